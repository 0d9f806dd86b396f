"""Each operator on odd rows: nulls, empty and very long texts, repeats and ties, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from buildloom.llm import bpe, decontam, fingerprints, licenses, near_dup, pii, quality, suffix_tree, token_counts, toxicity
from buildloom.llm.queries import tokenizer

PASSAGE = "the quick amber lantern drifts over nine quiet harbours while seven tall ferries wait beyond the old stone pier at dusk"
LONG = " ".join(f"word{i % 997} and" for i in range(60_000))
ROWS = [
    (1, "Plain words in a line. More of them here."), (2, None), (3, ""), (4, " \t\n "), (None, "no id at all"), (None, None), (5, LONG), (6, "ü é ñ 🙂 中文 text"), (7, f"before {PASSAGE} after"),
    (8, "same text twice over and over again now"), (9, "same text twice over and over again now"), (8, "same text twice over and over again now"), (10, "mail a@b.cd from 10.0.0.1, released under the MIT License."), (11, "x"), (12, "\x00 odd \x0b bytes"),
]
#: names that the operators use inside, as extra columns of the caller
EXTRA = ["id", "row", "key", "rep", "label", "held", "held_out", "score", "n", "found", "base", "sigs", "ids", "item_id", "word", "chunk", "part", "u", "v", "predicted"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 2 == 0), int(i % 3 == 0)) for i in range(1, 13)] + [(None, 1, 1), (8, 0, 1), (99, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (None, PASSAGE)], "item_id long, text string")


def operators(labels, bench):
    byte, piece = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    plain = lambda d: d.select("doc_id", "text")
    return {
        "contaminated": lambda d: decontam.contaminated(d, bench), "near_duplicates": lambda d: near_dup.near_duplicates(d, k=4), "bpe": lambda d: bpe.digests(bpe.decode(bpe.encode(plain(d), byte), byte)), "token_counts": lambda d: token_counts.token_counts(d, piece),
        "toxicity": lambda d: toxicity.toxicity(d, labels).drop("sentences"), "quality": lambda d: quality.quality(d, labels), "pii": lambda d: pii.digests(pii.find_pii(d)), "licenses": licenses.license_scan, "lm": suffix_tree.lm_scores, "spotsigs": fingerprints.edited_and_next,
    }


NAMES = ["contaminated", "near_duplicates", "bpe", "token_counts", "toxicity", "quality", "pii", "licenses", "lm", "spotsigs"]
#: those that give a row for each row of documents
ROWWISE = set(NAMES) - {"contaminated", "licenses"}


def rows(df):
    return sorted(str([f"{x:.9g}" if isinstance(x, float) else x for x in r]) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, docs, labels, bench, name):
    run = operators(labels, bench)[name]
    got = run(docs)
    whole = rows(got)
    if name in ROWWISE:
        assert len(whole) == len(ROWS)
        assert sorted(map(str, (r.doc_id for r in got.select("doc_id").collect()))) == sorted(str(i) for i, _ in ROWS)
    # the rows' order does not matter
    assert rows(run(docs.orderBy(F.desc("text")).coalesce(1))) == whole


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_and_empty_tables(spark, docs, labels, bench, name):
    run = operators(labels, bench)[name]
    small = docs.where("text is null or length(text) < 1000")
    wide = small.select("doc_id", "text", *(F.lit(f"own {c}").alias(c) for c in EXTRA))
    assert rows(run(wide)) == rows(run(small))
    none = run(docs.limit(0))
    assert none.columns == run(small).columns and none.count() == 0


def test_found_rows(spark, docs, labels, bench):
    run = operators(labels, bench)
    assert {(r.doc_id, r.item_id) for r in run["contaminated"](docs).collect()} == {(7, 1)}
    assert {(r.doc_id, r.license) for r in run["licenses"](docs).collect()} == {(10, "MIT")}
    same = {r.doc_id: r.component_id for r in run["near_duplicates"](docs).collect() if r.doc_id in (8, 9)}
    assert same == {8: 8, 9: 8}
    assert [r.spans for r in run["pii"](docs).collect() if r.doc_id == 10] == ["email:5:11,ip:17:25"]
    for name, c in (("toxicity", "score"), ("quality", "score"), ("lm", "score"), ("token_counts", "n_tokens")):
        # equal texts fare alike
        assert len({r[c] for r in run[name](docs).collect() if r.doc_id in (8, 9)}) == 1, name


@pytest.mark.parametrize("stage", ["keep_good", "keep_one", "drop_contaminated", "redacted"])
def test_filters_keep_all_columns(spark, docs, labels, bench, stage):
    wide = docs.where("text is null or length(text) < 1000").select("doc_id", "text", *(F.lit(f"own {c}").alias(c) for c in EXTRA))
    run = {"keep_good": lambda d: quality.keep_good(d, labels.limit(0)), "keep_one": near_dup.keep_one_of_each, "drop_contaminated": lambda d: decontam.drop_contaminated(d, bench), "redacted": pii.redacted}[stage]
    out = run(wide)
    assert out.columns == wide.columns
    got = out.collect()
    assert all(r[c] == f"own {c}" for r in got for c in EXTRA)
    gone = {"keep_good": 0, "keep_one": 1, "drop_contaminated": 1, "redacted": 0}[stage]
    assert len(got) == wide.count() - gone
    assert run(wide.limit(0)).count() == 0


def test_one_id_with_several_texts_fits_alike(spark, labels):
    texts = [(i, f"good calm words number {i} here") for i in range(1, 13)] + [(i, f"bad loud words number {i} there!!") for i in range(1, 13)]
    scores = []
    for order in (texts, texts[::-1]):
        frame = spark.createDataFrame(order, "doc_id long, text string").repartition(4)
        scores.append(sorted((r.doc_id, round(r.score, 12)) for r in quality.quality(frame, labels).collect()))
    assert scores[0] == scores[1]
