"""Classifiers and the language model: held-out accuracy, exact base scores, a proper distribution, edge cases; and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from buildloom.llm import quality, suffix_tree, toxicity
from buildloom.llm import textvec as tv


def held(i, r=0):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == r


def corpus(n=700, seed=1):
    draw, vocab = random.Random(seed), [f"wo{i}rd" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(vocab) for _ in range(draw.randrange(8, 80))]
        toxic, poor = draw.random() < 0.25, draw.random() < 0.3
        if toxic:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(["vilething", "vilest", "nastyword"])
        if poor:
            words = [w.upper() + "!!" for w in words]
        text = ""
        for k, w in enumerate(words):
            text += w + (". " if k % 7 == 6 else " ")
        rows.append((i, text))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(9001, None), (9002, ""), (None, "no id here")], "doc_id long, text string")
    return docs, spark.createDataFrame(labels + [(None, 1, 1), (9500, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int"), labels


def accuracy(rows, truth):
    pairs = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(p == t for p, t in pairs) / len(pairs)


def test_toxicity(tables):
    docs, labels, truth = tables
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 703 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, {i: t for i, _, t in truth if i != 3}) >= 0.9
    texts = dict(corpus()[0])
    found = [texts[r.doc_id][s.start : s.end] for r in rows if r.doc_id in texts for s in r.sentences]
    assert found and sum("vile" in f.lower() or "nasty" in f.lower() for f in found) >= 0.9 * len(found)
    assert {r.score for r in rows if r.doc_id in (9001, 9002)} == {0.0}


def test_quality(tables):
    docs, labels, truth = tables
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == 703 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert accuracy(rows, {i: q for i, q, _ in truth if i != 3}) >= 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.predicted)


def test_without_labels(spark, tables):
    docs, labels, _ = tables
    for out in (toxicity.toxicity(docs, labels.limit(0)), quality.quality(docs, labels.limit(0))):
        assert out.count() == 703
    assert toxicity.toxicity(docs.limit(0), labels).count() == quality.quality(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in quality.quality(docs, labels.limit(0)).collect()} == {1}


def test_labels_of_held_out_rows_are_not_used(spark, tables):
    docs, labels, _ = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_base_scores(spark):
    rows = [(i, t) for i, t in corpus(120)[0]] + [(7001, None), (7002, " \t"), (7003, "ONE  two\x0bthree"), (7003, "ONE  two\x0bthree"), (None, "é one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows if not held(i, 1) for w in words(t))
    n, v = sum(c.values()), len(c)
    for sent in (1 << 18, 50, 0):  # whichever way a word's count comes, it is exact
        got = suffix_tree.lm_scores(docs, sent_words=sent).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r for r in got}
        for i, t in rows:
            r = by[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 1), len(words(t)), sum(c[w] > 0 for w in words(t)), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)))
            assert r.score < 0
        assert by[7001].score == by[7002].score


class PlainTree:
    """The suffix tree by its definition, over lists of words."""

    def __init__(self, texts, depth, share, gain):
        self.depth, runs = depth, Counter()
        for t in texts:
            seq = [None, *t, None]
            for i in range(1, len(seq)):
                for k in range(min(depth, i) + 1):
                    runs[tuple(seq[i - k : i + 1])] += 1
        self.words = {r[0]: n for r, n in runs.items() if len(r) == 1}
        self.total = sum(self.words.values())
        self.least = max(2.0, share * self.total ** (2 / 3))
        self.runs = {r: n for r, n in runs.items() if n >= self.least}
        self.kept = {}
        for k in range(1, depth + 1):
            for s in {r[:-1] for r in self.runs if len(r) == k + 1}:
                nexts = {r[-1]: n for r, n in self.runs.items() if r[:-1] == s}
                seen, below = self.runs[s], {a: self.p(s[1:], a) for a in nexts}
                rest, left = seen - sum(nexts.values()), 1 - sum(below.values())
                far = sum(n * math.log(n / seen / below[a]) for a, n in nexts.items())
                far += rest * math.log(rest / seen / left) if rest else 0.0
                if far >= gain * self.least:
                    self.kept[s] = (nexts, seen, rest, left, len(nexts) + 1)

    def p(self, context, a):
        """By the longest retained suffix of the context."""
        if not context:
            return (self.words.get(a, 0) + 0.5) / (self.total + 0.5 * (len(self.words) + 1))
        if context not in self.kept:
            return self.p(context[1:], a)
        nexts, seen, rest, left, kinds = self.kept[context]
        below = self.p(context[1:], a)
        return (nexts[a] + kinds * below) / (seen + kinds) if a in nexts else (rest + kinds * left) / (seen + kinds) / left * below

    def score(self, words):
        seq = [None, *words, None]
        return sum(math.log10(self.p(tuple(seq[max(i - self.depth, 0) : i]), seq[i])) for i in range(1, len(seq)))


def phrases(n, seed=2):
    """Texts of phrases that come again and again, some words between them."""
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    stock = [[draw.choice(vocab) for _ in range(draw.randrange(2, 6))] for _ in range(25)]
    return [sum((draw.choice(stock) if draw.random() < 0.7 else [draw.choice(vocab), f"rare{draw.randrange(900)}"] for _ in range(draw.randrange(9))), []) for _ in range(n)]


@pytest.mark.parametrize("depth,share,gain", [(3, 4e-4, 0.5), (2, 0.02, 0.1), (1, 0.0, 3.0), (0, 0.0, 1.0)])
def test_tree_matches_its_definition(spark, depth, share, gain):
    texts = [*phrases(300), [], ["once"], ["w1"] * 50]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    plain = PlainTree([t for i, t in enumerate(texts) if not held(i, 1)], depth, share, gain)
    got = suffix_tree.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth, share=share, gain=gain, sent_words=20).collect()
    assert depth == 0 or plain.kept
    for r in got:
        assert r.score == pytest.approx(plain.score(texts[r.doc_id]), rel=1e-9), r
    # a proper distribution after any context: of all known symbols and of the one for all others
    for context in [(), *list(plain.kept)[:40], ("w1", "w2"), ("rare1",)]:
        assert sum(plain.p(context, a) for a in [*plain.words, "not there"]) == pytest.approx(1)


def test_tree_beats_word_counts_on_held_out_texts_and_grows(spark):
    states = []
    for n in (300, 3000):
        rows = [(i, " ".join(t)) for i, t in enumerate(phrases(n))]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        out = [r for r in suffix_tree.lm_scores(docs).collect() if r.held_out and r.n_tokens > 1]
        assert sum(r.score > r.base_score for r in out) >= 0.9 * len(out) and sum(r.score for r in out) > sum(r.base_score for r in out)
        words = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1").select("text")
        counts = words.mapInArrow(suffix_tree._counted(suffix_tree._words), "key long, n long").groupBy("key").sum("n").toDF("key", "n")
        total, kinds = counts.selectExpr("sum(n)", "count(*)").head()
        tree = suffix_tree.grow_tree(words, counts, total, kinds, 3, 0.02, 0.5, 100)
        states.append(sum(len(entries) for entries, _ in tree.levels))
    assert states[1] > states[0]


def test_word_hashes_do_not_depend_on_place():
    texts = ["The cat", "a  THE\tcat\n", "", "cat" + " z" * 400_000]
    buf, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    h, begin, end, woffs = tv.hash_words(buf, offs)
    assert np.diff(woffs).tolist() == [2, 3, 0, 400_001]
    assert h[0] == h[3] and h[1] == h[4] == h[5] and len(set(h[6:].tolist())) == 1


def test_pipeline(spark, tmp_path):
    rows, labels = corpus(400, 3)
    bench = " ".join(f"item{i}word" for i in range(30))
    extra = [(5000, rows[0][1] + " mail me at someone@mail.org now"), (5001, "one two three four five six seven. " + bench + " and more of it after that here."), (5002, None), (5003, "call +1 (555) 123-4567 about the wo1rd wo2rd wo3rd wo4rd.")]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows + extra + [(6000 + i, t) for i, t in rows[:40]]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == frame.columns, name
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id for r in frame.select("doc_id").collect()})
    good = {i for i, q, _ in labels if q}
    assert len(seen[0] & good) >= 0.97 * len(good) and len(seen[0] & ({i for i, _ in rows} - good)) <= 0.1 * (400 - len(good))
    assert not any(i - 6000 in seen[0] for i in seen[1] if 6000 <= i < 6040)
    assert seen[2] == seen[1] - {5001} and seen[3] == seen[2] == seen[4]
    texts = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert "<phone>" in texts[5003].text and texts[5003].n_chars == len(texts[5003].text)
    assert all(r.round_trip for r in frame.collect())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(seen[4])


def test_the_basis_is_fitted_on_all_blocks(spark):
    from pyspark.sql import functions as F

    from buildloom.llm import decontam
    from buildloom.llm import textvec as tv

    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{draw.integers(0, 40)}" if draw.random() < 0.4 else f"x{draw.integers(0, 900)}" for _ in range(draw.integers(1, 90))) for _ in range(300)]
    buf, offsets = tv.text_buffer(pa.array([" ".join(f"w{i}" for i in range(40))]))
    known = np.unique(tv.hash_words(buf, offsets, tv.ALNUM)[0])
    held = decontam.Words(known, draw.random(40) + 0.5, 0.7)
    frame = spark.createDataFrame([(t, 1.0 + (i % 3)) for i, t in enumerate(texts)], "text string, weight double")
    basis, most = decontam.randomised_svd(frame, held, rank=5, extra=35), decontam.GRAM
    try:
        decontam.GRAM = 0  # as for a benchmark of more words
        again = decontam.randomised_svd(frame, held, rank=5, extra=35)
    finally:
        decontam.GRAM = most
    rows = []
    for i, t in enumerate(texts):
        buf, offsets = tv.text_buffer(pa.array([t]))
        words = tv.hash_words(buf, offsets, tv.ALNUM)[0]
        for lo in range(0, len(words), decontam.BLOCK):
            row, mass = np.zeros(40), 0.0
            for w in words[lo : lo + decontam.BLOCK].tolist():
                at = np.searchsorted(known, w)
                if at < 40 and known[at] == w:
                    row[at] += held.weight[at]
                mass += held.weight[at] ** 2 if at < 40 and known[at] == w else 0.7**2
            rows.append(row / np.sqrt(mass) * np.sqrt(1.0 + i % 3))
    want = np.linalg.svd(np.array(rows))[2][:5].T
    assert max(np.abs(np.abs((b * want).sum(0)) - 1).max() for b in (basis, again)) < 1e-2
    # every text's blocks are in what the search is fitted on, however many there are
    seen = []
    real, decontam.randomised_svd = decontam.randomised_svd, lambda p, h, **how: seen.append(p.agg(F.count("*"), F.sum(F.when(F.col("weight") == 1.0, 1))).head()) or real(p, h, **how)
    try:
        many = spark.range(40_000).select(F.concat(F.lit("w1 w2 w3 "), F.expr("repeat(concat('u', id, ' '), 16)")).alias("text"))
        decontam.fitted(many, spark.createDataFrame([(1, texts[0] + " w1")], "item_id long, text string"))
    finally:
        decontam.randomised_svd = real
    assert seen[0][1] == 40_000


def test_quality_is_fitted_on_all_labelled_rows(spark):
    # 12,000 labelled rows, of which those with telling words are the last by hash
    from pyspark.sql import functions as F

    rows = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.lit("!! ## $$ %% QQ !! ## $$ QQ")).otherwise(F.concat(F.lit("plain words of text number "), "id", F.lit(".")))
                                      .alias("text"), F.when(F.col("id") % 4 == 0, 0).otherwise(1).alias("quality"))
    seen = []
    real, quality.cut_of = quality.cut_of, lambda raw, good, poor: seen.append((int(good.sum()), int(poor.sum()))) or real(raw, good, poor)
    try:
        model = quality.fitted(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
    finally:
        quality.cut_of = real
    left = [i for i in range(12_000) if zlib.crc32(str(i).encode()) % 5]
    assert seen == [(sum(i % 4 > 0 for i in left), sum(i % 4 == 0 for i in left))] and len(left) > 9_000
    x = quality._features_of(pa.array(["!! ## $$ %% QQ !! ## $$ QQ", "plain words of text number 7777."]))
    assert model.score(x)[0] < quality.CUT <= model.score(x)[1]


def test_quality_weights_are_those_of_all_pairs_of_all_labelled_rows(spark):
    # kinds that overlap, so that the weights depend on which pairs are met
    draw = random.Random(11)
    rows = []
    for i in range(2_500):
        good = draw.random() < 0.8
        words = [draw.choice(["plain", "words", "Said", "well,", "today.", "12"]) if draw.random() < (0.7 if good else 0.5) else draw.choice(["BUY!!", "@@@", "now!", "x1", "$$"]) for _ in range(draw.randrange(3, 40))]
        rows.append((i, " ".join(words), int(good)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model, again = (quality.fitted(f.select("doc_id", "text"), f.select("doc_id", "quality")) for f in (frame, frame.orderBy("text").repartition(7)))
    left = [r for r in rows if not held(r[0])]
    x = quality._features_of(pa.array([t for _, t, _ in left]))
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-3))
    z, y = quality.standard(x, model.mean, model.scale), np.array([q for _, _, q in left])
    good, poor = z[y == 1], z[y == 0]
    lost = 1 / (1 + np.exp((good @ model.weights)[:, None] - (poor @ model.weights)[None, :]))  # for each pair, how much it pulls
    assert lost.mean() > 0.01
    slope = (lost.sum(0) @ poor - lost.sum(1) @ good) / lost.size + 1e-3 * model.weights
    assert np.abs(slope).max() < 1e-4
    assert np.allclose(model.weights, again.weights, atol=1e-6)
