"""Near duplicates and fingerprints against brute force, and their edge cases."""

import hashlib
import random

from pyspark.sql import functions as F

from buildloom.llm import fingerprints as fp
from buildloom.llm import near_dup as nd


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets, parent = {}, {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t, k))
            parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in ids}


def family(seed, words, copies, edits):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        t = list(base)
        for _ in range(draw.randrange(edits + 1)):
            t[draw.randrange(words)] = f"e{draw.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_families_match_brute_force(spark):
    texts = [t for s in range(12) for t in family(s, 20 + 15 * s, 9, 6)] + family(99, 150, 160, 9)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (4, 5):
        got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs, k=k).collect()}
        assert got == brute(rows, k)


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(5, "A b\tC d e"), (2, "a B c D\ne"), (9, "one two"), (7, "ONE  two"), (3, None), (4, ""), (6, " \n "), (None, "one two"), (8, long), (1, long + " tail"), (9, "other words here now ok")]
    docs = spark.createDataFrame([(i, t, "id", 0) for i, t in rows], "doc_id long, text string, id string, key int")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(docs, k=4).collect()]
    assert len(got) == len(rows)
    by = {i: (c, k) for i, _, c, k in got if i is not None}
    want = brute(rows, 4)
    assert {i: c for i, (c, _) in by.items()} == want
    assert all(k == (i == c) for i, (c, k) in by.items())
    assert (None, 1, None, True) in got
    assert {n for i, n, _, _ in got if i in (3, 4, 6)} == {0}


def test_sketches_never_lose_a_link():
    import numpy as np

    draw = random.Random(6)
    for _ in range(200):
        a = {draw.getrandbits(64) for _ in range(draw.randrange(1, 3000))}
        b = set(draw.sample(sorted(a), draw.randrange(len(a) // 2, len(a) + 1))) | {draw.getrandbits(64) for _ in range(draw.randrange(len(a) // 3 + 1))}
        cells = [np.minimum(np.bincount([x >> 54 for x in s], minlength=nd.SKETCH), 255).astype(np.uint8)[None, :] for s in (a, b)]
        if 100 * len(a & b) >= 80 * len(a | b):
            assert nd._able(*cells, 80)[0]
        if len(a) < 2000 and not a & b:
            assert not nd._able(*cells, 80)[0]


def test_links_right_at_the_threshold(spark):
    # 400 shingles, of which the pair shares just 80 of 100 of the union, or one too few
    base = [f"w{i}" for i in range(364)]
    over = lambda n: " ".join([*base[:n], *(f"z{i}" for i in range(364 - n))])
    rows = [(1, " ".join(base)), *((10 + n, over(n)) for n in range(300, 364, 3))]
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=5).collect()}
    assert got == brute(rows, 5)


def test_empty_table_and_stage(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert nd.near_duplicates(none).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, "z", None)], "doc_id long, text string, lang string")
    kept = nd.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_edited_texts_and_next(spark):
    texts = [(10, "The cat sat on the mat and it was good"), (3, None), (7, ""), (5, "é" * 9), (20, "the 🙂 of x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in fp.edited_and_next(docs).collect()}
    order = sorted(texts)
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        q = len(t) // 4
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
    assert got[3].fingerprint == got[7].fingerprint and got[3].near_next == 0.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_next_over_many_ranges(spark):
    docs = spark.range(2000).select((F.col("id") * F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows = {r.doc_id: r.next_text for r in fp.with_next(docs, "doc_id", "text").collect()}
    assert rows == {i * i: str((i + 1) % 2000) for i in range(2000)}


def spots(text):
    import re

    words, common = re.sub(r"[\W_]+", " ", (text or "").lower()).split(), set(fp.COMMON)
    out, last = set(), None
    content = [(i, w) for i, w in enumerate(words) if w not in common]
    for n, (i, w) in enumerate(content):
        if i and words[i - 1] in common:
            out.add((words[i - 1], w, content[n + 1][1] if n + 1 < len(content) else None))
    return out or {("", " ".join(words))}


def test_signatures_and_alike_sets(spark):
    draw = random.Random(4)
    words = [*fp.COMMON[:8], *(f"c{i}" for i in range(30))]
    rows = []
    for i in range(40):
        t = [draw.choice(words) for _ in range(60)]
        rows.append((2 * i, " ".join(t)))
        t[draw.randrange(60)] = "changed"
        rows.append((2 * i + 1, " ".join(t)))
    rows += [(100, rows[0][1]), (101, "of the"), (102, None)]
    prints = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {i: spots(t) for i, t in rows}
    assert {r.doc_id: len(r.signatures) for r in prints.collect()} == {i: len(s) for i, s in want.items()}
    classes, pairs = fp.alike(prints, 0.8)
    rep = {r.id: r.rep for r in classes.collect()}
    assert rep[100] == 0 and all(want[i] == want[r] for i, r in rep.items())
    reps = sorted(set(rep.values()))
    close = {(a, b) for a in reps for b in reps if a < b and len(want[a] & want[b]) >= 0.8 * len(want[a] | want[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == close and close


def test_next_over_clusters_of_ids(spark, monkeypatch):
    monkeypatch.setattr(fp, "TASK_CHARS", 1000)
    # ids in two far clusters: the ranges follow the rows, not the width of the ids
    ids = [*range(0, 3000), *range(10**12, 10**12 + 3000), -(2**62), 2**62]
    docs = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    order = sorted(ids)
    got = fp.with_next(docs, "doc_id", "text")
    assert {r.doc_id: r.next_text for r in got.collect()} == {a: str(b) for a, b in zip(order, order[1:] + order[:1])}


def test_likeness_and_order_with_nulls_and_repeats(spark):
    texts = [(None, "the cat of a dog in the sun"), (2, "the cat of a dog in the moon"), (2, "and so on to an end"), (5, None), (9, "the cat of a dog in the sun " * 40)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, id string, sigs int")
    got = fp.edited_and_next(docs).collect()
    assert len(got) == len(texts)
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    by = {(r.doc_id, r.n_chars): r for r in got}
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        near = lambda a, b: len(spots(a) & spots(b)) / len(spots(a) | spots(b))
        r = by[i, len(t)]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - near(t, edited)) < 1e-9 and abs(r.near_next - near(t, nxt)) < 1e-9
    assert fp.edited_and_next(docs.limit(0)).count() == 0
