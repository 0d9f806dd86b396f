"""Decontamination, toxicity and quality against their definitions, written out plainly."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from buildloom.llm import decontam, quality, toxicity
from buildloom.llm import textvec as tv


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_decontamination_matches_all_windows(spark):
    draw = random.Random(21)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "ck", "lp")]
    prose = lambda n: [draw.choice(["the", "of", "and"]) if draw.random() < 0.3 else draw.choice(vocab) + draw.choice(vocab) for _ in range(n)]
    items = {i: prose(draw.randrange(6, 45)) for i in range(12)}
    docs = {}
    for d in range(150):
        t = prose(draw.randrange(3, 160))
        if d % 3 == 0:
            p = [w if draw.random() > (d % 5) * 0.12 else draw.choice(vocab) for w in items[draw.randrange(12)]]
            t[(at := draw.randrange(len(t))) : at] = p
        docs[d] = t
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.share, r.answer) for r in decontam.contaminated(frame, bench).collect()}
    # the words' weights, as the benchmark's words occur in the documents' blocks
    size = decontam.BLOCK
    blocks = [set(t[a : a + size]) for t in docs.values() for a in range(0, len(t), size)]
    weight = {w: float(np.log((len(blocks) + 1) / (sum(w in b for b in blocks) + 1))) for p in items.values() for w in p}
    hashed = {w: int(tv.hash_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), tv.ALNUM)[0][0]) for w in weight}
    found = 0
    for i, p in items.items():
        kinds = sorted(set(p), key=lambda w: (-weight[w], hashed[w]))
        answer, total = set(kinds[: max(1, len(kinds) // 3)]), sum(weight[w] for w in kinds)
        for d, t in docs.items():
            best, sure = (0.0, 0.0), False
            for a in range(0, len(t), size):
                window = t[max(a - len(p), 0) : a + 2 * size + len(p)]
                told = len(answer & set(window)) / len(answer)
                if told >= decontam.LEAST_ANSWER:
                    share = lcs(p, window) / len(p)
                    best = max(best, (share, told))
                    heavy = sum(weight[w] for w in set(p) & set(window)) >= decontam.LEAST_ANSWER * total
                    sure |= share >= decontam.LEAST_SHARE and heavy
            if sure:
                found += 1
                assert (d, i) in got
            if (d, i) in got:
                # what the cosine finds beside is held to the same checks, in some window
                assert best[0] >= got[d, i][0] - 1e-9 >= decontam.LEAST_SHARE - 1e-9 and got[d, i][1] >= decontam.LEAST_ANSWER
    assert found >= 25


def word_hash(b: bytes, head: int = 0) -> int:
    out = tv.hash_words(np.frombuffer(b, np.uint8), np.array([0, len(b)]), tv.ALNUM, (head,) if head else ())
    return int(out[4][0][0]) if head else int(out[0][0])


def test_toxicity_is_the_noisy_or_of_sentences(spark):
    draw = random.Random(4)
    words = [f"calm{i}" for i in range(40)]
    rows, marks = [], []
    for i in range(260):
        text = [draw.choice(words) for _ in range(draw.randrange(1, 40))]
        bad = draw.random() < 0.3
        if bad:
            text[draw.randrange(len(text))] = draw.choice(["vilethings", "vilething", "nastyness"])
        rows.append((i, "".join(w + draw.choice([" ", ". ", "\n", "! ", " é "]) for w in text)))
        marks.append((i, int(bad)))
    rows += [(900, None), (901, " . ! "), (902, "Vilethings! vilethings VILETHING")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels, "toxic", toxicity.MOST_LABELLED).select("id", "text", "y").toArrow().sort_by("id")
    model = toxicity.fit(sample["text"], sample["y"].to_numpy().astype(np.int64))
    weights = dict(zip(model.known.tolist(), model.weights.tolist()))
    assert weights
    for r in toxicity.toxicity(docs, labels).collect():
        text, none = dict(rows)[r.doc_id] or "", 1.0
        for sentence in re.split(r"[\n.!?]", text):
            found = re.findall(rb"[a-z0-9\x80-\xff]+", sentence.encode().lower())
            if found:
                kinds = {word_hash(w) for w in found} | {word_hash(w, k) for w in found for k in toxicity.HEADS if len(w) > k}
                none *= 1 - 1 / (1 + np.exp(-(model.bias + sum(weights.get(h, 0.0) for h in kinds))))
        assert r.score == pytest.approx(1 - none, abs=1e-9), r
        assert r.predicted == int(r.score >= 0.5)


def test_quality_minimises_the_pairs_loss_and_cuts_at_the_best_quantile():
    draw = random.Random(8)
    good = [" ".join(draw.choice(["plain", "words", "said", "well", "today"]) for _ in range(draw.randrange(10, 60))) + "." for _ in range(80)]
    poor = [" ".join(draw.choice(["BUY!!", "@@@", "now!!", "x1x2x3", "$$$$", "plain"]) for _ in range(draw.randrange(10, 60))) for _ in range(50)]
    texts, y = pa.chunked_array([pa.array(good + poor)]), np.array([1] * 80 + [0] * 50)
    m = quality.fit(texts, y)
    buf, offsets = tv.text_buffer(texts)
    z = quality.standard(quality.features(buf, offsets), m.mean, m.scale)
    d = (z[:80, None, :] - z[None, 80:, :]).reshape(-1, z.shape[1])

    def loss(w):
        return np.logaddexp(0, -(d @ w)).mean() + 0.5e-3 * (w @ w)

    # no small step in any direction does much better than the fit
    base, noise = loss(m.weights), np.random.default_rng(1)
    assert all(loss(m.weights + 0.3 * noise.standard_normal(len(m.weights)) / 5) > base - 0.01 for _ in range(50)) and base < 0.5 * loss(0 * m.weights)
    raw = m.raw(quality.features(buf, offsets))
    assert np.allclose(raw, z @ m.weights)
    # the cut parts the labels as well as any cut does
    gain = lambda c: (raw[80:] < c).mean() - (raw[:80] < c).mean()
    assert gain(m.cut) >= max(gain(c) for c in raw) - 0.02
    # a text's score does not depend on the others, and CUT lies at the cut
    for i in (0, 5, 85, 120):
        alone, o = tv.text_buffer(texts.slice(i, 1))
        assert m.score(quality.features(alone, o))[0] == pytest.approx(m.score(quality.features(buf, offsets))[i])
    assert ((m.score(quality.features(buf, offsets)) >= quality.CUT) == (raw >= m.cut)).all()
