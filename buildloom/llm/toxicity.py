"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's score is a logistic function of the words and the beginnings of words (`HEADS` bytes,
so that inflected forms count together) in it; a document's is the noisy-or of its sentences', and
the weights are fitted to document labels alone.  The fit uses at most `MOST_LABELLED` labelled
documents, and of their words and beginnings those that `LEAST_DOCS` toxic ones hold and that are
half as frequent again in toxic ones as in others; scoring reads every sentence of every whole text
and says which sentences offend.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import held_out
from .labelled import training_sample

MOST_LABELLED, LEAST_DOCS, HEADS = 6000, 3, (4, 5, 6, 7, 8, 9)

_STOPS = np.zeros(256, bool)
_STOPS[[10, 33, 46, 63]] = True  # line end ! . ?


def sentence_words(buf: np.ndarray, offsets: np.ndarray):
    """(hashes of words and of their heads, sentence of each word, sentences' offsets by text, sentences' begins and ends in bytes).

    A sentence runs up to the next line end, full stop, exclamation or question mark; sentences without words are left out."""
    words, begin, _, woffs, heads = tv.hash_words(buf, offsets, tv.ALNUM, HEADS)
    stops = np.flatnonzero(_STOPS[buf])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(woffs))
    part = np.searchsorted(stops, begin)
    new = np.ones(len(words), bool)
    if len(words):
        new[1:] = (text[1:] != text[:-1]) | (part[1:] != part[:-1])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    soffs = np.searchsorted(text[first], np.arange(len(offsets)))
    lo = np.maximum(np.concatenate([[-1], stops])[part[first]] + 1, offsets[text[first]])
    hi = np.minimum(np.concatenate([stops + 1, [len(buf)]])[part[first]], offsets[text[first] + 1])
    return [words, *heads], sentence, soffs, lo, hi


def _once(sentence: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature counts once in a sentence."""
    pair = np.unique(sentence.astype(np.int64) * n + feature)
    return pair // n, pair % n


class Model:
    """Weights of hashes and a bias."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float):
        self.known, self.weights, self.bias = known, weights, bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[known >> np.uint64(44)] = True

    def sentence_scores(self, hashes: list[np.ndarray], sentence: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.bias)
        found = []
        for h in hashes if len(self.known) else ():
            likely = np.flatnonzero(self.maybe[h >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.known, h[likely]), len(self.known) - 1)
            hit = self.known[at] == h[likely]
            found.append((sentence[likely[hit]], at[hit]))
        if found:
            s, f = _once(*(np.concatenate(x) for x in zip(*found)), len(self.known))
            z += np.bincount(s, weights=self.weights[f], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _any(p: np.ndarray, soffs: np.ndarray) -> np.ndarray:
    """The noisy-or of each text's sentences; 0 without a sentence."""
    total = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
    out = np.zeros(len(soffs) - 1)
    full = np.flatnonzero(np.diff(soffs))
    if len(full):
        out[full] = -np.expm1(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), soffs[full]))
    return np.clip(out, 0.0, 1.0)


def fit(texts, y: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 0.3, boost: float = 3.0, least_docs: int = LEAST_DOCS) -> Model:
    """Full-batch gradient descent (Adam) on the noisy-or's log likelihood with a quadratic penalty, toxic documents counted `boost` times; texts is an Arrow string column."""
    buf, offsets = tv.text_buffer(texts)
    hashes, sentence, soffs, _, _ = sentence_words(buf, offsets)
    n = int(soffs[-1])
    doc = np.repeat(np.arange(len(y)), np.diff(soffs))
    bad, good = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    known, s, f = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for h in hashes:
        vocab, feature = np.unique(h, return_inverse=True)
        found = np.unique(doc[sentence] * len(vocab) + feature)
        in_bad = np.bincount(found % len(vocab), weights=y[found // len(vocab)], minlength=len(vocab))
        in_docs = np.bincount(found % len(vocab), minlength=len(vocab))
        keep = (in_bad >= least_docs) & (in_bad / bad >= 1.5 * (in_docs - in_bad) / good) & (vocab > 0)
        new, used = np.cumsum(keep) - 1, keep[feature]
        if used.any():
            more = _once(sentence[used], new[feature[used]], int(keep.sum()))
            s, f = np.concatenate([s, more[0]]), np.concatenate([f, more[1] + len(known)])
            known = np.concatenate([known, vocab[keep]])
    m = len(known)
    full = np.flatnonzero(np.diff(soffs))
    theta = np.append(np.zeros(m), -5.0)  # the words' weights, then the bias
    mean, square = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(theta[m] + np.bincount(s, weights=theta[f], minlength=n))))
        none = np.ones(len(y))
        none[full] = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), soffs[full]))
        dz = np.where(y == 1, -boost * none / np.maximum(1 - none, 1e-9), 1.0)[doc] * p
        g = np.append(np.bincount(f, weights=dz[s], minlength=m) + decay * theta[:m], dz.sum())
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    w, bias = theta[:m], theta[m]
    strong = np.flatnonzero(np.abs(w) >= 0.02)
    strong = strong[np.argsort(known[strong])]
    return Model(known[strong], w[strong], float(bias))


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            buf, offsets = tv.text_buffer(batch.column(1))
            ids, held = batch.column(0), batch.column(2)
            for a, b in tv.groups(offsets):
                part = offsets[a : b + 1]
                piece = buf[part[0] : part[-1]]
                hashes, sentence, soffs, lo, hi = sentence_words(piece, part - part[0])
                p = m.sentence_scores(hashes, sentence, int(soffs[-1]))
                bad = np.flatnonzero(p >= 0.5)
                points = np.concatenate([[0], np.cumsum((piece & 0xC0) != 0x80)])
                base = points[(part - part[0])[np.searchsorted(soffs, bad, side="right") - 1]]
                spans = pa.StructArray.from_arrays([pa.array(points[lo[bad]] - base), pa.array(points[hi[bad]] - base), pa.array(p[bad])], names=["start", "end", "score"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(bad, soffs).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), held.slice(a, b - a), pa.array(_any(p, soffs)), lists], names=["id", "held_out", "score", "sentences"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most: int = MOST_LABELLED) -> DataFrame:
    """(id, held_out, score, predicted, sentences) of each row of docs.

    Fits on at most `most` labelled rows whose crc32(id as text) mod 5 is not 0.  sentences holds
    start, end (code points) and score of each sentence that scores 0.5 or more.  A text that is
    null, empty or without words scores 0.  With no labels all texts score near 0.  Repeated rows
    are scored each; a null id is scored and is not held out; other columns are not read.
    """
    sample = training_sample(docs, labels, label, most, id_col, text_col).select("id", "text", "y").toArrow().sort_by("id")
    model = fit(sample["text"], sample["y"].to_numpy().astype(np.int64))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out(id_col, 0).alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"id {kind}, held_out boolean, score double, sentences array<struct<start: long, end: long, score: double>>")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
