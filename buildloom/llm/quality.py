"""Quality by Bradley-Terry ranking: a good document should beat a poor one.

Preference pairs are a labelled good document against a poor one; the logistic loss of the
difference of their features fits one weight for each feature, hence a score for each document
alone.  The cut is the quantile of the fitted documents' scores that best parts the labels, and
scores are mapped so that it lies at `CUT`.  Every labelled good row meets every labelled poor one:
what a row adds to the slope depends on its own score and on how many rivals have which score, so
each round of Newton's method sums rows up by steps of their score (`BIN`), and no pair is drawn or
written out.  Scales, weights and the cut are those of all labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import held_out, written
from .labelled import training_rows

CUT = 0.3
#: bytes of text whose features are worked out at once; each takes some 30 times its size for a moment
TEXT_BYTES = 1 << 18
#: bytes at which a text's own shares weigh as much as the average ones
SHORT = 40.0

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = tv.ALNUM.copy()
_LETTER[48:58] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 44, 46, 58, 59, 63]] = True
_ODD = ~tv.ALNUM & tv.SPACED & ~_STOP
_ODD[[34, 39, 40, 41, 45]] = False


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text: shares of kinds of bytes, words and lines, and repetition."""
    n = len(offsets) - 1
    words, begin, end, woffs = tv.hash_words(buf, offsets)
    text = np.repeat(np.arange(n), np.diff(woffs))
    nw, nb = np.diff(woffs).astype(float), np.diff(offsets).astype(float)

    def per_text(flags):
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def over_words(x):
        return np.bincount(text, weights=x, minlength=n) / np.maximum(nw, 1)

    letters = per_text(_LETTER[buf])
    upper = per_text(_UPPER[buf])
    tail, head = buf[end - 1], buf[begin]
    length = (end - begin).astype(float)
    lone = (length <= 3) & ~tv.ALNUM[head] & ~tv.ALNUM[tail]
    distinct, _ = np.unique(text * np.int64(1 << 40) + (words >> np.uint64(24)).astype(np.int64), return_counts=True) if len(words) else (np.zeros(0, np.int64), None)
    kinds = np.bincount(distinct >> 40, minlength=n)
    pairs = tv.mix(words[:-1] * np.uint64(3) + words[1:])[text[1:] == text[:-1]] if len(words) > 1 else words[:0]
    pair_text = text[:-1][text[1:] == text[:-1]] if len(words) > 1 else text[:0]
    pair_kinds = np.bincount(np.unique(pair_text * np.int64(1 << 40) + (pairs >> np.uint64(24)).astype(np.int64)) >> 40, minlength=n)
    not_line = np.ones(256, bool)
    not_line[10] = False
    lines, lb, le, loffs = tv.hash_words(buf, offsets, not_line)
    line_text = np.repeat(np.arange(n), np.diff(loffs))
    nl = np.diff(loffs).astype(float)
    line_kinds = np.bincount(np.unique(line_text * np.int64(1 << 40) + (lines >> np.uint64(24)).astype(np.int64)) >> 40, minlength=n)
    odd = per_text(_ODD[buf])
    return np.stack([
        nb / (nb + SHORT),
        (nw == 0).astype(float),
        over_words(np.minimum(length, 30)) / 10,
        upper / np.maximum(letters, 1),
        np.sqrt(upper / np.maximum(letters, 1)),
        per_text(_DIGIT[buf]) / np.maximum(nb, 1),
        odd / np.maximum(nb, 1),
        np.sqrt(odd / np.maximum(nb, 1)),
        per_text(_STOP[buf]) / np.maximum(nw, 1),
        over_words(_ODD[tail]),
        over_words(_ODD[head]),
        over_words(tail == 33),
        over_words((length > 2) & (tail == 33)),
        over_words(lone),
        np.sqrt(over_words(lone)),
        over_words(length > 20),
        over_words(length <= 2),
        over_words(tv.ALNUM[tail] & tv.ALNUM[head]),
        kinds / np.maximum(nw, 1),
        kinds / np.maximum(np.sqrt(nw * 30), 1),
        1 - pair_kinds / np.maximum(nw - 1, 1),
        np.sqrt(np.maximum(1 - pair_kinds / np.maximum(nw - 1, 1), 0)),
        1 - line_kinds / np.maximum(nl, 1),
        np.minimum(nw / np.maximum(nl, 1), 200) / 100,
        per_text(buf >= 128) / np.maximum(nb, 1),
    ], 1)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Scaled features; a short text's are drawn towards the average, as its shares say little."""
    z = np.clip((x - mean) / scale, -4, 4)
    z[:, 2:] *= x[:, :1]
    z[:, 0] = 0.0
    return z


class Ranker:
    """A linear score on scaled features, and how it maps to 0 to 1."""

    def __init__(self, mean, scale, weights, cut: float, slope: float):
        self.mean, self.scale, self.weights, self.cut, self.slope = mean, scale, weights, cut, slope

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (standard(x, self.mean, self.scale) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self.raw(x) - self.cut) * self.slope, -30, 30) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def _features_of(texts) -> np.ndarray:
    buf, offsets = tv.text_buffer(texts)
    if len(offsets) < 2:
        return features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[:0]
    return np.concatenate([features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in tv.groups(offsets, TEXT_BYTES)])


#: steps of a score by which rows meet their rivals (a row between two of them counts in both, by its place), and how many of them share one curvature
BIN, WIDE = 1 / 64, 32
#: features are summed up as whole numbers of this part, so that no order of rows changes a sum
_UNIT = 1 << 13


def _slot(width: int) -> int:
    """Numbers of one kind of rows in one stretch of `WIDE` steps: (rows, sums of features) of each step, then those and the products of features of the stretch."""
    return (WIDE + 1) * (1 + width) + width * width


def _by_score(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of scores that the rows lie in, and the numbers of each (stretches x kinds x `_slot`), poor ones first."""
    z = np.rint(z * _UNIT)
    place = (z * w).sum(1) / (_UNIT * BIN)
    step = np.floor(place).astype(np.int64)
    upper, width = np.rint((place - step) * _UNIT), z.shape[1]
    low = int(step.min()) // WIDE
    out = np.zeros((int(step.max() + 1) // WIDE - low + 1, 2, _slot(width)), np.int64)
    one, fine = np.column_stack([np.ones(len(z)), z]), WIDE * (1 + width)
    for kind in (0, 1):
        mine = np.flatnonzero(y == kind)
        for at, share in ((step[mine], _UNIT - upper[mine]), (step[mine] + 1, upper[mine])):
            total = np.stack([np.bincount(at - low * WIDE, weights=share * c, minlength=len(out) * WIDE) for c in one[mine].T], 1)
            out[:, kind, :fine] += total.reshape(len(out), fine).astype(np.int64)
        stretch = step[mine] // WIDE
        order = np.argsort(stretch, kind="stable")
        for rows in np.split(mine[order], np.flatnonzero(np.diff(stretch[order])) + 1) if len(mine) else []:
            got = out[int(step[rows[0]]) // WIDE - low, kind, fine:]
            got[: 1 + width] += one[rows].sum(0).astype(np.int64)
            got[1 + width :] += (z[rows].T @ z[rows]).ravel().astype(np.int64)
    some = np.flatnonzero(out.any((1, 2)))
    return some + low, out[some]


def _met(at: np.ndarray, rivals: np.ndarray, count: np.ndarray, kernel) -> np.ndarray:
    """For each place the sum over its rivals' places of count times kernel(rival's place less its own)."""
    return np.concatenate([kernel(rivals[None, :] - at[lo : lo + 256, None]) @ count for lo in range(0, len(at), 256)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _bend(x: np.ndarray) -> np.ndarray:
    p = _sigmoid(x)
    return p * (1 - p)


def _slope(at: np.ndarray, sums: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean logistic loss of all pairs, and its curvature by stretches, from what _by_score gives."""
    cut = WIDE * (1 + width)
    step = (at[:, None] * WIDE + np.arange(WIDE)).ravel() * BIN
    fine = sums[:, :, :cut].reshape(len(at), 2, WIDE, 1 + width).transpose(1, 0, 2, 3).reshape(2, -1, 1 + width) / _UNIT
    some = [np.flatnonzero(f[:, 0]) for f in fine]
    (poor, good), (p, g) = ([fine[k][some[k]] for k in (0, 1)], [step[some[k]] for k in (0, 1)])
    pairs = good[:, 0].sum() * poor[:, 0].sum()
    slope = _met(p, g, good[:, 0], lambda x: _sigmoid(-x)) @ poor[:, 1:] - _met(g, p, poor[:, 0], _sigmoid) @ good[:, 1:]
    whole = sums[:, :, cut : cut + 1 + width].astype(float)
    square = sums[:, :, cut + 1 + width :].reshape(len(at), 2, width, width).astype(float)
    bend = _bend((at[:, None] - at[None, :]) * (WIDE * BIN))
    across = whole[:, 1, 1:].T @ bend @ whole[:, 0, 1:]
    curve = np.tensordot(bend @ whole[:, 0, 0], square[:, 1], 1) + np.tensordot(bend @ whole[:, 1, 0], square[:, 0], 1) - across - across.T
    return slope / (_UNIT * pairs), curve / (float(_UNIT) ** 2 * pairs)


def minimised(look, width: int, decay: float = 1e-3, rounds: int = 100) -> np.ndarray:
    """The weights of least mean loss over all pairs plus 0.5 * decay * |w|^2, by Newton's method; look(w) is _by_score of all rows.

    The stretches' curvature is near the true one, so that a step is halved until the slope, measured by it, falls."""

    def at(w):
        slope, curve = _slope(*look(w), width)
        return slope + decay * w, curve + decay * np.eye(width)

    w = np.zeros(width)
    slope, curve = at(w)
    while rounds > 0 and (left := slope @ np.linalg.solve(curve, slope)) > 1e-9:
        go, t = np.linalg.solve(curve, slope), 1.0
        while rounds > 0:
            rounds -= 1
            new, bent = at(w - t * go)
            if new @ np.linalg.solve(curve, new) < (1 - 0.2 * t) * left:
                break
            t /= 2
        else:
            break
        w, slope, curve = w - t * go, new, bent
    return w


def weights_of(z: np.ndarray, y: np.ndarray, **how) -> np.ndarray:
    """The weights of least loss over all pairs of the scaled features' rows."""
    return minimised(lambda w: _by_score(z, y, w), z.shape[1], **how)


def cut_of(raw: np.ndarray, good: np.ndarray, poor: np.ndarray) -> float:
    """The quantile of all scores under which poor ones are best parted from good ones; good and poor count the rows at each of the ascending scores."""
    both = np.cumsum(good + poor)
    cuts = raw[np.searchsorted(both, np.linspace(0.002, 0.998, 499) * both[-1])]
    below = np.searchsorted(raw, cuts)
    gain = np.concatenate([[0], np.cumsum(poor)])[below] / poor.sum() - np.concatenate([[0], np.cumsum(good)])[below] / good.sum()
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    return float(cuts[best[len(best) // 2]])


def _unfitted(width: int) -> Ranker:
    return Ranker(np.zeros(width), np.ones(width), np.zeros(width), -1.0, 1.0)


def fit(texts, y: np.ndarray, **how) -> Ranker:
    """The ranker of texts in one place."""
    x = _features_of(texts)
    if not (y == 1).any() or not (y == 0).any():
        return _unfitted(x.shape[1])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = standard(x, mean, scale)
    w = weights_of(z, y, **how)
    raw, at = np.unique(z @ w, return_inverse=True)
    return Ranker(mean, scale, w, cut_of(raw, np.bincount(at[y == 1], minlength=len(raw)), np.bincount(at[y == 0], minlength=len(raw))), 1.0)


def _matrix(batch_column) -> np.ndarray:
    n = len(batch_column)
    return np.array([np.frombuffer(p.as_buffer(), np.float64) for p in batch_column]) if n else np.zeros((0, 1))


def _featured(batches):
    for batch in batches:
        x = _features_of(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])


def _moments(batches):
    """One row of a task: (rows, good ones, sums, sums of squares)."""
    n, good, total = 0, 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(2))
            n, good, both = n + len(x), good + int(np.asarray(batch.column(1)).sum()), np.stack([x.sum(0), (x * x).sum(0)])
            total = both if total is None else total + both
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([good], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "good", "sums"])


#: rows that a task sums up at once
_AT_ONCE = 1 << 14


def _sums(scales, weights):
    """(stretch, slot, n): a task's rows as _by_score sums them up, numbers other than 0."""

    def run(batches):
        (mean, scale), w = scales.value, weights.value
        total, held = {}, []

        def add():
            x, y = (np.concatenate(c) for c in zip(*held))
            for at, sums in zip(*_by_score(standard(x, mean, scale), y, w)):
                total[int(at)] = total.get(int(at), 0) + sums.ravel()
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append((_matrix(batch.column(2)), np.asarray(batch.column(1))))
                if sum(len(y) for _, y in held) >= _AT_ONCE:
                    add()
        if held:
            add()
        for at, sums in total.items():
            slot = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), at)), pa.array(slot), pa.array(sums[slot])], names=["stretch", "slot", "n"])

    return run


#: steps of a score that the counts for the cut tell apart
STEP = 1e-3


def _counted(model):
    """(score in steps, good, poor) of a task's rows."""

    def run(batches):
        m = model.value
        for batch in batches:
            if batch.num_rows:
                y = np.asarray(batch.column(1))
                at, place = np.unique(np.round(m.raw(_matrix(batch.column(2))) / STEP).astype(np.int64), return_inverse=True)
                count = [pa.array(np.bincount(place[y == k], minlength=len(at)), pa.int64()) for k in (1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(at), *count], names=["at", "good", "poor"])

    return run


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            buf, offsets = tv.text_buffer(batch.column(1))
            ids, held = batch.column(0), batch.column(2)
            for a, b in tv.groups(offsets, TEXT_BYTES):
                part = offsets[a : b + 1]
                s = m.score(features(buf[part[0] : part[-1]], part - part[0]))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), held.slice(a, b - a), pa.array(s)], names=["id", "held_out", "score"])

    return run


def _keep(model, column: int):
    def run(batches):
        m = model.value
        for batch in batches:
            buf, offsets = tv.text_buffer(batch.column(column))
            score = [m.score(features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in tv.groups(offsets, TEXT_BYTES)]
            if score:
                yield batch.filter(pa.array(np.concatenate(score) >= CUT))

    return run


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Ranker:
    """The ranker of all labelled rows whose crc32(id as text) mod 5 is not 0.

    Their features are written once and read in each round; sums and counts by steps of scores reach the driver."""
    sc = docs.sparkSession.sparkContext
    train = training_rows(docs, labels, label, id_col, text_col)
    kind = train.schema["id"].dataType.simpleString()
    rows = written(train.select("id", "text", "y").mapInArrow(_featured, f"id {kind}, y int, x binary"), "features")
    sums = rows.mapInArrow(_moments, "n long, good long, sums binary").collect()
    n, good = sum(r["n"] for r in sums), sum(r["good"] for r in sums)
    if not 0 < good < n:
        return _unfitted(features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1])
    first, second = sum(np.frombuffer(r["sums"], np.float64).reshape(2, -1) for r in sums) / n
    scale = np.maximum(np.sqrt(np.maximum(second - first**2, 0)), 1e-3)
    scales, slots = sc.broadcast((first, scale)), 2 * _slot(len(first))

    def look(w):
        got = rows.mapInArrow(_sums(scales, sc.broadcast(w)), "stretch long, slot long, n long").groupBy("stretch", "slot").agg(F.sum("n").alias("n")).toArrow()
        at, place = np.unique(got["stretch"].to_numpy(), return_inverse=True)
        out = np.zeros((len(at), slots), np.int64)
        out[place, got["slot"].to_numpy()] = got["n"].to_numpy()
        return at, out.reshape(len(at), 2, -1)

    w = minimised(look, len(first))
    counts = rows.mapInArrow(_counted(sc.broadcast(Ranker(first, scale, w, 0.0, 1.0))), "at long, good long, poor long").groupBy("at").agg(F.sum("good").alias("good"), F.sum("poor").alias("poor")).toArrow().sort_by("at")
    return Ranker(first, scale, w, cut_of(counts["at"].to_numpy() * STEP, counts["good"].to_numpy(), counts["poor"].to_numpy()), 1.0)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) of each row of docs; predicted is 1 if score >= 0.3.

    Fits on all labelled rows whose crc32(id as text) mod 5 is not 0.  Null and empty
    texts are scored as texts without words.  With labels of one kind only, or none, all texts
    score alike, above the cut.  Repeated rows are scored each; a null id is scored and is not
    held out; other columns are not read.
    """
    model = fitted(docs, labels, id_col, text_col, label)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out(id_col, 0).alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, whose text scores CUT or more; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, text_col=text_col, **how))
    return docs.mapInArrow(_keep(model, docs.columns.index(text_col)), docs.schema)
