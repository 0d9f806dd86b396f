"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of `BLOCK` words; two blocks in a row are a passage.  A passage's
vector holds TF-IDF weights of the words that the benchmark has at all (idf counted over all blocks
of all documents; words in a hundredth of the blocks weigh nothing), projected onto the leading
right singular vectors of a randomised SVD; its length is that of all its words, so words that the
benchmark lacks make it less like any item.  The SVD is fitted on the blocks of the benchmark and on
those of all documents, either as heavy as the other: the blocks are written once as numbers of features, each task
adds up its share of A'(A*Omega), the shares meet by rows of features, and only matrices of the
benchmark's words by `RANK` numbers reach the driver.

Every passage of every document is then compared by cosine with every benchmark passage (the
benchmark is the stated query set, sent to all machines); passages whose projection is too short
to reach the least cosine need no comparison.  Candidates are checked on the words themselves: an
answer check, that most of the item's most telling words occur, and the longest common subsequence
with the whole item.

Words without weight and the rank limit the cosine search alone: beside it every
place that holds enough of an item's most telling words for the answer check, and as large a part of
all its words by idf, is a candidate (looked up by word, exactly).  This idf leaves out no word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import written

BLOCK, RANK, EXTRA = 16, 256, 16
COMMON_SHARE = 0.01
LEAST_COSINE, LEAST_SHARE, LEAST_ANSWER = 0.35, 0.6, 0.5
_CHUNK = 1024  # features summed as one row
#: bytes of text whose passages are held at once; their vectors take some 60 times its size
TEXT_BYTES = 1 << 18
#: characters of benchmark text that machines hold at once; a larger benchmark is looked for part by part
BENCHMARK_CHARS = 1 << 25


def blocks_of(words: np.ndarray, woffs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins of the blocks among the words, and the texts' offsets in the blocks; the last block of a text may be short."""
    n = -(-np.diff(woffs) // BLOCK)
    boffs = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    return woffs[text] + (np.arange(boffs[-1]) - boffs[text]) * BLOCK, boffs


def _texts(batch, column: int):
    buf, offsets = tv.text_buffer(batch.column(column))
    for lo, hi in tv.groups(offsets, TEXT_BYTES):
        part = offsets[lo : hi + 1]
        words, _, _, woffs = tv.hash_words(buf[part[0] : part[-1]], part - part[0], tv.ALNUM)
        yield lo, hi, words, woffs


class Words:
    """The benchmark's words, sorted, with their weights; `other` is the weight of any other word."""

    def __init__(self, known: np.ndarray, weight: np.ndarray | None = None, other: float = 0.0):
        self.known, self.weight, self.other = known, weight, other
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[known >> np.uint64(44)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are known, and their places."""
        likely = np.flatnonzero(self.maybe[words >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.known, words[likely]), len(self.known) - 1)
        hit = self.known[at] == words[likely]
        return likely[hit], at[hit]


def _document_counts(words_held):
    """(feature, n): in how many blocks each known word occurs; feature -1: blocks in all."""

    def run(batches):
        held = words_held.value
        n, seen = np.zeros(len(held.known), np.int64), 0
        for batch in batches:
            for _, _, words, woffs in _texts(batch, 0):
                begin, _ = blocks_of(words, woffs)
                which, feature = held.find(words)
                block = np.searchsorted(begin, which, side="right") - 1
                n += np.bincount(np.unique(block * len(n) + feature) % len(n), minlength=len(n))
                seen += len(begin)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], seen))], names=["feature", "n"])

    return run


def _block_rows(words: np.ndarray, begin: np.ndarray, held: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each block's sum of its words' rows and of their squared weights; also the words that weigh, and their blocks."""
    which, feature = held.find(words)
    heavy = held.weight[feature] > 0
    block = np.searchsorted(begin, which, side="right") - 1
    mass = np.diff(np.append(begin, len(words))) * held.other**2
    mass += np.bincount(block, weights=held.weight[feature] ** 2 - held.other**2, minlength=len(begin))
    block, feature = block[heavy], feature[heavy]
    out = np.zeros((len(begin), rows.shape[1]), np.float32)
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    for at in range(0, len(first), 512):  # a few thousand rows at a time stay in cache
        lo, hi = first[at], first[at + 512] if at + 512 < len(first) else len(block)
        out[block[first[at : at + 512]]] = np.add.reduceat(rows[feature[lo:hi]], first[at : at + 512] - lo, axis=0)
    return out, mass, feature, block


def passage_vectors(words: np.ndarray, woffs: np.ndarray, held: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the passages, their blocks' begins, and the texts' offsets: a passage for each block, with the block after it."""
    begin, boffs = blocks_of(words, woffs)
    if not len(begin):
        return np.zeros((0, rows.shape[1]), np.float32), begin, boffs
    block, mass, _, _ = _block_rows(words, begin, held, rows)
    both, size = block.copy(), mass.copy()
    both[:-1] += block[1:]
    size[:-1] += mass[1:]
    last = boffs[1:][np.diff(boffs) > 0] - 1
    both[last], size[last] = block[last], mass[last]
    both *= (1 / np.sqrt(np.maximum(size, 1e-9))).astype(np.float32)[:, None]
    return both, begin, boffs


def _encoded(words_held):
    """(features, sizes, scales): the weighing words of the blocks of some texts, how many each block has, and what each block's row is multiplied by; texts are (text, weight)."""

    def run(batches):
        held = words_held.value
        for batch in batches:
            weight = np.asarray(batch.column(1))
            for lo, hi, words, woffs in _texts(batch, 0):
                begin, boffs = blocks_of(words, woffs)
                _, mass, feature, block = _block_rows(words, begin, held, np.zeros((len(held.known), 0), np.float32))
                if not len(feature):
                    continue
                sizes = np.bincount(block, minlength=len(begin))
                scale = np.sqrt(np.repeat(weight[lo:hi], np.diff(boffs)) / np.maximum(mass, 1e-9))
                some = np.flatnonzero(sizes)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (feature.astype(np.int32), sizes[some].astype(np.uint8), scale[some].astype(np.float32))], names=["features", "sizes", "scales"])

    return run


def _project(words_held, step):
    """Each task's share of A'(A X) for X = step (features x columns) over the rows of encoded blocks, by chunks of features; with chunk -1: (A X)'(A X)."""

    def run(batches):
        held, x = words_held.value, step.value
        weight = held.weight.astype(np.float32)
        rows = x * weight[:, None]
        got, inner = np.zeros(x.shape, np.float32), np.zeros((x.shape[1], x.shape[1]))
        for batch in batches:
            for f, n, scale in zip(*(batch.column(i) for i in range(3))):
                f, n, scale = np.frombuffer(f.as_buffer(), np.int32), np.frombuffer(n.as_buffer(), np.uint8).astype(np.int64), np.frombuffer(scale.as_buffer(), np.float32)
                ends = np.concatenate([[0], np.cumsum(n)])
                for lo in range(0, len(n), 512):  # a few thousand rows at a time stay in cache
                    hi = min(lo + 512, len(n))
                    g = f[ends[lo] : ends[hi]]
                    y = np.add.reduceat(rows[g], ends[lo:hi] - ends[lo], axis=0) * scale[lo:hi, None]
                    inner += y.T @ y
                    b = np.repeat(np.arange(hi - lo), n[lo:hi])
                    order = np.argsort(g, kind="stable")
                    g, b = g[order], b[order]
                    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                    y *= scale[lo:hi, None]
                    got[g[first]] += np.add.reduceat(y[b], first, axis=0) * weight[g[first], None]
        parts = [(c // _CHUNK, got[c : c + _CHUNK].tobytes()) for c in range(0, len(got), _CHUNK) if got[c : c + _CHUNK].any()]
        parts.append((-1, inner.astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in parts], pa.int32()), pa.array([r[1] for r in parts], pa.binary())], names=["chunk", "part"])

    return run


#: words of a benchmark up to which A'A is summed once; it has so many numbers squared
GRAM = 6000
_ROWS = 256  # of A'A as one row


def _gram(words_held):
    """Each task's share of A'A over the rows of encoded blocks, as places and numbers other than 0 of `_ROWS` of its rows at a time."""

    def run(batches):
        held = words_held.value
        weight, size = held.weight.astype(np.float32), len(held.known)
        got = np.zeros(size * size, np.float32)
        for batch in batches:
            for f, n, scale in zip(*(batch.column(i) for i in range(3))):
                f, n, scale = np.frombuffer(f.as_buffer(), np.int32).astype(np.int64), np.frombuffer(n.as_buffer(), np.uint8).astype(np.int64), np.frombuffer(scale.as_buffer(), np.float32)
                x, left = weight[f] * np.repeat(scale, n), np.repeat(np.cumsum(n), n) - np.arange(len(f))
                np.add.at(got, f * (size + 1), x * x)
                at = np.flatnonzero(left > 1)
                for far in range(1, int(n.max(initial=0))):  # words so far apart in one block
                    a, b = f[at], f[at + far]
                    np.add.at(got, np.minimum(a, b) * size + np.maximum(a, b), x[at] * x[at + far] * (1 + (a == b)))
                    at = at[left[at] > far + 1]
        got = got.reshape(size, size)
        ends = got.diagonal().copy()
        got += got.T
        np.fill_diagonal(got, ends)
        for c in range(0, size, _ROWS):
            flat = got[c : c + _ROWS].reshape(-1)
            some = np.flatnonzero(flat)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([c // _ROWS], pa.int32()), pa.array([some.astype(np.int32).tobytes() + flat[some].tobytes()], pa.binary())], names=["chunk", "part"])

    return run


def _gram_total(size: int):
    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(_ROWS * size, np.float32)
        for p in table["part"]:
            b = p.as_buffer()
            total[np.frombuffer(b, np.int32, len(b) // 8)] += np.frombuffer(b, np.float32, len(b) // 8, len(b) // 2)
        some = np.flatnonzero(total)
        return pa.table({"chunk": table["chunk"].slice(0, 1), "part": pa.array([some.astype(np.int32).tobytes() + total[some].tobytes()], pa.binary())})

    return run


def _times_gram(step):
    """The rows of A'A X of each chunk."""

    def run(batches):
        x = step.value
        for batch in batches:
            for c, p in zip(batch.column(0).to_pylist(), batch.column(1)):
                b, m = p.as_buffer(), np.zeros(_ROWS * len(x), np.float32)
                m[np.frombuffer(b, np.int32, len(b) // 8)] = np.frombuffer(b, np.float32, len(b) // 8, len(b) // 2)
                rows = min(_ROWS, len(x) - c * _ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([(m.reshape(_ROWS, -1)[:rows] @ x).tobytes()], pa.binary())], names=["chunk", "part"])

    return run


#: tasks' matrices of one chunk that are summed as one group
_FAN = 32


def _total(table: pa.Table) -> pa.Table:
    total = None
    for p in table["part"]:
        x = np.frombuffer(p.as_buffer(), np.float32)
        total = x.copy() if total is None else np.add(total, x, out=total)
    return pa.table({"chunk": table["chunk"].slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})


def _summed(parts: DataFrame, tasks: int, total=_total) -> DataFrame:
    """(chunk, part) with the sum of each chunk's matrices, `_FAN` of them in a group at a time, so that no task holds those of all tasks."""
    while tasks > _FAN:
        tasks = -(-tasks // _FAN)
        parts = written(parts.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(tasks))).groupBy("chunk", "group").applyInArrow(total, "chunk int, part binary"), "sums")
    return parts.groupBy("chunk").applyInArrow(total, "chunk int, part binary")


def randomised_svd(passages: DataFrame, held: Words, rank: int = RANK, extra: int = EXTRA, rounds: int = 2, seed: int = 1) -> np.ndarray:
    """The leading right singular vectors (features x rank, or as many as there are features) of the TF-IDF rows of the blocks of passages(text, weight); a weight counts a text's rows so many times.

    Subspace iteration from a random start; the texts are read once and their blocks written as
    numbers of features.  With up to `GRAM` features A'A is summed once and each round multiplies
    it; else the rows stay where they are, and each round moves one matrix of features x (rank +
    extra) for each task."""
    sc, features = passages.sparkSession.sparkContext, len(held.known)
    columns = min(rank + extra, features)
    weights = sc.broadcast(held)
    passages = written(passages.select("text", F.col("weight").cast("double")).mapInArrow(_encoded(weights), "features binary, sizes binary, scales binary"), "blocks")

    gram = None
    if features <= GRAM:
        gram = written(_summed(passages.mapInArrow(_gram(weights), "chunk int, part binary"), passages.rdd.getNumPartitions(), _gram_total(features)), "gram")

    def multiply(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if gram is not None:
            out = np.zeros((features, columns), np.float32)
            for r in gram.mapInArrow(_times_gram(sc.broadcast(x)), "chunk int, part binary").collect():
                out[r[0] * _ROWS : (r[0] + 1) * _ROWS] = np.frombuffer(r[1], np.float32).reshape(-1, columns)
            return out, x.T.astype(float) @ out
        parts = _summed(passages.mapInArrow(_project(weights, sc.broadcast(x)), "chunk int, part binary"), passages.rdd.getNumPartitions()).toArrow()
        out, inner = np.zeros((features, columns), np.float32), np.zeros((columns, columns))
        for c, p in zip(parts["chunk"].to_pylist(), parts["part"].to_pylist()):
            m = np.frombuffer(p, np.float32).reshape(-1, columns)
            if c < 0:
                inner = m.astype(float)
            else:
                out[c * _CHUNK : c * _CHUNK + len(m)] = m
        return out, inner

    draw = np.random.default_rng(seed)
    q = draw.standard_normal((features, columns)).astype(np.float32)
    for _ in range(rounds):
        z, _ = multiply(q)
        q = np.linalg.qr(z + 1e-6 * draw.standard_normal(z.shape))[0].astype(np.float32)
    _, inner = multiply(q)  # (A Q)'(A Q): its eigenvectors turn Q into the singular vectors
    values, turn = np.linalg.eigh(inner)
    return np.ascontiguousarray((q @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32))


class Item:
    """One benchmark item: its words' places as bit masks, and its most telling words."""

    def __init__(self, words: np.ndarray, held: Words):
        self.n, self.masks = len(words), {}
        for i, w in enumerate(words.tolist()):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        kinds = np.unique(words)
        weight = dict(zip(kinds.tolist(), held.weight[np.searchsorted(held.known, kinds)].tolist()))
        ranked = sorted(weight, key=lambda w: (-weight[w], w))
        self.answer = frozenset(ranked[: max(1, len(ranked) // 3)])
        self.weight, self.total = weight, sum(weight.values())

    def weighed(self, words: list[int]) -> float:
        """The words' part of the item's weight."""
        return sum(self.weight[w] for w in self.weight.keys() & words) / self.total if self.total > 0 else 1.0

    def share(self, words: list[int], least_answer: float = 0.0) -> tuple[float, float]:
        """Longest common subsequence with the words, as a share of the item (bit-parallel), and the share of telling words that occur; (0, .) if that is too small."""
        answer = len(self.answer.intersection(words)) / len(self.answer)
        if answer < least_answer:
            return 0.0, answer
        full, row, masks = (1 << self.n) - 1, (1 << self.n) - 1, self.masks
        for w in words:
            m = masks.get(w, 0)
            if m:
                u = row & m
                row = (row + u | row - u) & full
        return (self.n - row.bit_count()) / self.n, answer


class Lookup:
    """The items by their telling words: finds each block around which enough of them occur for the answer check."""

    def __init__(self, items: list[Item], least_answer: float):
        # without an answer check any word of an item will do
        look = [sorted(item.answer if least_answer > 0 else item.masks) for item in items]
        size = np.array([len(x) for x in look], np.int64)
        flat = np.array([w for x in look for w in x], np.uint64)
        known, feature = np.unique(flat, return_inverse=True)
        order = np.argsort(feature, kind="stable")
        self.items, self.words, self.owner = items, Words(known), np.repeat(np.arange(len(items)), size)[order]
        self.offs = np.searchsorted(feature[order], np.arange(len(known) + 1))
        self.need = np.maximum(np.ceil(least_answer * size - 1e-9), 1)
        self.reach = np.array([item.n for item in items], np.int64)

    def places(self, words: np.ndarray, woffs: np.ndarray, boffs: np.ndarray):
        """(text, item, first block, last block) of the blocks that may pass.

        A window starts `reach` before its block and is `span` long, so it lies in the two
        stretches of `span` words from the one that it starts in."""
        which, feature = self.words.find(words)
        times = self.offs[feature + 1] - self.offs[feature]
        at, word = np.repeat(which, times), np.repeat(feature, times)
        item = self.owner[np.arange(len(at)) + np.repeat(self.offs[feature] - (np.cumsum(times) - times), times)]
        if not len(at):
            return
        text, span = np.searchsorted(woffs, at, side="right") - 1, 2 * (self.reach + BLOCK)
        stretch = (at - woffs[text]) // span[item]
        wide = int(stretch.max()) + 1
        key = (text * len(self.items) + item) * wide + stretch
        before = stretch > 0
        key, word = np.concatenate([key, key[before] - 1]), np.concatenate([word, word[before]])
        pairs, pair, times = np.unique(key, return_inverse=True, return_counts=True)
        some = (times >= self.need[pairs // wide % len(self.items)])[pair]  # repeats count here, not below
        kinds = np.bincount(np.unique(pair[some] * len(self.words.known) + word[some]) // len(self.words.known), minlength=len(pairs))
        for p in pairs[kinds >= self.need[pairs // wide % len(self.items)]].tolist():
            (t, i), s = divmod(p // wide, len(self.items)), p % wide
            n, size = int(self.reach[i]), int(span[i])
            first = -(-(s * size + n) // BLOCK) if s else 0
            last = min(-(-((s + 1) * size + n) // BLOCK), int(boffs[t + 1] - boffs[t])) - 1
            yield t, i, int(boffs[t]) + first, int(boffs[t]) + last


class Search:
    """What every machine holds to look for benchmark items: weights, basis, passage vectors and items."""

    def __init__(self, held: Words, tell: Words, rows, vectors, owner, ids, texts, least: tuple[float, float, float]):
        self.held, self.tell, self.rows, self.vectors, self.owner, self.ids, self.texts, self.least = held, tell, rows, vectors, owner, ids, texts, least
        self.longest = float(np.sqrt((vectors * vectors).sum(1).max(initial=0.0)))

    def lookup(self) -> Lookup:
        return Lookup([Item(t, self.tell) for t in self.texts], self.least[2])

    def hits(self, batch, column: int, look: Lookup):
        """(row, item, share, answer) of each text of the batch that holds an item."""
        cosine, least_share, least_answer = self.least
        for lo, _, words, woffs in _texts(batch, column):
            mine, begin, boffs = passage_vectors(words, woffs, self.held, self.rows)
            # a product is at most the lengths' product
            far = np.flatnonzero((mine * mine).sum(1) >= (cosine / self.longest) ** 2) if self.longest > 0 else np.zeros(0, np.int64)
            found: dict[tuple[int, int], list[int]] = {}
            for at in range(0, len(far), 4096):
                some = far[at : at + 4096]
                p, q = np.nonzero(mine[some] @ self.vectors.T >= cosine)
                text = np.searchsorted(boffs, some[p], side="right") - 1
                for t, i, b in zip(text.tolist(), self.owner[q].tolist(), some[p].tolist()):
                    found.setdefault((t, i), []).append(b)
            near = {k: set(blocks) for k, blocks in found.items()}
            for t, i, first, last in look.places(words, woffs, boffs):
                found.setdefault((t, i), []).extend(range(first, last + 1))
            for (t, i), blocks in found.items():
                item, best, alike = look.items[i], (0.0, 0.0), near.get((t, i), ())
                for b in sorted(set(blocks)):
                    a = max(int(begin[b]) - item.n, int(woffs[t]))
                    z = min(int(begin[b]) + 2 * BLOCK + item.n, int(woffs[t + 1]))
                    window = words[a:z].tolist()
                    if b in alike or item.weighed(window) >= least_answer:
                        best = max(best, item.share(window, least_answer))
                    if best[0] == 1.0:
                        break
                if best[0] >= least_share and best[1] >= least_answer:
                    yield lo + t, self.ids[i], *best


def _search(search):
    def run(batches):
        s = search.value
        look = s.lookup()
        for batch in batches:
            if rows := list(s.hits(batch, 1, look)):
                at, item, share, answer = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(item, pa.int64()), pa.array(share, pa.float64()), pa.array(answer, pa.float64())], names=["id", "item_id", "share", "answer"])

    return run


def _keep(search, column: int):
    def run(batches):
        s = search.value
        look = s.lookup()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r[0] for r in s.hits(batch, column, look)]] = False
            yield batch.filter(pa.array(keep))

    return run


def fitted(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: tuple[float, float, float] = (LEAST_COSINE, LEAST_SHARE, LEAST_ANSWER)) -> Search | None:
    """The search for the benchmark's items among docs; None if there is nothing to find or to look through."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    queries = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toArrow()
    buf, offsets = tv.text_buffer(queries["text"])
    qwords, _, _, qoffs = tv.hash_words(buf, offsets, tv.ALNUM)
    some = np.flatnonzero(np.diff(qoffs))
    known = np.unique(qwords)
    if not len(some):
        return None
    counts = rows.mapInArrow(_document_counts(sc.broadcast(Words(known))), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = counts["feature"].to_numpy(), counts["n"].to_numpy()
    total = int(n[feature == -1].sum())
    if not total:
        return None
    df = np.zeros(len(known))
    df[feature[feature >= 0]] = n[feature >= 0]
    idf = np.log((total + 1) / (df + 1))
    tell = Words(known, idf.copy())
    idf[df > max(COMMON_SHARE * total, 3 * len(queries))] = 0.0
    held = Words(known, idf, float(idf[idf > 0].mean()) if (idf > 0).any() else 0.0)
    # the basis has to tell the benchmark's own passages apart: they count as much as the documents'
    heavy = max(1.0, total / len(blocks_of(qwords, qoffs)[0]))
    passages = rows.withColumn("weight", F.lit(1.0)).unionByName(benchmark.select(F.col("text").cast("string"), F.lit(heavy).alias("weight")))
    basis = (randomised_svd(passages, held) * idf[:, None]).astype(np.float32)
    vectors, _, boffs = passage_vectors(qwords, qoffs, held, basis)
    vectors = vectors / np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-6)
    owner = np.repeat(np.arange(len(queries)), np.diff(boffs))
    return Search(held, tell, basis, vectors, np.searchsorted(some, owner), queries["item_id"].to_numpy()[some].tolist(), [qwords[qoffs[i] : qoffs[i + 1]] for i in some], least)


def _parts(benchmark: DataFrame, most: int = BENCHMARK_CHARS) -> list[DataFrame]:
    """The benchmark in parts of about `most` characters each, dealt by a hash of the items."""
    chars = benchmark.agg(F.coalesce(F.sum(F.char_length(F.col("text").cast("string"))), F.lit(0))).head()[0]
    n = max(1, -(-chars // most))
    return [benchmark] if n == 1 else [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cosine: float = LEAST_COSINE, least_share: float = LEAST_SHARE, least_answer: float = LEAST_ANSWER) -> DataFrame:
    """(id, item_id, share, answer): each document and benchmark item that it holds, with how much of it.

    share is the longest common subsequence's part of the item's words, answer the part of its most
    telling third of words that occur; both must reach their least values.  benchmark(item_id,
    text) is a query set that every machine holds, part by part if it is large.  Null and blank texts, and items without words,
    match nothing; of repeated rows and null ids each gives its rows; an empty table on either
    side gives an empty result.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, item_id long, share double, answer double"
    out = None
    for part in _parts(benchmark):
        search = fitted(rows, part, "text", (least_cosine, least_share, least_answer))
        if search is not None:
            found = rows.mapInArrow(_search(spark.sparkContext.broadcast(search)), kind)
            out = found if out is None else out.union(found)
    return (spark.createDataFrame([], kind) if out is None else out).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item; nothing is shuffled.

    Null and blank texts hold none and stay, as do repeated rows; an empty benchmark keeps all."""
    out = docs
    for part in _parts(benchmark):
        search = fitted(docs, part, text_col, **how)
        if search is not None:
            out = out.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(search), docs.columns.index(text_col)), docs.schema)
    return out
