"""Language-model scores: a probabilistic suffix tree over words.

The tree's symbols are a text's words and its end, and one symbol for every word that the training
texts lack; a context is a run of up to `DEPTH` symbols before the next one, and may begin with the
end of the text before.  The root's next-symbol distribution is that of the word counts, 0.5 added
to each.  A run of symbols is looked at if it occurs `SHARE` * N ** (2/3) times or more among the N
training symbols (twice at least), so more and longer contexts come in as the input grows, but no
more than N ** (1/3) / SHARE of each length, which is what every machine holds.  Counts of
length k + 1 are taken only for runs whose two parts of length k are that frequent, one exact pass
over the texts for each length.

A context is retained if its own distribution of next symbols lies `GAIN` times the least count or
more nats, summed over its occurrences, from what its suffix says (Kullback-Leibler divergence; next
symbols that are rare there count as one).  Its distribution is smoothed towards its suffix's
(Witten-Bell).  A text is scored by the longest retained suffix of what stands before each symbol.

Word counts are exact: the commonest words' counts, a bounded number, are sent to all machines,
and the other words of each text meet their counts in a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import commonest, held_out, written

DEPTH, SHARE, GAIN = 3, 4e-4, 0.5
#: words whose counts every machine holds beside the frequent ones (16 bytes each)
SENT_WORDS = 1 << 18
_END_WORD = int(tv.seeds(1, 4242).view(np.int64)[0])
_END = np.uint64(_END_WORD & (1 << 64) - 1)


def symbols(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, each text closed by its end, and the texts' offsets in them."""
    words, _, _, woffs = tv.hash_words(buf, offsets)
    return np.insert(words, woffs[1:], _END), woffs + np.arange(len(woffs))


def _longer(run: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, key) of the runs of k symbols and a next one, from the keys of the runs one shorter; 0 where the text has too few before."""
    context = np.zeros_like(run)
    context[1:] = run[:-1]
    context[place == 0] = _END
    key = tv.mix(context * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + tv.mix(run + np.uint64(k)))
    few = place < k - 1
    context[few] = key[few] = 0
    return context, key


def _place(offs: np.ndarray) -> np.ndarray:
    return np.arange(offs[-1]) - np.repeat(offs[:-1], np.diff(offs))


class Table:
    """Values by sorted keys."""

    def __init__(self, keys: np.ndarray, **values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], {c: v[order] for c, v in values.items()}
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The places of the asked keys, -1 for those that are not there."""
        out = np.full(len(asked), -1, np.int64)
        likely = np.flatnonzero(self.maybe[asked >> np.uint64(44)])
        if len(self.keys) and len(likely):
            at = np.minimum(np.searchsorted(self.keys, asked[likely]), len(self.keys) - 1)
            hit = self.keys[at] == asked[likely]
            out[likely[hit]] = at[hit]
        return out


def _counted(found, most: int = 1 << 19):
    """(key, n) of what found(stream, offs) gives for each stretch of texts; what a task has counted goes out before it grows beyond `most` keys."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, n = (np.concatenate(x) for x in zip(*held))
            got, where = np.unique(keys, return_inverse=True)
            return got, np.bincount(where, weights=n, minlength=len(got)).astype(np.int64)

        for batch in batches:
            buf, offsets = tv.text_buffer(batch.column(0))
            for lo, hi in tv.groups(offsets):
                part = offsets[lo : hi + 1]
                held.append(np.unique(found(*symbols(buf[part[0] : part[-1]], part - part[0])), return_counts=True))
                if sum(len(k) for k, _ in held) > 2 * most:
                    held = [merged()]
                    if len(held[0][0]) > most:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["key", "n"])
                        held = []
        if held:
            keys, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return run


def _words(stream: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return stream


def _pairs(frequent, k: int):
    """The runs of k symbols and a next one whose two parts of k symbols are frequent, as the parts' places in one number."""

    def found(stream: np.ndarray, offs: np.ndarray) -> np.ndarray:
        table, run, place = frequent.value, stream, _place(offs)
        for j in range(1, k):
            run = _longer(run, place, j)[1]
        part = table.find(run)
        before = np.full(len(part), -1, np.int64)
        before[1:] = part[:-1]
        before[place == 0] = table.find(np.array([_END]))[0] if k == 1 else -1
        both = np.flatnonzero((part >= 0) & (before >= 0) & (place >= k - 1))
        return (before[both] << 32 | part[both]).view(np.uint64)

    return found


def grown(frequent: Table, packed: np.ndarray, n: np.ndarray, k: int, gain: float) -> tuple[Table, Table, Table]:
    """(runs, entries, contexts) of length k: all frequent runs with count and probability, those of retained contexts, and what these leave to their suffixes.

    frequent has the counts and probabilities of the runs one shorter."""
    context, part = packed >> 32, packed & 0xFFFFFFFF
    key = tv.mix(frequent.keys[context] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + tv.mix(frequent.keys[part] + np.uint64(k)))
    q = frequent.values["p"][part]
    which, at = np.unique(context, return_inverse=True)
    seen = frequent.values["n"][which].astype(float)
    add = lambda x: np.bincount(at, weights=x, minlength=len(which))
    kinds, lower = add(np.ones(len(at))) + 1, np.maximum(1 - add(q), 1e-12)
    rest = np.maximum(seen - add(n), 0.0)
    far = add(n * np.log(n / seen[at] / q)) + rest * np.log(np.maximum(rest, 1e-12) / seen / lower)
    kept = far >= gain
    p = np.where(kept[at], (n + kinds[at] * q) / (seen + kinds)[at], q)
    inside = kept[at]
    left = np.log10((rest + kinds * lower) / (seen + kinds) / lower)
    return Table(key, n=n, p=p), Table(key[inside], log=np.log10(p[inside])), Table(frequent.keys[which[kept]], log=left[kept])


class Tree:
    """Known words' counts, and for each length the entries and contexts that scoring looks up."""

    def __init__(self, words: Table, total: int, kinds: int, levels: list[tuple[Table, Table]]):
        self.words, self.levels, self.floor = words, levels, float(np.log10(total + 0.5 * (kinds + 1)))

    def score(self, stream: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of each symbol's root probability and of its probability in its place, and which symbols are unknown here; their root probability is left out of both."""
        at = self.words.find(stream)
        if len(self.words):
            root = np.where(at >= 0, np.log10(self.words.values["n"][at] + 0.5) - self.floor, 0.0)
        else:
            root = np.zeros(len(stream))
        now, run, place = root.copy(), stream, _place(offs)
        for k, (entries, contexts) in enumerate(self.levels, 1):
            context, run = _longer(run, place, k)
            held = contexts.find(context)
            there = np.flatnonzero(held >= 0)
            if len(there):
                entry = entries.find(run[there])
                now[there] += contexts.values["log"][held[there]]
                hit = entry >= 0
                now[there[hit]] = entries.values["log"][entry[hit]]
        return root, now, at < 0


def grow_tree(train: DataFrame, words: DataFrame, total: int, kinds: int, depth: int, share: float, gain: float, sent_words: int) -> Tree:
    """The tree of train(text), whose words(key, n) are counted already; each length is one more pass."""
    sc, least = train.sparkSession.sparkContext, max(2.0, share * total ** (2 / 3))
    got = words.where(F.col("n") >= least).union(commonest(words, sent_words)).distinct().toArrow()
    keys, n = got["key"].to_numpy().view(np.uint64), got["n"].to_numpy()
    often = n >= least
    frequent = Table(keys[often], n=n[often], p=(n[often] + 0.5) / (total + 0.5 * (kinds + 1)))
    levels = []
    for k in range(1, depth + 1):
        if not len(frequent):
            break
        pairs = train.mapInArrow(_counted(_pairs(sc.broadcast(frequent), k)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        pairs = pairs.where(F.col("n") >= least).toArrow().sort_by("key")
        frequent, *level = grown(frequent, pairs["key"].to_numpy(), pairs["n"].to_numpy(), k, gain * least)
        levels.append(tuple(level))
    return Tree(Table(keys, n=n), total, kinds, levels)


def _score(tree):
    def run(batches):
        model = tree.value
        for batch in batches:
            buf, offsets = tv.text_buffer(batch.column(1))
            ids, held = batch.column(0), batch.column(2)
            for lo, hi in tv.groups(offsets):
                part = offsets[lo : hi + 1]
                # each text's end closes it, so no text is without symbols
                stream, offs = symbols(buf[part[0] : part[-1]], part - part[0])
                root, now, other = model.score(stream, offs)
                rest = np.concatenate([[0], np.cumsum(other)])[offs]
                lists = pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.array(stream[other].view(np.int64)))
                sums = [np.add.reduceat(x, offs[:-1], dtype=t) for x, t in ((~other, np.int64), (root, np.float64), (now, np.float64))]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), held.slice(lo, hi - lo), pa.array(np.diff(offs)), *map(pa.array, sums), lists],
                    names=["id", "held_out", "n_tokens", "known", "worth", "tree", "rest"],
                )

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, share: float = SHARE, gain: float = GAIN, sent_words: int = SENT_WORDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    Learns from the rows whose crc32(id as text) mod 5 is not 1; a null id is learnt from.
    base_score sums log10((c + 0.5) / (N + 0.5 * (V + 1))) over words and end; score is log10 of
    the tree's probability of the words and the end, each after those before it, a word that training
    lacks standing for all such words.  A null or blank text has its end alone.  Equal texts score
    alike.  With no training row every symbol is that one word, of probability 1.
    Repeated rows are scored each; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out(id_col, 1).alias("held_out"))
    train = rows.where("not held_out").select("text")
    words = written(train.mapInArrow(_counted(_words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    tree = grow_tree(train, words, total, kinds, depth, share, gain, sent_words)
    kind = rows.select("id", "held_out").schema.add("n_tokens", "long").add("known", "long").add("worth", "double").add("tree", "double").add("rest", T.ArrayType(T.LongType()))
    scored = rows.select("id", "text", "held_out").mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(tree)), kind)
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    c = F.coalesce("n", F.lit(0))
    rest = rest.join(words, "key", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10((c + 0.5) / (F.lit(float(total)) + 0.5 * (kinds + 1)))).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("some"))
    out = scored.join(rest, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("some", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("worth") + more).alias("base_score"), (F.col("tree") + more).alias("score"))
