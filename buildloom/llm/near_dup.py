"""MinHash near-duplicate classes with tensored banding.

Two small hash collections, A and B, are computed per text; each yields `bands` short keys of
`width` minimum hashes.  Table (i, j) is keyed by A's i-th and B's j-th key together, so
bands**2 tables cost only 2 * bands * width minimum hashes.  Two texts of similarity s meet in
some table with probability (1 - (1 - s**width)**bands)**2: 0.99993 at s = 0.8 as set here.

Work on hot groups stays near linear.  Texts with equal shingle sets are one class first.  In
every bucket all classes are compared with its most central one, the one whose own buckets are
the largest (a star), and what links is merged.  Buckets that still hold several components go
on.  Large ones are first taken apart exactly: a class of theirs is looked up by its rarest
shingles only, as many as a linked class cannot all lack (prefix filter), and lists of one
component end there.  In what is left every pair of different components is compared: pair by
pair in short lists; in long ones by their sketches, in tasks of `ROWS` by `BLOCK` rows, and only
pairs that pass leave the task.  No pair is left out and none is capped.

A sketch counts a set's shingles in each of `SKETCH` cells of hash values.  Two sets share at most
the smaller count of each cell, so a pair whose sketches put it below the threshold has no link,
for certain; only such pairs go before texts are joined.  Links are confirmed on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import textvec as tv
from .common import commonest, components, written

BANDS, WIDTH, SKETCH = 10, 2, 1024
#: buckets with more rows than this are taken apart by rare shingles
LARGE = 48
ROWS, BLOCK = 64, 4096
#: shingles of such buckets that are known to be common, on every machine (16 bytes each)
COMMONEST = 1 << 17

#: classes whose keys one task makes
ROWS_AT_ONCE = 1 << 14

_SIG = "id long, n_shingles long, h1 long, h2 long, a array<long>, b array<long>"


def _signatures(k: int, bands: int, width: int):
    total = 2 * bands * width

    def run(batches):
        times, flips = tv.seeds(total, 5) | np.uint64(1), tv.seeds(total, 9)
        for batch in batches:
            buf, offsets = tv.text_buffer(batch.column(1))
            ids, out = batch.column(0), []
            for lo, hi in tv.groups(offsets):
                part = offsets[lo : hi + 1]
                words, _, _, woffs = tv.hash_words(buf[part[0] : part[-1]], part - part[0])
                sets, offs = tv.distinct(*tv.shingles(words, woffs, k))
                n = np.diff(offs)
                full = np.flatnonzero(n)
                least = np.zeros((hi - lo, total), np.uint64)
                h = np.zeros((hi - lo, 2), np.uint64)
                if len(full):
                    at = offs[full]
                    for j in range(total):
                        least[full, j] = np.minimum.reduceat((sets ^ flips[j]) * times[j], at)
                    h[full, 0] = np.add.reduceat(tv.mix(sets + np.uint64(11)), at)
                    h[full, 1] = np.add.reduceat(tv.mix(sets + np.uint64(23)), at)
                mixed = tv.mix(least)
                keys = mixed.reshape(hi - lo, 2 * bands, width)
                band = np.zeros((hi - lo, 2 * bands), np.uint64)
                for j in range(width):
                    band = tv.mix(band + keys[:, :, j])
                out.append((n, h.view(np.int64), band.view(np.int64)))
            if not out:
                continue
            n, h, band = (np.concatenate(x) for x in zip(*out))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, bands, dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(h[:, 0]), pa.array(h[:, 1]), lists(band[:, :bands]), lists(band[:, bands:])],
                names=["id", "n_shingles", "h1", "h2", "a", "b"],
            )

    return run


def _sketches(k: int):
    """(id, sig): how many of each text's shingles fall into each cell, a byte for each; 255 and more are 255."""

    def run(batches):
        for batch in batches:
            buf, offsets = tv.text_buffer(batch.column(1))
            for lo, hi in tv.groups(offsets):
                part = offsets[lo : hi + 1]
                words, _, _, woffs = tv.hash_words(buf[part[0] : part[-1]], part - part[0])
                sets, offs = tv.distinct(*tv.shingles(words, woffs, k))
                cell = (sets >> np.uint64(64 - (SKETCH - 1).bit_length())).astype(np.int64)
                sig = [np.minimum(np.bincount(cell[p:q], minlength=SKETCH), 255).astype(np.uint8).tobytes() for p, q in zip(offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sig, pa.binary())], names=["id", "sig"])

    return run


def _cells(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, SKETCH)


def _able(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a link is possible: the sets share at most the smaller count of each cell.  A full cell tells nothing."""
    both = np.minimum(a, b).sum(1, dtype=np.int64)
    size = a.sum(1, dtype=np.int64) + b.sum(1, dtype=np.int64)
    return (100 * both >= percent * (size - both)) | (a.max(1) == 255) | (b.max(1) == 255)


def _likely(percent: int):
    """Drops pairs whose sketches leave no link possible."""

    def run(batches):
        for x in batches:
            keep = np.zeros(x.num_rows, bool)
            for at in range(0, x.num_rows, 2048):
                piece = x.slice(at, 2048)
                keep[at : at + 2048] = _able(_cells(piece.column(2).to_pylist()), _cells(piece.column(3).to_pylist()), percent)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["u", "v"]).filter(pa.array(keep))

    return run


def _between(percent: int):
    """The pairs of one task's rows, `few` against all, that are of different components and whose sketches leave a link possible."""

    def run(table: pa.Table) -> pa.Table:
        few = np.array(table["few"].to_pylist(), bool)
        rep, label, minor = table["rep"].to_numpy(), table["label"].to_numpy(), np.array(table["minor"].to_pylist(), bool)
        sig, single = _cells(table["sig"].to_pylist()), table["sets"].to_numpy() == 1
        members = np.flatnonzero(~few)
        u, v = [], []
        for i in np.flatnonzero(few):
            # two rows of the few meet once, from the smaller one
            other = members[(label[members] != label[i]) & (~minor[members] | (rep[members] > rep[i]))]
            for at in range(0, len(other), 2048):
                some = other[at : at + 2048]
                good = some[_able(sig[i : i + 1], sig[some], percent) | ~single[some] | ~single[i]]
                u += [int(rep[i])] * len(good)
                v += rep[good].tolist()
        return pa.table({"u": pa.array(np.minimum(u, v) if u else [], pa.int64()), "v": pa.array(np.maximum(u, v) if u else [], pa.int64())})

    return run


def _occurrences(k: int, most: int = 1 << 18):
    """(key, n): how many texts have each shingle, summed within a task up to `most` shingles at a time."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, n = (np.concatenate(x) for x in zip(*held))
            got, where = np.unique(keys, return_inverse=True)
            return got, np.bincount(where, weights=n, minlength=len(got)).astype(np.int64)

        def out(keys, n):
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

        for batch in batches:
            buf, offsets = tv.text_buffer(batch.column(0))
            for lo, hi in tv.groups(offsets):
                part = offsets[lo : hi + 1]
                words, _, _, woffs = tv.hash_words(buf[part[0] : part[-1]], part - part[0])
                held.append(np.unique(tv.distinct(*tv.shingles(words, woffs, k))[0], return_counts=True))
                if sum(len(x) for x, _ in held) > 2 * most:
                    held = [merged()]
                    if len(held[0][0]) > most:
                        yield out(*held[0])
                        held = []
        if held:
            yield out(*merged())

    return run


def _rarest(k: int, percent: int, common):
    """(rep, key): the shingles that a text and one linked with it cannot both lack.

    Of n shingles a linked text has `overlap` or more, so one of the n - overlap + 1 first in any one order
    is in both lists; the order puts the commonest shingles last.  All shingles where an id has several texts."""

    def run(batches):
        keys, times = common.value
        for batch in batches:
            buf, offsets = tv.text_buffer(batch.column(1))
            least, several = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for lo, hi in tv.groups(offsets):
                part = offsets[lo : hi + 1]
                words, _, _, woffs = tv.hash_words(buf[part[0] : part[-1]], part - part[0])
                sets, offs = tv.distinct(*tv.shingles(words, woffs, k))
                rows, found = [], []
                for i, (p, q) in enumerate(zip(offs[:-1], offs[1:])):
                    mine, n = sets[p:q], int(q - p)
                    often = np.zeros(n, np.int64)
                    if len(keys) and n:
                        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                        often = np.where(keys[at] == mine, times[at], 0)
                    other = max(int(least[lo + i]), -(-n * percent // 100))
                    overlap = -(-percent * (n + other) // (100 + percent))
                    take = n if several[lo + i] > 1 else max(n - overlap + 1, 0)
                    found.append(mine[np.lexsort((mine, often))[:take]])
                    rows.append(np.full(take, lo + i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(found).view(np.int64))], names=["rep", "key"])

    return run


def _linked(k: int, percent: int):
    """Keeps the pairs whose whole shingle sets have 100 * intersection >= percent * union."""

    def run(batches):
        for x in batches:
            keep = np.zeros(x.num_rows, bool)
            for at in range(0, x.num_rows, 256):
                piece = x.slice(at, 256)
                sides = []
                for c in (2, 3):
                    buf, offsets = tv.text_buffer(piece.column(c))
                    words, _, _, woffs = tv.hash_words(buf, offsets)
                    sides.append(tv.distinct(*tv.shingles(words, woffs, k)))
                (p, po), (q, qo) = sides
                for i in range(piece.num_rows):
                    s, t = p[po[i] : po[i + 1]], q[qo[i] : qo[i + 1]]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep[at + i] = both and 100 * both >= percent * (len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["u", "v"]).filter(pa.array(keep))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of docs, linked where 100 * |A & B| >= percent * |A | B|.

    Words are runs of bytes other than ASCII white space, A-Z as a-z; a text's set holds its
    distinct k-word shingles, or its whole sequence if it is shorter.  component_id is the
    smallest id that links lead to.  Texts that are null, empty or blank have an empty set and
    link with nothing.  Rows with one id are one document; a null id links with nothing and is
    kept.  An empty table gives an empty result.  Other columns of docs are neither read nor kept.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sigs = written(rows.mapInArrow(_signatures(k, bands, width), _SIG), "sigs")
    same = ["n_shingles", "h1", "h2"]
    linkable = sigs.where("n_shingles > 0 and id is not null")
    classes = written(linkable.groupBy(*same).agg(F.min("id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b")), "classes")
    # One id may carry several texts: then its classes meet through links of their own.
    twice = linkable.select("id", *same).distinct().groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    more = linkable.join(twice, "id").join(classes.select("rep", *same), same).select(F.col("id").alias("u"), F.col("rep").alias("v")).where("u <> v")

    table = F.transform("a", lambda p, i: F.transform("b", lambda q, j: F.xxhash64(p, q, i * bands + j)))
    # each row becomes bands**2 keys: as many tasks as those ask for, not as many as these rows do
    keys = classes.repartition(-(-classes.count() // ROWS_AT_ONCE) or 1, "rep").select("rep", F.explode(F.flatten(table)).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    met = written(keys.join(shared, "key"), "met")
    central = met.groupBy("rep").agg(F.sum("c").alias("weight"))
    size = F.max("n_shingles").alias("n"), F.min("n_shingles").alias("low"), F.count("*").alias("sets")
    sizes = written(classes.groupBy("rep").agg(*size).join(central, "rep"), "sizes")
    texts = written(rows.where("id is not null").join(sizes.select(F.col("rep").alias("id")), "id", "left_semi"), "texts")
    sketches = texts.mapInArrow(_sketches(k), "id long, sig binary").groupBy(F.col("id").alias("rep")).agg(F.min("sig").alias("sig"))
    info = written(sizes.join(sketches, "rep"), "info")
    met = met.join(sizes.select("rep", "n", "low", "sets", (-F.col("weight")).alias("place")), "rep")
    pivots = met.groupBy("key").agg(F.min(F.struct("place", "rep")).alias("pivot")).select("key", F.col("pivot.rep").alias("pivot"))
    buckets = written(met.join(pivots, "key").where("rep <> pivot"), "buckets")

    def side(x: str) -> DataFrame:
        return info.select(*(F.col(c).alias(x if c == "rep" else f"{c}_{x}") for c in ("rep", "n", "low", "sig", "sets")))

    def confirm(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(side("u"), "u").join(side("v"), "v").where(f"100 * least(n_u, n_v) >= {percent} * greatest(low_u, low_v)")
        plain = sized.where("sets_u = 1 and sets_v = 1").select("u", "v", "sig_u", "sig_v").mapInArrow(_likely(percent), "u long, v long")
        likely = written(plain.union(sized.where("sets_u > 1 or sets_v > 1").select("u", "v")), "likely")
        first = likely.join(texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u")
        pair = first.join(texts.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v")
        return written(pair.select("u", "v", "text_u", "text_v").mapInArrow(_linked(k, percent), "u long, v long").distinct(), "linked")

    def several(rows: DataFrame, label: DataFrame) -> DataFrame:
        """The rows of buckets that hold more than one component, with their labels."""
        known = rows.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        mixed = known.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("rows"), F.min("low").alias("least")).where("x <> y").select("key", "rows", "least")
        return known.drop("rows", "least").join(mixed, "key")

    seen = written(buckets.select(F.least("pivot", "rep").alias("u"), F.greatest("pivot", "rep").alias("v")).distinct(), "pairs")
    links = written(confirm(seen).union(more), "links")
    label = components(links)
    # buckets lacks the pivot, which all others have met
    left = written(several(buckets.select("key", "rep", "place", "n", "low", "sets"), label), "left")
    row = ["key", "rep", "place", "n", "low", "sets"]
    large = left.where(F.col("rows") > LARGE).groupBy("rep").agg(*(F.first(c).alias(c) for c in row[2:]), F.min("least").alias("least"))
    apart = written(texts.join(large.select(F.col("rep").alias("id"), "least", "sets"), "id").select("id", "text", "least", "sets"), "apart")
    times = written(apart.select("text").mapInArrow(_occurrences(k), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "times")
    got = commonest(times, COMMONEST).toArrow()
    order = np.argsort(got["key"].to_numpy().view(np.uint64))
    common = docs.sparkSession.sparkContext.broadcast((got["key"].to_numpy().view(np.uint64)[order], got["n"].to_numpy()[order]))
    lists = apart.mapInArrow(_rarest(k, percent, common), "rep long, key long").distinct().join(large, "rep")
    left = left.where(F.col("rows") <= LARGE).select(*row).unionByName(lists.select(*row))
    left = written(several(left, label), "left")
    short = left.where(F.col("rows") <= LARGE).select("key", "rep", "label", "n", "low")
    other = short.select("key", *(F.col(c).alias(f"{c}_v") for c in ("rep", "label", "n", "low")))
    able = F.expr(f"rep < rep_v and label <> label_v and 100 * least(n, n_v) >= {percent} * greatest(low, low_v)")
    pairs = short.join(other, "key").where(able).select(F.col("rep").alias("u"), F.col("rep_v").alias("v"))
    # long lists: all rows against those outside the list's largest component
    long = left.where(F.col("rows") > LARGE).select("key", "rep", "label", "sets")
    major = long.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("x")).select("key", F.col("x.label").alias("major"))
    long = long.join(major, "key").withColumn("minor", F.col("label") != F.col("major"))
    # rows fall into blocks by a hash, and so do the few; as many of either as their count asks for
    count = long.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if("minor") / ROWS).cast("int").alias("chunks"))
    long = written(long.join(count, "key").join(info.select("rep", "sig"), "rep"), "long")
    at = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    every = long.select("key", "rep", "label", "minor", "sets", "sig", F.lit(False).alias("few"), at(1, "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    few = long.where("minor").select("key", "rep", "label", "minor", "sets", "sig", F.lit(True).alias("few"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), at(2, "chunks").alias("chunk"))
    pairs = pairs.union(every.unionByName(few).groupBy("key", "block", "chunk").applyInArrow(_between(percent), "u long, v long"))
    pairs = written(pairs.distinct().join(seen, ["u", "v"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        links = written(links.union(confirm(pairs)), "links")
        label = components(links)

    one = sigs.select("id", *same).join(classes.select("rep", *same), same, "left")
    one = one.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left")
    group = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("label", "rep")).otherwise(F.col("id"))
    return one.select(F.col("id").alias(id_col), "n_shingles", group.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs, all columns, without the near duplicates of a document with a smaller id.

    Nulls, blank texts and repeated rows of a kept id stay; an empty table gives an empty result."""
    gone = near_duplicates(docs, id_col=id_col, **how).where("not kept").select(F.col(id_col).alias("gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
