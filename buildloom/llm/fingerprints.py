"""SpotSigs fingerprints, in DataFrame functions alone.

A spot is a common word (of four languages) that a content word follows; its signature is that
common word with the chain of the next content words, common words between them skipped.  A
text's fingerprint is the set of its signatures.  Two fingerprints are alike by Jaccard; sets
are partitioned by length so that only neighbouring partitions can be alike enough, and within
them by rare signatures that alike sets must share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CHAIN = 2
#: stretches of as many rows each that keys are dealt into first
QUANTILES = 128
#: characters that one task sorts, about, where the session's own number of partitions gives it more
TASK_CHARS = 1 << 26

# The commonest words of English, German, French and Spanish.
COMMON = """
the of and to a in is it that was for on are with as be at by this from or an have not had but were which their has
der die das und zu den von ist mit des im dem nicht ein eine als auch es an auf werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch sein
le la les de du et un une en est que qui dans pour par au il sur ne se pas plus ce sont avec sa son ou aux leur
el los las y del por con para su al lo como más pero sus o este sí porque esta entre cuando muy sin
""".split()


def _prefixes(words: set[str]) -> str:
    """A pattern for exactly these words that tries each letter once."""
    heads = sorted({w[0] for w in words if w})
    parts = [c + _prefixes({w[1:] for w in words if w[:1] == c}) for c in heads]
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)})" + ("?" if "" in words else "") if len(parts) > 1 or "" in words else parts[0]


_ANY = _prefixes(set(COMMON))
_BEFORE_ANOTHER = f"(?<![^ ])(?:{_ANY}) (?=(?:{_ANY})(?: |$))"
_BEFORE_CONTENT = f"(?<![^ ])({_ANY}) (?=[^ ])"


def normalised(text: Column) -> Column:
    """Lower-cased runs of letters and digits, one space between; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted distinct signature hashes of a text (array<long>); a text without a spot has one, of its whole normalised words."""
    clean = normalised(text)
    # each run of common words goes, but for the last, which is joined to the content word after it
    words = F.split(F.regexp_replace(F.regexp_replace(clean, _BEFORE_ANOTHER, ""), _BEFORE_CONTENT, "$1_"), " ")

    def build(pair):
        rest = lambda i: [F.get(pair["bare"], i + j) for j in range(1, chain)]
        return F.array_compact(F.transform(pair["words"], lambda w, i: F.when(F.contains(w, F.lit("_")), F.xxhash64(w, *rest(i)))))

    # one struct, so that the split is made once
    pairs = F.transform(F.array(words), lambda w: F.struct(w.alias("words"), F.transform(w, lambda x: F.substring_index(x, "_", -1)).alias("bare")))
    found = F.array(F.flatten(F.transform(pairs, build)))
    return F.sort_array(F.array_distinct(F.flatten(F.transform(found, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.xxhash64(clean)))))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; 0 at once where one is null."""
    both = F.transform(F.array(F.size(F.array_intersect(a, b))), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.coalesce(both[0], F.lit(0.0))


def digest(sigs: Column) -> Column:
    """A signature set as a string: its size and the SHA-256 of its sorted members."""
    return F.concat(F.size(sigs).cast("string"), F.lit("-"), F.sha2(F.concat_ws(",", sigs.cast("array<string>")).cast("binary"), 256))


def with_next(rows: DataFrame, key: str, first: str, columns: dict[str, Column] | None = None) -> DataFrame:
    """rows, with columns added, and next_<column> of the following row in ascending order of the key (after the last: the first).

    Null keys come first; rows of one key follow each other by `first`.  Keys are dealt into about
    4 * sqrt(rows) ranges: `QUANTILES` stretches of as many rows each, as the keys lie, and equal widths
    within a stretch.  Each range is sorted by itself, and the first row of each range is also lent
    to the range before it; no task sees all rows."""
    ends = [i / QUANTILES for i in range(QUANTILES + 1)]
    n, marks, chars = rows.agg(F.count("*"), F.percentile_approx(key, ends, 10_000), F.coalesce(F.sum(F.char_length(first)), F.lit(0))).head()
    marks = sorted(set(marks or [0]))
    inside = max(1, -(-math.isqrt(16 * n) // QUANTILES))
    at = F.col(key).cast("decimal(20,0)")
    marked = F.array(*(F.lit(int(x)).cast("decimal(20,0)") for x in marks))
    stretch = F.greatest(F.size(F.filter(marked, lambda x: x <= at)), F.lit(1))
    low, high = F.element_at(marked, stretch), F.element_at(marked, F.least(stretch + 1, F.lit(len(marks))))
    step = F.when(high > low, F.floor((at - low).cast("double") * inside / (high - low).cast("double"))).otherwise(0)
    place = F.when(at.isNull(), F.lit(-1)).otherwise(stretch * inside + F.greatest(F.lit(0), F.least(step, F.lit(inside - 1)))).cast("int")
    rows = rows.withColumn("__range", place)
    order = [F.col(key).asc_nulls_first(), F.col(first).asc_nulls_first()]
    least = rows.groupBy("__range").agg(F.min(key).alias("__least"))
    whole = Window.orderBy("__range")  # the ranges alone, a few for each thousand rows
    least = least.withColumn("__to", F.coalesce(F.lag("__range").over(whole), F.last("__range").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = rows.join(least, (rows["__range"] == least["__range"]) & rows[key].eqNullSafe(least["__least"])).drop(least["__range"])
    heads = heads.withColumn("__n", F.row_number().over(Window.partitionBy("__range").orderBy(*order))).where("__n = 1")
    lent = heads.withColumn("__range", F.col("__to")).select(*rows.columns, F.lit(1).alias("__lent"))
    both = rows.select(*rows.columns, F.lit(0).alias("__lent")).unionByName(lent)
    tasks = -(-chars // TASK_CHARS)
    if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        both = both.repartition(tasks, "__range")  # the window takes this dealing over
    w = Window.partitionBy("__range").orderBy("__lent", *order)
    both = both.withColumn(f"next_{first}", F.lead(first).over(w))
    # added where the rows already lie in order, so that they are made once and never shuffled
    both = both.withColumns(columns or {})
    return both.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns or {})).where("__lent = 0").drop("__lent", "__range")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """(id, signatures) of each row of docs: its fingerprint as a sorted set of hashes.

    A null or empty text has the one signature of no words.  Equal texts have equal fingerprints;
    repeated rows and null ids stay; other columns are not read."""
    return docs.select(F.col(id_col), signatures(F.col(text_col).cast("string"), chain).alias("signatures"))


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """Each document's fingerprint beside those of an edited text and of the next document.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document in ascending id order (after the last: the first; a lone one: its own).
    Null texts count as empty; null ids come first, and rows of one id follow each other by their
    text; an empty table gives an empty result; other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows, "id", "text", {"sigs": signatures(F.col("text"), chain)})
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 4)))"), F.expr("substring(next_text, 1, int(floor(char_length(text) / 4)))"))
    rows = rows.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs").withColumn("edited_sigs", signatures(F.col("edited"), chain))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("sigs")).alias("fingerprint"), digest(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def alike(prints: DataFrame, least: float = 0.8, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(classes, pairs) of fingerprints(id, signatures) that are alike by `least` or more.

    classes(id, rep): the smallest id with the same set; pairs(a, b, likeness): representatives a < b.
    A set of length l can only be alike to lengths from l * least to l / least, so lengths fall into
    partitions whose bounds grow by 1 / least, and a set meets its own partition and the next one.
    There it is looked up by its l - ceil(least * l) + 1 rarest signatures, one of which alike sets
    share.  Rows without an id are left out; an empty table gives empty results."""
    rows = prints.select(F.col(id_col).alias("id"), "signatures").where("id is not null")
    same = rows.groupBy("signatures").agg(F.min("id").alias("rep"))
    classes = rows.join(same, "signatures").select("id", "rep")
    sets = written(same.withColumn("n", F.size("signatures")).withColumn("part", F.floor(F.log(F.size("signatures").cast("double")) / F.lit(math.log(1 / least)) + 1e-9)), "sets")
    sig = sets.select("rep", "n", "part", F.explode("signatures").alias("sig"))
    df = sig.groupBy("sig").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("rep", "n", "part").orderBy("df", "sig"))
    rare = sig.join(df, "sig").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    rare = written(rare.where("df > 1").select("rep", "n", "part", "sig"), "rare")
    own = rare.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.explode(F.array("part", F.col("part") + 1)).alias("meet"), "sig", F.col("part").alias("pa"))
    other = rare.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("part").alias("meet"), "sig")
    pairs = own.join(other, ["meet", "sig"]).where((F.col("a") != F.col("b")) & ((F.col("pa") < F.col("meet")) | (F.col("a") < F.col("b"))) & (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    full = sets.groupBy("rep").agg(F.collect_list("signatures").alias("all"))
    pairs = pairs.join(full.select(F.col("rep").alias("a"), F.explode("all").alias("x")), "a").join(full.select(F.col("rep").alias("b"), F.explode("all").alias("y")), "b")
    pairs = pairs.withColumn("likeness", likeness(F.col("x"), F.col("y"))).groupBy("a", "b").agg(F.max("likeness").alias("likeness"))
    return classes, pairs.where(F.col("likeness") >= least)
