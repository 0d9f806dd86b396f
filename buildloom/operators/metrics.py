"""Roll-ups, scores, validation and comparisons over file, target, step and snapshot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import glob, minmax, ratio


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def target_rollup(files: DataFrame) -> DataFrame:
    """Counts, sums and the spread of compile times of each target; history counts authored files alone."""
    made, ms = F.col("is_generated"), F.col("compile_ms")
    spread = Window.partitionBy("target")
    authored = F.when(~made, F.col("commits"))
    hot = files.withColumn("__hot", authored > F.avg(authored).over(spread) + _zero(F.stddev_samp(authored).over(spread)))
    return hot.groupBy("target").agg(
        F.count("*").alias("files"), F.count_if(made).alias("generated_files"), F.count_if(~made).alias("authored_files"),
        _zero(F.sum("code_lines")).alias("code_lines"), _zero(F.sum(F.when(made, F.col("code_lines")))).alias("generated_lines"),
        _zero(F.sum(ms)).alias("compile_ms"), _zero(F.max(ms)).alias("compile_max"), F.avg(ms).alias("compile_mean"), F.median(ms).alias("compile_median"),
        F.coalesce(F.stddev_samp(ms), F.lit(0.0)).alias("compile_std"), F.percentile(ms, 0.9).alias("compile_p90"), F.percentile(ms, 0.99).alias("compile_p99"),
        _zero(F.sum(authored)).alias("commits"), F.count_if("__hot").alias("hotspots"),
    )


def hotspot_files(files: DataFrame) -> DataFrame:
    """Authored files with more commits than their target's mean and one deviation."""
    w = Window.partitionBy("target")
    rows = files.where(~F.col("is_generated")).withColumn("level", F.avg("commits").over(w) + F.coalesce(F.stddev_samp("commits").over(w), F.lit(0.0)))
    return rows.where(F.col("commits") > F.col("level")).select("target", "file_id", "commits", "level")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """One row: count, sum, extremes, mean, median, deviation and upper percentiles; zeros over no rows."""
    c = F.col(column)
    return df.agg(F.count(c).alias("n"), _zero(F.sum(c)).alias("total"), _zero(F.min(c)).alias("low"), _zero(F.max(c)).alias("high"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"), F.coalesce(F.median(c), F.lit(0.0)).alias("median"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"), F.coalesce(F.percentile(c, 0.9), F.lit(0.0)).alias("p90"), F.coalesce(F.percentile(c, 0.99), F.lit(0.0)).alias("p99"))


def step_times(steps: DataFrame, kinds: list[str]) -> DataFrame:
    """Milliseconds of each kind of step by target, a column each."""
    out = steps.withColumn("ms", F.col("end_ms") - F.col("start_ms")).groupBy("target_id").pivot("step_type", kinds).agg(F.sum("ms"))
    return out.na.fill(0).select("target_id", *(F.col(k).alias(f"{k}_ms") for k in kinds))


def parallelism(steps: DataFrame) -> DataFrame:
    """One row: wall and CPU time, mean and exact greatest parallelism.

    Starts and ends are summed up by moment before the running sum, and the moments are dealt into
    hours, whose own sums carry over; so no task holds all moments."""
    moves = steps.where("end_ms > start_ms").select(F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("at"), F.lit(-1).alias("d")))).alias("x")).select("x.at", "x.d")
    moves = moves.groupBy("at").agg(F.sum("d").alias("d")).withColumn("hour", F.floor(F.col("at") / 3_600_000))
    within = moves.withColumn("run", F.sum("d").over(Window.partitionBy("hour").orderBy("at")))
    hours = within.groupBy("hour").agg(F.sum("d").alias("d"), F.max("run").alias("peak"))
    before = F.sum("d").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    peak = hours.withColumn("before", F.coalesce(before, F.lit(0))).agg(F.max(F.col("before") + F.col("peak")).alias("peak"))
    totals = steps.agg(F.count("*").alias("steps"), (F.max("end_ms") - F.min("start_ms")).alias("wall_ms"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("cpu_ms"))
    return totals.crossJoin(F.broadcast(peak)).select("steps", "wall_ms", "cpu_ms", ratio("cpu_ms", "wall_ms").alias("mean_parallelism"), _zero(F.col("peak")).alias("max_parallelism"))


def longest_prefix(rows: DataFrame, column: str, owners: DataFrame) -> DataFrame:
    """rows with the owner(prefix, owner) of the longest directory (of words here) that the column begins with: ancestors are exploded, so the join is an equality."""
    parts = F.split(column, " ")
    up = rows.select("*", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("__k")).withColumn("prefix", F.array_join(F.slice(F.split(column, " "), F.lit(1), F.col("__k")), " "))
    best = up.join(owners, "prefix").groupBy(column).agg(F.max_by("owner", "__k").alias("owner"), F.max_by("prefix", "__k").alias("prefix"))
    return rows.join(best, column, "left")


def assign_modules(rows: DataFrame, column: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """rows with the module of the first pattern that matches, in the order declared; null if none does."""
    out = F.lit(None).cast("string")
    for module, pattern in reversed(patterns):
        out = F.when(glob(column, pattern), module).otherwise(out)
    return rows.withColumn("module", out)


#: stretches of costs, of as many rows each, that the frontier is looked for in side by side
STRETCHES = 64


def pareto(df: DataFrame, gain: str, cost: str, key: str) -> DataFrame:
    """Rows that no other row beats: none with as much gain for no more cost, and better in one of the two.

    The best gain of each cost comes first, then a running maximum over the distinct costs: within
    stretches of costs, and over the stretches, so no task holds all costs.  Effort below 2 is
    quick_win, up to 10 medium."""
    best = df.groupBy(cost).agg(F.max(gain).alias("__best"))
    marks = best.agg(F.percentile_approx(cost, [i / STRETCHES for i in range(STRETCHES)])).head()[0] or []
    at = F.size(F.filter(F.array(*(F.lit(x) for x in sorted(set(marks)))), lambda x: x <= F.col(cost))) if marks else F.lit(0)
    best = best.withColumn("__at", at)
    tops = best.groupBy("__at").agg(F.max("__best").alias("__top"))
    tops = tops.select("__at", F.max("__top").over(Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)).alias("__below"))  # a row for each stretch
    cheaper = Window.partitionBy("__at").orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("__before", F.max("__best").over(cheaper)).join(F.broadcast(tops), "__at")
    beaten = F.greatest("__before", "__below")  # nulls are passed over
    top = best.where(beaten.isNull() | (F.col("__best") > beaten))
    out = df.join(top.select(cost, "__best"), cost).where(F.col(gain) == F.col("__best")).drop("__best")
    effort = F.when(F.col(cost) < 2, "quick_win").when(F.col(cost) <= 10, "medium").otherwise("strategic")
    return out.select(key, gain, cost, effort.alias("category"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """One row: distinct child keys without a parent, and rows that have them."""
    lost = child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    return lost.agg(F.countDistinct(column).alias("missing_keys"), F.count("*").alias("rows"))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, rows) of each column, in one pass."""
    counts = df.agg(F.count("*").alias("__rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counts.select("__rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns))).alias("x")).select("x.column", "x.nulls", F.col("__rows").alias("rows"))


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, failures) of each rule in one pass; a null counts as a failure."""
    counts = df.agg(*(F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("failures")) for n in rules))).alias("x")).select("x.*")


def refactor_hotspots(targets: DataFrame) -> DataFrame:
    """Scaled build time times scaled logarithms of commits and of dependants."""
    df = targets.withColumn("lc", F.log1p(F.col("commits").cast("double"))).withColumn("ld", F.log1p(F.col("dependants").cast("double")))
    return minmax(df, t="ms", c="lc", d="ld").withColumn("score", F.col("t") * F.col("c") * F.col("d")).drop("lc", "ld", "t", "c", "d")


def slow_files(files: DataFrame, view: str, least_bytes: int = 512, least_lines: int = 50) -> DataFrame:
    """One of the views of files that are slow to compile, with the figure that it sorts by.

    slowest: by compile time; template: by the share of template instantiation in the compiler's time (0
    over none), compiled files alone; bloat: by growth in preprocessing, sources of least_bytes or
    more; throughput: by lines compiled a second, the fewest first, compiled files of least_lines or more."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    key = ["source_file", "cmake_target", "compile_time_ms"]
    if view == "slowest":
        return files.select(*key, F.col("compile_time_ms").cast("double").alias("figure")).orderBy(F.desc_nulls_last("figure"), "source_file")
    if view == "template":
        share = F.coalesce(F.try_divide(zero("compiler_template_instantiation_ms"), "compiler_total_time_ms"), F.lit(0.0))
        return files.where(zero("compile_time_ms") > 0).select(*key, share.alias("figure")).orderBy(F.desc("figure"), "source_file")
    if view == "bloat":
        return files.where(zero("source_size_bytes") >= least_bytes).select(*key, F.col("expansion_ratio").alias("figure")).orderBy(F.desc_nulls_last("figure"), "source_file")
    if view == "throughput":
        return files.where((zero("code_lines") >= least_lines) & (zero("compile_time_ms") > 0)).select(*key, F.col("compile_rate_lines_per_sec").alias("figure")).orderBy(F.asc_nulls_last("figure"), "source_file")
    raise ValueError(f"{view!r} is no view: slowest, template, bloat or throughput")


def ownership_risk(concentration: DataFrame, targets: DataFrame, most_contributors: int | None = None, least_share: float = 0.0) -> DataFrame:
    """Top share times Gini times the root of the build time of each target, with filters on what is shown; targets(target, ms), a missing time counts as 0."""
    out = concentration.join(targets.select("target", "ms"), "target", "left")
    out = out.withColumn("risk", F.col("top_share") * F.col("gini") * F.sqrt(F.coalesce("ms", F.lit(0)).cast("double")))
    if most_contributors is not None:
        out = out.where(F.col("contributors") <= most_contributors)
    if least_share > 0:
        out = out.where(F.col("top_share") >= least_share)
    return out.select("target", "contributors", "top_share", "gini", "commits", "risk")


def target_deltas(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's change: improved, regressed, unchanged, new or removed; no percentage for the last two."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    out = b.join(a, key, "full_outer")
    delta = F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))
    status = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "removed").when(delta < 0, "improved").when(delta > 0, "regressed").otherwise("unchanged")
    pct = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), ratio(delta * 100.0, "before"))
    return out.select(key, "before", "after", delta.alias("delta"), pct.alias("pct"), status.alias("status"))


def edge_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst, status): added, removed or unchanged, by one full outer join."""
    b, a = before.select("src", "dst").distinct().withColumn("b", F.lit(1)), after.select("src", "dst").distinct().withColumn("a", F.lit(1))
    return b.join(a, ["src", "dst"], "full_outer").select("src", "dst", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("unchanged").alias("status"))


def trend(snapshots: DataFrame) -> DataFrame:
    """Totals of each snapshot, and build time by file against the snapshot before."""
    out = snapshots.groupBy("label").agg(F.count("*").alias("targets"), F.sum("files").alias("files"), F.sum("build_ms").alias("build_ms"), F.max("build_ms").alias("slowest"), F.sum("authors").alias("authors"))
    w = Window.orderBy("label")  # one row for each snapshot
    return out.withColumn("ms_per_file", ratio("build_ms", "files")).withColumn("build_ms_before", F.lag("build_ms").over(w))


def line_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blank, comment and code lines: a fold with a block-comment state; a line that opens with code is code and opens no block."""

    def step(s: Column, line: Column) -> Column:
        t = F.trim(line)
        inside, opens = s["inside"], t.startswith("/*")
        closes = t.contains("*/")
        blank = ~inside & (t == "")
        comment = inside | opens | (~inside & t.startswith("//"))
        return F.struct(
            F.when(inside, ~closes).otherwise(opens & ~closes).alias("inside"), (s["blank"] + blank.cast("int")).alias("blank"),
            (s["comment"] + (~blank & comment).cast("int")).alias("comment"), (s["code"] + (~blank & ~comment).cast("int")).alias("code"),
        )

    lines = F.split(F.regexp_replace(F.coalesce(text_col, F.lit("")), "\n$", ""), "\n")
    zero = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("blank"), F.lit(0).alias("comment"), F.lit(0).alias("code"))
    return docs.select(id_col, F.aggregate(lines, zero, step).alias("x")).select(id_col, *(F.col(f"x.{c}").cast("long").alias(c) for c in ("blank", "comment", "code")))
