"""Snapshots against each other: totals over time, deltas, regressions, critical paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph as g

#: totals of which less is better
LOWER_IS_BETTER = ("total_build_time_ms", "total_compile_time_ms", "total_link_time_ms", "total_preprocessed_bytes", "mean_expansion_ratio", "edge_count", "mean_dependency_count", "mean_dep_count")
#: what a target table's columns add up to, and which are averaged
SUMS = {"build_ms": "total_build_time_ms", "total_build_time_ms": "total_build_time_ms", "compile_time_sum_ms": "total_compile_time_ms", "link_ms": "total_link_time_ms", "link_time_ms": "total_link_time_ms", "file_count": "file_count", "code_lines": "total_sloc", "code_lines_total": "total_sloc", "preprocessed_bytes_total": "total_preprocessed_bytes"}
MEANS = {"dependencies": "mean_dep_count", "total_dependency_count": "mean_dep_count", "expansion_ratio_mean": "mean_expansion_ratio", "codegen_ratio": "codegen_ratio"}


def trend(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """A row of totals for each label, of the columns that targets(label, ...) has; edges(label, src, dst)."""
    have = [c for c in targets.columns]
    totals = targets.groupBy("label").agg(F.count("*").cast("double").alias("target_count"), *(F.sum(c).cast("double").alias(SUMS[c]) for c in have if c in SUMS), *(F.avg(c).alias(MEANS[c]) for c in have if c in MEANS))
    out = totals.join(edges.groupBy("label").agg(F.count("*").cast("double").alias("edge_count")), "label", "left").na.fill(0.0, ["edge_count"])
    if {"total_build_time_ms", "total_sloc"} <= set(out.columns):
        out = out.withColumn("build_time_per_sloc", F.when(F.col("total_sloc") > 0, F.col("total_build_time_ms") / F.col("total_sloc")).otherwise(0.0))
    return out


def _long(trends: DataFrame, metrics: list[str]) -> DataFrame:
    return trends.select("label", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select("label", "x.*")


def global_deltas(trends: DataFrame, before, after) -> DataFrame:
    """(metric, before, after, delta, delta_pct, improved) between two labels; from 0 the percentage is 0."""
    rows = _long(trends, [c for c in trends.columns if c not in ("label", "date", "build_time_per_sloc")])
    at = lambda label: F.max(F.when(F.col("label") == label, F.col("value")))
    out = rows.groupBy("metric").agg(at(before).alias("before"), at(after).alias("after")).withColumn("delta", F.col("after") - F.col("before"))
    pct = F.when(F.col("before") != 0, F.col("delta") / F.col("before") * 100).otherwise(0.0)
    return out.withColumn("delta_pct", pct).withColumn("improved", F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("delta") < 0).otherwise(F.col("delta") >= 0))


def regressions(trends: DataFrame, metrics: list[str], threshold: float = 10.0, latest_only: bool = True) -> DataFrame:
    """Metrics that grew by more than threshold percent since the label before, at the last label or at each; twice that is critical, growth from 0 is left out."""
    rows = _long(trends, [m for m in metrics if m in trends.columns])
    w = Window.partitionBy("metric")
    rows = rows.withColumn("before", F.lag("value").over(w.orderBy("label"))).withColumn("last", F.max("label").over(w))
    if latest_only:
        rows = rows.where("label = last")
    rows = rows.where("before <> 0").withColumn("pct", (F.col("value") - F.col("before")) / F.col("before") * 100).where(F.col("pct") > threshold)
    return rows.select("label", "metric", "before", F.col("value").alias("after"), "pct", F.when(F.col("pct") > 2 * threshold, "critical").otherwise("warning").alias("severity"))


def module_trends(targets: DataFrame, modules: DataFrame) -> DataFrame:
    """Totals of each label and module; modules(node, module), targets without one are left out."""
    rows = targets.drop("module").join(modules.withColumnRenamed("node", "target"), "target").where("module is not null")
    return rows.groupBy("label", "module").agg(F.count("*").alias("target_count"), F.sum("build_ms").alias("total_build_time_ms"), F.sum("code_lines").alias("total_sloc"), F.lit(0).alias("external_dep_count"))


def efficiency(trends: DataFrame) -> DataFrame:
    """One row: build time a line at the first and the last label, and which way it goes."""
    one = trends.agg(F.min_by("build_time_per_sloc", "label").alias("first"), F.max_by("build_time_per_sloc", "label").alias("last"))
    pct = F.when(F.col("first") > 0, (F.col("last") - F.col("first")) * 100 / F.col("first")).otherwise(0.0)
    way = F.when(F.col("last") < F.col("first"), "improving").when(F.col("last") > F.col("first"), "degrading").otherwise("stable")
    return one.withColumn("delta_pct", pct).withColumn("direction", way)


def critical_paths(nodes_before: DataFrame, edges_before: DataFrame, nodes_after: DataFrame, edges_after: DataFrame) -> DataFrame:
    """(node, status, before_ms, after_ms): the nodes on either critical path, added to it, removed from it or unchanged, with both lengths."""
    a, b = g.critical_path(nodes_before, edges_before), g.critical_path(nodes_after, edges_after)
    total = a.agg(F.max("finish").alias("before_ms")).crossJoin(F.broadcast(b.agg(F.max("finish").alias("after_ms"))))  # one row each
    both = a.where("critical").select("node", F.lit(1).alias("x")).join(b.where("critical").select("node", F.lit(1).alias("y")), "node", "full_outer")
    status = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("unchanged")
    return both.select("node", status.alias("status")).crossJoin(F.broadcast(total))
