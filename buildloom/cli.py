"""Reports over a folder of core tables, from the command line: python -m buildloom.cli REPORT --data FOLDER."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import split_values
from .operators import consolidate as co
from .operators import graph as g
from .operators import history as h
from .operators import includes as inc
from .operators import metrics as m
from .operators import recommend as rc
from .operators import scope as sc
from .sources.dataset import Dataset


class Build:
    """The core tables in the operators' terms, narrowed to the scope that the options ask for."""

    def __init__(self, spark: SparkSession, options: argparse.Namespace):
        self.data, self.options = Dataset(spark, options.data, not options.no_validate), options
        t = self.data.table("target_metrics")
        self.targets = t
        self.nodes = t.select(
            F.col("cmake_target").alias("node"), F.col("target_type").alias("kind"), F.col("source_directory").alias("directory"), F.col("total_build_time_ms").alias("ms"), F.col("git_commit_count_total").alias("commits"),
            F.col("transitive_dependant_count").alias("dependants"), F.col("file_count").alias("files"), F.col("code_lines_total").alias("lines"),
        )
        direct = self.data.table("edge_list").where("is_direct")
        self.edges = direct.select(F.col("source_target").alias("src"), F.col("dest_target").alias("dst"), F.col("cmake_visibility").alias("visibility")).dropDuplicates(["src", "dst"])
        asked = {"names": split_values(options.target), "globs": split_values(options.target_glob), "types": split_values(options.target_type), "directories": split_values(options.directory), "depends_on": split_values(options.depends_on), "dependencies_of": split_values(options.dependencies_of), "exclude": split_values(options.exclude), "exclude_globs": split_values(options.exclude_glob)}
        least = {k: getattr(options, k) for k in sc.THRESHOLDS if getattr(options, k) is not None}
        asked = {k: v for k, v in asked.items() if v}
        self.scope = sc.resolve(self.nodes, self.edges, **asked, **least) if asked or least else None

    def within(self, df: DataFrame, column: str = "node") -> DataFrame:
        return df if self.scope is None else df.join(self.scope.select(F.col("node").alias(column)), column, "left_semi")

    def files(self) -> DataFrame:
        o = self.options
        rows = self.within(self.data.table("file_metrics"), "cmake_target")
        return co.file_filters(rows, o.exclude_generated, split_values(o.language), split_values(o.file_path_glob), split_values(o.exclude_file_path_glob))


def critical_path(b: Build) -> DataFrame:
    """Targets on the critical path, and those that can slip no more than --near-ms."""
    rows = b.within(g.critical_path(b.nodes, b.edges)).join(b.nodes.select("node", "kind"), "node", "left").where(F.col("critical") | (F.col("slack") <= b.options.near_ms))
    return rows.select("node", "kind", "cost", "start", "finish", "slack", F.when(F.col("critical"), "critical").otherwise("near").alias("status")).orderBy("status", "start", "node")


def hotspots(b: Build) -> DataFrame:
    """Targets by scaled build time, commits and dependants."""
    return m.refactor_hotspots(b.within(b.nodes).select("node", "ms", F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("dependants", F.lit(0)).alias("dependants"))).orderBy(F.desc("score"), "node")


def layer_violations(b: Build) -> DataFrame:
    """Edges that do not lead to a lower layer; --layers names a CSV file of node and layer, else the graph's own layers count."""
    if b.options.layers:
        layers = b.data.spark.read.csv(b.options.layers, header=True, schema="node string, layer int")
    else:
        layers = g.longest(b.nodes, b.edges).select("node", F.col("level").alias("layer"))
    return b.within(g.layer_violations(b.edges, layers), "src").orderBy("src", "dst")


def ownership_risk(b: Build) -> DataFrame:
    """Targets that few contributors know, weighed by build time."""
    files = b.within(b.data.table("file_metrics"), "cmake_target").select("source_file", F.col("cmake_target").alias("target")).dropDuplicates(["source_file"])
    log = b.data.table("git_commit_log").withColumnRenamed("commit_hash", "commit_id").join(files, "source_file")
    times = b.nodes.select(F.col("node").alias("target"), "ms")
    return m.ownership_risk(h.concentration(log, "target"), times, b.options.max_contributors, b.options.min_top_share).orderBy(F.desc("risk"), "target")


def _months(log: DataFrame) -> float:
    days = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 86_400_000_000
    return max(log.agg(days).head()[0] or 0.0, 30.44) / 30.44


def rebuild_impact(b: Build) -> DataFrame:
    """What a change of --of, a target or a file's path, makes to be built again; or all targets by expected daily cost."""
    o = b.options
    if o.of:
        target = o.of
        if b.nodes.where(F.col("node") == target).isEmpty():
            changes = co.target_of_changes(b.data.spark.createDataFrame([(o.of,)], "path string"), b.data.table("file_metrics")).head()
            if changes["cmake_target"] is None:
                raise ValueError(f"no target owns {o.of!r}")
            target = changes["cmake_target"]
        return rc.dependants(b.nodes.select("node", "ms"), g.closure(b.edges), b.edges, target)
    log = b.data.table("git_commit_log")
    files = b.data.table("file_metrics").select("source_file", F.col("cmake_target").alias("node")).dropDuplicates(["source_file"])
    commits = log.join(files, "source_file").groupBy("node").agg(F.countDistinct("commit_hash").alias("commits"))
    return b.within(rc.daily_cost(g.rebuild_cost(b.nodes, b.edges), commits, _months(log))).orderBy(F.desc("daily_ms"), "node")


def slow_files(b: Build) -> DataFrame:
    """Files by one of the views: slowest, template, bloat, throughput."""
    return m.slow_files(b.files(), b.options.view, b.options.min_source_bytes, b.options.min_code_lines)


def header_hotlist(b: Build) -> DataFrame:
    """Headers by what a change of theirs makes to be compiled again."""
    nodes, edges = inc.include_graph(b.data.table("header_edges").withColumnRenamed("source_file", "unit"))
    headers = b.data.table("header_metrics").select(F.col("header_file").alias("node"), F.col("cmake_target").alias("target"), "sloc", "source_size_bytes")
    files = b.data.table("file_metrics").select(F.col("cmake_target").alias("target"), F.col("git_commit_count").alias("commits"))
    scope = b.scope.select(F.col("node").alias("target")) if b.scope is not None else None
    return inc.hot_list(nodes, edges, headers, files, not b.options.include_system, scope)


def target_summary(b: Build) -> DataFrame:
    """The figures of the targets in scope, and their neighbours where it is one."""
    return co.summary(b.within(b.targets, "cmake_target")).orderBy("target", "ord").select("target", "key", "value")


REPORTS: dict[str, Callable[[Build], DataFrame]] = {"critical-path": critical_path, "hotspots": hotspots, "layer-violations": layer_violations, "ownership-risk": ownership_risk, "rebuild-impact": rebuild_impact, "slow-files": slow_files, "header-hotlist": header_hotlist, "target-summary": target_summary}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="buildloom", description=__doc__)
    p.add_argument("report", choices=sorted(REPORTS))
    p.add_argument("--data", required=True, help="folder of the core tables")
    p.add_argument("--no-validate", action="store_true")
    p.add_argument("--format", choices=("table", "csv", "json"), default="table")
    p.add_argument("--limit", type=int, default=20, help="rows to show; 0 shows all")
    for name in ("target", "target-glob", "target-type", "directory", "depends-on", "dependencies-of", "exclude", "exclude-glob", "language", "file-path-glob", "exclude-file-path-glob"):
        p.add_argument(f"--{name}", action="append", help="may be given several times, or with commas")
    for name in sc.THRESHOLDS:
        p.add_argument(f"--{name.replace('_', '-')}", type=float)
    p.add_argument("--exclude-generated", action="store_true")
    p.add_argument("--include-system", action="store_true")
    p.add_argument("--near-ms", type=int, default=1000)
    p.add_argument("--layers")
    p.add_argument("--of", help="a target, or a file's path")
    p.add_argument("--view", choices=("slowest", "template", "bloat", "throughput"), default="slowest")
    p.add_argument("--min-source-bytes", type=int, default=512)
    p.add_argument("--min-code-lines", type=int, default=50)
    p.add_argument("--max-contributors", type=int)
    p.add_argument("--min-top-share", type=float, default=0.0)
    return p


def main(argv: list[str] | None = None) -> int:
    """Writes the report to standard output; 0, or 1 with a line on standard error where the question has no answer."""
    options = parser().parse_args(argv)
    spark = SparkSession.builder.appName("buildloom").getOrCreate()
    try:
        sys.stdout.write(co.emit(REPORTS[options.report](Build(spark, options)), options.format, options.limit))
    except (ValueError, KeyError, FileNotFoundError) as e:
        sys.stderr.write(f"{options.report}: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
