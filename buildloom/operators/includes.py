"""The graph of inclusions, and what its headers cost: an edge src -> dst says that src includes dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import extension
from ..functions.storage import written
from . import graph as g

# Suffixes of headers and of sources.
HEADERS = (".h", ".hpp", ".hxx", ".hh", ".inl", ".ipp")
SOURCES = (".c", ".cc", ".cpp", ".cxx", ".m", ".mm")
#: working days a month, builds a day, and the months that commit counts are taken to span
DAYS, BUILDS, MONTHS = 22, 10, 12


def is_header(path: str) -> Column:
    return extension(path).isin(*HEADERS)


def is_source(path: str) -> Column:
    return extension(path).isin(*SOURCES)


def include_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, is_system), edges(src, dst, weight)) of rows(unit, includer, included, is_system).

    An edge weighs as many units as it occurs in; a file counts as system if all inclusions of it say so, and one that none includes does not."""
    edges = rows.groupBy(F.col("includer").alias("src"), F.col("included").alias("dst")).agg(F.countDistinct("unit").alias("weight"))
    flags = rows.groupBy(F.col("included").alias("node")).agg(F.bool_and(F.coalesce("is_system", F.lit(False))).alias("is_system"))
    every = rows.select(F.explode(F.array("includer", "included")).alias("node")).distinct()
    return every.join(flags, "node", "left").select("node", F.coalesce("is_system", F.lit(False)).alias("is_system")), edges


def without_system(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = nodes.where("not is_system")
    keep = lambda c: own.select(F.col("node").alias(c))
    return own, edges.join(keep("src"), "src", "left_semi").join(keep("dst"), "dst", "left_semi").select(*edges.columns)


def fan(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, direct_fan_in, direct_fan_out, transitive_fan_in, is_header); the transitive count is -1 for what is no header."""
    users = pairs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("users"))
    out = g.degrees(nodes, edges).join(users, "node", "left")
    header = is_header("node")
    return out.select("node", F.col("in_degree").alias("direct_fan_in"), F.col("out_degree").alias("direct_fan_out"), F.when(header, F.coalesce("users", F.lit(0))).otherwise(-1).alias("transitive_fan_in"), header.alias("is_header"))


def impact(fans: DataFrame, headers: DataFrame, churn: DataFrame) -> DataFrame:
    """(node, transitive_fan_in, sloc, source_size_bytes, n_commits, impact_score, direct_fan_in) of the headers; headers(node, sloc, source_size_bytes), churn(node, n_commits)."""
    rows = fans.where("is_header").join(headers.select("node", "sloc", "source_size_bytes"), "node", "left").join(churn.select("node", "n_commits"), "node", "left").na.fill(0, ["sloc", "source_size_bytes", "n_commits"])
    return rows.select("node", "transitive_fan_in", "sloc", "source_size_bytes", "n_commits", (F.col("transitive_fan_in") * F.col("source_size_bytes") * (1 + F.col("n_commits"))).alias("impact_score"), "direct_fan_in")


def owner_churn(headers: DataFrame, files: DataFrame) -> DataFrame:
    """(node, n_commits): the most commits of any file of the target that owns the header; headers(node, target), files(target, commits)."""
    most = files.groupBy("target").agg(F.max("commits").alias("n_commits"))
    return headers.select("node", "target").join(most, "target", "left").select("node", F.coalesce("n_commits", F.lit(0)).alias("n_commits"))


def hot_list(nodes: DataFrame, edges: DataFrame, headers: DataFrame, files: DataFrame, exclude_system: bool = True, scope: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Headers by impact, the greatest first: churn is that of the owning target; a scope(target) narrows what is shown, not what is counted."""
    pairs = g.closure(edges) if pairs is None else pairs
    rows = impact(fan(nodes, edges, pairs), headers, owner_churn(headers, files)).join(headers.select("node", "target"), "node", "left")
    if exclude_system:
        rows = rows.join(nodes.where("is_system").select("node"), "node", "left_anti")
    if scope is not None:
        rows = rows.join(scope.select("target").distinct(), "target", "left_semi")
    return rows.orderBy(F.desc("impact_score"), "node")


def header_rank(nodes: DataFrame, edges: DataFrame, exclude_system: bool = True, **how) -> DataFrame:
    """(node, rank) of files by the inclusions that lead to them, weighted by units; system files left out with their edges."""
    if exclude_system:
        nodes, edges = without_system(nodes, edges)
    return g.pagerank(nodes, edges, weight="weight", **how)


def amplification(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, bytes_of: DataFrame | None = None) -> DataFrame:
    """(node, direct_includes, transitive_includes, amplification_ratio) of sources that include something; with bytes_of(node, preprocessed_bytes), those too."""
    far = pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("transitive_includes"))
    near = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("direct_includes"))
    out = nodes.where(is_source("node")).select("node").join(near, "node").join(far, "node", "left").na.fill(0)
    out = out.withColumn("amplification_ratio", F.col("transitive_includes") / F.col("direct_includes"))
    return out if bytes_of is None else out.join(bytes_of.select("node", "preprocessed_bytes"), "node", "left")


def header_owners(rows: DataFrame, files: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, target, sloc, source_size_bytes, is_system) of every included file and every header that includes.

    The owner is the target of the file itself, or that of the longest directory with files of one; system files have none and no size.
    files(path, target), sizes(path, sloc, source_size_bytes)."""
    included = rows.groupBy(F.col("included").alias("node")).agg(F.bool_and(F.coalesce("is_system", F.lit(False))).alias("is_system"))
    more = rows.where(extension("includer").isin(*HEADERS, ".inc", ".tpp")).select(F.col("includer").alias("node")).distinct().join(included, "node", "left_anti").withColumn("is_system", F.lit(False))
    every = included.unionByName(more)
    exact = files.groupBy(F.col("path").alias("node")).agg(F.min("target").alias("exact"))
    parts = lambda c: F.slice(F.split(c, "/"), 1, F.size(F.split(c, "/")) - 1)
    # a directory belongs to the target of its first file; a header looks its own directories up, the deepest counts
    folders = files.select(F.array_join(parts("path"), "/").alias("dir"), "path", "target").groupBy("dir").agg(F.min_by("target", "path").alias("by_dir"))
    up = every.select("node", F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts("node")), F.lit(1)))).alias("k")).withColumn("dir", F.array_join(F.slice(parts("node"), F.lit(1), F.col("k")), "/"))
    near = up.join(folders, "dir").groupBy("node").agg(F.max_by("by_dir", "k").alias("near"))
    out = every.join(exact, "node", "left").join(near, "node", "left").join(sizes.select(F.col("path").alias("node"), "sloc", "source_size_bytes").dropDuplicates(["node"]), "node", "left")
    own = ~F.col("is_system")
    size = lambda c: F.when(own, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    return out.select("node", F.when(own, F.coalesce("exact", "near")).alias("target"), size("sloc"), size("source_size_bytes"), "is_system")


def pch_candidates(files: DataFrame, pairs: DataFrame, headers: DataFrame, churn: DataFrame, top: int = 0) -> DataFrame:
    """(target, node, users, coverage, size, commits, score) of the headers that more than one file of a target reaches, all targets at once.

    files(target, node), headers(node, source_size_bytes), churn(node, n_commits).  The score is coverage times
    size over the largest size times one less commits over the most commits, both over the
    target's candidates and 1 where they are 0; top, if over 0, keeps so many of a target, ties by name."""
    used = files.select("target", F.col("node").alias("src")).distinct().join(pairs, "src").groupBy("target", F.col("dst").alias("node")).agg(F.count("*").alias("users")).where("users > 1")
    total = files.groupBy("target").agg(F.countDistinct("node").alias("files"))
    rows = used.where(is_header("node")).join(total, "target").join(headers.select("node", F.col("source_size_bytes").alias("size")), "node", "left").join(churn.select("node", F.col("n_commits").alias("commits")), "node", "left").na.fill(0, ["size", "commits"])
    w = Window.partitionBy("target")
    most = lambda c: F.when(F.max(c).over(w) > 0, F.max(c).over(w)).otherwise(1)
    rows = rows.withColumn("coverage", F.col("users") / F.col("files"))
    rows = rows.withColumn("score", F.col("coverage") * F.col("size") / most("size") * (1 - F.col("commits") / most("commits")))
    if top > 0:
        rows = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "node"))).where(F.col("place") <= top)
    return rows.select("target", "node", "users", "coverage", "size", "commits", "score")


def pch_impact(chosen: DataFrame, files: DataFrame, pairs: DataFrame, headers: DataFrame, churn: DataFrame, builds: int = BUILDS) -> DataFrame:
    """What precompiling the chosen(target, node) headers would save each target, one row each.

    files(target, node, preprocessed_bytes, compile_time_ms); a header's bytes are saved in each file that reaches it.
    Targets without chosen headers save nothing and are not_recommended."""
    total = files.groupBy("target").agg(F.count("*").alias("source_file_count"), F.coalesce(F.sum("preprocessed_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("compile_time_ms"), F.lit(0)).alias("ms"))
    size = headers.select("node", F.col("source_size_bytes").alias("size"))
    one = chosen.select("target", "node").distinct().join(size, "node", "left").join(churn.select("node", F.col("n_commits").alias("commits")), "node", "left").na.fill(0, ["size", "commits"])
    by_header = one.groupBy("target").agg(F.count("*").alias("headers"), F.sum("size").alias("pch_bytes"), F.sum(F.col("commits") / MONTHS).alias("rebuilds"), F.count_if(F.col("commits") > 5).alias("risks"))
    saved = files.select("target", F.col("node").alias("src")).join(pairs, "src").join(one.select("target", F.col("node").alias("dst"), "size"), ["target", "dst"]).groupBy("target").agg(F.sum("size").alias("saved"))
    rows = total.join(by_header, "target", "left").join(saved, "target", "left").na.fill(0, ["headers", "pch_bytes", "rebuilds", "risks", "saved"])
    whole = F.when(F.col("bytes") == 0, 1).otherwise(F.col("bytes"))
    per_byte = F.when(F.col("ms") > 0, F.col("ms") / whole).otherwise(0.0)  # milliseconds
    rows = rows.withColumns({"reduction": F.col("saved") / whole, "time_saved": F.col("saved") * per_byte, "rebuild_cost": F.col("pch_bytes") * per_byte})
    advice = F.when(F.col("headers") == 0, "not_recommended").when((F.col("reduction") > 0.2) & (F.col("risks") == 0), "recommended").when((F.col("reduction") > 0.1) | (F.col("risks") <= 2), "marginal").otherwise("not_recommended")
    return rows.select(
        "target", F.col("headers").alias("pch_header_count"), "source_file_count", F.col("saved").cast("long").alias("total_preprocessed_bytes_saved"), F.col("reduction").alias("preprocessed_reduction_fraction"),
        F.col("time_saved").alias("estimated_compile_time_saved_ms"), F.col("rebuild_cost").alias("estimated_pch_rebuild_cost_ms"), F.col("rebuilds").cast("double").alias("pch_rebuild_frequency_per_month"),
        (F.col("time_saved") * (builds * DAYS) - F.col("rebuild_cost") * F.col("rebuilds")).alias("net_monthly_savings_ms"), F.col("risks").alias("risk_header_count"), advice.alias("recommendation"),
    )


def pch_opportunities(files: DataFrame, pairs: DataFrame, headers: DataFrame, churn: DataFrame, top: int = 15, least_files: int = 3) -> DataFrame:
    """Targets of least_files files or more with what their best headers would save, in one plan for all of them."""
    large = files.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") >= least_files).select("target")
    files = files.join(large, "target", "left_semi")
    chosen = written(pch_candidates(files, pairs, headers, churn, top).select("target", "node"), "chosen")
    now = files.groupBy("target").agg(F.coalesce(F.sum("compile_time_ms"), F.lit(0)).alias("current_compile_time_ms"))
    out = pch_impact(chosen, files, pairs, headers, churn).join(now, "target")
    return out.select("target", "source_file_count", "current_compile_time_ms", F.col("estimated_compile_time_saved_ms").alias("estimated_savings_ms"), F.coalesce(F.try_divide("estimated_compile_time_saved_ms", "current_compile_time_ms"), F.lit(0.0)).alias("savings_fraction"), "pch_header_count", "risk_header_count", "recommendation")


def leaders(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """(side, place, node, degree): the files with the highest in- and out-degrees, ties by name."""
    d = g.degrees(nodes, edges)
    side = lambda name, c: d.orderBy(F.desc(c), "node").limit(top).select(F.lit(name).alias("side"), "node", F.col(c).alias("degree"))
    both = side("in", "in_degree").unionByName(side("out", "out_degree"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("degree"), "node")))
