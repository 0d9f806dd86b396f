"""Node and edge tables of the graphs that are exported, missing values filled; sources.gexf writes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .consolidate import filled, origin
from .history import keep_one

#: what a target's own table gives to its node, and in which unit
TARGET_UNITS = {"link_time_s": ("link_time_ms", 1000.0), "codegen_time_s": ("codegen_time_ms", 1000.0), "preprocessed_mb": ("preprocessed_bytes_total", 1e6)}
TARGET_PLAIN = {"file_count": "file_count", "code_lines": "code_lines_total", "git_commit_count": "git_commit_count_total", "git_churn": "git_churn_total"}


def _or(df: DataFrame, name: str, kind: str, otherwise=None) -> Column:
    """A column, or what stands for it where the frame has none."""
    return F.coalesce(F.col(name).cast(kind), F.lit(otherwise).cast(kind)) if name in df.columns else F.lit(otherwise).cast(kind)


def _first(df: DataFrame, key: str = "node") -> DataFrame:
    """One row of each key: the least by its other columns."""
    others = [f.name for f in df.schema.fields if f.name != key and f.dataType.typeName() not in ("map",)]
    return keep_one(df, [key], others, last=False) if others else df.distinct()


def dependency_nodes(targets: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """The 29 attributes of each target: its own figures, and those of parts(node, ...), of which layer, community, centrality, critical path, ownership and module are told by their columns.

    A target's compile time is its own table's, or else its whole build time; without layer or community it has -1."""
    t = reduce(lambda out, p: out.join(_first(p), "node", "left"), parts, targets)
    n = targets.agg(F.count("*").alias("whole"))
    t = t.crossJoin(F.broadcast(n))  # one row
    total = _or(t, "total_build_time_ms", "double", 0.0) / 1000
    compile_s = F.coalesce(F.col("compile_time_sum_ms").cast("double") / 1000, total) if "compile_time_sum_ms" in t.columns else total
    out = {
        "label": F.col("node").cast("string"), "target_type": _or(t, "target_type", "string", "unknown"), "source_directory": _or(t, "source_directory", "string", ""),
        "module": _or(t, "module", "string", "unassigned"), "module_category": _or(t, "module_category", "string", "unknown"), "team": _or(t, "owning_team", "string", "unknown"),
        "ownership_hhi": _or(t, "ownership_hhi", "double", 0.0), "cross_team_fraction": _or(t, "cross_team_fraction", "double", 0.0), "contributor_count": _or(t, "contributor_count", "long", 0),
        "compile_time_s": compile_s, "total_build_time_s": total,
        **{k: _or(t, c, "double", 0.0) / unit for k, (c, unit) in TARGET_UNITS.items()}, **{k: _or(t, c, "long", 0) for k, c in TARGET_PLAIN.items()}, "codegen_ratio": _or(t, "codegen_ratio", "double", 0.0),
        "layer": _or(t, "layer", "long", -1), "community": _or(t, "community", "long", -1), "betweenness": _or(t, "betweenness", "double", 0.0), "pagerank": _or(t, "pagerank", "double", 0.0),
        "in_degree": _or(t, "in_degree", "long", 0), "out_degree": _or(t, "out_degree", "long", 0), "transitive_dep_count": _or(t, "transitive_dependencies", "long", 0),
        "transitive_dep_fraction": _or(t, "transitive_dependencies", "double", 0.0) / F.col("whole"), "on_critical_path": _or(t, "critical", "boolean", False), "slack_s": _or(t, "slack", "double", 0.0) / 1000,
    }
    return filled(t.select("node", *(c.alias(k) for k, c in out.items())))


def _sides(edges: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    for end, mark in (("src", "a"), ("dst", "b")):
        edges = edges.join(nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{mark}") for c in columns)), end, "left")
    return edges


def _differ(name: str) -> Column:
    return ~F.col(f"{name}_a").eqNullSafe(F.col(f"{name}_b"))


def dependency_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The 7 attributes of each edge(src, dst, visibility) between nodes as dependency_nodes gives them; a layer that is not above the needed one's is a violation."""
    e = _sides(edges, nodes, ["community", "layer", "module", "team"])
    layer = lambda m: F.when(F.col(f"layer_{m}") < 0, 0).otherwise(F.col(f"layer_{m}"))
    out = e.select(
        "src", "dst", F.col("visibility").alias("cmake_visibility"), _differ("community").alias("is_cross_community"), (layer("a") <= layer("b")).alias("is_layer_violation"), _differ("module").alias("is_cross_module"),
        F.col("module_a").alias("source_module"), F.col("module_b").alias("dest_module"), _differ("team").alias("is_cross_team"),
    )
    return filled(out)


def module_nodes(metrics: DataFrame, configs: DataFrame | None = None, owners: DataFrame | None = None) -> DataFrame:
    """Attributes of each module: its figures as module_metrics gives them, and the part of the build it needs by configs(module, build_fraction)."""
    t = metrics.drop("build_fraction").withColumnRenamed("module", "node")
    for more in (configs, owners):
        t = t.join(_first(more.withColumnRenamed("module", "node")), "node", "left") if more is not None else t
    return filled(t.select(
        "node", F.col("node").alias("label"), "category", _or(t, "owning_team", "string", "unknown").alias("owning_team"), "target_count", (F.col("total_build_time_ms") / 1000.0).alias("total_build_time_s"), "total_sloc", "file_count", "codegen_ratio",
        "self_containment", "internal_dep_count", "external_dep_count", "critical_path_target_count", _or(t, "build_fraction", "double", 0.0).alias("build_fraction"),
    ))


def module_edges(edges: DataFrame) -> DataFrame:
    return filled(edges.select(F.col("module_a").alias("src"), F.col("module_b").alias("dst"), "weight", "public_count", "private_count", "is_cross_category", "is_bidirectional"))


def include_nodes(nodes: DataFrame, edges: DataFrame, headers: DataFrame, parts: list[DataFrame], files: DataFrame, churn: DataFrame, owners: DataFrame, exclude_system: bool = True) -> DataFrame:
    """Attributes of each file of the inclusion graph.

    headers(node, target, sloc, source_size_bytes); parts: frames by node with rank, impact, amplification_ratio or pch_score;
    files(node, is_generated, compile_time_ms, preprocessed_bytes, expansion_ratio); churn(node, n_commits, git_churn); owners(target, module, team)."""
    from .includes import is_header

    t = nodes.where("not is_system") if exclude_system else nodes
    fans = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("direct_fan_out"))
    for part in (headers.withColumn("in_headers", F.lit(True)), *parts, files.withColumn("in_files", F.lit(True)), churn, fans):
        t = t.join(_first(part), "node", "left")
    t = t.join(_first(owners, "target"), "target", "left")
    return filled(t.select(
        "node", F.substring_index("node", "/", -1).alias("label"), F.col("node").alias("full_path"), is_header("node").alias("is_header"), _or(t, "sloc", "long", 0).alias("sloc"), _or(t, "source_size_bytes", "long", 0).alias("source_size_bytes"),
        F.coalesce("target", F.lit("unknown")).alias("cmake_target"), _or(t, "module", "string", "unassigned").alias("module"), _or(t, "team", "string", "unknown").alias("team"), F.when(F.col("in_files"), origin(F.col("is_generated"))).otherwise("unknown").alias("origin"),
        _or(t, "rank", "double", 0.0).alias("pagerank"), _or(t, "impact_score", "double", 0.0).alias("impact_score"), _or(t, "direct_fan_in", "long", 0).alias("direct_fan_in"), _or(t, "transitive_fan_in", "long", 0).alias("transitive_fan_in"),
        _or(t, "direct_fan_out", "long", 0).alias("direct_fan_out"), _or(t, "n_commits", "long", 0).alias("git_commits"), _or(t, "git_churn", "long", 0).alias("git_churn"), _or(t, "compile_time_ms", "long", 0).alias("compile_time_ms"),
        _or(t, "preprocessed_bytes", "long", 0).alias("preprocessed_bytes"), _or(t, "expansion_ratio", "double", 0.0).alias("expansion_ratio"), _or(t, "amplification_ratio", "double", 0.0).alias("amplification_ratio"), _or(t, "pch_score", "double", 0.0).alias("pch_candidate_score"),
    ))


def include_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attributes of the inclusions(src, dst, weight) between nodes as include_nodes gives them; others are left out."""
    here = lambda c: nodes.select(F.col("node").alias(c))
    e = _sides(edges.join(here("src"), "src", "left_semi").join(here("dst"), "dst", "left_semi"), nodes, ["cmake_target", "module"])
    return filled(e.select("src", "dst", "weight", _differ("cmake_target").alias("is_cross_target"), _differ("module").alias("is_cross_module"), F.col("module_a").alias("source_module"), F.col("module_b").alias("dest_module")))


def cochange_graph(pairs: DataFrame, targets: DataFrame, parts: list[DataFrame], structure: DataFrame, least_pmi: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the pairs(item_a, item_b, together, pmi, jaccard) with a PMI of least_pmi or more.

    targets(node, target_type, total_build_time_ms, codegen_ratio, code_lines_total); parts: frames by node with churn, community, module, owning_team;
    structure(src, dst): an edge either way makes a pair structural."""
    kept = pairs.where(F.col("pmi") >= least_pmi)
    t = kept.select(F.explode(F.array("item_a", "item_b")).alias("node")).distinct()
    for part in (targets, *parts):
        t = t.join(_first(part), "node", "left")
    nodes = filled(t.select(
        "node", F.col("node").cast("string").alias("label"), _or(t, "target_type", "string", "unknown").alias("target_type"), (_or(t, "total_build_time_ms", "double", 0.0) / 1000).alias("total_build_time_s"), _or(t, "codegen_ratio", "double", 0.0).alias("codegen_ratio"),
        _or(t, "code_lines_total", "long", 0).alias("code_lines"), _or(t, "n_commits", "long", 0).alias("n_commits"), _or(t, "total_churn", "long", 0).alias("total_churn"), _or(t, "contributor_count", "long", 0).alias("contributor_count"),
        _or(t, "community", "long", -1).alias("structural_community"), _or(t, "module", "string", "unassigned").alias("module"), _or(t, "owning_team", "string", "unknown").alias("team"), _or(t, "ownership_hhi", "double", 0.0).alias("ownership_hhi"),
    ))
    both = structure.select(F.col("src").alias("item_a"), F.col("dst").alias("item_b")).union(structure.select("dst", "src")).distinct().withColumn("has", F.lit(True))
    e = kept.join(both, ["item_a", "item_b"], "left").withColumnsRenamed({"item_a": "src", "item_b": "dst"})
    e = _sides(e, nodes, ["module", "team"])
    edges = filled(e.select("src", "dst", F.col("together").alias("cochange_count"), "pmi", "jaccard", _differ("module").alias("is_cross_module"), _differ("team").alias("is_cross_team"), F.coalesce("has", F.lit(False)).alias("has_structural_edge"), F.col("module_a").alias("source_module"), F.col("module_b").alias("dest_module")))
    return nodes, edges
