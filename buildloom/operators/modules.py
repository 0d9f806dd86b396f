"""Modules and communities over a dependency graph: sizes, coupling, agreement with each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



UNASSIGNED = "Unassigned"


def assigned(nodes: DataFrame, assignments: DataFrame) -> DataFrame:
    """nodes with their module and its category; those without one are Unassigned, of category unknown. assignments(node, module, category)."""
    out = nodes.join(assignments.select("node", "module", "category"), "node", "left")
    return out.withColumns({"category": F.when(F.col("module").isNull(), "unknown").otherwise(F.coalesce("category", F.lit("unknown"))), "module": F.coalesce("module", F.lit(UNASSIGNED))})


def _ends(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """edges with module and category of either end."""
    end = lambda c, s: rows.select(F.col("node").alias(c), F.col("module").alias(f"module_{s}"), F.col("category").alias(f"category_{s}"))
    return edges.join(end("src", "a"), "src").join(end("dst", "b"), "dst")


def module_edges(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(module_a, module_b, weight, public_count, private_count, is_cross_category, is_bidirectional) of edges(src, dst, visibility) between assigned rows.

    Cross-category are edges between two different modules of the domain; an edge of a module with itself is bidirectional."""
    by = _ends(edges, rows).groupBy("module_a", "module_b", "category_a", "category_b").agg(F.count("*").alias("weight"), F.count_if(F.col("visibility") == "PUBLIC").alias("public_count"), F.count_if(F.col("visibility") == "PRIVATE").alias("private_count"))
    back = by.select(F.col("module_b").alias("module_a"), F.col("module_a").alias("module_b"), F.lit(True).alias("back")).distinct()
    cross = (F.col("module_a") != F.col("module_b")) & (F.col("category_a") == "domain") & (F.col("category_b") == "domain")
    out = by.withColumn("is_cross_category", cross).groupBy("module_a", "module_b").agg(*(F.sum(c).alias(c) for c in ("weight", "public_count", "private_count")), F.bool_or("is_cross_category").alias("is_cross_category"))
    return out.join(back, ["module_a", "module_b"], "left").withColumn("is_bidirectional", F.coalesce("back", F.lit(False))).drop("back")


def module_metrics(rows: DataFrame, edges: DataFrame, critical: DataFrame) -> DataFrame:
    """Figures of each module over assigned rows(node, kind, files, lines, ms, compile_ms, link_ms, codegen_ratio, module, category); critical(node).

    A module without dependencies is wholly self-contained."""
    on = rows.join(critical.select("node").distinct().withColumn("critical", F.lit(True)), "node", "left")
    whole = rows.agg(F.count("*").alias("whole"))
    s = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    out = on.groupBy("module").agg(
        F.min("category").alias("category"), F.count("*").alias("target_count"), F.count_if(F.col("kind") == "executable").alias("executable_count"), F.count_if(~F.coalesce(F.col("kind") == "executable", F.lit(False))).alias("library_count"),
        s("files", "file_count"), s("lines", "total_sloc"), s("ms", "total_build_time_ms"), s("compile_ms", "total_compile_time_ms"), s("link_ms", "total_link_time_ms"), F.coalesce(F.avg("codegen_ratio"), F.lit(0.0)).alias("codegen_ratio"),
        F.count_if("critical").alias("critical_path_target_count"),
    )
    e, same = _ends(edges, rows), F.col("module_a") == F.col("module_b")
    own = e.groupBy(F.col("module_a").alias("module")).agg(F.count_if(same).alias("internal_dep_count"), F.count_if(~same).alias("external_dep_count"), F.countDistinct(F.when(~same, F.col("module_b"))).alias("dependency_module_count"))
    users = e.where(~same).groupBy(F.col("module_b").alias("module")).agg(F.countDistinct("module_a").alias("dependant_module_count"))
    out = out.join(own, "module", "left").join(users, "module", "left").na.fill(0, ["internal_dep_count", "external_dep_count", "dependency_module_count", "dependant_module_count"])
    inside = F.coalesce(F.try_divide("internal_dep_count", F.col("internal_dep_count") + F.col("external_dep_count")), F.lit(1.0))
    return out.crossJoin(F.broadcast(whole)).withColumns({"self_containment": inside, "build_fraction": F.col("target_count") / F.col("whole"), "critical_path_fraction": F.col("critical_path_target_count") / F.col("target_count")}).drop("whole")  # one row


def feature_configs(nodes: DataFrame, parts: DataFrame, pairs: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """What each part needs to be built: its own targets and all that these depend on.

    nodes(node, ms), parts(node, part), shared(part): the parts whose targets count as shared core.
    shared_deps counts the outside targets that another part needs too."""
    own = parts.select("part", "node").distinct()
    need = own.join(pairs.withColumnRenamed("src", "node"), "node").select("part", F.col("dst").alias("node")).distinct().join(own, ["part", "node"], "left_anti").withColumn("own", F.lit(False))
    usage = need.groupBy("node").agg((F.count("*") > 1).alias("often"))
    core = parts.join(shared.select("part").distinct(), "part", "left_semi").select("node").distinct().withColumn("core", F.lit(True)) if shared is not None else parts.limit(0).select("node", F.lit(True).alias("core"))
    every = own.withColumn("own", F.lit(True)).unionByName(need.select("part", "node", "own")).join(nodes.select("node", "ms"), "node", "left").join(usage, "node", "left").join(core, "node", "left")
    total = nodes.agg(F.count("*").alias("n"), F.sum("ms").alias("all_ms"))
    out = every.groupBy("part").agg(
        F.count_if("own").alias("own_targets"), F.count_if(~F.col("own")).alias("transitive_deps"), F.count("*").alias("total_build_set"), F.coalesce(F.sum("ms"), F.lit(0)).alias("build_ms"),
        F.count_if(~F.col("own") & F.col("often")).alias("shared_deps"), F.count_if("core").alias("shared_core_targets"),
    ).crossJoin(F.broadcast(total))
    return out.select(
        "part", "own_targets", "transitive_deps", "total_build_set", (F.col("total_build_set") / F.col("n")).alias("build_fraction"), "build_ms", F.coalesce(F.try_divide("build_ms", "all_ms"), F.lit(0.0)).alias("time_fraction"),
        "shared_deps", "shared_core_targets", (F.col("shared_core_targets") / F.col("total_build_set")).alias("shared_core_fraction"),
    )


def quality(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: modularity, share of edges between parts, mean self-containment, and the parts' number and sizes; parts(node, part)."""
    by = parts.groupBy("part").agg(F.count("*").alias("size"))
    e = edges.select("src", "dst").distinct().join(parts.select(F.col("node").alias("src"), F.col("part").alias("a")), "src").join(parts.select(F.col("node").alias("dst"), F.col("part").alias("b")), "dst")
    ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("part"), (F.col("a") == F.col("b")).alias("inside")), F.struct(F.col("b").alias("part"), (F.col("a") == F.col("b")).alias("inside")))).alias("x")).select("x.*")
    degree = ends.groupBy("part").agg(F.count("*").alias("d"), F.count_if("inside").alias("i"))
    rows = by.join(degree, "part", "left").na.fill(0)
    total = e.agg(F.count("*").alias("m"), F.count_if(F.col("a") != F.col("b")).alias("between"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    q = F.sum(F.try_divide(F.col("i") / 2, "m") - F.pow(F.try_divide("d", F.col("m") * 2.0), 2))
    return rows.agg(
        F.coalesce(q, F.lit(0.0)).alias("modularity"), F.coalesce(F.max(F.try_divide("between", "m")), F.lit(0.0)).alias("between_fraction"), F.avg(F.coalesce(F.try_divide("i", "d"), F.lit(1.0))).alias("mean_self_containment"),
        F.count("*").alias("parts"), F.min("size").alias("least"), F.max("size").alias("most"), F.median("size").alias("median"),
    )


def compare_methods(edges: DataFrame, methods: dict[str, DataFrame]) -> DataFrame:
    """The quality of each method's parts(node, part), the highest modularity first."""
    rows = [quality(edges, parts).withColumn("method", F.lit(name)) for name, parts in methods.items()]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("modularity"), "method")


def alignment(communities: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, targets, dominant_community, fraction_in_dominant, communities, fragmented) of modules(node, part) against communities(node, part); targets without either are left out.

    The dominant community holds most of the module, ties by its name; three or more communities make it fragmented."""
    both = modules.select("node", F.col("part").alias("module")).join(communities.select("node", F.col("part").alias("community")), "node").where("module is not null and community is not null")
    n = both.groupBy("module", "community").agg(F.count("*").alias("n"))
    top = n.groupBy("module").agg(F.sum("n").alias("targets"), F.min(F.struct((-F.col("n")).alias("minus"), "community")).alias("top"), F.count("*").alias("communities"))
    return top.select("module", "targets", F.col("top.community").alias("dominant_community"), (-F.col("top.minus") / F.col("targets")).alias("fraction_in_dominant"), "communities", (F.col("communities") >= 3).alias("fragmented"))


def merged_communities(communities: DataFrame, modules: DataFrame, least: int = 3) -> DataFrame:
    """(community, modules): the communities that span so many modules or more."""
    both = modules.select("node", F.col("part").alias("module")).join(communities.select("node", F.col("part").alias("community")), "node")
    return both.groupBy("community").agg(F.countDistinct("module").alias("modules")).where(F.col("modules") >= least)


def neighbourhood_distances(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, distance), a < b: Jaccard distance of the neighbourhoods, each node's own among them, of the pairs that share a node; all others are at 1.

    Pairs are met at the nodes they share, so only those that have one are made."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).union(nodes.select("node", "node")).distinct().toDF("node", "near")
    size = both.groupBy("node").agg(F.count("*").alias("n"))
    pairs = both.select(F.col("node").alias("a"), "near").join(both.select(F.col("node").alias("b"), "near"), "near").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    pairs = pairs.join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    return pairs.select("a", "b", (1 - F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("distance"))


def team_coupling(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(team_a, team_b, edge_count, public_edge_count, target_pairs) of edges(src, dst, visibility) between the teams that own their ends; owners(node, team), ends without a team are left out."""
    own = owners.where("team is not null")
    e = edges.join(own.select(F.col("node").alias("src"), F.col("team").alias("team_a")), "src").join(own.select(F.col("node").alias("dst"), F.col("team").alias("team_b")), "dst")
    return e.groupBy("team_a", "team_b").agg(F.count("*").alias("edge_count"), F.count_if(F.col("visibility") == "PUBLIC").alias("public_edge_count"), F.countDistinct("src", "dst").alias("target_pairs"))


def owner_of(rows: DataFrame, patterns: list[tuple[str, str]], prefixes: DataFrame, column: str) -> DataFrame:
    """rows with the module of the first pattern that matches, or of the longest prefix(prefix, owner); null if neither does."""
    from .metrics import assign_modules, longest_prefix

    out = longest_prefix(rows, column, prefixes)
    return assign_modules(out, column, patterns).withColumn("module", F.coalesce("module", "owner")).drop("owner", "prefix")


def overlaps(rows: DataFrame, patterns: list[tuple[str, str]], column: str) -> DataFrame:
    """(column, modules) of the rows that patterns of more than one module match."""
    from ..functions.columns import glob

    hits = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(glob(column, p), F.lit(m)) for m, p in patterns)))))
    return rows.select(column, hits.alias("modules")).where(F.size("modules") > 1)


def ranked(df: DataFrame, by: str, key: str, top: int) -> DataFrame:
    """The top rows by a figure, ties by key, with their place."""
    return df.orderBy(F.desc_nulls_last(by), key).limit(top).withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), key)))  # top rows alone


