"""Raw measurements into the core tables: one row for each file, and one for each target."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.storage import written
from . import graph as g
from .history import keep_one

# What the build system calls its kinds of targets, and what the tables call them.
TARGET_TYPES = {
    "EXECUTABLE": "executable", "STATIC_LIBRARY": "static_library", "SHARED_LIBRARY": "shared_library", "MODULE_LIBRARY": "module_library",
    "OBJECT_LIBRARY": "object_library", "INTERFACE_LIBRARY": "interface_library", "UTILITY": "custom_target",
}
# The phases of each compiler's report that fill the time columns.
PHASES = {
    "gcc": {"parse": "phase parsing", "template_instantiation": "phase lang. deferred", "codegen": "phase opt and generate", "optimization": "phase opt and generate"},
    "clang": {"parse": "frontend", "codegen": "codegen", "optimization": "optimizer"},
}
COLUMNS = {"parse": "compiler_parse_time_ms", "template_instantiation": "compiler_template_instantiation_ms", "codegen": "compiler_codegen_time_ms", "optimization": "compiler_optimization_time_ms"}


def target_type(raw: Column) -> Column:
    """The tables' name of a target's kind; unknown if there is none."""
    names = F.create_map(*(F.lit(x) for pair in TARGET_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, raw), F.lit("unknown"))


def phase_columns(reports: DataFrame, report: str = "report") -> DataFrame:
    """reports with its report (as timing_report gives it) as time columns in milliseconds; a phase that a compiler does not tell apart is 0."""
    wall = lambda name: F.coalesce(F.try_element_at(F.col(f"{report}.phases"), F.lit(name))["wall"], F.lit(0.0)) * 1000
    clang = F.col(f"{report}.compiler") == "clang"
    out = {column: F.when(clang, wall(PHASES["clang"][p]) if p in PHASES["clang"] else F.lit(0.0)).otherwise(wall(PHASES["gcc"][p])) for p, column in COLUMNS.items()}
    return reports.withColumns(out).withColumn("compiler_total_time_ms", F.col(f"{report}.wall_total_ms").cast("double"))


def spine(files: DataFrame, parts: list[tuple[DataFrame, list[str]]], key: str = "source_file", order: str = "ord") -> DataFrame:
    """files with the columns of each part(key, order, ...), null where it has no row; of several rows of a file the last in order counts, on either side."""
    last = lambda df: keep_one(df, [key], [order]).drop(order) if order in df.columns else df.dropDuplicates([key])
    return reduce(lambda out, part: out.join(last(part[0]).select(key, *part[1]), key, "left"), parts, last(files))


def derived_ratios(files: DataFrame) -> DataFrame:
    """files with the growth by preprocessing, lines compiled a second, and object bytes a line; null over 0."""
    return files.withColumns({
        "expansion_ratio": ratio("preprocessed_bytes", "source_size_bytes"),
        "compile_rate_lines_per_sec": ratio("code_lines", F.col("compile_time_ms") / 1000),
        "object_efficiency": ratio("object_size_bytes", "code_lines"),
    })


def origin(generated: Column) -> Column:
    return F.when(F.coalesce(generated, F.lit(False)), "GENERATED").otherwise("HANDWRITTEN")


def file_filters(files: DataFrame, exclude_generated: bool = False, languages=(), paths=(), exclude_paths=()) -> DataFrame:
    """files that are not generated, of one of the languages, match any of the path patterns and none of the excluded ones; an empty option holds for all."""
    match = lambda patterns: reduce(lambda a, b: a | b, (F.col("source_file").rlike("^" + fnmatch.translate(p)) for p in patterns))
    if exclude_generated:
        files = files.where(~F.coalesce("is_generated", F.lit(False)))
    if languages:
        files = files.where(F.col("language").isin(list(languages)))
    if paths:
        files = files.where(match(paths))
    return files.where(~match(exclude_paths)) if exclude_paths else files


def target_of_changes(changes: DataFrame, files: DataFrame) -> DataFrame:
    """changes(path) with the target of the file of that path, or else of the first file, by path, of that name; null if there is none."""
    name = lambda c: F.substring_index(c, "/", -1)
    exact = files.groupBy(F.col("source_file").alias("path")).agg(F.min("cmake_target").alias("exact"))
    named = files.where(F.col("source_file").contains("/")).groupBy(name(F.col("source_file")).alias("name")).agg(F.min_by("cmake_target", "source_file").alias("named"))
    out = changes.withColumn("name", name(F.col("path"))).join(exact, "path", "left").join(named, "name", "left")
    return out.withColumn("cmake_target", F.coalesce("exact", "named")).drop("exact", "named", "name")


def _sum(c: Column, kind: str = "long") -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(kind)


def file_rollup(files: DataFrame) -> DataFrame:
    """The 34 figures of each target over its files.  Missing values count as none; history counts authored files alone."""
    col, made = F.col, F.coalesce("is_generated", F.lit(False))
    ms, own = col("compile_time_ms"), lambda c: F.when(~F.coalesce("is_generated", F.lit(False)), F.col(c))
    theirs = lambda c: F.when(F.coalesce("is_generated", F.lit(False)), F.col(c))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    top = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long")
    w = Window.partitionBy("cmake_target")
    level = F.avg(own("git_commit_count")).over(w) + F.coalesce(F.stddev_samp(own("git_commit_count")).over(w), F.lit(0.0))
    rows = files.withColumn("hot", own("git_commit_count") > level)
    floats = {"compiler_parse_time_sum_ms": "compiler_parse_time_ms", "compiler_template_time_sum_ms": "compiler_template_instantiation_ms", "compiler_codegen_phase_sum_ms": "compiler_codegen_time_ms", "compiler_optimization_time_sum_ms": "compiler_optimization_time_ms", "compiler_total_usr_sum_ms": "compiler_total_usr_ms", "compiler_total_sys_sum_ms": "compiler_total_sys_ms"}
    return rows.groupBy("cmake_target").agg(
        F.count("*").alias("file_count"), F.count_if(made).alias("codegen_file_count"), F.count_if(~made).alias("authored_file_count"), (F.count_if(made) / F.count("*")).alias("codegen_ratio"),
        _sum(col("code_lines")).alias("code_lines_total"), _sum(own("code_lines")).alias("code_lines_authored"), _sum(theirs("code_lines")).alias("code_lines_generated"),
        _sum(ms).alias("compile_time_sum_ms"), top(ms).alias("compile_time_max_ms"), zero(F.avg(ms)).alias("compile_time_mean_ms"), zero(F.median(ms)).alias("compile_time_median_ms"),
        zero(F.stddev_samp(ms)).alias("compile_time_std_ms"), zero(F.percentile(ms, 0.9)).alias("compile_time_p90_ms"), zero(F.percentile(ms, 0.99)).alias("compile_time_p99_ms"),
        _sum(own("compile_time_ms")).alias("authored_compile_time_sum_ms"), top(own("compile_time_ms")).alias("authored_compile_time_max_ms"),
        _sum(theirs("compile_time_ms")).alias("codegen_compile_time_sum_ms"), top(theirs("compile_time_ms")).alias("codegen_compile_time_max_ms"),
        *(_sum(col(c), "double").alias(name) for name, c in floats.items()),
        top(col("header_max_depth")).alias("header_depth_max"), zero(F.avg("header_max_depth")).alias("header_depth_mean"), _sum(col("unique_headers")).alias("unique_headers_total"), _sum(col("total_includes")).alias("total_includes_sum"),
        _sum(col("preprocessed_bytes")).alias("preprocessed_bytes_total"), zero(F.avg("preprocessed_bytes")).alias("preprocessed_bytes_mean"), zero(F.avg("expansion_ratio")).alias("expansion_ratio_mean"),
        _sum(col("object_size_bytes")).alias("object_size_total_bytes"), F.count("object_size_bytes").alias("object_file_count"),
        _sum(own("git_commit_count")).alias("git_commit_count_total"), _sum(own("git_churn")).alias("git_churn_total"), top(own("git_distinct_authors")).alias("git_distinct_authors"), F.count_if("hot").alias("git_hotspot_file_count"),
    )


def step_totals(steps: DataFrame) -> DataFrame:
    """(cmake_target, codegen_time_ms, archive_time_ms, link_time_ms) of steps(target, step_type, duration_ms)."""
    of = lambda k: _sum(F.when(F.col("step_type") == k, F.col("duration_ms"))).alias(f"{k}_time_ms")
    return steps.where("target <> ''").groupBy(F.col("target").alias("cmake_target")).agg(of("codegen"), of("archive"), of("link"))


def file_lists(files: DataFrame) -> DataFrame:
    """(cmake_target, source_files, generated_files): JSON lists of paths, in their order."""
    made = F.when(F.coalesce("is_generated", F.lit(False)), F.col("source_file"))
    return files.groupBy("cmake_target").agg(F.to_json(F.sort_array(F.collect_list("source_file"))).alias("source_files"), F.to_json(F.sort_array(F.collect_list(made))).alias("generated_files"))


def graph_counters(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependency counts of each target over edges(src, dst, is_direct) of all kinds, edges to unknown targets left out.

    Direct counts flagged neighbours; transitive dependencies are all reachable ones less the direct;
    transitive dependants count all that reach the target, the direct ones too."""
    nodes = targets.select(F.col("cmake_target").alias("node")).distinct()
    known = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "is_direct")
    direct = known.where("is_direct").select("src", "dst").distinct()
    pairs = g.closure(known)
    count = lambda df, by, name: df.groupBy(F.col(by).alias("node")).agg(F.count("*").alias(name))
    out = nodes
    for part in (count(direct, "src", "direct_dependency_count"), count(pairs, "src", "total_dependency_count"), count(direct, "dst", "direct_dependant_count"), count(pairs, "dst", "transitive_dependant_count")):
        out = out.join(part, "node", "left")
    out = out.na.fill(0)
    return out.select(F.col("node").alias("cmake_target"), "direct_dependency_count", (F.col("total_dependency_count") - F.col("direct_dependency_count")).alias("transitive_dependency_count"), "total_dependency_count", "direct_dependant_count", "transitive_dependant_count", F.col("direct_dependant_count").alias("fan_in"), F.col("direct_dependency_count").alias("fan_out"))


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): the longest way from a root; 0 for all if the graph has a cycle."""
    try:
        return written(g.longest(nodes, g.reverse(edges)).select("node", F.col("level").cast("long").alias("depth")), "depths")
    except Exception as e:  # the cycle is found where the chains are followed, in a task or here
        if "has a cycle" not in str(e):
            raise
        return nodes.select("node", F.lit(0).cast("long").alias("depth"))


def target_metrics(targets: DataFrame, files: DataFrame, steps: DataFrame, edges: DataFrame, top: str = "") -> DataFrame:
    """One row for each of targets(cmake_target, raw_type, source_dir): file figures, step times, graph counters, file lists.

    A target without files has zeros and empty lists; the total build time is that of its compilations,
    code generation, archiving and linking.  Depth and betweenness are over edges of all kinds; what a
    target adds to the critical path is not known here and 0."""
    col, zero = F.col, lambda c: F.coalesce(c, F.lit(0))
    roll, times, lists, counts = file_rollup(files), step_totals(steps), file_lists(files), graph_counters(targets, edges)
    nodes = targets.select(col("cmake_target").alias("node")).distinct()
    known = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").distinct()
    placed = depths(nodes, known).join(g.betweenness(nodes, known), "node").select(col("node").alias("cmake_target"), col("depth").alias("topological_depth"), col("betweenness").alias("betweenness_centrality"))
    counts = counts.join(placed, "cmake_target", "left")
    out = targets.join(roll, "cmake_target", "left").join(times, "cmake_target", "left").join(counts, "cmake_target", "left").na.fill(0).join(lists, "cmake_target", "left")
    out = out.na.fill("[]", ["source_files", "generated_files"])
    inside = F.startswith(col("source_dir"), F.lit(top.rstrip("/") + "/"))
    deep = F.when(inside, F.size(F.split(F.substring(col("source_dir"), len(top.rstrip("/")) + 2, 1 << 20), "/"))).otherwise(0)
    return out.withColumns({
        "target_type": target_type(col("raw_type")), "directory_depth": deep.cast("long"), "critical_path_contribution_ms": F.lit(0).cast("long"),
        "total_build_time_ms": zero(col("compile_time_sum_ms")) + zero(col("codegen_time_ms")) + zero(col("archive_time_ms")) + zero(col("link_time_ms")),
    }).drop("raw_type")


#: what a missing value of an attribute counts as, by the attribute's name
UNKNOWN = {"module": "unassigned", "source_module": "unassigned", "dest_module": "unassigned", "source_directory": ""}
NUMBERS = ("_ms", "_s", "_count", "_bytes", "_ratio", "_fraction", "_score", "_mb")


def filled(df: DataFrame) -> DataFrame:
    """df with missing values filled by each column's type and name: numbers 0, flags false, names `unknown` or `unassigned`, other texts empty; NaN counts as missing."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f.name)
        if kind in ("double", "float"):
            c = F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))
        elif kind in ("long", "integer", "short", "byte") or kind.startswith("decimal"):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        elif kind == "boolean":
            c = F.coalesce(c, F.lit(False))
        elif kind == "string":
            named = f.name in ("module_category", "team", "owning_team", "cmake_target", "target_type", "cmake_visibility", "origin", "category")
            c = F.coalesce(c, F.lit(UNKNOWN.get(f.name, "unknown" if named else "")))
        out.append(c.alias(f.name))
    return df.select(*out)


def milliseconds(c: Column) -> Column:
    """A duration for people: `1,234 ms (1.23 s)`, or n/a."""
    return F.when(c.isNull(), "n/a").otherwise(F.concat(F.format_number(c.cast("double"), 0), F.lit(" ms ("), F.regexp_replace(F.format_number(c.cast("double") / 1000, 2), ",", ""), F.lit(" s)")))


def summary(target: DataFrame) -> DataFrame:
    """(target, ord, key, value) of each row of a target table: its figures as texts, in their order."""
    plain = ["target_type", "source_directory", "file_count", "authored_file_count", "codegen_file_count"]
    rows = [(c, F.col(c).cast("string")) for c in plain if c in target.columns]
    rows += [("codegen_ratio", F.concat(F.format_number(F.col("codegen_ratio") * 100, 2), F.lit("%")))] if "codegen_ratio" in target.columns else []
    rows += [(c.removesuffix("_ms"), milliseconds(F.col(c))) for c in ("compile_time_sum_ms", "compile_time_max_ms", "compile_time_p99_ms", "link_time_ms", "total_build_time_ms", "compiler_parse_time_sum_ms", "compiler_template_time_sum_ms", "compiler_codegen_phase_sum_ms") if c in target.columns]
    counts = ["code_lines_total", "preprocessed_bytes_total", "object_size_total_bytes", "direct_dependency_count", "transitive_dependency_count", "direct_dependant_count", "transitive_dependant_count", "topological_depth", "git_commit_count_total", "git_churn_total", "git_distinct_authors"]
    rows += [(c, F.col(c).cast("string")) for c in counts if c in target.columns]
    pairs = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), F.coalesce(v, F.lit("n/a")).alias("value")) for i, (k, v) in enumerate(rows)))
    return target.select(F.col("cmake_target").alias("target"), F.explode(pairs).alias("x")).select("target", "x.*")


def neighbours(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, target) -> DataFrame:
    """(relation, node, ms): what a target needs directly, and what depends on it, directly or not; by relation, the longest first."""
    near = lambda a, b, name: edges.where(F.col(a) == target).select(F.col(b).alias("node")).distinct().withColumn("relation", F.lit(name))
    users = near("dst", "src", "direct_dependant")
    far = pairs.where(F.col("dst") == target).select(F.col("src").alias("node")).join(users.select("node"), "node", "left_anti").withColumn("relation", F.lit("transitive_dependant"))
    rows = near("src", "dst", "direct_dependency").unionByName(users).unionByName(far)
    return rows.join(nodes.select("node", "ms"), "node").select("relation", "node", "ms").orderBy("relation", F.desc("ms"), "node")


def limited(df: DataFrame, limit: int = 0) -> DataFrame:
    """The first rows; 0 asks for all."""
    return df.limit(limit) if limit > 0 else df


def emit(df: DataFrame, form: str = "table", limit: int = 20) -> str:
    """The first rows as a report: a table, CSV or JSON lines; a limit of 0 writes all, a partition at a time."""
    import csv
    import io
    import json

    rows, out = (r.asDict(recursive=True) for r in limited(df, limit).toLocalIterator()), io.StringIO()
    if form == "json":
        for r in rows:
            out.write(json.dumps(r, default=str) + "\n")
    elif form == "csv":
        writer = csv.DictWriter(out, df.columns)
        writer.writeheader()
        writer.writerows(rows)
    elif form == "table":
        cells = [df.columns, *([("" if r[c] is None else str(r[c])) for c in df.columns] for r in rows)]
        width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
        for r in cells:
            out.write("  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() + "\n")
    else:
        raise ValueError(f"{form!r} is no form of report: table, csv or json")
    return out.getvalue()


def load_summary(steps: DataFrame, key: str = "target") -> DataFrame:
    """(key, value) rows: how many of the steps name a target, their share in percent, and the steps' time."""
    named = F.count_if(F.coalesce(F.col(key), F.lit("")) != "")
    one = steps.agg(F.count("*").cast("double").alias("steps"), named.cast("double").alias("named"), F.coalesce(F.try_divide(named * 100.0, F.count("*")), F.lit(0.0)).alias("coverage_pct"), F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("double").alias("time_ms"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in one.columns))).alias("x")).select("x.*")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each value of each column occurs."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, low, q1, median, q3, high, constant) of each number column, nulls left out; constant: no more than one value."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*").where("v is not null")
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return long.groupBy("column").agg(F.min("v").alias("low"), q.alias("q"), F.max("v").alias("high")).select("column", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high", (F.col("low") == F.col("high")).alias("constant"))
