"""Queries of consolidation: file spine, target tables, reports, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import six_places
from ..operators import consolidate as c
from ..operators import graph as g
from .registry import SQL, query

_TARGETS = """targets as (select distinct target as cmake_target, case substring(target, length(target), 1) when '0' then 'EXECUTABLE' when '1' then 'STATIC_LIBRARY' when '2' then 'UTILITY' else 'ODD' end as raw_type,
 concat('/top/src/', lower(replace(target, '#', ''))) as source_dir from paths union all select 'Empty/0', 'INTERFACE_LIBRARY', '/elsewhere')"""


def targets(paths):
    """The targets of the files, and one without files."""
    last = F.right("target", F.lit(1))
    kind = F.when(last == "0", "EXECUTABLE").when(last == "1", "STATIC_LIBRARY").when(last == "2", "UTILITY").otherwise("ODD")
    rows = paths.select(F.col("target").alias("cmake_target"), kind.alias("raw_type"), F.concat(F.lit("/top/src/"), F.lower(F.replace("target", F.lit("#"), F.lit("")))).alias("source_dir")).distinct()
    return rows.union(rows.sparkSession.createDataFrame([("Empty/0", "INTERFACE_LIBRARY", "/elsewhere")], rows.schema))


_FILES = """fm as (select *, preprocessed_bytes / nullif(source_size_bytes, 0) as expansion_ratio from sources),
 lv as (select *, avg(case when not is_generated then git_commit_count end) over (partition by cmake_target) + coalesce(stddev_samp(case when not is_generated then git_commit_count end) over (partition by cmake_target), 0) as level from fm)"""
_INT = {"code_lines_total": "sum(code_lines)", "code_lines_authored": "sum(code_lines) filter (where not is_generated)", "code_lines_generated": "sum(code_lines) filter (where is_generated)", "compile_time_sum_ms": "sum(compile_time_ms)", "compile_time_max_ms": "max(compile_time_ms)", "authored_compile_time_sum_ms": "sum(compile_time_ms) filter (where not is_generated)", "authored_compile_time_max_ms": "max(compile_time_ms) filter (where not is_generated)", "codegen_compile_time_sum_ms": "sum(compile_time_ms) filter (where is_generated)", "codegen_compile_time_max_ms": "max(compile_time_ms) filter (where is_generated)", "header_depth_max": "max(header_max_depth)", "unique_headers_total": "sum(unique_headers)", "total_includes_sum": "sum(total_includes)", "preprocessed_bytes_total": "sum(preprocessed_bytes)", "object_size_total_bytes": "sum(object_size_bytes)", "git_commit_count_total": "sum(git_commit_count) filter (where not is_generated)", "git_churn_total": "sum(git_churn) filter (where not is_generated)", "git_distinct_authors": "max(git_distinct_authors) filter (where not is_generated)"}
_REAL = {"codegen_ratio": "count(*) filter (where is_generated) / count(*)", "compile_time_mean_ms": "avg(compile_time_ms)", "compile_time_median_ms": "median(compile_time_ms)", "compile_time_std_ms": "stddev_samp(compile_time_ms)", "compile_time_p90_ms": "quantile_cont(compile_time_ms, 0.9)", "compile_time_p99_ms": "quantile_cont(compile_time_ms, 0.99)", "compiler_parse_time_sum_ms": "sum(compiler_parse_time_ms)", "compiler_template_time_sum_ms": "sum(compiler_template_instantiation_ms)", "compiler_codegen_phase_sum_ms": "sum(compiler_codegen_time_ms)", "compiler_optimization_time_sum_ms": "sum(compiler_optimization_time_ms)", "compiler_total_usr_sum_ms": "sum(compiler_total_usr_ms)", "compiler_total_sys_sum_ms": "sum(compiler_total_sys_ms)", "header_depth_mean": "avg(header_max_depth)", "preprocessed_bytes_mean": "avg(preprocessed_bytes)", "expansion_ratio_mean": "avg(expansion_ratio)"}
_ROLLED = (
    "select cmake_target, count(*) file_count, count(*) filter (where is_generated) codegen_file_count, count(*) filter (where not is_generated) authored_file_count, count(object_size_bytes) object_file_count, count(*) filter (where not is_generated and git_commit_count > level) git_hotspot_file_count, "
    + ", ".join(f"cast(coalesce({x}, 0) as bigint) {n}" for n, x in _INT.items()) + ", " + ", ".join(f"round(coalesce({x}, 0), 6) {n}" for n, x in _REAL.items()) + " from lv group by cmake_target"
)
_COUNTS = """de as (select src, dst, is_direct from target_edges), c(src, dst) as (select src, dst from de union select c.src, e.dst from c join de e on e.src = c.dst),
 dd as (select src, count(*) n from de where is_direct group by 1), du as (select dst, count(*) n from de where is_direct group by 1), td as (select src, count(*) n from c group by 1), tu as (select dst, count(*) n from c group by 1),
 gc as (select cmake_target, coalesce(dd.n, 0) direct_dependency_count, coalesce(td.n, 0) - coalesce(dd.n, 0) transitive_dependency_count, coalesce(td.n, 0) total_dependency_count, coalesce(du.n, 0) direct_dependant_count, coalesce(tu.n, 0) transitive_dependant_count, coalesce(du.n, 0) fan_in, coalesce(dd.n, 0) fan_out
  from targets left join dd on dd.src = cmake_target left join du on du.dst = cmake_target left join td on td.src = cmake_target left join tu on tu.dst = cmake_target)"""
_STEPS = "st as (select target cmake_target, " + ", ".join(f"cast(coalesce(sum(duration_ms) filter (where step_type = '{k}'), 0) as bigint) {k}_time_ms" for k in ("codegen", "archive", "link")) + " from target_steps group by 1)"


@query(f">{_FILES} {_ROLLED}", ("sources",))
def file_rollup(sources):
    return c.file_rollup(c.derived_ratios(sources))


@query(f">{_TARGETS}, {_COUNTS} select * from gc", ("target_edges", "paths"), recursive=True)
def graph_counters(edges, paths):
    return c.graph_counters(targets(paths), edges)


_LISTS = """li as (select cmake_target, cast(to_json(list(source_file order by source_file)) as varchar) source_files, cast(coalesce(to_json(list(source_file order by source_file) filter (where is_generated)), '[]') as varchar) generated_files from sources group by 1)"""


_PLACE = """lw(node, level) as (select cmake_target, 0 from targets union select e.dst, lw.level + 1 from lw join de e on e.src = lw.node), dp as (select node cmake_target, cast(max(level) as bigint) topological_depth from lw group by 1),
 ds(s, v, d) as (select src, dst, 1 from de union select s, e.dst, d + 1 from ds join de e on e.src = v), m as (select s, v, min(d) d from ds group by 1, 2),
 sg(s, v, d, n) as (select src, dst, 1, cast(1 as double) from de union all select s, v, d, sum(n) from (select p.s, e.dst v, p.d + 1 d, p.n from sg p join de e on e.src = p.v join m on m.s = p.s and m.v = e.dst and m.d = p.d + 1) group by s, v, d),
 bt as (select x.v cmake_target, sum(x.n * y.n / z.n) b from sg x join sg y on y.s = x.v join sg z on z.s = x.s and z.v = y.v and z.d = x.d + y.d group by 1), nt as (select count(*) n from targets)"""


@query(f">{_FILES}, {_TARGETS}, {_COUNTS}, {_STEPS}, {_LISTS}, {_PLACE}, ro as ({_ROLLED})" + " select t.cmake_target, source_dir, topological_depth, round(coalesce(b, 0) / ((nt.n - 1.0) * (nt.n - 2.0)), 6) betweenness_centrality, cast(0 as bigint) critical_path_contribution_ms, "
       + ", ".join(f"coalesce({x}, 0) {x}" for x in ("file_count", "codegen_file_count", "authored_file_count", "object_file_count", "git_hotspot_file_count", *_INT, *_REAL, "codegen_time_ms", "archive_time_ms", "link_time_ms"))
       + """, direct_dependency_count, transitive_dependency_count, total_dependency_count, direct_dependant_count, transitive_dependant_count, fan_in, fan_out,
 coalesce(source_files, '[]') source_files, coalesce(generated_files, '[]') generated_files, case raw_type when 'EXECUTABLE' then 'executable' when 'STATIC_LIBRARY' then 'static_library' when 'UTILITY' then 'custom_target' when 'INTERFACE_LIBRARY' then 'interface_library' else 'unknown' end target_type,
 cast(case when source_dir like '/top/%' then len(string_split(source_dir, '/')) - 2 else 0 end as bigint) directory_depth,
 coalesce(compile_time_sum_ms, 0) + coalesce(codegen_time_ms, 0) + coalesce(archive_time_ms, 0) + coalesce(link_time_ms, 0) total_build_time_ms
 from targets t left join ro using (cmake_target) left join st using (cmake_target) left join gc using (cmake_target) left join li using (cmake_target) left join dp using (cmake_target) left join bt using (cmake_target), nt""", ("sources", "target_edges", "paths", "target_steps"), recursive=True)  # fmt: skip
def target_metrics(sources, edges, paths, steps):
    return c.target_metrics(targets(paths), c.derived_ratios(sources), steps, edges, "/top")


@query("""select source_file, round(preprocessed_bytes / nullif(source_size_bytes, 0), 6) expansion_ratio, round(code_lines / nullif(compile_time_ms / 1000.0, 0), 6) compile_rate_lines_per_sec, round(object_size_bytes / nullif(code_lines, 0), 6) object_efficiency from sources""", ("sources",))
def derived_ratios(sources):
    return c.derived_ratios(sources).select("source_file", "expansion_ratio", "compile_rate_lines_per_sec", "object_efficiency")


@query("""select source_file, cmake_target, case when compile_time_ms % 2 = 0 then compile_time_ms + 1 else compile_time_ms end compile_time_ms, case when code_lines > 0 then code_lines end code_lines, case when length(source_file) % 2 = 0 then header_max_depth end header_max_depth,
 object_size_bytes, preprocessed_bytes, case when not is_generated then git_commit_count end git_commit_count, compiler_parse_time_ms from sources""", ("sources",))  # fmt: skip
def file_spine(sources):
    # every even compilation was logged twice, and some measurements are missing
    ordered = sources.withColumn("ord", F.lit(1))
    again = ordered.where("compile_time_ms % 2 = 0").withColumns({"ord": F.lit(2), "compile_time_ms": F.col("compile_time_ms") + 1})
    parts = [
        (ordered.unionByName(again), ["compile_time_ms"]), (ordered.where("code_lines > 0"), ["code_lines"]), (ordered.where("length(source_file) % 2 = 0"), ["header_max_depth"]), (ordered, ["object_size_bytes"]),
        (ordered, ["preprocessed_bytes"]), (ordered.where("not is_generated"), ["git_commit_count"]), (ordered, ["compiler_parse_time_ms"]),
    ]
    return c.spine(ordered.select("source_file", "cmake_target", "ord"), parts)


@query("select source_file, language from sources where not is_generated and language in ('CXX') and (source_file like 'src/brand1%' or source_file like '%.hpp') and not source_file like '%9.cpp'", ("sources",))
def file_filters(sources):
    return c.file_filters(sources, True, ["CXX"], ["src/brand1*", "*.hpp"], ["*9.cpp"]).select("source_file", "language")


@query(""">ch as (select case when file_id % 3 = 0 then path when file_id % 3 = 1 then concat('other/', 'f', file_id, '.cpp') else concat('none', file_id) end path from paths)
 select ch.path, coalesce(a.target, b.target) cmake_target from ch left join paths a on a.path = ch.path left join paths b on ch.path like 'other/%' and b.path like concat('%/', substring(ch.path, 7))""", ("paths",))  # fmt: skip
def change_targets(paths):
    k = F.col("file_id") % 3
    changes = paths.select(F.when(k == 0, F.col("path")).when(k == 1, F.concat(F.lit("other/f"), "file_id", F.lit(".cpp"))).otherwise(F.concat(F.lit("none"), "file_id")).alias("path"))
    return c.target_of_changes(changes, paths.select(F.col("path").alias("source_file"), F.col("target").alias("cmake_target")))


SQL["change_targets"] = SQL["change_targets"].replace("b.path like concat('%/', substring(ch.path, 7))", "string_split(b.path, '/')[-1] = substring(ch.path, 7)")


@query("select source_file, case when is_generated then 'GENERATED' else 'HANDWRITTEN' end origin from sources", ("sources",))
def file_origin(sources):
    return sources.select("source_file", c.origin(F.col("is_generated")).alias("origin"))


@query(""">g as (select target_id, cast(sum(end_ms - start_ms) as bigint) ms, cast(count(*) as double) score, max(step_type) team from steps where target_id % 3 = 0 group by 1)
 select i.contributor, coalesce(ms, 0) total_ms, coalesce(score, 0) x_score, coalesce(g.team, 'unknown') team, coalesce(canonical, '') canonical, coalesce(case when is_resolved then true end, false) flag from identities i left join g on g.target_id = i.contributor""", ("identities", "steps"))  # fmt: skip
def default_fill(identities, steps):
    rows = steps.where("target_id % 3 = 0").groupBy(F.col("target_id").alias("contributor")).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.count("*").cast("double").alias("x_score"), F.max("step_type").alias("team"))
    return c.filled(identities.select("contributor", "canonical", F.when(F.col("is_resolved"), True).alias("flag")).join(rows, "contributor", "left"))


@query(""">m as (select *, printf('%,.0f ms (%.2f s)', compile_time_ms * 1.0, compile_time_ms / 1000.0) t from sources) select source_file, t as shown from m""", ("sources",))
def shown_times(sources):
    return sources.select("source_file", c.milliseconds(F.col("compile_time_ms")).alias("shown"))


SQL["shown_times"] = SQL["shown_times"].replace("printf('%,.0f ms (%.2f s)', compile_time_ms * 1.0, compile_time_ms / 1000.0)", "format('{:,} ms ({:.2f} s)', compile_time_ms, compile_time_ms / 1000.0)")


@query(f">{_FILES}, ro as ({_ROLLED})" + """ select cmake_target as target, 1 as ord, 'file_count' as key, cast(file_count as varchar) as value from ro union all select cmake_target, 4, 'codegen_ratio', format('{:.2f}%', codegen_ratio * 100) from ro
 union all select cmake_target, 5, 'compile_time_sum', format('{:,} ms ({:.2f} s)', compile_time_sum_ms, compile_time_sum_ms / 1000.0) from ro union all select cmake_target, 12, 'git_churn_total', cast(git_churn_total as varchar) from ro""", ("sources",))  # fmt: skip
def target_summary(sources):
    # the target table keeps its ratios to six places, and is what the percentages are made of
    rows = c.summary(c.file_rollup(c.derived_ratios(sources)).withColumn("codegen_ratio", six_places(F.col("codegen_ratio"))))
    keys = {"file_count": 1, "codegen_ratio": 4, "compile_time_sum": 5, "git_churn_total": 12}
    at = F.create_map(*(F.lit(x) for p in keys.items() for x in p))
    return rows.where(F.col("key").isin(*keys)).select("target", at[F.col("key")].alias("ord"), "key", "value")


@query(""">c(src, dst) as (select src, dst from edges union select c.src, e.dst from c join edges e on e.src = c.dst), t as (select min(dst) t from (select dst, count(*) n from edges group by 1 order by n desc, dst limit 1)),
 r as (select 'direct_dependency' relation, dst node from edges, t where src = t union all select 'direct_dependant', src from edges, t where dst = t union all select 'transitive_dependant', src from c, t where dst = t and src not in (select src from edges, t where dst = t))
 select relation, node, ms from r join nodes using (node)""", ("edges", "nodes"), recursive=True)  # fmt: skip
def target_neighbours(edges, nodes):
    most = edges.groupBy("dst").count().orderBy(F.desc("count"), "dst").head()[0]
    return c.neighbours(nodes, edges, g.closure(edges), most)


@query("""select 'steps' as key, cast(count(*) as double) as value from target_steps union all select 'named', cast(count(*) as double) from target_steps where target <> '' union all select 'coverage_pct', round(count(*) filter (where target <> '') * 100.0 / count(*), 6) from target_steps
 union all select 'time_ms', cast(sum(duration_ms) as double) from target_steps""", ("target_steps",))  # fmt: skip
def schedule_coverage(steps):
    return c.load_summary(steps)


@query(" union all ".join(f"select '{x}' as column, cast({x} as varchar) as value, count(*) as n from sources group by {x}" for x in ("language", "is_generated", "cmake_target")), ("sources",))
def value_counts(sources):
    return c.value_counts(sources, ["language", "is_generated", "cmake_target"])


_NUM = ["compile_time_ms", "code_lines", "object_size_bytes", "preprocessed_bytes"]


@query(" union all ".join(f"select '{x}' as column, cast(min({x}) as double) low, round(quantile_cont({x}, 0.25), 6) q1, round(quantile_cont({x}, 0.5), 6) median, round(quantile_cont({x}, 0.75), 6) q3, cast(max({x}) as double) high, min({x}) = max({x}) constant from sources" for x in _NUM), ("sources",))
def quartiles(sources):
    return c.quartiles(sources, _NUM)


@query("""select target_type, count(*) targets, cast(sum(files) as bigint) files, round(avg(files), 6) mean_files from (select case substring(target, length(target), 1) when '0' then 'executable' when '1' then 'static_library' when '2' then 'custom_target' else 'unknown' end target_type, target, count(*) files from paths group by 1, 2) group by 1""", ("paths",))
def target_types(paths):
    sizes = paths.groupBy(F.col("target").alias("cmake_target")).agg(F.count("*").alias("files"))
    return targets(paths).join(sizes, "cmake_target").groupBy(c.target_type(F.col("raw_type")).alias("target_type")).agg(F.count("*").alias("targets"), F.sum("files").alias("files"), F.avg("files").alias("mean_files"))
