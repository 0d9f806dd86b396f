"""Queries that compare snapshots: the years of the log stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as cmp
from .registry import query

_TOT = """el as (select label, count(*) edge_count from yearly_edges group by 1),
 tr as (select label, cast(sum(build_ms) as double) total_build_time_ms, cast(sum(link_ms) as double) total_link_time_ms, cast(count(*) as double) target_count, cast(sum(file_count) as double) file_count, cast(sum(code_lines) as double) total_sloc,
  cast(max(coalesce(edge_count, 0)) as double) edge_count, avg(dependencies) mean_dep_count from yearly left join el using (label) group by label)"""
_BIG = ["total_build_time_ms", "total_link_time_ms", "target_count", "file_count", "total_sloc", "edge_count", "mean_dep_count"]
_LOWER = ("total_build_time_ms", "total_link_time_ms", "edge_count", "mean_dep_count")


@query(f">{_TOT} select label, " + ", ".join(f"round({c}, 6) {c}" for c in _BIG) + ", round(case when total_sloc > 0 then total_build_time_ms / total_sloc else 0 end, 6) build_time_per_sloc from tr", ("yearly", "yearly_edges"))
def snapshot_trend(yearly, edges):
    return cmp.trend(yearly, edges)


@query(f">{_TOT}, mx as (select max(label) l from tr), b as (select tr.* from tr, mx where label = l - 1), a as (select tr.* from tr, mx where label = l), r as (" + " union all ".join(f"select '{c}' metric, b.{c} as before, a.{c} as after, {'true' if c in _LOWER else 'false'} as low from a, b" for c in _BIG)
       + ") select metric, round(before, 6) before, round(after, 6) as after, round(after - before, 6) delta, round(case when before <> 0 then (after - before) / before * 100 else 0 end, 6) delta_pct, case when low then after < before else after >= before end improved from r", ("yearly", "yearly_edges"))
def global_deltas(yearly, edges):
    last = yearly.agg(F.max("label")).head()[0]
    return cmp.global_deltas(cmp.trend(yearly, edges), last - 1, last)


@query(f">{_TOT}, l as (" + " union all ".join(f"select label, '{c}' metric, {c} as value from tr" for c in _LOWER) + """), p as (select *, lag(value) over (partition by metric order by label) before, row_number() over (partition by metric order by label) k from l)
 select label, metric, round(before, 6) before, round(value, 6) as after, round((value - before) / before * 100, 6) pct, case when (value - before) / before * 100 > 1.0 then 'critical' else 'warning' end severity from p where k > 1 and before <> 0 and (value - before) / before * 100 > 0.5""", ("yearly", "yearly_edges"))  # fmt: skip
def regressions(yearly, edges):
    return cmp.regressions(cmp.trend(yearly, edges), list(_LOWER), 0.5, latest_only=False)


@query("select label, module, count(*) target_count, cast(sum(build_ms) as bigint) total_build_time_ms, cast(sum(code_lines) as bigint) total_sloc, 0 as external_dep_count from yearly where module <> 'Brand#11' group by 1, 2", ("yearly",))
def module_trends(yearly):
    modules = yearly.select(F.col("target").alias("node"), F.when(F.col("module") != "Brand#11", F.col("module")).alias("module")).distinct()
    return cmp.module_trends(yearly, modules)


@query(f">{_TOT}, e as (select label, case when total_sloc > 0 then total_build_time_ms / total_sloc else 0 end x from tr), f as (select x from e order by label limit 1), l as (select x from e order by label desc limit 1)"
       " select round(f.x, 6) as first, round(l.x, 6) as last, round(case when f.x > 0 then (l.x - f.x) * 100 / f.x else 0 end, 6) delta_pct, case when l.x < f.x then 'improving' when l.x > f.x then 'degrading' else 'stable' end direction from f, l", ("yearly", "yearly_edges"))  # fmt: skip
def efficiency_trend(yearly, edges):
    return cmp.efficiency(cmp.trend(yearly, edges))


def _chain(n: str, label: str) -> str:
    """Critical nodes of one snapshot's edges, in SQL: names end in n."""
    return f"""e{n} as (select src, dst from yearly_edges where label = {label}), f{n}(node, finish) as (select node, ms from nodes union select e.src, f.finish + x.ms from f{n} f join e{n} e on e.dst = f.node join nodes x on x.node = e.src),
 b{n}(node, tail) as (select node, ms from nodes union select e.dst, b.tail + x.ms from b{n} b join e{n} e on e.src = b.node join nodes x on x.node = e.dst), t{n} as (select max(finish) total from f{n}),
 c{n} as (select node from (select node, max(finish) finish from f{n} group by 1) join (select node, max(tail) tail from b{n} group by 1) using (node) join nodes using (node), t{n} where finish + tail - ms = total)"""


_L = "(select max(label) from yearly_edges)"


@query(">" + _chain("p", f"{_L} - 1") + ", " + _chain("n", _L) + """ select node, case when cp.x is null then 'added' when cn.y is null then 'removed' else 'unchanged' end status, (select total from tp) before_ms, (select total from tn) after_ms
 from (select node, 1 x from cp) cp full join (select node, 1 y from cn) cn using (node)""", ("yearly_edges", "nodes"), recursive=True)  # fmt: skip
def critical_path_changes(edges, nodes):
    last = edges.agg(F.max("label")).head()[0]
    return cmp.critical_paths(nodes, edges.where(F.col("label") == last - 1), nodes, edges.where(F.col("label") == last))


@query(f"select src, dst, case when b.x is null then 'added' when a.x is null then 'removed' else 'unchanged' end status from (select src, dst, 1 x from yearly_edges where label = {_L} - 1) b full join (select src, dst, 1 x from yearly_edges where label = {_L}) a using (src, dst)", ("yearly_edges",))
def edge_deltas(edges):
    from ..operators import metrics as m

    last = edges.agg(F.max("label")).head()[0]
    return m.edge_deltas(edges.where(F.col("label") == last - 1), edges.where(F.col("label") == last))
