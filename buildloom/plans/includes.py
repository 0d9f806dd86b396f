"""Queries of the inclusion graph and of precompiled headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import includes as inc
from .registry import query

ROWS = "include_rows"
_G = """>e as (select includer src, included dst, count(distinct unit) weight from include_rows group by 1, 2), n as (select distinct node from (select src node from e union all select dst from e)),
 sy as (select included node, bool_and(is_system) is_system from include_rows group by 1), nn as (select node, coalesce(is_system, false) is_system, regexp_extract(node, '(\\.[^./]*)$', 1) in ('.h', '.hpp', '.hxx', '.hh', '.inl', '.ipp') header from n left join sy using (node))"""
_C = ", c(src, dst) as (select src, dst from e union select c.src, e.dst from c join e on e.src = c.dst)"
_F = """, fi as (select dst node, count(*) n from e group by 1), fo as (select src node, count(*) n from e group by 1), ft as (select dst node, count(*) n from c group by 1),
 fan as (select nn.node, coalesce(fi.n, 0) direct_fan_in, coalesce(fo.n, 0) direct_fan_out, case when header then coalesce(ft.n, 0) else -1 end transitive_fan_in, header is_header from nn left join fi using (node) left join fo using (node) left join ft using (node))"""
_H = ", h as (select path node, max(p.target) target, max(code_lines) sloc, max(source_size_bytes) source_size_bytes from sources s join paths p on p.path = s.source_file group by 1), k as (select source_file node, git_commit_count n_commits from sources)"


def _sizes(sources):
    return sources.select(F.col("source_file").alias("node"), F.col("cmake_target").alias("target"), F.col("code_lines").alias("sloc"), "source_size_bytes")


def _churn(sources):
    return sources.select(F.col("source_file").alias("node"), F.col("git_commit_count").alias("n_commits"))


def _files(sources):
    return sources.select(F.col("cmake_target").alias("target"), F.col("source_file").alias("node"), "preprocessed_bytes", "compile_time_ms")


@query(_G + " select src, dst, weight, is_system from e join nn on node = dst", (ROWS,))
def include_graph(rows):
    nodes, edges = inc.include_graph(rows)
    return edges.join(nodes.withColumnRenamed("node", "dst"), "dst").select("src", "dst", "weight", "is_system")


@query(_G + _C + _F + " select * from fan", (ROWS,), recursive=True)
def include_fan(rows):
    nodes, edges = inc.include_graph(rows)
    return inc.fan(nodes, edges, g.closure(edges))


@query(_G + _C + """, d as (select src node, count(*) a from e group by 1), t as (select src node, count(*) b from c group by 1)
 select node, a direct_includes, b transitive_includes, round(b / a, 6) amplification_ratio, preprocessed_bytes from d join t using (node) left join sources on source_file = node where regexp_extract(node, '(\\.[^./]*)$', 1) in ('.c', '.cc', '.cpp', '.cxx', '.m', '.mm')""", (ROWS, "sources"), recursive=True)  # fmt: skip
def include_amplification(rows, sources):
    nodes, edges = inc.include_graph(rows)
    return inc.amplification(nodes, edges, g.closure(edges), sources.select(F.col("source_file").alias("node"), "preprocessed_bytes"))


def ranks(edges: str, nodes: str, rounds: int, weight: str = "1.0") -> str:
    """Rank rounds as tables one after another: SQL for edges(src, dst) and nodes(node)."""
    out = f"rn as materialized (select node, count(*) over () n from {nodes}), rw as materialized (select src, dst, {weight} / sum({weight}) over (partition by src) w from {edges}), rl as materialized (select node from rn where node not in (select src from rw)), r0 as materialized (select node, 1.0 / n rank from rn)"
    for k in range(rounds):
        out += f""", r{k + 1} as materialized (select rn.node, 0.15 / n + 0.85 * (coalesce(i.s, 0) + l.s / n) as rank from rn left join (select dst node, sum(rank * w) s from r{k} join rw on src = node group by 1) i using (node), (select coalesce(sum(rank), 0) s from r{k} join rl using (node)) l)"""
    return out


@query(_G + ", on_ as (select node from nn where not is_system), oe as (select src, dst, cast(weight as double) weight from e where src in (select node from on_) and dst in (select node from on_)), " + ranks("oe", "on_", 20, "weight") + " select node, round(rank, 6) as rank from r20", (ROWS,))
def header_pagerank(rows):
    return inc.header_rank(*inc.include_graph(rows), rounds=20, tolerance=None)


@query(_G + _C + _F + _H + """ select f.node, transitive_fan_in, coalesce(sloc, 0) sloc, coalesce(source_size_bytes, 0) source_size_bytes, coalesce(n_commits, 0) n_commits, transitive_fan_in * coalesce(source_size_bytes, 0) * (1 + coalesce(n_commits, 0)) impact_score, direct_fan_in
 from fan f left join h using (node) left join k using (node) where is_header""", (ROWS, "sources", "paths"), recursive=True)  # fmt: skip
def header_impact_scores(rows, sources, paths):
    nodes, edges = inc.include_graph(rows)
    return inc.impact(inc.fan(nodes, edges, g.closure(edges)), _sizes(sources), _churn(sources))


@query(_G + _C + _F + _H + """, m as (select cmake_target target, max(git_commit_count) n_commits from sources group by 1)
 select f.node, transitive_fan_in, coalesce(sloc, 0) sloc, coalesce(source_size_bytes, 0) source_size_bytes, coalesce(n_commits, 0) n_commits, transitive_fan_in * coalesce(source_size_bytes, 0) * (1 + coalesce(n_commits, 0)) impact_score, direct_fan_in, target
 from fan f join nn using (node) left join h using (node) left join m using (target) where is_header and not is_system and target like 'Brand#1%'""", (ROWS, "sources", "paths"), recursive=True)  # fmt: skip
def header_hot_list(rows, sources, paths):
    nodes, edges = inc.include_graph(rows)
    scope = paths.where("target like 'Brand#1%'").select("target").distinct()
    files = sources.select(F.col("cmake_target").alias("target"), F.col("git_commit_count").alias("commits"))
    return inc.hot_list(nodes, edges, _sizes(sources), files, scope=scope)


@query(""">own as (select path, target from paths where file_id % 2 = 0), every as (select included node, bool_and(is_system) is_system from include_rows group by 1 union all
  select distinct includer, false from include_rows where regexp_extract(includer, '(\\.[^./]*)$', 1) in ('.h', '.hpp', '.hxx', '.hh', '.inl', '.ipp', '.inc', '.tpp') and includer not in (select included from include_rows)),
 d as (select regexp_replace(path, '/[^/]*$', '') dir, arg_min(target, path) t from own group by 1)
 select node, case when not is_system then coalesce(own.target, d.t) end target, cast(case when is_system then 0 else coalesce(code_lines, 0) end as bigint) sloc, cast(case when is_system then 0 else coalesce(source_size_bytes, 0) end as bigint) source_size_bytes, is_system
 from every left join own on own.path = node left join d on d.dir = regexp_replace(node, '/[^/]*$', '') left join sources on source_file = node""", (ROWS, "paths", "sources"))  # fmt: skip
def header_owners(rows, paths, sources):
    sizes = sources.select(F.col("source_file").alias("path"), F.col("code_lines").alias("sloc"), "source_size_bytes")
    return inc.header_owners(rows, paths.where("file_id % 2 = 0").select("path", "target"), sizes)


_P = _G + _C + """, used as (select cmake_target target, c.dst node, count(*) users from sources join c on c.src = source_file group by 1, 2 having count(*) > 1), tot as (select cmake_target target, count(*) files from sources group by 1),
 pc as (select used.target, used.node, users, users / files coverage, coalesce(s.source_size_bytes, 0) size, coalesce(s.git_commit_count, 0) commits from used join tot using (target) join nn on nn.node = used.node and nn.header left join sources s on s.source_file = used.node),
 ps as (select *, coverage * size / (case when max(size) over (partition by target) > 0 then max(size) over (partition by target) else 1 end) * (1 - commits / (case when max(commits) over (partition by target) > 0 then max(commits) over (partition by target) else 1 end)) score from pc),
 pt as (select *, row_number() over (partition by target order by score desc, node) place from ps)"""
_I = """, ch as (select target, node, size, commits from pt where place <= {top}), bh as (select target, count(*) headers, sum(size) pch_bytes, sum(commits / 12) rebuilds, count(*) filter (where commits > 5) risks from ch group by 1),
 sv as (select ch.target, sum(ch.size) saved from ch join sources s on s.cmake_target = ch.target join c on c.src = s.source_file and c.dst = ch.node group by 1),
 tt as (select cmake_target target, count(*) source_file_count, sum(preprocessed_bytes) bytes, sum(compile_time_ms) ms from sources group by 1),
 im as (select target, source_file_count, ms, coalesce(headers, 0) headers, coalesce(saved, 0) saved, coalesce(pch_bytes, 0) pch_bytes, coalesce(rebuilds, 0) rebuilds, coalesce(risks, 0) risks, coalesce(saved, 0) / (case when bytes = 0 then 1 else bytes end) reduction, case when ms > 0 then ms / (case when bytes = 0 then 1 else bytes end) else 0.0 end per_byte
  from tt left join bh using (target) left join sv using (target)),
 ad as (select *, case when headers = 0 then 'not_recommended' when reduction > 0.2 and risks = 0 then 'recommended' when reduction > 0.1 or risks <= 2 then 'marginal' else 'not_recommended' end recommendation from im)"""


@query(_P + " select target, node, users, round(coverage, 6) coverage, size, commits, round(score, 6) score from pt where place <= 15", (ROWS, "sources"), recursive=True)
def pch_candidates(rows, sources):
    _, edges = inc.include_graph(rows)
    return inc.pch_candidates(_files(sources), g.closure(edges), _sizes(sources), _churn(sources), 15)


@query(_P + _I.format(top=5) + """ select target, headers pch_header_count, source_file_count, cast(saved as bigint) total_preprocessed_bytes_saved, round(reduction, 6) preprocessed_reduction_fraction, round(saved * per_byte, 6) estimated_compile_time_saved_ms,
 round(pch_bytes * per_byte, 6) estimated_pch_rebuild_cost_ms, round(cast(rebuilds as double), 6) pch_rebuild_frequency_per_month, round(saved * per_byte * 220 - pch_bytes * per_byte * rebuilds, 6) net_monthly_savings_ms, risks risk_header_count, recommendation from ad""", (ROWS, "sources"), recursive=True)  # fmt: skip
def pch_impact(rows, sources):
    _, edges = inc.include_graph(rows)
    pairs, files, sizes, churn = g.closure(edges), _files(sources), _sizes(sources), _churn(sources)
    return inc.pch_impact(inc.pch_candidates(files, pairs, sizes, churn, 5), files, pairs, sizes, churn)


@query(_P + _I.format(top=15) + """ select target, source_file_count, cast(ms as bigint) current_compile_time_ms, round(saved * per_byte, 6) estimated_savings_ms, round(coalesce(saved * per_byte / nullif(ms, 0), 0), 6) savings_fraction, headers pch_header_count, risks risk_header_count, recommendation
 from ad where source_file_count >= 3""", (ROWS, "sources"), recursive=True)  # fmt: skip
def pch_opportunities(rows, sources):
    _, edges = inc.include_graph(rows)
    return inc.pch_opportunities(_files(sources), g.closure(edges), _sizes(sources), _churn(sources))


@query(_G + """, i as (select 'in' side, node, count(e.src) degree from nn left join e on e.dst = node group by 2), o as (select 'out' side, node, count(e.dst) degree from nn left join e on e.src = node group by 2),
 r as (select *, row_number() over (partition by side order by degree desc, node) place from (select * from i union all select * from o)) select side, place, node, degree from r where place <= 10""", (ROWS,))  # fmt: skip
def include_leaders(rows):
    return inc.leaders(*inc.include_graph(rows))
