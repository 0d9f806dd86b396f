"""All registered queries of the engine's own operators over the derived views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import minmax
from ..operators import graph as g
from ..operators import history as h
from ..operators import metrics as m
from ..operators import recommend as rc
from .registry import CLOSURE, QUERIES, SQL, query

# Module patterns over paths, in order.
PATTERNS = [("blue", "blue*"), ("hot", "hot *"), ("rings", "*ring"), ("small", "s[m]all ?*")]


LOG, FILES, EDGES, NODES = "commit_log", "file_metrics", "edges", "nodes"


@query("""select file_id, count(distinct commit_id) as n_commits, count(distinct contributor) as n_authors, cast(sum(added) as bigint) as added, cast(sum(deleted) as bigint) as deleted,
 cast(sum(added) + sum(deleted) as bigint) as churn, round(epoch(max(ts) - min(ts)) / 86400.0, 6) as age_days,
 round(case when max(ts) > min(ts) then count(distinct commit_id) / (epoch(max(ts) - min(ts)) / 86400.0 / 30.44) else count(distinct commit_id) end, 6) as commits_per_month
 from commit_log group by file_id""", (LOG,))  # fmt: skip
def file_churn(log):
    return h.file_churn(log)


@query("select commit_id, count(distinct file_id) as files, cast(sum(added) as bigint) as added, cast(sum(deleted) as bigint) as deleted, cast(sum(added + deleted) as bigint) as churn from commit_log group by commit_id", (LOG,))
def commit_summary(log):
    return h.commit_summary(log)


@query("select contributor, count(distinct commit_id) as commits, count(distinct file_id) as files, min(ts) as first, max(ts) as last from commit_log group by contributor", (LOG,))
def contributor_summary(log):
    return h.contributor_summary(log)


@query("select contributor, file_id, count(*) as n from commit_log group by contributor, file_id", (LOG,))
def contributor_file_counts(log):
    return log.groupBy("contributor", "file_id").agg(F.count("*").alias("n"))


@query("select commit_id, file_id, line_no, added from commit_log where commit_id in (select commit_id from commit_log group by commit_id having count(distinct file_id) <= 5)", (LOG,))
def mega_commit_filter(log):
    return h.without_mega_commits(log, 5).select("commit_id", "file_id", "line_no", "added")


@query("select file_id, commit_id, line_no from (select *, row_number() over (partition by file_id order by ts desc, commit_id desc, line_no desc, added desc, contributor desc) k from commit_log) where k = 1", (LOG,))
def keep_last(log):
    return h.keep_one(log, ["file_id"], ["ts", "commit_id", "line_no", "added", "contributor"]).select("file_id", "commit_id", "line_no")


@query("select file_id, commit_id, line_no from (select *, row_number() over (partition by file_id order by ts, commit_id, line_no, added, contributor) k from commit_log) where k = 1", (LOG,))
def keep_first(log):
    return h.keep_one(log, ["file_id"], ["ts", "commit_id", "line_no", "added", "contributor"], last=False).select("file_id", "commit_id", "line_no")


@query("select contributor, count(*) as n, count(team) as with_team, count(*) filter (where not coalesce(is_resolved, false)) as unresolved from commit_log left join identities using (contributor) group by contributor", (LOG, "identities"))
def identity_resolution(log, identities):
    # the team of an unknown contributor is null
    return h.resolve_identities(log, identities).groupBy("contributor").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_resolved"), F.col("team"))).alias("with_team"), F.count_if(~F.col("is_resolved")).alias("unresolved"))


SQL["identity_resolution"] = SQL["identity_resolution"].replace("count(team) as", "count(case when is_resolved then team end) as")

_OWN = """>rows as (select {item}, contributor, case when is_resolved then canonical end canonical, case when is_resolved then team end team, coalesce(is_resolved, false) r from {source} left join identities using (contributor)),
 tot as (select {item}, count(*) total_commits, count(*) filter (where not r) unresolved, count(distinct canonical) filter (where r) + count(distinct contributor) filter (where not r) contributors from rows group by 1),
 teams as (select {item}, team, count(*) n from rows where team is not null group by 1, 2),
 own as (select {item}, arg_min(team, struct_pack(a := -n, b := team)) owning_team, max(n) top, sum(n * n) squares, count(*) teams from teams group by 1)
 select {item}, owning_team, round(coalesce(top / total_commits, 0), 6) owning_share, round(coalesce(squares / (total_commits * total_commits), 0), 6) team_hhi, round(1 - coalesce(top / total_commits, 0), 6) cross_team_fraction, total_commits, unresolved, contributors, coalesce(teams, 0) teams
 from tot left join own using ({item})"""


@query(_OWN.format(item="target", source="(select l.contributor, f.target from commit_log l join files f using (file_id))"), (LOG, "files", "identities"))
def target_ownership(log, files, identities):
    return h.team_ownership(h.resolve_identities(log.join(files.select("file_id", "target"), "file_id"), identities), "target")


@query(_OWN.format(item="file_id", source="commit_log"), (LOG, "identities"))
def file_ownership(log, identities):
    return h.team_ownership(h.resolve_identities(log, identities), "file_id")


@query(""">n as (select target, contributor, count(distinct commit_id) n from commit_log join files using (file_id) group by 1, 2),
 r as (select *, row_number() over (partition by target order by n, contributor) k, sum(n) over (partition by target order by n desc, contributor rows unbounded preceding) cum, sum(n) over (partition by target) total from n)
 select target, round((2 * sum(k * n) - (count(*) + 1) * sum(n)) / (count(*) * sum(n)), 6) gini, round(sum(n * n) / (sum(n) * sum(n)), 6) hhi, round(max(n) / sum(n), 6) top_share,
 count(*) filter (where cum * 2 <= total) + 1 bus_factor, count(*) contributors, cast(sum(n) as bigint) commits from r group by target""", (LOG, "files"))  # fmt: skip
def ownership_concentration(log, files):
    return h.concentration(log.join(files.select("file_id", "target"), "file_id"), "target")


@query(""">e as (select max(ts) as till from commit_log),
 w as (select target, contributor, sum(exp(-ln(2.0) / 180 * (epoch(till - ts) / 86400.0))) weight from commit_log join files using (file_id), e group by 1, 2)
 select target, contributor, round(weight, 6) weight, round(weight / sum(weight) over (partition by target), 6) share from w""", (LOG, "files"))  # fmt: skip
def decayed_ownership(log, files):
    return h.decayed_ownership(log.join(files.select("file_id", "target"), "file_id"), "target", 180)


@query(""">e as (select max(ts) as till from commit_log) select target, team, count(distinct contributor) bus_factor from commit_log join files using (file_id) join identities using (contributor), e
 where is_resolved and team is not null and ts >= till - interval 12 months group by 1, 2""", (LOG, "files", "identities"))  # fmt: skip
def recent_bus_factor(log, files, identities):
    rows = h.resolve_identities(log.join(files.select("file_id", "target"), "file_id"), identities).where("team is not null")
    return h.recent_bus_factor(rows, "target", "team", 12)


@query(""">n as (select contributor, target, count(*) n from commit_log join files using (file_id) group by 1, 2),
 k as (select * from n where contributor in (select contributor from n group by 1 having sum(n) >= 10) and target in (select target from n group by 1 having sum(n) >= 5))
 select contributor, target, n, round(n / sum(n) over (partition by contributor), 6) share from k""", (LOG, "files"))  # fmt: skip
def contributor_matrix(log, files):
    return h.contributor_matrix(log.join(files.select("file_id", "target"), "file_id"), "target", 10, 5)


_CO = """>one as (select distinct commit_id, {item} as item from {source}),
 kept as (select * from one where commit_id in (select commit_id from one group by 1 having count(*) <= 50)),
 tot as (select count(distinct commit_id) total from kept), each as (select item, count(*) n from kept group by 1),
 p as (select a.item item_a, b.item item_b, count(*) together from kept a join kept b using (commit_id) where a.item < b.item group by 1, 2 having count(*) >= {least})
 select item_a, item_b, together, round(log2(together * total / (x.n * y.n)), 6) pmi, round(together / (x.n + y.n - together), 6) jaccard
 from p join each x on x.item = item_a join each y on y.item = item_b, tot"""


@query(_CO.format(item="file_id", source="commit_log", least=2), (LOG,))
def cochange_file(log):
    return h.cochange(log, "file_id", least=2)


@query(_CO.format(item="target", source="commit_log join files using (file_id)", least=3), (LOG, "files"))
def cochange_target(log, files):
    return h.cochange(log.join(files.select("file_id", "target"), "file_id"), "target")


_ROLL = """select target, count(*) files, count(*) filter (where is_generated) generated_files, count(*) filter (where not is_generated) authored_files, cast(coalesce(sum(code_lines), 0) as bigint) code_lines,
 cast(coalesce(sum(code_lines) filter (where is_generated), 0) as bigint) generated_lines, cast(coalesce(sum(compile_ms), 0) as bigint) compile_ms, max(compile_ms) compile_max, round(avg(compile_ms), 6) compile_mean,
 round(median(compile_ms), 6) compile_median, round(coalesce(stddev_samp(compile_ms), 0), 6) compile_std, round(quantile_cont(compile_ms, 0.9), 6) compile_p90, round(quantile_cont(compile_ms, 0.99), 6) compile_p99,
 cast(coalesce(sum(commits) filter (where not is_generated), 0) as bigint) commits, count(*) filter (where not is_generated and commits > level) hotspots
 from (select *, avg(commits) filter (where not is_generated) over (partition by target) + coalesce(stddev_samp(commits) filter (where not is_generated) over (partition by target), 0) as level from file_metrics) group by target"""


@query(_ROLL, (FILES,))
def target_rollup(files):
    return m.target_rollup(files)


@query(""">a as (select *, avg(commits) over (partition by target) + coalesce(stddev_samp(commits) over (partition by target), 0) as level from file_metrics where not is_generated)
 select target, file_id, commits, round(level, 6) level from a where commits > level""", (FILES,))  # fmt: skip
def hotspot_files(files):
    return m.hotspot_files(files)


@query("""select count(compile_ms) n, cast(coalesce(sum(compile_ms), 0) as bigint) total, min(compile_ms) low, max(compile_ms) high, round(avg(compile_ms), 6) mean, round(median(compile_ms), 6) median,
 round(stddev_samp(compile_ms), 6) std, round(quantile_cont(compile_ms, 0.9), 6) p90, round(quantile_cont(compile_ms, 0.99), 6) p99 from file_metrics""", (FILES,))  # fmt: skip
def distribution_stats(files):
    return m.distribution(files, "compile_ms")


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("select target_id, " + ", ".join(f"cast(coalesce(sum(end_ms - start_ms) filter (where step_type = '{k}'), 0) as bigint) {k}_ms" for k in KINDS) + " from steps group by target_id", ("steps",))
def step_times_pivot(steps):
    return m.step_times(steps, KINDS)


@query(""">mv as (select start_ms as moment, 1 d from steps where end_ms > start_ms union all select end_ms, -1 from steps where end_ms > start_ms), mm as (select moment, sum(d) d from mv group by moment),
 run as (select sum(d) over (order by moment) r from mm)
 select count(*) steps, max(end_ms) - min(start_ms) wall_ms, cast(sum(end_ms - start_ms) as bigint) cpu_ms, round(sum(end_ms - start_ms) / nullif(max(end_ms) - min(start_ms), 0), 6) mean_parallelism,
 cast(coalesce((select max(r) from run), 0) as bigint) max_parallelism from steps""", ("steps",))  # fmt: skip
def schedule_summary(steps):
    return m.parallelism(steps)


@query("select file_id, case when path like 'blue%' then 'blue' when path like 'hot %' then 'hot' when path like '%ring' then 'rings' when path like 'small _%' then 'small' end as module from files", ("files",))
def glob_modules(files):
    return m.assign_modules(files, "path", PATTERNS).select("file_id", "module")


@query("select file_id, compile_ms, size, case when size < 2 then 'quick_win' when size <= 10 then 'medium' else 'strategic' end as category from files a where not exists (select 1 from files b where b.compile_ms >= a.compile_ms and b.size <= a.size and (b.compile_ms > a.compile_ms or b.size < a.size))", ("files",))
def pareto_frontier(files):
    return m.pareto(files, "compile_ms", "size", "file_id")


@query("select count(distinct file_id) missing_keys, count(*) as rows from commit_log where file_id is not null and file_id not in (select file_id from files where is_generated)", (LOG, "files"))
def fk_check(log, files):
    return m.orphans(log, "file_id", files.where("is_generated"), "file_id")


@query(" union all ".join(f"select '{c}' as column, count(*) - count({c}) as nulls, count(*) as rows from identities" for c in ("contributor", "canonical", "team", "is_resolved")), ("identities",))
def null_profile(identities):
    return m.null_profile(identities)


@query("select 'size' as rule, count(*) filter (where not (size between 1 and 45)) as failures from files union all select 'time', count(*) filter (where compile_ms < 0) from files union all select 'kind', count(*) filter (where kind not in ('SMALL', 'LARGE', 'ECONOMY')) from files", ("files",))
def range_check(files):
    return m.check(files, {"size": F.col("size").between(1, 45), "time": F.col("compile_ms") >= 0, "kind": F.col("kind").isin("SMALL", "LARGE", "ECONOMY")})


@query("select file_id, round(case when hi > lo then (compile_ms - lo) / (hi - lo) else 0 end, 6) scaled from files, (select min(compile_ms) lo, max(compile_ms) hi from files)", ("files",))
def minmax_scaled(files):
    return minmax(files.select("file_id", "compile_ms"), scaled="compile_ms").select("file_id", "scaled")


# --- graphs

_CL = CLOSURE


@query(_CL + """, o as (select src, count(*) n from c group by 1), i as (select dst, count(*) n from c group by 1), od as (select src, count(*) n from edges group by 1), id as (select dst, count(*) n from edges group by 1)
 select node, coalesce(id.n, 0) in_degree, coalesce(od.n, 0) out_degree, coalesce(o.n, 0) transitive_dependencies, coalesce(i.n, 0) transitive_dependants
 from nodes left join o on o.src = node left join i on i.dst = node left join od on od.src = node left join id on id.dst = node""", (EDGES, NODES), recursive=True)  # fmt: skip
def closure_counts(edges, nodes):
    return g.reach(nodes, edges)


@query(_CL + "select node, cast(ms + coalesce((select sum(n.ms) from c join nodes n on n.node = c.src where c.dst = x.node), 0) as bigint) as rebuild_ms from nodes x", (EDGES, NODES), recursive=True)
def rebuild_cost(edges, nodes):
    return g.rebuild_cost(nodes, edges)


_LV = """>r(node, level) as (select node, 0 from nodes union select e.{a}, r.level + 1 from r join edges e on e.{b} = r.node)"""


@query(_LV.format(a="src", b="dst") + " select node, max(level) as layer from r group by node", (EDGES, NODES), recursive=True)
def layers(edges, nodes):
    return g.longest(nodes, edges).select("node", F.col("level").alias("layer"))


@query(_LV.format(a="dst", b="src") + " select node, max(level) as depth from r group by node", (EDGES, NODES), recursive=True)
def topological_depth(edges, nodes):
    return g.longest(nodes, g.reverse(edges)).select("node", F.col("level").alias("depth"))


@query("select src, dst, src % 10 as src_layer, dst % 10 as dst_layer, case when src % 10 = dst % 10 then 'lateral' else 'upward' end as violation from edges where dst % 10 >= src % 10", (EDGES,))
def layer_violations(edges):
    own = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", (F.col("node") % 10).alias("layer"))
    return g.layer_violations(edges, own)


_CP = """>f(node, finish) as (select node, ms from nodes union select e.src, f.finish + n.ms from f join edges e on e.dst = f.node join nodes n on n.node = e.src),
 b(node, tail) as (select node, ms from nodes union select e.dst, b.tail + n.ms from b join edges e on e.src = b.node join nodes n on n.node = e.dst),
 x as (select node, max(finish) finish from f group by 1), y as (select node, max(tail) tail from b group by 1), t as (select max(finish) total from x)"""


@query(_CP + " select n.node, ms as cost, finish - ms as start, finish, total - finish - tail + ms as slack, total - finish - tail + ms = 0 as critical from nodes n join x using (node) join y using (node), t", (EDGES, NODES), recursive=True)
def critical_path(edges, nodes):
    return g.critical_path(nodes, edges)


@query(_CP.replace("select node, ms from nodes", "select node, m from nn").replace("n.ms", "n.m").replace("join nodes n", "join nn n").replace(">f(", ">nn as (select node, case when node % 7 = 0 then cast(floor(ms * 0.5) as bigint) else ms end m from nodes), f(") + " select total as length_ms from t", (EDGES, NODES), recursive=True)
def whatif_reduce(edges, nodes):
    faster = nodes.withColumn("ms", F.when(F.col("node") % 7 == 0, F.floor(F.col("ms") * 0.5).cast("long")).otherwise(F.col("ms")))
    return g.longest(faster, edges, "ms").agg(F.max("finish").alias("length_ms"))


@query(">c(node, label) as (select node, node from nodes union select case when e.src = c.node then e.dst else e.src end, c.label from c join edges e on e.src = c.node or e.dst = c.node) select node, min(label) as component from c group by node", (EDGES, NODES), recursive=True)
def components(edges, nodes):
    return g.components(nodes, edges)


@query("""select count(*) nodes, (select count(*) from edges) edges, round((select count(*) from edges) / (count(*) * (count(*) - 1.0)), 6) density,
 (select max(n) from (select count(*) n from edges group by src)) max_out, (select max(n) from (select count(*) n from edges group by dst)) max_in from nodes""", (EDGES, NODES))  # fmt: skip
def graph_summary(edges, nodes):
    d = g.degrees(nodes, edges)
    return d.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), (F.sum("out_degree") / (F.count("*") * (F.count("*") - 1.0))).alias("density"), F.max("out_degree").alias("max_out"), F.max("in_degree").alias("max_in"))


@query(None, (EDGES, NODES))
def louvain(edges, nodes):
    return g.communities(nodes, edges)


@query(None, (EDGES, NODES))
def simulate_build(edges, nodes):
    spark = nodes.sparkSession
    runs = spark.createDataFrame([(f"{c} cores", c) for c in (1, 2, 4, 8, 16, 32, 64)], "scenario string, cores int")
    return g.simulate(nodes, edges, runs).groupBy("scenario").agg(F.max("end_ms").alias("wall_ms"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("work_ms"), F.count("*").alias("steps"))


@query(""">e as (select a.target a, b.target b from edges join nodes a on a.node = src join nodes b on b.node = dst), i as (select a p, count(*) l from e where a = b group by 1),
 d as (select p, count(*) d from (select a p from e union all select b from e) group by 1), t as (select count(*) m, count(*) filter (where a <> b) x from e)
 select round(sum(coalesce(l, 0) / m - pow(d / (2.0 * m), 2)), 6) modularity, round(max(x) / max(m), 6) between_fraction, count(*) parts from d left join i using (p), t""", (EDGES, NODES))  # fmt: skip
def modularity(edges, nodes):
    return g.modularity(edges, nodes.select("node", F.col("target").alias("part")))


@query(""">c as (select target a, kind b, count(*) n from nodes group by 1, 2), ra as (select a, sum(n) r from c group by 1), cb as (select b, sum(n) s from c group by 1), t as (select sum(n) t from c),
 z as (select sum(n * (n - 1) / 2) s, sum(n / t * ln(n * t / (r * cb.s))) mi, max(t) t from c join ra using (a) join cb using (b), t),
 za as (select sum(r * (r - 1) / 2) sa, -sum(r / t * ln(r / t)) ha from ra, t), zb as (select sum(s * (s - 1) / 2) sb, -sum(s / t * ln(s / t)) hb from cb, t)
 select round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) ari, round(mi / ((ha + hb) / 2), 6) nmi from z, za, zb""", (NODES,))  # fmt: skip
def ari_nmi(nodes):
    return g.agreement(nodes.select("node", F.col("target").alias("part")), nodes.select("node", F.col("kind").alias("part")))


_ME = ">e as (select a.target ma, b.target mb, a.kind ka, b.kind kb from edges join nodes a on a.node = src join nodes b on b.node = dst)"


def _module_edges(edges, nodes):
    a = nodes.select(F.col("node").alias("src"), F.col("target").alias("ma"), F.col("kind").alias("ka"))
    b = nodes.select(F.col("node").alias("dst"), F.col("target").alias("mb"), F.col("kind").alias("kb"))
    return edges.join(a, "src").join(b, "dst")


@query(_ME + " select ka as from_kind, kb as to_kind, count(*) as edges from e where ka <> kb group by 1, 2", (EDGES, NODES))
def cross_category(edges, nodes):
    return _module_edges(edges, nodes).where("ka <> kb").groupBy(F.col("ka").alias("from_kind"), F.col("kb").alias("to_kind")).agg(F.count("*").alias("edges"))


@query(_CL + """, own as (select target m, node from nodes), b as (select m, node from own union select m, dst from own join c on c.src = node),
 x as (select m, count(*) build_set, cast(sum(ms) as bigint) build_ms, count(*) filter (where target <> m) external_deps from b join nodes using (node) group by 1)
 select m as module, build_set, build_ms, external_deps, round(build_set / (select count(*) from nodes), 6) build_fraction from x""", (EDGES, NODES), recursive=True)  # fmt: skip
def feature_configs(edges, nodes):
    own = nodes.select(F.col("target").alias("module"), "node")
    more = own.join(g.closure(edges).withColumnRenamed("src", "node"), "node").select("module", F.col("dst").alias("node"))
    every = own.union(more).distinct().join(nodes, "node")
    total = nodes.agg(F.count("*").alias("total"))
    out = every.groupBy("module").agg(F.count("*").alias("build_set"), F.sum("ms").alias("build_ms"), F.count_if(F.col("target") != F.col("module")).alias("external_deps"))
    return out.crossJoin(F.broadcast(total)).select("module", "build_set", "build_ms", "external_deps", (F.col("build_set") / F.col("total")).alias("build_fraction"))


@query(""">d as (select dst as file_id, count(*) dependants from edges group by 1), t as (select f.file_id, compile_ms ms, commits, coalesce(dependants, 0) dependants from file_metrics f left join d using (file_id)),
 s as (select *, ln(1 + commits) lc, ln(1 + dependants) ld from t), x as (select min(ms) a, max(ms) b, min(lc) c, max(lc) d, min(ld) e, max(ld) f from s)
 select file_id, ms, commits, dependants, round(case when b > a then (ms - a) / (b - a) else 0 end * case when d > c then (lc - c) / (d - c) else 0 end * case when f > e then (ld - e) / (f - e) else 0 end, 6) score from s, x""", (FILES, EDGES))  # fmt: skip
def hotspots(files, edges):
    users = edges.groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("dependants"))
    t = files.join(users, "file_id", "left").select("file_id", F.col("compile_ms").alias("ms"), "commits", F.coalesce("dependants", F.lit(0)).alias("dependants"))
    return m.refactor_hotspots(t)


@query(_CL + ", u as (select dst, count(*) n from c group by 1) select file_id, cast(coalesce(n, 0) * size * (1.0 + commits) as double) impact from file_metrics left join u on dst = file_id", (EDGES, FILES), recursive=True)
def header_impact(edges, files):
    fan = g.closure(edges).groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("n"))
    return files.join(fan, "file_id", "left").select("file_id", (F.coalesce("n", F.lit(0)) * F.col("size") * (1.0 + F.col("commits"))).alias("impact"))


# --- snapshots


@query("select label, count(*) targets, cast(sum(files) as bigint) files, cast(sum(build_ms) as bigint) build_ms, max(build_ms) slowest, cast(sum(authors) as bigint) authors, round(sum(build_ms) / sum(files), 6) ms_per_file, cast(lag(sum(build_ms)) over (order by label) as bigint) build_ms_before from snapshots group by label", ("snapshots",))
def trend(snapshots):
    return m.trend(snapshots)


_LAST = "(select max(label) from snapshots)"


@query(f""">b as (select target, build_ms before from snapshots where label = {_LAST} - 1), a as (select target, build_ms after from snapshots where label = {_LAST})
 select target, before, after, coalesce(after, 0) - coalesce(before, 0) delta, round((after - before) * 100.0 / before, 6) pct,
 case when before is null then 'new' when after is null then 'removed' when after < before then 'improved' when after > before then 'regressed' else 'unchanged' end status from b full join a using (target)""", ("snapshots",))  # fmt: skip
def target_deltas(snapshots):
    last = snapshots.agg(F.max("label").alias("last"))
    s = snapshots.crossJoin(F.broadcast(last))
    return m.target_deltas(s.where("label = last - 1"), s.where("label = last"), "target", "build_ms")


@query(">p as (select min(ts) a, max(ts) b from commit_log)," + _CL.lstrip(">") + """, r as (select node, cast(ms + coalesce((select sum(n.ms) from c join nodes n on n.node = c.src where c.dst = x.node), 0) as bigint) rebuild_ms from nodes x),
 k as (select file_id node, count(distinct commit_id) n from commit_log group by 1)
 select node, rebuild_ms, round(coalesce(n, 0) / 120.0, 4) commits_a_day, cast(floor(coalesce(n, 0) / 120.0 * rebuild_ms) as bigint) daily_ms from r left join k using (node)""", (EDGES, NODES, LOG), recursive=True)  # fmt: skip
def daily_cost(edges, nodes, log):
    changes = log.groupBy(F.col("file_id").alias("node")).agg(F.countDistinct("commit_id").alias("commits"))
    return rc.daily_cost(g.rebuild_cost(nodes, edges), changes, months=6)


@query(_CL + """, u as (select dst, count(*) fan from c group by 1), d as (select dst, count(*) direct from edges group by 1),
 x as (select file_id item, fan * size * 0.3 / 1e6 impact, cast(greatest(0.5, least(20.0, direct * 0.5)) as double) effort, 0.4 + 0.2 * least(1.0, fan / 500) confidence from files join u on u.dst = file_id join d on d.dst = file_id)
 select 'split_header' as type, item, round(impact, 6) impact, round(effort, 6) effort, round(confidence, 6) confidence from x where impact > 0 order by impact desc, item limit 20""", (EDGES, "files"), recursive=True)  # fmt: skip
def header_interventions(edges, files):
    fan = g.closure(edges).groupBy(F.col("dst").alias("header")).agg(F.count("*").alias("fan_in"))
    direct = edges.groupBy(F.col("dst").alias("header")).agg(F.count("*").alias("direct"))
    return rc.header_interventions(files.select(F.col("file_id").alias("header"), "size").join(fan, "header").join(direct, "header"))


from . import consolidation, includes, readers, scenarios, sharing, snapshots  # noqa: E402, F401  register theirs


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
