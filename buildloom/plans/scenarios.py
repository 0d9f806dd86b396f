"""Queries of what-if questions, schedules, rebuilds and centrality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import recommend as rc
from ..operators import replay as rp
from ..operators import scope as sc
from .includes import ranks
from .registry import CLOSURE, query

EDGES, NODES, LOG = "edges", "nodes", "commit_log"
_KIND = "case node % 10 when 0 then 'interface_library' when 1 then 'executable' when 2 then 'shared_library' else 'static_library' end"
_CP = """>f(node, finish) as (select node, ms from nodes union select e.src, f.finish + n.ms from f join edges e on e.dst = f.node join nodes n on n.node = e.src),
 b(node, tail) as (select node, ms from nodes union select e.dst, b.tail + n.ms from b join edges e on e.src = b.node join nodes n on n.node = e.dst),
 x as (select node, max(finish) finish from f group by 1), y as (select node, max(tail) tail from b group by 1), t as (select max(finish) total from x),
 cp as (select n.node, ms, target, finish - ms as start, finish, total - finish - tail + ms as slack from nodes n join x using (node) join y using (node), t)"""


def kinds(nodes):
    return nodes.withColumn("kind", F.expr(_KIND))


@query(_CP + " select node, slack, ms, target from cp where slack > 0 and slack <= 100000", (EDGES, NODES), recursive=True)
def near_critical(edges, nodes):
    rows = g.critical_path(nodes, edges).where("not critical and slack <= 100000")
    return rows.join(nodes.select("node", "ms", "target"), "node").select("node", "slack", "ms", "target")


@query(f">k as (select node, case when {_KIND} = 'interface_library' then 0 else 1 end own from nodes), r(node, w) as (select node, own from k union select e.src, r.w + k.own from r join edges e on e.dst = r.node join k on k.node = e.src) select node, max(w) as weight from r group by 1", (EDGES, NODES), recursive=True)
def scheduler_weights(edges, nodes):
    return g.chain_weights(kinds(nodes), edges)


@query(f"select node, case when {_KIND} in ('executable', 'shared_library') then 'link_pool' else 'default' end as pool from nodes", (NODES,))
def pool_assignment(nodes):
    return g.pools(kinds(nodes), 4)


@query(_CP + ", s as (select cast(sum(ms) as bigint) work, count(*) steps from nodes) select 'all cores' as scenario, total as wall_ms, work as work_ms, steps, false as overlap from t, s union all select 'one core', work, work, steps, false from s", (EDGES, NODES), recursive=True)
def simulate_bounds(edges, nodes):
    # one core works without a pause, and with a core for each node the longest chain decides
    n = nodes.count()
    runs = nodes.sparkSession.createDataFrame([("one core", 1), ("all cores", n)], "scenario string, cores int")
    plan = g.simulate(nodes, edges, runs)
    free = F.lag("end_ms").over(g.Window.partitionBy("scenario", "core").orderBy("start_ms", "end_ms"))
    plan = plan.withColumn("overlap", F.coalesce(free > F.col("start_ms"), F.lit(False)))
    return plan.groupBy("scenario").agg(F.max("end_ms").alias("wall_ms"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("work_ms"), F.count("*").alias("steps"), F.bool_or("overlap").alias("overlap"))


_MOST = "(select src from (select src, count(*) n from edges group by 1 order by n desc, src limit 1))"


@query(f""">cl(src, dst) as (select src, dst from edges union select cl.src, e.dst from cl join edges e on e.src = cl.dst), ins as (select {_MOST} as node union select dst from cl where src = {_MOST}),
 mm as (select node, ms from nodes join ins using (node)), f(node, finish) as (select node, ms from mm union select e.src, f.finish + n.ms from f join edges e on e.dst = f.node join mm n on n.node = e.src)
 select (select count(*) from mm) as steps, max(finish) as wall_ms from f""", (EDGES, NODES), recursive=True)  # fmt: skip
def simulate_target(edges, nodes):
    target = edges.groupBy("src").count().orderBy(F.desc("count"), "src").head()[0]
    runs = nodes.sparkSession.createDataFrame([("all", nodes.count())], "scenario string, cores int")
    return g.simulate(nodes, edges, runs, target=target).agg(F.count("*").alias("steps"), F.max("end_ms").alias("wall_ms"))


@query(None, (EDGES, NODES))
def core_and_pool_sweep(edges, nodes):
    """Wall time, efficiency against linear speed-up, and what a pool of 4 links costs, for numbers of cores."""
    cores = [1, 2, 4, 8, 16, 32, 64]
    runs = nodes.sparkSession.createDataFrame([(f"{c}/{d}", c, d) for c in cores for d in (0, 4)], "scenario string, cores int, link_depth int")
    wall = g.simulate(kinds(nodes), edges, runs).groupBy("scenario").agg(F.max("end_ms").alias("wall_ms"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("work_ms"))
    rows = runs.join(wall, "scenario")
    pooled = rows.where("link_depth > 0").select("cores", F.col("wall_ms").alias("pooled_ms"))
    out = rows.where("link_depth = 0").join(pooled, "cores")
    return out.select("cores", "wall_ms", F.try_divide(F.col("work_ms") / F.col("cores"), "wall_ms").alias("efficiency"), "pooled_ms", F.try_divide((F.col("pooled_ms") - F.col("wall_ms")) * 100.0, "wall_ms").alias("overhead_pct"))


@query(_CP + """, ob as (select file_id % 50 as node, min(compile_ms) start_ms, max(compile_ms + size) end_ms from files group by 1), w as (select sum(ms) work, count(*) n from nodes), os as (select max(end_ms) wall, sum(end_ms - start_ms) work from ob)
 select total as simulated_wall_ms, wall as observed_wall_ms, round(abs(total - wall) * 100.0 / wall, 6) error_pct, abs(total - wall) * 100.0 / wall <= 10 as within_tolerance, round(os.work / wall, 6) observed_utilisation from t, w, os""", (EDGES, NODES, "files"), recursive=True)  # fmt: skip
def schedule_validation(edges, nodes, files):
    runs = nodes.sparkSession.createDataFrame([("all", nodes.count())], "scenario string, cores int")
    seen = files.select((F.col("file_id") % 50).alias("node"), F.col("compile_ms").alias("start_ms"), (F.col("compile_ms") + F.col("size")).alias("end_ms"))
    return rp.compare_schedules(g.simulate(nodes, edges, runs), seen).drop("simulated_utilisation")


#: longest chains without each edge that lies on a critical one: the chains are followed anew for each
_WITHOUT = _CP + """, tight as (select e.src, e.dst from edges e join cp a on a.node = e.src join cp z on z.node = e.dst where a.slack = 0 and z.slack = 0), w(s, d, node, finish) using key (s, d, node) as (select src, dst, node, ms from tight, nodes union
  select q.s, q.d, q.node, max(q.f) from (select w.s, w.d, e.src node, w.finish + n.ms f from w join edges e on e.dst = w.node join nodes n on n.node = e.src where not (e.src = w.s and e.dst = w.d)) q
  join recurring.w r on r.s = q.s and r.d = q.d and r.node = q.node where q.f > r.finish group by q.s, q.d, q.node), z as (select s, d, max(finish) without_ms from w group by 1, 2)"""


@query(_WITHOUT + " select s as src, d as dst, total as length_ms, without_ms from z, t", (EDGES, NODES), recursive=True)
def whatif_remove_edges(edges, nodes):
    at = g.critical_path(nodes, edges).where("critical").select("node")
    both = edges.join(at.select(F.col("node").alias("src")), "src", "left_semi").join(at.select(F.col("node").alias("dst")), "dst", "left_semi")
    return g.lengths_without(nodes, edges, both)


@query(_WITHOUT + """, r as (select s src, d dst, total - without_ms impact, weight % 2 = 0 as public from z join edges on edges.src = s and edges.dst = d, t where total > without_ms order by 3 desc, 1, 2 limit 20)
 select case when public then 'narrow_visibility' else 'remove_dependency' end as type, src, dst, impact, round(cast(greatest(0.5, least(10.0, size * 0.1)) as double), 6) effort, cast(0.7 as double) as confidence from r join files on file_id = src""", (EDGES, NODES, "files"), recursive=True)  # fmt: skip
def dependency_interventions(edges, nodes, files):
    seen = edges.withColumn("visibility", F.when(F.col("weight") % 2 == 0, "PUBLIC").otherwise("PRIVATE"))
    return rc.dependency_interventions(nodes, seen, files.select(F.col("file_id").alias("node"), F.col("size").alias("files")))


_SLOW = "(select node from nodes order by ms desc, node limit 1)"


@query(_CP + f""", n2 as (select node, case when node = {_SLOW} then cast(floor(ms * 0.7) as bigint) else ms end ms from nodes), f2(node, finish) as (select node, ms from n2 union select e.src, f2.finish + n.ms from f2 join edges e on e.dst = f2.node join n2 n on n.node = e.src)
 select total as before_ms, (select max(finish) from f2) as after_ms, total - (select max(finish) from f2) as saved_ms from t""", (EDGES, NODES), recursive=True)  # fmt: skip
def whatif_reduce_one(edges, nodes):
    slowest = nodes.orderBy(F.desc("ms"), "node").head()["node"]
    return rc.whatif_reduce(nodes, edges, slowest, 30)


_TT = """tt as (select target node, cast(sum(duration_ms) as bigint) total_ms, cast(coalesce(sum(duration_ms) filter (where step_type = 'archive'), 0) as bigint) archive_ms, cast(coalesce(sum(duration_ms) filter (where step_type = 'link'), 0) as bigint) link_ms, count(*) files from target_steps group by 1)"""


def _totals(steps):
    of = lambda k: F.coalesce(F.sum(F.when(F.col("step_type") == k, F.col("duration_ms"))), F.lit(0)).alias(f"{k}_ms")
    return steps.groupBy(F.col("target").alias("node")).agg(F.sum("duration_ms").alias("total_ms"), of("archive"), of("link"), F.count("*").alias("files"))


@query(f""">{_TT}, gr as (select split_part(node, '/', 1) g, node, row_number() over (partition by split_part(node, '/', 1) order by node) k from tt),
 i as (select a.g, count(*) n from target_edges join gr a on a.node = src join gr b on b.node = dst and b.g = a.g group by 1)
 select g as "group", count(*) targets, cast(sum(total_ms) as bigint) before_ms, cast(sum(total_ms) - sum(case when k > 1 then archive_ms + link_ms else 0 end) as bigint) after_ms, cast(sum(case when k > 1 then archive_ms + link_ms else 0 end) as bigint) savings_ms, coalesce(max(i.n), 0) inter_edges
 from gr join tt using (node) left join i using (g) group by 1""", ("target_steps", "target_edges"))  # fmt: skip
def merge_simulation(steps, edges):
    t = _totals(steps)
    groups = t.select(F.split("node", "/")[0].alias("group"), F.col("node").alias("ord"), "node")
    return rc.merges(groups, t, edges)


@query(f""">{_TT}, q as (select quantile_cont(total_ms, 0.25) q from tt), sm as (select node, total_ms, archive_ms, link_ms from tt, q where total_ms < q), se as (select node from sm order by node limit 50)
 select src, dst, a.total_ms + b.total_ms as before_ms, a.total_ms + b.total_ms - b.archive_ms - b.link_ms as after_ms, b.archive_ms + b.link_ms as savings_ms, 1 as inter_edges from target_edges join sm a on a.node = src join sm b on b.node = dst where src in (select node from se) and b.archive_ms + b.link_ms > 0""", ("target_steps", "target_edges"))  # fmt: skip
def merge_candidates(steps, edges):
    return rc.merge_candidates(_totals(steps), edges)


@query(f""">{_TT}, pt as (select target node, file_id % 3 as partition, count(*) partition_files from paths group by 1, 2) select node, partition, partition_files, count(*) over (partition by node) partitions, count(*) over (partition by node) - 1 cross_edges, total_ms, files from pt join tt using (node)""", ("target_steps", "paths"))
def split_simulation(steps, paths):
    groups = paths.select(F.col("target").alias("node"), (F.col("file_id") % 3).alias("partition"), F.col("path").alias("file"))
    return rc.splits(groups, _totals(steps))


@query(_CP + " select 'split_target' as type, cast(node as varchar) item, round(cast(ms * 0.4 as double), 6) impact, round(cast(greatest(1.0, least(30.0, size * 0.3)) as double), 6) effort, cast(0.5 as double) as confidence from (select * from cp join files on file_id = node where slack = 0 and size >= 4 order by ms desc, node limit 20)", (EDGES, NODES, "files"), recursive=True)
def split_interventions(edges, nodes, files):
    return rc.split_interventions(nodes, edges, files.select(F.col("file_id").alias("node"), F.col("size").alias("files")))


@query(CLOSURE + """, t as (select distinct commit_id, file_id node from commit_log), s as (select commit_id, node from t union select commit_id, c.src from t join c on c.dst = t.node) select commit_id, count(*) rebuilt, cast(sum(ms) as bigint) work_ms from s join nodes using (node) group by 1""", (EDGES, NODES, LOG), recursive=True)
def rebuild_sets(edges, nodes, log):
    sets = rp.rebuild_sets(log.select("commit_id", F.col("file_id").alias("node")), g.closure(edges))
    return sets.join(nodes, "node").groupBy("commit_id").agg(F.count("*").alias("rebuilt"), F.sum("ms").alias("work_ms"))


@query(CLOSURE + """, t as (select distinct commit_id, file_id node from commit_log), s as (select commit_id, node from t union select commit_id, c.src from t join c on c.dst = t.node),
 f(commit_id, node, finish) using key (commit_id, node) as (select commit_id, node, ms from s join nodes using (node) union select q.commit_id, q.node, max(q.x) from (select f.commit_id, e.src node, f.finish + n.ms x from f join edges e on e.dst = f.node join nodes n on n.node = e.src) q
  join recurring.f r on r.commit_id = q.commit_id and r.node = q.node where q.x > r.finish group by q.commit_id, q.node)
 select commit_id, (select count(*) from t where t.commit_id = f.commit_id) modified, count(distinct node) rebuilt, max(finish) build_ms from f group by commit_id""", (EDGES, NODES, LOG), recursive=True)  # fmt: skip
def replayed_commits(edges, nodes, log):
    return rp.replay(log.select("commit_id", F.col("file_id").alias("node")), nodes, edges)


@query(CLOSURE + ", d as (select src, count(*) n from c group by 1), o as (select src, count(*) n from edges group by 1) select node, coalesce(o.n, 0) direct, coalesce(d.n, 0) transitive, round(coalesce(d.n, 0) / (select count(*) from nodes), 6) fraction from nodes left join d on d.src = node left join o on o.src = node", (EDGES, NODES), recursive=True)
def dependency_fractions(edges, nodes):
    n = nodes.agg(F.count("*").alias("n"))
    rows = g.reach(nodes, edges).crossJoin(F.broadcast(n))  # one row
    return rows.select("node", F.col("out_degree").alias("direct"), F.col("transitive_dependencies").alias("transitive"), (F.col("transitive_dependencies") / F.col("n")).alias("fraction"))


_B = """>ds(s, v, d) as (select src, dst, 1 from edges union select s, e.dst, d + 1 from ds join edges e on e.src = v), m as (select s, v, min(d) d from ds group by 1, 2),
 sg(s, v, d, n) as (select src, dst, 1, cast(1 as double) from edges union all select s, v, d, sum(n) from (select p.s, e.dst v, p.d + 1 d, p.n from sg p join edges e on e.src = p.v join m on m.s = p.s and m.v = e.dst and m.d = p.d + 1) group by s, v, d),
 bt as (select x.v node, sum(x.n * y.n / z.n) b from sg x join sg y on y.s = x.v join sg z on z.s = x.s and z.v = y.v and z.d = x.d + y.d group by 1), nn as (select count(*) n from nodes)"""


@query(_B + " select node, round(coalesce(b, 0) / ((n - 1.0) * (n - 2.0)), 6) betweenness from nodes left join bt using (node), nn", (EDGES, NODES), recursive=True)
def betweenness(edges, nodes):
    return g.betweenness(nodes, edges)


_R = ", " + ranks("edges", "nodes", 20)


@query(_R.replace(", ", ">", 1) + " select node, round(rank, 6) as rank from r20", (EDGES, NODES))
def pagerank(edges, nodes):
    return g.pagerank(nodes, edges, rounds=20, tolerance=None)


@query(_B + _R + """, i as (select dst node, count(*) n from edges group by 1), o as (select src node, count(*) n from edges group by 1)
 select node, coalesce(i.n, 0) in_degree, coalesce(o.n, 0) out_degree, round(coalesce(b, 0) / ((nn.n - 1.0) * (nn.n - 2.0)), 6) betweenness, round(rank, 6) pagerank from nodes left join bt using (node) join r20 using (node) left join i using (node) left join o using (node), nn""", (EDGES, NODES), recursive=True)  # fmt: skip
def centrality(edges, nodes):
    return g.centrality(nodes, edges, rounds=20, tolerance=None)


@query(_B + " select node, round(coalesce(b, 0) / ((n - 1.0) * (n - 2.0)) * ln(1 + ms), 6) priority from nodes left join bt using (node), nn", (EDGES, NODES), recursive=True)
def priority_scores(edges, nodes):
    return rc.priorities(g.betweenness(nodes, edges), nodes)


@query(f""">l(node, level) as (select node, 0 from nodes union select e.src, l.level + 1 from l join edges e on e.dst = l.node), i as (select dst node, count(*) n from edges group by 1), o as (select src node, count(*) n from edges group by 1), k as (select node, {_KIND} kind from nodes)
 select count(*) nodes, cast(sum(coalesce(o.n, 0)) as bigint) edges, round(sum(coalesce(o.n, 0)) / (count(*) * (count(*) - 1.0)), 6) density, count(*) filter (where kind = 'executable') executables, count(*) filter (where kind like '%library%') libraries, round(avg(coalesce(i.n, 0)), 6) mean_in,
 round(avg(coalesce(o.n, 0)), 6) mean_out, max(coalesce(i.n, 0)) max_in, max(coalesce(o.n, 0)) max_out, (select max(level) from l) max_depth, true as is_dag from k left join i using (node) left join o using (node)""", (EDGES, NODES), recursive=True)  # fmt: skip
def dependency_summary(edges, nodes):
    return g.summary(kinds(nodes), edges)


@query(CLOSURE + ", s as (select node from nodes where target = 'Brand#11'), i as (select node from s union select c.dst from c join s on s.node = c.src) select e.src, e.dst from edges e where e.src in (select node from i) and e.dst in (select node from i)", (EDGES, NODES), recursive=True)
def closed_subgraph(edges, nodes):
    return g.with_dependencies(nodes, edges, nodes.where("target = 'Brand#11'"))[1].select("src", "dst")


@query("select node, cast(ms as bigint) as ms, src_known from (select node, ms, true as src_known from nodes where target <> 'Brand#11' union all select distinct dst, cast(null as bigint), false from edges where dst in (select node from nodes where target = 'Brand#11') union select distinct src, cast(null as bigint), false from edges where src in (select node from nodes where target = 'Brand#11'))", (EDGES, NODES))
def graph_endpoints(edges, nodes):
    every, _ = g.build_graph(nodes.where("target <> 'Brand#11'").select("node", "ms"), edges)
    return every.select("node", "ms", F.col("ms").isNotNull().alias("src_known"))


@query(CLOSURE + f""", seed as (select node from nodes where node = {_MOST}), rel as (select node from seed union select dst from c where src in (select node from seed))
 select node from rel join nodes using (node) where target like 'Brand#[1-3]%' and ms >= 90005 and kind <> 'SMALL'""", (EDGES, NODES), recursive=True)  # fmt: skip
def resolved_scope(edges, nodes):
    target = edges.groupBy("src").count().orderBy(F.desc("count"), "src").head()[0]
    rows = nodes.withColumn("module", F.col("target"))
    small = [r[0] for r in nodes.select("kind").where("kind <> 'SMALL'").distinct().collect()]  # the few kinds there are
    brands = [r[0] for r in nodes.select("target").where("target rlike '^Brand#[1-3]'").distinct().collect()]  # 25 brands at most
    return sc.resolve(rows, edges, dependencies_of=[target], modules=brands, types=small, min_build_ms=90005)


from .registry import SQL  # noqa: E402

SQL["resolved_scope"] = SQL["resolved_scope"].replace("target like 'Brand#[1-3]%'", "regexp_matches(target, '^Brand#[1-3]')")


@query("""select 'min_build' as option, count(*) n from nodes where ms >= 90100 union all select 'directory', count(*) from nodes where target like 'Brand#1%' union all select 'excluded', count(*) from nodes where target <> 'Brand#11' union all select 'type', count(*) from nodes where kind = 'SMALL'""", (EDGES, NODES))
def scope_tiers(edges, nodes):
    rows, spark = nodes.select(F.concat("target", F.lit(":"), "node").alias("node"), F.col("target").alias("directory"), "kind", "ms"), nodes.sparkSession
    asked = {"min_build": {"min_build_ms": 90100}, "directory": {"directories": ["Brand#1"]}, "excluded": {"exclude_globs": ["Brand#11:*"]}, "type": {"types": ["SMALL"]}}
    out = None
    for name, how in asked.items():
        one = sc.resolve(rows, edges, **how).agg(F.lit(name).alias("option"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""select src, dst, used, total, round(used / total, 6) ratio from (select e.src, e.dst, count(distinct h.p) filter (where u.p is not null) used, count(distinct h.p) total from (select src, dst from target_edges) e
 join (select target, file_id p from paths where file_id % 4 in (1, 2)) h on h.target = e.dst left join (select distinct x.target, e2.dst p from edges e2 join paths x on x.file_id = e2.src) u on u.target = e.src and u.p = h.p group by 1, 2) where used / total <= 0.5""", ("target_edges", "paths", EDGES))  # fmt: skip
def thin_dependencies(target_edges, paths, edges):
    headers = paths.where("file_id % 4 in (1, 2)").select(F.col("target").alias("node"), F.col("file_id").alias("header"))
    uses = edges.join(paths.select(F.col("file_id").alias("src"), F.col("target").alias("node")), "src").select("node", F.col("dst").alias("header"))
    return rp.thin_dependencies(target_edges, headers, uses)


@query(""">u as (select distinct x.target, e.dst header from edges e join paths x on x.file_id = e.src) select header, count(*) targets, round(count(*) / (select count(distinct target) from u), 6) fraction, array_to_string(list(target order by target), ',') names from u group by 1 having count(*) > 1""", ("paths", EDGES))
def shared_headers(paths, edges):
    uses = edges.join(paths.select(F.col("file_id").alias("src"), F.col("target").alias("node")), "src").select("node", F.col("dst").alias("header"))
    return rp.shared_headers(uses).withColumn("names", F.array_join("names", ","))
