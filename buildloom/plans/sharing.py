"""Queries of modules, communities, teams, contributors and exported graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import consolidate as co
from ..operators import exports as ex
from ..operators import graph as g
from ..operators import history as h
from ..operators import includes as inc
from ..operators import metrics as mt
from ..operators import modules as md
from ..operators import recommend as rc
from .includes import _C, _F, _G, _P, ROWS, ranks
from .registry import CLOSURE, query
from .scenarios import _B, _CP

LOG, EDGES, NODES, TEDGES = "commit_log", "edges", "nodes", "target_edges"
#: modules of targets: the brand, but for one; brands that begin with 2 are no domain
_AS = """asg as (select distinct target node, case when brand = 'Brand#11' then null else brand end module, case when brand = 'Brand#11' then null when brand like 'Brand#2%' then 'shared' else 'domain' end category from paths),
 rw as (select node, coalesce(module, 'Unassigned') module, coalesce(category, 'unknown') category from asg)"""
_TM = """tm as (select s.cmake_target node, case when right(s.cmake_target, 1) = '0' then 'executable' else 'static_library' end kind, count(*) files, cast(sum(code_lines) as bigint) lines, cast(sum(compile_time_ms) as bigint) compile_ms, cast(sum(git_commit_count) as bigint) commits, cast(sum(git_churn) as bigint) churn,
 cast(sum(preprocessed_bytes) as bigint) bytes, count(*) filter (where is_generated) / count(*) codegen_ratio from sources s group by 1)"""


def assignments(paths):
    none = F.col("brand") == "Brand#11"
    kind = F.when(none, F.lit(None)).when(F.col("brand").startswith("Brand#2"), "shared").otherwise("domain")
    return paths.select(F.col("target").alias("node"), F.when(~none, F.col("brand")).alias("module"), kind.alias("category")).distinct()


def target_rows(sources):
    one = sources.groupBy(F.col("cmake_target").alias("node")).agg(F.count("*").alias("files"), F.sum("code_lines").alias("lines"), F.sum("compile_time_ms").alias("compile_ms"), F.sum("git_commit_count").alias("commits"), F.sum("git_churn").alias("churn"), F.sum("preprocessed_bytes").alias("bytes"), (F.count_if("is_generated") / F.count("*")).alias("codegen_ratio"))
    return one.withColumns({"kind": F.when(F.right("node", F.lit(1)) == "0", "executable").otherwise("static_library"), "ms": F.col("compile_ms"), "link_ms": F.lit(0).cast("long")})


_ME = """me as (select a.module module_a, b.module module_b, count(*) weight, count(*) filter (where visibility = 'PUBLIC') public_count, count(*) filter (where visibility = 'PRIVATE') private_count, bool_or(a.module <> b.module and a.category = 'domain' and b.category = 'domain') is_cross_category
 from target_edges join rw a on a.node = src join rw b on b.node = dst group by 1, 2), mg as (select x.*, exists (select 1 from me y where y.module_a = x.module_b and y.module_b = x.module_a) is_bidirectional from me x)"""


@query(f">{_AS}, {_ME} select * from mg", (TEDGES, "paths"))
def module_graph(edges, paths):
    return md.module_edges(edges, md.assigned(paths.select(F.col("target").alias("node")).distinct(), assignments(paths)))


_MM = """cr as (select node from (select node, row_number() over (order by compile_ms desc, node) k from tm) where k <= 10), on_ as (select tm.*, rw.module, rw.category, cr.node is not null critical from tm join rw using (node) left join cr using (node)),
 ee as (select a.module ma, b.module mb from target_edges join rw a on a.node = src join rw b on b.node = dst), ow as (select ma module, count(*) filter (where ma = mb) i, count(*) filter (where ma <> mb) x, count(distinct mb) filter (where ma <> mb) d from ee group by 1), us as (select mb module, count(distinct ma) u from ee where ma <> mb group by 1),
 mm as (select module, min(category) category, count(*) target_count, count(*) filter (where kind = 'executable') executable_count, count(*) filter (where kind <> 'executable') library_count, cast(sum(files) as bigint) file_count, cast(sum(lines) as bigint) total_sloc, cast(sum(compile_ms) as bigint) total_build_time_ms,
  avg(codegen_ratio) codegen_ratio, count(*) filter (where critical) critical_path_target_count, coalesce(max(i), 0) internal_dep_count, coalesce(max(x), 0) external_dep_count, coalesce(max(d), 0) dependency_module_count, coalesce(max(u), 0) dependant_module_count, coalesce(max(i) / nullif(max(i) + max(x), 0), 1.0) self_containment
  from on_ left join ow using (module) left join us using (module) group by module)"""


def _metrics(sources, edges, paths):
    rows = target_rows(sources)
    critical = rows.orderBy(F.desc("compile_ms"), "node").limit(10).select("node")
    return md.module_metrics(md.assigned(rows, assignments(paths)), edges, critical)


@query(f">{_AS}, {_TM}, {_MM}" + """ select module, category, target_count, executable_count, library_count, file_count, total_sloc, total_build_time_ms, total_build_time_ms as total_compile_time_ms, 0 as total_link_time_ms, round(codegen_ratio, 6) codegen_ratio, critical_path_target_count,
 internal_dep_count, external_dep_count, dependency_module_count, dependant_module_count, round(self_containment, 6) self_containment, round(target_count / (select count(*) from tm), 6) build_fraction, round(critical_path_target_count / target_count, 6) critical_path_fraction from mm""", ("sources", TEDGES, "paths"))  # fmt: skip
def module_metrics(sources, edges, paths):
    return _metrics(sources, edges, paths)


@query(f">{_AS}, {_TM}, {_MM} select 'restructure_module' as type, module as item, round(self_containment, 6) self_containment from mm where self_containment < 0.5 order by module limit 5", ("sources", TEDGES, "paths"))
def low_containment_modules(sources, edges, paths):
    return rc.low_containment(_metrics(sources, edges, paths))


_FC = """tc(src, dst) as (select src, dst from target_edges union select tc.src, e.dst from tc join target_edges e on e.src = tc.dst), pt as (select node, module part from rw), ow_ as (select distinct part, node from pt),
 nd as (select part, dst node from ow_ join tc on tc.src = ow_.node except select part, node from ow_), ev as (select part, node, true own from ow_ union all select part, node, false from nd), of_ as (select node from nd group by 1 having count(*) > 1), sc as (select node from rw where category = 'shared'),
 fc as (select part, count(*) filter (where own) own_targets, count(*) filter (where not own) transitive_deps, count(*) total_build_set, count(*) / (select count(*) from tm) build_fraction, cast(coalesce(sum(compile_ms), 0) as bigint) build_ms, coalesce(sum(compile_ms) / (select sum(compile_ms) from tm), 0) time_fraction,
  count(*) filter (where not own and node in (select node from of_)) shared_deps, count(*) filter (where node in (select node from sc)) shared_core_targets from ev left join tm using (node) group by part)"""


@query(f">{_AS}, {_TM}, {_FC} select part, own_targets, transitive_deps, total_build_set, round(build_fraction, 6) build_fraction, build_ms, round(time_fraction, 6) time_fraction, shared_deps, shared_core_targets, round(shared_core_targets / total_build_set, 6) shared_core_fraction from fc", ("sources", TEDGES, "paths"), recursive=True)
def module_feature_configs(sources, edges, paths):
    rows = md.assigned(target_rows(sources), assignments(paths))
    shared = rows.where("category = 'shared'").select(F.col("module").alias("part")).distinct()
    return md.feature_configs(rows, rows.select("node", F.col("module").alias("part")), g.closure(edges), shared)


_Q = """select '{m}' as method, * from (with p as ({p}), e as (select distinct src, dst from target_edges), x as (select a.part a, b.part b from e join p a on a.node = src join p b on b.node = dst), s as (select part, count(*) size from p group by 1),
 en as (select a part, a = b inside from x union all select b, a = b from x), d as (select part, count(*) d, count(*) filter (where inside) i from en group by 1), t as (select count(*) m, count(*) filter (where a <> b) bt from x)
 select round(sum(coalesce(i, 0) / 2 / m - pow(coalesce(d, 0) / (2.0 * m), 2)), 6) modularity, round(max(bt / m), 6) between_fraction, round(avg(coalesce(i / nullif(d, 0), 1.0)), 6) mean_self_containment, count(*) parts, min(size) least, max(size) most, median(size) median from s left join d using (part), t)"""


@query(f">{_AS} " + _Q.format(m="module", p="select node, module part from rw") + " union all " + _Q.format(m="suffix", p="select node, right(node, 1) part from rw") + " union all " + _Q.format(m="one", p="select node, 'all' part from rw"), (TEDGES, "paths"))
def community_methods(edges, paths):
    rows = md.assigned(paths.select(F.col("target").alias("node")).distinct(), assignments(paths))
    of = lambda part: rows.select("node", part.alias("part"))
    return md.compare_methods(edges, {"module": of(F.col("module")), "suffix": of(F.right("node", F.lit(1))), "one": of(F.lit("all"))})


@query(">n as (select target module, kind community, count(*) n from nodes group by 1, 2) select module, cast(sum(n) as bigint) targets, arg_min(community, struct_pack(a := -n, b := community)) dominant_community, round(max(n) / sum(n), 6) fraction_in_dominant, count(*) communities, count(*) >= 3 fragmented from n group by 1", (NODES,))
def module_alignment(nodes):
    return md.alignment(nodes.select("node", F.col("kind").alias("part")), nodes.select("node", F.col("target").alias("part")))


@query("select kind as community, count(distinct target) modules from nodes group by 1 having count(distinct target) >= 3", (NODES,))
def merged_communities(nodes):
    return md.merged_communities(nodes.select("node", F.col("kind").alias("part")), nodes.select("node", F.col("target").alias("part")))


@query(""">b as (select distinct node, near from (select src node, dst near from target_edges union all select dst, src from target_edges union all select target, target from paths)), z as (select node, count(*) n from b group by 1),
 p as (select x.node a, y.node b, count(*) k from b x join b y using (near) where x.node < y.node group by 1, 2) select a, b, round(1 - k / (x.n + y.n - k), 6) distance from p join z x on x.node = a join z y on y.node = b""", (TEDGES, "paths"))  # fmt: skip
def neighbourhood_distances(edges, paths):
    return md.neighbourhood_distances(paths.select(F.col("target").alias("node")).distinct(), edges)


@query(None, (TEDGES, "paths"))
def target_hierarchy(edges, paths):
    nodes = paths.select(F.col("target").alias("node")).distinct()
    return cl.target_hierarchy(nodes, md.neighbourhood_distances(nodes, edges))


_TEAM = """rs as (select p.target, case when is_resolved then team end team from commit_log l join paths p using (file_id) left join identities using (contributor)), tt as (select target, team, count(*) n from rs where team is not null group by 1, 2), tw as (select target node, arg_min(team, struct_pack(a := -n, b := team)) team from tt group by 1)"""


def _owners(log, paths, identities):
    own = h.team_ownership(h.resolve_identities(log.join(paths.select("file_id", "target"), "file_id"), identities), "target")
    return own.withColumnRenamed("target", "node")


@query(f">{_TEAM} select a.team team_a, b.team team_b, count(*) edge_count, count(*) filter (where visibility = 'PUBLIC') public_edge_count, count(distinct struct_pack(x := src, y := dst)) target_pairs from target_edges join tw a on a.node = src join tw b on b.node = dst group by 1, 2", (LOG, "paths", "identities", TEDGES))
def team_coupling(log, paths, identities, edges):
    return md.team_coupling(edges, _owners(log, paths, identities).select("node", F.col("owning_team").alias("team")))


@query(""">o as (select distinct split_part(path, '/', 2) d, concat('dir:', split_part(path, '/', 2)) as owner from paths where brand <> 'Brand#11') select file_id, case when path like '%.hpp' then 'headers' when path like 'src/brand1/%' then 'first' else owner end module from paths left join o on split_part(path, '/', 2) = d""", ("paths",))
def module_assignment(paths):
    # directories of two depths: the longer prefix decides
    cut = paths.withColumn("words", F.replace("path", F.lit("/"), F.lit(" ")))
    near = F.concat_ws(" ", F.split("words", " ")[0], F.split("words", " ")[1])
    prefixes = cut.where("brand <> 'Brand#11'").select(near.alias("prefix"), F.concat(F.lit("dir:"), F.split("words", " ")[1]).alias("owner")).distinct()
    return md.owner_of(cut, [("headers", "*.hpp"), ("first", "src brand1 *")], prefixes, "words").select("file_id", "module")


@query("select path, case when path like '%.hpp' and path like 'src/brand1/%' then 'first,headers' end as modules from paths where path like '%.hpp' and path like 'src/brand1/%'", ("paths",))
def module_overlaps(paths):
    return md.overlaps(paths, [("headers", "*.hpp"), ("first", "src/brand1/*"), ("headers", "src/*.hpp")], "path").withColumn("modules", F.array_join("modules", ","))


@query(""">pre as (select 'src' as prefix, 'top' as owner union all select distinct concat('src ', lower(replace(brand, '#', ''))), concat('dir:', brand) from paths where file_id % 2 = 0 union all select distinct concat('src ', lower(replace(brand, '#', '')), ' f', file_id, '.cpp'), 'file' from paths where file_id % 4 = 0 and file_id % 3 = 0),
 w as (select file_id, replace(path, '/', ' ') p from paths) select file_id, arg_max(owner, length(prefix)) as owner, arg_max(prefix, length(prefix)) as prefix from w join pre on p = prefix or starts_with(p, prefix || ' ') group by 1""", ("paths",))  # fmt: skip
def longest_prefix_owner(paths):
    from ..operators import metrics as m

    brand = F.concat(F.lit("src "), F.lower(F.replace("brand", F.lit("#"), F.lit(""))))
    owners = paths.sparkSession.createDataFrame([("src", "top")], "prefix string, owner string")
    owners = owners.union(paths.where("file_id % 2 = 0").select(brand, F.concat(F.lit("dir:"), "brand")).distinct()).union(paths.where("file_id % 4 = 0 and file_id % 3 = 0").select(F.concat(brand, F.lit(" f"), "file_id", F.lit(".cpp")), F.lit("file")).distinct())
    words = paths.select("file_id", F.replace("path", F.lit("/"), F.lit(" ")).alias("words"))
    return m.longest_prefix(words, "words", owners).select("file_id", "owner", "prefix")


@query(None, (LOG, "files"))
def contributor_clusters(log, files):
    return cl.hierarchy(h.contributor_matrix(log.join(files.select("file_id", "target"), "file_id"), "target", 10, 5), "contributor", "target", "n")


@query(None, (LOG, "files"))
def contributor_factors(log, files):
    return cl.factor_groups(h.contributor_matrix(log.join(files.select("file_id", "target"), "file_id"), "target", 10, 5), "contributor", "target", "n")


_RISK = """n as (select f.target, contributor, count(distinct commit_id) n from commit_log join paths f using (file_id) group by 1, 2), r as (select *, row_number() over (partition by target order by n, contributor) k from n),
 c as (select target, (2 * sum(k * n) - (count(*) + 1) * sum(n)) / (count(*) * sum(n)) gini, max(n) / sum(n) top_share, count(*) contributors, cast(sum(n) as bigint) commits from r group by 1), b as (select cmake_target target, sum(compile_time_ms) ms from sources group by 1)"""


@query(f">{_RISK} select target, contributors, round(top_share, 6) top_share, round(gini, 6) gini, commits, round(top_share * gini * sqrt(ms), 6) risk from c join b using (target) where contributors <= 500 and top_share >= 0.0055", (LOG, "paths", "sources"))
def ownership_risk(log, paths, sources):
    c = h.concentration(log.join(paths.select("file_id", "target"), "file_id"), "target")
    time = sources.groupBy(F.col("cmake_target").alias("target")).agg(F.sum("compile_time_ms").alias("ms"))
    return mt.ownership_risk(c, time, 500, 0.0055)


@query("""select 'slowest' as view, source_file, cast(compile_time_ms as double) figure from sources union all select 'template', source_file, round(case when compile_time_ms > 0 then compiler_template_instantiation_ms / compile_time_ms else 0 end, 6) from sources where compile_time_ms > 0
 union all select 'bloat', source_file, round(preprocessed_bytes / nullif(source_size_bytes, 0), 6) from sources where source_size_bytes >= 512 union all select 'throughput', source_file, round(code_lines / (compile_time_ms / 1000.0), 6) from sources where code_lines >= 50 and compile_time_ms > 0""", ("sources",))  # fmt: skip
def slow_files(sources):
    files, out = co.derived_ratios(sources).withColumn("compiler_total_time_ms", F.col("compile_time_ms").cast("double")), None
    for view in ("slowest", "template", "bloat", "throughput"):
        one = mt.slow_files(files, view).select(F.lit(view).alias("view"), "source_file", "figure")
        out = one if out is None else out.unionByName(one)
    return out


# --- exported graphs

_OWN = """rw_ as (select l.file_id node, case when is_resolved then canonical end canonical, case when is_resolved then team end team, l.contributor, coalesce(is_resolved, false) r from commit_log l left join identities using (contributor)),
 ot as (select node, count(*) n, count(distinct canonical) filter (where r) + count(distinct contributor) filter (where not r) contributors from rw_ group by 1), on2 as (select node, team, count(*) n from rw_ where team is not null group by 1, 2),
 own as (select ot.node, t.team, coalesce(sq / (ot.n * ot.n), 0) hhi, 1 - coalesce(top / ot.n, 0) cross_, contributors from ot left join (select node, arg_min(team, struct_pack(a := -n, b := team)) team, max(n) top, sum(n * n) sq from on2 group by 1) t using (node))"""
_X1 = _CP + _B.replace(">", ", ", 1) + ", " + ranks("edges", "nodes", 20) + ", " + _OWN + """, cl(src, dst) as (select src, dst from edges union select cl.src, e.dst from cl join edges e on e.src = cl.dst), td as (select src node, count(*) n from cl group by 1), lv(node, level) as (select node, 0 from nodes union select e.src, lv.level + 1 from lv join edges e on e.dst = lv.node), ly as (select node, max(level) layer from lv group by 1),
 i as (select dst node, count(*) n from edges group by 1), o as (select src node, count(*) n from edges group by 1),
 xn as (select n.node, cast(n.node as varchar) as label, n.kind target_type, '' source_directory, case when n.target = 'Brand#11' then 'unassigned' else n.target end as module, case when n.target = 'Brand#11' then 'unknown' else 'domain' end module_category, coalesce(own.team, 'unknown') team, round(coalesce(hhi, 0), 6) ownership_hhi,
  round(coalesce(cross_, 0), 6) cross_team_fraction, coalesce(contributors, 0) contributor_count, round(n.ms / 1000.0, 6) compile_time_s, round(n.ms / 1000.0, 6) total_build_time_s, cast(0 as double) link_time_s, cast(0 as double) codegen_time_s, cast(0 as double) preprocessed_mb, 0 file_count, coalesce(m.code_lines, 0) code_lines, coalesce(m.commits, 0) git_commit_count, 0 git_churn, cast(0 as double) codegen_ratio,
  layer, cast(substring(n.target, 7) as bigint) community, round(coalesce(b, 0) / ((nn.n - 1.0) * (nn.n - 2.0)), 6) betweenness, round(rank, 6) pagerank, coalesce(i.n, 0) in_degree, coalesce(o.n, 0) out_degree, coalesce(td.n, 0) transitive_dep_count, round(coalesce(td.n, 0) / nn.n, 6) transitive_dep_fraction, slack = 0 on_critical_path, round(slack / 1000.0, 6) slack_s
  from nodes n join cp on cp.node = n.node left join own on own.node = n.node left join file_metrics m on m.file_id = n.node join ly on ly.node = n.node left join bt on bt.node = n.node join r20 on r20.node = n.node left join i on i.node = n.node left join o on o.node = n.node left join td on td.node = n.node, nn)"""
_V1 = (EDGES, NODES, LOG, "identities", "file_metrics")


def _dependency(edges, nodes, log, identities, files):
    own = h.team_ownership(h.resolve_identities(log, identities), "file_id").select(F.col("file_id").alias("node"), "owning_team", F.col("team_hhi").alias("ownership_hhi"), "cross_team_fraction", F.col("contributors").alias("contributor_count"))
    known = F.col("target") != "Brand#11"
    targets = nodes.select("node", F.col("kind").alias("target_type"), F.col("ms").alias("total_build_time_ms"), F.when(known, F.col("target")).alias("module"), F.when(known, "domain").alias("module_category"))
    targets = targets.join(files.select(F.col("file_id").alias("node"), F.col("code_lines").alias("code_lines_total"), F.col("commits").alias("git_commit_count_total")), "node", "left")
    layers = g.longest(nodes, edges).select("node", F.col("level").alias("layer"))
    parts = nodes.select("node", F.substring("target", 7, 9).cast("long").alias("community"))
    reach = g.reach(nodes, edges).select("node", "transitive_dependencies")
    return ex.dependency_nodes(targets, [own, layers, parts, g.centrality(nodes, edges, rounds=20, tolerance=None), reach, g.critical_path(nodes, edges).select("node", "critical", "slack")])


@query(_X1 + " select * from xn", _V1, recursive=True)
def export_dependency_nodes(edges, nodes, log, identities, files):
    return _dependency(edges, nodes, log, identities, files)


@query(f">{_OWN}" + """, lv(node, level) as (select node, 0 from nodes union select e.src, lv.level + 1 from lv join edges e on e.dst = lv.node), ly as (select node, max(level) layer from lv group by 1),
 xn as (select n.node, substring(n.target, 7) community, layer, case when n.target = 'Brand#11' then 'unassigned' else n.target end as module, coalesce(own.team, 'unknown') team from nodes n join ly using (node) left join own using (node))
 select src, dst, case when weight % 2 = 0 then 'PUBLIC' else 'PRIVATE' end cmake_visibility, a.community <> b.community is_cross_community, a.layer <= b.layer is_layer_violation, a.module <> b.module is_cross_module, a.module source_module, b.module dest_module, a.team <> b.team is_cross_team from edges join xn a on a.node = src join xn b on b.node = dst""", _V1, recursive=True)  # fmt: skip
def export_dependency_edges(edges, nodes, log, identities, files):
    seen = edges.withColumn("visibility", F.when(F.col("weight") % 2 == 0, "PUBLIC").otherwise("PRIVATE"))
    return ex.dependency_edges(seen, _dependency(edges, nodes, log, identities, files))


@query(f">{_AS}, {_TM}, {_MM}, {_FC}" + """ select module as node, module as label, category, 'unknown' owning_team, target_count, round(total_build_time_ms / 1000.0, 6) total_build_time_s, total_sloc, file_count, round(codegen_ratio, 6) codegen_ratio, round(self_containment, 6) self_containment, internal_dep_count, external_dep_count, critical_path_target_count,
 round(fc.build_fraction, 6) build_fraction from mm join fc on fc.part = module""", ("sources", TEDGES, "paths"), recursive=True)  # fmt: skip
def export_module_nodes(sources, edges, paths):
    rows = md.assigned(target_rows(sources), assignments(paths))
    configs = md.feature_configs(rows, rows.select("node", F.col("module").alias("part")), g.closure(edges)).select(F.col("part").alias("module"), "build_fraction")
    return ex.module_nodes(_metrics(sources, edges, paths), configs)


@query(f">{_AS}, {_ME} select module_a src, module_b dst, cast(weight as bigint) weight, public_count, private_count, is_cross_category, is_bidirectional from mg", (TEDGES, "paths"))
def export_module_edges(edges, paths):
    return ex.module_edges(module_graph(edges, paths))


_X3 = _P + _F + """, on_ as (select node from nn where not is_system), oe as (select src, dst, cast(weight as double) weight from e where src in (select node from on_) and dst in (select node from on_)), """ + ranks("oe", "on_", 20, "weight") + """,
 sx as (select node, max(score) pch from ps group by 1), ho as (select source_file node, cmake_target target, code_lines sloc, source_size_bytes from sources),
 xi as (select nn.node, string_split(nn.node, '/')[-1] as label, nn.node full_path, nn.header is_header, coalesce(ho.sloc, 0) sloc, coalesce(ho.source_size_bytes, 0) source_size_bytes, coalesce(ho.target, 'unknown') cmake_target, coalesce(split_part(ho.target, '/', 1), 'unassigned') as module, 'unknown' team,
  case when s.source_file is null then 'unknown' when s.is_generated then 'GENERATED' else 'HANDWRITTEN' end origin, round(coalesce(rank, 0), 6) pagerank, cast(case when nn.header then fan.transitive_fan_in * coalesce(ho.source_size_bytes, 0) * (1 + coalesce(s.git_commit_count, 0)) else 0 end as double) impact_score,
  case when nn.header then fan.direct_fan_in else 0 end direct_fan_in, case when nn.header then fan.transitive_fan_in else 0 end transitive_fan_in, fan.direct_fan_out, coalesce(s.git_commit_count, 0) git_commits, coalesce(s.git_churn, 0) git_churn, coalesce(s.compile_time_ms, 0) compile_time_ms, coalesce(s.preprocessed_bytes, 0) preprocessed_bytes,
  round(coalesce(s.preprocessed_bytes / nullif(s.source_size_bytes, 0), 0), 6) expansion_ratio, case when regexp_extract(nn.node, '(\\.[^./]*)$', 1) in ('.c', '.cc', '.cpp', '.cxx', '.m', '.mm') and fan.direct_fan_out > 0 then round((select count(*) from c where c.src = nn.node) / fan.direct_fan_out, 6) else 0.0 end amplification_ratio, round(coalesce(pch, 0), 6) pch_candidate_score
  from nn join fan using (node) left join ho using (node) left join sources s on s.source_file = nn.node left join r20 using (node) left join sx using (node) where not nn.is_system)"""


def _includes(rows, sources):
    nodes, edges = inc.include_graph(rows)
    pairs = g.closure(edges)
    sizes = sources.select(F.col("source_file").alias("node"), F.col("cmake_target").alias("target"), F.col("code_lines").alias("sloc"), "source_size_bytes")
    churn = sources.select(F.col("source_file").alias("node"), F.col("git_commit_count").alias("n_commits"))
    files = sources.select(F.col("cmake_target").alias("target"), F.col("source_file").alias("node"), "preprocessed_bytes", "compile_time_ms")
    impact = inc.impact(inc.fan(nodes, edges, pairs), sizes, churn).select("node", F.col("impact_score").cast("double").alias("impact_score"), "direct_fan_in", "transitive_fan_in")
    amplified = inc.amplification(nodes, edges, pairs).select("node", "amplification_ratio")
    pch = inc.pch_candidates(files, pairs, sizes, churn).groupBy("node").agg(F.max("score").alias("pch_score"))
    measured = co.derived_ratios(sources).select(F.col("source_file").alias("node"), "is_generated", "compile_time_ms", "preprocessed_bytes", "expansion_ratio")
    owners = sources.select(F.col("cmake_target").alias("target"), F.split("cmake_target", "/")[0].alias("module")).distinct()
    history = sources.select(F.col("source_file").alias("node"), F.col("git_commit_count").alias("n_commits"), "git_churn")
    return ex.include_nodes(nodes, edges, sizes, [inc.header_rank(nodes, edges, rounds=20, tolerance=None), impact, amplified, pch], measured, history, owners), edges


@query(_X3 + " select * from xi", (ROWS, "sources"), recursive=True)
def export_include_nodes(rows, sources):
    return _includes(rows, sources)[0]


@query(_G + """, x as (select node, coalesce(cmake_target, 'unknown') t, coalesce(split_part(cmake_target, '/', 1), 'unassigned') as m from nn left join sources on source_file = node where not is_system)
 select src, dst, weight, a.t <> b.t is_cross_target, a.m <> b.m is_cross_module, a.m source_module, b.m dest_module from e join x a on a.node = src join x b on b.node = dst""", (ROWS, "sources"))  # fmt: skip
def export_include_edges(rows, sources):
    nodes, edges = _includes(rows, sources)
    return ex.include_edges(edges, nodes)


_CO = """one as (select distinct commit_id, target as item from commit_log join paths using (file_id)), kept as (select * from one where commit_id in (select commit_id from one group by 1 having count(*) <= 50)), tot as (select count(distinct commit_id) total from kept), each as (select item, count(*) n from kept group by 1),
 p as (select a.item item_a, b.item item_b, count(*) together from kept a join kept b using (commit_id) where a.item < b.item group by 1, 2 having count(*) >= 3),
 pq as (select item_a src, item_b dst, together, log2(together * total / (x.n * y.n)) pmi, together / (x.n + y.n - together) jaccard from p join each x on x.item = item_a join each y on y.item = item_b, tot where log2(together * total / (x.n * y.n)) >= 0.5)"""


def _cochange(log, paths, identities, edges, sources):
    rows = log.join(paths.select("file_id", "target"), "file_id")
    t = target_rows(sources)
    targets = t.select("node", F.col("kind").alias("target_type"), F.col("ms").alias("total_build_time_ms"), "codegen_ratio", F.col("lines").alias("code_lines_total"))
    history = t.select("node", F.col("commits").alias("n_commits"), F.col("churn").alias("total_churn"))
    own = _owners(log, paths, identities).select("node", "owning_team", F.col("team_hhi").alias("ownership_hhi"), F.col("contributors").alias("contributor_count"))
    return ex.cochange_graph(h.cochange(rows, "target"), targets, [history, own, assignments(paths).select("node", "module")], edges, 0.5)


_V4 = (LOG, "paths", "identities", TEDGES, "sources")


@query(f">{_CO}, {_AS}, {_TM}, {_TEAM}" + """, nd_ as (select distinct node from (select src node from pq union all select dst from pq)), hh as (select target node, sum(n * n) / pow(max(total), 2) hhi from (select target, team, count(*) n from rs where team is not null group by 1, 2) join (select target, count(*) total from rs group by 1) using (target) group by 1),
 ct as (select p.target node, count(distinct case when is_resolved then canonical end) + count(distinct case when not coalesce(is_resolved, false) then contributor end) contributors from commit_log l join paths p using (file_id) left join identities using (contributor) group by 1)
 select node, node as label, coalesce(kind, 'unknown') target_type, round(coalesce(compile_ms, 0) / 1000.0, 6) total_build_time_s, round(coalesce(codegen_ratio, 0), 6) codegen_ratio, coalesce(lines, 0) code_lines, coalesce(commits, 0) n_commits, coalesce(churn, 0) total_churn, contributors contributor_count, -1 structural_community,
 coalesce(module, 'unassigned') as module, coalesce(team, 'unknown') team, round(coalesce(hhi, 0), 6) ownership_hhi from nd_ left join tm using (node) left join asg using (node) left join tw using (node) left join hh using (node) left join ct using (node)""", _V4)  # fmt: skip
def export_cochange_nodes(log, paths, identities, edges, sources):
    return _cochange(log, paths, identities, edges, sources)[0]


@query(f">{_CO}, {_AS}, {_TEAM}" + """, x as (select asg.node, coalesce(module, 'unassigned') as m, coalesce(team, 'unknown') t from asg left join tw using (node))
 select pq.src, pq.dst, together cochange_count, round(pmi, 6) pmi, round(jaccard, 6) jaccard, a.m <> b.m is_cross_module, a.t <> b.t is_cross_team, exists (select 1 from target_edges z where (z.src = pq.src and z.dst = pq.dst) or (z.src = pq.dst and z.dst = pq.src)) has_structural_edge, a.m source_module, b.m dest_module
 from pq join x a on a.node = pq.src join x b on b.node = pq.dst""", _V4)  # fmt: skip
def export_cochange_edges(log, paths, identities, edges, sources):
    return _cochange(log, paths, identities, edges, sources)[1]
