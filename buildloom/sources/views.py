"""The build-data roles that the registered queries read, derived from the star-schema tables.

Each view is written once, in SQL that both engines read: Spark binds it as a temporary view, and
the check queries take the same text as their common table expressions, so operators alone differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import ship, written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "commit_log": """
        select l_orderkey as commit_id, cast(o_orderdate as timestamp) as ts, o_custkey as contributor, l_partkey as file_id,
               l_linenumber as line_no, cast(l_quantity as bigint) as added, cast(l_linenumber as bigint) as deleted
        from lineitem join orders on l_orderkey = o_orderkey""",
    "files": """
        select p_partkey as file_id, p_name as path, p_brand as target, p_type as kind, cast(p_size as bigint) as size,
               p_size > 40 as is_generated, cast(round(p_retailprice * 100) as bigint) as compile_ms
        from part""",
    "churn": """
        select l_partkey as file_id, cast(count(distinct l_orderkey) as bigint) as commits, cast(sum(cast(l_quantity as bigint)) as bigint) as code_lines
        from lineitem group by l_partkey""",
    "file_metrics": """
        select f.file_id, f.path, f.target, f.kind, f.size, f.is_generated, f.compile_ms,
               coalesce(c.commits, 0) as commits, coalesce(c.code_lines, 0) as code_lines
        from files f left join churn c on f.file_id = c.file_id""",
    "pairs_in_commit": "select distinct l_orderkey as o, l_partkey as p from lineitem",
    "edges": """
        select a.p as src, b.p as dst, cast(count(*) as bigint) as weight
        from pairs_in_commit a join pairs_in_commit b on a.o = b.o where a.p > b.p group by a.p, b.p having count(*) >= 2""",
    "paths": """
        select file_id, target as brand, concat(target, '/', size % 4) as target,
               concat('src/', lower(replace(target, '#', '')), '/f', file_id, case file_id % 4 when 0 then '.cpp' when 1 then '.hpp' when 2 then '.h' else '.cc' end) as path
        from files""",
    "sources": """
        select p.path as source_file, p.target as cmake_target, f.is_generated, case when f.file_id % 7 = 0 then 'C' else 'CXX' end as language, f.compile_ms as compile_time_ms,
               cast(f.compile_ms as double) * 0.4 as compiler_parse_time_ms, cast(f.compile_ms as double) * 0.2 as compiler_template_instantiation_ms,
               cast(f.compile_ms as double) * 0.3 as compiler_codegen_time_ms, cast(f.compile_ms as double) * 0.1 as compiler_optimization_time_ms,
               cast(f.compile_ms as double) * 0.9 as compiler_total_usr_ms, cast(f.compile_ms as double) * 0.1 as compiler_total_sys_ms,
               f.code_lines, f.size % 9 as header_max_depth, f.size as unique_headers, f.size * 3 as total_includes, f.code_lines * 30 as source_size_bytes,
               f.code_lines * 300 + f.size * 1000 as preprocessed_bytes, case when f.file_id % 5 = 0 then null else f.code_lines * 12 + 100 end as object_size_bytes,
               f.commits as git_commit_count, f.code_lines + f.commits as git_churn, f.commits % 5 as git_distinct_authors
        from file_metrics f join paths p on f.file_id = p.file_id""",
    "include_rows": """
        select a.o as unit, x.path as includer, y.path as included, b.p % 11 = 0 as is_system
        from pairs_in_commit a join pairs_in_commit b on a.o = b.o join edges e on e.src = a.p and e.dst = b.p join paths x on x.file_id = a.p join paths y on y.file_id = b.p""",
    "target_edges": """
        select a.target as src, b.target as dst, cast(sum(e.weight) as bigint) as weight, sum(e.weight) % 3 <> 0 as is_direct,
               case when sum(e.weight) % 3 = 0 then 'TRANSITIVE' when sum(e.weight) % 2 = 0 then 'PUBLIC' else 'PRIVATE' end as visibility
        from edges e join paths a on a.file_id = e.src join paths b on b.file_id = e.dst where a.target > b.target group by a.target, b.target""",
    "target_steps": """
        select p.target, f.kind, case f.file_id % 4 when 0 then 'archive' when 1 then 'link' when 2 then 'codegen' else 'other' end as step_type, f.size * 10 as duration_ms
        from files f join paths p on f.file_id = p.file_id""",
    "yearly": """
        select cast(year(o_orderdate) as int) as label, concat(p_brand, '/', p_size % 4) as target, p_brand as module, cast(count(*) as bigint) as file_count,
               cast(sum(cast(round(l_extendedprice) as bigint)) as bigint) as build_ms, cast(sum(cast(l_quantity as bigint)) as bigint) as code_lines,
               cast(sum(cast(l_linenumber as bigint)) as bigint) as link_ms, cast(count(distinct o_custkey) as bigint) as dependencies
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by year(o_orderdate), p_brand, p_size % 4""",
    "yearly_edges": """
        select distinct cast(year(o_orderdate) as int) as label, a.p as src, b.p as dst
        from pairs_in_commit a join pairs_in_commit b on a.o = b.o join edges e on e.src = a.p and e.dst = b.p join orders on a.o = o_orderkey""",
    "nodes": "select file_id as node, cast(compile_ms as bigint) as ms, target, kind from files",
    "identities": """
        select c_custkey as contributor, n_name as canonical, case when c_mktsegment = 'MACHINERY' then null else r_name end as team,
               c_mktsegment <> 'FURNITURE' as is_resolved
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "steps": """
        select event_id as step_id, event_type as step_type, user_id as target_id,
               epoch_us(ts) // 1000 as start_ms, epoch_us(ts) // 1000 + cast(round(greatest(coalesce(value, 0), 0) * 1000) as bigint) as end_ms
        from events""",
    "snapshots": """
        select cast(year(o_orderdate) as int) as label, o_orderpriority as target, cast(count(*) as bigint) as files,
               cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as build_ms, cast(count(distinct o_custkey) as bigint) as authors
        from orders group by year(o_orderdate), o_orderpriority""",
}
#: what a view reads, directly
NEEDS = {
    "file_metrics": ("files", "churn"), "edges": ("pairs_in_commit",), "nodes": ("files",), "paths": ("files",), "sources": ("file_metrics", "paths"),
    "include_rows": ("pairs_in_commit", "edges", "paths"), "target_edges": ("edges", "paths"), "target_steps": ("files", "paths"), "yearly_edges": ("pairs_in_commit", "edges"),
}

#: small results of self-joins of the whole commit log, which a query reads several times
WRITTEN = ("edges", "include_rows", "target_edges", "yearly_edges")


def _closed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in (*_closed(NEEDS.get(n, ())), n):
            if m not in out:
                out.append(m)
    return out


def ctes(*names: str, recursive: bool = False) -> str:
    """The views as a WITH clause's parts, for the check queries."""
    return ("with recursive " if recursive else "with ") + ",\n".join(f"{n} as ({VIEWS[n]})" for n in _closed(names))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables of a folder; only columns and rows in use are read."""
    ship(spark)
    sql = VIEWS[name].replace("epoch_us(ts) // 1000", "unix_millis(cast(ts as timestamp))")
    bound = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if _binds(sql, t)}
    bound |= {n: view(spark, sf_dir, n) for n in NEEDS.get(name, ())}
    for n in bound:
        sql = _bind(sql, n)
    out = spark.sql(sql, **bound)
    return written(out, name) if name in WRITTEN else out


def _binds(sql: str, name: str) -> bool:
    return re.search(rf"\b(from|join) {name}\b", sql) is not None


def _bind(sql: str, name: str) -> str:
    """`from name` and `join name` read a bound frame."""
    return re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", sql)
