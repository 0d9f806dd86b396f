"""Typed tables, snapshots, graph files, clusters and recommendations."""

import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from buildloom.operators import clusters as cl
from buildloom.operators import recommend as rc
from buildloom.sources import gexf
from buildloom.sources.dataset import SCHEMAS, Dataset, Snapshots


def commits(spark):
    return spark.createDataFrame([("ann", "core", 3, "x"), ("bob", "app", 1, None)], "contributor string, cmake_target string, commit_count int, more string")


def test_tables_conform_and_are_checked(spark, tmp_path):
    d = Dataset(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="edge_list"):
        d.table("edge_list")
    d.save("contributor_target_commits", commits(spark))
    got = d.table("contributor_target_commits")
    assert got.dtypes == [("contributor", "string"), ("cmake_target", "string"), ("commit_count", "bigint"), ("more", "string")]
    assert d.views() == ["contributor_target_commits"] and spark.sql("select sum(commit_count) from contributor_target_commits").head()[0] == 4
    d.save("contributor_target_commits", spark.createDataFrame([(None, "a", -1)], "contributor string, cmake_target string, commit_count long"))
    with pytest.raises(ValueError, match="contributor is not null"):
        d.table("contributor_target_commits")
    assert Dataset(spark, str(tmp_path), check=False).table("contributor_target_commits").count() == 1
    assert all(spark.createDataFrame([], s).columns for s in SCHEMAS.values())


def test_snapshots(spark, tmp_path):
    d = Dataset(spark, f"{tmp_path}/now")
    d.save("contributor_target_commits", commits(spark))
    s = Snapshots(spark, f"{tmp_path}/snapshots")
    assert s.list().count() == 0 and s.latest() is None
    s.create("baseline-1", "2024-01-01", d)
    s.create("later", "2024-02-01", d, "second")
    assert [r.label for r in s.list().collect()] == ["baseline-1", "later"] and s.latest() == "later" and s.baseline() == "baseline-1"
    assert s.all("contributor_target_commits").count() == 4 and s.all("edge_list") is None
    with pytest.raises(ValueError):
        s.create("1bad", "2024-03-01", d)


def test_gexf(spark, tmp_path):
    nodes = spark.createDataFrame([("a<b", 1.5, True), ("c", None, None)], "node string, score double, hot boolean")
    gexf.write(nodes, spark.createDataFrame([("a<b", "c", 3)], "src string, dst string, weight long"), f"{tmp_path}/g.gexf")
    root = ET.parse(f"{tmp_path}/g.gexf").getroot()
    tag = "{http://www.gexf.net/1.2draft}"
    assert [n.get("id") for n in root.iter(f"{tag}node")] == ["a<b", "c"] and len(list(root.iter(f"{tag}edge"))) == 1
    assert [a.get("value") for a in root.iter(f"{tag}attvalue")] == ["1.5", "true", "0.0", "false", "3"]


def test_clusters(spark):
    x = np.array([[9, 9, 0, 0], [8, 9, 0, 0], [0, 0, 7, 8], [0, 1, 9, 9], [9, 8, 0, 1]], float)
    assert cl.ward(cl.divergence(x), [2])[2].tolist() == [1, 1, 2, 2, 1]
    w, h = cl.factorise(x, 2)
    assert len(set(w.argmax(1)[[0, 1, 4]])) == 1 and w.argmax(1)[0] != w.argmax(1)[2] and np.abs(x - w @ h).max() < 2
    assert cl.silhouette(x, np.array([1, 1, 2, 2, 1])) > 0.8 and cl.silhouette(x, np.ones(5, int)) == 0
    long = spark.createDataFrame([(f"r{i}", j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v], "who string, what int, n double")
    got = {(r.who, r.clusters): r.group_id for r in cl.hierarchy(long, "who", "what", "n", (2, 3, 9)).collect()}
    assert [got[f"r{i}", 2] for i in range(5)] == [1, 1, 2, 2, 1] and {k for _, k in got} == {2, 3}
    assert {r.clusters for r in cl.factor_groups(long, "who", "what", "n", 2, 3).collect()} == {2, 3}


def test_ward_matches_the_plain_way():
    draw = np.random.default_rng(4)
    for n in (2, 5, 23):
        x = draw.random((n, 4))
        far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        groups = [[i] for i in range(n)]
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        want = {}
        while True:
            if len(groups) in (1, 2, 3, 5):
                want[len(groups)] = sorted(sorted(g) for g in groups)
            if len(groups) == 1:
                break
            a, b = min(((a, b) for i, a in enumerate(groups) for b in groups[:i]), key=lambda p: cost(*p))
            groups = [g for g in groups if g is not a and g is not b] + [a + b]
        for k, label in cl.ward(far, [1, 2, 3, 5]).items():
            assert sorted(sorted(np.flatnonzero(label == c).tolist()) for c in np.unique(label)) == want[k]


def test_silhouette_matches_the_plain_way():
    draw = np.random.default_rng(9)
    x, label = draw.random((60, 3)), draw.integers(0, 4, 60)
    label[0] = 9  # alone
    total = 0.0
    for i in range(60):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        own = label == label[i]
        if own.sum() > 1:
            a, b = d[own].sum() / (own.sum() - 1), min(d[label == k].mean() for k in set(label.tolist()) - {int(label[i])})
            total += (b - a) / max(a, b)
    assert cl.silhouette(x, label, 7) == pytest.approx(total / 60)


def test_bad_values_fail_and_files_are_found(spark, tmp_path):
    from buildloom.sources import dataset as ds

    data = ds.Dataset(spark, str(tmp_path / "deep" / "er"))
    data.save("contributor_target_commits", spark.createDataFrame([("a", "t", "3"), ("b", "t", "many")], "contributor string, cmake_target string, commit_count string"))
    with pytest.raises(ValueError, match="commit_count is of its type"):
        data.table("contributor_target_commits")
    (tmp_path / "teams.yaml").write_text("")
    assert ds.project_file(str(tmp_path / "deep" / "er"), "teams.yaml") == str(tmp_path / "teams.yaml")
    assert ds.project_file(str(tmp_path / "deep" / "er"), "none.yaml") is None


def test_emitted_reports(spark):
    from buildloom.operators import consolidate as co

    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "z, w")], "n long, t string").orderBy("n")
    assert co.emit(rows, "csv", 0) == "n,t\r\n1,x\r\n2,\r\n3,\"z, w\"\r\n"
    assert co.emit(rows, "json", 1) == '{"n": 1, "t": "x"}\n' and co.emit(rows, "table", 2) == "n  t\n1  x\n2\n"
    with pytest.raises(ValueError):
        co.emit(rows, "odd")


def test_recommendations(spark):
    rows = spark.createDataFrame([("t", "a", 10.0, 1.0, 0.5), ("t", "b", 8.0, 5.0, 0.5), ("t", "c", 20.0, 12.0, 0.5), ("t", "d", 10.0, 1.0, 0.5)], "type string, item string, impact double, effort double, confidence double")
    assert [(r["item"], r["category"]) for r in rc.frontier(rows).collect()] == [("c", "strategic"), ("a", "quick_win"), ("d", "quick_win")]
    nodes = spark.createDataFrame([("A", 10), ("B", 30), ("C", 20)], "node string, ms long")
    edges = spark.createDataFrame([("B", "A"), ("C", "A"), ("C", "B")], "src string, dst string")
    assert rc.without_edge(nodes, edges, "C", "B") == 20 and rc.without_edge(nodes, edges, "C", "A") == 0
    split = rc.split_interventions(nodes, edges, spark.createDataFrame([("A", 3), ("B", 8)], "node string, files long"))
    assert [(r["item"], r["effort"]) for r in split.collect()] == [("B", 2.4), ("C", 3.0)]
    assert rc.merge_saving(spark.createDataFrame([(1, 5, 5), (2, 3, None), (3, 1, 1)], "ord int, archive_ms long, link_ms long")).head().saved_ms == 5


def test_header_interventions_round_and_cut_as_the_sql(spark):
    import duckdb
    from buildloom.plans import catalog

    # impacts whose seventh place is a half, and more rows that are alike to six places than are asked for
    rows = [(i, fan, 1, fan % 9) for i, fan in enumerate((415, 815, 845, 1695, 3265, 10_001))] + [(100 - i, 3_000_000 + i % 3, 1, 3) for i in range(30)]
    got = rc.header_interventions(spark.createDataFrame(rows, "header long, fan_in long, size long, direct long"))
    con = duckdb.connect()
    con.execute("create table h(file_id bigint, fan bigint, size bigint, direct bigint)")
    con.executemany("insert into h values (?, ?, ?, ?)", rows)
    sql = catalog.oracle_sql()["header_interventions"]
    sql = "with files as (select file_id, size from h), u as (select file_id dst, fan from h), d as (select file_id dst, direct from h), " + sql[sql.index("x as (select file_id item") :]
    assert [tuple(r)[1:3] for r in got.collect()] == [r[1:3] for r in con.execute(sql).fetchall()]
    few = [r for r in rows if r[0] < 6]
    con.execute("delete from h where file_id >= 6")
    got = rc.header_interventions(spark.createDataFrame(few, "header long, fan_in long, size long, direct long"))
    assert [tuple(r)[1:3] for r in got.collect()] == [r[1:3] for r in con.execute(sql).fetchall()]


def test_target_summary_shows_ratios_as_the_sql(spark):
    import duckdb
    from buildloom.plans import catalog, consolidation

    # shares that six places round to the half of a hundredth of a percent
    shares = [(95, 107), (37, 109), (72, 109), (1, 113), (50, 117), (38, 121), (1, 32), (0, 3)]
    con = duckdb.connect()
    con.execute("create table sources(cmake_target varchar, is_generated boolean)")
    con.executemany("insert into sources select ?, i < ? from range(?) t(i)", [(f"{a}/{b}", a, b) for a, b in shares])
    names = ("compile_time_ms", "code_lines", "object_size_bytes", "preprocessed_bytes", "source_size_bytes", "header_max_depth", "unique_headers", "total_includes", "git_commit_count", "git_churn", "git_distinct_authors",
             "compiler_parse_time_ms", "compiler_template_instantiation_ms", "compiler_codegen_time_ms", "compiler_optimization_time_ms", "compiler_total_usr_ms", "compiler_total_sys_ms")
    con.execute("create or replace table sources as select *, " + ", ".join(f"cast(7 as bigint) {n}" for n in names) + " from sources")
    rows = con.execute("select * from sources").fetchall()
    frame = spark.createDataFrame(rows, "cmake_target string, is_generated boolean, " + ", ".join(f"{n} long" for n in names)).withColumn("source_file", F.lit("f"))
    sql = catalog.oracle_sql()["target_summary"]
    want = con.execute("with " + sql[sql.index("fm as (select") :]).fetchall()
    assert sorted(map(tuple, consolidation.target_summary(frame).collect())) == sorted(want)


def test_equal_rows_count_as_often_as_they_are_there(spark):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 9, (40, 5)).astype(float)
    times = draw.integers(1, 5, 40)
    which = np.repeat(np.arange(40), times)
    for k, label in cl.ward(cl.divergence(x), [2, 4, 6], times).items():
        assert label[which].tolist() == cl.ward(cl.divergence(x[which]), [k])[k].tolist()
    label = draw.integers(0, 4, 40)
    assert sum(cl._silhouettes(x, times.astype(float), [label], 0, 40)) / times.sum() == pytest.approx(cl.silhouette(x[which], label[which]))
    # so many rows that their distances would be 900 million cells: 200 different ones
    kinds = np.unique(draw.integers(0, 5, (330, 4)), axis=0)[:200] + [[1, 0, 0, 0]]
    long = spark.createDataFrame([(i,) for i in range(30_000)], "who long").withColumn("n", F.element_at(F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in kinds)), (F.col("who") % 200 + 1).cast("int")))
    long = long.select("who", F.posexplode("n").alias("what", "n")).where("n > 0")
    got = {(r.who, r.clusters): r.group_id for r in cl.hierarchy(long, "who", "what", "n", (3, 5)).collect()}
    assert len(got) == 60_000 and all(got[i, k] == got[i % 200, k] for i, k in got)
    rows = cl.factor_groups(long, "who", "what", "n", 2, 3).collect()
    assert len(rows) == 60_000 and len({r.clusters for r in rows if r.best}) == 1
    a = {k: {r.who: r.group_id for r in rows if r.clusters == k} for k in (2, 3)}
    few = kinds[np.arange(3_000) % 200].astype(float)
    assert next(r.silhouette for r in rows if r.clusters == 2) == pytest.approx(cl.silhouette(few, np.array([a[2][i] for i in range(3_000)])), abs=5e-3)


def test_hierarchy_holds_no_matrix_of_distances(spark):
    from pathlib import Path

    from buildloom.functions.storage import shared_dir

    draw = np.random.default_rng(6)
    middle = draw.random((10, 8)) ** 4 * 60
    x = np.unique(draw.poisson(middle[draw.integers(0, 10, 4_000)]).astype(float), axis=0)
    x = draw.permutation(x[x.sum(1) > 0])[:3_300]
    assert len(x) == 3_300  # more than one task's work
    size = lambda: sum(f.stat().st_size for f in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if f.is_file())
    who, what = np.nonzero(x)
    long = spark.createDataFrame(pd.DataFrame({"who": who, "what": what, "n": x[who, what]}))
    before = size()
    got = {(r.who, r.clusters): r.group_id for r in cl.hierarchy(long, "who", "what", "n", (3, 5, 10)).collect()}
    assert size() - before < len(x) ** 2
    for k, label in cl.ward(cl.divergence(x), [3, 5, 10]).items():
        assert [got[i, k] for i in range(len(x))] == label.tolist()


def test_tree_in_rounds_matches_the_plain_way(spark):
    from buildloom.sources.views import ship

    ship(spark)
    draw = np.random.default_rng(1)
    x, weight = draw.integers(0, 6, (150, 6)).astype(float), draw.integers(1, 5, 150).astype(float)
    x[[3, 50, 51]], weight[[3, 50, 51]] = 0, 1  # 1 from all others
    want = cl.merges(cl.divergence(x), weight)
    got = cl.tree_in_rounds(spark, x, weight, few=9)
    assert sorted(m[2] for m in got) == pytest.approx(sorted(m[2] for m in want), abs=1e-3)
    for k, label in cl._cut(want, 150, [2, 5, 12]).items():
        assert cl._cut(got, 150, [k])[k].tolist() == label.tolist()
    # all equally far: whichever pairs are joined, every row is in the tree
    got = cl.tree_in_rounds(spark, np.eye(60), np.ones(60), few=1)
    assert len(got) == 59 and cl._cut(got, 60, [1])[1].tolist() == [1] * 60


def test_a_cut_may_fall_among_equal_rows(spark):
    long = spark.createDataFrame([(f"r{i}", i % 2, 3.0) for i in range(6)] + [("none", 0, 0.0), ("nil", 1, 0.0)], "who string, what int, n double")
    rows = cl.hierarchy(long, "who", "what", "n", (2, 4, 7, 9)).collect()
    kinds = {k: len({r.group_id for r in rows if r.clusters == k}) for k in (2, 4, 7)}
    assert kinds == {2: 2, 4: 4, 7: 7} and len(rows) == 24
    at4 = {r.who: r.group_id for r in rows if r.clusters == 4}
    assert len({at4[f"r{i}"] for i in (0, 2, 4)}) == len({at4[f"r{i}"] for i in (1, 3, 5)}) == 1 and at4["none"] != at4["nil"]


def test_only_different_rows_are_held(spark, monkeypatch):
    monkeypatch.setattr(cl, "CELLS", 100)
    kinds = [[9, 1, 0], [0, 7, 2], [3, 0, 8], [5, 5, 0], [1, 1, 1]]
    long = spark.range(600).withColumnRenamed("id", "who").select("who", F.posexplode(F.element_at(F.array(*(F.array(*map(F.lit, r)) for r in kinds)), (F.col("who") % 5 + 1).cast("int"))).alias("what", "n"))
    rows = cl.factor_groups(long, "who", "what", "n", 2, 3).collect()
    x = np.array(kinds, float)[np.arange(600) % 5]
    for k in (2, 3):
        of = {r.who: r for r in rows if r.clusters == k}
        w, h = cl.factorise(np.array(kinds, float), k, weight=np.full(5, 120))
        label = np.array([of[i].group_id for i in range(600)])
        assert label.tolist() == w.argmax(1)[np.arange(600) % 5].tolist()
        assert of[0].silhouette == pytest.approx(cl.silhouette(x, label), abs=1e-6) and of[0].error == pytest.approx(np.sqrt(120) * np.linalg.norm(x[:5] - w @ h))
    assert len(rows) == 1200 and len({r.clusters for r in rows if r.best}) == 1
    with pytest.raises(ValueError, match="600 x 3"):
        cl.factor_groups(long.withColumn("n", F.col("n") + F.col("who") * (F.col("what") + 1)), "who", "what", "n", 2, 3)
