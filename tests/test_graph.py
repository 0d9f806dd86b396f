"""Graph operators on small graphs: expected values, invariants, and the distributed form against the one-task form."""

import pytest

from buildloom.functions import kernels
from buildloom.operators import graph as g


@pytest.fixture(scope="module")
def diamond(spark):
    nodes = spark.createDataFrame([("A", 10_000), ("B", 30_000), ("C", 20_000), ("D", 5_000)], "node string, ms long")
    edges = spark.createDataFrame([("B", "A"), ("C", "A"), ("D", "B"), ("D", "C")], "src string, dst string")
    return nodes, edges


def test_critical_path(diamond):
    rows = {r.node: r for r in g.critical_path(*diamond).collect()}
    assert max(r.finish for r in rows.values()) == 45_000
    assert rows["C"].slack == 10_000
    assert {n for n, r in rows.items() if r.critical} == {"A", "B", "D"}


def test_halving_one_target(diamond):
    nodes, edges = diamond
    faster = nodes.selectExpr("node", "case when node = 'B' then 15000 else ms end as ms")
    assert g.length(nodes, edges) - g.length(faster, edges) == 10_000


def test_cycle_is_refused(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    with pytest.raises(Exception, match="cycle"):
        g.longest(nodes, edges, few=0).collect()
    with pytest.raises(Exception, match="cycle"):
        g.longest(nodes, edges).collect()


def test_both_forms_of_longest_agree(spark):
    nodes = spark.range(30).selectExpr("id as node", "id % 7 as ms")
    edges = spark.createDataFrame([(a, b) for a in range(30) for b in range(a) if (a * 7 + b * 3) % 5 == 0], "src long, dst long")
    few = sorted(map(tuple, g.longest(nodes, edges, "ms").collect()))
    assert few == sorted(map(tuple, g.longest(nodes, edges, "ms", few=0).collect()))


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = {tuple(r) for r in g.closure(edges).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4) if a != b}


def test_ranks_sum_to_one_and_follow_the_definition(spark):
    nodes = spark.range(5).selectExpr("id as node")
    pairs = [(1, 0), (2, 0), (3, 1), (3, 2)]
    got = {r.node: r.rank for r in g.pagerank(nodes, spark.createDataFrame(pairs, "src long, dst long"), rounds=30, tolerance=None).collect()}
    rank = [0.2] * 5
    for _ in range(30):
        loose = rank[0] + rank[4]
        rank = [0.15 / 5 + 0.85 * (sum(rank[a] / sum(x == a for x, _ in pairs) for a, b in pairs if b == n) + loose / 5) for n in range(5)]
    assert got == pytest.approx(dict(enumerate(rank))) and sum(got.values()) == pytest.approx(1)


def test_betweenness_of_a_chain(spark):
    nodes = spark.range(4).selectExpr("id as node")
    got = {r.node: r.betweenness for r in g.betweenness(nodes, spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")).collect()}
    assert got == pytest.approx({0: 0, 1: 2 / 6, 2: 2 / 6, 3: 0})
    assert got == pytest.approx(kernels.betweenness([0, 1, 2, 3], {0: [1], 1: [2], 2: [3]}))


def test_communities_of_two_triangles(spark):
    nodes = spark.range(6).selectExpr("id as node")
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1), (2, 3, 1)], "src long, dst long, weight long")
    assert {r.node: r.community for r in g.communities(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_schedules():
    times, deps = {"A": 10, "B": 30, "C": 20, "D": 5}, {"B": ["A"], "C": ["A"], "D": ["B", "C"]}
    assert max(r[2] for r in kernels.schedule(times, deps, 1)) == 65
    assert max(r[2] for r in kernels.schedule(times, deps, 100)) == 45
    links = dict.fromkeys("xyz", 10)
    assert max(r[2] for r in kernels.schedule(links, {}, 8, dict.fromkeys("xyz", "link"), {"link": 1})) == 30
    assert len({r[3] for r in kernels.schedule(links, {}, 3)}) == 3


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], "node long, ms long"), spark.createDataFrame([], "src long, dst long")
    assert g.closure(edges).count() == g.longest(nodes, edges).count() == g.components(nodes, edges).count() == 0


def test_ranks_stop_at_the_tolerance(spark):
    nodes, edges = spark.range(6).selectExpr("id as node"), spark.createDataFrame([(1, 0), (2, 0), (3, 1), (0, 3), (4, 5)], "src long, dst long")
    near = {r.node: r.rank for r in g.pagerank(nodes, edges).collect()}
    long = {r.node: r.rank for r in g.pagerank(nodes, edges, rounds=200, tolerance=None).collect()}
    assert all(abs(near[n] - long[n]) < 1e-4 for n in near) and sum(near.values()) == pytest.approx(1)


def test_lengths_without_an_edge_match_brute_force(spark):
    import random

    draw = random.Random(11)
    for _ in range(3):
        ms = {n: draw.randrange(1, 30) for n in range(14)}
        pairs = sorted({(a, b) for a in range(14) for b in range(a) if draw.random() < 0.25})

        def longest(edges):
            best = {}
            for n in range(14):
                best[n] = ms[n] + max((best[b] for a, b in edges if a == n), default=0)
            return max(best.values())

        nodes, edges = spark.createDataFrame(list(ms.items()), "node long, ms long"), spark.createDataFrame(pairs, "src long, dst long")
        got = {(r.src, r.dst): (r.length_ms, r.without_ms) for r in g.lengths_without(nodes, edges, edges).collect()}
        assert got == {e: (longest(pairs), longest([x for x in pairs if x != e])) for e in pairs}


def test_schedules_with_pools_targets_and_scopes(spark):
    nodes = spark.createDataFrame([("a", 5, "static_library"), ("b", 7, "executable"), ("c", 7, "executable"), ("d", 3, "custom_target")], "node string, ms long, kind string")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b")], "src string, dst string")
    runs = spark.createDataFrame([("free", 4, 0), ("pooled", 4, 1)], "scenario string, cores int, link_depth int")
    wall = lambda plan: {r.scenario: r.w for r in plan.groupBy("scenario").agg({"end_ms": "max"}).toDF("scenario", "w").collect()}
    # with one link at a time c waits for b
    assert wall(g.simulate(nodes, edges, runs)) == {"free": 15, "pooled": 19}
    assert wall(g.simulate(nodes, edges, runs, target="c")) == {"free": 12, "pooled": 12}
    assert wall(g.simulate(nodes, edges, runs, scope=nodes.where("node in ('a', 'd')"))) == {"free": 5, "pooled": 5}
    with pytest.raises(KeyError):
        g.simulate(nodes, edges, runs, target="nowhere")
    with pytest.raises(ValueError):
        g.simulate(nodes, edges, runs, target="c", scope=nodes)
    assert {r.node: r.weight for r in g.chain_weights(nodes, edges).collect()} == {"a": 1, "b": 2, "c": 2, "d": 2}


def test_cycles_are_told(spark):
    nodes, edges = spark.createDataFrame([(1,), (2,)], "node long"), spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    assert not g.is_acyclic(nodes, edges)
    with pytest.raises(ValueError):
        g.build_graph(nodes, edges)
    from buildloom.operators import consolidate

    assert {r.depth for r in consolidate.depths(nodes, edges).collect()} == {0}
