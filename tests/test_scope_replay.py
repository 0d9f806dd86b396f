"""Scopes, replayed commits and header use on a small graph."""

import pytest

from buildloom.operators import replay, scope


@pytest.fixture(scope="module")
def build(spark):
    nodes = spark.createDataFrame([("core", "lib", "src/core", "base", "red", 10, 5), ("net", "lib", "src/net", "base", "blue", 30, None), ("app", "exe", "src/app", "top", "red", 20, 1), ("tool", "exe", "tools", None, None, 5, 0)], "node string, kind string, directory string, module string, team string, ms long, commits long")
    return nodes, spark.createDataFrame([("net", "core"), ("app", "net"), ("tool", "core")], "src string, dst string")


def names(df):
    return sorted(r.node for r in df.collect())


def test_scopes(build):
    t, e = build
    assert names(scope.resolve(t, e, depends_on=["net"])) == ["app", "net"]
    assert names(scope.resolve(t, e, dependencies_of=["app"], types=["lib"], exclude=["net"])) == ["core"]
    assert names(scope.resolve(t, e, globs=["*o*"], exclude_globs=["t?ol"])) == ["core"]
    assert names(scope.resolve(t, e, directories=["src/"], min_commits=1)) == ["app", "core"]
    assert names(scope.resolve(t, e, teams=["red"], modules=["top"])) == ["app"]
    for bad in ({"names": ["nope"]}, {"types": ["none"]}, {"min_colour": 3}):
        with pytest.raises(ValueError):
            scope.resolve(t, e, **bad)
    assert [tuple(r) for r in scope.induced(e, scope.resolve(t, e, types=["lib"])).collect()] == [("net", "core")]


def test_replay(spark, build):
    t, e = build
    touched = spark.createDataFrame([(1, "core"), (2, "app"), (3, "net"), (3, "app"), (4, "core")], "commit_id long, node string")
    got = {r.commit_id: (r.modified, r.rebuilt, r.build_ms) for r in replay.replay(touched, t, e).collect()}
    assert got == {1: (1, 4, 60), 2: (1, 1, 20), 3: (2, 2, 50), 4: (1, 4, 60)}
    assert {r.commit_id: r.build_ms for r in replay.replay(touched, t, e, cores=1).collect()} == {1: 65, 2: 20, 3: 50, 4: 65}


def test_schedules_and_headers(spark):
    frame = lambda rows: spark.createDataFrame(rows, "node string, start_ms long, end_ms long")
    cores = frame([("a", 0, 110)]).selectExpr("*", "0 as core")
    r = replay.compare_schedules(cores, frame([("a", 50, 90), ("a", 80, 125), ("b", 0, 10)])).head()
    # walls end with the last target, and an observed target lasts from its first step to its last
    assert (r.simulated_wall_ms, r.observed_wall_ms, r.error_pct, r.within_tolerance) == (110, 125, 12.0, False)
    assert r.simulated_utilisation == 1.0 and r.observed_utilisation == (75 + 10) / 125
    pair = lambda rows: spark.createDataFrame(rows, "node string, header string")
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("D", "E")], "src string, dst string")
    thin = replay.thin_dependencies(edges, pair([("B", "b1"), ("B", "b2"), ("B", "b3"), ("C", "c1")]), pair([("A", "b1"), ("A", "c1")]))
    assert [(x.src, x.dst, x.used, x.total) for x in thin.collect()] == [("A", "B", 1, 3)]
    assert [tuple(x) for x in replay.shared_headers(pair([("A", "h"), ("B", "h"), ("B", "k")])).collect()] == [("h", 2, 1.0, ["A", "B"])]
