"""The command line's reports over a small dataset."""

import json

import pytest

from buildloom import cli
from buildloom.sources.dataset import SCHEMAS, Dataset


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("data"))
    data = Dataset(spark, where)

    def put(name, rows):
        fields = spark.createDataFrame([], SCHEMAS[name]).schema
        data.save(name, spark.createDataFrame([[r.get(f.name) for f in fields.fields] for r in rows], fields))

    put("target_metrics", [{"cmake_target": n, "target_type": k, "source_directory": f"/top/{n}", "total_build_time_ms": ms, "file_count": 2, "git_commit_count_total": c, "transitive_dependant_count": d, "code_lines_total": 10 * ms} for n, k, ms, c, d in [("core", "static_library", 30, 9, 2), ("net", "static_library", 20, 3, 1), ("app", "executable", 10, 1, 0), ("doc", "custom_target", 5, 0, 0)]])
    put("edge_list", [{"source_target": a, "dest_target": b, "is_direct": d, "dependency_type": "link", "cmake_visibility": "PUBLIC"} for a, b, d in [("net", "core", True), ("app", "net", True), ("app", "core", False)]])
    put("file_metrics", [{"source_file": f"/top/{t}/{n}.cpp", "cmake_target": t, "is_generated": False, "language": "CXX", "compile_time_ms": ms, "code_lines": 100, "git_commit_count": 4, "source_size_bytes": 600, "expansion_ratio": float(ms)} for t, n, ms in [("core", "a", 20), ("core", "b", 10), ("net", "c", 15), ("app", "main", 9)]])
    import datetime as dt

    put("git_commit_log", [{"commit_hash": f"c{i}", "timestamp": dt.datetime(2024, 1 + i, 1), "contributor": p, "source_file": f"/top/{f}.cpp", "lines_added": 1, "lines_deleted": 0} for i, (p, f) in enumerate([("ann", "core/a"), ("ann", "core/a"), ("bob", "core/b"), ("bob", "net/c")])])
    put("header_edges", [{"includer": a, "included": b, "depth": 1, "source_file": "/top/core/a.cpp", "is_system": s} for a, b, s in [("/top/core/a.cpp", "/top/core/a.h", False), ("/top/core/a.h", "/top/core/b.h", False), ("/top/core/a.cpp", "/usr/include/x.h", True)]])
    put("header_metrics", [{"header_file": f"/top/core/{n}.h", "cmake_target": "core", "sloc": 5, "source_size_bytes": size, "is_system": False} for n, size in [("a", 100), ("b", 40)]])
    return where


def ask(capsys, folder, *args):
    assert cli.main([args[0], "--data", folder, "--format", "json", "--limit", "0", *args[1:]]) == 0
    return [json.loads(line) for line in capsys.readouterr().out.splitlines()]


def test_reports(spark, folder, capsys):
    path = ask(capsys, folder, "critical-path")
    assert [(r["node"], r["start"]) for r in path if r["status"] == "critical"] == [("core", 0), ("net", 30), ("app", 50)]
    assert [r["node"] for r in path if r["status"] == "near"] == ["doc"]
    assert ask(capsys, folder, "hotspots")[0]["node"] == "core"
    assert ask(capsys, folder, "layer-violations") == []
    risk = {r["target"]: r for r in ask(capsys, folder, "ownership-risk")}
    assert risk["core"]["contributors"] == 2 and risk["net"]["top_share"] == 1.0
    assert [(r["node"], r["relation"]) for r in ask(capsys, folder, "rebuild-impact", "--of", "core")] == [("net", "direct"), ("app", "transitive")]
    assert [r["node"] for r in ask(capsys, folder, "rebuild-impact", "--of", "elsewhere/c.cpp")] == ["app"]
    assert ask(capsys, folder, "rebuild-impact")[0]["node"] == "core"
    assert [r["source_file"] for r in ask(capsys, folder, "slow-files", "--view", "bloat", "--target", "core,net")] == ["/top/core/a.cpp", "/top/net/c.cpp", "/top/core/b.cpp"]
    hot = ask(capsys, folder, "header-hotlist")
    assert [(r["node"], r["impact_score"]) for r in hot] == [("/top/core/a.h", 500), ("/top/core/b.h", 400)]
    assert {"target": "app", "key": "file_count", "value": "2"} in ask(capsys, folder, "target-summary", "--target", "app")


def test_questions_without_an_answer(spark, folder, capsys):
    assert cli.main(["hotspots", "--data", folder, "--target", "nowhere"]) == 1
    assert cli.main(["rebuild-impact", "--data", folder, "--of", "none.cpp"]) == 1
    assert cli.main(["hotspots", "--data", folder + "-none"]) == 1
    assert "nowhere" in capsys.readouterr().err
