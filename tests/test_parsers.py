"""Readers of raw logs on small samples."""

from pyspark.sql import functions as F

from buildloom.functions.columns import glob, normal_path
from buildloom.operators import metrics as m
from buildloom.sources import parsers as p


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_ninja_log(spark, tmp_path):
    path = put(tmp_path, "log", "# ninja log v5\n0\t500\t0\ta/x.cpp.o\tab\n\n100\t2000\t0\tlib/libcore.a\tcd\nshort\t1\n200\t3000\t0\tapp\tef\n50\t150\t0\tgen/m.cpp\t12\n5\t6\t0\tl/libp.so\t9\n")
    rows = p.ninja_log(spark, path)
    known = lambda x: spark.createDataFrame([(x,)], "output string")
    got = {r.output: (r.start_ms, r.end_ms, r.step_type) for r in p.step_type("output", known("app"), known("gen/m.cpp"), rows).collect()}
    assert got == {"a/x.cpp.o": (0, 500, "compile"), "lib/libcore.a": (100, 2000, "archive"), "app": (200, 3000, "link"), "gen/m.cpp": (50, 150, "codegen"), "l/libp.so": (5, 6, "link")}


def test_git_log(spark, tmp_path):
    path = put(tmp_path, "log", "COMMIT:abc1|2024-01-02T03:04:05+00:00|Ann|ann@x.y|Fix | things\n\n3\t1\tsrc/a.cpp\n-\t-\tlogo.png\nCOMMIT:def2|2024-01-03T00:00:00+00:00|Bob|b@x.y|\n10\t0\tb.h\n")
    got = sorted((r.commit_hash, r.author_email, r.message, r.lines_added, r.lines_deleted, r.source_file) for r in p.git_log(spark, path, "/top/").collect())
    assert got == [("abc1", "ann@x.y", "Fix | things", 3, 1, "/top/src/a.cpp"), ("def2", "b@x.y", "", 10, 0, "/top/b.h")]


def gcc_report(phases, total):
    rows = "".join(f" {n:<30}: {u:6.2f} ({9:3}%) {y:6.2f} ({8:3}%) {w:6.2f} ({7:3}%) {k:7} kB ({6:3}%)\n" for n, u, y, w, k in phases)
    return "Time variable                       usr           sys          wall           GGC\n" + rows + (f" {'TOTAL':<30}: {total[0]:6.2f} {total[1]:13.2f} {total[2]:13.2f} {512:8} kB\n" if total else "")


def clang_report(title, rows):
    banner = "===" + "-" * 71 + "==="
    lines = "".join(f"   {u:.4f} ( 51.2%)   {y:.4f} ( 48.8%)   {u + y:.4f} (  7.1%)   {w:.4f} ( 33.3%)  {i}  {n}\n" for u, y, w, i, n in rows)
    return f"{banner}\n                 {title}\n{banner}\n  Total Execution Time: 3.0 seconds (4.0 wall clock)\n\n{lines}\n"


def test_git_log_subjects_may_quote_records(spark, tmp_path):
    path = put(tmp_path, "log", "COMMIT:77aa|2023-05-06T07:08:09+00:00|Cy D|cy@d.e|revert COMMIT:99ff|x|y|z fix\n\n4\t2\tlib/one.cc\n8\t0\tlib/../two.cc\nCOMMIT:zz|2023|A|b@c|no hash\n1\t1\tx\nCOMMIT:88bb|2023-05-07|E|e@f.g|end\n")
    got = sorted((r.commit_hash, r.message, r.lines_added, r.source_file) for r in p.git_log(spark, path, "/t").collect())
    assert got == [("77aa", "revert COMMIT:99ff|x|y|z fix", 4, "/t/lib/one.cc"), ("77aa", "revert COMMIT:99ff|x|y|z fix", 8, "/t/two.cc")]
    assert p.git_log(spark, str(tmp_path / "none"), "/t").count() == 0


def test_timing_reports(spark):
    gcc = gcc_report([("phase setup", 0.5, 0.25, 1.75, 99), ("phase parsing", 2.5, 0.5, 3.25, 7), ("|name lookup", 1.0, 0.0, 1.5, 3)], (9.5, 1.25, 11.019))
    clang = clang_report("Some other report", [(8.0, 8.0, 8.0, 1, "Misleading")]) + clang_report("Clang time report", [(1.5, 0.5, 2.125, 77, "Front end"), (0.25, 0.125, 0.5, 8, "Odd Phase"), (3.0, 1.0, 4.0679, 99, "Total")]) + clang_report("Last report", [(7.0, 7.0, 7.0, 2, "Late")])
    cases = [(1, gcc), (2, clang), (3, "nothing"), (4, None), (5, gcc_report([("phase setup", 0.5, 0.25, 1.75, 99)], None)), (6, clang_report("Clang time report", [(1.0, 1.0, 1.0, 5, "Optimizer")])), (7, "Time variable\n")]
    rows = spark.createDataFrame(cases, "id int, t string").select("id", p.timing_report(F.col("t")).alias("x")).collect()
    got = {r.id: r.x for r in rows}
    assert got[1].compiler == "gcc" and got[1].wall_total_ms == 11020 and (got[1].total.usr, got[1].total.sys) == (9.5, 1.25)
    assert {n: (x.usr, x.sys, x.wall) for n, x in got[1].phases.items()} == {"phase setup": (0.5, 0.25, 1.75), "phase parsing": (2.5, 0.5, 3.25), "|name lookup": (1.0, 0.0, 1.5)}
    # milliseconds are cut off, not rounded
    assert got[2].compiler == "clang" and got[2].wall_total_ms == 4067
    assert {n: (x.usr, x.sys, x.wall) for n, x in got[2].phases.items()} == {"frontend": (1.5, 0.5, 2.125), "odd_phase": (0.25, 0.125, 0.5)}
    assert got[3] is None and got[4] is None and got[7] is None
    assert got[5].wall_total_ms == 0 and set(got[5].phases) == {"phase setup"} and got[6].wall_total_ms == 0 and set(got[6].phases) == {"optimizer"}


def test_header_edges(spark):
    text = ". /src/foo.h\n.. /src/types.h\n.. /usr/include/stdio.h\n. /src/bar.h\n.. /src/types.h\n.. /src/bar.h\n. /src/foo.h\nnoise\n"
    units = spark.createDataFrame([("/src/main.cpp", text), ("/src/none.cpp", "")], "source_file string, t string").select("source_file", p.header_tree(F.col("t")).alias("tree"))
    got = {(r.includer, r.included, r.depth, r.is_system) for r in p.header_edges(units).collect()}
    assert got == {("/src/main.cpp", "/src/foo.h", 1, False), ("/src/foo.h", "/src/types.h", 2, False), ("/src/foo.h", "/usr/include/stdio.h", 2, True), ("/src/main.cpp", "/src/bar.h", 1, False), ("/src/bar.h", "/src/types.h", 2, False)}


def test_keyed_json_and_csv(spark, tmp_path):
    path = put(tmp_path, "x.json", '{"a.cpp": {"n": 3}, "b.cpp": {"n": null}}')
    assert {tuple(r) for r in p.read_keyed_json(spark, path, "file", "struct<n:int>").collect()} == {("a.cpp", 3), ("b.cpp", None)}
    assert p.read_keyed_json(spark, str(tmp_path / "no.json"), "file", "struct<n:int>").columns == ["file", "n"]
    assert p.read_csv(spark, str(tmp_path / "no.csv"), "a int").count() == 0


def test_columns(spark):
    rows = spark.createDataFrame([("/a/./b/../c//d",), ("a/../../b",), ("/..",), ("x/..",)], "p string")
    assert [r[0] for r in rows.select(normal_path("p")).collect()] == ["/a/c/d", "../b", "/", "."]
    names = spark.createDataFrame([("core_test",), ("core",), ("libcore",)], "n string")
    assert [r.n for r in names.where(glob("n", "core*")).collect()] == ["core_test", "core"]


def test_line_counts(spark):
    text = "// comment\n\nint a;\n/* open\n still\n end */\nint b; /* not a block\nint c;\n"
    r = m.line_counts(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()[0]
    assert (r.blank, r.comment, r.code) == (1, 4, 3)


def test_the_entry_needs_no_session_to_be_imported():
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    ask = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100"
    assert subprocess.run([sys.executable, "-c", ask], cwd=root, capture_output=True).returncode == 0


def test_preprocess_commands():
    from buildloom.sources import cmake as cm

    assert cm._preprocessing("/x/capture_stderr.sh c++ -O2 -H '-DN=a b' -o out.o -ftime-report m.cpp") == "c++ -E -O2 '-DN=a b' m.cpp"
    assert cm._preprocessing("broken 'quote") is None and cm._preprocessing(None) is None and cm._preprocessing("") == ""


def test_a_source_row_does_not_hold_its_targets_reply(spark):
    import json
    import re

    from buildloom.sources import cmake as cm

    target = {"name": "t", "id": "t::1", "sources": [{"path": "a.cpp", "compileGroupIndex": 1}, {"path": "b.h"}, {"path": "/x/c.c", "isGenerated": True, "compileGroupIndex": 0}, {"path": "d.c", "compileGroupIndex": 7}], "compileGroups": [{"language": "C"}, {"language": "CXX"}]}
    index = {"objects": [{"kind": "codemodel", "jsonFile": "m.json", "version": {"major": 2, "minor": 9}}]}
    model = {"configurations": [{"targets": [{"id": "t::1", "name": "t", "jsonFile": "t.json"}]}]}
    files = cm.CodeModel(spark.createDataFrame([("index-1.json", json.dumps(index)), ("m.json", json.dumps(model)), ("t.json", json.dumps(target))], "name string, json string"), "/top", "/top/b").files()
    assert [(r.position, r.path, r.is_generated, r.group, r.language) for r in files.orderBy("position").collect()] == [(0, "/top/a.cpp", False, 1, "CXX"), (1, "/top/b.h", False, None, None), (2, "/x/c.c", True, 0, "C"), (3, "/top/d.c", False, 7, None)]
    # what each exploded row carries along, besides its own source
    (kept,) = re.findall(r"Generate posexplode\(.*\), \[([^\[\]]*)\], false, \[position", files._jdf.queryExecution().sparkPlan().toString())
    assert {x.split("#")[0] for x in kept.split(", ")} == {"ord", "target"}
