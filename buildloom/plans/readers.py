"""Queries of the readers: the views are written out as the tools write them, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import normal_path, split_values
from ..functions.storage import shared_dir
from ..operators import consolidate as co
from ..operators import metrics as m
from ..sources import cmake as cm
from ..sources import parsers as ps
from ..sources.dataset import Dataset, Snapshots, conform
from ..streaming import ingest
from .registry import query


def put(df, name: str, kind: str = "text", **options) -> str:
    """df as a folder of files of that kind, where all machines see it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).format(kind).save(path)
    return path


@query("select cast(commit_id as varchar) commit_hash, concat('c', contributor, '@x.org') author_email, concat('fix COMMIT:', commit_id, ' | part') message, added lines_added, deleted lines_deleted, concat('/top/src/f', file_id, '.cpp') source_file from commit_log where line_no <> 7", ("commit_log",))
def git_log(log):
    return _commits(ps.git_log(log.sparkSession, _written_log(log), "/top/"))


def _commits(rows):
    return rows.select("commit_hash", "author_email", "message", "lines_added", "lines_deleted", "source_file")


def _written_log(log):
    """The commit log as a folder of logs."""
    # a line of 7 is a binary file, and subjects quote records
    line = F.when(F.col("line_no") == 7, F.concat(F.lit("-\t-\tsrc/f"), "file_id", F.lit(".bin"))).otherwise(F.concat("added", F.lit("\t"), "deleted", F.lit("\tsrc/./f"), "file_id", F.lit(".cpp")))
    head = F.concat(F.lit("COMMIT:"), "commit_id", F.lit("|"), F.date_format("ts", "yyyy-MM-dd"), F.lit("|Ann "), "contributor", F.lit("|c"), "contributor", F.lit("@x.org|fix COMMIT:"), "commit_id", F.lit(" | part"))
    record = log.groupBy("commit_id").agg(F.first(head).alias("head"), F.collect_list(line).alias("lines"))
    return put(record.select(F.concat("head", F.lit("\n\n"), F.array_join("lines", "\n")).alias("value")), "gitlog")


@query("select cast(commit_id as varchar) commit_hash, concat('c', contributor, '@x.org') author_email, concat('fix COMMIT:', commit_id, ' | part') message, added lines_added, deleted lines_deleted, concat('/top/src/f', file_id, '.cpp') source_file from commit_log where line_no <> 7", ("commit_log",))
def streamed_commits(log):
    spark, out = log.sparkSession, f"{shared_dir(log.sparkSession)}/streamed-{uuid.uuid4().hex}"
    stream = ingest.commits(spark, _written_log(log), "/top/")
    ingest.append(stream, out, f"{out}-progress").awaitTermination()
    return _commits(spark.read.schema(stream.schema).parquet(out))


@query("select epoch_us(time_bucket(interval '1 hour', make_timestamp(start_ms * 1000))) // 1000 start_ms, step_type, count(*) steps, cast(sum(end_ms - start_ms) as bigint) ms from steps group by 1, 2", ("steps",))
def streamed_step_windows(steps):
    spark, out = steps.sparkSession, f"{shared_dir(steps.sparkSession)}/windows-{uuid.uuid4().hex}"
    rows = steps.select(F.timestamp_millis("start_ms").alias("ts"), "step_type", (F.col("end_ms") - F.col("start_ms")).alias("ms"))
    stream = spark.readStream.schema(rows.schema).parquet(put(rows, "steps", "parquet"))
    ingest.replace(ingest.step_windows(stream), out, f"{out}-progress").awaitTermination()
    return spark.read.parquet(out).select(F.unix_millis("start").alias("start_ms"), "step_type", "steps", "ms")


_OUT = "case file_id % 6 when 0 then concat('a/f', file_id, '.cpp.o') when 1 then concat('lib/l', file_id, '.a') when 2 then concat('lib/l', file_id, '.so') when 3 then concat('bin/f', file_id) when 4 then concat('gen/f', file_id, '.cpp') else concat('doc/f', file_id) end"


@query(f"select size start_ms, size + compile_ms end_ms, 0 restat, {_OUT} as output, 'ab' as hash, case file_id % 6 when 0 then 'compile' when 1 then 'archive' when 2 then 'link' when 3 then 'link' when 4 then 'codegen' else 'other' end step_type from files", ("files",))
def ninja_log(files):
    spark, rows = files.sparkSession, files.withColumn("output", F.expr(_OUT))
    lines = rows.select(F.concat_ws("\t", "size", F.col("size") + F.col("compile_ms"), F.lit("0"), "output", F.lit("ab")).alias("value"))
    path = put(lines.union(spark.createDataFrame([("# ninja log v5",), ("",), ("1\t2\tshort",)], "value string")), "ninja")
    of = lambda k: rows.where(F.col("file_id") % 6 == k).select("output")
    return ps.step_type("output", of(3), of(4), ps.ninja_log(spark, path))


@query("select step_id, case when step_type in ('compile', 'codegen', 'archive', 'link', 'other') then step_type else 'other' end step_type from (select event_id step_id, case when event_type = 'click' then 'compile' when event_type = 'view' then 'link' else event_type end step_type from events)", ("steps",))
def known_step_types(steps):
    kind = F.when(F.col("step_type") == "click", "compile").when(F.col("step_type") == "view", "link").otherwise(F.col("step_type"))
    return steps.select("step_id", ps.known_step(kind).alias("step_type"))


@query("""select file_id, case when size % 2 = 0 then 'gcc' else 'clang' end compiler, cast((case when size % 2 = 0 then size + 0.25 else size + 0.5 end) * 1000 as bigint) wall_total_ms, cast(size * 1000 as double) compiler_parse_time_ms, case when size % 2 = 0 then cast(size * 500 as double) else 0.0 end compiler_template_instantiation_ms,
 case when size % 2 = 0 then cast(750 as double) else cast(size * 250 as double) end compiler_codegen_time_ms, cast(case when size % 2 = 0 then 750 else 125 end as double) compiler_optimization_time_ms from files""", ("files",))  # fmt: skip
def timing_reports(files):
    t = lambda x: F.format_string("%.4f", x.cast("double"))
    gcc = lambda n, w: F.concat(F.lit(f" {n} : "), t(F.lit(0.1)), F.lit(" ( 1%) "), t(F.lit(0.2)), F.lit(" (  2%) "), t(w), F.lit(" ( 33%)   100 kB (  4%)\n"))
    a = F.concat(F.lit("note\nTime variable   usr  sys  wall  GGC\n"), gcc("phase setup", F.lit(9.0)), gcc("phase parsing", F.col("size")), gcc("phase lang. deferred", F.col("size") / 2), gcc("phase opt and generate", F.lit(0.75)), F.lit(" TOTAL : 1.00  1.00  "), t(F.col("size") + 0.25), F.lit("  99 kB\n"))
    row = lambda n, w: F.concat(F.lit("   "), t(F.lit(0.1)), F.lit(" ( 10.0%)   "), t(F.lit(0.1)), F.lit(" ( 10.0%)   "), t(F.lit(0.2)), F.lit(" ( 10.0%)   "), t(w), F.lit(f" ( 10.0%)  12345  {n}\n"))
    bar = "===" + "-" * 20 + "===\n"
    b = F.concat(F.lit(bar + "      Other report\n" + bar), row("Front end", F.lit(99.0)), F.lit(bar + "     Clang time report\n" + bar), row("Front end", F.col("size")), row("Machine code generation", F.col("size") / 4), row("Optimizer", F.lit(0.125)), row("Total", F.col("size") + 0.5))
    rows = files.select("file_id", ps.timing_report(F.when(F.col("size") % 2 == 0, a).otherwise(b)).alias("report"))
    return co.phase_columns(rows).select("file_id", "report.compiler", "report.wall_total_ms", *co.COLUMNS.values())


@query("""select path as source_file, cast(2 + file_id % 3 as bigint) header_max_depth, cast(3 + file_id % 3 as bigint) unique_headers, cast(4 + file_id % 3 as bigint) total_includes from paths""", ("paths",))
def header_trees(paths):
    # a.h, b.h below it, again a.h, then one deeper header for each step
    deep = F.array_join(F.transform(F.sequence(F.lit(1), F.col("file_id") % 3 + 1), lambda k: F.concat(F.repeat(F.lit("."), (k + 1).cast("int")), F.lit(" /usr/include/d"), k.cast("string"), F.lit(".h"))), "\n")
    text = F.concat(F.lit("noise\n. a.h\n.. b.h\n. a.h\n"), deep, F.lit("\nMultiple include guards:\nx.h\n"))
    return paths.select(F.col("path").alias("source_file"), ps.header_tree(text).alias("tree")).select("source_file", *(c.alias(n) for n, c in ps.header_stats(F.col("tree")).items()))


@query("""select path includer, '/p/a.h' included, 1 as depth, path source_file, false as is_system from paths union all select '/p/a.h', concat('/usr/include/s', file_id % 5, '.h'), 2, path, true from paths union all select path, '/p/c.h', 1, path, false from paths""", ("paths",))
def header_edges(paths):
    # the second a.h and c.h's inclusion of itself give no edge
    text = F.concat(F.lit(". /p/a.h\n.. /usr/include/s"), (F.col("file_id") % 5).cast("string"), F.lit(".h\n. /p/c.h\n.. /p/c.h\n. /p/a.h\n"))
    return ps.header_edges(paths.select(F.col("path").alias("source_file"), ps.header_tree(text).alias("tree")))


@query("select path, case when file_id % 11 = 0 or file_id % 4 = 0 then true else false end is_system from paths", ("paths",))
def system_headers(paths):
    at = F.when(F.col("file_id") % 11 == 0, F.concat(F.lit("/usr/include/"), "path")).when(F.col("file_id") % 4 == 0, F.concat(F.lit("/home/x/third_party/"), "path")).otherwise(F.concat(F.lit("/home/usr/include/"), "path"))
    return paths.select("path", ps.is_system(at).alias("is_system"))


@query("select file_id, concat('/top/', path) as path from paths", ("paths",))
def normal_paths(paths):
    return paths.select("file_id", normal_path(F.concat(F.lit("/top//x/../y/./../"), F.replace("path", F.lit("/"), F.lit("//")))).alias("path"))


@query("select file_id, path, size from files", ("files",))
def csv_reader(files):
    path, spark = put(files.select("file_id", "path", "size"), "csv", "csv", header=True), files.sparkSession
    return ps.read_csv(spark, path, "file_id long, path string, size long").union(ps.read_csv(spark, f"{path}-none", "file_id long, path string, size long"))


@query("select path as file, compile_time_ms as ms, case when is_generated then null else code_lines end lines from sources join paths on path = source_file", ("sources", "paths"))
def keyed_json_reader(sources, paths):
    entry = F.struct(F.col("source_file").alias("key"), F.struct(F.col("compile_time_ms").alias("ms"), F.when(~F.col("is_generated"), F.col("code_lines")).alias("lines")).alias("value"))
    one = sources.groupBy("cmake_target").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).select("value")
    path = put(one, "json", maxRecordsPerFile=1)  # a file of one object, as the tools write it
    return ps.read_keyed_json(sources.sparkSession, path, "file", "struct<ms:long,lines:long>")


@query("select file_id, 1 + size % 3 as blank, 3 as comment, cast(2 + size % 2 as bigint) as code from files", ("files",))
def line_counter(files):
    text = F.concat(F.lit("// one\n/* two\nthree */\n"), F.repeat(F.lit("  \n"), (F.col("size") % 3 + 1).cast("int")), F.lit("int a; /* open\nint b;\n"), F.repeat(F.lit("int c; // end\n"), (F.col("size") % 2).cast("int")))
    return m.line_counts(files.withColumn("text", text), "file_id", "text").select("file_id", *(F.col(c).cast("long").alias(c) for c in ("blank", "comment", "code")))


def code_model(edges, paths, minor: int = 9):
    """A reply of the build system, of the targets and edges of the views: link, order, compile and object dependencies by the edge's weight."""
    spark = edges.sparkSession
    names = paths.select(F.col("target").alias("name")).distinct()
    ident = lambda c: F.concat(c, F.lit("::@1"))
    ids = lambda keep: F.collect_list(F.when(keep, F.struct(ident(F.col("dst")).alias("id"))))
    w = F.col("weight")
    deps = edges.groupBy(F.col("src").alias("name")).agg(
        ids(F.lit(True)).alias("dependencies"), ids(w % 5 == 0).alias("linkLibraries"), ids(w % 5 <= 1).alias("orderDependencies"), ids(w % 5 == 2).alias("compileDependencies"), ids((w % 5 == 3) | (w % 35 == 0)).alias("objectDependencies"), ids(w % 10 == 0).alias("interfaceCompileDependencies"),
    )
    source = F.struct(F.col("path"), (F.col("file_id") % 7 == 0).alias("isGenerated"), F.when(F.col("file_id") % 4 != 2, F.lit(0)).alias("compileGroupIndex"))
    files = paths.groupBy(F.col("target").alias("name")).agg(F.transform(F.sort_array(F.collect_list(F.struct("file_id", source.alias("s")))), lambda x: x["s"]).alias("sources"))
    group = F.array(F.struct(F.lit("CXX").alias("language"), F.array(F.struct(F.lit("-O2 -g").alias("fragment"))).alias("compileCommandFragments"), F.array(F.struct(F.lit("/top/./inc").alias("path"), F.lit(False).alias("isSystem")), F.struct(F.lit("/usr/include").alias("path"), F.lit(True).alias("isSystem"))).alias("includes"), F.array(F.struct(F.lit("NDEBUG").alias("define"))).alias("defines")))
    provided = F.col("name").endswith("Brand#11/3")
    body = names.join(files, "name").join(deps, "name", "left").withColumns({"id": ident(F.col("name")), "type": F.lit("STATIC_LIBRARY"), "isGeneratorProvided": provided, "paths": F.struct(F.lit("src").alias("source"), F.lit(".").alias("build")), "compileGroups": group, "artifacts": F.array(F.struct(F.concat(F.lit("lib/"), "name", F.lit(".a")).alias("path")))})
    file = lambda c: F.concat(F.lit("target-"), F.md5(c.cast("binary")), F.lit(".json"))
    targets = body.select(file(F.col("name")).alias("name"), F.to_json(F.struct(*body.columns)).alias("json"))
    entry = F.struct(ident(F.col("name")).alias("id"), "name", file(F.col("name")).alias("jsonFile"))
    model = names.agg(F.sort_array(F.collect_list(entry)).alias("targets")).select(F.lit("codemodel-v2.json").alias("name"), F.to_json(F.struct(F.array(F.struct("targets")).alias("configurations"))).alias("json"))
    index = '{"cmake":{"version":{"string":"4.2"}},"objects":[{"kind":"cache","jsonFile":"c.json","version":{"major":2,"minor":0}},{"kind":"codemodel","jsonFile":"codemodel-v2.json","version":{"major":2,"minor":%d}}]}' % minor
    old = spark.createDataFrame([("index-1.json", '{"objects":[]}'), ("index-2.json", index)], "name string, json string")
    return cm.CodeModel(targets.unionByName(model).unionByName(old), "/top", "/top/build")


_CM = "p as (select distinct target from paths where target not like '%Brand#11/3'), te as (select src, dst, weight from target_edges where src in (select target from p) and dst in (select target from p))"


@query(f""">{_CM} select src source_target, dst dest_target, true is_direct, case weight % 5 when 0 then 'link' when 1 then 'order' when 2 then 'compile' else 'object' end dependency_type, case when weight % 10 = 0 then 'PUBLIC' when weight % 5 = 0 then 'PRIVATE' else 'UNKNOWN' end cmake_visibility from te where weight % 5 <= 3
 union all select src, dst, true, 'object', 'UNKNOWN' from te where weight % 35 = 0 union all select src, dst, false, 'transitive', 'TRANSITIVE' from te where weight % 5 = 4""", ("target_edges", "paths"))  # fmt: skip
def cmake_edges(edges, paths):
    return code_model(edges, paths).edges()


@query(f">{_CM} select src source_target, dst dest_target, false is_direct, 'transitive' dependency_type, 'UNKNOWN' cmake_visibility from te", ("target_edges", "paths"))
def cmake_edges_before(edges, paths):
    return code_model(edges, paths, 8).edges()


@query(f">{_CM} select target, path, file_id % 7 = 0 is_generated, case when file_id % 4 <> 2 then 'CXX' end as language from (select target, concat(case when file_id % 7 = 0 then '/top/build/' else '/top/' end, path) as path, file_id from paths join p using (target))", ("target_edges", "paths"))
def cmake_files(edges, paths):
    return code_model(edges, paths).files().select("target", "path", "is_generated", "language")


@query(f">{_CM} select concat(case when file_id % 7 = 0 then '/top/build/' else '/top/' end, path) as path, target from paths join p using (target)", ("target_edges", "paths"))
def cmake_file_index(edges, paths):
    return code_model(edges, paths).file_index()


@query(f">{_CM} select target, array_to_string(list(concat('/top/build/', path) order by file_id), ',') paths from paths join p using (target) where file_id % 7 = 0 group by 1", ("target_edges", "paths"))
def cmake_generated(edges, paths):
    return code_model(edges, paths).generated().withColumn("paths", F.array_join("paths", ","))


@query(f">{_CM} select target, '/top/src' as source_dir, '/top/build' as build_dir, concat('/top/build/lib/', target, '.a') as artifact, 'STATIC_LIBRARY' as type from p", ("target_edges", "paths"))
def cmake_targets(edges, paths):
    return code_model(edges, paths).targets.select("target", "source_dir", "build_dir", F.col("artifacts")[0].alias("artifact"), "type")


@query(f">{_CM}, f as (select target, concat(case when file_id % 7 = 0 then '/top/build/' else '/top/' end, path) as path from paths join p using (target) where file_id % 4 <> 2) select target, path, concat('c++ -O2 -g -I/top/inc -isystem /usr/include -DNDEBUG ', path) command, concat('c++ -E -O2 -g -I/top/inc -isystem /usr/include -DNDEBUG ', path) preprocess from f", ("target_edges", "paths"))
def compile_commands(edges, paths):
    rows = code_model(edges, paths).commands("c++")
    noisy = F.concat(F.lit("/x/capture_stderr.sh "), F.col("command"), F.lit(" -ftime-report -H -o out.o"))
    return rows.withColumn("preprocess", F.regexp_replace(cm.preprocess_command(noisy), "'", ""))


@query("""select concat('sub/CMakeFiles/', replace(target, '/', '_'), '.dir/', case when file_id % 3 = 0 then path when file_id % 3 = 1 then string_split(path, '/')[-1] else concat('gone', file_id, '.c') end, '.o') as object, case when file_id % 3 < 2 then path end source, case when file_id % 3 < 2 then target else replace(target, '/', '_') end target from paths""", ("paths",))
def object_sources(paths):
    name = F.when(F.col("file_id") % 3 == 0, F.col("path")).when(F.col("file_id") % 3 == 1, F.substring_index("path", "/", -1)).otherwise(F.concat(F.lit("gone"), "file_id", F.lit(".c")))
    objects = paths.select(F.concat(F.lit("sub/CMakeFiles/"), F.replace("target", F.lit("/"), F.lit("_")), F.lit(".dir/"), name, F.lit(".o")).alias("object"))
    return cm.sources_of_objects(objects, paths.select("path", "target"))


@query("select concat('/logs/', substring(md5(path), 1, 16), '.stderr') as log, path from paths", ("paths",))
def log_sources(paths):
    logs = paths.select(F.concat(F.lit("/logs/"), F.substring(F.md5(F.col("path").cast("binary")), 1, 16), F.lit(".stderr")).alias("log"))
    logs = logs.union(logs.sparkSession.createDataFrame([("/logs/0000000000000000.stderr",), ("/logs/x.txt",)], "log string"))
    return cm.sources_of_logs(logs, paths)


@query("select contributor, target as cmake_target, count(*) commit_count from commit_log join files using (file_id) group by 1, 2", ("commit_log", "files"))
def dataset_table(log, files):
    """Written with its numbers as texts, read in its schema, checked, and read by SQL from its view."""
    spark = log.sparkSession
    rows = log.join(files.select("file_id", "target"), "file_id").groupBy(F.col("contributor").cast("string").alias("contributor"), F.col("target").alias("cmake_target")).agg(F.count("*").cast("string").alias("commit_count"))
    data = Dataset(spark, f"{shared_dir(spark)}/dataset-{uuid.uuid4().hex}")
    data.save("contributor_target_commits", rows)
    data.save("own_table", rows.limit(1))
    assert data.has("own_table") and not data.has("edge_list")
    return data.table("contributor_target_commits").select(F.col("contributor").cast("long").alias("contributor"), "cmake_target", "commit_count")


@query("select label, count(*) \"rows\", cast(sum(n) as bigint) n from (select 'baseline_a' as label, contributor, count(*) n from commit_log group by 1, 2 union all select 'later', contributor, count(*) from commit_log where line_no > 1 group by 1, 2) group by 1", ("commit_log",))
def snapshot_tables(log):
    spark, root = log.sparkSession, f"{shared_dir(log.sparkSession)}/snapshots-{uuid.uuid4().hex}"
    snaps = Snapshots(spark, root)
    for label, rows in (("baseline_a", log), ("later", log.where("line_no > 1"))):
        data = Dataset(spark, f"{root}-{label}")
        data.save("contributor_target_commits", rows.groupBy(F.col("contributor").cast("string").alias("contributor")).agg(F.lit("t").alias("cmake_target"), F.count("*").alias("commit_count")))
        snaps.create(label, f"2024-0{1 + (label == 'later')}-01", data)
    before, after = snaps.pair(snaps.baseline(), snaps.latest())
    both = before.table("contributor_target_commits").withColumn("label", F.lit(snaps.baseline())).unionByName(after.table("contributor_target_commits").withColumn("label", F.lit(snaps.latest())))
    return both.groupBy("label").agg(F.count("*").alias("rows"), F.sum("commit_count").alias("n"))


@query("select path, size, case when size % 2 = 0 then size end half from files", ("files",))
def typed_columns(files):
    odd = F.when(F.col("size") % 2 == 0, F.col("size").cast("double")).otherwise(F.lit(float("nan")))
    return conform(files.select("path", F.col("size").cast("string").alias("size"), odd.alias("half")), "path string, size bigint, half bigint, missing string").drop("missing")


@query("select 'a' as value, 1 as place union all select 'b c', 2 union all select 'd', 3", ("files",))
def split_options(files):
    return files.sparkSession.createDataFrame([(v, i) for i, v in enumerate(split_values(["a, b c", "", "a,d", " ,"]), 1)], "value string, place int")
