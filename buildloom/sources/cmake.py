"""The build system's code model, from its reply files to targets, files, edges and compile commands.

A reply is a frame (name, json) of files; each target's file is parsed by the task that holds it,
and dependencies meet their targets' names in joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import normal_path, resolved_path

# The fields of the reply files that are read.
INDEX = "struct<cmake:struct<version:struct<string:string>>,objects:array<struct<kind:string,jsonFile:string,version:struct<major:int,minor:int>>>>"
MODEL = "struct<configurations:array<struct<targets:array<struct<id:string,name:string,jsonFile:string>>,abstractTargets:array<struct<id:string,name:string,jsonFile:string>>>>>"
IDS = "array<struct<id:string>>"
KINDS = {"link": "linkLibraries", "order": "orderDependencies", "compile": "compileDependencies", "object": "objectDependencies"}
TARGET = (
    "struct<name:string,id:string,type:string,nameOnDisk:string,isGeneratorProvided:boolean,paths:struct<source:string,build:string>,artifacts:array<struct<path:string>>,"
    "sources:array<struct<path:string,isGenerated:boolean,compileGroupIndex:int>>,"
    "compileGroups:array<struct<language:string,languageStandard:struct<standard:string>,compileCommandFragments:array<struct<fragment:string>>,includes:array<struct<path:string,isSystem:boolean>>,defines:array<struct<define:string>>>>,"
    f"dependencies:{IDS}," + ",".join(f"{f}:{IDS}" for f in KINDS.values()) + f",interfaceCompileDependencies:{IDS},link:struct<commandFragments:array<struct<fragment:string>>>>"
)
#: the code model's minor version from which dependencies are told apart
TELLS_APART = 9


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """(name, json) of the reply files in a folder."""
    return spark.read.text(f"{folder.rstrip('/')}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("json"))


class CodeModel:
    """The targets of a reply: of the last index, its code model, and the targets' own files.

    targets(ord, target, id, source_dir, build_dir, body): generator-provided ones are left out; names(id, name): of all entries."""

    def __init__(self, files: DataFrame, source_dir: str, build_dir: str):
        last = files.where("name like 'index-%.json'").agg(F.max_by("json", "name").alias("json")).select(F.from_json("json", INDEX).alias("x")).head()
        if last is None or last["x"] is None:
            raise ValueError("no index-*.json among the replies")
        entry = next((o for o in last["x"]["objects"] or [] if o["kind"] == "codemodel"), None)
        if entry is None:
            raise ValueError("the index names no codemodel")
        self.cmake_version = last["x"]["cmake"]["version"]["string"] if last["x"]["cmake"] else None
        self.version = (entry["version"]["major"], entry["version"]["minor"])
        model = files.where(F.col("name") == entry["jsonFile"]).select(F.from_json("json", MODEL)["configurations"][0].alias("c"))
        every = F.concat(F.coalesce("c.targets", F.array()), F.coalesce("c.abstractTargets", F.array()))
        entries = model.select(F.posexplode(every).alias("ord", "e")).select("ord", "e.id", "e.name", "e.jsonFile")
        self.names = entries.select("id", "name").dropDuplicates(["id"])
        body = entries.select("ord", F.col("jsonFile").alias("file")).join(files.withColumnRenamed("name", "file"), "file").select("ord", F.from_json("json", TARGET).alias("body"))
        body = body.where(~F.coalesce("body.isGeneratorProvided", F.lit(False)))
        self.source_dir, self.build_dir = source_dir, build_dir
        self.targets = body.select(
            "ord", F.col("body.name").alias("target"), F.col("body.id").alias("id"), F.coalesce("body.type", F.lit("UTILITY")).alias("type"),
            resolved_path(F.col("body.paths.source"), F.lit(source_dir)).alias("source_dir"), resolved_path(F.col("body.paths.build"), F.lit(build_dir)).alias("build_dir"),
            F.col("body.nameOnDisk").alias("name_on_disk"), F.transform(F.coalesce("body.artifacts", F.array()), lambda a: resolved_path(a["path"], F.lit(build_dir))).alias("artifacts"), "body",
        )

    def files(self) -> DataFrame:
        """(target, position, path, is_generated, group, language) of all sources; a generated one's relative path begins at the build folder."""
        own = lambda s: F.struct(s["path"].alias("path"), F.coalesce(s["isGenerated"], F.lit(False)).alias("made"), s["compileGroupIndex"].alias("group"), F.get("body.compileGroups", s["compileGroupIndex"])["language"].alias("language"))
        # a source takes its language along, so that no row of a source holds its target's whole reply
        rows = self.targets.select("ord", "target", F.posexplode(F.transform(F.coalesce("body.sources", F.array()), own)).alias("position", "s"))
        base = F.when(F.col("s.made"), F.lit(self.build_dir)).otherwise(F.lit(self.source_dir))
        return rows.select("ord", "target", "position", resolved_path(F.col("s.path"), base).alias("path"), F.col("s.made").alias("is_generated"), F.col("s.group").alias("group"), F.col("s.language").alias("language"))

    def file_index(self) -> DataFrame:
        """(path, target): of a file of several targets the last one counts."""
        return self.files().groupBy("path").agg(F.max_by("target", F.struct("ord", "position")).alias("target"))

    def generated(self) -> DataFrame:
        """(target, paths): the generated files of the targets that have any, in their order."""
        rows = self.files().where("is_generated").groupBy("target").agg(F.sort_array(F.collect_list(F.struct("position", "path"))).alias("x"))
        return rows.select("target", F.transform("x", lambda x: x["path"]).alias("paths"))

    def edges(self) -> DataFrame:
        """(source_target, dest_target, is_direct, dependency_type, cmake_visibility) between targets that were parsed.

        A direct dependency is of the first of link, order and compile that names it, and an object
        dependency gives an edge of its own beside.  A linked one is PUBLIC if the interface needs
        it to compile too, else PRIVATE.  All other dependencies are transitive.  Before minor
        version 9 all are, and nothing is known of who sees them.  Entries without an id are skipped."""
        ids = lambda f: F.filter(F.transform(F.coalesce(F.col(f"body.{f}"), F.array().cast(IDS)), lambda e: e["id"]), lambda i: i.isNotNull())
        t = self.targets
        if self.version[1] < TELLS_APART:
            rows = t.select("target", F.explode(ids("dependencies")).alias("id")).select("target", "id", F.lit(False).alias("is_direct"), F.lit("transitive").alias("kind"), F.lit("UNKNOWN").alias("visibility"))
        else:
            own = t.select("target", *(F.array_distinct(ids(f)).alias(k) for k, f in KINDS.items()), ids("interfaceCompileDependencies").alias("seen"), ids("dependencies").alias("all"))
            kinds = {"link": F.col("link"), "order": F.array_except("order", "link"), "compile": F.array_except("compile", F.array_union("link", "order")), "object": F.col("object")}

            def made(kind: str) -> Column:
                seen = lambda i: F.when(F.array_contains(F.col("seen"), i), "PUBLIC").otherwise("PRIVATE") if kind == "link" else F.lit("UNKNOWN")
                return F.transform(kinds[kind], lambda i: F.struct(i.alias("id"), F.lit(True).alias("is_direct"), F.lit(kind).alias("kind"), seen(i).alias("visibility")))

            direct = F.concat(*(F.col(k) for k in KINDS))
            rest = F.transform(F.filter("all", lambda i: ~F.array_contains(direct, i)), lambda i: F.struct(i.alias("id"), F.lit(False).alias("is_direct"), F.lit("transitive").alias("kind"), F.lit("TRANSITIVE").alias("visibility")))
            rows = own.select("target", F.explode(F.concat(*(made(k) for k in kinds), rest)).alias("e")).select("target", "e.*")
        known = self.names.join(t.select(F.col("target").alias("name")).distinct(), "name", "left_semi")
        return rows.join(known, "id").select(F.col("target").alias("source_target"), F.col("name").alias("dest_target"), "is_direct", F.col("kind").alias("dependency_type"), F.col("visibility").alias("cmake_visibility"))

    def commands(self, compiler: str) -> DataFrame:
        """(target, path, command) of the files that a compile group tells how to compile: compiler, flags, folders, definitions, file."""
        groups = self.targets.select("ord", F.posexplode(F.coalesce("body.compileGroups", F.array())).alias("group", "g"))
        flags = F.array_join(F.transform(F.coalesce("g.compileCommandFragments", F.array()), lambda f: F.coalesce(f["fragment"], F.lit(""))), " ")
        include = lambda i: F.concat(F.when(i["isSystem"], "-isystem ").otherwise("-I"), normal_path(i["path"]))
        parts = F.concat(F.when(flags != "", F.array(flags)).otherwise(F.array().cast("array<string>")), F.transform(F.coalesce("g.includes", F.array()), include), F.transform(F.coalesce("g.defines", F.array()), lambda d: F.concat(F.lit("-D"), d["define"])))
        rows = self.files().join(groups.select("ord", "group", parts.alias("parts")), ["ord", "group"])
        return rows.select("target", "path", F.concat_ws(" ", F.lit(compiler), "parts", "path").alias("command"))


#: options that ask for reports, and a mark of the wrapper that keeps them
REPORTS, WRAPPER = ("-ftime-report", "-H"), "capture_stderr"


def preprocess_command(command: Column) -> Column:
    """A compile command that preprocesses to standard output: without output file, reports and wrapper.  Null if a command cannot be split.

    Quoting follows the shell's rules, which columns cannot tell, so this is a function over batches in Python."""

    def batch(commands: pd.Series) -> pd.Series:
        return commands.map(_preprocessing)

    return F.pandas_udf(batch, "string")(command)


def _preprocessing(text: str | None) -> str | None:
    import shlex

    try:
        words = shlex.split(text) if text is not None else None
    except ValueError:
        return None
    if words is None:
        return None
    kept, skip = [], False
    for w in words:
        if skip:
            skip = False
        elif w == "-o":
            skip = True
        elif w not in REPORTS and WRAPPER not in w:
            kept.append(w)
    return " ".join(shlex.quote(w) for w in [*kept[:1], *(["-E"] if kept else []), *kept[1:]])


def object_parts(path: Column) -> tuple[Column, Column]:
    """(target, source suffix) of an object file below `CMakeFiles/<target>.dir/`; null where it lies elsewhere."""
    inside = F.regexp_extract(path, r"(?:^|/)CMakeFiles/([^/]+)\.dir/(.*)$", 1)
    rest = F.regexp_extract(path, r"(?:^|/)CMakeFiles/([^/]+)\.dir/(.*)$", 2)
    return F.nullif(inside, F.lit("")), F.nullif(F.regexp_replace(rest, r"\.o$", ""), F.lit(""))


def sources_of_objects(objects: DataFrame, index: DataFrame) -> DataFrame:
    """objects(object) with source and target: the first file by path of index(path, target) that ends as the object's own path does; else no source, and the target that the folder names.

    An ending with a folder in it fixes the file's name, so those join on it; others join on the ends of names."""
    target, suffix = object_parts(F.col("object"))
    rows = objects.select("object", target.alias("named"), suffix.alias("suffix"))
    name = lambda c: F.substring_index(c, "/", -1)
    files = index.select("path", "target", name(F.col("path")).alias("name"))
    deep = rows.where("contains(suffix, '/')").withColumn("name", name(F.col("suffix"))).join(files, "name").where("endswith(path, suffix)")
    ends = files.select("path", "target", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("name"), F.lit(1))), lambda k: F.right("name", k))).alias("suffix"))
    flat = rows.where("suffix is not null and not contains(suffix, '/')").join(ends, "suffix")
    found = deep.select("object", "path", "target").union(flat.select("object", "path", "target")).groupBy("object").agg(F.min(F.struct("path", "target")).alias("x"))
    return rows.join(found, "object", "left").select("object", F.col("x.path").alias("source"), F.coalesce("x.target", "named").alias("target"))


def log_name(path: Column) -> Column:
    """The name of the file that a source's compiler messages are kept in."""
    return F.concat(F.substring(F.md5(path.cast("binary")), 1, 16), F.lit(".stderr"))


def sources_of_logs(logs: DataFrame, files: DataFrame) -> DataFrame:
    """logs(log, ...) of known files(path), with the path; the log's name is a hash of it."""
    named = files.select("path").distinct().select(log_name(F.col("path")).alias("name"), "path")
    return logs.withColumn("name", F.substring_index("log", "/", -1)).join(named, "name").drop("name")
