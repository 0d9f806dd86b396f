"""The typed tables of a processed build, their checks, and snapshots of them."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .parsers import exists

# The tables' columns and types.
SCHEMAS = {
    "file_metrics": """source_file string, cmake_target string, is_generated boolean, language string, compile_time_ms bigint,
        compiler_parse_time_ms double, compiler_template_instantiation_ms double, compiler_codegen_time_ms double, compiler_optimization_time_ms double,
        compiler_total_time_ms double, compiler_total_usr_ms double, compiler_total_sys_ms double, code_lines bigint, blank_lines bigint, comment_lines bigint,
        source_size_bytes bigint, header_max_depth bigint, unique_headers bigint, total_includes bigint, header_tree string, preprocessed_bytes bigint,
        object_size_bytes bigint, git_commit_count bigint, git_lines_added bigint, git_lines_deleted bigint, git_churn bigint, git_distinct_authors bigint,
        git_first_change_date string, git_last_change_date string, expansion_ratio double, compile_rate_lines_per_sec double, object_efficiency double""",
    "target_metrics": """cmake_target string, target_type string, output_artifact string, source_directory string, directory_depth bigint, file_count bigint,
        codegen_file_count bigint, authored_file_count bigint, codegen_ratio double, code_lines_total bigint, code_lines_authored bigint, code_lines_generated bigint,
        compile_time_sum_ms bigint, compile_time_max_ms bigint, compile_time_mean_ms double, compile_time_median_ms double, compile_time_std_ms double,
        compile_time_p90_ms double, compile_time_p99_ms double, authored_compile_time_sum_ms bigint, authored_compile_time_max_ms bigint,
        codegen_compile_time_sum_ms bigint, codegen_compile_time_max_ms bigint, compiler_parse_time_sum_ms double, compiler_template_time_sum_ms double,
        compiler_codegen_phase_sum_ms double, compiler_optimization_time_sum_ms double, compiler_total_usr_sum_ms double, compiler_total_sys_sum_ms double,
        header_depth_max bigint, header_depth_mean double, unique_headers_total bigint, total_includes_sum bigint, preprocessed_bytes_total bigint,
        preprocessed_bytes_mean double, expansion_ratio_mean double, object_size_total_bytes bigint, object_file_count bigint, codegen_time_ms bigint,
        archive_time_ms bigint, link_time_ms bigint, total_build_time_ms bigint, git_commit_count_total bigint, git_churn_total bigint, git_distinct_authors bigint,
        git_hotspot_file_count bigint, direct_dependency_count bigint, transitive_dependency_count bigint, total_dependency_count bigint,
        direct_dependant_count bigint, transitive_dependant_count bigint, topological_depth bigint, critical_path_contribution_ms bigint, fan_in bigint,
        fan_out bigint, betweenness_centrality double, source_files string, generated_files string, output_files string""",
    "edge_list": "source_target string, dest_target string, is_direct boolean, dependency_type string, source_target_type string, dest_target_type string, from_dependency string, cmake_visibility string",
    "contributor_target_commits": "contributor string, cmake_target string, commit_count bigint",
    "git_commit_log": "commit_hash string, timestamp timestamp, contributor string, source_file string, lines_added bigint, lines_deleted bigint",
    "header_edges": "includer string, included string, depth bigint, source_file string, is_system boolean",
    "header_metrics": "header_file string, cmake_target string, sloc bigint, source_size_bytes bigint, is_system boolean",
    "build_schedule": "output_file string, source_file string, cmake_target string, step_type string, start_time_ms bigint, end_time_ms bigint, duration_ms bigint",
}
#: columns that are never null, by table
REQUIRED = {
    "file_metrics": ("source_file", "cmake_target"), "target_metrics": ("cmake_target",), "edge_list": ("source_target", "dest_target", "is_direct"),
    "contributor_target_commits": ("contributor", "cmake_target"), "git_commit_log": ("commit_hash", "contributor", "source_file"),
    "header_edges": ("includer", "included", "source_file"), "header_metrics": ("header_file",), "build_schedule": ("output_file", "step_type"),
}
STEP_TYPES = ("compile", "codegen", "archive", "link", "other")
LABEL = re.compile(r"^[a-zA-Z][a-zA-Z0-9_-]*$")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with the schema's columns cast, missing ones null, and others kept after them; NaN counts as null."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    have = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def one(f) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f.name)
        if have[f.name] in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        return c.try_cast(f.dataType).alias(f.name)

    return df.select(*(one(f) for f in fields), *(c for c in df.columns if c not in {f.name for f in fields}))


def uncastable(df: DataFrame, schema: str) -> dict[str, int]:
    """How many values of each column the schema's type does not take, in one pass."""
    fields = [f for f in df.sparkSession.createDataFrame([], schema).schema.fields if f.name in df.columns]
    lost = lambda f: F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
    fields = [f for f in fields if df.schema[f.name].dataType != f.dataType]
    return df.agg(*(lost(f).alias(f.name) for f in fields)).head().asDict() if fields else {}


def project_file(folder: str, name: str, levels: int = 5) -> str | None:
    """The file of that name in the folder or in the nearest of its ancestors, so many folders at most; None if there is none."""
    here = Path(folder)
    for _ in range(levels):
        if (here / name).exists():
            return str(here / name)
        here = here.parent
    return None


class Dataset:
    """Lazily read tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str, check: bool = True):
        self.spark, self.folder, self.check, self._held = spark, folder.rstrip("/"), check, {}

    def has(self, name: str) -> bool:
        return exists(self.spark, f"{self.folder}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        """A core table in its schema, or an intermediate one as it is; a missing one raises FileNotFoundError."""
        if name not in self._held:
            if not self.has(name):
                raise FileNotFoundError(f"{name}.parquet is not in {self.folder}")
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            raw, df = df, conform(df, SCHEMAS[name]) if name in SCHEMAS else df
            if self.check and name in SCHEMAS:
                bad = {r.rule: r.failures for r in self.faults(name, df).where("failures > 0").collect()}
                bad |= {f"{c} is of its type": n for c, n in uncastable(raw, SCHEMAS[name]).items() if n}
                if bad:
                    raise ValueError(f"{name}: rows that fail {bad}")
            self._held[name] = df
        return self._held[name]

    def faults(self, name: str, df: DataFrame) -> DataFrame:
        """(rule, failures): keys that are null, negative sizes and times, unknown step types; one pass."""
        from ..operators.metrics import check

        rules = {f"{c} is not null": F.col(c).isNotNull() for c in REQUIRED[name]}
        rules |= {f"{f.name} >= 0": F.col(f.name).isNull() | (F.col(f.name) >= 0) for f in df.schema.fields if f.dataType.typeName() in ("long", "double") and f.name in SCHEMAS[name]}
        if name == "build_schedule":
            rules["step_type is known"] = F.col("step_type").isin(*STEP_TYPES)
        return check(df, rules)

    def save(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}.parquet")
        self._held.pop(name, None)

    def views(self) -> list[str]:
        """Binds every core table that is there as a temporary view for SQL."""
        there = [n for n in SCHEMAS if self.has(n)]
        for n in there:
            self.table(n).createOrReplaceTempView(n)
        return there


class Snapshots:
    """Labelled copies of a dataset: root/<label>/processed/<table>.parquet, with an index table of labels and dates."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def list(self) -> DataFrame:
        """(label, date, description), oldest first; of one label the latest entry."""
        path = f"{self.root}/index"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], "label string, date string, description string")
        rows = self.spark.read.schema("label string, date string, description string").json(path)
        return rows.groupBy("label").agg(F.max(F.struct("date", "description")).alias("x")).select("label", "x.*").orderBy("date", "label")

    def create(self, label: str, date: str, data: Dataset, description: str = "") -> Dataset:
        if not LABEL.match(label):
            raise ValueError(f"{label!r} is no label: a letter, then letters, digits, _ and -")
        out = Dataset(self.spark, f"{self.root}/{label}/processed", data.check)
        for name in SCHEMAS:
            if data.has(name):
                out.save(name, data.table(name))
        self.spark.createDataFrame([(label, date, description)], "label string, date string, description string").write.mode("append").json(f"{self.root}/index")
        return out

    def get(self, label: str) -> Dataset:
        return Dataset(self.spark, f"{self.root}/{label}/processed")

    def baseline(self) -> str | None:
        """The first label that begins with `baseline`."""
        return next((r.label for r in self.list().collect() if r.label.startswith("baseline")), None)

    def latest(self) -> str | None:
        row = self.list().orderBy(F.desc("date"), F.desc("label")).head()
        return row.label if row else None

    def pair(self, before: str, after: str) -> tuple[Dataset, Dataset]:
        """Two snapshots to compare; FileNotFoundError for a label without tables."""
        for label in (before, after):
            if not exists(self.spark, f"{self.root}/{label}/processed"):
                raise FileNotFoundError(f"no snapshot {label!r} in {self.root}")
        return self.get(before), self.get(after)

    def all(self, table: str) -> DataFrame | None:
        """The table of every snapshot that has it, with label and date."""
        out = None
        for r in self.list().collect():
            d = self.get(r.label)
            if d.has(table):
                df = d.table(table).withColumns({"label": F.lit(r.label), "date": F.lit(r.date)})
                out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out
