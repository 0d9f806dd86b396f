"""Where queries register: a function of views, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: the closure of `edges`, for the check queries
CLOSURE = ">c(src, dst) as (select src, dst from edges union select c.src, e.dst from c join edges e on e.src = c.dst)"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zeros."""
    return df.select(*(F.round(f.name, 6).alias(f.name) + F.lit(0.0) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields)).toDF(*df.columns)


def query(sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    """Registers a function of views, in their order, as a query; sql reads the same views."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(*(v.view(spark, sf_dir, n) for n in views)))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql if sql.startswith("with") else v.ctes(*views, recursive=recursive) + ("," if sql.lstrip().startswith(">") else "") + "\n" + sql.lstrip().removeprefix(">")
        return f

    return add
