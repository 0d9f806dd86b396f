"""Column helpers with the engine's conventions: zero denominators give null, missing counts as zero."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def six_places(c: Column) -> Column:
    """A number to six places by arithmetic in doubles, halves away from zero, as the check queries round."""
    return F.round(c.cast("double") * 1e6) / 1e6


def minmax(df: DataFrame, **columns: str) -> DataFrame:
    """df with each new column scaled to 0..1 over the table; nulls count as 0 and a constant gives 0.

    The extremes are one row, joined back; no window over the whole table."""
    value = {new: F.coalesce(F.col(old).cast("double"), F.lit(0.0)) for new, old in columns.items()}
    ends = df.agg(*(f(v).alias(f"__{n}_{new}") for new, v in value.items() for n, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(ends))  # one row by construction
    for new, v in value.items():
        lo, hi = F.col(f"__lo_{new}"), F.col(f"__hi_{new}")
        out = out.withColumn(new, F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0))
    return out.drop(*ends.columns)


def glob(column: str, pattern: str) -> Column:
    """Whether a shell pattern matches the whole value."""
    return F.col(column).rlike("^" + fnmatch.translate(pattern))


def extension(column: str) -> Column:
    """The last suffix with its dot, or an empty string."""
    return F.regexp_extract(column, r"(\.[^./]*)$", 1)


def normal_path(column: str | Column) -> Column:
    """A path without empty parts, `.` and `..` where it can be resolved."""
    path = F.col(column) if isinstance(column, str) else column
    parts = F.split(path, "/")
    absolute = path.startswith("/")

    def step(done: Column, part: Column) -> Column:
        up = F.size(done) > 0
        top = F.element_at(done, -1)
        return (
            F.when(part.isin("", "."), done)
            .when((part == "..") & up & (top != ".."), F.slice(done, 1, F.size(done) - 1))
            .when((part == "..") & absolute, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    joined = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(joined == "", ".").otherwise(joined)


def resolved_path(path: Column, base: Column) -> Column:
    """A path from its base folder, or by itself if it is absolute, without `.` and `..`."""
    return normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path)))


def split_values(values) -> list[str]:
    """The parts of comma-separated options given several times: in order, once each, without blanks."""
    parts = (p.strip() for v in values or () for p in str(v).split(","))
    return list(dict.fromkeys(p for p in parts if p))
