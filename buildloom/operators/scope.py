"""Scopes: which targets a question is about, as a frame of keys that other frames are joined with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import glob
from . import graph as g

#: threshold options and the columns they hold for
THRESHOLDS = {"min_build_ms": "ms", "min_commits": "commits", "min_dependants": "dependants", "min_files": "files", "min_lines": "lines"}


def resolve(targets: DataFrame, edges: DataFrame, *, names=(), globs=(), types=(), directories=(), modules=(), teams=(), depends_on=(), dependencies_of=(), exclude=(), exclude_globs=(), **least: float) -> DataFrame:
    """The targets(node, kind, directory, module, team, ...) that fit, as (node).

    Related targets (depends_on: all that depend on these; dependencies_of: all that these need; with
    the named ones themselves) are united, then narrowed by each option given, then what is excluded
    goes.  Unknown names and empty scopes raise ValueError, thresholds count null as 0."""
    named = {*names, *depends_on, *dependencies_of, *exclude}
    if named:
        known = {r[0] for r in targets.where(F.col("node").isin(list(named))).select("node").collect()}
        if lost := sorted(named - known, key=str):
            raise ValueError(f"unknown targets: {lost}")
    if unknown := set(least) - set(THRESHOLDS):
        raise ValueError(f"unknown options: {sorted(unknown)}")
    out = targets
    if depends_on or dependencies_of:
        pairs = g.closure(edges)
        parts = [targets.where(F.col("node").isin([*depends_on, *dependencies_of])).select("node")]
        if depends_on:
            parts.append(pairs.where(F.col("dst").isin(list(depends_on))).select(F.col("src").alias("node")))
        if dependencies_of:
            parts.append(pairs.where(F.col("src").isin(list(dependencies_of))).select(F.col("dst").alias("node")))
        out = out.join(reduce(DataFrame.union, parts).distinct(), "node", "left_semi")
    either = lambda tests: reduce(lambda a, b: a | b, tests)
    for wanted, column in ((names, "node"), (types, "kind"), (modules, "module"), (teams, "team")):
        if wanted:
            out = out.where(F.col(column).isin(list(wanted)))
    if globs:
        out = out.where(either([glob("node", p) for p in globs]))
    if directories:
        out = out.where(either([F.col("directory").startswith(d) for d in directories]))
    for option, value in least.items():
        out = out.where(F.coalesce(F.col(THRESHOLDS[option]), F.lit(0)) >= value)
    if exclude:
        out = out.where(~F.col("node").isin(list(exclude)))
    if exclude_globs:
        out = out.where(~either([glob("node", p) for p in exclude_globs]))
    out = out.select("node").distinct()
    if out.isEmpty():
        raise ValueError("no target fits the scope")
    return out


def induced(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """The edges with both ends in the scope."""
    both = edges.join(scope.select(F.col("node").alias("src")), "src", "left_semi").join(scope.select(F.col("node").alias("dst")), "dst", "left_semi")
    return both.select(*edges.columns)
