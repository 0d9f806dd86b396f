"""Churn, ownership and co-change over a commit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, key: list[str], order: list[str], last: bool = True) -> DataFrame:
    """The last (or first) row of each key in the given order."""
    by = [F.desc_nulls_last(c) if last else F.asc_nulls_last(c) for c in order]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("__n = 1").drop("__n")


def file_churn(log: DataFrame) -> DataFrame:
    """Commits, authors, line counts, age and commits a month (30.44 days) of each file; a file of one day counts its commits as monthly."""
    out = log.groupBy("file_id").agg(
        F.countDistinct("commit_id").alias("n_commits"), F.countDistinct("contributor").alias("n_authors"),
        F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    days = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 86_400_000_000
    out = out.withColumn("churn", F.col("added") + F.col("deleted")).withColumn("age_days", days)
    month = F.when(F.col("age_days") > 0, F.col("n_commits") / (F.col("age_days") / 30.44)).otherwise(F.col("n_commits").cast("double"))
    return out.withColumn("commits_per_month", month).drop("first", "last")


def commit_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("commit_id").agg(F.countDistinct("file_id").alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.sum(F.col("added") + F.col("deleted")).alias("churn"))


def contributor_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("contributor").agg(F.countDistinct("commit_id").alias("commits"), F.countDistinct("file_id").alias("files"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def without_mega_commits(log: DataFrame, most_files: int) -> DataFrame:
    """Rows of commits that touch most_files distinct files or fewer."""
    small = log.groupBy("commit_id").agg(F.countDistinct("file_id").alias("n")).where(F.col("n") <= most_files)
    return log.join(small.select("commit_id"), "commit_id", "left_semi")


def resolve_identities(log: DataFrame, identities: DataFrame) -> DataFrame:
    """log with canonical name, team and whether the contributor is known."""
    out = log.join(identities, "contributor", "left")
    return out.withColumn("is_resolved", F.coalesce("is_resolved", F.lit(False))).withColumn("team", F.when(F.col("is_resolved"), F.col("team"))).withColumn("canonical", F.when(F.col("is_resolved"), F.col("canonical")))


def team_ownership(rows: DataFrame, item: str) -> DataFrame:
    """Owner (most commits, ties by name), its share, team HHI and cross-team share of each item; shares are of all commits, unresolved ones too."""
    total = rows.groupBy(item).agg(
        F.count("*").alias("total_commits"), F.count_if(~F.col("is_resolved")).alias("unresolved"),
        (F.countDistinct(F.when(F.col("is_resolved"), F.col("canonical"))) + F.countDistinct(F.when(~F.col("is_resolved"), F.col("contributor")))).alias("contributors"),
    )
    teams = rows.where("team is not null").groupBy(item, "team").agg(F.count("*").alias("n"))
    own = teams.groupBy(item).agg(F.min(F.struct((-F.col("n")).alias("minus"), "team")).alias("top"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("teams"))
    out = total.join(own, item, "left")
    n = F.col("total_commits")
    share = F.coalesce(-F.col("top.minus") / n, F.lit(0.0))
    return out.select(item, F.col("top.team").alias("owning_team"), share.alias("owning_share"), F.coalesce(F.col("squares") / (n * n), F.lit(0.0)).alias("team_hhi"), (1 - share).alias("cross_team_fraction"), "total_commits", "unresolved", "contributors", F.coalesce("teams", F.lit(0)).alias("teams"))


def concentration(log: DataFrame, item: str) -> DataFrame:
    """Gini, HHI, top share and the number of contributors behind half of the distinct commits of each item."""
    n = log.groupBy(item, "contributor").agg(F.countDistinct("commit_id").alias("n"))
    up = Window.partitionBy(item).orderBy("n", "contributor")
    down = Window.partitionBy(item).orderBy(F.desc("n"), "contributor").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(item)
    ranked = n.withColumn("rank", F.row_number().over(up)).withColumn("cum", F.sum("n").over(down)).withColumn("total", F.sum("n").over(whole))
    x, k = F.sum("n"), F.count("*")
    return ranked.groupBy(item).agg(
        F.when(x > 0, (2 * F.sum(F.col("rank") * F.col("n")) - (k + 1) * x) / (k * x)).otherwise(0.0).alias("gini"),
        (F.sum(F.col("n") * F.col("n")) / (x * x)).alias("hhi"), (F.max("n") / x).alias("top_share"),
        (F.count_if(F.col("cum") * 2 <= F.col("total")) + 1).alias("bus_factor"), k.alias("contributors"), x.alias("commits"),
    )


def decayed_ownership(log: DataFrame, item: str, half_life_days: float) -> DataFrame:
    """Each contributor's share of an item when a commit's weight halves every half_life_days before the log's end."""
    end = log.agg(F.max("ts").alias("end"))
    age = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000
    w = log.crossJoin(F.broadcast(end)).groupBy(item, "contributor").agg(F.sum(F.exp(-F.log(F.lit(2.0)) / half_life_days * age)).alias("weight"))
    return w.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(item)))


def recent_bus_factor(rows: DataFrame, item: str, group: str, months: int) -> DataFrame:
    """Distinct contributors of each (item, group) within the last months of the log."""
    end = rows.agg(F.max("ts").alias("end"))
    recent = rows.crossJoin(F.broadcast(end)).where(F.col("ts") >= F.expr(f"end - interval {months} months"))
    return recent.groupBy(item, group).agg(F.countDistinct("contributor").alias("bus_factor"))


def contributor_matrix(log: DataFrame, item: str, least_contributor: int, least_item: int) -> DataFrame:
    """Commit counts in long form, without contributors and items below their totals (both over all rows), and as row shares."""
    n = log.groupBy("contributor", item).agg(F.count("*").alias("n"))
    people = n.groupBy("contributor").agg(F.sum("n").alias("t")).where(F.col("t") >= least_contributor).select("contributor")
    items = n.groupBy(item).agg(F.sum("n").alias("t")).where(F.col("t") >= least_item).select(item)
    kept = n.join(people, "contributor", "left_semi").join(items, item, "left_semi")
    return kept.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("contributor")))


def cochange(log: DataFrame, item: str, most_items: int = 50, least: int = 3) -> DataFrame:
    """Pairs of items in `least` or more commits of at most most_items items, with PMI (base 2) and Jaccard.

    Commits above most_items are left out by definition, so a commit gives at most most_items**2 / 2 pairs."""
    one = log.select("commit_id", F.col(item).alias("item")).distinct()
    size = one.groupBy("commit_id").agg(F.count("*").alias("k")).where(F.col("k") <= most_items)
    kept = one.join(size.select("commit_id"), "commit_id", "left_semi")
    total = kept.agg(F.countDistinct("commit_id").alias("total"))
    each = kept.groupBy("item").agg(F.count("*").alias("n"))
    pairs = kept.withColumnRenamed("item", "item_a").join(kept.withColumnRenamed("item", "item_b"), "commit_id").where("item_a < item_b")
    pairs = pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    pairs = pairs.join(each.select(F.col("item").alias("item_a"), F.col("n").alias("a")), "item_a").join(each.select(F.col("item").alias("item_b"), F.col("n").alias("b")), "item_b").crossJoin(F.broadcast(total))
    return pairs.select("item_a", "item_b", "together", F.log2(F.col("together") * F.col("total") / (F.col("a") * F.col("b"))).alias("pmi"), (F.col("together") / (F.col("a") + F.col("b") - F.col("together"))).alias("jaccard"))
