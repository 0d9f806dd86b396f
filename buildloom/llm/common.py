"""What the operators share: the folder all machines see, written tables, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  A local session that names none gets a folder of its own, removed when Python ends; on a cluster that is an error, as its machines share no such folder."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if not now.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that all machines share")
            folder = tempfile.mkdtemp(prefix="buildloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
        now = sc._jsc.sc().getCheckpointDir()
    return now.get()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(key: str, remainder: int) -> F.Column:
    """Whether crc32 of the key as text leaves this remainder on division by 5 (a null key does not)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(u, v): the smallest node that can be reached.

    Each round takes the least label among the neighbours, then jumps to that label's own label;
    rounds grow with the logarithm of a component's width.  Only pairs of ids move, each round is
    a written table, and a node with very many links is summed up before it is shuffled."""
    both = written(links.select("u", "v").union(links.select("v", "u")).where("u <> v").distinct(), "links")
    label = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        seen = both.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("m"))
        near = label.join(seen.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = written(near.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("label")), "labels")
        done = new.where("old <> label").isEmpty()
        label = new.select("node", "label")
        if done:
            return label


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts(..., n) from some count upwards, `most` at most: the count is read off a histogram of under 1,100 steps."""
    step = F.floor(F.log2("n") * 16)
    room, least = most, None
    for r in sorted(counts.where("n > 0").groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect(), key=lambda r: -r["s"]):
        if r["c"] > room:
            break
        room, least = room - r["c"], r["s"]
    return counts.where(F.lit(False)) if least is None else counts.where((F.col("n") > 0) & (step >= least))


#: texts handed to Python at once, so that neither side holds many MB of them
TEXTS_AT_ONCE = 500


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for a session's context, and keeps Arrow batches of texts small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > TEXTS_AT_ONCE:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_AT_ONCE))
    sc = spark.sparkContext
    if not getattr(sc, "_buildloom_shipped", False):
        here = Path(__file__).resolve().parents[1]
        where = Path(tempfile.mkdtemp(prefix="buildloom-")) / "buildloom_package.zip"
        with zipfile.ZipFile(where, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        sc.addPyFile(str(where))
        sc._buildloom_shipped = True
