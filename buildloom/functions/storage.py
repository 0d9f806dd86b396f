"""Written tables in the folder that all machines see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  A local session that names none gets a folder of its own, removed when Python ends; on a cluster that is an error, as its machines share no such folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that all machines share")
            folder = tempfile.mkdtemp(prefix="buildloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for a session's context."""
    sc = spark.sparkContext
    if not getattr(sc, "_buildloom_shipped", False):
        here = Path(__file__).resolve().parents[1]
        where = Path(tempfile.mkdtemp(prefix="buildloom-")) / "buildloom_package.zip"
        with zipfile.ZipFile(where, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        sc.addPyFile(str(where))
        sc._buildloom_shipped = True
