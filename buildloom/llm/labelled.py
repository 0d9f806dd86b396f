"""Labelled documents for fitting: all, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of all labelled documents, by the rules of training_sample."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 0))
    chosen = chosen.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most `most` labelled documents, chosen by a hash of the id.

    Rows whose crc32(id as text) mod 5 is 0 are never taken, nor are null labels or ids; of
    several labels for one id the largest counts, of several texts the first in order.  The chosen
    ids, `most` at the most, are broadcast, so that no text moves but the sample's."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 0))
    chosen = chosen.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")
