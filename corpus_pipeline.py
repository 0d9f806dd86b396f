"""From raw documents to encoded ones: the stages of the corpus pipeline, in order.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of documents.  run() applies them to documents, each stage's result written to
the shared folder and read again.  The classifier and the retrieval have no SQL, so there is none
for the whole; tests/llm holds the stages against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildloom.llm import bpe, decontam, near_dup, pii, quality
from buildloom.llm.common import ship, written
from buildloom.llm.queries import tokenizer

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker does not reject."""
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five words, 0.8)."""
    ship(spark)
    return near_dup.keep_one_of_each(docs, k=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    ship(spark)
    return pii.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip): BPE ids, and whether they decode to the text."""
    ship(spark)
    path = tokenizer("byte_bpe_50k.json")
    frame = docs.select("doc_id", "text", "lang", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    out = bpe.decode(bpe.encode(frame, path), path)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2(F.col("decoded").cast("binary"), 256) == F.col("sha")).alias("round_trip"))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("BPE encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
