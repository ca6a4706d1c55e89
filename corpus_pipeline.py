"""A training corpus from raw documents: toxicity, exact dedup, near-duplicate join, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next
stage's docs. All but the last return the columns of documents, and any further ones whatever their names. ORACLE_SQL is None: a trained classifier and a
tokenizer can't be expressed in SQL; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.llm import best_fit, exact_dedup, mixing, ngram_join, queries, toxicity
from grainline.llm.store import cut, free

ORACLE_SQL = None


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a written table with a number for each row, and that column's name (none that docs has)."""
    row = free(docs, "_row")
    return cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine scores at 0.3 or above go. Null and empty texts stay, repeated rows are judged each, and no
    labels or no rows drop nothing."""
    machine = toxicity.learn(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, machine, threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the largest doc_id stays, a null one only where there is
    no other; of rows that repeat it one."""
    held, row = numbered(docs)
    found = exact_dedup.dedup(held.select(F.struct("doc_id", F.col(row).alias("row")).alias("doc_id"), "text"))
    return held.join(found.where("kept").select(F.col("doc_id.row").alias(row)), row, "left_semi").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that 5-gram similarities of 0.8 or more connect, one with the smallest doc_id stays (a null one only
    where there is no other). Rows are told apart by number, so that rows without an id and texts that share one are judged each.
    Null and empty texts are like no other and stay."""
    held, row = numbered(docs)
    found = ngram_join.join(held.select(F.col(row).alias("doc_id"), "text"), n=5, threshold=0.8).select(F.col("doc_id").alias(row), "class_id")
    ids = held.select(F.col("doc_id").alias("id"), row).join(found, row)
    kept = ids.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
    return held.join(kept, row, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' targets take them, to the nearest whole number. A null source is one of its own;
    documents without a word are taken by no target and go."""
    return mixing.apply(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens; a null text is packed as its end alone, repeated rows each."""
    return best_fit.pack_documents(docs, queries.tokenizer_path(), max_len=4096, eos=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, name)
    return docs
