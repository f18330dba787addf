"""A corpus pipeline of five stages: toxicity, near-duplicates, personal data, mixing, packing.

Every stage reads what the one before has kept and writes Parquet; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genospan.llm.minhash import near_duplicates
from genospan.llm.mixing import mix_sources
from genospan.llm.packing import pack_documents
from genospan.llm.surrogates import EXAMPLE_KEY, replace_entities
from genospan.llm.toxicity import THRESHOLD, with_toxicity
from genospan.session import ensure_checkpoint_dir


def apart(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with the columns that a stage does not use under names no operator makes."""
    return docs.select(*[F.col(c).alias(c if c in used else f"__own_{k}") for k, c in enumerate(docs.columns)])


def back(made: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` again."""
    return made.select(*[F.col(c if c in used else f"__own_{k}").alias(c) for k, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold, rows without an id or a text included."""
    scored = with_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), into="__toxicity")
    return scored.where(F.col("__toxicity") < THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows that repeat an id are one document; rows without an id stay.
    """
    found = near_duplicates(docs)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    known, unknown = left.where("doc_id is not null"), left.where("doc_id is null")
    # Rows are told apart by a digest, so that no sort holds whole texts as its key.
    digest = F.md5(F.to_json(F.struct("text", "source", "lang")).cast("binary"))
    once = known.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy(digest)))
    return once.where("__n = 1").select(*docs.columns).union(unknown)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets; ``n_chars`` follows the text."""
    made = replace_entities(apart(docs, "text", "n_chars"), key=EXAMPLE_KEY)
    if "n_chars" in made.columns:
        made = made.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return back(made, docs, "text", "n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources."""
    used = ("doc_id", "text", "source")
    return back(mix_sources(apart(docs, *used)), docs, *used)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, one row per piece."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("source_mixing", mix),
    ("packing", pack),
]

# The stages train a classifier, hash sets and run a tokenizer: no SQL says that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes Parquet to a new folder beside the checkpoints, the next reads it."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
