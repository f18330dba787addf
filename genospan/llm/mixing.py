"""Mixing sources to target weights: repetition rates per source, whole copies plus one seeded draw.

Only DataFrame functions are used.  The documents are read twice (sizes per
source, then copies) and never shuffled; the table of sources is one row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genospan.llm.words import WORD_PATTERN

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MOST_COPIES = 2.0
SEED = 17


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    source: str,
    size: str,
    weights: Sequence[float] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    most: float = MOST_COPIES,
) -> DataFrame:
    """Target size of each source, ``sizes`` having one row per source.

    Sources take the weights in turn, by code point, null last.  They share
    ``total_share`` of all sizes by weight; no target exceeds ``most`` times the
    source's size, and what is cut goes to the others by weight.  Filling to a common level solves this at once: sources
    are full in the order of capacity per weight, and the level of the rest
    is what is left over their weights.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    cap = F.col(size).cast("double") * most
    rows = sizes.withColumn("__weight", weight).withColumn("__cap", cap)
    rows = rows.withColumn("__full_at", F.col("__cap") / F.col("__weight"))
    filling = Window.orderBy("__full_at", F.col(source).asc_nulls_last())
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum(F.col(size).cast("double")).over(everything) * min(total_share, most)
    level = (total - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0))) / F.sum("__weight").over(onward)
    rows = rows.withColumn("__level", level)
    # The level of the first source that it does not fill holds for all after it.
    reached = F.min(F.when(F.col("__level") <= F.col("__full_at"), F.struct("__full_at", "__level"))).over(everything)
    target = F.least("__cap", F.coalesce(F.col("__weight") * reached["__level"], F.col("__cap")))
    return rows.withColumn("__target", target).select(source, size, F.col("__target").alias("target"))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only (28 bits of an MD5 digest)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("double") / float(16**7)


def repetition_plan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    *,
    weights: Sequence[float] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    most: float = MOST_COPIES,
    seed: int = SEED,
) -> DataFrame:
    """Every document with its ``size``, ``source_size``, ``target`` and number of ``copies``.

    A document gets floor(rate) copies and one more with the fraction of the
    rate as probability, rate being target over size of its source.  Null
    text has size 0, null sources form one source, repeated rows draw alike,
    an empty table gives an empty one.  Columns of ``docs`` are kept; columns of
    the same names as the new ones are replaced.
    """
    made = {"size", "source_size", "target", "rate", "copies"}
    kept = [F.col(c) for c in docs.columns if c not in made or c in (doc_id, text, source)]
    sized = docs.select(*kept, word_count(F.col(text)).alias("__size"))
    sources = (
        docs.select(F.col(source).alias("__source"), word_count(F.col(text)).alias("__size"))
        .groupBy("__source")
        .agg(F.sum("__size").alias("__source_size"))
    )
    targets = source_targets(sources, "__source", "__source_size", weights, total_share, most)
    # The table of sources is one row per source; Spark sends it to the documents where its size allows.
    joined = sized.join(targets, F.col(source).eqNullSafe(F.col("__source")), "left")
    rate = F.when(F.col("__source_size") > 0, F.col("target") / F.col("__source_size")).otherwise(F.lit(0.0))
    whole = F.floor("__rate")
    extra = (uniform(seed, F.col(doc_id)) < F.col("__rate") - whole).cast("long")
    return (
        joined.withColumn("__rate", rate)
        .withColumn("copies", (whole + extra).cast("long"))
        .select(
            *kept,
            F.col("__size").alias("size"),
            F.col("__source_size").alias("source_size"),
            "target",
            F.col("__rate").alias("rate"),
            "copies",
        )
    )


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents: each row as often as its plan says, with the columns of ``docs``."""
    plan = repetition_plan(docs, doc_id, text, source, **options)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return plan.where("copies > 0").withColumn("__copy", times).select(*docs.columns)
