"""Repeatable down-sampling: hash order instead of a random generator.

The same rows are kept on every run and after the loss of an executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genospan.operators.genome import to_genome_coordinate
from genospan.scale import hashed_order, top_k_per_group

MAX_WHOLE_GENOME = 10_000
SAMPLING_WINDOW = 100


def downsample_reads(
    reads: DataFrame, depth: int, window: int = SAMPLING_WINDOW, *, paired: bool = False, seed: int = 0
) -> DataFrame:
    """At most ``depth`` read names per window of a fixed grid (half of it when paired).

    A read name is placed in the window of its first alignment; all alignments
    of a kept name stay and all of a dropped name go, so mates and chimeric parts
    are treated as one.  Only names and starts are ranked; the reads themselves
    are filtered by a semi join.
    """
    if paired:
        depth = max(1, depth // 2)
    bucket = F.floor(F.col("start") / window).cast("long")
    names = reads.groupBy("read_name").agg(F.min(F.struct("chr", bucket.alias("bucket"))).alias("p"))
    places = names.select("read_name", F.col("p.chr").alias("chr"), F.col("p.bucket").alias("bucket"))
    kept = top_k_per_group(places, ["chr", "bucket"], hashed_order("read_name", seed=seed), depth, ["read_name"])
    return reads.join(kept.select("read_name"), "read_name", "left_semi")


def downsample_stats(reads: DataFrame, depth: int, window: int = SAMPLING_WINDOW, *, paired: bool = False) -> DataFrame:
    """Windows in which read names were dropped, with the number dropped."""
    if paired:
        depth = max(1, depth // 2)
    bucket = F.floor(F.col("start") / window).cast("long")
    names = reads.groupBy("read_name").agg(F.min(F.struct("chr", bucket.alias("bucket"))).alias("p"))
    sizes = names.groupBy(F.col("p.chr").alias("chr"), F.col("p.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.where(F.col("n") > depth).select(
        "chr",
        (F.col("bucket") * window).alias("start"),
        ((F.col("bucket") + 1) * window).alias("end"),
        (F.col("n") - depth).alias("dropped"),
    )


def generic_sample(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` rows in hash order of ``key``; a top-n that never sorts the whole table."""
    return df.orderBy(*hashed_order(*key, seed=seed)).limit(n)


def whole_genome_sample(
    features: DataFrame, offsets: DataFrame, key: Sequence[str], limit: int = MAX_WHOLE_GENOME, seed: int = 0
) -> DataFrame:
    """At most ``limit`` features on the whole-genome axis.

    Duplicate rows of two-chromosome features and chromosomes outside the
    whole-genome list are left out.
    """
    rows = features.where(~F.coalesce(F.col("dup"), F.lit(False))) if "dup" in features.columns else features
    if "chr2" in features.columns:
        two = rows.withColumn("chr", F.col("chr1"))
        first = to_genome_coordinate(two, offsets, "start1", "wg_start")
        second = first.withColumn("chr", F.coalesce("chr2", "chr1"))
        placed = to_genome_coordinate(second, offsets, "end2", "wg_end")
    else:
        placed = to_genome_coordinate(rows, offsets, "start", "wg_start")
        placed = to_genome_coordinate(placed, offsets, "end", "wg_end")
    inside = placed.where(F.col("wg_start").isNotNull() & F.col("wg_end").isNotNull())
    return generic_sample(inside, limit, key, seed).withColumn("chr", F.lit("all"))


def interaction_wg_sample(
    pairs: DataFrame, offsets: DataFrame, key: Sequence[str], limit: int = MAX_WHOLE_GENOME, strata: int = 5, seed: int = 0
) -> DataFrame:
    """Two-anchor features on the whole-genome axis, sampled by score.

    When there are more than ``limit`` rows and a positive score, the rows are put
    into ``strata`` classes of equal width in log score, each class gives at most
    ``limit / strata`` rows, and the row with the highest score is always kept.
    """
    rows = pairs.where(~F.coalesce(F.col("dup"), F.lit(False)))
    listed = offsets.select("chr")
    rows = rows.join(listed.withColumnRenamed("chr", "chr1"), "chr1", "left_semi")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    total = totals.select(F.struct("n", "top")).scalar()
    staged = rows.withColumn("__t", total)
    split = (F.col("__t.top") > 0) & (F.col("__t.n") > limit)
    step = F.when(F.log("__t.top") != 0, F.log("__t.top") / strata)
    at = F.coalesce(F.floor(F.log("score") / step), F.lit(0))
    stratum = F.when(split & (F.col("score") > 0), F.greatest(F.lit(0), F.least(F.lit(strata - 1), at))).otherwise(F.lit(0))
    staged = staged.withColumn("__split", split).withColumn("__stratum", stratum.cast("int"))
    order = hashed_order(*key, seed=seed)
    # Without strata one class may take the whole limit, so it is ranked once up to the limit.
    kept = top_k_per_group(staged, ["__stratum"], order, limit, key)
    ranked = kept.withColumn("__r", F.row_number().over(Window.partitionBy("__stratum").orderBy(*order)))
    sampled = ranked.where((~F.col("__split")) | (F.col("__r") <= limit // strata)).drop("__r")
    best = staged.orderBy(F.col("score").desc_nulls_last(), *key).limit(1).where("__split")
    out = sampled.unionByName(best).drop("__t", "__split", "__stratum").dropDuplicates(list(key))
    return whole_genome_sample(out, offsets, key, limit=limit + 1, seed=seed)
