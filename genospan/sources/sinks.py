"""Writers: JSON feature sets, BED text, and Parquet laid out for range queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def bed_text(df: DataFrame) -> DataFrame:
    """BED lines with the coordinates as stored; missing middle fields read ``.``."""
    optional = [c for c in ("name", "score", "strand") if c in df.columns]
    cells = [F.col(c).cast("string") for c in ("chr", "start", "end")]
    cells += [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(".")) for c in optional]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def write_bed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    bed_text(df).write.mode(mode).text(path)


def write_intervals(df: DataFrame, path: str, mode: str = "errorifexists", partitions: int | None = None, longest: int | None = None) -> None:
    """Parquet in folders by chromosome, sorted by start inside each file.

    Rows are range partitioned on (chr, start), so a large chromosome becomes many
    files whose start ranges do not overlap: a range query prunes folders by
    chromosome and files and row groups by start.  ``longest`` (measured where not given) is the length of
    the longest interval; it is kept with the data, so that a query by end prunes by start as well.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    length = F.lit(longest) if longest is not None else df.agg(F.max(F.col("end") - F.col("start"))).scalar()
    laid = df.withColumn("longest", length.cast("long")).repartitionByRange(n, "chr", "start").sortWithinPartitions("chr", "start")
    laid.write.mode(mode).partitionBy("chr").parquet(path)


def read_intervals(spark: SparkSession, path: str, chroms: Sequence[str], start: int, end: int) -> DataFrame:
    """Intervals of a store that touch [start, end] on some chromosomes.

    The longest interval of the store bounds from where on one may reach ``start``; the bound goes into the
    scan beside ``end``, so that both ends prune row groups.
    """
    stored = spark.read.parquet(path)
    longest = stored.agg(F.max("longest")).first()[0]  # from the files' statistics
    near = stored.where(F.col("chr").isin(*chroms) & (F.col("start") <= end) & (F.col("start") >= start - (longest or 0)))
    return near.where(F.col("end") >= start).drop("longest")
