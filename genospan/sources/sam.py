"""SAM text to alignment rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genospan.functions import reads as R
from genospan.sources.lines import field, long_field, once, read_lines


def read_sam(spark: SparkSession, path) -> DataFrame:
    return parse_sam(read_lines(spark, path))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Mapped alignments: positions 0-based (the mate position too), tags as a map.

    Unmapped rows and header lines are dropped.  ``qual`` stays as text; see
    ``functions.reads.qual_array`` and ``qual_at`` for numbers.
    """
    t = lines.where(~F.col("value").startswith("@")).select(once(F.split("value", "\t")).alias("t"))
    # TAG:TYPE:VALUE; a value may itself contain colons.
    part = lambda x, i: F.get(x, F.lit(i))
    extra = F.transform(F.slice(F.col("t"), 12, F.greatest(F.size("t") - 11, F.lit(0))), lambda x: F.split(x, ":", 3))
    t = t.select("t", F.filter(extra, lambda x: (F.size(x) == 3) & (part(x, 0) != "")).alias("tag"))
    t = t.select("t", "tag", F.transform("tag", lambda x: part(x, 0)).alias("name"))
    # Of a repeated tag the last stays; most lines repeat none.
    last = F.filter("tag", lambda x, i: ~F.exists(F.slice("tag", i + 2, F.size("tag")), lambda y: part(y, 0) == part(x, 0)))
    kept = F.when(F.size(F.array_distinct("name")) == F.size("name"), F.col("tag")).otherwise(last)
    tags = F.map_from_entries(F.transform(kept, lambda x: F.struct(part(x, 0), part(x, 2))))
    rows = t.select(
        field(0).alias("read_name"),
        long_field(1).cast("int").alias("flags"),
        field(2).alias("chr"),
        (long_field(3) - 1).alias("start"),
        long_field(4).cast("int").alias("mq"),
        field(5).alias("cigar"),
        F.when(field(6) == "=", field(2)).otherwise(field(6)).alias("mate_chr"),
        (long_field(7) - 1).alias("mate_pos"),
        long_field(8).alias("tlen"),
        field(9).alias("seq"),
        field(10).alias("qual"),
        tags.alias("tags"),
    )
    mapped = rows.where((F.col("chr") != "*") & ~R.has_flag("unmapped"))
    length = R.length_on_ref("cigar")
    return mapped.withColumn("length_on_ref", length).withColumn("end", F.col("start") + F.col("length_on_ref"))


def with_parts(alignments: DataFrame) -> DataFrame:
    """Add ``parts``: CIGAR operations with positions, the basis of blocks, gaps and insertions."""
    return alignments.withColumn("parts", R.cigar_parts())
