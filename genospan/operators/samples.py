"""Sample attributes: joins, ranges, groups, filters and orderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospan.scale import ordered_scan


def attach_sample_info(df: DataFrame, attributes: DataFrame, mapping: DataFrame | None = None, sample: str = "sample") -> DataFrame:
    """Attributes of every row's sample; a mapping table renames samples first."""
    named = df
    if mapping is not None:
        dim = mapping.select(F.col("name").alias("__n"), F.col("sample").alias("__s"))
        named = df.join(dim, F.col(sample) == F.col("__n"), "left").withColumn("__key", F.coalesce("__s", F.col(sample))).drop("__n", "__s")
    else:
        named = df.withColumn("__key", F.col(sample))
    info = attributes.withColumnRenamed("sample", "__key")
    return named.join(info, "__key", "left").drop("__key")


def attribute_ranges(attributes: DataFrame) -> DataFrame:
    """Numeric attributes give their range, others one row per distinct text.

    An attribute with any number counts as numeric and its texts are ignored.
    """
    ranges = attributes.groupBy("attribute").agg(F.min("num_value").alias("min_value"), F.max("num_value").alias("max_value"))
    numeric = ranges.where(F.col("min_value").isNotNull()).withColumn("str_value", F.lit(None).cast("string"))
    texts = (
        attributes.join(numeric.select("attribute"), "attribute", "left_anti")
        .where(F.col("str_value").isNotNull())
        .select("attribute", "str_value")
        .distinct()
    )
    return numeric.unionByName(texts, allowMissingColumns=True)


def group_counts(attributes: DataFrame, attribute: str, ascending: bool = True) -> DataFrame:
    """Samples per value of one attribute, in display order (``group_index``).

    Texts come before numbers when ascending.  The counts are reduced first; the
    display position is a blocked running count over the distinct values, cut by
    the first letters of a text or the thousands of a number.
    """
    counts = (
        attributes.where((F.col("attribute") == attribute) & ((F.col("str_value") != "") | (F.col("num_value") != 0)))
        .groupBy("str_value", "num_value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("__one", F.lit(1))
        .withColumn("__num", F.col("num_value").isNotNull())
    )
    block = F.struct("__num", F.substring("str_value", 1, 3).alias("s"), F.floor(F.col("num_value") / 1000).alias("k"))
    ranked = ordered_scan(
        counts, ["__one"], ["__num", "str_value", "num_value"], block, reverse=not ascending, __at=("sum", F.lit(1))
    )
    return ranked.select("str_value", "num_value", "n", (F.col("__at") - 1).cast("int").alias("group_index"))


def _attribute_order(ascending: bool):
    is_number = F.col("num_value").isNotNull().cast("int")
    if ascending:
        return [is_number.asc(), F.col("str_value").asc(), F.col("num_value").asc()]
    return [is_number.desc(), F.col("str_value").desc(), F.col("num_value").desc()]


def sample_filter(samples: DataFrame, scores: DataFrame, op: str, value: float | None = None) -> DataFrame:
    """Keep samples by their score in one region; chain calls to combine filters.

    ``>`` and ``<`` compare the segment score, ``HAS`` / ``NOT HAS`` test for
    mutations.  A sample without a score fails ``>``, ``<`` and ``HAS``.
    """
    if op in (">", "<"):
        hit = F.col("score") > value if op == ">" else F.col("score") < value
        return samples.join(scores.where(hit).select("sample"), "sample", "left_semi")
    touched = scores.where(F.col("score") != 0).select("sample")
    return samples.join(touched, "sample", "left_semi" if op == "HAS" else "left_anti")


def sort_samples_by_value(samples: DataFrame, scores: DataFrame, ascending: bool = True) -> DataFrame:
    """Order by region score; a missing score or a score of 0 goes last either way."""
    joined = samples.join(scores.select("sample", "score"), "sample", "left")
    key = F.when(F.col("score") != 0, F.col("score"))
    return joined.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last())


def sort_samples_by_genotype(samples: DataFrame, scores: DataFrame, ascending: bool = True) -> DataFrame:
    """Order by genotype score; a missing score counts as 0."""
    joined = samples.join(scores.select("sample", "score"), "sample", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    return joined.orderBy(F.col("score").asc() if ascending else F.col("score").desc())


def sort_samples_by_attribute(samples: DataFrame, attributes: DataFrame, attribute: str, ascending: bool = True) -> DataFrame:
    """Texts before numbers when ascending, numbers before texts when descending.

    Samples without the attribute are dropped.
    """
    values = attributes.where(F.col("attribute") == attribute).select("sample", "str_value", "num_value")
    return samples.join(values, "sample").orderBy(*_attribute_order(ascending))


def export_samples(attributes: DataFrame) -> DataFrame:
    """One JSON text per sample with its attributes as texts and numbers."""
    entry = F.struct(F.col("attribute").alias("k"), F.coalesce("str_value", F.col("num_value").cast("string")).alias("v"))
    packed = attributes.groupBy("sample").agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("m"))
    return packed.select("sample", F.to_json("m").alias("json"))


def attribute_names(attributes: DataFrame) -> Sequence[str]:
    return [r["attribute"] for r in attributes.select("attribute").distinct().orderBy("attribute").collect()]
