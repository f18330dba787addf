"""Binned summaries, zoom levels and value scaling of signal tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospan.scale import BLOCK_BP, block_of, label_runs, ordered_scan


def finite_only(signal: DataFrame, column: str = "value") -> DataFrame:
    """Drop NaN, infinite and missing values."""
    v = F.col(column)
    return signal.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def bin_summarize(
    signal: DataFrame,
    bin_size: float,
    how: str = "mean",
    *,
    by: Sequence[str] = ("chr",),
    origin: Column | int = 0,
    block_bp: int = BLOCK_BP,
) -> DataFrame:
    """Summarise sorted, non-overlapping signal into bins of ``bin_size``.

    A row counts in the bin of its end, and also in the bin of its start when the
    previous row ended there.  The bins between become one flat block with the
    row's own value.  The mean is over rows, not over base pairs.  Neighbours with
    equal values that touch are merged.  ``origin`` is the first base of bin 0.
    Bins of one base or fewer, or ``how='none'``, return the input.
    """
    by = list(by)
    if bin_size <= 1 or how == "none":
        return signal.select(*by, "start", "end", "value")
    base = F.lit(origin) if isinstance(origin, (int, float)) else origin
    size = F.lit(bin_size)
    rows = (
        signal.withColumn("__o", base.cast("double"))
        .withColumn("__sb", F.floor((F.col("start") - F.col("__o")) / size))
        .withColumn("__eb", F.floor((F.col("end") - F.col("__o")) / size))
    )
    linked = ordered_scan(rows, by, ["start"], block_of("start", block_bp), __pe=("lag", F.col("__eb")))
    linked = linked.withColumn("__joined", F.coalesce(F.col("__sb") == F.col("__pe"), F.lit(False)))

    touched = F.when(
        F.col("__joined") & (F.col("__sb") < F.col("__eb")), F.array("__sb", "__eb")
    ).otherwise(F.array("__eb"))
    bins = linked.select(*by, "__o", F.explode(touched).alias("__b"), "value")
    pick = {"mean": F.sum("value") / F.count("value"), "min": F.min("value"), "max": F.max("value")}[how]
    binned = (
        bins.groupBy(*by, "__o", "__b")
        .agg(pick.alias("value"))
        .select(
            *by,
            (F.col("__o") + F.col("__b") * size).alias("start"),
            (F.col("__o") + (F.col("__b") + 1) * size).alias("end"),
            F.col("value").cast("double").alias("value"),
            F.lit(0).alias("__kind"),
        )
    )
    flat = linked.where(F.col("__eb") > F.col("__sb") + F.col("__joined").cast("int")).select(
        *by,
        F.col("start").cast("double").alias("start"),
        (F.col("__o") + F.col("__eb") * size).alias("end"),
        F.col("value").cast("double").alias("value"),
        F.lit(1).alias("__kind"),
    )
    return merge_equal_neighbours(binned.unionByName(flat), by, order=("start", "__kind"), block_bp=block_bp)


def merge_equal_neighbours(
    signal: DataFrame, by: Sequence[str] = ("chr",), order: Sequence[str] = ("start",), *, block_bp: int = BLOCK_BP
) -> DataFrame:
    """Join touching neighbours that carry the same value."""
    by, order = list(by), list(order)
    runs = label_runs(
        signal,
        by,
        order,
        block_of(order[0], block_bp),
        F.struct(F.col("value").alias("value"), F.col("end").alias("end")),
        lambda prev: ~((F.col("value") == prev["value"]) & (F.col("start") <= prev["end"])),
        "__run",
    )
    return (
        runs.groupBy(*by, "__run", "value")
        .agg(F.min("start").alias("start"), F.max_by("end", F.struct(*order)).alias("end"))
        .select(*by, "start", "end", "value")
    )


def zoom_rollup(signal: DataFrame, levels: Sequence[int], by: Sequence[str] = ("chr",)) -> DataFrame:
    """Pre-binned levels with count, min, max, sum and sum of squares.

    The rows are reduced once at the finest level; coarser levels are built from
    that result, so the input is read and shuffled a single time.
    """
    levels = sorted(levels)
    finest = levels[0]
    if any(lv % finest for lv in levels):
        raise ValueError("every level must be a multiple of the finest level")
    by = list(by)
    v = F.col("value")
    base = (
        signal.groupBy(*by, F.floor(F.col("start") / finest).alias("__b"))
        .agg(
            F.count(v).alias("valid_count"),
            F.min(v).alias("min_value"),
            F.max(v).alias("max_value"),
            F.sum(v).alias("sum_value"),
            F.sum(v * v).alias("sum_squares"),
        )
    )
    each = F.explode(F.array(*[F.lit(lv) for lv in levels])).alias("level")
    spread = base.select("*", each).withColumn("start", F.floor(F.col("__b") * finest / F.col("level")) * F.col("level"))
    return (
        spread.groupBy(*by, "level", "start")
        .agg(
            F.sum("valid_count").alias("valid_count"),
            F.min("min_value").alias("min_value"),
            F.max("max_value").alias("max_value"),
            F.sum("sum_value").alias("sum_value"),
            F.sum("sum_squares").alias("sum_squares"),
        )
        .withColumn("end", F.col("start") + F.col("level"))
    )


def choose_level(levels: Sequence[int], bp_per_pixel: float) -> int | None:
    """The coarsest level that is still finer than a pixel; None means raw data."""
    for lv in sorted(levels, reverse=True):
        if lv < bp_per_pixel:
            return lv
    return None


def level_values(rollup: DataFrame, level: int, how: str = "mean") -> DataFrame:
    """One zoom level as signal. ``level`` prunes partitions when the roll-up is stored by level."""
    pick = {
        "mean": F.try_divide("sum_value", "valid_count"),
        "min": F.col("min_value"),
        "max": F.col("max_value"),
    }[how]
    keep = [c for c in rollup.columns if c not in ("level", "valid_count", "min_value", "max_value", "sum_value", "sum_squares")]
    return rollup.where((F.col("level") == level) & (F.col("valid_count") > 0)).select(*keep, pick.alias("value"))


def rollup_statistics(rollup: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, spread and the default display range of a data set.

    ``stddev`` is the root of sum-of-squares / (n - 1), without centring, and the
    range is mean +- 2 stddev, cut at zero on a side that has no values there.
    Feed a single level (the finest) so that every value counts once.
    """
    stats = rollup.groupBy(*by).agg(
        F.sum("valid_count").alias("n"),
        F.sum("sum_value").alias("__s"),
        F.sum("sum_squares").alias("__q"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
    )
    out = stats.withColumn("mean", F.try_divide("__s", "n")).withColumn(
        "stddev", F.when(F.col("n") > 1, F.sqrt(F.try_divide(F.col("__q"), F.col("n") - 1)))
    )
    low = F.when(F.col("min_value") < 0, F.col("mean") - 2 * F.col("stddev")).otherwise(F.lit(0.0))
    high = F.when(F.col("max_value") > 0, F.col("mean") + 2 * F.col("stddev")).otherwise(F.lit(0.0))
    return out.withColumn("default_min", low).withColumn("default_max", high).drop("__s", "__q")


def autoscale(signal: DataFrame, by: Sequence[str] = ("track",)) -> DataFrame:
    """Display range per group: zero baseline, NaN ignored, (0, 100) when nothing is left."""
    v = F.when(~F.isnan("value"), F.col("value"))
    ranges = signal.groupBy(*by).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    low = F.coalesce(F.least(F.lit(0.0), F.col("__lo")), F.lit(0.0))
    high = F.when(F.col("__hi").isNull(), F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.col("__hi")))
    return ranges.select(*by, low.alias("min_value"), high.alias("max_value"))


def range_extremes(signal: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest and smallest value per group; the maximum defaults to 100, the minimum is at most 0."""
    return signal.groupBy(*by).agg(
        F.coalesce(F.max("value"), F.lit(100.0)).alias("max_in_range"),
        F.least(F.lit(0.0), F.coalesce(F.min("value"), F.lit(0.0))).alias("min_in_range"),
    )


def scale_values(signal: DataFrame, factor: float | Column = 1.0, total: DataFrame | None = None, per: float = 1e6) -> DataFrame:
    """Multiply values by ``factor``; with ``total`` (a one-row table) also by ``per / total``."""
    scale = F.lit(factor) if isinstance(factor, (int, float)) else factor
    if total is not None:
        scale = scale * F.lit(per) / total.scalar()
    return signal.withColumn("value", F.col("value") * scale)
