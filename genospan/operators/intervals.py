"""Range queries, overlap joins, nearest features, coverage and region scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genospan.scale import BLOCK_BP, all_of, block_of, cut_lineage, ordered_scan
from genospan.session import ship_by_value

ship_by_value(__name__)

# The four range predicates; a feature is [start, end), a query is [q_start, q_end).
PREDICATES = {
    "closed": lambda s, e, qs, qe: (s <= qe) & (e >= qs),
    "mixed": lambda s, e, qs, qe: (s <= qe) & (e > qs),
    "signal": lambda s, e, qs, qe: (s < qe) & (e >= qs),
    "half": lambda s, e, qs, qe: (s < qe) & (e > qs),
}

LEVEL_STEP = 64
MAX_LEVEL = 3
# Features of one bin that may meet its regions in one task.
HOT_BIN_ROWS = 2_000_000


def range_query(features: DataFrame, chr: str, start: int, end: int, mode: str = "closed", sort: bool = True) -> DataFrame:
    """Features of one locus, by start. The conditions reach the Parquet scan as filters."""
    hit = features.where(F.col("chr") == F.lit(chr)).where(
        PREDICATES[mode](F.col("start"), F.col("end"), F.lit(start), F.lit(end))
    )
    return sort_by_start(hit) if sort else hit


def sort_by_start(features: DataFrame) -> DataFrame:
    return features.orderBy("chr", "start")


def click_query(features: DataFrame, chr: str, position: float, tolerance: float = 0) -> DataFrame:
    """Features under a point, widened by ``tolerance`` base pairs on both sides."""
    return range_query(features, chr, position - tolerance, position + tolerance, mode="closed")


@dataclass(frozen=True)
class JoinLayout:
    """Bin width, and the number of the coarsest size level used on either side.

    The tops only steer cost: an interval longer than its side's top level allows
    stays on that level and takes more bins, so results never depend on them.
    """

    bin_size: int
    feature_top: int = 0
    region_top: int = 0


def measure_layout(features: DataFrame, regions: DataFrame) -> JoinLayout:
    """Pick the bin width from both length distributions (one aggregate row per side)."""

    def lengths(df):
        n = F.greatest(F.col("end") - F.col("start"), F.lit(1))
        return df.agg(F.percentile_approx(n, 0.95), F.max(n)).first()

    f, r = lengths(features), lengths(regions)
    bin_size = max(64, int(max(f[0] or 1, r[0] or 1)))

    def top(longest):
        level, size = 0, bin_size * LEVEL_STEP
        while level < MAX_LEVEL and (longest or 0) > size:
            level, size = level + 1, size * LEVEL_STEP
        return level

    return JoinLayout(bin_size, top(f[1]), top(r[1]))


def _level(length: Column, bin_size: int, top: int) -> Column:
    expr = F.lit(top)
    for lv in reversed(range(top)):
        expr = F.when(length <= F.lit(bin_size * LEVEL_STEP ** (lv + 1)), F.lit(lv)).otherwise(expr)
    return expr


def _bins(width: int) -> Column:
    return F.sequence(F.floor(F.col("start") / F.lit(width)), F.floor(F.greatest("end", "start") / F.lit(width)))


def _cells(bin_size: int, level: int) -> Column:
    return F.transform(
        _bins(bin_size * LEVEL_STEP**level), lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin"))
    )


def _binned(df: DataFrame, bin_size: int, own_top: int, other_top: int) -> DataFrame:
    """One row per (level, bin) the interval touches, on its own level and on every
    coarser level a partner may have.  Within its level an interval takes at most
    LEVEL_STEP + 1 bins, on a coarser one at most two.
    """
    if own_top == 0 and other_top == 0:
        return df.withColumns({"__lv": F.lit(0), "__level": F.lit(0), "__bin": F.explode(_bins(bin_size))})
    leveled = df.withColumn("__lv", _level(F.col("end") - F.col("start"), bin_size, own_top))
    cells = []
    for lv in range(max(own_top, other_top) + 1):
        here = _cells(bin_size, lv)
        wanted = F.col("__lv") <= lv if lv <= other_top else F.col("__lv") == lv
        cells.append(F.when(wanted, here).otherwise(F.slice(here, 1, 0)))
    return leveled.select("*", F.explode(F.concat(*cells)).alias("__cell")).select(
        *df.columns, "__lv", F.col("__cell.level").alias("__level"), F.col("__cell.bin").alias("__bin")
    )


def overlap_join(
    features: DataFrame,
    regions: DataFrame,
    mode: str = "half",
    *,
    layout: JoinLayout | None = None,
    prefix: str = "region_",
    hot_bin_rows: int = HOT_BIN_ROWS,
    clustered: bool = False,
) -> DataFrame:
    """All (feature, region) pairs that overlap, for a whole table of regions.

    Both sides need ``chr, start, end``; region columns come back with
    ``prefix`` (``chr`` once).  Both sides are cut into bins and joined on
    (chr, level, bin); a pair is kept only in the bin that holds the larger
    start, so it appears once.  Spark chooses the join: a small region table is
    broadcast by its measured size, otherwise both sides are shuffled on the bin.

    ``hot_bin_rows``: bins with more features than this are cut into slices; the
    features are spread over the slices and the regions of that bin repeated.  The bins' counts are taken at
    every size of the table.

    ``clustered``: features are dealt by bin and sorted before they meet the regions.  Written pairs then repeat few
    values at a time and take far less disk, for one shuffle of the features.
    """
    layout = layout or measure_layout(features, regions)
    renamed = {c: prefix + c for c in regions.columns if c != "chr"}
    left = _binned(features, layout.bin_size, layout.feature_top, layout.region_top)
    right = _binned(regions, layout.bin_size, layout.region_top, layout.feature_top)
    right = right.withColumnsRenamed({**renamed, "__lv": "__rlv"})

    keys = ["chr", "__level", "__bin"]
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.where(F.col("__n") > hot_bin_rows).select(*keys, F.ceil(F.col("__n") / hot_bin_rows).cast("int").alias("__slices"))
    # One row for so many features at the least: small enough for every executor.
    hot = F.broadcast(hot)
    slices = F.coalesce(F.col("__slices"), F.lit(1))
    own_slice = F.pmod(F.xxhash64(*features.columns), slices).cast("int")
    left = left.join(hot, keys, "left").withColumn("__slice", own_slice).drop("__slices")
    every_slice = F.explode(F.sequence(F.lit(0), slices - 1))
    right = right.join(hot, keys, "left").withColumn("__slice", every_slice).drop("__slices")
    keys = [*keys, "__slice"]
    if clustered:
        # Without the one-element explode the optimiser drops the sort below the join.
        left = left.repartition(*keys).sortWithinPartitions(*keys, "start", "end").withColumn("__slice", F.explode(F.array("__slice")))

    rs, re = F.col(prefix + "start"), F.col(prefix + "end")
    width = F.lit(layout.bin_size) * F.pow(F.lit(LEVEL_STEP), F.col("__level"))
    once = F.floor(F.greatest(F.col("start"), rs) / width) == F.col("__bin")
    pairs = left.join(right, keys).where(
        PREDICATES[mode](F.col("start"), F.col("end"), rs, re)
        & once
        & (F.col("__level") == F.greatest("__lv", "__rlv"))
    )
    return pairs.select(*features.columns, *renamed.values())


def overlap_totals(
    features: DataFrame, regions: DataFrame, mode: str = "half", *, by: str = "region_id", sums: Sequence[str] = (), layout: JoinLayout | None = None
) -> DataFrame:
    """Number ``n`` of overlapping features, and totals of whole-numbered columns, per ``by``.

    No pair is formed.  Features that start before a region ends, less those that end before it starts, are the ones
    that overlap it; both counts are running totals over distinct positions.  Rows that end before they start break
    that rule and meet their partners in ``overlap_join``, and so do empty regions in mode ``half``.
    """
    known = all_of([F.col(c).isNotNull() for c in ("chr", "start", "end")])
    forward = F.col("start") <= F.col("end")
    regular = F.col("start") < F.col("end") if mode == "half" else forward
    added = {f"__s{i}": F.coalesce(F.col(c), F.lit(0)) for i, c in enumerate(sums)}
    added |= {f"__k{i}": F.when(F.col(c).isNotNull(), 1).otherwise(0) for i, c in enumerate(sums)}  # a total of nulls is null
    totals = ["__n", *added]
    f = features.where(known).select("chr", "start", "end", F.lit(1).alias("__n"), *[c.alias(n) for n, c in added.items()])
    r = regions.where(known).select("chr", "start", "end", by)

    # What comes first at one position: a start or the end of a region, an end or the start of a region.
    after_start, after_end = mode not in ("signal", "half"), mode in ("mixed", "half")
    ranks = {"start": 0, "end": 0, "ask_end": 1 if after_start else -1, "ask_start": 1 if after_end else -1}
    events = []
    for side in ("start", "end"):
        changes = f.where(forward).groupBy("chr", F.col(side).alias("__pos")).agg(*[F.sum(n).alias(n) for n in totals])
        asked = r.where(regular).select("chr", F.col(side).alias("__pos")).distinct()
        for rows, kind in ((changes, side), (asked, f"ask_{side}")):
            given = [(F.col(n) if kind == side else F.lit(0)).cast("decimal(38,0)").alias(n) for n in totals]
            events.append(rows.select("chr", "__pos", F.lit(ranks[kind]).alias("__rank"), F.lit(kind).alias("__kind"), *given))
    line = reduce(DataFrame.unionByName, events)
    running = {f"{n}_{side}": ("sum", F.when(F.col("__kind") == side, F.col(n))) for n in totals for side in ("start", "end")}
    scanned = ordered_scan(line, ["chr"], ["__pos", "__rank", "__kind"], block_of("__pos"), **running)
    begun = scanned.where("__kind = 'ask_end'").select("chr", F.col("__pos").alias("end"), *[f"{n}_start" for n in totals])
    over = scanned.where("__kind = 'ask_start'").select("chr", F.col("__pos").alias("start"), *[f"{n}_end" for n in totals])
    met = r.where(regular).join(begun, ["chr", "end"]).join(over, ["chr", "start"])
    found = met.select(by, *[(F.col(f"{n}_start") - F.col(f"{n}_end")).cast("long").alias(n) for n in totals]).where("__n > 0")

    odd_features, odd_regions = f.where(~forward), r.where(~regular)
    for a, b in ((odd_features, r), (f.where(forward), odd_regions)):
        if not (odd_features if b is r else odd_regions).isEmpty():
            pairs = overlap_join(a, b, mode, layout=layout, prefix="__r_")
            found = found.unionByName(pairs.select(F.col(f"__r_{by}").alias(by), *[F.col(n).cast("long").alias(n) for n in totals]))
    summed = [F.when(F.sum(f"__k{i}") > 0, F.sum(f"__s{i}")).alias(c) for i, c in enumerate(sums)]
    return found.groupBy(by).agg(F.sum("__n").alias("n"), *summed)


def nearest_feature(
    features: DataFrame, points: DataFrame, direction: str = "next", *, tie: Sequence[str] = (), prefix: str = "near_"
) -> DataFrame:
    """The feature with the next larger (or smaller) midpoint for every query point.

    ``points`` has ``chr`` and ``center``.  Equal midpoints are settled by
    ``tie`` columns (smallest first).  Distinct midpoints are reduced first, so
    the scan sees at most one row per half base pair and side.
    """
    forward = direction == "next"
    cols = features.columns
    ranked = [F.col(c) for c in (*tie, "start", "end")]
    feature_points = features.groupBy("chr", (F.col("start") + F.col("end")).cast("double").alias("__m")).agg(
        F.min_by(F.struct(*cols), F.struct(*ranked)).alias("__hit")
    )
    asked = points.select("chr", (F.col("center") * 2).cast("double").alias("__m")).distinct()
    # Scanning order puts a query before a feature with the same midpoint.
    query_side, feature_side = (1, 0) if forward else (0, 1)
    both = feature_points.withColumn("__side", F.lit(feature_side)).unionByName(
        asked.withColumn("__side", F.lit(query_side)).withColumn("__hit", F.lit(None).cast(feature_points.schema["__hit"].dataType))
    )
    scanned = ordered_scan(
        both, ["chr"], ["__m", "__side"], block_of("__m", 2 * BLOCK_BP), reverse=forward, __near=("last", F.col("__hit"))
    ).where(F.col("__side") == query_side)
    answers = scanned.select("chr", "__m", *[F.col("__near")[c].alias(prefix + c) for c in cols if c != "chr"])
    return (
        points.withColumn("__m", (F.col("center") * 2).cast("double"))
        .join(answers, ["chr", "__m"], "left")
        .drop("__m")
    )


def coverage_depth(features: DataFrame, by: Sequence[str] = ("chr",), block_bp: int = BLOCK_BP) -> DataFrame:
    """Depth as runs ``(by, start, end, depth)``; zero-depth gaps are left out.

    Start and end events are summed per position before anything is ordered, so
    the scan handles one row per changed position, however deep the data are.
    """
    by = list(by)
    events = features.where(F.col("end") > F.col("start")).select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("start").alias("pos"), F.lit(1).cast("long").alias("d")),
                F.struct(F.col("end").alias("pos"), F.lit(-1).cast("long").alias("d")),
            )
        ).alias("e"),
    )
    steps = events.groupBy(*by, F.col("e.pos").alias("start")).agg(F.sum("e.d").alias("d")).where(F.col("d") != 0)
    runs = ordered_scan(
        steps, by, ["start"], block_of("start", block_bp), depth=("sum", F.col("d")), end=("lead", F.col("start"))
    )
    return runs.where(F.col("depth") > 0).select(*by, "start", "end", "depth")


def region_scores(features: DataFrame, regions: DataFrame, kind: str = "seg", **join) -> DataFrame:
    """Score of every sample in every region (closed overlap).

    ``seg``: sum of value x overlap / (region length + 1); ``mut``: number of touching rows; ``sum``: sum of value.
    Needs ``sample`` on the features and ``region_id`` on the regions.

    All features a region can meet are sent to the one bin that holds its start, so a (region, sample) total is
    finished where its pairs are formed, a region at a time, and neither pairs nor totals are shuffled or sorted.
    Rows of an id that comes twice have no bin in common; they are joined as pairs.
    """
    known = all_of([F.col(c).isNotNull() for c in ("chr", "start", "end")])
    value = F.lit(1) if kind == "mut" else F.col("value")
    f = features.where(known).select("chr", "start", "end", "sample", value.alias("value"))
    r = regions.where(known).select("chr", "start", "end", "region_id")
    ids = r.groupBy("region_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("region_id").alias("__id"))
    if ids.isEmpty():
        return _totals_by_bin(f, r, kind, **join)
    same = F.col("region_id").eqNullSafe(F.col("__id"))
    once, again = r.join(ids, same, "left_anti"), r.join(ids, same, "left_semi")
    pairs = overlap_join(f, again, "closed", prefix="r_", **join)
    grouped = pairs.groupBy(F.col("r_region_id").alias("region_id"), "sample")
    if kind == "mut":
        rest = grouped.agg(F.count(F.lit(1)).cast("double").alias("score"))
    elif kind == "sum":
        rest = grouped.agg(F.sum("value").alias("score"))
    else:
        overlap = F.least("end", "r_end") - F.greatest("start", "r_start")
        rest = grouped.agg(F.try_divide(F.sum(overlap * F.col("value")), F.max(F.col("r_end") - F.col("r_start") + 1)).alias("score"))
    return _totals_by_bin(f, once, kind, **join).unionByName(rest)


# Rows that are put in order at a time, rows of a result batch, and bins that are sent to every executor.
ORDERED_ROWS, BATCH_ROWS, MOST_SENT_CELLS = 1 << 21, 1 << 18, 1_000_000


def _totals_by_bin(f: DataFrame, r: DataFrame, kind: str, layout: JoinLayout | None = None, hot_bin_rows: int = HOT_BIN_ROWS) -> DataFrame:
    """Scores of regions with ids of their own; a hot bin is cut by sample, its regions repeated."""
    size = (layout or measure_layout(f, r)).bin_size
    length = F.col("end") - F.col("start")
    level = F.lit(0)
    for lv in range(6):
        level = F.when(length > size * LEVEL_STEP**lv, lv + 1).otherwise(level)
    width = F.lit(size) * F.pow(F.lit(LEVEL_STEP), F.col("__level"))
    cell = ["chr", "__level", "__bin"]
    homes = r.withColumn("__level", level).withColumn("__bin", F.floor(F.col("start") / width).cast("long"))
    levels = sorted(x[0] for x in homes.select("__level").distinct().collect())
    places = homes.select(*cell).distinct()

    # A region is no longer than its bin: it meets what touches that bin or the next.
    copies = f.where("false").select("*", F.lit(0).alias("__level"), F.lit(0).cast("long").alias("__bin"))
    longest = f.agg(F.max(length)).first()[0] or 0
    for lv in levels:
        w = size * LEVEL_STEP**lv
        bins = F.sequence(F.floor(F.col("start") / w).cast("long") - 1, F.floor(F.greatest("start", "end") / w).cast("long"))
        copies = copies.union(f.where(length <= w * LEVEL_STEP).select("*", F.lit(lv), F.explode(bins)))
        if longest > w * LEVEL_STEP:  # as many copies as there are bins with regions, found by a join
            spans = places.where(F.col("__level") == lv).select("chr", (F.col("__bin") * w).alias("start"), ((F.col("__bin") + 2) * w).alias("end"), F.col("__bin").alias("home"))
            met = overlap_join(f.where(length > w * LEVEL_STEP), spans, "closed", prefix="__c_")
            copies = copies.union(met.select(*f.columns, F.lit(lv), "__c_home"))
    counts = copies.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    cells = cut_lineage(places.join(counts, cell).select(*cell, F.ceil(F.col("__n") / hot_bin_rows).cast("int").alias("__slices")))
    if cells.count() <= MOST_SENT_CELLS:
        cells = F.broadcast(cells)

    own = F.pmod(F.xxhash64("sample"), F.col("__slices")).cast("int")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    left = copies.join(cells, cell).select(*cell, own.alias("__slice"), "start", "end", "sample", "value", none(r, "region_id"), F.lit(False).alias("asks"))
    every = F.explode(F.sequence(F.lit(0), F.col("__slices") - 1))
    right = homes.join(cells, cell).select(*cell, every.alias("__slice"), "start", "end", none(f, "sample"), none(f, "value"), "region_id", F.lit(True).alias("asks"))

    exact = not isinstance(f.schema["value"].dataType, (T.FloatType, T.DoubleType, T.DecimalType))
    if not exact:
        left, right = (x.withColumn("value", F.col("value").cast("double")) for x in (left, right))
    score = T.LongType() if kind == "sum" and exact else T.DoubleType()
    schema = T.StructType([r.schema["region_id"], f.schema["sample"], T.StructField("score", score)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _bin_scores(batches, kind, np.int64 if exact else np.float64, schema.names)

    return left.union(right).groupBy(*cell, "__slice").applyInArrow(run, schema)


def _bin_scores(batches: Iterator[pa.RecordBatch], kind: str, number: type, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Scores of the regions of one bin: features in sample order, one pass over them per region.

    Rows come by the first feature that a total holds, then by region: neighbours in place then list the same regions, and
    a sample is repeated, so that written totals take far less disk.
    """
    table = pa.Table.from_batches([b.select(["start", "end", "sample", "value", "region_id", "asks"]) for b in batches])
    asks = table["asks"].to_numpy()
    r, f = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
    if not len(r) or not len(f):
        return
    r = r.sort_by([("start", "ascending"), ("end", "ascending"), ("region_id", "ascending")])
    coded = f["sample"].combine_chunks().dictionary_encode("encode")
    codes, start, end = coded.indices.to_numpy(), f["start"].to_numpy(), f["end"].to_numpy()
    value = f["value"].fill_null(0).to_numpy().astype(number)
    place = np.lexsort((codes, value, end, start))
    at = np.argsort(codes[place], kind="stable")  # places in sample order
    order = place[at]
    codes, start, end, value = codes[order], start[order], end[order], value[order]
    known = f["value"].is_valid().to_numpy()[order]
    ids = r["region_id"].combine_chunks()
    held, rows = [], 0

    def ordered():
        which, first, score, missing = (np.concatenate(x) for x in zip(*held))
        by = np.argsort(at[first] * len(ids) + which)
        for part in np.split(by, range(BATCH_ROWS, len(by), BATCH_ROWS)):
            sample = coded.dictionary.take(pa.array(codes[first[part]]))
            columns = [ids.take(pa.array(which[part])), sample, pa.array(score[part], mask=missing[part])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    for k, (a, b) in enumerate(zip(r["start"].to_numpy(), r["end"].to_numpy())):
        hit = np.flatnonzero((start <= b) & (end >= a))
        if not len(hit):
            continue
        mine = codes[hit]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        missing = np.zeros(len(first), bool)
        if kind == "mut":
            score = np.diff(first, append=len(hit)).astype(np.float64)
        else:
            terms = value[hit]
            if kind == "seg":
                terms = terms * (np.minimum(end[hit], b) - np.maximum(start[hit], a))
            score = np.add.reduceat(terms, first)
            missing = np.add.reduceat(known[hit].astype(np.int64), first) == 0
            if kind == "seg":
                size = b - a + 1
                score, missing = (score / size, missing) if size else (np.zeros(len(first)), np.ones(len(first), bool))
        held.append((np.full(len(first), k, np.int32), hit[first].astype(np.int32), score, missing))
        rows += len(first)
        if rows >= ORDERED_ROWS:
            yield from ordered()
            held, rows = [], 0
    if held:
        yield from ordered()


def merge_tracks(tracks: dict[str, DataFrame]) -> DataFrame:
    """Bag union of several tracks with a ``track`` column; absent columns become NULL."""
    out = None
    for order, (name, df) in enumerate(tracks.items()):
        tagged = df.withColumn("track", F.lit(name)).withColumn("track_order", F.lit(order))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def unique_values(features: DataFrame, column: str) -> DataFrame:
    return features.select(column).where(F.col(column).isNotNull()).dropDuplicates()


def add_regions(regions: DataFrame, more: DataFrame) -> DataFrame:
    return regions.unionByName(more, allowMissingColumns=True)


def remove_regions(regions: DataFrame, gone: DataFrame) -> DataFrame:
    """Drop the regions whose (chr, start, end) is listed in ``gone``."""
    keys = ["chr", "start", "end"]
    return regions.join(gone.select(*keys), keys, "left_anti")


def user_filter(features: DataFrame, predicate: Column | str) -> DataFrame:
    """Any user condition: a column expression or SQL text."""
    return features.where(predicate)
