"""Order-dependent building blocks that stay spread over the cluster.

A chromosome (or any other natural key) may hold a third of all rows, so no
function in this module partitions a window by such a key alone.  Ordered work
is cut into blocks of the coordinate axis; each block reports one small partial
result, the partial results are scanned, and the carry is joined back.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genospan.session import ensure_checkpoint_dir

# Width in base pairs of a scan block: a 250 Mbp chromosome gives about 1,000
# blocks, and a block holds at most this many distinct positions.
BLOCK_BP = 1 << 18


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def block_of(position: Column | str, width: int = BLOCK_BP) -> Column:
    col = F.col(position) if isinstance(position, str) else position
    return F.floor(col / F.lit(width)).cast("long")


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    block: Column,
    *,
    reverse: bool = False,
    **outputs: tuple[str, Column],
) -> DataFrame:
    """Running values along ``order`` inside each ``by`` group, block by block.

    ``block`` must not decrease along ``order``.  Every output is a pair
    ``(kind, column)``:

    ``sum`` / ``sum_before``   running total with / without the current row
    ``max`` / ``max_before``   running maximum
    ``last`` / ``last_before`` latest non-null value
    ``lag`` / ``lead``         value of the neighbouring row

    With ``reverse=True`` rows are visited from the highest key to the lowest.
    Cost: one shuffle of the rows on ``(by, block)`` plus a shuffle of one row
    per block.
    """
    by = list(by)
    blk = "__blk"
    key = F.struct(*[F.col(c) for c in order])
    newest, oldest = (F.min_by, F.max_by) if reverse else (F.max_by, F.min_by)
    sort = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    rows = df.withColumn(blk, block)

    inside = Window.partitionBy(*by, blk).orderBy(*sort)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    blk_sort = F.col(blk).desc() if reverse else F.col(blk).asc()
    across = Window.partitionBy(*by).orderBy(blk_sort)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)

    partials, carries, locals_ = [], [], []
    for name, (kind, col) in outputs.items():
        part, carry = f"__p_{name}", f"__c_{name}"
        base = kind.removesuffix("_before")
        frame = before if kind.endswith("_before") else upto
        if base == "sum":
            partials.append(F.sum(col).alias(part))
            carries.append(F.sum(part).over(earlier).alias(carry))
            local = F.sum(col).over(frame)
            locals_.append((name, F.coalesce(local, F.lit(0)) + F.coalesce(F.col(carry), F.lit(0))))
        elif base == "max":
            partials.append(F.max(col).alias(part))
            carries.append(F.max(part).over(earlier).alias(carry))
            locals_.append((name, F.greatest(F.max(col).over(frame), F.col(carry))))
        elif base == "last":
            partials.append(newest(col, F.when(col.isNotNull(), key)).alias(part))
            carries.append(F.last(part, ignorenulls=True).over(earlier).alias(carry))
            local = F.last(col, ignorenulls=True).over(frame)
            locals_.append((name, F.coalesce(local, F.col(carry))))
        elif base in ("lag", "lead"):
            boxed = F.struct(col.alias("v"))
            pick, step = (newest, F.lag) if base == "lag" else (oldest, F.lead)
            partials.append(pick(boxed, key).alias(part))
            carries.append(step(F.col(part)).over(across).alias(carry))
            locals_.append((name, F.coalesce(step(boxed).over(inside), F.col(carry))["v"]))
        else:
            raise ValueError(f"unknown scan kind {kind!r}")

    per_block = rows.groupBy(*by, blk).agg(*partials)
    carried = per_block.select(*by, blk, *carries)
    joined = rows.join(carried, [*by, blk], "left")
    return joined.select(*df.columns, *[c.alias(n) for n, c in locals_])


def label_runs(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    block: Column,
    carry: Column,
    starts_new: Callable[[Column], Column],
    name: str = "run",
) -> DataFrame:
    """Number runs of rows: ``name`` is the key of the row that opened the run.

    ``carry`` is what a row shows to the next one; ``starts_new(previous)`` says
    whether a row opens a run.  The rows are shuffled once on (by, block); each
    block reports its first row, its last ``carry`` and its last opening.
    """
    by, blk, key = list(by), "__blk", F.struct(*order)
    inside = Window.partitionBy(*by, blk).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*by).orderBy(blk)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    opens = lambda prev: F.coalesce(starts_new(prev["v"]), F.lit(True))

    rows = df.withColumn(blk, block).withColumn("__box", F.struct(carry.alias("v")))
    rows = rows.withColumn("__lp", F.lag("__box").over(inside))
    inner = F.when(F.col("__lp").isNotNull() & opens(F.col("__lp")), key)
    rest = [c for c in df.columns if c not in by]
    per_block = rows.groupBy(*by, blk).agg(
        F.min_by(F.struct(*rest), key).alias("__first"),
        F.max_by("__box", key).alias("__last"),
        F.max(inner).alias("__inner"),
    )
    table = per_block.select(*by, blk, "__first.*", "__inner", F.lag("__last").over(across).alias("__cp"))
    opened = F.coalesce("__inner", F.when(F.col("__cp").isNull() | opens(F.col("__cp")), key))
    carried = table.select(*by, blk, "__cp", F.last(opened, ignorenulls=True).over(earlier).alias("__co"))
    met = rows.join(carried, [*by, blk], "left").withColumn("__p", F.coalesce("__lp", "__cp"))
    here = F.when(F.col("__p").isNull() | opens(F.col("__p")), key)
    return met.withColumn("__open", here).select(
        *df.columns, F.coalesce(F.last("__open", ignorenulls=True).over(upto), F.col("__co")).alias(name)
    )


def islands(
    df: DataFrame,
    by: Sequence[str],
    start: str = "start",
    end: str = "end",
    *,
    gap: float = 0,
    touching: bool = True,
    block_bp: int = BLOCK_BP,
) -> DataFrame:
    """Merged clusters ``(by, start, end, n)`` of overlapping intervals.

    Rows that share a start are reduced first, so a pile of identical starts is
    combined on the map side.  With ``touching`` two intervals join when the
    second starts at or before the running end plus ``gap``; otherwise they must
    truly overlap.
    """
    by = list(by)
    points = df.groupBy(*by, F.col(start).alias("start")).agg(
        F.max(end).alias("end"), F.count(F.lit(1)).alias("n")
    )
    scanned = ordered_scan(
        points, by, ["start"], block_of("start", block_bp), reach=("max_before", F.col("end"))
    )
    limit = F.col("reach") + F.lit(gap)
    opens = F.col("reach").isNull() | (F.col("start") > limit if touching else F.col("start") >= limit)
    marked = scanned.withColumn("opened", F.when(opens, F.col("start")))
    labelled = ordered_scan(
        marked, by, ["start"], block_of("start", block_bp), island=("last", F.col("opened"))
    )
    return labelled.groupBy(*by, F.col("island").alias("start")).agg(
        F.max("end").alias("end"), F.sum("n").alias("n")
    )


def top_k_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, spread: Sequence[str], salts: int = 256
) -> DataFrame:
    """The first ``k`` rows of every group in ``order``; exact and safe for hot groups.

    A hot group is first cut into ``salts`` slices by a hash of ``spread``; each
    slice keeps its own first ``k`` rows, so the final ranking of a group sees at
    most ``salts * k`` rows.
    """
    by = list(by)
    if not by:
        return df.orderBy(*order).limit(k)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    first = salted.withColumn(
        "__rn", F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(*order))
    ).where(F.col("__rn") <= k)
    second = first.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return second.where(F.col("__rn") <= k).drop("__salt", "__rn")


# Steps of a radix selection: first by size, so many classes to a doubling; then thrice by place between the ends
# of the class that holds the rank.  Two doubles inside a class of the last step are equal.
CLASSES_PER_DOUBLING, CLASSES_BETWEEN, REFINEMENTS = 64, 1 << 17, 3
# Groups whose searches are sent to every executor; with more the counts meet them by shuffle.
MOST_SENT_GROUPS = 100_000


def order_statistics(df: DataFrame, value: str, ranks: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Exact order statistics: the value at 0-based sorted position ``rank``.

    ``ranks`` maps an output name to a rank expression over the column ``n``
    (row count of the group).  A rank outside ``0..n-1`` gives NULL.  One row per
    group comes back, with the count ``n``; without ``by`` one row if there is any value.

    Equal values are counted first (map-side combined) and written once.  Then a fixed number of grouped counts
    narrows the class of values that holds each rank, like a radix selection does digit by digit: nothing is
    sorted, and no group meets in one task.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    counts = cut_lineage(counts)
    sizes = counts.groupBy(*by).agg(F.sum("__c").alias("n")).where("n is not null")
    few = bool(by) and sizes.count() <= MOST_SENT_GROUPS
    least, most = F.lit(float("-inf")), F.lit(float("nan"))
    searches = [F.struct(F.lit(n).alias("name"), r.cast("long").alias("rank"), least.alias("lo"), most.alias("hi")) for n, r in ranks.items()]
    sought = sizes.select(*by, F.array(*searches).alias("__s"))

    def beside(rows: DataFrame, table: DataFrame) -> DataFrame:
        """``rows`` with the one row that ``table`` has for their group."""
        if not by:
            return rows.withColumn("__s", table.select("__s").scalar())
        return rows.join(F.broadcast(table) if few else table, by)

    v = F.col("__v")
    size = F.floor(F.log2(F.abs(v)) * CLASSES_PER_DOUBLING) + CLASSES_PER_DOUBLING * 2_000
    by_size = F.when(F.isnan(v), F.lit(1 << 40)).when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.signum(v).cast("long") * (1 << 39))
    by_size = by_size.otherwise(F.signum(v).cast("long") * size)
    lo, hi = F.col("s.lo"), F.col("s.hi")
    by_place = F.when(lo == hi, F.lit(0)).otherwise(F.floor((v - lo) / (hi - lo) * CLASSES_BETWEEN))
    for step in range(1 + REFINEMENTS):
        inside = F.filter("__s", lambda s: (s["lo"] <= v) & (v <= s["hi"]))
        met = beside(counts, sought).select(*by, "__v", "__c", F.explode(inside).alias("s"))
        classes = met.groupBy(*by, "s.name", "s.rank", (by_place if step else by_size).cast("long").alias("__k")).agg(
            F.sum("__c").alias("__n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")
        )
        upto = F.sum("__n").over(Window.partitionBy(*by, "name").orderBy("__k"))
        placed = classes.withColumn("__rest", F.col("rank") - (upto - F.col("__n"))).where("0 <= __rest and __rest < __n")
        found = F.struct("name", F.col("__rest").alias("rank"), "lo", "hi")
        sought = placed.groupBy(*by).agg(F.collect_list(found).alias("__s"))  # one search a name
    of = lambda name: F.get(F.filter("__s", lambda s: s["name"] == name), F.lit(0))["lo"].alias(name)
    if not by:
        return sizes.withColumn("__s", sought.select("__s").scalar()).select("n", *[of(name) for name in ranks])
    return sizes.join(sought, by, "left").select(*by, "n", *[of(name) for name in ranks])


def hashed_order(*cols: str, seed: int = 0) -> list[Column]:
    """A repeatable pseudo-random order, the same in any engine: an MD5 digest of the columns, then the columns as tie-break."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return [F.md5(text.cast("binary")), *[F.col(c) for c in cols]]


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(operator.or_, conditions, F.lit(False))


def empty_like(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([], df.schema)
