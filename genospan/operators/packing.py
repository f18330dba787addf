"""First-fit row packing, run in parallel over coordinate blocks.

Packing is sequential in nature: the row of a feature depends on everything that
still overlaps it.  The work is nevertheless split.  Features are range
partitioned by (group, start) into blocks of bounded size; what one block hands
to the next is only the set of rows still occupied at its end.  A block that
holds a gap in coverage hands over the same state whatever it is given, so all
such blocks start at once; the others follow one after the other, each as soon
as it is handed its state.  No block is tried twice, and once every state is
known all rows are given at the same time.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genospan.scale import block_of, cut_lineage, ordered_scan
from genospan.session import ensure_checkpoint_dir, ship_by_value

ship_by_value(__name__)

# Rows of a block: at most, and as few as are worth a task of their own.
ROWS_PER_BLOCK, LEAST_PER_BLOCK = 500_000, 50_000
# A group's part of a block: places in order, the last gap before which nothing is occupied any more, and the furthest end.
SEGMENT = "part int, grp string, s array<double>, e array<double>, opened int, open double, reach double"
STATE = "part int, grp string, rows array<int>, ends array<double>"


def _fit(starts, ends, busy, max_rows, gap):
    """Rows for sorted intervals, given ``busy`` = [(end, row)] still occupied on entry."""
    heap = list(busy)
    heapq.heapify(heap)
    used = {r for _, r in heap}
    top = max(used, default=-1) + 1
    free = [r for r in range(top) if r not in used]
    out = np.empty(len(starts), dtype=np.int32)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        while heap and heap[0][0] + gap <= s:
            heapq.heappush(free, heapq.heappop(heap)[1])
        if free:
            row = heapq.heappop(free)
        elif max_rows is None or top < max_rows:
            row, top = top, top + 1
        else:
            out[i] = max_rows
            continue
        out[i] = row
        heapq.heappush(heap, (e, row))
    last = starts[-1] if len(starts) else -np.inf
    return out, sorted((e, r) for e, r in heap if e + gap > last)


def _groups(names: pa.Array) -> Iterator[tuple[str, int, int]]:
    """Every run of equal names with its ends."""
    codes = names.dictionary_encode()
    ids = codes.indices.to_numpy()
    cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
    return ((codes.dictionary[int(ids[a])].as_py(), a, b) for a, b in zip(cuts, cuts[1:]))


def _segments(batches: Iterator[pa.RecordBatch], gap: float, whole: bool) -> Iterator[pa.RecordBatch]:
    """The segments of one block, which comes in order; without their places unless ``whole``."""
    held = list(batches)
    if not sum(map(len, held)):
        return
    table = pa.Table.from_batches(held).combine_chunks()
    s, e = (table[c].to_numpy().astype(float) for c in ("__s", "__e"))
    part = table["__part"][0].as_py()
    for grp, a, b in _groups(table["__grp"].combine_chunks()):
        furthest = np.maximum.accumulate(e[a:b])
        opened = int(np.flatnonzero(np.concatenate([[True], s[a + 1 : b] >= furthest[:-1] + gap]))[-1])
        places = [pa.array([x[a:b] if whole else []], pa.list_(pa.float64())) for x in (s, e)]
        rest = [pa.array([opened], pa.int32()), pa.array([s[a + opened]]), pa.array([furthest[-1]])]
        names = ["part", "grp", "s", "e", "opened", "open", "reach"]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([grp]), *places, *rest], names=names)


def _exit_states(batches: Iterator[pa.RecordBatch], max_rows, gap) -> Iterator[pa.RecordBatch]:
    """What segments hand to the next: rows still occupied, with their ends."""
    for batch in batches:
        for k in range(len(batch)):
            one = {c: batch[c][k] for c in batch.schema.names}
            s, e = (one[c].values.to_numpy()[one["opened"].as_py() :] for c in ("s", "e"))
            busy = list(zip(one["ends"].values.to_pylist(), one["rows"].values.to_pylist())) if one["rows"].is_valid else []
            _, state = _fit(s, e, busy, max_rows, gap)
            rows, ends = pa.array([[r for _, r in state]], pa.list_(pa.int32())), pa.array([[e for e, _ in state]], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([one["next"].as_py()], pa.int32()), pa.array([one["grp"].as_py()]), rows, ends], names=["part", "grp", "rows", "ends"])


def _placed(rows: pa.Table, entry: pa.Table, columns: list[str], max_rows, gap) -> pa.Table:
    """One block with ``row`` set; its first group goes on from the state handed over."""
    rows = rows.sort_by("__id")
    s, e = (rows[c].to_numpy().astype(float) for c in ("__s", "__e"))
    given = {x["grp"]: list(zip(x["ends"], x["rows"])) for x in entry.to_pylist()}
    pieces = [_fit(s[a:b], e[a:b], given.get(grp, []), max_rows, gap)[0] for grp, a, b in _groups(rows["__grp"].combine_chunks())] if len(rows) else []
    row = pa.array(np.concatenate(pieces) if pieces else [], pa.int32())
    return rows.select(columns).append_column("row", row)


def pack_rows(
    features: DataFrame,
    by: Sequence[str] = ("chr",),
    *,
    tie: Sequence[str],
    max_rows: int | None = None,
    gap: float = 0,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add ``row``: the lowest row whose last feature ends at or before this start.

    Features are taken by start, then by ``tie`` (which must make the order
    total).  There are as many rows as needed; with ``max_rows`` all that find no room
    in so many rows share one more.
    """
    by, tie = list(by), list(tie)
    spark = features.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/packing-{uuid.uuid4().hex}"
    group = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    keyed = (
        features.withColumn("__grp", group)
        .withColumn("__s", F.col("start").cast("double"))
        .withColumn("__e", F.col("end").cast("double"))
    )
    keyed = cut_lineage(keyed)  # counted, sampled and dealt without making the features again
    total = keyed.count()
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(min(shuffle, -(-total // LEAST_PER_BLOCK)), -(-total // rows_per_block), 1)
    laid = (
        keyed.repartitionByRange(n_blocks, "__grp", "__s", *tie)
        .sortWithinPartitions("__grp", "__s", *tie)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__id", F.monotonically_increasing_id())
    )
    laid = cut_lineage(laid)  # blocks must not move once states are handed over

    spans = laid.select("__part", "__grp", "__s", "__e")
    outline = spans.mapInArrow(lambda batches: _segments(batches, gap, False), SEGMENT).drop("s", "e")
    along = Window.partitionBy("grp").orderBy("part")
    before = F.max("reach").over(along.rowsBetween(Window.unboundedPreceding, -1))
    nth = F.row_number().over(along)
    marked = outline.withColumn("__nth", nth).withColumn("next", F.lead("part").over(along))
    marked = marked.withColumn("free", before.isNull() | (F.col("open") >= before + F.lit(gap)))
    last_free = F.max(F.when(F.col("free"), F.col("__nth"))).over(along)
    steps = cut_lineage(marked.select("part", "grp", "next", "free", (F.col("__nth") - last_free).alias("step")).where("next is not null"))

    # Only a free segment may leave out what lies before its last gap.
    segments = spans.mapInArrow(lambda batches: _segments(batches, gap, True), SEGMENT).join(F.broadcast(steps), ["part", "grp"])
    opened = F.when(F.col("free"), F.col("opened")).otherwise(0).alias("opened")
    segments.select("part", "grp", "s", "e", opened, "next", "step").write.partitionBy("step").parquet(f"{folder}/segments")
    last = steps.agg(F.max("step")).first()[0]
    states = spark.createDataFrame([], STATE)
    for step in range(-1 if last is None else last + 1):
        now = spark.read.parquet(f"{folder}/segments/step={step}").join(states, ["part", "grp"], "left")
        ran = now.mapInArrow(lambda batches: _exit_states(batches, max_rows, gap), STATE)
        ran.write.parquet(f"{folder}/states/step={step}")
        states = spark.read.schema(STATE).parquet(f"{folder}/states/step={step}")
    entries = spark.createDataFrame([], STATE) if last is None else spark.read.schema(STATE).parquet(*[f"{folder}/states/step={k}" for k in range(last + 1)])

    columns = features.columns
    made = T.StructType([*features.schema.fields, T.StructField("row", T.IntegerType())])
    blocks = laid.groupBy(F.col("__part").alias("part")).cogroup(entries.groupBy("part"))
    return blocks.applyInArrow(lambda rows, entry: _placed(rows, entry, columns, max_rows, gap), made)


def pack_reads(reads: DataFrame, by: Sequence[str] = ("chr",), *, tie: Sequence[str], soft_clips: bool = False, space: int = 2) -> DataFrame:
    """Dense packing of reads: the next read of a row starts more than ``space`` bases after it.

    Filling one row after the other gives the same rows as first-fit in start
    order, so the block-parallel packer is used.  ``soft_clips`` uses the extent
    that includes clipped ends (``sc_start``, ``sc_length``).
    """
    start, length = ("sc_start", "sc_length") if soft_clips else ("start", "length_on_ref")
    spans = reads.withColumn("__start0", F.col("start"))
    shaped = spans.withColumn("start", F.col(start)).withColumn("end", F.col(start) + F.col(length))
    # Strictly more than ``space`` apart on whole coordinates is ``space + 1`` or more.
    packed = pack_rows(shaped, by, tie=tie, max_rows=None, gap=space + 1)
    out = packed.withColumn("start", F.col("__start0")).drop("__start0")
    return out.select(*[c for c in out.columns if c in reads.columns or c == "row"])


def pack_full(reads: DataFrame, start: int, end: int, *, tie: Sequence[str] = ()) -> DataFrame:
    """One read per row, in start order, for reads that touch the window.

    Row numbers are given inside the window only; the numbering is a blocked count.
    Reads of one start are taken by name and flags, then by ``tie``; reruns agree only if that makes the order total.
    """
    inside = reads.where((F.col("end") >= start) & (F.col("start") <= end))
    per_start = inside.groupBy("chr", "start").agg(F.count(F.lit(1)).alias("__n"))
    before = ordered_scan(per_start, ["chr"], ["start"], block_of("start"), __before=("sum_before", F.col("__n")))
    nth = F.row_number().over(Window.partitionBy("chr", "start").orderBy("read_name", "flags", *tie)) - 1
    return inside.join(before.drop("__n"), ["chr", "start"]).withColumn("row", (F.col("__before") + nth).cast("int")).drop("__before")
