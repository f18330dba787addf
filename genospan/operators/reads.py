"""Alignment filters, pileup, pairing, pair statistics and read ordering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospan.functions import reads as R
from genospan.scale import order_statistics
from genospan.session import ship_by_value
from genospan.sources.lines import once

ship_by_value(__name__)

BASES = ("A", "C", "G", "T", "N")
DEFAULT_QUALITY = 30
MISMATCH_THRESHOLD = 0.2
MIN_PAIRS_FOR_LIMITS = 100


def read_filter(
    alignments: DataFrame,
    *,
    qc_fail: bool = True,
    duplicates: bool = True,
    secondary: bool = False,
    supplementary: bool = False,
    min_mq: int = 0,
    read_groups: Sequence[str] | None = None,
) -> DataFrame:
    """Keep mapped reads; each flag set to True drops that kind of read."""
    drop = {"unmapped": True, "qc_fail": qc_fail, "duplicate": duplicates, "secondary": secondary, "supplementary": supplementary}
    mask = sum(R.FLAGS[name] for name, on in drop.items() if on)
    keep = (F.col("flags").bitwiseAND(F.lit(mask)) == 0) & (F.col("mq") >= min_mq)
    if read_groups is not None:
        keep = keep & F.coalesce(F.col("tags")["RG"].isin(list(read_groups)), F.lit(False))
    return alignments.where(keep)


def discordant_pairs(alignments: DataFrame, max_template_length: float) -> DataFrame:
    """Reads whose mate is on another chromosome or farther away than the limit."""
    far = (F.col("mate_chr") != F.col("chr")) | (F.col("tlen") > max_template_length)
    return alignments.where(R.mate_mapped() & (F.col("mate_chr") != "*") & far)


def split_reads(alignments: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Reads with a supplementary alignment, optionally touching a window."""
    out = alignments.where(F.col("tags")["SA"].isNotNull())
    if start is not None:
        out = out.where((F.col("end") >= start) & (F.col("start") <= end))
    return out


COUNTERS = [*(f"{side}{b}" for b in BASES for side in ("pos", "neg", "qual")), "total", "qual", "del", "ins"]
READS_BLOCK_BP = 1 << 14
EVENTS_AT_ONCE = 1 << 20  # bases and gaps that a worker counts together, one read at least
_CODE = np.full(256, len(BASES), np.int64)
for _k, _b in enumerate(BASES):
    _CODE[[ord(_b), ord(_b.lower())]] = _k


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text column, and each row's first byte and length; a missing text or ``*`` has none."""
    absent = pc.fill_null(pc.equal(column, "*"), True)
    column = pc.if_else(absent, "", column).cast(pa.large_string())
    _, offsets, data = column.buffers()
    edge = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return raw, edge[:-1], np.diff(edge)


def _ramps(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _count_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``COUNTERS`` for the positions that some reads touch."""
    for batch in batches:
        each = batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
        lo, ends = 0, np.cumsum(each)
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + EVENTS_AT_ONCE, side="right")))
            yield _counted(batch.slice(lo, hi - lo))
            lo = hi


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
    chroms = column["chr"].dictionary_encode()
    code, reverse = chroms.indices.to_numpy(), column["reverse"].to_numpy(zero_copy_only=False).astype(bool)
    lists = column["op"]
    read = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    op = pc.dictionary_encode(lists.flatten())
    kind = np.array([{"D": 1, "I": 2}.get(x, 0) for x in op.dictionary.to_pylist()] or [0])[op.indices.to_numpy()]
    first, off, size = (column[n].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for n in ("pos", "off", "len"))

    def keys(part: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (np.repeat(code[read[part]].astype(np.int64), sizes) << 44) + np.repeat(first[part], sizes) + _ramps(sizes)

    bases, gaps, added = (np.flatnonzero(kind == k) for k in range(3))
    n = size[bases]
    owner, inside = np.repeat(read[bases], n), np.repeat(off[bases], n) + _ramps(n)
    raw, begin, length = _text(column["seq"])
    known = inside < length[owner]
    # Bases that are not recorded count as N.
    base = np.where(known, _CODE[raw[np.where(known, begin[owner] + inside, 0)]], BASES.index("N"))
    raw, begin, length = _text(column["qual"])
    known = inside < length[owner]
    q = np.where(known, raw[np.where(known, begin[owner] + inside, 0)].astype(np.int64) - 33, DEFAULT_QUALITY)
    place = [keys(bases, n), keys(gaps, size[gaps]), keys(added, np.ones(len(added), np.int64))]
    at, which = np.unique(np.concatenate(place), return_inverse=True)
    edges = np.cumsum([0, *map(len, place)])
    own, gap, ins = (which[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))
    m, kinds = len(at), len(BASES) + 1
    count = lambda index, width, weights=None: np.bincount(index, weights, m * width).astype(np.int64).reshape(m, width)
    strand = count(own * 2 * kinds + base * 2 + reverse[owner], 2 * kinds)
    quality = count(own * kinds + base, kinds, q.astype(np.float64))
    sums = [x for k in range(len(BASES)) for x in (strand[:, 2 * k], strand[:, 2 * k + 1], quality[:, k])]
    sums += [strand.sum(axis=1), quality.sum(axis=1), count(gap, 1)[:, 0], count(ins, 1)[:, 0]]
    names = chroms.dictionary.take(pa.array(at >> 44))
    return pa.RecordBatch.from_arrays([names, pa.array(at & ((1 << 44) - 1)), *map(pa.array, sums)], names=["chr", "pos", *COUNTERS])


def pileup(alignments: DataFrame) -> DataFrame:
    """Counts per reference position.

    ``posA..posN`` and ``negA..negN`` by strand and base, ``qualA..qualN``,
    ``total`` and ``qual``; ``del`` counts bases inside D gaps (not N), ``ins``
    insertions at their first base.  Soft clips are skipped; bases that are not recorded count as N, without a
    recorded quality as ``DEFAULT_QUALITY``.

    The reads are dealt by blocks of their place.  A worker counts a bounded number of bases at a time in flat arrays and
    hands on one row for each position it saw; those rows are summed by (chr, pos).  A position
    covered by a large share of all reads costs a row for each such step, not for each read.
    """
    wanted = F.filter("parts", lambda p: p["op"].isin("M", "=", "X", "D", "I") & (p["len"] > 0))
    parts = alignments.where(F.col("chr").isNotNull()).select("chr", R.has_flag("reverse").alias("reverse"), "seq", "qual", once(wanted).alias("p")).where(F.size("p") > 0)
    flat = parts.select(
        "chr", "reverse", "seq", "qual",
        *[F.col(f"p.{k}").alias(k) for k in ("op", "pos", "off", "len")],
        F.aggregate("p", F.lit(0).cast("long"), lambda n, b: n + b["len"].cast("long")).alias("n"),
    )
    # Reads come by place, so that a step sees few positions; Spark splits what is dealt too thick.
    flat = flat.withColumn("start", F.get("pos", F.lit(0))).withColumn("block", F.floor(F.col("start") / READS_BLOCK_BP))
    flat = flat.hint("rebalance", "chr", "block").sortWithinPartitions("chr", "start")
    counted = flat.mapInArrow(_count_events, "chr string, pos long, " + ", ".join(f"{c} long" for c in COUNTERS))
    return counted.groupBy("chr", "pos").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def base_count(base: str, strand: str = "both") -> Column:
    """Count of a base at a pileup row: ``pos``, ``neg`` or ``both`` strands."""
    b = base.upper()
    if b not in BASES:
        return F.lit(0)
    parts = {"pos": [f"pos{b}"], "neg": [f"neg{b}"], "both": [f"pos{b}", f"neg{b}"]}[strand]
    return sum((F.col(p) for p in parts[1:]), F.col(parts[0]))


def max_coverage(pile: DataFrame, by: Sequence[str] = ("chr",)) -> DataFrame:
    return pile.groupBy(*by).agg(F.max("total").alias("max_total"))


def is_mismatch(ref: Column, threshold: float = MISMATCH_THRESHOLD) -> Column:
    """Do the non-reference bases reach ``threshold`` of the quality (or of the count)?"""
    by_quality = F.col("qual") != 0
    other = F.lit(0)
    for b in ("A", "C", "G", "T"):
        weight = F.when(by_quality, F.col(f"qual{b}")).otherwise(base_count(b))
        other = other + F.when(ref == b, 0).otherwise(weight)
    whole = F.when(by_quality, F.col("qual")).otherwise(F.col("total"))
    return other >= F.lit(threshold) * whole


def mismatch_sites(pile: DataFrame, chunks: DataFrame, chunk_size: int, threshold: float = MISMATCH_THRESHOLD) -> DataFrame:
    """Pileup rows whose non-reference share is high; the reference base comes along as ``ref``."""
    from genospan.operators.sequence import attach_base

    based = attach_base(pile, chunks, chunk_size, "pos", "ref")
    return based.where(is_mismatch(F.upper("ref"), threshold))


def read_mismatches(alignments: DataFrame, chunks: DataFrame, chunk_size: int, *keep: str) -> DataFrame:
    """Read bases that differ from the reference: ``pos, base, ref, q``.

    ``=`` counts as equal, ``X`` always as different.  Blocks meet the reference
    by chunk, and only the overlapping piece of both is split into bases.
    """
    blocks = alignments.where((F.col("seq") != "*") & F.col("seq").isNotNull()).select(
        "chr", *keep, "seq", "qual", F.explode(R.aligned_blocks()).alias("b")
    )
    blocks = blocks.where("b.len > 0").withColumn(
        "chunk",
        F.explode(
            F.sequence(
                F.floor(F.col("b.pos") / chunk_size), F.floor((F.col("b.pos") + F.col("b.len") - 1) / chunk_size)
            )
        ),
    )
    met = blocks.join(chunks.select("chr", "chunk", F.col("seq").alias("ref_seq")), ["chr", "chunk"])
    lo = F.greatest(F.col("b.pos"), F.col("chunk") * chunk_size)
    hi = F.least(F.col("b.pos") + F.col("b.len"), (F.col("chunk") + 1) * chunk_size)
    n = (hi - lo).cast("int")
    at = (F.col("b.off") + lo - F.col("b.pos")).cast("int") + 1
    cut = met.select(
        "chr",
        *keep,
        lo.alias("from"),
        F.split(F.upper(F.substring("seq", at, n)), "").alias("base"),
        F.split(F.when(F.col("qual") == "*", F.lit("")).otherwise(F.substring("qual", at, n)), "").alias("q"),
        F.split(F.upper(F.substring("ref_seq", (lo - F.col("chunk") * chunk_size).cast("int") + 1, n)), "").alias("ref"),
    )
    per_base = cut.select("chr", *keep, "from", F.posexplode(F.arrays_zip("base", "q", "ref")).alias("i", "z"))
    base, ref = F.col("z.base"), F.col("z.ref")
    return per_base.where((base == "X") | ((base != "=") & (base != ref))).select(
        "chr",
        *keep,
        (F.col("from") + F.col("i")).alias("pos"),
        base.alias("base"),
        ref.alias("ref"),
        F.when(F.length("z.q") > 0, F.ascii("z.q") - 33).alias("q"),
    )


def can_be_paired() -> Column:
    return (
        R.has_flag("paired")
        & R.mate_mapped()
        & (F.col("mate_chr") == F.col("chr"))
        & (R.has_flag("first_of_pair") | R.has_flag("second_of_pair"))
        & ~R.has_flag("secondary")
        & ~R.has_flag("supplementary")
    )


PAIR_FIELDS = ("start", "end", "flags", "mq", "cigar", "tlen")


def pair_mates(alignments: DataFrame) -> DataFrame:
    """The two alignments of a pair as one row, the left one first.

    Only primary alignments with a mapped mate on the same chromosome are paired.
    A name seen once gives a row without a second alignment.  The pick is an
    aggregate, so nothing is collected per name.
    """
    row = F.struct(*PAIR_FIELDS)
    met = (
        alignments.where(can_be_paired())
        .groupBy("read_name", "chr")
        .agg(F.min(row).alias("first"), F.max(row).alias("second"), F.count(F.lit(1)).alias("n"))
    )
    second = F.when(F.col("n") > 1, F.col("second"))
    return met.select(
        "read_name",
        "chr",
        F.col("first.start").alias("start"),
        F.greatest("first.end", second["end"]).alias("end"),
        "first",
        second.alias("second"),
    )


def paired_end_stats(
    alignments: DataFrame, low: float = 0.1, high: float = 99.5, by: Sequence[str] = ()
) -> DataFrame:
    """Library orientation and template-length limits from properly paired reads.

    The limits are the values at sorted position ``floor(n * p / 100)``; they are
    only meant to be used when ``n_pairs`` exceeds 99 (``usable``).
    """
    by = list(by)
    proper = alignments.where(R.has_flag("proper_pair")).select(
        *by, F.abs("tlen").alias("size"), R.pair_orientation().alias("po")
    )
    kind = F.concat(F.substring("po", 1, 1), F.substring("po", 3, 1))

    def share(*kinds: str) -> Column:
        return F.sum(F.when(kind.isin(*kinds), 1).otherwise(0)) / F.count(F.lit(1))

    counts = proper.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        share("FF", "RR").alias("ff"),
        share("FR").alias("fr"),
        share("RF").alias("rf"),
    )
    n = F.col("n").cast("double")
    limits = order_statistics(
        proper,
        "size",
        {
            "min_tlen": F.floor(n * (low / 100)) if low else F.lit(-1),
            "max_tlen": F.floor(n * (high / 100)),
        },
        by,
    )
    library = F.when(F.col("ff") > 0.9, "ff").when(F.col("fr") > 0.9, "fr").when(F.col("rf") > 0.9, "rf")
    if by:
        met = counts.join(limits, by)
    else:
        one = limits.select(F.struct("min_tlen", "max_tlen")).scalar()
        met = counts.where("n_pairs > 0").withColumn("__l", one).select("*", "__l.*")
    return met.select(
        *by,
        "n_pairs",
        library.alias("orientation"),
        (F.coalesce("min_tlen", F.lit(0.0)) if low == 0 else F.col("min_tlen")).alias("min_tlen"),
        "max_tlen",
        (F.col("n_pairs") >= MIN_PAIRS_FOR_LIMITS).alias("usable"),
    )


def base_sort_score(pos: int, ref: str, counts: str = "at_pos") -> Column:
    """Score used to order reads at a position by base.

    Insertions and deletions count against the read by their frequency, then
    mismatches by frequency and quality; N comes next, reference bases last.
    ``counts`` names a struct column with the pileup row of the position.
    """
    at = F.lit(pos)
    base, q = R.base_at(at), F.coalesce(R.qual_at(at), F.lit(0))
    c = lambda name: F.coalesce(F.col(counts)[name], F.lit(0))
    ins = F.when(R.insertion_at(at).isNotNull(), -c("ins")).otherwise(0).cast("double")
    seen = F.lit(0)
    for b in BASES:
        seen = F.when(base == b, c(f"pos{b}") + c(f"neg{b}")).otherwise(seen)
    no_base = F.when(c("del") > 0, ins - c("del")).otherwise(F.when(ins == 0, F.lit(1.0)).otherwise(ins))
    ref = ref.upper()
    with_base = (
        F.when((base == "N") & (ins == 0), F.lit(2.0))
        .when(((base == ref) | (base == "=")) & (ins == 0), F.lit(4.0) - q / 1000)
        .when((base == "X") | (base != ref), ins - (seen + q / 1000))
        .otherwise(ins)
    )
    return F.when(base.isNull(), no_base).otherwise(with_base)


def sort_value(option: str, pos: int | None = None, tag: str | None = None) -> Column:
    """Sort key of a read for the simple options; smaller comes first when ascending."""
    simple = {
        "strand": lambda: F.when(R.strand(), 1).otherwise(-1),
        "START": lambda: F.col("start"),
        "TAG": lambda: F.col("tags")[tag],
        "READ_NAME": lambda: F.col("read_name"),
        "INSERT_SIZE": lambda: -F.abs("tlen"),
        "GAP_SIZE": lambda: -R.gap_size_at(F.lit(pos)),
        "MATE_CHR": lambda: F.when(R.mate_mapped(), F.col("mate_chr")),
        "MQ": lambda: -F.col("mq"),
        "ALIGNED_READ_LENGTH": lambda: -F.col("length_on_ref"),
    }
    return simple[option]()


def sort_reads_at(
    alignments: DataFrame, chr: str, pos: int, option: str = "BASE", *, ref: str | None = None, tag: str | None = None, ascending: bool = True
) -> DataFrame:
    """Reads of a chromosome ordered by ``option`` at a position.

    Reads that do not cover the position come last.  ``BASE`` needs the reference
    base and computes the counts of that one position from the same reads.
    """
    here = alignments.where(F.col("chr") == chr)
    covers = (F.col("start") <= pos) & (F.col("end") >= pos)
    if option in ("BASE", "NUCLEOTIDE"):
        row = pileup(here.where(covers)).where(F.col("pos") == pos).drop("pos")
        row = row.select("chr", F.struct(*[c for c in row.columns if c != "chr"]).alias("at_pos"))
        # One position of one chromosome: at most a single row to broadcast.
        here = here.join(F.broadcast(row), "chr", "left")
        key = base_sort_score(pos, ref or "N")
    else:
        key = sort_value(option, pos, tag)
    scored = here.withColumn("sort_value", F.when(covers, key))
    order = F.col("sort_value").asc_nulls_last() if ascending else F.col("sort_value").desc_nulls_last()
    return scored.orderBy((~covers).cast("int"), order)


# Display order of base groups and of pair orientation groups.
BASE_GROUP_RANK = {"A": 1, "T": 2, "C": 3, "G": 4, "N": 5, "GAP": 5, "": 7}
ORIENTATION_ORDER = ["LL", "RR", "RL", "LR", ""]


def group_order(group_by: str, column: str = "group_value") -> list[Column]:
    """Sort expressions for group values.

    Bases by rank, strands reversed with the empty group first, orientations in a
    fixed order, all else numbers before text with blanks last.
    """
    v = F.col(column)
    if group_by.startswith("base:"):
        rank = F.coalesce(*[F.when(v == k, F.lit(r)) for k, r in BASE_GROUP_RANK.items()], F.lit(6))
        return [rank, F.lower(v)]
    if group_by in ("strand", "firstOfPairStrand"):
        return [F.when(v == "", 0).when(v == "-", 1).otherwise(2)]
    if group_by == "pairOrientation":
        return [F.array_position(F.lit(ORIENTATION_ORDER), v)]
    number = v.try_cast("double")
    return [(v == "").cast("int"), number.isNull().cast("int"), number, F.lower(v)]
