"""Column expressions on alignments: flags, CIGAR, orientation, tags and grouping keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from genospan.functions.sequence import lookup

# The SAM flag bits.
FLAGS = {
    "paired": 0x1,
    "proper_pair": 0x2,
    "unmapped": 0x4,
    "mate_unmapped": 0x8,
    "reverse": 0x10,
    "mate_reverse": 0x20,
    "first_of_pair": 0x40,
    "second_of_pair": 0x80,
    "secondary": 0x100,
    "qc_fail": 0x200,
    "duplicate": 0x400,
    "supplementary": 0x800,
}

# Pair orientation classes by library type.
ORIENTATION_CLASS = {
    "fr": {"F1R2": "LR", "F2R1": "LR", "F1F2": "LL", "F2F1": "LL", "R1R2": "RR", "R2R1": "RR", "R1F2": "RL", "R2F1": "RL"},
    "rf": {"R1F2": "LR", "R2F1": "LR", "R1R2": "LL", "R2R1": "LL", "F1F2": "RR", "F2F1": "RR", "F1R2": "RL", "F2R1": "RL"},
    "ff": {"F2F1": "LR", "R1R2": "LR", "F2R1": "LL", "R1F2": "LL", "R2F1": "RR", "F1R2": "RR", "R2R1": "RL", "F1F2": "RL"},
}


def has_flag(name: str, flags: Column | str = "flags") -> Column:
    col = F.col(flags) if isinstance(flags, str) else flags
    return col.bitwiseAND(F.lit(FLAGS[name])) != 0


def decode_flags(flags: str = "flags") -> list[Column]:
    """The twelve flag bits as booleans, and the strand as a boolean (true = forward)."""
    return [has_flag(n, flags).alias(n) for n in FLAGS] + [(~has_flag("reverse", flags)).alias("strand")]


def strand() -> Column:
    return ~has_flag("reverse")


def mate_mapped() -> Column:
    return ~has_flag("mate_unmapped")


def first_of_pair_strand() -> Column:
    """Strand of the first read of the pair; NULL when it cannot be known."""
    return F.when(
        has_flag("paired"),
        F.when(has_flag("first_of_pair"), strand()).when(mate_mapped(), ~has_flag("mate_reverse")),
    )


def pair_orientation() -> Column:
    """Such as ``F1R2``: strand and order of the left and the right read.

    Without a recorded template length the mate end is estimated from the read's
    own length.  Needs ``chr, start, end, tlen, mate_chr, mate_pos, flags``.
    """
    own = F.when(strand(), "F").otherwise("R")
    other = F.when(has_flag("mate_reverse"), "R").otherwise("F")
    is_first, is_second = has_flag("first_of_pair"), has_flag("second_of_pair")
    own_no = F.when(is_first, "1").when(is_second, "2").otherwise(" ")
    other_no = F.when(is_first, "2").when(is_second, "1").otherwise(" ")
    length = F.col("end") - F.col("start")
    mate_end = F.col("mate_pos") + F.when(F.col("start") < F.col("mate_pos"), length).otherwise(-length)
    size = F.when(F.col("tlen") == 0, mate_end - F.col("start")).otherwise(F.col("tlen"))
    this_one, the_mate = F.concat(own, own_no), F.concat(other, other_no)
    value = F.when(size > 0, F.concat(this_one, the_mate)).otherwise(F.concat(the_mate, this_one))
    return F.when(~has_flag("unmapped") & mate_mapped() & (F.col("mate_chr") == F.col("chr")), value)


def orientation_class(library: str, orientation: Column | str = "pair_orientation") -> Column:
    return lookup(F.col(orientation) if isinstance(orientation, str) else orientation, ORIENTATION_CLASS[library])


def cigar_ops(cigar: str = "cigar") -> Column:
    """Array of ``(op, len)``; neighbours with the same operation are merged."""
    items = F.regexp_extract_all(F.col(cigar), F.lit(r"\d+[A-Z=]"), F.lit(0))
    raw = F.transform(
        items,
        lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.substring(x, F.lit(1), F.length(x) - 1).cast("long").alias("len")),
    )
    # The same operation twice in a row is rare, so merging is only done where it occurs.
    twice = F.col(cigar).rlike(r"\d+([A-Z=])\d+\1")

    def put(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(x["op"].alias("op"), (last["len"] + x["len"]).alias("len"))),
        )
        same = F.coalesce(F.try_element_at(done, F.lit(-1))["op"] == x["op"], F.lit(False))
        return F.when(same, grown).otherwise(F.concat(done, F.array(x)))

    merged = F.aggregate(raw, F.array().cast("array<struct<op:string,len:bigint>>"), put)
    return F.when(twice, merged).otherwise(raw)


def cigar_parts(start: str = "start", cigar: str = "cigar") -> Column:
    """CIGAR operations with their reference position and read offset.

    Struct array ``(op, len, pos, off)``; ``pos`` of a soft clip is where the
    clipped bases would lie: before the alignment for a leading clip, else after.
    """
    empty = F.struct(
        F.col(start).cast("long").alias("pos"),
        F.lit(0).cast("long").alias("off"),
        F.lit(False).alias("seen"),
        F.array().cast("array<struct<op:string,len:bigint,pos:bigint,off:bigint>>").alias("parts"),
    )

    def step(acc: Column, x: Column) -> Column:
        op, n = x["op"], x["len"]
        one_of = lambda kinds: F.contains(F.lit(kinds), op)
        on_ref, on_read = one_of("M=XDN"), one_of("M=XIS")
        at = F.when((op == "S") & ~acc["seen"], acc["pos"] - n).otherwise(acc["pos"])
        return F.struct(
            (acc["pos"] + F.when(on_ref, n).otherwise(0)).alias("pos"),
            (acc["off"] + F.when(on_read, n).otherwise(0)).alias("off"),
            (acc["seen"] | one_of("M=XS")).alias("seen"),
            F.concat(
                acc["parts"],
                F.array(F.struct(op.alias("op"), n.alias("len"), at.alias("pos"), acc["off"].alias("off"))),
            ).alias("parts"),
        )

    return F.aggregate(cigar_ops(cigar), empty, step, lambda acc: acc["parts"])


def blocks(parts: str = "parts") -> Column:
    """Aligned and soft-clipped blocks ``(op, len, pos, off)``."""
    return F.filter(parts, lambda p: p["op"].isin("M", "=", "X", "S"))


def aligned_blocks(parts: str = "parts") -> Column:
    return F.filter(parts, lambda p: p["op"].isin("M", "=", "X"))


def gaps(parts: str = "parts") -> Column:
    """Deletions (D) and skipped regions (N)."""
    return F.filter(parts, lambda p: p["op"].isin("D", "N"))


def insertions(parts: str = "parts", min_length: int = 0) -> Column:
    return F.filter(parts, lambda p: (p["op"] == "I") & (p["len"] > min_length))


def small_indel_filter(parts: str = "parts", threshold: int = 1) -> Column:
    """Operations without insertions and gaps of ``threshold`` bases or fewer."""
    return F.filter(parts, lambda p: ~p["op"].isin("I", "D", "N") | (p["len"] > threshold))


def length_on_ref(cigar: str | Column = "cigar") -> Column:
    """Bases of the reference that the alignment spans."""
    col = F.col(cigar) if isinstance(cigar, str) else cigar
    lens = F.regexp_extract_all(col, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(lens, F.lit(0).cast("long"), lambda a, n: a + n.cast("long"))


def soft_clip_extent(parts: str = "parts") -> list[Column]:
    """``sc_start`` and ``sc_length``: the extent including clipped ends."""
    clips = F.filter(parts, lambda p: p["op"] == "S")
    total = F.aggregate(clips, F.lit(0).cast("long"), lambda a, p: a + p["len"])
    first = F.get(blocks(parts), F.lit(0))
    lead = F.when(first["op"] == "S", first["len"]).otherwise(0)
    return [(F.col("start") - lead).alias("sc_start"), (F.col("length_on_ref") + total).alias("sc_length")]


def soft_clipped_blocks(parts: str = "parts") -> list[Column]:
    """Left and right soft clips of an alignment."""
    shown = blocks(parts)
    first, last = F.get(shown, F.lit(0)), F.try_element_at(shown, F.lit(-1))
    left = F.when(first["op"] == "S", first)
    right = F.when((F.size(shown) > 1) & (last["op"] == "S"), last)
    return [left.alias("left_clip"), right.alias("right_clip")]


def block_at(pos: Column, parts: str = "parts") -> Column:
    return F.get(F.filter(blocks(parts), lambda b: (b["pos"] <= pos) & (pos < b["pos"] + b["len"])), F.lit(0))


def read_index_at(pos: Column, parts: str = "parts") -> Column:
    b = block_at(pos, parts)
    return pos - b["pos"] + b["off"]


def base_at(pos: Column) -> Column:
    """Read base over a reference position; NULL outside blocks, ``*`` without a sequence."""
    i = read_index_at(pos)
    return F.when(i.isNotNull(), F.when(F.col("seq") == "*", "*").otherwise(F.substring("seq", i.cast("int") + 1, F.lit(1))))


def qual_at(pos: Column) -> Column:
    i = read_index_at(pos)
    char = F.substring("qual", i.cast("int") + 1, F.lit(1))
    return F.when(i.isNotNull() & (F.col("qual") != "*") & (char != ""), F.ascii(char) - 33)


def qual_array() -> Column:
    """Base qualities as integers; NULL when the file has none."""
    return F.when(F.col("qual") != "*", F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33))


def gap_size_at(pos: Column, parts: str = "parts") -> Column:
    hit = F.get(F.filter(gaps(parts), lambda g: (g["pos"] <= pos) & (pos < g["pos"] + g["len"])), F.lit(0))
    return F.coalesce(hit["len"], F.lit(0))


def insertion_at(pos: Column, parts: str = "parts") -> Column:
    """Inserted bases at a position; an insertion lies at its first inserted base."""
    hit = F.get(F.filter(insertions(parts), lambda i: i["pos"] == pos), F.lit(0))
    return F.when(hit.isNotNull(), F.substring("seq", hit["off"].cast("int") + 1, hit["len"].cast("int")))


def parse_sa(sa: Column) -> Column:
    """Supplementary alignments of an ``SA`` tag: (chr, start, strand, mapq, mismatches, len_on_ref)."""
    recs = F.filter(F.split(sa, ";"), lambda r: F.length(r) > 0)

    def one(r: Column) -> Column:
        t = F.split(r, ",")
        return F.struct(
            F.get(t, F.lit(0)).alias("chr"),
            F.get(t, F.lit(1)).try_cast("long").alias("start"),
            F.substring(F.get(t, F.lit(2)), 1, 1).alias("strand"),
            F.get(t, F.lit(4)).try_cast("int").alias("mapq"),
            F.get(t, F.lit(5)).try_cast("int").alias("mismatches"),
            length_on_ref(F.get(t, F.lit(3))).alias("len_on_ref"),
        )

    return F.transform(recs, one)


def group_value(group_by: str, library: str = "fr") -> Column:
    """Grouping key of a read, as text; the empty text means no value.

    ``strand, firstOfPairStrand, mateChr, pairOrientation, chimeric,
    supplementary, readOrder, phase, tag:XX, base:chr:pos, insertion:chr:pos``
    with 1-based positions.
    """
    sign = lambda c: F.when(c, "+").otherwise("-")
    kind, _, rest = group_by.partition(":")
    if kind == "strand":
        return sign(strand())
    if kind == "firstOfPairStrand":
        s = first_of_pair_strand()
        return F.when(s.isNull(), "").otherwise(sign(s))
    if kind == "mateChr":
        return F.when(mate_mapped(), F.coalesce("mate_chr", F.lit(""))).otherwise("")
    if kind == "pairOrientation":
        return F.coalesce(orientation_class(library, pair_orientation()), F.lit(""))
    if kind == "chimeric":
        return F.when(F.col("tags")["SA"].isNotNull(), "chimeric").otherwise("")
    if kind == "supplementary":
        return F.when(has_flag("supplementary"), "supplementary").otherwise("")
    if kind == "readOrder":
        return (
            F.when(has_flag("paired") & has_flag("first_of_pair"), "first")
            .when(has_flag("paired") & has_flag("second_of_pair"), "second")
            .otherwise("")
        )
    if kind in ("phase", "tag"):
        return F.coalesce(F.col("tags")["HP" if kind == "phase" else rest], F.lit(""))
    if kind in ("base", "insertion"):
        chrom, _, where = rest.rpartition(":")
        pos = F.lit(int(where.replace(",", "")) - 1)
        inside = (F.col("chr") == chrom) & (F.col("start") <= pos) & (F.col("end") > pos)
        value = F.coalesce(base_at(pos), F.lit("GAP")) if kind == "base" else F.coalesce(insertion_at(pos), F.lit(""))
        return F.when(inside, value).otherwise("")
    raise ValueError(f"unknown grouping {group_by!r}")


def insert_size_class(low: Column | float, high: Column | float) -> Column:
    """``inter`` / ``small`` / ``large`` against template-length limits, else NULL."""
    lo = F.lit(low) if isinstance(low, (int, float)) else low
    hi = F.lit(high) if isinstance(high, (int, float)) else high
    size = F.abs("tlen")
    return F.when(
        mate_mapped(),
        F.when(F.col("mate_chr") != F.col("chr"), "inter")
        .when((lo != 0) & (size < lo), "small")
        .when((hi != 0) & (size > hi), "large"),
    )
