"""Locus texts, locus predicates, search keys and HGVS notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT_MARGIN = 20


def parse_locus(text: Column) -> Column:
    """Struct ``(chr, start, end)`` of ``chr:start-end``, a tab-separated triple or ``chr:pos``.

    Coordinates in the text are 1-based and may contain commas.  A single
    position is widened by 20 bases to both sides.  A range that would begin
    before 0 is moved to 0.  A bare name has NULL coordinates; text that cannot be
    read gives NULL.
    """
    clean = F.replace(text, F.lit(","), F.lit(""))
    tab = r"^([^\t]+)\t(-?\d+)\t(-?\d+)"
    span = r"^([^:]+):(-?\d+)-(-?\d+)$"
    point = r"^([^:]+):(-?\d+)$"

    def built(pattern: str, margin: bool) -> Column:
        start = F.regexp_extract(clean, pattern, 2).try_cast("long") - 1
        end = start + 1 if margin else F.regexp_extract(clean, pattern, 3).try_cast("long")
        if margin:
            return F.struct(
                F.regexp_extract(clean, pattern, 1).alias("chr"), (start - POINT_MARGIN).alias("start"), (end + POINT_MARGIN).alias("end")
            )
        shift = F.when(start < 0, -start).otherwise(F.lit(0))
        return F.struct(F.regexp_extract(clean, pattern, 1).alias("chr"), (start + shift).alias("start"), (end + shift).alias("end"))

    bare = F.struct(text.alias("chr"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    return (
        F.when(clean.rlike(tab), built(tab, False))
        .when(clean.rlike(span), built(span, False))
        .when(clean.rlike(point), built(point, True))
        .when(~text.contains(":"), bare)
    )


def format_locus(chr: Column, start: Column, end: Column) -> Column:
    """``chr:start-end`` with 1-based start and thousands separators; ``all`` stays ``all``."""
    number = lambda c: F.format_number(c, 0)
    return F.when(chr == "all", "all").otherwise(
        F.concat(chr, F.lit(":"), number(F.floor(start) + 1), F.lit("-"), number(F.round(end)))
    )


def contains(chr1, start1, end1, chr2, start2, end2) -> Column:
    return (chr1 == chr2) & (start2 >= start1) & (end2 <= end1)


def overlaps(chr1, start1, end1, chr2, start2, end2) -> Column:
    """Closed ends: loci that only touch overlap."""
    return (chr1 == chr2) & ~((end2 < start1) | (start2 > end1))


def extend(chr1, start1, end1, chr2, start2, end2) -> Column:
    """The first locus widened to include the second, when both are on one chromosome."""
    same = chr1 == chr2
    return F.struct(
        chr1.alias("chr"),
        F.when(same, F.least(start1, start2)).otherwise(start1).alias("start"),
        F.when(same, F.greatest(end1, end2)).otherwise(end1).alias("end"),
    )


def search_key(text: Column) -> Column:
    """Upper case, blanks as ``+``."""
    return F.upper(F.replace(text, F.lit(" "), F.lit("+")))


def hgvs_valid(text: Column) -> Column:
    """True where ``hgvs_parse`` can read the text."""
    return hgvs_parse(text).isNotNull()


def _hgvs_position(token: Column) -> Column:
    """Struct ``(side, number, offset)`` of one position: a sign or star, digits, and a distance into an intron."""
    side = F.when(token.startswith("*"), "*").when(token.startswith("-"), "-").otherwise("")
    digits = F.split(F.ltrim(token, F.lit("*-")), "(?=[+-])", 2)
    return F.struct(
        side.alias("side"), F.get(digits, 0).try_cast("long").alias("number"), F.get(digits, 1).try_cast("long").alias("offset")
    )


def hgvs_parse(text: Column) -> Column:
    """Parts of a notation: accession, type, two positions with their offsets, and UTR side; NULL if it cannot be read.

    A notation is a reference sequence, with a gene in brackets if need be, a colon, the
    coordinate type and a description.  The description of ``g``, ``c`` and ``n`` begins with
    one position or two joined by ``_``; each has its own offset, and a single
    position is both ends.  ``utr`` is ``5`` for ``c.-N``, ``3`` for ``c.*N``.  Where the second
    end is unknown or lies on another side, the first position is both ends.
    Protein notation (``p``) needs a residue number and has no positions here.
    """
    head, tail = F.substring_index(text, ":", 1), F.get(F.split(text, ":", 2), 1)
    accession = F.substring_index(head, "(", 1)
    named = (F.length(accession) > 0) & (F.translate(accession, " \t/,;", "") == accession)
    gene = F.substring(head, F.length(accession) + 1, F.length(head))
    gene_ok = (gene == "") | (gene.endswith(")") & (F.length(gene) > 2))
    kind = F.substring_index(tail, ".", 1)
    body = F.ltrim(F.substring(tail, 3, F.length(tail)), F.lit("("))
    ends = F.split(F.regexp_extract(body, "^[0-9_?*+-]*", 0), "_")
    first, second = _hgvs_position(F.get(ends, 0)), _hgvs_position(F.get(ends, 1))
    side_ok = (first["side"] == "") | (kind == "c") | ((kind == "n") & (first["side"] == "-"))
    residue = F.translate(F.substring_index(body, "_", 1), "0123456789", "") != F.substring_index(body, "_", 1)
    readable = F.when(kind.isin("g", "c", "n"), first["number"].isNotNull() & side_ok).when(kind == "p", residue)
    single = second["number"].isNull() | (second["side"] != first["side"])
    signed = lambda p: F.when((kind == "n") & (p["side"] == "-"), -p["number"]).otherwise(p["number"])
    placed = lambda value: F.when(kind != "p", value)
    pos1, off1 = signed(first), F.coalesce(first["offset"], F.lit(0))
    return F.when(
        named & gene_ok & readable,
        F.struct(
            accession.alias("accession"),
            kind.alias("type"),
            F.when((kind == "c") & (first["side"] == "-"), "5").when((kind == "c") & (first["side"] == "*"), "3").alias("utr"),
            placed(pos1).alias("pos1"),
            placed(F.when(single, pos1).otherwise(signed(second))).alias("pos2"),
            F.when(kind.isin("g", "p"), 0).otherwise(off1).cast("long").alias("offset1"),
            F.when(kind.isin("g", "p"), 0).when(single, off1).otherwise(F.coalesce(second["offset"], F.lit(0))).cast("long").alias("offset2"),
        ),
    )
