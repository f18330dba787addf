"""Nucleotide sequence expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nucleotide codes and their partners (W and S pair with themselves); other characters stay as they are.
IUPAC = "ACGTYRWSKMDHBV"
IUPAC_COMPLEMENT = "TGCARYWSMKHDVB"


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of ``key`` in a small fixed table, else NULL."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def complement(seq: Column) -> Column:
    return F.translate(seq, IUPAC + IUPAC.lower(), IUPAC_COMPLEMENT + IUPAC_COMPLEMENT.lower())


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


# Fixed value: the standard genetic code, codons in T, C, A, G order.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon_table() -> dict[str, str]:
    letters = ["STOP" if a == "*" else a for a in AMINO_ACIDS]
    return dict(zip(("".join(c) for c in product("TCAG", repeat=3)), letters))


def codons(seq: Column, frame: int) -> Column:
    """Whole codons of reading frame 0, 1 or 2, cut in one pass over the text."""
    return F.regexp_extract_all(F.substring(seq, F.lit(frame + 1), F.length(seq)), F.lit("(?s)(.{3})"), F.lit(1))


def amino_acid(codon: Column) -> Column:
    """Amino acid of an upper-case codon by its rank in T, C, A, G order; empty when unknown."""
    digit = lambda i: F.instr(F.lit("TCAG"), F.substring(codon, i, 1))
    a, b, c = digit(1), digit(2), digit(3)
    acids = F.array(*[F.lit("STOP" if x == "*" else x) for x in AMINO_ACIDS])
    known = (a > 0) & (b > 0) & (c > 0)
    return F.when(known, F.get(acids, a * 16 + b * 4 + c - 21)).otherwise("")


def translate_frame(seq: Column, frame: int, reverse: bool = False) -> Column:
    """Amino acids of a frame as an array; unknown codons give the empty text.

    In reverse mode each codon is read backwards: the caller passes the already
    complemented strand in forward order.
    """
    read = (lambda c: F.upper(F.reverse(c))) if reverse else (lambda c: F.upper(c))
    return F.transform(codons(seq, frame), lambda c: amino_acid(read(c)))


def translate_3_frames(seq: Column, reverse: bool = False) -> list[Column]:
    return [translate_frame(seq, f, reverse).alias(f"frame{f}") for f in range(3)]
