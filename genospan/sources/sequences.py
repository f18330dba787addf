"""FASTA, GenBank and AED files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genospan.scale import ordered_scan
from genospan.sources.lines import ORDER, as_long, fill_directives, line_block, ordered_lines


def read_fasta(spark: SparkSession, path) -> DataFrame:
    return parse_fasta(ordered_lines(spark, path))


def parse_fasta(lines: DataFrame) -> DataFrame:
    """Sequence rows ``(chr, offset, seq)``, one per line of the file, from an ordered line table.

    A header with ``@len=`` is a slice ``chr:from-to`` that starts at ``from - 1``;
    any other header starts a whole contig.  The offset of a line is the running
    length of the lines above it in the same record, so a contig of any length is
    never held in one row.
    """
    v = F.col("value")
    is_head = v.startswith(">")
    token = F.regexp_extract(v, r"^>(\S*)", 1)
    slice_of = v.contains("@len=")
    start = as_long(F.regexp_extract(token, r":(\d+)-\d+$", 1)) - 1
    head = F.struct(
        F.when(slice_of, F.split_part(token, F.lit(":"), F.lit(1))).otherwise(token).alias("chr"),
        F.when(slice_of, F.coalesce(start, F.lit(0))).otherwise(F.lit(0)).alias("offset"),
        as_long(F.regexp_extract(v, r"@len=(\d+)", 1)).alias("length"),
        F.col("part").alias("part"),
        F.col("line").alias("line"),
    )
    body = lines.where((v != "") & ~v.startswith("#"))
    filled = fill_directives(body, F.when(is_head, head), "h").where(~is_head)
    keyed = filled.select("file", *ORDER, F.struct("h.part", "h.line").alias("record"), "h", F.col("value").alias("seq"))
    placed = ordered_scan(keyed, ["file", "record"], ORDER, line_block(), before=("sum_before", F.length("seq")))
    return placed.select(
        F.col("h.chr").alias("chr"), (F.col("h.offset") + F.col("before")).alias("offset"), "seq", F.col("h.length").alias("declared_length")
    )


def fasta_lengths(sequence: DataFrame) -> DataFrame:
    """Contig lengths: the declared one, else the end of the last line."""
    end = F.max(F.col("offset") + F.length("seq"))
    return sequence.groupBy("chr").agg(F.coalesce(F.max("declared_length"), end).alias("length"))


def read_genbank(spark: SparkSession, path) -> DataFrame:
    records = spark.read.option("lineSep", "\n//").text(path)
    return parse_genbank(records)


def parse_genbank(records: DataFrame) -> DataFrame:
    """One row per GenBank record: ``chr, locus, accession, aliases, sequence`` and the feature texts."""
    v = F.col("value")
    start_of = lambda word: F.regexp_extract(v, rf"(?m)^{word}\s+(\S+)", 1)
    accession, locus = start_of("ACCESSION"), start_of("LOCUS")
    origin = F.regexp_extract(v, r"(?s)\nORIGIN[^\n]*\n(.*)$", 1)
    block = F.regexp_extract(v, r"(?s)\nFEATURES[^\n]*\n(.*?)(?:\nORIGIN|$)", 1)
    aliases = start_of("ALIASES")
    return records.where(locus != "").select(
        F.when(accession != "", accession).otherwise(locus).alias("chr"),
        locus.alias("locus"),
        accession.alias("accession"),
        F.when(aliases != "", F.split(aliases, ",")).alias("aliases"),
        F.regexp_replace(origin, r"[\s\d/]+", "").alias("sequence"),
        # A feature starts in column 6; its qualifiers are indented further.
        F.filter(F.split(block, r"\n(?= {5}\S)"), lambda f: F.trim(f) != "").alias("feature_texts"),
    )


def genbank_features(records: DataFrame) -> DataFrame:
    """Features of GenBank records; ``source`` rows are left out.

    ``join``, ``order`` and ``complement`` give strand and exons; qualifiers go to
    ``attributes``.
    """
    f = records.select("chr", F.explode("feature_texts").alias("text"))
    text = F.col("text")
    kind = F.regexp_extract(text, r"^\s{5}(\S+)", 1)
    rest = F.regexp_replace(text, r"^\s{5}\S+\s+", "")
    location = F.regexp_replace(F.regexp_extract(rest, r"(?s)^(.*?)(?:\n\s+/|$)", 1), r"\s+", "")
    quals = F.regexp_extract_all(rest, F.lit(r'(?s)\n\s+/(\w+=(?:"[^"]*+(?:""[^"]*+)*+"|[^\n]*))'), F.lit(1))
    entries = F.transform(
        quals,
        lambda q: F.struct(
            F.regexp_extract(q, r"^(\w+)=", 1).alias("col1"),
            F.regexp_replace(F.regexp_replace(q, r"(?s)^\w+=\"?(.*?)\"?$", "$1"), r"\n\s+", "").alias("col2"),
        ),
    )
    from genospan.sources.annotations import last_of_key

    rows = f.select("chr", kind.alias("type"), location.alias("loc"), entries.alias("e")).where(F.lower("type") != "source")
    spans = F.regexp_extract_all("loc", F.lit(r"(\d+(?:\.\.[<>]?\d+)?)"), F.lit(1))
    exons = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                (as_long(s) - 1).alias("start"),
                F.when(s.contains(".."), as_long(F.regexp_extract(s, r"\.\.[<>]?(\d+)$", 1))).otherwise(as_long(s)).alias("end"),
            ),
        )
    )
    return rows.select(
        "chr", "type", F.when(F.col("loc").contains("complement"), "-").otherwise("+").alias("strand"), exons.alias("x"),
        F.map_from_entries(last_of_key(F.col("e"))).alias("attributes"),
    ).where(F.size("x") > 0).select(
        "chr", "type", "strand",
        F.get("x", F.lit(0))["start"].alias("start"),
        F.element_at("x", -1)["end"].alias("end"),
        F.when(F.size("x") > 1, F.col("x")).alias("exons"),
        "attributes",
    )


AED_HEADER = re.compile(r"^(?:([^:(]+):)?([^(]+)\(([^)]+)\)$")
AED_NAMES = {"sequence": "chr", "start": "start", "end": "end", "name": "name", "strand": "strand"}


def aed_columns(header: Sequence[str]) -> list[tuple[str, str, str]]:
    """(namespace, name, type) of every header cell ``ns:name(ns:type)``."""
    out = []
    for cell in header:
        m = AED_HEADER.match(cell.strip())
        if not m:
            raise ValueError(f"header cell {cell!r} is not in ns:name(ns:type) form")
        out.append((m.group(1) or "?", m.group(2), m.group(3)))
    return out


def read_aed(spark: SparkSession, path) -> DataFrame:
    """AED rows: typed header, quoted fields may span lines, a doubled quote is a quote."""
    raw = (
        spark.read.option("sep", "\t").option("multiLine", True).option("escape", '"').option("header", False)
        .option("mode", "PERMISSIVE").csv(path)
    )
    header = [c for c in raw.first() if c is not None]
    return shape_aed(raw, header)


def shape_aed(raw: DataFrame, header: Sequence[str]) -> DataFrame:
    """Name the columns by the typed header; rows without coordinates (file metadata) are dropped."""
    cols = aed_columns(header)
    at = {}
    for i, (ns, name, _) in enumerate(cols):
        at.setdefault((ns, name), raw.columns[i])
    pick = lambda name: F.col(at.get(("bio", name)) or at.get(("aed", name)) or at[("?", name)])
    rest = [x for i, (ns, name, _) in enumerate(cols) for x in (F.lit(f"{ns}:{name}"), F.col(raw.columns[i]))]
    out = raw.select(
        pick("sequence").alias("chr"), as_long(pick("start")).alias("start"), as_long(pick("end")).alias("end"),
        F.create_map(*rest).alias("attributes"),
    )
    return out.where(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("chr").isNotNull())
