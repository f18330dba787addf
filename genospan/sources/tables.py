"""Tabular formats: segments, pairs, association tables, matrices, fusions, arcs, genome tables, custom columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genospan.sources.lines import (
    Header,
    as_double,
    as_long,
    blank_fields,
    content,
    dot_null,
    double_field,
    field,
    join_by_file,
    listed_header,
    long_field,
    named_fields,
    with_file_headers,
)

# 0-based columns of the three sample-interval formats.
SEGMENT_LAYOUT = {
    "seg": {"sample": 0, "chr": 1, "start": 2, "end": 3, "value": None},
    "mut": {"sample": 3, "chr": 0, "start": 1, "end": 2, "value": 4},
    "maf": {"sample": 15, "chr": 4, "start": 5, "end": 6, "value": 8},
}
# Header names (lower case) of association tables.
CHROM_NAMES = ("chr", "chromosome", "chr_id", "chrom")
POSITION_NAMES = ("bp", "pos", "position", "chr_pos")
P_NAMES = ("p", "pval", "pvalue", "p-value", "p.value")
SNP_NAMES = ("rsid", "variant", "snp")
PHENOTYPE_NAMES = ("phenotype", "gene", "gene_id", "molecular_trait_id")
# Header names of a two-anchor table with donut statistics.
DONUT_NAMES = ("fdrDonut", "fdr_donut")
SMALLEST_DOUBLE = 4.9e-324
SMALLEST_EXPONENT = -323


def content_line() -> Column:
    """The header of tables is their first line that is neither empty nor a comment."""
    return ~F.col("value").startswith("#") & (F.col("value") != "")


def read_segments(spark: SparkSession, path, kind: str = "seg") -> DataFrame:
    """Sample intervals of any number of files, each read by its own header."""
    lines, header = with_file_headers(spark, path, content_line())
    return _segments(lines, header, kind).withColumn("attributes", F.when(header.size > 5, F.col("attributes"))).select(
        "sample", "chr", "start", "end", "value", "attributes"
    )


def parse_segments(lines: DataFrame, header: Sequence[str], kind: str = "seg") -> DataFrame:
    """Sample intervals, 1-based starts; in ``seg`` the value is the last column.

    Columns that are not sample or coordinates are kept in ``attributes`` when the
    header has more than five columns.
    """
    rows = _segments(lines, listed_header(header), kind)
    names = ["sample", "chr", "start", "end", "value"]
    return rows.select(*names, "attributes") if len(header) > 5 else rows.select(*names)


def _segments(lines: DataFrame, header: Header, kind: str) -> DataFrame:
    at = {k: None if i is None else F.lit(i) for k, i in SEGMENT_LAYOUT[kind].items()}
    if at["value"] is None:
        at["value"] = header.size - 1
    t = lines.where((F.col("value") != header.line) & ~F.col("value").startswith("#")).withColumn("t", F.split("value", "\t"))
    value = double_field(at["value"]) if kind == "seg" else field(at["value"])
    attributes = named_fields(header, [at[k] for k in ("sample", "chr", "start", "end")])
    cols = {
        "sample": field(at["sample"]),
        "chr": field(at["chr"]),
        "start": long_field(at["start"]) - 1,
        "end": long_field(at["end"]),
        "value": value,
        "attributes": attributes,
    }
    return t.where(F.size("t") > at["value"]).withColumns(cols)


def read_bedpe(spark: SparkSession, path) -> DataFrame:
    """Two-anchor features of any number of files, each read by its own header, if it has one."""
    heading = F.col("value").startswith("#") | F.col("value").rlike("(?i)^chr(omosome)?1\t")
    lines, header = with_file_headers(spark, path, heading)
    rows = _pairs(lines, header)
    named = rows.select("file", *_PAIR_COLUMNS, "extras")
    return interchrom_duplicates(name_as_score(named, ["file"]).drop("file"))


def parse_bedpe(lines: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Two-anchor features; a row across chromosomes comes twice, the second with ``dup``.

    With a header that names a donut false discovery rate the first six columns
    are coordinates and the rest are extras.  Where no score column is present and
    every name is a number, the names are the scores.
    """
    header = listed_header(columns or [""])
    std = 6 if set(DONUT_NAMES) & set(columns or ()) else 10
    more = ["extras"] if columns and len(columns) > std else []
    return interchrom_duplicates(name_as_score(_pairs(lines, header).select(*_PAIR_COLUMNS, *more)))


_PAIR_COLUMNS = ["chr1", "start1", "end1", "chr2", "start2", "end2", "name", "score", "strand1", "strand2"]


def _pairs(lines: DataFrame, header: Header) -> DataFrame:
    # A file without a header has no donut columns and no extras.
    hiccups = F.coalesce(F.arrays_overlap(header.names, F.array(*map(F.lit, DONUT_NAMES))), F.lit(False))
    std = F.when(hiccups, F.lit(6)).otherwise(F.lit(10))
    text = F.trim("value")
    t = content(lines).withColumn("t", F.when(hiccups, F.split(text, r"\t")).otherwise(F.split(text, r"\s+"))).where(F.size("t") >= 6)
    named = lambda i: F.when(~hiccups, dot_null(field(i)))
    extras = F.slice(F.transform(header.names, lambda n, i: F.struct(n, field(i))), std + 1, F.greatest(header.size - std, F.lit(0)))
    cols = {
        "chr1": field(0), "start1": long_field(1), "end1": long_field(2),
        "chr2": field(3), "start2": long_field(4), "end2": long_field(5),
        "name": named(6), "score": as_double(named(7)), "strand1": named(8), "strand2": named(9),
        "extras": F.when((header.size > std) & (F.size("t") == header.size), F.map_from_entries(extras)),
    }
    return t.withColumns(cols).where("start1 is not null and end1 is not null and start2 is not null and end2 is not null")


def name_as_score(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Move numeric names to the score where no row of a file has a score (a decision over the whole file)."""
    number = F.col("name").try_cast("double")
    numeric = F.coalesce(F.bool_and(number.isNotNull() | F.col("name").isNull()), F.lit(False))
    verdict = ((F.count("score") == 0) & numeric & (F.count("name") > 0)).alias("__use")
    # The rows themselves are not moved: the verdict is one row, or one a file.
    if by:
        judged = join_by_file(rows, rows.groupBy(*by).agg(verdict))
    else:
        judged = rows.withColumn("__use", rows.agg(verdict).scalar())
    use = F.col("__use")
    return judged.withColumns({"score": F.when(use, number).otherwise(F.col("score")), "name": F.when(~use, F.col("name"))}).drop("__use")


def interchrom_duplicates(rows: DataFrame) -> DataFrame:
    """Extent of a two-anchor row on its chromosome; one row per chromosome when they differ."""
    same = F.col("chr1") == F.col("chr2")
    whole = F.struct(
        F.col("chr1").alias("chr"), F.least("start1", "start2").alias("start"), F.greatest("end1", "end2").alias("end"), F.lit(False).alias("dup")
    )
    side = lambda k, dup: F.struct(
        F.col(f"chr{k}").alias("chr"), F.col(f"start{k}").alias("start"), F.col(f"end{k}").alias("end"), F.lit(dup).alias("dup")
    )
    places = F.when(same, F.array(whole)).otherwise(F.array(side(1, False), side(2, True)))
    return rows.select("*", F.inline(places))


def parse_bedpe_domain(lines: DataFrame) -> DataFrame:
    t = content(lines).select(blank_fields().alias("t")).where(F.size("t") >= 8)
    return t.select(
        field(0).alias("chr"), long_field(1).alias("start"), long_field(2).alias("end"), field(6).alias("color"), double_field(7).alias("value")
    ).where(F.col("start").isNotNull())


def parse_interact(lines: DataFrame) -> DataFrame:
    """UCSC interact rows: own extent, then source and target anchors."""
    t = content(lines).select(F.split("value", r"\t|\s+").alias("t")).where(F.size("t") >= 6)
    return t.select(
        field(0).alias("chr"), long_field(1).alias("start"), long_field(2).alias("end"),
        field(8).alias("chr1"), long_field(9).alias("start1"), long_field(10).alias("end1"),
        field(13).alias("chr2"), long_field(14).alias("start2"), long_field(15).alias("end2"),
        field(3).alias("name"), double_field(4).alias("score"), double_field(5).alias("value"),
        F.when(field(7) == "0", "rgb(0,0,0)").otherwise(dot_null(field(7))).alias("color"),
    )


def parse_longrange(lines: DataFrame) -> DataFrame:
    """Rows whose fourth column reads ``chr:start-end,score``."""
    t = content(lines).select(blank_fields().alias("t")).where(F.size("t") >= 4)
    mate = r"^([^:]+):(\d+)-(\d+)(?:,(.*))?$"
    part = lambda i: F.regexp_extract(field(3), mate, i)
    rows = t.where(field(3).rlike(mate)).select(
        field(0).alias("chr1"), long_field(1).alias("start1"), long_field(2).alias("end1"),
        part(1).alias("chr2"), as_long(part(2)).alias("start2"), as_long(part(3)).alias("end2"),
        as_double(part(4)).alias("score"), field(4).alias("name"), field(5).alias("color"),
    )
    same = F.col("chr1") == F.col("chr2")
    return rows.withColumns(
        {
            "chr": F.col("chr1"),
            "start": F.when(same, F.least("start1", "start2")).otherwise(F.col("start1")),
            "end": F.when(same, F.greatest("end1", "end2")).otherwise(F.col("end1")),
        }
    )


def p_value(text: Column) -> Column:
    """A p value; exponents below the double range give the smallest double."""
    exponent = F.regexp_extract(text, r"[eE]([+-]?\d+)\s*$", 1).try_cast("int")
    return F.when(exponent < SMALLEST_EXPONENT, F.lit(SMALLEST_DOUBLE)).otherwise(as_double(text))


def _association(lines: DataFrame, header: Header, keep: dict[str, Column], value: str) -> DataFrame:
    at = header.at
    t = lines.where((F.col("value") != header.line) & ~F.col("value").startswith("#")).withColumn("t", F.split("value", "\t"))
    pos = field(at["pos"])
    good = (F.size("t") == header.size) & (pos != "") & ~pos.contains(";") & ~pos.rlike(".x")
    start = as_long(pos) - 1
    return t.where(good).select(
        field(at["chr"]).alias("chr"), start.alias("start"), (start + 1).alias("end"), p_value(field(at["p"])).alias(value),
        *[c.alias(n) for n, c in keep.items()], named_fields(header).alias("attributes"),
    )


def _gwas_columns(columns: dict[str, int] | None) -> dict:
    if columns:
        return {"chr": ((), columns["chromosome"] - 1), "pos": ((), columns["position"] - 1), "p": ((), columns["value"] - 1)}
    return {"chr": (CHROM_NAMES[:3], 1), "pos": (POSITION_NAMES, 2), "p": (P_NAMES, 3)}


QTL_COLUMNS = {
    "chr": (CHROM_NAMES, None),
    "pos": (POSITION_NAMES, None),
    "p": (P_NAMES, None),
    "snp": (SNP_NAMES, None),
    "phenotype": (PHENOTYPE_NAMES, None),
}


def read_gwas(spark: SparkSession, path, columns: dict[str, int] | None = None) -> DataFrame:
    """Association rows of any number of files, each read by its own header."""
    lines, header = with_file_headers(spark, path, content_line(), _gwas_columns(columns))
    return _association(lines, header, {}, "value")


def parse_gwas(lines: DataFrame, header: Sequence[str], columns: dict[str, int] | None = None) -> DataFrame:
    """Association rows; columns are found by header name, or given 1-based.

    Rows with several positions, interactions (``x``) or no position are skipped.
    """
    return _association(lines, listed_header(header, _gwas_columns(columns)), {}, "value")


def _qtl(lines: DataFrame, header: Header) -> DataFrame:
    return _association(lines, header, {"snp": field(header.at["snp"]), "phenotype": field(header.at["phenotype"])}, "p_value")


def read_qtl(spark: SparkSession, path) -> DataFrame:
    """QTL rows of any number of files, each read by its own header."""
    return _qtl(*with_file_headers(spark, path, content_line(), QTL_COLUMNS))


def parse_qtl(lines: DataFrame, header: Sequence[str]) -> DataFrame:
    return _qtl(lines, listed_header(header, QTL_COLUMNS))


def parse_gtex_gwas(lines: DataFrame) -> DataFrame:
    t = content(lines).select(F.split("value", "\t").alias("t")).where((F.size("t") >= 7) & long_field(1).isNotNull())
    return t.select(
        field(0).alias("chr"), (long_field(1) - 1).alias("start"), long_field(2).alias("end"), field(3).alias("risk_allele"),
        field(4).alias("phenotype"), field(5).alias("p_value"), field(6).alias("effect"), field(7).alias("pubmed_id"),
    )


def read_matrix(spark: SparkSession, path) -> DataFrame:
    """Interval rows of any number of files; ``samples`` names the values by each file's own header (null without one)."""
    lines, header = with_file_headers(spark, path, F.col("value").rlike("(?i)^#?chr(om)?\t"))
    samples = F.when(header.line.isNotNull(), F.slice(header.names, 4, F.greatest(header.size - 3, F.lit(0))))
    rows = _matrix(lines.withColumn("samples", samples), F.coalesce(F.size("t") == F.size("samples") + 3, F.lit(True)))
    return rows.select("chr", "start", "end", "values", "samples")


def parse_matrix(lines: DataFrame, samples: Sequence[str] | None = None) -> DataFrame:
    """Interval rows with one value per sample; rows with another count are dropped.

    Without sample names every row with at least one value is kept.
    """
    good = F.lit(True) if samples is None else F.size("t") == len(samples) + 3
    return _matrix(lines, good).select("chr", "start", "end", "values")


def _matrix(lines: DataFrame, good: Column) -> DataFrame:
    t = content(lines).withColumn("t", F.split(F.trim("value"), r"\s+")).where((F.size("t") > 3) & long_field(1).isNotNull() & good)
    values = F.transform(F.slice("t", 4, F.size("t")), as_double)
    return t.withColumns({"chr": field(0), "start": long_field(1), "end": long_field(2), "values": values})


def melt_matrix(matrix: DataFrame, samples: Sequence[str] | None = None) -> DataFrame:
    """One row per interval and sample; names follow the header order, by default that of each row's own file."""
    names = F.col("samples") if samples is None else F.array(*[F.lit(s) for s in samples])
    kept = ["chr", "start", "end", *(["samples"] if samples is None else [])]
    return matrix.select(*kept, F.posexplode("values").alias("i", "value")).select(
        "chr", "start", "end", F.get(names, F.col("i")).alias("sample"), "value"
    )


def parse_fusion(lines: DataFrame) -> DataFrame:
    """Junctions with spanning fragments; the extent covers the junction and all fragments."""
    t = content(lines).select(F.split("value", "\t").alias("t")).where((F.size("t") >= 7) & long_field(2).isNotNull())
    pairs = F.transform(
        F.split(field(6), ","),
        lambda p: F.struct(
            as_long(F.split_part(p, F.lit("-"), F.lit(1))).alias("left"), as_long(F.split_part(p, F.lit("-"), F.lit(2))).alias("right")
        ),
    )
    rows = t.select(
        field(0).alias("chr"), field(1).alias("name"), long_field(2).alias("junction_left"), long_field(3).alias("junction_right"),
        long_field(4).alias("num_junction_reads"), long_field(5).alias("num_spanning_frags"),
        F.when(long_field(5) > 0, pairs).otherwise(F.slice(pairs, 1, 0)).alias("spans"),
    )
    edge = lambda f, k: f(F.transform("spans", lambda s: s[k]))
    return rows.withColumns(
        {
            "start": F.least("junction_left", edge(F.array_min, "left")),
            "end": F.greatest("junction_right", edge(F.array_max, "right")),
        }
    )


def parse_bp(lines: DataFrame) -> DataFrame:
    """RNA base-pair arcs.  ``lines`` is ordered; ``color:`` header lines give colour and label by rank.

    The header is a handful of lines per file; it is joined on (file, colour index).
    """
    from pyspark.sql import Window

    t = lines.where(F.trim("value") != "").withColumn("t", F.split("value", "\t"))
    is_color = F.col("value").startswith("color:")
    rank = F.row_number().over(Window.partitionBy("file").orderBy("part", "line")) - 1
    colors = t.where(is_color).select(
        "file", rank.cast("long").alias("score"),
        F.concat(F.lit("rgb("), F.concat_ws(",", field(1), field(2), field(3)), F.lit(")")).alias("color"),
        field(4).alias("description"),
    )
    p = [long_field(1) - 1, long_field(2) - 1, long_field(3), long_field(4)]
    arcs = t.where(~is_color).select("file", field(0).alias("chr"), *[c.alias(f"p{i}") for i, c in enumerate(p)], long_field(5).alias("score"))
    first = (F.least("p0", "p1"), F.greatest("p0", "p1"))
    second = (F.least("p2", "p3"), F.greatest("p2", "p3"))
    forward = F.col("p0") <= F.col("p3")
    shaped = arcs.select(
        "file", "chr", "score",
        F.when(forward, first[0]).otherwise(second[0]).alias("start_left"),
        F.when(forward, first[1]).otherwise(second[1]).alias("start_right"),
        F.when(forward, second[0]).otherwise(first[0]).alias("end_left"),
        F.when(forward, second[1]).otherwise(first[1]).alias("end_right"),
    )
    out = shaped.join(colors, ["file", "score"], "left").drop("file")
    return out.withColumns({"start": F.col("start_left"), "end": F.col("end_right")})


def sort_by_score(df: DataFrame) -> DataFrame:
    """Ascending by score, rows without one first."""
    return df.orderBy(F.col("score").asc_nulls_first())


def parse_chrom_sizes(lines: DataFrame) -> DataFrame:
    """Contig lengths with their rank in the file; ``lines`` is ordered."""
    from pyspark.sql import Window

    t = lines.withColumn("t", F.split("value", "\t")).where(F.size("t") > 1)
    rank = F.row_number().over(Window.partitionBy("file").orderBy("part", "line")) - 1
    return t.select(field(0).alias("chr"), rank.cast("long").alias("ord"), long_field(1).alias("length"))


def parse_chrom_alias(lines: DataFrame) -> DataFrame:
    """Alias records: one array of names per contig."""
    return lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).select(
        F.filter(F.split("value", "\t"), lambda x: x != "").alias("names")
    )


def parse_cytobands(lines: DataFrame) -> DataFrame:
    t = lines.select(F.split("value", "\t").alias("t")).where(F.size("t") == 5)
    return t.select(field(0).alias("chr"), long_field(1).alias("start"), long_field(2).alias("end"), field(3).alias("name"), field(4).alias("stain"))


# Column lists of well-known table dumps.
FORMATS: dict[str, list[str]] = {
    "gwascatalog": [
        "bin", "chr", "start", "end", "name", "pubMedID", "author", "pubDate", "journal", "title", "trait",
        "initSample", "replSample", "region", "genes", "riskAllele", "riskAlFreq", "pValue", "pValueDesc", "orOrBeta",
        "ci95", "platform", "cnv",
    ],
    "wgrna": [
        "bin", "chr", "start", "end", "name", "score", "strand", "thickStart", "thickEnd", "type",
    ],
    "cpgislandext": [
        "bin", "chr", "start", "end", "name", "length", "cpgNum", "gcNum", "perCpg", "perGc", "obsExp",
    ],
    "clinVarMain": [
        "chr1", "start", "end", "name", "score", "strand", "thickStart", "thickEnd", "reserved", "blockCount",
        "blockSizes", "chromStarts", "origName", "clinSign", "reviewStatus", "type", "geneId", "molConseq", "snpId",
        "nsvId", "rcvAcc", "testedInGtr", "phenotypeList", "phenotype", "origin", "assembly", "cytogenetic",
        "hgvsCod", "hgvsProt", "numSubmit", "lastEval", "guidelines", "otherIds",
    ],
}


def register_format(name: str, fields: Sequence[str]) -> None:
    FORMATS[name] = list(fields)


def parse_custom(lines: DataFrame, fields: Sequence[str] | str, coords: int = 0, sep: str = "\t") -> DataFrame:
    """Rows of a user-defined column list; ``chr`` and ``start`` are required.

    Without an ``end`` column the feature is one base long.  ``coords=1`` is for
    1-based starts.  All other columns stay text.
    """
    names = FORMATS[fields] if isinstance(fields, str) else list(fields)
    t = content(lines).select(F.split("value", sep).alias("t")).where(F.size("t") >= len(names))
    chrom = "chr" if "chr" in names else "chr1"
    start = long_field(names.index("start")) - coords
    end = long_field(names.index("end")) if "end" in names else start + 1
    others = [field(i).alias(n) for i, n in enumerate(names) if n not in (chrom, "start", "end")]
    return t.select(field(names.index(chrom)).alias("chr"), start.alias("start"), end.alias("end"), *others)


def read_sharded(spark: SparkSession, template: str, shards: dict[str, str] | Sequence[str], reader: Callable[[SparkSession, object], DataFrame], only: Sequence[str] | None = None) -> DataFrame:
    """One file per chromosome; only the files of the asked chromosomes are opened.

    ``shards`` is a list of chromosomes put into ``$CHR`` of the template, or a
    mapping from chromosome to path.
    """
    paths = shards if isinstance(shards, dict) else {c: template.replace("$CHR", c) for c in shards}
    wanted = [p for c, p in paths.items() if only is None or c in only]
    return reader(spark, wanted)


def parse_shard_list(lines: DataFrame) -> DataFrame:
    """Rows of a shard list: chromosome and path."""
    t = lines.where(F.trim("value") != "").select(blank_fields().alias("t"))
    return t.select(field(0).alias("chr"), field(1).alias("path"))


def from_rows(df: DataFrame, aliases: DataFrame | None = None, mappings: dict[str, str] | None = None) -> DataFrame:
    """In-memory features as a table: property names mapped, chromosome names made canonical."""
    from genospan.operators.genome import canonical_chr

    out = df.withColumnsRenamed(mappings) if mappings else df
    return canonical_chr(out, aliases) if aliases is not None else out


def decode_with(lines: DataFrame, decode: Callable, schema: str) -> DataFrame:
    """User line decoder: a function from an iterator of pandas frames with ``value`` to frames of ``schema``."""
    return lines.select("value").mapInPandas(decode, schema)


# User-supplied readers and table functions, by name.
READERS: dict[str, Callable[..., DataFrame]] = {}
COMPUTATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_reader(name: str, reader: Callable[..., DataFrame]) -> None:
    READERS[name] = reader


def read_with(name: str, *args, chr: str, start: int, end: int) -> DataFrame:
    """Features of a user's reader in one region.

    The reader gets the region as ``chr``, ``start`` and ``end``; it may return more than that.
    """
    got = READERS[name](*args, chr=chr, start=start, end=end)
    return got.where((F.col("chr") == chr) & (F.col("end") >= start) & (F.col("start") <= end))


def parse_service_response(answers: DataFrame, schema: str, names: dict[str, str] | None = None) -> DataFrame:
    """Features of JSON answers, each a list in ``value``; properties of ``schema`` are renamed by ``names``.

    An answer that is no list of objects gives nothing.
    """
    listed = answers.select(F.inline(F.from_json("value", f"array<struct<{schema.replace(' ', ': ').replace(',:', ',')}>>")))
    return listed.withColumnsRenamed(names or {})


def register_computation(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    COMPUTATIONS[name] = fn


def compute(name: str, df: DataFrame) -> DataFrame:
    return COMPUTATIONS[name](df)
