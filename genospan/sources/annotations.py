"""BED family, peaks, signal text, gene tables, PSL, repeat and SNP tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genospan.sources.lines import (
    ORDER,
    as_double,
    as_long,
    blank_fields,
    bound,
    content,
    double_field,
    field,
    fill_directives,
    long_field,
    number_within,
    once,
    ordered_lines,
    read_lines,
)

# Names of the nine columns that follow the first nine of a bedMethyl row.
BEDMETHYL_COLUMNS = [
    "coverage", "percent_methylated", "n_mod", "n_canonical", "n_other_mod", "n_delete", "n_fail", "n_diff", "n_nocall",
]
# Columns of the UCSC SNP table after the first six.
SNP_COLUMNS = [
    "strand", "refNCBI", "refUCSC", "observed", "molType", "class", "valid", "avHet", "avHetSE", "func", "locType", "weight",
    "exceptions", "submitterCount", "submitters", "alleleFreqCount", "alleles", "alleleNs", "alleleFreqs", "bitfields",
]


def numbers(text: Column) -> Column:
    """Comma-separated whole numbers; a trailing comma is ignored."""
    return F.transform(F.split(F.regexp_replace(text, ",$", ""), ","), as_long)


def with_cds(exons: Column, cds_start: Column, cds_end: Column) -> Column:
    """Exons marked as UTR when outside the coding range; otherwise cut coding ends are kept."""

    def one(e: Column) -> Column:
        utr = F.coalesce((e["end"] < cds_start) | (e["start"] > cds_end), F.lit(False))
        inside = lambda p: ~utr & (p >= e["start"]) & (p <= e["end"])
        return F.struct(
            e["start"].alias("start"),
            e["end"].alias("end"),
            F.when(inside(cds_start), cds_start).alias("cds_start"),
            F.when(inside(cds_end), cds_end).alias("cds_end"),
            utr.alias("utr"),
        )

    return F.transform(exons, one)


def attributes_of(text: Column) -> Column:
    """``k=v;k=v`` to a map; pairs without a key or a value are dropped."""
    entries = F.transform(pairs_of(text, "="), lambda p: F.struct(F.trim(p[0]), F.trim(p[1])))
    return F.map_from_entries(last_of_key(entries))


def pairs_of(text: Column, delim: str) -> Column:
    """Key and value, cut at the first ``delim``, of every part between semicolons that has both."""
    cut = F.transform(F.split(text, ";"), lambda x: F.split(F.trim(x), delim, 2))
    return F.filter(cut, lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) != "") & (F.get(p, F.lit(1)) != ""))


def last_of_key(entries: Column) -> Column:
    """Entries without earlier duplicates of a key, so that a map can be built."""

    def last(items: Column) -> Column:
        later = lambda i: F.slice(items, i + 2, F.greatest(F.size(items), F.lit(1)))
        kept = F.filter(items, lambda e, i: ~F.exists(later(i), lambda x: x["col1"] == e["col1"]))
        # Most rows repeat no key.
        single = F.size(F.array_distinct(F.transform(items, lambda e: e["col1"]))) == F.size(items)
        return F.when(single, items).otherwise(kept)

    return bound(entries, last)


def read_bed(spark: SparkSession, path, **options) -> DataFrame:
    return parse_bed(read_lines(spark, path), **options)


def parse_bed(lines: DataFrame, max_columns: int = 12, keep_fields: bool = False) -> DataFrame:
    """BED3 to BED12, split on white space.

    ``.`` as a name gives the empty name; a name in ``k=v;`` form also fills
    ``attributes``.  The default score is 1000.  A field that cannot be read ends
    the row: what comes after it stays NULL.  Exons need matching counts.
    """
    t = content(lines).select(once(blank_fields()).alias("t"))
    n = F.size("t")
    has = lambda i: (n > i) & F.lit(max_columns > i)
    raw_name, raw_score = field(3), field(4)
    score = F.when(raw_score == ".", F.lit(0.0)).otherwise(as_double(raw_score))
    score_ok = ~has(4) | score.isNotNull()
    strand_ok = score_ok & (~has(5) | field(5).isin(".", "+", "-"))
    cds_start, cds_end = long_field(6), long_field(7)
    start_ok = strand_ok & (~has(6) | cds_start.isNotNull())
    end_ok = start_ok & (~has(7) | cds_end.isNotNull())
    sizes, offsets = numbers(field(10)), numbers(field(11))
    blocks_ok = (
        end_ok & has(11) & (n > 11)
        & (F.size(sizes) == F.size(offsets)) & (F.size(sizes) == long_field(9))
    )
    looks_like_attributes = raw_name.rlike("^[^;]+;") & raw_name.rlike("^[^=]+=")
    rows = t.select(
        field(0).alias("chr"),
        long_field(1).alias("start"),
        long_field(2).alias("end"),
        F.when(has(3), F.when(raw_name == ".", "").otherwise(raw_name)).alias("name"),
        F.when(~has(4), F.lit(1000.0)).otherwise(score).alias("score"),
        F.when(has(4), score).alias("value"),
        F.when(score_ok & has(5), field(5)).alias("strand"),
        F.when(strand_ok & has(6), cds_start).alias("cds_start"),
        F.when(start_ok & has(7), cds_end).alias("cds_end"),
        F.when(end_ok & has(8) & ~field(8).isin(".", "0"), field(8)).alias("color"),
        F.when(has(3) & looks_like_attributes, attributes_of(raw_name)).alias("attributes"),
        F.when(
            blocks_ok,
            F.zip_with(
                offsets, sizes,
                lambda o, s: F.struct((long_field(1) + o).alias("start"), (long_field(1) + o + s).alias("end")),
            ),
        ).alias("blocks"),
        "t",
    ).where((n >= 3) & F.col("start").isNotNull() & F.col("end").isNotNull())
    done = rows.withColumn("exons", with_cds(F.col("blocks"), F.col("cds_start"), F.col("cds_end"))).drop("blocks")
    return done if keep_fields else done.drop("t")


def parse_gapped_peak(lines: DataFrame) -> DataFrame:
    """BED12 with signal, p and q values in columns 13 to 15."""
    rows = parse_bed(lines, keep_fields=True)
    return rows.withColumns({"signal": double_field(12), "p_value": double_field(13), "q_value": double_field(14)}).drop("t")


def read_peaks(spark: SparkSession, path) -> DataFrame:
    return parse_peaks(read_lines(spark, path))


def parse_peaks(lines: DataFrame) -> DataFrame:
    """Broad, region and narrow peaks; rows need nine columns, a score of 0 becomes the signal."""
    t = content(lines).select(blank_fields().alias("t")).where(F.size("t") >= 9)
    score = double_field(4)
    return t.select(
        field(0).alias("chr"),
        long_field(1).alias("start"),
        long_field(2).alias("end"),
        field(3).alias("name"),
        F.when(score == 0, double_field(6)).otherwise(score).alias("score"),
        field(5).alias("strand"),
        double_field(6).alias("signal"),
        double_field(7).alias("p_value"),
        double_field(8).alias("q_value"),
        double_field(9).alias("peak"),
    )


def read_bedmethyl(spark: SparkSession, path) -> DataFrame:
    return parse_bedmethyl(read_lines(spark, path))


def parse_bedmethyl(lines: DataFrame) -> DataFrame:
    """Nine BED columns, then named methylation columns as text."""
    t = content(lines).select(blank_fields().alias("t")).where(F.size("t") >= 3)
    return t.select(
        field(0).alias("chr"),
        long_field(1).alias("start"),
        long_field(2).alias("end"),
        field(3).alias("name"),
        double_field(4).alias("score"),
        field(5).alias("strand"),
        *[field(9 + i).alias(c) for i, c in enumerate(BEDMETHYL_COLUMNS)],
    ).where(F.col("start").isNotNull() & F.col("end").isNotNull())


def read_bedgraph(spark: SparkSession, path) -> DataFrame:
    return parse_bedgraph(read_lines(spark, path))


def parse_bedgraph(lines: DataFrame) -> DataFrame:
    t = content(lines).select(blank_fields().alias("t")).where(F.size("t") > 3)
    return t.select(field(0).alias("chr"), long_field(1).alias("start"), long_field(2).alias("end"), double_field(3).alias("value"))


def read_wig(spark: SparkSession, path) -> DataFrame:
    return parse_wig(ordered_lines(spark, path))


def parse_wig(lines: DataFrame) -> DataFrame:
    """fixedStep and variableStep signal, and bedGraph rows where no directive applies.

    ``lines`` is an ordered line table.  A directive holds for the lines below it.
    Positions in the file are 1-based.  A value that is not a number gives no row
    but still takes its place in a fixedStep run.
    """
    v = F.trim("value")
    is_directive = v.startswith("fixedStep") | v.startswith("variableStep")
    body = lines.where((v != "") & ~v.startswith("#") & ~v.startswith("browser"))
    # A track line ends the reach of a directive.
    resets = v.startswith("track")

    def option(name: str, default: str) -> Column:
        got = F.regexp_extract(v, rf"(?:^|\s){name}=(\S+)", 1)
        return F.when(got == "", F.lit(default)).otherwise(got)

    directive = F.struct(
        F.when(v.startswith("fixedStep"), "fixed").when(v.startswith("variableStep"), "variable").otherwise("none").alias("kind"),
        option("chrom", "").alias("chrom"),
        as_long(option("start", "1")).alias("start"),
        as_long(option("step", "1")).alias("step"),
        as_long(option("span", "1")).alias("span"),
        F.col("part").alias("part"),
        F.col("line").alias("line"),
    )
    filled = fill_directives(body, F.when(is_directive | resets, directive), "d").where(~is_directive & ~resets)
    filled = filled.withColumn("t", F.split(v, r"\s+"))
    other = filled.where(~F.coalesce(F.col("d.kind") == "fixed", F.lit(False)))
    variable = other.where((F.col("d.kind") == "variable") & (F.size("t") >= 2)).select(
        F.col("d.chrom").alias("chr"),
        (long_field(0) - 1).alias("start"),
        (long_field(0) - 1 + F.col("d.span")).alias("end"),
        double_field(1).alias("value"),
    )
    bare = other.where(F.coalesce(F.col("d.kind") == "none", F.lit(True)) & (F.size("t") > 3)).select(
        field(0).alias("chr"), long_field(1).alias("start"), long_field(2).alias("end"), double_field(3).alias("value")
    )
    fixed = filled.where(F.col("d.kind") == "fixed").select("file", *ORDER, "t", F.struct("d.part", "d.line").alias("run"), "d")
    numbered = number_within(fixed.withColumn("one", F.lit(1)), ["file", "run"], F.col("one"), "nth")
    at = F.col("d.start") - 1 + (F.col("nth") - 1) * F.col("d.step")
    stepped = numbered.select(
        F.col("d.chrom").alias("chr"), at.alias("start"), (at + F.col("d.span")).alias("end"), double_field(0).alias("value")
    )
    rows = stepped.unionByName(variable).unionByName(bare)
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _gene_table(lines: DataFrame, columns: dict[str, int], exon_columns: tuple[int, int, int], minimum: int, frames: int | None) -> DataFrame:
    t = content(lines).select(F.split("value", "\t").alias("t")).where(F.size("t") > minimum)
    count, starts, ends = exon_columns
    n = long_field(count).cast("int")
    s, e = numbers(field(starts)), numbers(field(ends))
    raw = F.slice(F.arrays_zip(s.alias("start"), e.alias("end")), 1, n)
    base = t.select(
        field(columns["name"]).alias("name"),
        field(columns["id"]).alias("id"),
        field(columns["chr"]).alias("chr"),
        field(columns["strand"]).alias("strand"),
        *[long_field(columns[c]).alias(c) for c in ("start", "end", "cds_start", "cds_end")],
        raw.alias("raw"),
        (numbers(field(frames)) if frames else F.lit(None).cast("array<bigint>")).alias("frames"),
    )
    marked = base.withColumn("exons", with_cds(F.col("raw"), F.col("cds_start"), F.col("cds_end")))
    framed = F.transform(
        "exons",
        lambda x, i: x.withField("reading_frame", F.nullif(F.get("frames", i), F.lit(-1).cast("long"))),
    )
    return marked.withColumn("exons", framed).drop("raw", "frames")


def read_genepred(spark: SparkSession, path, kind: str = "genePred") -> DataFrame:
    return parse_genepred(read_lines(spark, path), kind)


def parse_genepred(lines: DataFrame, kind: str = "genePred") -> DataFrame:
    """UCSC gene tables: ``genePred``, ``genePredExt``, ``refGene`` / ``ensGene`` (with a bin column), ``refFlat``."""
    k = 1 if kind.lower() in ("refgene", "ensgene") else 0
    if kind == "refFlat":
        cols = {"name": 0, "id": 1, "chr": 2, "strand": 3, "start": 4, "end": 5, "cds_start": 6, "cds_end": 7}
        return _gene_table(lines, cols, (8, 9, 10), 10, None)
    cols = {"id": k, "name": k, "chr": 1 + k, "strand": 2 + k, "start": 3 + k, "end": 4 + k, "cds_start": 5 + k, "cds_end": 6 + k}
    exons = (7 + k, 8 + k, 9 + k)
    if kind == "genePred":
        return _gene_table(lines, cols, exons, 9, None)
    return _gene_table(lines, cols | {"name": 11 + k}, exons, 11 + k, 14 + k)


def read_psl(spark: SparkSession, path) -> DataFrame:
    return parse_psl(read_lines(spark, path))


def parse_psl(lines: DataFrame) -> DataFrame:
    """Sequence alignments of 21 columns; score is per mille of the query that matches net of errors and gaps."""
    t = content(lines).select(blank_fields().alias("t")).where((F.size("t") >= 21) & long_field(0).isNotNull())
    q_size = long_field(10)
    net = long_field(0) + long_field(2) - long_field(1) - long_field(4) - long_field(6)
    sizes, starts = numbers(field(18)), numbers(field(20))
    exons = F.slice(
        F.zip_with(starts, sizes, lambda s, n: F.struct(s.alias("start"), (s + n).alias("end"))), 1, long_field(17).cast("int")
    )
    return t.select(
        field(13).alias("chr"),
        long_field(15).alias("start"),
        long_field(16).alias("end"),
        F.substring(field(8), 1, 1).alias("strand"),
        field(9).alias("name"),
        F.floor(F.try_divide(1000 * net, q_size)).alias("score"),
        *[
            long_field(i).alias(c)
            for i, c in enumerate(["matches", "mismatches", "rep_matches", "n_count", "q_num_insert", "q_base_insert", "t_num_insert", "t_base_insert"])
        ],
        q_size.alias("q_size"),
        exons.alias("exons"),
    )


def read_rmsk(spark: SparkSession, path) -> DataFrame:
    return parse_rmsk(read_lines(spark, path))


def parse_rmsk(lines: DataFrame) -> DataFrame:
    """Repeat table dump, more than 15 tab-separated columns."""
    t = content(lines).select(F.split("value", "\t").alias("t")).where(F.size("t") > 15)
    ints = {"sw_score": 1, "milli_div": 2, "milli_del": 3, "milli_ins": 4, "start": 6, "end": 7, "rep_start": 13, "rep_end": 14, "rep_left": 15}
    texts = {"chr": 5, "strand": 9, "rep_name": 10, "rep_class": 11, "rep_family": 12}
    return t.select(*[field(i).alias(c) for c, i in texts.items()], *[long_field(i).alias(c) for c, i in ints.items()])


def read_snp(spark: SparkSession, path) -> DataFrame:
    return parse_snp(read_lines(spark, path))


def parse_snp(lines: DataFrame) -> DataFrame:
    t = content(lines).select(F.split("value", "\t").alias("t")).where(F.size("t") >= 6)
    return t.select(
        field(1).alias("chr"), long_field(2).alias("start"), long_field(3).alias("end"), field(4).alias("name"),
        long_field(5).alias("score"), *[field(6 + i).alias(c) for i, c in enumerate(SNP_COLUMNS)],
    )


# Percent escapes that GFF3 allows.
GFF_ESCAPES = {"%09": "\t", "%0A": "\n", "%0D": "\r", "%3B": ";", "%3D": "=", "%26": "&", "%2C": ",", "%25": "%"}


def percent_decode(text: Column) -> Column:
    """The eight permitted escapes, each decoded once; ``%25`` goes last."""
    out = text
    for code, char in GFF_ESCAPES.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.when(F.contains(text, F.lit("%")), out).otherwise(text)


def read_gff(spark: SparkSession, path, kind: str = "gff3") -> DataFrame:
    return parse_gff(read_lines(spark, path), kind)


def parse_gff(lines: DataFrame, kind: str = "gff3") -> DataFrame:
    """GFF3 or GTF rows with ``id``, ``parent``, reading frame and an attribute map.

    In GTF the identifier is ``gene_id`` for genes and ``transcript_id`` for
    transcripts; a transcript's parent is its gene, any other row's parent is its
    transcript.
    """
    gff3 = kind == "gff3"
    delim = "=" if gff3 else " "
    t = content(lines).select(once(F.split("value", "\t")).alias("t")).where(F.size("t") >= 9)

    def clean(x: Column) -> Column:
        text = percent_decode(F.trim(x))
        return text if gff3 else F.regexp_replace(text, '^"(.*)"$', "$1")

    entries = F.transform(pairs_of(field(8), delim), lambda p: F.struct(clean(p[0]).alias("col1"), clean(p[1]).alias("col2")))
    rows = t.select(
        field(0).alias("chr"),
        percent_decode(field(1)).alias("source"),
        field(2).alias("type"),
        (long_field(3) - 1).alias("start"),
        long_field(4).alias("end"),
        F.when(field(5) != ".", double_field(5)).alias("score"),
        field(6).alias("strand"),
        F.when(field(7) != ".", long_field(7).cast("int")).alias("phase"),
        entries.alias("e"),
    ).withColumn("attributes", F.map_from_entries(last_of_key(F.col("e")))).drop("e")
    att = lambda k: F.try_element_at("attributes", F.lit(k))
    if gff3:
        ident, parent = att("ID"), att("Parent")
    else:
        ident = F.when(F.col("type") == "gene", att("gene_id")).when(F.col("type") == "transcript", att("transcript_id"))
        parent = F.when(F.col("type") == "transcript", att("gene_id")).when(F.col("type") != "gene", att("transcript_id"))
    return rows.withColumns(
        {"id": ident, "parent": parent, "reading_frame": ((F.lit(3) - F.col("phase")) % 3).cast("int")}
    )
