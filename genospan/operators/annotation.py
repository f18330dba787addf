"""Gene models: assembly, numbering, name lookup, coding positions and HGVS."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospan.functions import locus as L
from genospan.functions.sequence import lookup
from genospan.scale import all_of, block_of, cut_lineage, islands, ordered_scan

# Row types of the transcript model.
TRANSCRIPT_TYPES = [
    "transcript", "primary_transcript", "processed_transcript", "mRNA", "mrna",
    "lnc_RNA", "miRNA", "ncRNA", "rRNA", "scRNA", "snRNA", "snoRNA", "tRNA",
]
CODING_TYPES = ["CDS", "cds", "start_codon", "stop_codon"]
UTR_TYPES = ["5UTR", "3UTR", "UTR", "five_prime_UTR", "three_prime_UTR", "3'-UTR", "5'-UTR"]
EXON_TYPES = ["exon", "coding-exon"]
NAME_FIELDS = ["Name", "transcript_id", "gene_name", "gene", "gene_id", "alias", "locus", "name"]
SEARCH_FIELDS = ["name", "transcript_id", "gene_id", "gene_name", "id"]


def is_transcript(t: str = "type") -> Column:
    c = F.col(t)
    return c.isin(TRANSCRIPT_TYPES) | c.endswith("RNA") | c.endswith("transcript")


def is_intron(t: str = "type") -> Column:
    return F.col(t).contains("intron")


def is_part(t: str = "type") -> Column:
    return F.col(t).isin(CODING_TYPES + UTR_TYPES + EXON_TYPES) | is_intron(t)


def gff_type_filter(rows: DataFrame, types: Sequence[str] = ("chromosome",)) -> DataFrame:
    return rows.where(~F.col("type").isin(list(types)))


def combine_by_id(rows: DataFrame) -> DataFrame:
    """Rows outside the transcript model with one ID on one chromosome become one row.

    The parts are kept as ``exons``; the first row by (start, end) lends the other
    columns.  Rows of the model, and rows without an ID, pass through.
    """
    model = is_part() | is_transcript() | F.col("id").isNull()
    apart = rows.where(~model)
    rest = [c for c in rows.columns if c not in ("chr", "id", "start", "end")]
    order = F.struct("start", "end")
    merged = apart.groupBy("chr", "id").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        *[F.min_by(c, order).alias(c) for c in rest],
        F.array_sort(F.collect_list(order)).alias("__x"),
    )
    merged = merged.withColumn("exons", F.when(F.size("__x") > 1, F.col("__x"))).drop("__x")
    return rows.where(model).unionByName(merged, allowMissingColumns=True)


def exon_table(rows: DataFrame, kind: str = "gff3") -> DataFrame:
    """Exons of every transcript: ``tid, chr, strand, start, end, cds_start, cds_end, utr, reading_frame``.

    Exon rows come first; coding and UTR parts that no exon contains are merged
    into exons of their own.  Coding parts set the coding range of the exon that
    contains them, UTR parts mark the exon or cut its coding range.  One row with
    several parents counts for each of them.  Everything is joins and grouped
    aggregates on (transcript, exon), so a gene of any size is never gathered.
    """
    parts = rows.where(is_part() & F.col("parent").isNotNull()).select(
        F.explode(F.split(F.trim("parent"), ",")).alias("tid"), "chr", "strand", "type", "start", "end", "reading_frame"
    )
    if kind == "gff3":
        known = rows.where(is_transcript() & F.col("id").isNotNull()).select(F.col("id").alias("tid")).distinct()
        parts = parts.join(known, "tid", "left_semi")
    # The parts are read by several branches below, so they are written once.
    parts = cut_lineage(parts)
    key = ["tid", "chr", "strand"]
    exons = parts.where(F.col("type").isin(EXON_TYPES)).select(*key, "start", "end").distinct()
    bits = parts.where(F.col("type").isin(CODING_TYPES + UTR_TYPES))
    merged = cut_lineage(islands(bits, key).select(*key, "start", "end"))
    covered = (
        merged.alias("m")
        .join(exons.alias("e"), key)
        .where((F.col("e.start") <= F.col("m.start")) & (F.col("e.end") >= F.col("m.end")))
        .select(*key, F.col("m.start").alias("start"), F.col("m.end").alias("end"))
        .distinct()
    )
    made = merged.join(covered, [*key, "start", "end"], "left_anti")
    every = exons.withColumn("made", F.lit(False)).unionByName(made.withColumn("made", F.lit(True)))

    p = bits.select(*key, "type", F.col("start").alias("ps"), F.col("end").alias("pe"), "reading_frame")
    inside = every.join(p, key, "left").where(
        F.col("ps").isNull() | ((F.col("start") <= F.col("ps")) & (F.col("end") >= F.col("pe")))
    )
    lone = every.join(inside.select(*key, "start", "end").distinct(), [*key, "start", "end"], "left_anti")
    inside = inside.unionByName(lone, allowMissingColumns=True)
    coding, utr = F.col("type").isin(CODING_TYPES), F.col("type").isin(UTR_TYPES)
    first = F.when(F.col("strand") == "+", F.col("ps")).otherwise(-F.col("ps"))
    tagged = cut_lineage(inside.groupBy(*key, "start", "end", "made").agg(
        F.min(F.when(coding, F.col("ps"))).alias("c1"),
        F.max(F.when(coding, F.col("pe"))).alias("c2"),
        F.max(F.when(utr & (F.col("ps") == F.col("start")) & (F.col("pe") == F.col("end")), True)).alias("whole_utr"),
        F.max(F.when(utr & (F.col("pe") < F.col("end")), F.col("pe"))).alias("u_left"),
        F.min(F.when(utr & (F.col("ps") > F.col("start")), F.col("ps"))).alias("u_right"),
        F.min_by(F.when(coding, F.col("reading_frame")), F.when(coding & F.col("reading_frame").isNotNull(), first)).alias("reading_frame"),
    ))
    # A UTR may cut the coding end only where no coding part reaches farther.
    cds_start = F.coalesce("u_left", "c1")
    cds_end = F.when(F.col("c2").isNull() | (F.col("u_right") > F.col("c2")), F.coalesce("u_right", "c2")).otherwise(F.col("c2"))
    range_ = tagged.groupBy("tid", "chr").agg(F.min("c1").alias("t1"), F.max("c2").alias("t2"))
    outside = (F.col("end") < F.col("t1")) | (F.col("start") > F.col("t2"))
    return tagged.join(range_, ["tid", "chr"]).select(
        *key, "start", "end",
        cds_start.alias("cds_start"), cds_end.alias("cds_end"),
        F.coalesce(F.col("whole_utr") | F.coalesce(outside, F.lit(False)), F.coalesce(outside, F.lit(False))).alias("utr"),
        "reading_frame", "made",
        F.col("t1").alias("tx_cds_start"), F.col("t2").alias("tx_cds_end"),
    )


def assemble_transcripts(rows: DataFrame, kind: str = "gff3") -> DataFrame:
    """Transcripts with ordered, numbered exons and the ID of their gene.

    In GTF a transcript without a row of its own is made from its parts.
    """
    rows = gff_type_filter(rows)
    exons = exon_table(rows, kind)
    key = ["tid", "chr", "strand"]
    item = F.struct("start", "end", "cds_start", "cds_end", "utr", "reading_frame", "made")
    gathered = exons.groupBy(*key).agg(
        F.min("start").alias("x_start"),
        F.max("end").alias("x_end"),
        F.max("tx_cds_start").alias("cds_start"),
        F.max("tx_cds_end").alias("cds_end"),
        F.array_sort(F.collect_list(item)).alias("exons"),
    )
    gathered = gathered.withColumn("exons", exon_number("exons", F.col("strand")))
    stated = rows.where(is_transcript() & F.col("id").isNotNull()).select(
        F.col("id").alias("tid"), "chr", "strand", "start", "end", "type", F.col("parent").alias("gene_id"), "attributes"
    )
    joined = stated.join(gathered, key, "left" if kind == "gff3" else "full_outer")
    out = joined.select(
        F.col("tid").alias("id"), "chr", "strand",
        F.least("start", "x_start").alias("start"), F.greatest("end", "x_end").alias("end"),
        F.coalesce("type", F.lit("transcript")).alias("type"), "gene_id", "cds_start", "cds_end", "exons",
        feature_name().alias("name"),
    )
    return out


def combine_features(rows: DataFrame, kind: str = "gff3") -> DataFrame:
    """All features of a GFF or GTF table: assembled transcripts and everything they did not use.

    A gene with a transcript, and a part with a known transcript, are used up.
    Rows of one ID outside the model are combined first (GFF3); their pieces are
    in ``pieces``.
    """
    base = gff_type_filter(rows)
    if kind == "gff3":
        base = combine_by_id(base).withColumnRenamed("exons", "pieces")
    base = cut_lineage(base)
    transcripts = assemble_transcripts(base.drop("pieces"), kind)
    known = transcripts.select(F.col("id").alias("tid"))
    is_gene = (F.col("type") == "gene") | F.col("type").endswith("_gene")
    is_tx = is_transcript() & F.col("id").isNotNull()
    others = base.where(~is_tx)
    genes = others.where(is_gene)
    used = transcripts.where(F.col("gene_id").isNotNull()).select(F.col("gene_id").alias("id")).distinct()
    lone_genes = genes.join(used, "id", "left_anti")
    parts = others.where(~is_gene & is_part() & F.col("parent").isNotNull())
    place = ["chr", "start", "end", "type", "parent"]
    taken = parts.select(*place, F.explode(F.split(F.trim("parent"), ",")).alias("tid")).join(known, "tid", "left_semi")
    lone_parts = parts.join(taken.select(*place).distinct(), place, "left_anti")
    rest = others.where(~is_gene & ~(is_part() & F.col("parent").isNotNull()))
    left_over = rest.unionByName(lone_parts).unionByName(lone_genes.select(*rest.columns))
    named = left_over.withColumn("name", feature_name())
    keep = [c for c in ("id", "chr", "strand", "start", "end", "type", "name", "pieces") if c in named.columns]
    return transcripts.unionByName(named.select(*keep), allowMissingColumns=True)


def feature_name(fields: Sequence[str] = NAME_FIELDS, attributes: str = "attributes") -> Column:
    """The first attribute of the list that has a value."""
    return F.coalesce(*[F.nullif(F.try_element_at(attributes, F.lit(f)), F.lit("")) for f in fields])


def exon_number(exons: str, strand: Column) -> Column:
    """Number exons 1..n, counted from the right on the reverse strand."""
    n = F.size(exons)
    return F.transform(exons, lambda e, i: e.withField("number", F.when(strand == "-", n - i).otherwise(i + 1)))


def number_inside(exons: str, strand: Column, start: Column, end: Column, window: tuple[int, int]) -> Column:
    """Exon numbers only for features that lie inside the window."""
    inside = (end <= window[1]) & (start > window[0])
    bare = F.transform(exons, lambda e: e.withField("number", F.lit(None).cast("int")))
    return F.when(inside, exon_number(exons, strand)).otherwise(bare)


def name_index(features: DataFrame, fields: Sequence[str] = SEARCH_FIELDS, order: Sequence[str] = ()) -> DataFrame:
    """Search key to location; the longest feature wins, the later one among equals.

    ``fields`` are columns, or keys of ``attributes``.  ``order`` gives the file order.
    """
    has_map = "attributes" in features.columns
    values = [
        F.col(f) if f in features.columns else F.try_element_at("attributes", F.lit(f))
        for f in fields
        if f in features.columns or has_map
    ]
    keys = F.array_distinct(F.filter(F.array(*values), lambda v: F.coalesce(v != "", F.lit(False))))
    hits = features.select(F.explode(keys).alias("k"), "chr", "start", "end", *[c for c in order if c not in ("chr", "start", "end")])
    rank = F.struct((F.col("end") - F.col("start")).alias("len"), *order)
    best = hits.groupBy(L.search_key(F.col("k")).alias("key")).agg(F.max_by(F.struct("chr", "start", "end"), rank).alias("b"))
    return best.select("key", "b.chr", "b.start", "b.end")


def coding_start(e: Column) -> Column:
    return F.coalesce(e["cds_start"], e["start"])


def coding_end(e: Column) -> Column:
    return F.coalesce(e["cds_end"], e["end"])


def coding_length(e: Column) -> Column:
    return F.when(F.coalesce(e["utr"], F.lit(False)), F.lit(0).cast("long")).otherwise(coding_end(e) - coding_start(e))


def exon_phase(e: Column) -> Column:
    return (F.lit(3) - e["reading_frame"]) % 3


def total_coding_length(exons: str = "exons") -> Column:
    return F.aggregate(exons, F.lit(0).cast("long"), lambda a, e: a + coding_length(e))


def _in_reading_order(exons: str, strand: str) -> Column:
    return F.when(F.col(strand) == "+", F.col(exons)).otherwise(F.reverse(F.col(exons)))


def _walk(exons: str, strand: str, n: Column, length, left, right) -> Column:
    """Genomic position of the n-th base (1-based) along the given stretches; NULL past the end."""
    forward = F.col(strand) == "+"
    start = F.struct(F.lit(0).cast("long").alias("done"), F.lit(None).cast("long").alias("pos"))

    def step(acc: Column, e: Column) -> Column:
        size = length(e)
        inside = acc["pos"].isNull() & (acc["done"] + size >= n) & (size > 0)
        offset = n - acc["done"] - 1
        here = F.when(forward, left(e) + offset).otherwise(right(e) - 1 - offset)
        return F.struct((acc["done"] + size).alias("done"), F.when(inside, here).otherwise(acc["pos"]).alias("pos"))

    return F.aggregate(_in_reading_order(exons, strand), start, step, lambda acc: acc["pos"])


def coding_to_genomic(n: Column, exons: str = "exons", strand: str = "strand") -> Column:
    """0-based genomic position of a 1-based coding position."""
    return F.when(n >= 1, _walk(exons, strand, n, coding_length, coding_start, coding_end))


def transcript_to_genomic(n: Column, exons: str = "exons", strand: str = "strand") -> Column:
    """0-based genomic position of a 1-based transcript position; 0 and below lie before the start."""
    whole = lambda e: e["end"] - e["start"]
    before = F.when(F.col(strand) == "+", F.col("start") - F.abs(n)).otherwise(F.col("end") + F.abs(n))
    simple = F.when(F.col(strand) == "+", F.col("start") + n - 1).otherwise(F.col("end") - n + 1)
    inside = F.when(
        F.col(exons).isNull() | (F.size(exons) == 0), simple
    ).otherwise(_walk(exons, strand, n, whole, lambda e: e["start"], lambda e: e["end"]))
    return F.when(n <= 0, before).otherwise(inside)


def genomic_to_coding(pos: Column, exons: str = "exons", strand: str = "strand") -> Column:
    """0-based coding position of a genomic position inside an exon; NULL elsewhere."""
    forward = F.col(strand) == "+"
    start = F.struct(F.lit(0).cast("long").alias("done"), F.lit(None).cast("long").alias("hit"))

    def step(acc: Column, e: Column) -> Column:
        inside = acc["hit"].isNull() & (e["start"] <= pos) & (e["end"] > pos)
        delta = F.when(forward, pos - coding_start(e)).otherwise(coding_end(e) - pos - 1)
        return F.struct(
            (acc["done"] + coding_length(e)).alias("done"),
            F.when(inside, acc["done"] + delta).otherwise(acc["hit"]).alias("hit"),
        )

    return F.aggregate(_in_reading_order(exons, strand), start, step, lambda acc: acc["hit"])


def resolve_hgvs(terms: DataFrame, transcripts: DataFrame, aliases: DataFrame | None = None, column: str = "term") -> DataFrame:
    """Genomic extent of HGVS notations: a left join on the accession, then position arithmetic.

    ``transcripts`` has ``id, chr, strand, start, end, exons``.  Protein notation is
    recognised but gives no location.
    """
    parsed = terms.withColumn("h", L.hgvs_parse(F.col(column)))
    tx = transcripts.select(
        F.col("id").alias("__id"), F.col("chr").alias("t_chr"), "strand", "start", "end", "exons"
    )
    met = parsed.join(tx, F.col("h.accession") == F.col("__id"), "left")
    if aliases is not None:
        dim = aliases.select(F.col("alias").alias("__a"), F.col("canonical").alias("__c"))
        met = met.join(dim, F.col("h.accession") == F.col("__a"), "left")
    else:
        met = met.withColumn("__c", F.lit(None).cast("string"))
    kind, utr = F.col("h.type"), F.col("h.utr")
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    first = coding_to_genomic(F.lit(1).cast("long"))
    last = coding_to_genomic(total_coding_length())

    def place(k: int) -> Column:
        n = F.col(f"h.pos{k}")
        at = (
            F.when(kind == "n", transcript_to_genomic(n))
            .when(utr == "5", first - sign * n)
            .when(utr == "3", last + sign * n)
            .otherwise(coding_to_genomic(n))
        )
        return at + sign * F.col(f"h.offset{k}")

    placed = met.withColumns({"g1": place(1), "g2": place(2)})
    on_tx = kind.isin("c", "n")
    return placed.select(
        *terms.columns,
        F.when(kind == "g", F.coalesce("__c", F.col("h.accession"))).when(on_tx & F.col("g1").isNotNull() & F.col("g2").isNotNull(), F.col("t_chr")).alias("chr"),
        F.when(kind == "g", F.col("h.pos1") - 1).when(on_tx, F.least("g1", "g2") + F.col("g2") * 0).alias("start"),
        F.when(kind == "g", F.col("h.pos2")).when(on_tx, F.greatest("g1", "g2") + 1 + F.col("g2") * 0 + F.col("g1") * 0).alias("end"),
    )


COMPLEMENT = {"A": "T", "T": "A", "C": "G", "G": "C"}


def hgvs_annotate(pos: str = "pos", ref: str = "ref", alt: str = "alt", name: str = "name") -> Column:
    """Coding notation of a substitution on a transcript row, genomic notation without one.

    Inside an exon: the coding position, or the distance into the UTR.  Between
    exons: the nearest exon edge with a signed offset.
    """
    p, forward = F.col(pos), F.col("strand") == "+"
    flip = lambda c: F.when(forward, F.upper(c)).otherwise(F.coalesce(lookup(F.upper(c), COMPLEMENT), F.upper(c)))
    change = F.concat(flip(F.col(ref)), F.lit(">"), flip(F.col(alt)))
    text = lambda c: c.cast("string")
    in_exon = F.exists("exons", lambda e: (e["start"] <= p) & (p < e["end"]))
    coding = genomic_to_coding(p)
    first = coding_to_genomic(F.lit(1).cast("long"))
    last = coding_to_genomic(total_coding_length())
    sign = F.when(forward, 1).otherwise(-1)
    five = (p - first) * sign < 0
    three = (p - last) * sign >= 0
    body = F.when(coding >= 0, text(coding + 1)).when(
        first.isNotNull(),
        F.when(five, F.concat(F.lit("-"), text(F.abs(p - first)))).when(three, F.concat(F.lit("*"), text(F.abs(p - last) + 1))),
    )
    edges = F.flatten(
        F.transform(
            F.filter("exons", lambda e: coding_length(e) > 0),
            lambda e: F.array(
                F.struct(F.abs(p - e["start"]).alias("d"), e["start"].alias("edge"), coding_start(e).alias("at")),
                F.struct(F.abs(p - (e["end"] - 1)).alias("d"), (e["end"] - 1).alias("edge"), (coding_end(e) - 1).alias("at")),
            ),
        )
    )
    near = F.array_min(F.filter(edges, lambda x: x["d"] > 0))
    offset = (p - near["edge"]) * sign
    signed = F.when(offset >= 0, F.concat(F.lit("+"), text(offset))).otherwise(text(offset))
    between = F.concat(text(genomic_to_coding(near["at"]) + 1), signed)
    where = F.when(in_exon, body).otherwise(between)
    on_tx = F.concat(F.col(name), F.lit(":c."), where, change)
    genomic = F.concat(F.col("chr"), F.lit(":g."), text(p + 1), F.upper(ref), F.lit(">"), F.upper(alt))
    return F.when(F.col("exons").isNotNull(), F.coalesce(on_tx, change)).otherwise(genomic)


def transcript_at(points: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The first transcript (by start, then ID) that contains each point; both ends count."""
    inside = all_of([F.col(c).isNotNull() for c in ("chr", "start", "end", "id")]) & (F.col("start") <= F.col("end"))
    # Only a transcript that reaches beyond all before it is ever the first one at some point ...
    tx = transcripts.where(inside).groupBy("chr", "start", "end").agg(F.min("id").alias("id"))
    ranked = ordered_scan(tx, ["chr"], ["start", "id", "end"], block_of("start"), __reach=("max_before", F.col("end")))
    edge = ranked.where(F.col("__reach").isNull() | (F.col("end") > F.col("__reach")))
    hit = F.struct("start", "id", "end")
    edge = edge.select("chr", F.col("end").cast("double").alias("__at"), F.lit(1).alias("__side"), hit.alias("__hit"))
    # ... and the first of those that ends at a point or later is the answer, if it starts at the point or before.
    asked = points.where("chr is not null and pos is not null").select("chr", F.col("pos").cast("double").alias("__at")).distinct()
    both = edge.unionByName(asked.select("chr", "__at", F.lit(0).alias("__side"), F.lit(None).cast(edge.schema["__hit"].dataType).alias("__hit")))
    scanned = ordered_scan(both, ["chr"], ["__at", "__side"], block_of("__at"), reverse=True, __b=("last", F.col("__hit")))
    found = scanned.where((F.col("__side") == 0) & (F.col("__b.start") <= F.col("__at"))).select("chr", "__at", "__b")
    return points.withColumn("__at", F.col("pos").cast("double")).join(found, ["chr", "__at"], "left").select(
        *points.columns, F.col("__b.id").alias("transcript_id"), F.col("__b.start").alias("tx_start"), F.col("__b.end").alias("tx_end")
    )


def resolve_locus(terms: DataFrame, names: DataFrame, chromosomes: DataFrame, aliases: DataFrame, transcripts: DataFrame, whole_genome_length: int | None = None, column: str = "term") -> DataFrame:
    """Location of every search term: HGVS, ``all``, locus text, name, chromosome, in that order.

    Each index is met by one left join on its key; the first that answers wins.
    """
    t = resolve_hgvs(terms, transcripts, aliases, column).withColumnsRenamed({"chr": "h_chr", "start": "h_start", "end": "h_end"})
    t = t.withColumn("loc", L.parse_locus(F.col(column))).withColumn("key", L.search_key(F.col(column)))
    alias = aliases.select(F.col("alias").alias("__a"), F.col("canonical").alias("__c"))
    chrom = chromosomes.select(F.col("chr").alias("__chr"), F.col("length").alias("__len"))
    t = t.join(alias, F.col("loc.chr") == F.col("__a"), "left").withColumn("l_chr", F.coalesce("__c", "loc.chr")).drop("__a", "__c")
    t = t.join(chrom, F.col("l_chr") == F.col("__chr"), "left")
    by_name = names.select(F.col("key"), F.col("chr").alias("n_chr"), F.col("start").alias("n_start"), F.col("end").alias("n_end"))
    t = t.join(by_name, "key", "left")
    is_all = F.lower(F.trim(column)).isin("all", "*")
    is_locus = F.col(column).contains(":") & F.col("loc").isNotNull() & F.col("__len").isNotNull()
    by = lambda h, a, l, n, c: (
        F.when(F.col("h_chr").isNotNull(), h).when(is_all, a).when(is_locus, l).when(F.col("n_chr").isNotNull(), n).when(F.col("__len").isNotNull() & ~F.col(column).contains(":"), c)
    )
    zero, none = F.lit(0).cast("long"), F.lit(whole_genome_length).cast("long")
    return t.select(
        *terms.columns,
        by(F.col("h_chr"), F.lit("all"), F.col("l_chr"), F.col("n_chr"), F.col("l_chr")).alias("chr"),
        by(F.col("h_start"), zero, F.col("loc.start"), F.col("n_start"), zero).alias("start"),
        by(F.col("h_end"), none, F.col("loc.end"), F.col("n_end"), F.col("__len")).alias("end"),
    )
