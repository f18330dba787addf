"""Gene models, names, loci, HGVS and sequence expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from genospan.functions import locus as L
from genospan.functions import sequence as SEQ
from genospan.operators import annotation as A
from genospan.operators import genome as G
from genospan.plans import views as V
from genospan.plans.association_queries import _NAMES, names
from genospan.plans.format_queries import feature_lines, s
from genospan.plans.registry import query
from genospan.plans.views import as_line, with_views
from genospan.sources.annotations import parse_gff

# Gene models from customers and their orders: a gene per customer, a transcript per customer, an exon and a
# coding part per order.
_EXON_SPAN = "o_orderkey % 97 * 100 + o_custkey % 5 * 7 + 1000"


def gff_lines(spark, sf):
    o = V.spread(V.table(spark, sf, "orders"), "o_orderkey")
    c = F.col("o_custkey")
    start = F.col("o_orderkey") % 97 * 100 + c % 5 * 7 + 1000
    chrom = F.concat(F.lit("chr"), s(c % 6))
    strand = F.when(c % 2 == 0, "+").otherwise("-")

    def row(kind, a, b, att, phase="."):
        return F.concat_ws("\t", chrom, F.lit("src"), F.lit(kind), s(a), s(b), F.lit("."), strand, F.lit(phase), att)

    tid = F.concat(F.lit("t"), s(c))
    per_order = F.array(
        row("exon", start + 1, start + 60, F.concat(F.lit("Parent="), tid)),
        row("CDS", start + 11, start + 50, F.concat(F.lit("Parent="), tid), "0"),
    )
    parts = o.select(F.explode(per_order).alias("value"))
    span = o.groupBy("o_custkey").agg(F.min(start).alias("a"), F.max(start + 60).alias("b"))
    models = span.select(
        F.explode(
            F.array(
                row("gene", F.col("a") + 1, F.col("b"), F.concat(F.lit("ID=g"), s(c), F.lit(";Name=GENE"), s(c))),
                row("mRNA", F.col("a") + 1, F.col("b"), F.concat(F.lit("ID="), tid, F.lit(";Parent=g"), s(c), F.lit(";Name=TX"), s(c))),
                row("chromosome", F.lit(1), F.lit(99999), F.lit("ID=x")),
            )
        ).alias("value")
    )
    return parts.unionByName(models)


_MODEL = f"""ex AS (SELECT DISTINCT o_custkey AS c, {_EXON_SPAN} AS start, {_EXON_SPAN} + 60 AS "end" FROM orders),
    tx AS (SELECT c, min(start) AS start, max("end") AS "end", min(start) + 10 AS cds_start, max("end") - 10 AS cds_end, count(*) AS n FROM ex GROUP BY 1)"""


@query(
    "assemble_transcripts",
    f"""WITH {_MODEL} SELECT 't' || c AS id, 'chr' || (c % 6) AS chr, start, "end", 'g' || c AS gene_id, 'TX' || c AS name, cds_start, cds_end, n AS n_exons,
        (SELECT string_agg(start || '-' || "end" || ':' || (start + 10) || '-' || ("end" - 10) || '#' || CASE WHEN ex.c % 2 = 0 THEN i ELSE n + 1 - i END, ' ' ORDER BY start)
         FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY start) AS i FROM ex) ex WHERE ex.c = tx.c) AS exons FROM tx""",
)
def assemble_transcripts(spark, sf):
    t = A.assemble_transcripts(parse_gff(gff_lines(spark, sf)))
    text = F.array_join(
        F.transform(
            "exons",
            lambda e: F.concat(s(e["start"]), F.lit("-"), s(e["end"]), F.lit(":"), s(e["cds_start"]), F.lit("-"), s(e["cds_end"]), F.lit("#"), s(e["number"])),
        ),
        " ",
    )
    return t.select("id", "chr", "start", "end", "gene_id", "name", "cds_start", "cds_end", F.size("exons").cast("long").alias("n_exons"), text.alias("exons"))


@query(
    "exon_table",
    f"""WITH {_MODEL}, pt AS (SELECT o_custkey AS c, {_EXON_SPAN} AS start, {_EXON_SPAN} + 60 AS "end" FROM orders)
        SELECT DISTINCT 't' || c AS tid, start, "end", start + 10 AS cds_start, "end" - 10 AS cds_end, FALSE AS utr FROM pt""",
)
def exon_table(spark, sf):
    rows = A.gff_type_filter(parse_gff(gff_lines(spark, sf)))
    return A.exon_table(rows).select("tid", "start", "end", "cds_start", "cds_end", "utr")


@query("gff_type_filter", "SELECT count(*) + 2 * (SELECT count(DISTINCT o_custkey) FROM orders) AS n FROM (SELECT 1 FROM orders UNION ALL SELECT 1 FROM orders) x")
def gff_type_filter(spark, sf):
    return A.gff_type_filter(parse_gff(gff_lines(spark, sf))).agg(F.count(F.lit(1)).alias("n"))


@query(
    "combine_by_id",
    with_views(
        """SELECT chr, 'm' || sample AS id, min(start) AS start, max("end") AS "end", CAST(CASE WHEN count(*) > 1 THEN count(*) ELSE -1 END AS INT) AS parts
           FROM features GROUP BY chr, sample""",
        "features",
    ),
)
def combine_by_id(spark, sf):
    lines = feature_lines(
        spark, sf, "chr", lambda: F.lit("src"), lambda: F.lit("match"), lambda: s(F.col("start") + 1), "end", lambda: F.lit("."), lambda: F.lit("+"),
        lambda: F.lit("."), lambda: F.concat(F.lit("ID=m"), s("sample")),
    )
    c = A.combine_by_id(parse_gff(lines))
    return c.select("chr", "id", "start", "end", F.coalesce(F.size("exons"), F.lit(-1)).alias("parts"))


@query(
    "combine_features",
    with_views(
        """SELECT 'mRNA' AS type, count(DISTINCT o_custkey) AS n, NULL::BIGINT AS s FROM orders
           UNION ALL SELECT 'match', count(*), CAST(sum(x) AS BIGINT) FROM (SELECT min(start) AS x FROM features GROUP BY chr, sample) m""",
        "features",
    ),
)
def combine_features(spark, sf):
    matches = feature_lines(
        spark, sf, "chr", lambda: F.lit("src"), lambda: F.lit("match"), lambda: s(F.col("start") + 1), "end", lambda: F.lit("."), lambda: F.lit("+"),
        lambda: F.lit("."), lambda: F.concat(F.lit("ID=m"), s("sample")),
    )
    both = A.combine_features(parse_gff(gff_lines(spark, sf).unionByName(matches)))
    start = F.sum(F.when(F.col("type") == "match", F.col("start")))
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("n"), start.alias("s"))


@query(
    "exon_phase",
    with_views("SELECT fid, CAST((3 - fid % 3) % 3 AS INT) AS phase, \"end\" - start AS coding FROM features", "features"),
)
def exon_phase(spark, sf):
    f = V.features(spark, sf).select(
        "fid",
        F.struct(
            "start", "end", F.lit(None).cast("long").alias("cds_start"), F.lit(None).cast("long").alias("cds_end"),
            F.lit(False).alias("utr"), (F.col("fid") % 3).cast("int").alias("reading_frame"),
        ).alias("e"),
    )
    return f.select("fid", A.exon_phase(F.col("e")).cast("int").alias("phase"), A.coding_length(F.col("e")).alias("coding"))


def transcripts(spark, sf):
    return A.assemble_transcripts(parse_gff(gff_lines(spark, sf)))


_FIRST = """fe AS (SELECT tx.*, CASE WHEN tx.c % 2 = 0 THEN (SELECT min(start) FROM ex WHERE ex.c = tx.c) ELSE (SELECT max("end") FROM ex WHERE ex.c = tx.c) END AS edge FROM tx)"""


@query(
    "coding_positions",
    f"""WITH {_MODEL}, {_FIRST} SELECT 't' || c AS id, CASE WHEN c % 2 = 0 THEN edge + 10 + 24 ELSE edge - 10 - 1 - 24 END AS at25,
        CASE WHEN n >= 2 THEN (SELECT CASE WHEN fe.c % 2 = 0 THEN start + 10 ELSE "end" - 11 END FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY CASE WHEN c % 2 = 0 THEN start ELSE -start END) AS i FROM ex) e WHERE e.c = fe.c AND i = 2) END AS at41,
        CASE WHEN c % 2 = 0 THEN edge ELSE edge - 1 END AS first_base, CAST(24 AS BIGINT) AS back, CAST(n * 40 AS BIGINT) AS coding_length FROM fe""",
)
def coding_positions(spark, sf):
    t = transcripts(spark, sf)
    lit = lambda v: F.lit(v).cast("long")
    return t.select(
        "id", A.coding_to_genomic(lit(25)).alias("at25"), A.coding_to_genomic(lit(41)).alias("at41"), A.transcript_to_genomic(lit(1)).alias("first_base"),
        A.genomic_to_coding(A.coding_to_genomic(lit(25))).alias("back"), A.total_coding_length().alias("coding_length"),
    )


def hgvs_terms(spark, sf):
    c = V.table(spark, sf, "customer")
    k = F.col("c_custkey")
    acc = F.concat(F.lit("t"), s(k))
    term = (
        F.when(k % 6 == 0, F.concat(F.lit("chr"), s(k % 5), F.lit(":g."), s(k + 10), F.lit("_"), s(k + 20), F.lit("del")))
        .when(k % 6 == 1, F.concat(acc, F.lit("(GENE1):c.25+3A>G")))
        .when(k % 6 == 2, F.concat(acc, F.lit(":c.-4")))
        .when(k % 6 == 3, F.concat(acc, F.lit(":n.5_9")))
        .when(k % 6 == 4, F.concat(acc, F.lit(":p.Val600Glu")))
        .otherwise(F.concat(acc, F.lit(":c.10_12-2del")))
    )
    return c.select(k.alias("k"), term.alias("term"))


@query("hgvs_valid", "SELECT c_custkey AS k, c_custkey % 7 <> 3 AND c_custkey % 11 <> 5 AND c_custkey % 13 <> 7 AS valid FROM customer")
def hgvs_valid(spark, sf):
    """Every 7th term lacks its colon, every 11th has an unknown type, every 13th no number."""
    term, k = F.col("term"), F.col("k")
    broken = (
        F.when(k % 7 == 3, F.replace(term, F.lit(":"), F.lit("-")))
        .when(k % 11 == 5, F.regexp_replace(term, ":[a-z][.]", ":x."))
        .when(k % 13 == 7, F.concat(F.substring_index(term, ":", 1), F.lit(":c.del")))
        .otherwise(term)
    )
    return hgvs_terms(spark, sf).select("k", L.hgvs_valid(broken).alias("valid"))


@query(
    "resolve_hgvs",
    f"""WITH {_MODEL}, {_FIRST}, k AS (SELECT c_custkey AS k FROM customer)
        SELECT k, CASE WHEN k % 6 = 0 THEN 'chr' || (k % 5) WHEN k % 6 <> 4 AND edge IS NOT NULL THEN 'chr' || (k % 6) END AS chr,
          CASE k % 6 WHEN 0 THEN k + 9 WHEN 1 THEN edge - 10 - 1 - 24 - 3 WHEN 2 THEN edge + 10 - 4 WHEN 3 THEN edge - 1 - 8 WHEN 5 THEN edge - 10 - 1 - 9 END AS start,
          CASE k % 6 WHEN 0 THEN k + 20 WHEN 1 THEN edge - 10 - 1 - 24 - 3 + 1 WHEN 2 THEN edge + 10 - 4 + 1 WHEN 3 THEN edge - 1 - 4 + 1 WHEN 5 THEN edge - 10 - 1 - 11 + 2 + 1 END AS "end"
        FROM k LEFT JOIN fe ON fe.c = k.k""",
)
def resolve_hgvs(spark, sf):
    got = A.resolve_hgvs(hgvs_terms(spark, sf), transcripts(spark, sf))
    return got.select("k", "chr", "start", "end")


@query(
    "transcript_at",
    f"""WITH {_MODEL}, p AS (SELECT o_orderkey AS point_id, 'chr' || (o_custkey % 6) AS chr, o_orderkey % 12000 AS pos FROM orders)
        SELECT point_id, (SELECT 't' || c FROM tx WHERE 'chr' || (c % 6) = p.chr AND start <= pos AND "end" >= pos ORDER BY start, 't' || c LIMIT 1) AS transcript_id FROM p""",
)
def transcript_at(spark, sf):
    o = V.table(spark, sf, "orders")
    points = o.select(F.col("o_orderkey").alias("point_id"), F.concat(F.lit("chr"), s(F.col("o_custkey") % 6)).alias("chr"), (F.col("o_orderkey") % 12_000).alias("pos"))
    return A.transcript_at(points, transcripts(spark, sf)).select("point_id", "transcript_id")


@query("hgvs_annotate")
def hgvs_annotate(spark, sf):
    o = V.table(spark, sf, "orders").select(
        F.concat(F.lit("t"), s("o_custkey")).alias("id"), (F.col("o_orderkey") % 9700 + 1000).alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), "o_orderkey"
    )
    t = transcripts(spark, sf).select("id", "chr", "strand", "exons", F.col("id").alias("name"))
    return o.join(t, "id").select("o_orderkey", A.hgvs_annotate().alias("hgvs"))


@query(
    "parse_locus",
    with_views(
        """SELECT fid, chr, CASE fid % 3 WHEN 0 THEN start WHEN 1 THEN start - 20 END AS start, CASE fid % 3 WHEN 0 THEN "end" WHEN 1 THEN start + 21 END AS "end" FROM features""", "features"
    ),
)
def parse_locus(spark, sf):
    f = V.features(spark, sf)
    text = (
        F.when(F.col("fid") % 3 == 0, L.format_locus(F.col("chr"), F.col("start"), F.col("end")))
        .when(F.col("fid") % 3 == 1, F.concat("chr", F.lit(":"), F.format_number(F.col("start") + 1, 0)))
        .otherwise(F.col("chr"))
    )
    return f.select("fid", L.parse_locus(text).alias("l")).select("fid", "l.chr", "l.start", "l.end")


@query(
    "locus_predicates",
    with_views(
        """SELECT fid, start >= 150000 AND "end" <= 200000 AND chr = 'NO' AS inside, chr = 'NO' AND NOT ("end" < 150000 OR start > 200000) AS touching,
           CASE WHEN chr = 'NO' THEN least(start, 150000) ELSE 150000 END AS lo FROM features""",
        "features",
    ),
)
def locus_predicates(spark, sf):
    w = [F.lit("NO"), F.lit(150_000).cast("long"), F.lit(200_000).cast("long")]
    mine = [F.col("chr"), F.col("start"), F.col("end")]
    return V.features(spark, sf).select("fid", L.contains(*w, *mine).alias("inside"), L.overlaps(*w, *mine).alias("touching"), L.extend(*w, *mine)["start"].alias("lo"))


@query(
    "resolve_locus",
    with_views(
        f"""WITH {_NAMES}, t AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'gene' || (c_custkey % 50) WHEN 1 THEN 'NO:1,001-2,000' WHEN 2 THEN 'chrRO' ELSE 'nothing:5-9' END AS term FROM customer)
            SELECT k, CASE k % 4 WHEN 0 THEN nm.chr WHEN 1 THEN 'NO' WHEN 2 THEN 'RO' END AS chr, CASE k % 4 WHEN 0 THEN nm.start WHEN 1 THEN 1000 WHEN 2 THEN 0 END AS start,
              CASE k % 4 WHEN 0 THEN nm."end" WHEN 1 THEN 2000 WHEN 2 THEN (SELECT length FROM chrom_sizes WHERE chr = 'RO') END AS "end"
            FROM t LEFT JOIN nm ON nm.key = upper(term)""",
        "features",
        "chrom_sizes",
    ),
)
def resolve_locus(spark, sf):
    c = V.table(spark, sf, "customer")
    k = F.col("c_custkey")
    term = F.when(k % 4 == 0, F.concat(F.lit("gene"), s(k % 50))).when(k % 4 == 1, "NO:1,001-2,000").when(k % 4 == 2, "chrRO").otherwise("nothing:5-9")
    aliases = G.alias_table(spark, G.default_aliases("hg38", V.CHROMS))
    got = A.resolve_locus(c.select(k.alias("k"), term.alias("term")), names(spark, sf), V.chromosomes(spark, sf), aliases, transcripts(spark, sf))
    return got.select("k", "chr", "start", "end")


@query("search_key", "SELECT doc_id, md5(upper(replace(replace(text, 'ß', 'ss'), ' ', '+'))) AS key FROM documents")
def search_key(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(L.search_key(F.col("text")).cast("binary")).alias("key"))


@query(
    "props_attribute",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50",
)
def props_attribute(spark, sf):
    """Attribute lookup on a map parsed from JSON."""
    e = V.table(spark, sf, "events").withColumn("attributes", F.from_json("props", "map<string,string>"))
    k = F.try_element_at("attributes", F.lit("k"))
    return e.where(k.cast("int") > 50).select("event_id", k.alias("k"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def bases(spark, sf):
    """One base per character of the whole text; N for all that stands for none."""
    d = V.spread(V.table(spark, sf, "documents"), "doc_id")
    plain = F.translate("text", LETTERS, LETTERS.upper())
    return d.select("doc_id", F.regexp_replace(F.translate(plain, "EIONRS", "ACGTGA"), "(?s)[^ACGT]", "N").alias("seq"))


_SEQ = f"""sq AS (SELECT doc_id, regexp_replace(translate(translate(text, '{LETTERS}', '{LETTERS.upper()}'), 'EIONRS', 'ACGTGA'), '[^ACGT]', 'N', 'gs') AS seq FROM documents)"""


@query(
    "reverse_complement",
    "SELECT doc_id, md5(reverse(translate(text, 'ACGTYRWSKMDHBVacgtyrwskmdhbv', 'TGCARYWSMKHDVBtgcarywsmkhdvb'))) AS rc FROM documents",
)
def reverse_complement(spark, sf):
    """All letters of whole texts: the codes of several bases, lower case, and characters that have no partner."""
    d = V.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(SEQ.reverse_complement(F.col("text")).cast("binary")).alias("rc"))


# Amino acids of the standard genetic code, written out apart from the code under test.
CODON_OF = {
    "A": ["GCT", "GCC", "GCA", "GCG"],
    "R": ["CGT", "CGC", "CGA", "CGG", "AGA", "AGG"],
    "N": ["AAT", "AAC"],
    "D": ["GAT", "GAC"],
    "C": ["TGT", "TGC"],
    "Q": ["CAA", "CAG"],
    "E": ["GAA", "GAG"],
    "G": ["GGT", "GGC", "GGA", "GGG"],
    "H": ["CAT", "CAC"],
    "I": ["ATT", "ATC", "ATA"],
    "L": ["TTA", "TTG", "CTT", "CTC", "CTA", "CTG"],
    "K": ["AAA", "AAG"],
    "M": ["ATG"],
    "F": ["TTT", "TTC"],
    "P": ["CCT", "CCC", "CCA", "CCG"],
    "S": ["TCT", "TCC", "TCA", "TCG", "AGT", "AGC"],
    "T": ["ACT", "ACC", "ACA", "ACG"],
    "W": ["TGG"],
    "Y": ["TAT", "TAC"],
    "V": ["GTT", "GTC", "GTA", "GTG"],
    "STOP": ["TAA", "TAG", "TGA"],
}
_CODONS = "MAP {" + ", ".join(f"'{c}': '{a}'" for a, codons in CODON_OF.items() for c in codons) + "}"


def _frame_sql(f, read):
    return f"md5(coalesce(array_to_string(list_transform(range(0, greatest(0, (length(seq) - {f}) // 3)), lambda i: m[{read.format(c=f'substr(seq, CAST(i * 3 + {f} + 1 AS INT), 3)')}]), ''), ''))"


@query(
    "translate_3_frames",
    f"""WITH {_SEQ} SELECT doc_id, {_frame_sql(0, '{c}')} AS f0, {_frame_sql(1, '{c}')} AS f1, {_frame_sql(2, '{c}')} AS f2, {_frame_sql(0, 'reverse({c})')} AS r0
        FROM (SELECT *, {_CODONS} AS m FROM sq) s""",
)
def translate_3_frames(spark, sf):
    b = bases(spark, sf)
    digest = lambda c: F.md5(F.array_join(c, "").cast("binary"))
    fwd, rev = SEQ.translate_3_frames(F.col("seq")), SEQ.translate_3_frames(F.col("seq"), reverse=True)
    shown = b.select("doc_id", *fwd, rev[0].alias("r0"))
    return shown.select("doc_id", *[digest(F.col(f"frame{i}")).alias(f"f{i}") for i in range(3)], digest(F.col("r0")).alias("r0"))
