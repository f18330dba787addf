"""Readers, each fed with text lines that Spark derives from the whole benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from genospan.plans import views as V
from genospan.plans.registry import query
from genospan.plans.views import as_line, with_views
from genospan.sources import annotations as A
from genospan.sources import samples as SM
from genospan.sources import sequences as SQ
from genospan.sources import sinks as K
from genospan.sources import tables as T
from genospan.session import ship_by_value
from genospan.sources.variants import parse_vcf

ship_by_value(__name__)


def s(col):
    return F.col(col).cast("string") if isinstance(col, str) else col.cast("string")


def feature_lines(spark, sf, *cols, sep="\t"):
    f = V.spread(V.features(spark, sf), "fid")
    return f.select(as_line(*[c() if callable(c) else s(c) for c in cols], sep=sep))


def exon_text(col="exons"):
    part = lambda e: F.concat(
        s(e["start"]), F.lit("-"), s(e["end"]), F.lit(":"), F.coalesce(s(e["cds_start"]), F.lit("")), F.lit(":"),
        F.coalesce(s(e["cds_end"]), F.lit("")), F.when(e["utr"], "u").otherwise(""),
    )
    return F.array_join(F.transform(col, part), " ")


def name_or_dot():
    return F.when(F.col("odd") == 1, ".").otherwise(F.concat(F.lit("f"), s("fid")))


@query(
    "read_bed",
    with_views(
        """SELECT chr, start, "end", CASE WHEN odd = 1 THEN '' ELSE 'f' || fid END AS name,
             CASE WHEN fid % 7 = 0 THEN 1000.0 WHEN fid % 11 = 0 THEN NULL ELSE CAST(cents AS DOUBLE) END AS score,
             CASE WHEN fid % 7 <> 0 AND fid % 11 <> 0 THEN '+' END AS strand,
             CASE WHEN fid % 7 <> 0 AND fid % 11 <> 0 THEN start + 1 END AS cds_start,
             CASE WHEN fid % 7 <> 0 AND fid % 11 <> 0 THEN concat(start, '-', start + 2, ':', start + 1, ':', CASE WHEN "end" - 1 <= start + 2 AND "end" - 1 >= start THEN "end" - 1 END,
                 ' ', "end" - 3, '-', "end", ':', CASE WHEN start + 1 >= "end" - 3 AND start + 1 <= "end" THEN start + 1 END, ':', "end" - 1) END AS exons
           FROM features""",
        "features",
    ),
)
def read_bed(spark, sf):
    short, bad = F.col("fid") % 7 == 0, F.col("fid") % 11 == 0
    rest = lambda c: F.when(~short, c)
    f = V.spread(V.features(spark, sf), "fid")
    lines = f.select(
        as_line(
            "chr", s("start"), s("end"), name_or_dot(), rest(F.when(bad, "x").otherwise(s("cents"))), rest(F.lit("+")),
            rest(s(F.col("start") + 1)), rest(s(F.col("end") - 1)), rest(F.lit("0")), rest(F.lit("2")), rest(F.lit("2,3,")),
            rest(F.concat(F.lit("0,"), s(F.col("end") - F.col("start") - 3), F.lit(","))), sep=" ",
        )
    )
    return A.parse_bed(lines).select("chr", "start", "end", "name", "score", "strand", "cds_start", exon_text().alias("exons"))


@query(
    "bed_attributes",
    with_views("""SELECT start, 'j' || fid AS name, CAST(cents AS VARCHAR) AS reads, CASE WHEN odd = 1 THEN 'GT/AG' ELSE 'AT/AC' END AS motif FROM features""", "features"),
)
def bed_attributes(spark, sf):
    name = lambda: F.concat(
        F.lit("uniquely_mapped="), s("cents"), F.lit(";id=j"), s("fid"), F.lit(";motif="), F.when(F.col("odd") == 1, "GT/AG").otherwise("AT/AC")
    )
    bed = A.parse_bed(feature_lines(spark, sf, "chr", "start", "end", name))
    return bed.select("start", F.col("attributes")["id"].alias("name"), F.col("attributes")["uniquely_mapped"].alias("reads"), F.col("attributes")["motif"].alias("motif"))


@query(
    "read_peaks",
    with_views(
        """SELECT chr, start, "end", CASE WHEN odd = 1 THEN CAST(cents AS DOUBLE) / 4 ELSE 5.0 END AS score, CAST(cents AS DOUBLE) / 4 AS signal,
           2.5::DOUBLE AS p_value, -1.0::DOUBLE AS q_value, CASE WHEN sample % 2 = 0 THEN 17.0::DOUBLE END AS peak FROM features""",
        "features",
    ),
)
def read_peaks(spark, sf):
    lines = feature_lines(
        spark, sf, "chr", "start", "end", lambda: F.lit("."), lambda: F.when(F.col("odd") == 1, "0").otherwise("5"), lambda: F.lit("."),
        lambda: s(F.col("cents") / 4), lambda: F.lit("2.5"), lambda: F.lit("-1"), lambda: F.when(F.col("sample") % 2 == 0, "17"),
    )
    return A.parse_peaks(lines).select("chr", "start", "end", "score", "signal", "p_value", "q_value", "peak")


@query(
    "read_gapped_peak",
    with_views("""SELECT start, CAST(cents AS DOUBLE) / 4 AS signal, 2.5::DOUBLE AS p_value, -1.0::DOUBLE AS q_value FROM features""", "features"),
)
def read_gapped_peak(spark, sf):
    fixed = [lambda v=v: F.lit(v) for v in ("n", "5", "+")]
    tail = [lambda v=v: F.lit(v) for v in ("0", "1", "5,", "0,")]
    lines = feature_lines(
        spark, sf, "chr", "start", "end", *fixed, "start", "end", *tail, lambda: s(F.col("cents") / 4), lambda: F.lit("2.5"), lambda: F.lit("-1")
    )
    return A.parse_gapped_peak(lines).select("start", "signal", "p_value", "q_value")


@query(
    "read_bedmethyl",
    with_views("""SELECT start, "end", CAST(cents AS VARCHAR) AS coverage, '75.0' AS percent_methylated, CAST(sample AS VARCHAR) AS n_mod FROM features""", "features"),
)
def read_bedmethyl(spark, sf):
    mid = [lambda v=v: F.lit(v) for v in ("m", "10", "+", "1", "2", "0,0,0")]
    lines = feature_lines(spark, sf, "chr", "start", "end", *mid, "cents", lambda: F.lit("75.0"), "sample")
    return A.parse_bedmethyl(lines).select("start", "end", "coverage", "percent_methylated", "n_mod")


@query("read_bedgraph", with_views("""SELECT chr, start, "end", CAST(cents AS DOUBLE) / 4 AS value FROM features WHERE fid % 9 <> 0""", "features"))
def read_bedgraph(spark, sf):
    lines = feature_lines(spark, sf, "chr", "start", "end", lambda: F.when(F.col("fid") % 9 != 0, s(F.col("cents") / 4)))
    return A.parse_bedgraph(lines)


def wig_lines(spark, sf):
    """Per event type one file; fixedStep runs per day, variableStep for views."""
    e = V.table(spark, sf, "events").select(
        F.col("event_type").alias("file"), "event_id", "value", F.expr("unix_micros(cast(ts as timestamp)) div 86400000000").alias("day")
    )
    view = F.col("file") == "view"
    values = e.select(
        "file", F.lit(0).alias("part"), (F.col("event_id") * 2 + 1).alias("line"),
        F.when(view, F.concat_ws(" ", s(F.col("event_id") * 10 + 1), s("value")))
        .when(F.col("event_id") % 13 == 0, F.lit("NA"))
        .otherwise(s("value")).alias("value"),
    )
    heads = e.groupBy("file", "day").agg(F.min("event_id").alias("m")).select(
        "file", F.lit(0).alias("part"), (F.col("m") * 2).alias("line"),
        F.when(view, F.concat(F.lit("variableStep chrom="), "file", F.lit(" span=3")))
        .otherwise(F.concat(F.lit("fixedStep chrom="), "file", F.lit(" start="), s(F.col("day") * 1000 + 1), F.lit(" step=50 span=5"))).alias("value"),
    )
    return values.unionByName(heads)


@query(
    "read_wig",
    """SELECT chr, start, "end", value FROM (
         SELECT event_type AS chr, event_id, value, (epoch_us(ts) // 86400000000) * 1000 + 50 * (row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 86400000000 ORDER BY event_id) - 1) AS start,
                (epoch_us(ts) // 86400000000) * 1000 + 50 * (row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 86400000000 ORDER BY event_id) - 1) + 5 AS "end"
         FROM events WHERE event_type <> 'view') f WHERE event_id % 13 <> 0
       UNION ALL SELECT event_type, event_id * 10, event_id * 10 + 3, value FROM events WHERE event_type = 'view'""",
)
def read_wig(spark, sf):
    return A.parse_wig(wig_lines(spark, sf))


def gene_exons():
    starts = F.concat_ws(",", s("start"), s(F.col("end") + 100), F.lit(""))
    ends = F.concat_ws(",", s("end"), s(F.col("end") + 150), F.lit(""))
    return starts, ends


_GENE_EXONS = """concat(start, '-', "end", ':', CASE WHEN start + 1 <= "end" THEN start + 1 END, ':', ' ', "end" + 100, '-', "end" + 150, '::', "end" + 120)"""


@query(
    "read_genepred",
    with_views(f"""SELECT 'g' || fid AS name, chr, start, "end" + 150 AS "end", start + 1 AS cds_start, "end" + 120 AS cds_end, {_GENE_EXONS} AS exons FROM features""", "features"),
)
def read_genepred(spark, sf):
    starts, ends = gene_exons()
    lines = feature_lines(
        spark, sf, lambda: F.concat(F.lit("g"), s("fid")), "chr", lambda: F.lit("+"), "start", lambda: s(F.col("end") + 150),
        lambda: s(F.col("start") + 1), lambda: s(F.col("end") + 120), lambda: F.lit("2"), lambda: starts, lambda: ends,
    )
    g = A.parse_genepred(lines, "genePred")
    return g.select("name", "chr", "start", "end", "cds_start", "cds_end", exon_text().alias("exons"))


@query(
    "read_refgene",
    with_views("""SELECT 'NM_' || fid AS id, 'SYM' || sample AS name, chr, start, "end" + 150 AS "end", '0,' || (fid % 3) AS frames FROM features""", "features"),
)
def read_refgene(spark, sf):
    starts, ends = gene_exons()
    lines = feature_lines(
        spark, sf, lambda: F.lit("585"), lambda: F.concat(F.lit("NM_"), s("fid")), "chr", lambda: F.lit("+"), "start", lambda: s(F.col("end") + 150),
        lambda: s(F.col("start") + 1), lambda: s(F.col("end") + 120), lambda: F.lit("2"), lambda: starts, lambda: ends, lambda: F.lit("0"),
        lambda: F.concat(F.lit("SYM"), s("sample")), lambda: F.lit("cmpl"), lambda: F.lit("cmpl"), lambda: F.concat(F.lit("0,"), s(F.col("fid") % 3), F.lit(",")),
    )
    frames = F.array_join(F.transform("exons", lambda e: s(e["reading_frame"])), ",")
    return A.parse_genepred(lines, "refGene").select("id", "name", "chr", "start", "end", frames.alias("frames"))


@query(
    "read_refflat",
    with_views(f"""SELECT 'SYM' || sample AS name, 'NM_' || fid AS id, chr, start, "end" + 150 AS "end", {_GENE_EXONS} AS exons FROM features""", "features"),
)
def read_refflat(spark, sf):
    starts, ends = gene_exons()
    lines = feature_lines(
        spark, sf, lambda: F.concat(F.lit("SYM"), s("sample")), lambda: F.concat(F.lit("NM_"), s("fid")), "chr", lambda: F.lit("+"), "start",
        lambda: s(F.col("end") + 150), lambda: s(F.col("start") + 1), lambda: s(F.col("end") + 120), lambda: F.lit("2"), lambda: starts, lambda: ends,
    )
    return A.parse_genepred(lines, "refFlat").select("name", "id", "chr", "start", "end", exon_text().alias("exons"))


@query(
    "read_psl",
    with_views(
        """SELECT chr, start, "end", '-' AS strand, 'q' || fid AS name, CAST(floor(1000 * CAST(sample + 500 - fid % 5 - 3 AS DOUBLE) / 900) AS BIGINT) AS score,
           concat(start, '-', start + 4, ' ', "end" - 1, '-', "end") AS exons FROM features""",
        "features",
    ),
)
def read_psl(spark, sf):
    c = lambda v: (lambda: F.lit(v))
    lines = feature_lines(
        spark, sf, lambda: s(F.col("sample") + 500), lambda: s(F.col("fid") % 5), c("0"), c("0"), c("1"), c("7"), c("2"), c("9"), c("-"),
        lambda: F.concat(F.lit("q"), s("fid")), c("900"), c("0"), c("900"), "chr", c("1000000"), "start", "end", c("2"), c("4,1,"), c("0,4,"),
        lambda: F.concat(s("start"), F.lit(","), s(F.col("end") - 1), F.lit(",")),
    )
    exons = F.array_join(F.transform("exons", lambda e: F.concat(s(e["start"]), F.lit("-"), s(e["end"]))), " ")
    return A.parse_psl(lines).select("chr", "start", "end", "strand", "name", "score", exons.alias("exons"))


@query(
    "read_rmsk",
    with_views("""SELECT chr, start, "end", cents AS sw_score, 'Alu' || sample AS rep_name, -5 AS rep_left FROM features""", "features"),
)
def read_rmsk(spark, sf):
    c = lambda v: (lambda: F.lit(v))
    lines = feature_lines(
        spark, sf, c("585"), "cents", c("1"), c("2"), c("3"), "chr", "start", "end", c("-9"), c("+"), lambda: F.concat(F.lit("Alu"), s("sample")),
        c("SINE"), c("Alu"), c("1"), c("30"), c("-5"), c("1"),
    )
    r = A.parse_rmsk(lines)
    return r.select("chr", "start", "end", "sw_score", "rep_name", F.col("rep_left").cast("int").alias("rep_left"))


@query("read_snp", with_views("""SELECT chr, start, "end", 'rs' || fid AS name, sample AS score, '-' AS strand, 'A/G' AS observed FROM features""", "features"))
def read_snp(spark, sf):
    c = lambda v: (lambda: F.lit(v))
    lines = feature_lines(spark, sf, c("585"), "chr", "start", "end", lambda: F.concat(F.lit("rs"), s("fid")), "sample", c("-"), c("A"), c("A"), c("A/G"))
    return A.parse_snp(lines).select("chr", "start", "end", "name", "score", "strand", "observed")


@query(
    "read_gff3",
    with_views(
        """SELECT chr, start, "end", CASE WHEN odd = 1 THEN 'exon' ELSE 'CDS' END AS type, CASE WHEN sample % 2 = 0 THEN CAST(cents AS DOUBLE) END AS score,
           'e' || fid AS id, 't' || sample AS parent, 'a;b,c' AS note, CAST(CASE WHEN odd = 0 THEN (3 - fid % 3) % 3 END AS INT) AS reading_frame FROM features""",
        "features",
    ),
)
def read_gff3(spark, sf):
    lines = feature_lines(
        spark, sf, "chr", lambda: F.lit("my%20src"), lambda: F.when(F.col("odd") == 1, "exon").otherwise("CDS"), lambda: s(F.col("start") + 1), "end",
        lambda: F.when(F.col("sample") % 2 == 0, s("cents")).otherwise("."), lambda: F.lit("+"), lambda: F.when(F.col("odd") == 1, ".").otherwise(s(F.col("fid") % 3)),
        lambda: F.concat(F.lit("ID=e"), s("fid"), F.lit(";Parent=t"), s("sample"), F.lit(";Note=a%3Bb%2Cc")),
    )
    g = A.parse_gff(lines)
    return g.select("chr", "start", "end", "type", "score", "id", "parent", F.col("attributes")["Note"].alias("note"), "reading_frame")


@query(
    "read_gtf",
    with_views(
        """SELECT start, CASE WHEN odd = 1 THEN 'transcript' ELSE 'exon' END AS type, CASE WHEN odd = 1 THEN 'T' || fid END AS id,
           CASE WHEN odd = 1 THEN 'G' || sample ELSE 'T' || fid END AS parent, 'G' || sample AS gene FROM features""",
        "features",
    ),
)
def read_gtf(spark, sf):
    lines = feature_lines(
        spark, sf, "chr", lambda: F.lit("src"), lambda: F.when(F.col("odd") == 1, "transcript").otherwise("exon"), lambda: s(F.col("start") + 1), "end",
        lambda: F.lit("."), lambda: F.lit("+"), lambda: F.lit("."),
        lambda: F.concat(F.lit('gene_id "G'), s("sample"), F.lit('"; transcript_id "T'), s("fid"), F.lit('";')),
    )
    return A.parse_gff(lines, "gtf").select("start", "type", "id", "parent", F.col("attributes")["gene_id"].alias("gene"))


VCF_SAMPLES = ["S1", "S2"]


def vcf_lines(spark, sf):
    """Variants from line items: several allele shapes, INFO keys and two samples."""
    k = F.col("fid") % 8
    ref = F.when(k.isin(0, 1), "A").when(k == 2, "CA").when(k == 3, "CAT").when(k == 4, "GTC").otherwise("G")
    alt = F.when(k == 0, "C").when(k == 1, "ACC").when(k == 2, "C").when(k == 3, "CGT").when(k == 4, "G,GTCT").when(k == 5, "<DEL>").when(k == 6, ".").otherwise("T,<NON_REF>")
    end = s(F.col("start") + 2_000_000 * (F.col("sample") % 2))
    info = (
        F.when(k == 5, F.concat(F.lit("SVTYPE=DEL;CHR2="), F.when(F.col("odd") == 1, "RO").otherwise(F.col("chr")), F.lit(";END="), end))
        .when(k == 0, F.concat(F.lit("AF=0."), s(F.col("sample") % 10), F.lit(";DB")))
        .otherwise(".")
    )
    flt = F.when(F.col("odd") == 1, "PASS").when(F.col("sample") % 2 == 0, ".").otherwise("q10")
    gt1 = F.when(F.col("sample") % 3 == 0, "0/1").when(F.col("sample") % 3 == 1, "1|1").otherwise("./.")
    gt2 = F.when(F.col("odd") == 1, "0/0").otherwise("0|1")
    dp = lambda m: s(F.col("sample") % m)
    f = V.spread(V.features(spark, sf), "fid")
    return f.select(
        as_line(
            "chr", s(F.col("start") + 1), F.concat(F.lit("v"), s("fid")), ref, alt, s("cents"), flt, info, F.lit("GT:DP:AD"),
            F.concat_ws(":", gt1, dp(50), F.concat_ws(",", dp(7), dp(5))), F.concat_ws(":", gt2, dp(60), F.lit("3,4")),
        )
    )


def variants(spark, sf):
    return parse_vcf(vcf_lines(spark, sf), VCF_SAMPLES)


VCF_SQL = """vc AS (SELECT *, fid % 8 AS k, start + 1 AS pos,
      CASE WHEN fid % 8 IN (0, 1) THEN 'A' WHEN fid % 8 = 2 THEN 'CA' WHEN fid % 8 = 3 THEN 'CAT' WHEN fid % 8 = 4 THEN 'GTC' ELSE 'G' END AS ref,
      CASE fid % 8 WHEN 0 THEN 'C' WHEN 1 THEN 'ACC' WHEN 2 THEN 'C' WHEN 3 THEN 'CGT' WHEN 4 THEN 'G,GTCT' WHEN 5 THEN '<DEL>' WHEN 6 THEN '.' ELSE 'T,<NON_REF>' END AS alt,
      CASE WHEN odd = 1 THEN 'PASS' WHEN sample % 2 = 0 THEN '.' ELSE 'q10' END AS filter,
      CASE WHEN fid % 8 = 5 THEN CASE WHEN odd = 1 THEN 'RO' ELSE chr END END AS chr2,
      CASE WHEN fid % 8 = 5 THEN start + 2000000 * (sample % 2) END AS info_end,
      CASE WHEN fid % 8 = 0 THEN '0.' || (sample % 10) END AS af,
      CASE sample % 3 WHEN 0 THEN '0/1' WHEN 1 THEN '1|1' ELSE './.' END AS gt1, CASE WHEN odd = 1 THEN '0/0' ELSE '0|1' END AS gt2 FROM features)"""


def vcf_sql(body):
    return with_views(f"WITH {VCF_SQL} {body}", "features")


@query(
    "read_vcf",
    vcf_sql(
        """SELECT chr, pos, 'v' || fid AS names, ref, alt, CAST(cents AS VARCHAR) AS qual, filter, chr2, CAST(info_end AS VARCHAR) AS info_end, af,
           'S1' AS sample1, replace(replace(gt1, '|', '/'), '/', ' ') AS alleles1, CAST(sample % 60 AS VARCHAR) AS dp2 FROM vc"""
    ),
)
def read_vcf(spark, sf):
    v = variants(spark, sf)
    i = lambda k: F.try_element_at("info", F.lit(k))
    c1, c2 = F.get("calls", F.lit(0)), F.get("calls", F.lit(1))
    return v.select(
        "chr", "pos", "names", "ref", "alt", "qual", "filter", i("CHR2").alias("chr2"), i("END").alias("info_end"), i("AF").alias("af"),
        c1["sample"].alias("sample1"), F.array_join(c1["genotype"], " ").alias("alleles1"), c2["fields"]["DP"].alias("dp2"),
    )


def seg_lines(spark, sf, layout):
    f = V.spread(V.features(spark, sf), "fid")
    return f.select(as_line(*[F.lit("x") if c is None else (s(F.col("start") + 1) if c == "start" else s(c)) for c in layout]))


@query("read_seg", with_views("""SELECT CAST(sample AS VARCHAR) AS sample, chr, start, "end", CAST(cents AS DOUBLE) AS value, 'x' AS probes FROM features""", "features"))
def read_seg(spark, sf):
    head = ["sample", "chr", "start", "end", "probes", "value"]
    df = T.parse_segments(seg_lines(spark, sf, ["sample", "chr", "start", "end", None, "cents"]), head)
    return df.select("sample", "chr", "start", "end", "value", F.col("attributes")["probes"].alias("probes"))


@query("read_mut", with_views("""SELECT CAST(sample AS VARCHAR) AS sample, chr, start, "end", CAST(odd AS VARCHAR) AS value FROM features""", "features"))
def read_mut(spark, sf):
    head = ["chr", "start", "end", "sample", "type"]
    return T.parse_segments(seg_lines(spark, sf, ["chr", "start", "end", "sample", "odd"]), head, "mut")


@query("read_maf", with_views("""SELECT CAST(sample AS VARCHAR) AS sample, chr, start, "end", CAST(odd AS VARCHAR) AS value FROM features""", "features"))
def read_maf(spark, sf):
    cols = [None] * 4 + ["chr", "start", "end", None, "odd"] + [None] * 6 + ["sample"]
    df = T.parse_segments(seg_lines(spark, sf, cols), [f"h{i}" for i in range(len(cols))], "maf")
    return df.select("sample", "chr", "start", "end", "value")


def pair_lines(spark, sf, *extra):
    p = V.pairs(spark, sf)
    return p.select(as_line("chr1", s("start1"), s("end1"), "chr2", s("start2"), s("end2"), *[e() for e in extra]))


_PAIR_PLACES = """SELECT {cols}, chr1 AS chr, least(start1, start2) AS start, greatest(end1, end2) AS "end", FALSE AS dup FROM pairs WHERE chr1 = chr2
    UNION ALL SELECT {cols}, chr1, start1, end1, FALSE FROM pairs WHERE chr1 <> chr2 UNION ALL SELECT {cols}, chr2, start2, end2, TRUE FROM pairs WHERE chr1 <> chr2"""


@query("read_bedpe", with_views(_PAIR_PLACES.format(cols="start1, end2, 'p' || pid AS name, CAST(pid AS DOUBLE) AS score, '+' AS strand1"), "pairs"))
def read_bedpe(spark, sf):
    lines = pair_lines(spark, sf, lambda: F.concat(F.lit("p"), s("pid")), lambda: s("pid"), lambda: F.lit("+"), lambda: F.lit("."))
    return T.parse_bedpe(lines).select("start1", "end2", "name", "score", "strand1", "chr", "start", "end", "dup")


@query("read_bedpe_scored", with_views(_PAIR_PLACES.format(cols="CAST(NULL AS VARCHAR) AS name, CAST(pid AS DOUBLE) AS score"), "pairs"))
def read_bedpe_scored(spark, sf):
    """Seven columns, the seventh being a number: it is the score."""
    return T.parse_bedpe(pair_lines(spark, sf, lambda: s("pid"))).select("name", "score", "chr", "start", "end", "dup")


@query("read_bedpe_hiccups", with_views(_PAIR_PLACES.format(cols="start1, CAST(pid AS VARCHAR) AS fdr"), "pairs"))
def read_bedpe_hiccups(spark, sf):
    head = ["chr1", "x1", "x2", "chr2", "y1", "y2", "color", "fdrDonut"]
    df = T.parse_bedpe(pair_lines(spark, sf, lambda: F.lit("0,255,255"), lambda: s("pid")), head)
    return df.select("start1", F.col("extras")["fdrDonut"].alias("fdr"), "chr", "start", "end", "dup")


@query("read_bedpe_domain", with_views("""SELECT chr1 AS chr, start1 AS start, end1 AS "end", '1,2,3' AS color, CAST(pid AS DOUBLE) AS value FROM pairs""", "pairs"))
def read_bedpe_domain(spark, sf):
    return T.parse_bedpe_domain(pair_lines(spark, sf, lambda: F.lit("1,2,3"), lambda: s("pid")))


@query("read_interact", with_views("SELECT chr1 AS chr, start1 AS start, chr2, start2, end2, score, CAST(pid AS DOUBLE) AS value, 'rgb(0,0,0)' AS color FROM pairs", "pairs"))
def read_interact(spark, sf):
    p = V.pairs(spark, sf)
    lines = p.select(
        as_line(
            "chr1", s("start1"), s("end1"), F.lit("n"), s("score"), s("pid"), F.lit("."), F.lit("0"), "chr1", s("start1"), s("end1"), F.lit("a"), F.lit("+"),
            "chr2", s("start2"), s("end2"), F.lit("b"), F.lit("-"),
        )
    )
    return T.parse_interact(lines).select("chr", "start", "chr2", "start2", "end2", "score", "value", "color")


@query(
    "read_longrange",
    with_views(
        """SELECT chr1 AS chr, CASE WHEN chr1 = chr2 THEN least(start1, start2) ELSE start1 END AS start, CASE WHEN chr1 = chr2 THEN greatest(end1, end2) ELSE end1 END AS "end",
           chr2, start2, CAST(pid AS DOUBLE) AS score FROM pairs""",
        "pairs",
    ),
)
def read_longrange(spark, sf):
    p = V.pairs(spark, sf)
    mate = F.concat("chr2", F.lit(":"), s("start2"), F.lit("-"), s("end2"), F.lit(","), s("pid"))
    return T.parse_longrange(p.select(as_line("chr1", s("start1"), s("end1"), mate))).select("chr", "start", "end", "chr2", "start2", "score")


_P_TEXT = "CASE WHEN fid % 10 = 0 THEN 4.9e-324 ELSE CAST(cents AS DOUBLE) / 100000000 END"


def p_text():
    return F.when(F.col("fid") % 10 == 0, "1E-400").otherwise(s(F.col("cents") / 100_000_000))


def position_text():
    return F.when(F.col("fid") % 17 == 0, F.concat(s("start"), F.lit(";7"))).when(F.col("fid") % 19 == 0, F.concat(s("start"), F.lit(" x 9"))).otherwise(s(F.col("start") + 1))


GWAS_HEAD = ["CHR_ID", "CHR_POS", "SNP", "P-VALUE", "NOTE"]
QTL_HEAD = ["CHR", "SNP", "BP", "P", "Phenotype"]


def gwas(spark, sf):
    lines = feature_lines(spark, sf, "chr", position_text, lambda: F.concat(F.lit("rs"), s("fid")), p_text, lambda: F.lit("n"))
    return T.parse_gwas(lines, GWAS_HEAD)


def qtl(spark, sf):
    lines = feature_lines(
        spark, sf, "chr", lambda: F.concat(F.lit("rs"), s(F.col("cents") % 1000)), position_text, p_text, lambda: F.concat(F.lit("Gene"), s(F.col("sample") % 40))
    )
    return T.parse_qtl(lines, QTL_HEAD)


QTL_SQL = f"""q AS (SELECT chr, start, start + 1 AS "end", {_P_TEXT} AS p_value, 'rs' || (cents % 1000) AS snp, 'Gene' || (sample % 40) AS phenotype, fid
    FROM features WHERE fid % 17 <> 0 AND fid % 19 <> 0)"""


@query("read_gwas", with_views(f"""SELECT chr, start, start + 1 AS "end", {_P_TEXT} AS value, 'rs' || fid AS snp FROM features WHERE fid % 17 <> 0 AND fid % 19 <> 0""", "features"))
def read_gwas(spark, sf):
    return gwas(spark, sf).select("chr", "start", "end", "value", F.col("attributes")["SNP"].alias("snp"))


@query("read_qtl", with_views(f"""WITH {QTL_SQL} SELECT chr, start, "end", p_value, snp, phenotype FROM q""", "features"))
def read_qtl(spark, sf):
    return qtl(spark, sf).drop("attributes")


@query("read_gtex_gwas", with_views("""SELECT chr, start, "end", 'rs' || fid AS risk_allele, 'trait' AS phenotype, '8.00E-13' AS p_value FROM features""", "features"))
def read_gtex_gwas(spark, sf):
    c = lambda v: (lambda: F.lit(v))
    lines = feature_lines(spark, sf, "chr", lambda: s(F.col("start") + 1), "end", lambda: F.concat(F.lit("rs"), s("fid")), c("trait"), c("8.00E-13"), c("1.1"), c("99"))
    return T.parse_gtex_gwas(lines).select("chr", "start", "end", "risk_allele", "phenotype", "p_value")


def matrix(spark, sf):
    extra = lambda: F.when(F.col("fid") % 6 == 0, F.lit("9"))
    return T.parse_matrix(feature_lines(spark, sf, "chr", "start", "end", "cents", lambda: s(F.col("cents") / 2), extra), ["A", "B"])


@query("read_matrix", with_views("""SELECT chr, start, "end", CAST(cents AS DOUBLE) AS a, CAST(cents AS DOUBLE) / 2 AS b FROM features WHERE fid % 6 <> 0""", "features"))
def read_matrix(spark, sf):
    return matrix(spark, sf).select("chr", "start", "end", F.get("values", F.lit(0)).alias("a"), F.get("values", F.lit(1)).alias("b"))


@query(
    "melt_matrix",
    with_views(
        """SELECT chr, start, "end", 'A' AS sample, CAST(cents AS DOUBLE) AS value FROM features WHERE fid % 6 <> 0
           UNION ALL SELECT chr, start, "end", 'B', CAST(cents AS DOUBLE) / 2 FROM features WHERE fid % 6 <> 0""",
        "features",
    ),
)
def melt_matrix(spark, sf):
    return T.melt_matrix(matrix(spark, sf), ["A", "B"])


@query(
    "read_fusion",
    with_views(
        """SELECT 'fu' || fid AS name, CASE WHEN odd = 1 THEN least(start, start - 30) ELSE start END AS start,
           CASE WHEN odd = 1 THEN greatest("end", "end" + 900) ELSE "end" END AS "end", CASE WHEN odd = 1 THEN 2 ELSE 0 END AS n_spans FROM features""",
        "features",
    ),
)
def read_fusion(spark, sf):
    spans = lambda: F.concat(s(F.col("start") - 30), F.lit("-"), s(F.col("end") + 2), F.lit(","), s("start"), F.lit("-"), s(F.col("end") + 900))
    lines = feature_lines(spark, sf, "chr", lambda: F.concat(F.lit("fu"), s("fid")), "start", "end", lambda: F.lit("7"), lambda: s(F.col("odd") * 2), spans)
    return T.parse_fusion(lines).select("name", "start", "end", F.size("spans").alias("n_spans"))


@query(
    "read_bp",
    with_views(
        """SELECT chr, least(start, start + 4) AS start_left, start + 4 AS start_right, "end" + 100 AS end_left, "end" + 103 AS end_right, odd AS score,
           CASE odd WHEN 0 THEN 'rgb(1,2,3)' ELSE 'rgb(4,5,6)' END AS color, CASE odd WHEN 0 THEN 'low' ELSE 'high' END AS description FROM features""",
        "features",
    ),
)
def read_bp(spark, sf):
    f = V.spread(V.features(spark, sf), "fid")
    arcs = f.select(
        F.col("chr").alias("file"), F.lit(1).alias("part"), F.col("fid").alias("line"),
        as_line("chr", s(F.col("start") + 1), s(F.col("start") + 5), s(F.col("end") + 103), s(F.col("end") + 100), s("odd")),
    )
    heads = f.select(F.col("chr").alias("file")).distinct().select(
        "file", F.lit(0).alias("part"),
        F.inline(F.array(F.struct(F.lit(0).cast("long").alias("line"), F.lit("color:\t1\t2\t3\tlow").alias("value")), F.struct(F.lit(1).cast("long").alias("line"), F.lit("color:\t4\t5\t6\thigh").alias("value")))),
    )
    df = T.parse_bp(arcs.unionByName(heads))
    return df.select("chr", "start_left", "start_right", "end_left", "end_right", F.col("score").cast("int").alias("score"), "color", "description")


def fasta_lines(spark, sf):
    """Every document as a contig: one header, then its lines with other characters as ``n``."""
    d = V.table(spark, sf, "documents")
    lines = d.select(
        F.lit("docs").alias("file"), F.col("doc_id").alias("part"), F.posexplode(F.split("text", "\n")).alias("line", "value")
    ).select("file", "part", (F.col("line") + 1).cast("long").alias("line"), F.regexp_replace(F.lower("value"), "[^a-z]", "n").alias("value"))
    heads = d.select(
        F.lit("docs").alias("file"), F.col("doc_id").alias("part"), F.lit(0).cast("long").alias("line"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(">doc"), s("doc_id"), F.lit(":101-999 @len=500000"))).otherwise(F.concat(F.lit(">doc"), s("doc_id"), F.lit(" "), "lang")).alias("value"),
    )
    return lines.unionByName(heads)


_FASTA_SQL = r"""fl AS (SELECT doc_id, i, seq FROM (SELECT doc_id, generate_subscripts(l, 1) AS i, regexp_replace(lower(unnest(l)), '[^a-z]', 'n', 'g') AS seq
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d) x WHERE seq <> ''),
    fa AS (SELECT doc_id, 'doc' || doc_id AS chr, CASE WHEN doc_id % 4 = 0 THEN 100 ELSE 0 END + CAST(coalesce(sum(length(seq)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", seq FROM fl)"""


@query("read_fasta", f'WITH {_FASTA_SQL} SELECT chr, "offset", md5(seq) AS seq FROM fa')
def read_fasta(spark, sf):
    return SQ.parse_fasta(fasta_lines(spark, sf)).select("chr", "offset", F.md5(F.col("seq").cast("binary")).alias("seq"))


@query(
    "fasta_lengths",
    f"""WITH {_FASTA_SQL} SELECT chr, CASE WHEN doc_id % 4 = 0 THEN 500000 ELSE max("offset" + length(seq)) END AS length FROM fa GROUP BY chr, doc_id""",
)
def fasta_lengths(spark, sf):
    return SQ.fasta_lengths(SQ.parse_fasta(fasta_lines(spark, sf)))


def genbank_records(spark, sf):
    """Every order as a record with a source row, a gene and a joined coding row."""
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    a = F.col("o_custkey") + 1
    strand = F.when(k % 2 == 0, F.concat(F.lit("complement(join("), s(a), F.lit(".."), s(a + 9), F.lit(","), s(a + 20), F.lit(".."), s(a + 29), F.lit("))"))).otherwise(
        F.concat(F.lit("join("), s(a), F.lit(".."), s(a + 9), F.lit(",\n                     "), s(a + 20), F.lit(".."), s(a + 29), F.lit(")"))
    )
    pad = " " * 21
    text = F.concat(
        F.lit("LOCUS       L"), s(k), F.lit(" 90 bp DNA\nDEFINITION  x\nACCESSION   A"), s(k), F.lit("\nFEATURES             Location/Qualifiers\n     source          1..90\n" + pad + '/organism="x"\n     gene            '),
        s(a), F.lit(".."), s(a + 29), F.lit("\n" + pad + '/gene="G'), s(k), F.lit('"\n     CDS             '), strand, F.lit("\n" + pad + '/gene="G'), s(k),
        F.lit('"\n' + pad + '/note="two\n' + pad + 'lines"\nORIGIN\n        1 acgtacgtac gtacgtacgt\n       21 ttttt\n'),
    )
    return o.select(F.explode(F.array(text)).alias("value"))


@query("read_genbank", "SELECT 'A' || o_orderkey AS chr, 'L' || o_orderkey AS locus, 'acgtacgtacgtacgtacgtttttt' AS sequence FROM orders")
def read_genbank(spark, sf):
    return SQ.parse_genbank(genbank_records(spark, sf)).select("chr", "locus", "sequence")


@query(
    "genbank_features",
    """SELECT 'A' || o_orderkey AS chr, 'gene' AS type, '+' AS strand, o_custkey AS start, o_custkey + 30 AS "end", 'G' || o_orderkey AS gene, 0 AS n_exons FROM orders
       UNION ALL SELECT 'A' || o_orderkey, 'CDS', CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '+' END, o_custkey, o_custkey + 30, 'G' || o_orderkey, 2 FROM orders""",
)
def genbank_features(spark, sf):
    g = SQ.genbank_features(SQ.parse_genbank(genbank_records(spark, sf)))
    return g.select("chr", "type", "strand", "start", "end", F.col("attributes")["gene"].alias("gene"), F.coalesce(F.size("exons"), F.lit(0)).alias("n_exons"))


@query("read_aed", with_views("""SELECT chr, start, "end", 'n' || fid AS name, CAST(cents AS VARCHAR) AS value FROM features""", "features"))
def read_aed(spark, sf):
    head = ["bio:sequence(aed:String)", "bio:start(aed:Integer)", "bio:end(aed:Integer)", "aed:name(aed:String)", "aed:value(aed:Integer)"]
    raw = V.features(spark, sf).select("chr", s("start").alias("c1"), s("end").alias("c2"), F.concat(F.lit("n"), s("fid")).alias("c3"), s("cents").alias("c4"))
    a = SQ.shape_aed(raw, head)
    return a.select("chr", "start", "end", F.col("attributes")["aed:name"].alias("name"), F.col("attributes")["aed:value"].alias("value"))


def ordered(df, key, value):
    return df.select(F.lit("f").alias("file"), F.lit(0).alias("part"), F.col(key).alias("line"), value.alias("value"))


@query("read_chrom_sizes", "SELECT 'c' || c_custkey AS chr, row_number() OVER (ORDER BY c_custkey) - 1 AS ord, CAST(round(c_acctbal) AS BIGINT) + 100000 AS length FROM customer")
def read_chrom_sizes(spark, sf):
    c = V.table(spark, sf, "customer")
    text = F.concat_ws("\t", F.concat(F.lit("c"), s("c_custkey")), s(F.round("c_acctbal").cast("long") + 100_000))
    return T.parse_chrom_sizes(ordered(c, "c_custkey", text))


@query(
    "read_chrom_alias",
    """SELECT DISTINCT alias, canonical FROM (
         SELECT unnest([k, 'R' || k, upper(k), 'chr' || k, 'X' || k]) AS alias, k AS canonical FROM (SELECT 'c' || c_custkey AS k FROM customer) c
         UNION ALL SELECT upper(k[1:1]) || k[2:], k FROM (SELECT 'c' || c_custkey AS k FROM customer) c
         UNION ALL SELECT 'u' || k, k FROM (SELECT 'c' || c_custkey AS k FROM customer) c) x""",
)
def read_chrom_alias(spark, sf):
    from genospan.operators.genome import alias_table_from_records

    c = V.table(spark, sf, "customer")
    k = F.concat(F.lit("c"), s("c_custkey"))
    lines = c.select(as_line(F.concat(F.lit("R"), k), k, F.concat(F.lit("X"), k), F.concat(F.lit("u"), k)))
    known = c.select(k.alias("chr"))
    return alias_table_from_records(T.parse_chrom_alias(lines), known)


@query("read_cytobands", with_views("""SELECT chr, start, "end", 'p' || sample AS name, 'gneg' AS stain FROM features""", "features"))
def read_cytobands(spark, sf):
    return T.parse_cytobands(feature_lines(spark, sf, "chr", "start", "end", lambda: F.concat(F.lit("p"), s("sample")), lambda: F.lit("gneg")))


def sample_file(spark, sf):
    """Sample table and mapping sections in one file."""
    v = V.samples(spark, sf)
    part = lambda n: F.lit(n).alias("part")
    fixed = V.table(spark, sf, "region").select(F.min("r_regionkey").alias("z")).select(
        F.lit("f").alias("file"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(p).alias("part"), F.lit(n).cast("long").alias("line"), F.lit(t).alias("value"))
                    for p, n, t in ((0, 0, "#sampleTable"), (0, 1, "sample\tnation\tthe region\tbalance"), (2, 0, "#sampleMapping"))
                ]
            )
        ),
    )
    table = v.select(F.lit("f").alias("file"), part(1), F.col("sample").alias("line"), F.concat_ws("\t", s("sample"), "nation", F.when(F.col("sample") % 7 == 0, "").otherwise(F.col("region")), "balance").alias("value"))
    names = v.select(F.lit("f").alias("file"), part(3), F.col("sample").alias("line"), F.concat(F.lit("track"), s("sample"), F.lit("\t"), s("sample")).alias("value"))
    return table.unionByName(names).unionByName(fixed)


SAMPLES_SQL = """att AS (SELECT CAST(sample AS VARCHAR) AS sample, attribute, CASE WHEN try_cast(v AS DOUBLE) IS NULL THEN v END AS str_value, try_cast(v AS DOUBLE) AS num_value
    FROM (SELECT sample, 'nation' AS attribute, nation AS v FROM samples UNION ALL SELECT sample, 'the-region', CASE WHEN sample % 7 = 0 THEN '-' ELSE region END FROM samples
          UNION ALL SELECT sample, 'balance', balance FROM samples) a)"""


@query("read_sample_info", with_views(f"WITH {SAMPLES_SQL} SELECT * FROM att", "samples"))
def read_sample_info(spark, sf):
    return SM.parse_sample_info(sample_file(spark, sf))["attributes"]


@query("read_sample_mapping", with_views("SELECT 'track' || sample AS name, CAST(sample AS VARCHAR) AS sample FROM samples", "samples"))
def read_sample_mapping(spark, sf):
    return SM.parse_sample_info(sample_file(spark, sf))["mapping"]


@query("read_plink_fam", "SELECT 'F' || c_nationkey AS family_id, 'I' || c_custkey AS sample, '0' AS father_id, '1' AS sex FROM customer")
def read_plink_fam(spark, sf):
    c = V.table(spark, sf, "customer")
    lines = c.select(as_line(F.concat(F.lit("F"), s("c_nationkey")), F.concat(F.lit("I"), s("c_custkey")), F.lit("0"), F.lit("0"), F.lit("1"), F.lit("2"), sep=" "))
    return SM.parse_plink_fam(lines).select("family_id", "sample", "father_id", "sex")


@query("read_custom", with_views("""SELECT chr, start, start + 1 AS "end", CAST(sample AS VARCHAR) AS trait FROM features""", "features"))
def read_custom(spark, sf):
    return T.parse_custom(feature_lines(spark, sf, "sample", "chr", lambda: s(F.col("start") + 1)), ["trait", "chr", "start"], coords=1)


@query("registered_format", with_views("""SELECT chr, start, "end", CAST(cents AS VARCHAR) AS length FROM features""", "features"))
def registered_format(spark, sf):
    c = [lambda: F.lit("1")] * 5
    lines = feature_lines(spark, sf, lambda: F.lit("585"), "chr", "start", "end", lambda: F.lit("CpG"), "cents", *c)
    return T.parse_custom(lines, "cpgislandext").select("chr", "start", "end", "length")


@query("from_rows", with_views("SELECT CASE WHEN chr = 'AF' THEN 'chr1' ELSE chr END AS chr, start, cents AS value FROM features", "features"))
def from_rows(spark, sf):
    from genospan.operators.genome import alias_table

    rows = V.features(spark, sf).select("chr", "start", "cents")
    return T.from_rows(rows, alias_table(spark, [("AF", "chr1")]), {"cents": "value"})


@query("decode_callback", with_views("SELECT chr, start, cents * 2 AS doubled FROM features", "features"))
def decode_callback(spark, sf):
    def decode(frames):
        for pdf in frames:
            parts = pdf["value"].str.split("\t", expand=True)
            yield parts.rename(columns={0: "chr", 1: "start", 2: "doubled"}).astype({"start": "int64", "doubled": "int64"}).assign(doubled=lambda d: d["doubled"] * 2)

    return T.decode_with(feature_lines(spark, sf, "chr", "start", "cents"), decode, "chr string, start long, doubled long")


@query("write_bed", with_views("""SELECT concat_ws(chr(9), chr, start, "end", CASE WHEN odd = 1 THEN '.' ELSE 'n' || fid END) AS value FROM features""", "features"))
def write_bed(spark, sf):
    f = V.features(spark, sf).withColumn("name", F.when(F.col("odd") == 0, F.concat(F.lit("n"), s("fid"))))
    return K.bed_text(f.select("chr", "start", "end", "name"))
