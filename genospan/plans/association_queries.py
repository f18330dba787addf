"""Associations, contacts, interactions and splice junctions."""

from __future__ import annotations

from pyspark.sql import functions as F

from genospan.functions.variants import minus_log10
from genospan.operators import annotation as AN
from genospan.operators import association as O
from genospan.operators import genome as G
from genospan.operators import sampling as S
from genospan.operators import variants as OV
from genospan.plans import views as V
from genospan.plans.format_queries import QTL_SQL, gwas, qtl
from genospan.plans.read_queries import reads, sam_sql
from genospan.plans.registry import query
from genospan.plans.views import with_views
from genospan.sources.tables import interchrom_duplicates, sort_by_score


def qtl_sql(body):
    return with_views(f"WITH {QTL_SQL} {body}", "features")


@query("minus_log10", qtl_sql("SELECT fid, round(-log10(p_value), 6) AS v FROM q"))
def p_values(spark, sf):
    g = gwas(spark, sf).withColumn("fid", F.regexp_extract(F.col("attributes")["SNP"], r"(\d+)", 1).cast("long"))
    return g.select("fid", F.round(minus_log10(F.col("value")), 6).alias("v"))


@query("qtl_match", qtl_sql("""SELECT chr, start, snp, phenotype FROM q WHERE (upper(snp) = 'GENE3' OR upper(phenotype) = 'GENE3') AND -log10(p_value) > 1.5"""))
def qtl_match(spark, sf):
    return O.qtl_match(qtl(spark, sf), " gene3 ", 1.5).select("chr", "start", "snp", "phenotype")


_NAMES = """nm AS (SELECT key, chr, start, "end" FROM (SELECT 'GENE' || (sample % 40) AS key, chr, start, "end", fid,
      row_number() OVER (PARTITION BY sample % 40 ORDER BY "end" - start DESC, fid DESC) AS i FROM features) x WHERE i = 1)"""


def names(spark, sf):
    f = V.features(spark, sf).withColumn("name", F.concat(F.lit("Gene"), (F.col("sample") % 40).cast("string")))
    return AN.name_index(f, ["name"], ["fid"])


@query("name_index", with_views(f"WITH {_NAMES} SELECT * FROM nm", "features"))
def name_index(spark, sf):
    return names(spark, sf)


@query(
    "expand_qtl_region",
    qtl_sql(
        f""", h AS (SELECT * FROM q WHERE upper(phenotype) = 'GENE3' OR upper(snp) = 'GENE3'), {_NAMES},
        a AS (SELECT chr, start, "end" FROM h UNION ALL SELECT nm.chr, nm.start, nm."end" FROM nm JOIN (SELECT DISTINCT chr, upper(phenotype) AS p FROM h) d ON nm.key = d.p AND nm.chr = d.chr),
        s AS (SELECT chr, min(start) AS s, max("end") AS e FROM a GROUP BY 1)
        SELECT chr, greatest(0, s - CAST(floor((e - s) * 0.1) AS BIGINT)) AS start, e + CAST(floor((e - s) * 0.1) AS BIGINT) AS "end" FROM s"""
    ),
)
def expand_qtl_region(spark, sf):
    return O.expand_qtl_region(O.qtl_match(qtl(spark, sf), "gene3"), names(spark, sf))


@query(
    "qtl_axis_max",
    qtl_sql(
        """SELECT chr, round(greatest(10.0::DOUBLE, max(v)), 6) AS axis_max FROM (SELECT chr, -log10(p_value) AS v, row_number() OVER (PARTITION BY chr ORDER BY -log10(p_value)) - 1 AS i,
             count(*) OVER (PARTITION BY chr) AS n FROM q) x WHERE i = CAST(floor(n * 0.98) AS BIGINT) GROUP BY 1"""
    ),
)
def qtl_axis_max(spark, sf):
    return O.qtl_axis_max(qtl(spark, sf), 98, ["chr"]).withColumn("axis_max", F.round("axis_max", 6))


# Contacts: feature counts between 2,000-base bins of a feature's start and of another feature of the same order.
_CONTACTS = """ct AS (SELECT chr, least(b1, b2) AS bin1, greatest(b1, b2) AS bin2, CAST(count(*) AS DOUBLE) AS counts
      FROM (SELECT chr, start // 2000 AS b1, (start + cents % 90000) // 2000 AS b2 FROM features) x GROUP BY 1, 2, 3),
    nv AS (SELECT chr, bin, CASE WHEN bin % 11 = 0 THEN 0.0 ELSE (bin % 4 + 1) / 2.0 END::DOUBLE AS nv FROM (SELECT chr, bin1 AS bin FROM ct UNION SELECT chr, bin2 FROM ct) b),
    vl AS (SELECT ct.*, counts / (a.nv * b.nv) AS value FROM ct JOIN nv a ON a.chr = ct.chr AND a.bin = bin1 JOIN nv b ON b.chr = ct.chr AND b.bin = bin2 WHERE a.nv * b.nv <> 0),
    rk AS (SELECT chr, value, row_number() OVER (PARTITION BY chr ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY chr) AS n FROM vl WHERE abs(bin1 - bin2) > 5),
    kk AS (SELECT DISTINCT chr, n, CAST(floor(n * 0.8) AS BIGINT) AS k FROM rk),
    th AS (SELECT kk.chr, CASE WHEN kk.n >= 1000 THEN max(CASE WHEN i = k THEN value END) ELSE 0.0 END AS threshold,
             CASE WHEN kk.n >= 1000 THEN max(CASE WHEN i = k + CAST(floor((kk.n - k) * 0.05) AS BIGINT) THEN value END) END AS low,
             CASE WHEN kk.n >= 1000 THEN max(CASE WHEN i = k + CAST(floor((kk.n - k) * 0.95) AS BIGINT) THEN value END) END AS high
           FROM kk JOIN rk ON rk.chr = kk.chr GROUP BY kk.chr, kk.n)"""


def contact_sql(body):
    return with_views(f"WITH {_CONTACTS} {body}", "features")


def contacts(spark, sf):
    f = V.features(spark, sf)
    a, b = F.floor(F.col("start") / 2000), F.floor((F.col("start") + F.col("cents") % 90_000) / 2000)
    counted = f.groupBy("chr", F.least(a, b).alias("bin1"), F.greatest(a, b).alias("bin2")).agg(F.count(F.lit(1)).cast("double").alias("counts"))
    bins = counted.select("chr", F.explode(F.array("bin1", "bin2")).alias("bin")).distinct()
    nv = F.when(F.col("bin") % 11 == 0, 0.0).otherwise((F.col("bin") % 4 + 1) / 2)
    return O.normalize_contacts(counted, bins.withColumn("nv", nv))


@query("normalize_contacts", contact_sql("SELECT chr, bin1, bin2, counts, value FROM vl"))
def normalize_contacts(spark, sf):
    return contacts(spark, sf)


@query("contact_percentiles", contact_sql("SELECT chr, threshold, low, high FROM th"))
def contact_percentiles(spark, sf):
    return O.contact_percentiles(O.off_diagonal(contacts(spark, sf)), ["chr"])


@query(
    "contact_filter",
    contact_sql(
        """SELECT chr, bin1, bin2, bin1 * 2000 AS start, bin2 * 2000 + 2000 AS "end", value,
             CAST(CASE WHEN low IS NULL THEN NULL WHEN high > low THEN floor(200 + least(greatest((value - low) / (high - low), 0.0), 1.0) * 600 + 0.5) ELSE 800 END AS INT) AS score
           FROM vl JOIN th USING (chr) WHERE abs(bin1 - bin2) > 5 AND value >= threshold"""
    ),
)
def contact_filter(spark, sf):
    return O.contact_filter(contacts(spark, sf), 2000)


@query(
    "interchrom_duplicates",
    with_views(
        """SELECT pid, chr1 AS chr, least(start1, start2) AS start, greatest(end1, end2) AS "end", FALSE AS dup FROM pairs WHERE chr1 = chr2
           UNION ALL SELECT pid, chr1, start1, end1, FALSE FROM pairs WHERE chr1 <> chr2 UNION ALL SELECT pid, chr2, start2, end2, TRUE FROM pairs WHERE chr1 <> chr2""",
        "pairs",
    ),
)
def duplicates(spark, sf):
    return interchrom_duplicates(V.pairs(spark, sf)).select("pid", "chr", "start", "end", "dup")


_MID = "least(start1 + end1, start2 + end2) / 2.0 AS m1, greatest(start1 + end1, start2 + end2) / 2.0 AS m2"


@query("interaction_filter", with_views(f"SELECT pid FROM (SELECT *, {_MID} FROM pairs) p WHERE score BETWEEN 100000 AND 400000 AND m1 >= 12000 AND m2 <= 30000", "pairs"))
def interaction_filter(spark, sf):
    p = V.pairs(spark, sf).withColumn("value", F.col("score"))
    return O.interaction_filter(p, 100_000, 400_000, "inView", 12_000, 30_000).select("pid")


@query(
    "interaction_filter_partial",
    with_views(f"SELECT pid FROM (SELECT *, {_MID} FROM pairs) p WHERE score BETWEEN 100000 AND 400000 AND ((m1 BETWEEN 12000 AND 20000) OR (m2 BETWEEN 12000 AND 20000))", "pairs"),
)
def interaction_filter_partial(spark, sf):
    p = V.pairs(spark, sf).withColumn("value", F.col("score"))
    return O.interaction_filter(p, 100_000, 400_000, "partialInView", 12_000, 20_000).select("pid")


@query(
    "interaction_wg_sample",
    with_views(
        """WITH off AS (SELECT chr, coalesce(sum(length) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
              FROM (SELECT chr1 AS chr, max(end1) + 1 AS length FROM pairs GROUP BY 1) c),
            tot AS (SELECT count(*) AS n, max(score) AS top FROM pairs),
            cls AS (SELECT p.*, n > 500 AND top > 0 AS split, CASE WHEN n > 500 AND top > 0 AND score > 0
              THEN greatest(0, least(4, coalesce(floor(ln(score) / nullif(ln(top) / 5, 0)), 0))) ELSE 0 END AS stratum FROM pairs p, tot),
            rnk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', '0', pid)), pid) AS i,
              row_number() OVER (ORDER BY score DESC NULLS LAST, pid) AS best FROM cls),
            got AS (SELECT * FROM rnk WHERE i <= CASE WHEN split THEN 100 ELSE 500 END OR (split AND best = 1))
            SELECT pid, CAST(a.o + start1 AS BIGINT) AS wg_start, CAST(b.o + end2 AS BIGINT) AS wg_end, score
            FROM got JOIN off a ON a.chr = chr1 JOIN off b ON b.chr = chr2 ORDER BY md5(concat_ws('|', '0', pid)), pid LIMIT 501""",
        "pairs",
    ),
)
def interaction_wg_sample(spark, sf):
    from pyspark.sql import Window

    p = V.pairs(spark, sf).withColumn("dup", F.lit(False))
    sizes = p.groupBy(F.col("chr1").alias("chr")).agg((F.max("end1") + 1).alias("length"))
    off = G.genome_offsets(sizes.withColumn("ord", F.row_number().over(Window.orderBy("chr"))))
    return S.interaction_wg_sample(p, off, ["pid"], limit=500).select("pid", "wg_start", "wg_end", "score")


@query("sort_by_score", with_views("SELECT pid, score FROM pairs", "pairs"))
def score_order(spark, sf):
    return sort_by_score(V.pairs(spark, sf)).select("pid", "score")


@query(
    "pair_feature_chords",
    with_views(
        """SELECT chr1 || ':' || start1 || '-' || end1 || '_' || chr2 || ':' || start2 || '-' || end2 AS id, chr1 AS chr, start1 AS start, chr2 AS mate_chr, end2 AS mate_end FROM pairs""", "pairs"
    ),
)
def pair_feature_chords(spark, sf):
    return OV.pair_feature_chords(V.pairs(spark, sf)).select("id", "chr", "start", "mate_chr", "mate_end")


@query("pair_chords", sam_sql('SELECT read_name AS id, chr, start, "end", mate_chr, mate_pos AS mate_start, mate_pos + 1 AS mate_end FROM rd'))
def pair_chords(spark, sf):
    return OV.pair_chords(reads(spark, sf))


@query(
    "split_read_chords",
    sam_sql(
        """SELECT read_name || '_0' AS id, chr, start, 'RO' AS mate_chr, start + 7 AS mate_start, start + 13 + q AS mate_end FROM rd WHERE sa IS NOT NULL
           UNION ALL SELECT read_name || '_1', chr, start, 'NF', 5, 15 FROM rd WHERE sa IS NOT NULL"""
    ),
)
def split_read_chords(spark, sf):
    return OV.split_read_chords(reads(spark, sf)).select("id", "chr", "start", "mate_chr", "mate_start", "mate_end")


@query(
    "splice_junction_filter",
    with_views(
        """SELECT fid FROM features WHERE odd = 1 AND sample % 5 <> 2 AND cents % 100 >= 20 AND cents % 100 + sample % 30 >= 30
             AND (sample % 30) <= 0.4 * (cents % 100 + sample % 30) AND fid % 13 >= 3
             AND (CASE WHEN start BETWEEN 150000 AND 250000 THEN 1 ELSE 0 END + CASE WHEN "end" BETWEEN 150000 AND 250000 THEN 1 ELSE 0 END) >= 1""",
        "features",
    ),
)
def splice_junctions(spark, sf):
    t = lambda c: c.cast("string")
    j = V.features(spark, sf).withColumn(
        "attributes",
        F.create_map(
            F.lit("annotated_junction"), F.when(F.col("odd") == 1, "true").otherwise("false"),
            F.lit("motif"), F.when(F.col("sample") % 5 == 2, "non-canonical").otherwise("GT/AG"),
            F.lit("uniquely_mapped"), t(F.col("cents") % 100), F.lit("multi_mapped"), t(F.col("sample") % 30),
            F.lit("maximum_spliced_alignment_overhang"), t(F.col("fid") % 13),
        ),
    ).withColumn("strand", F.lit("+"))
    kept = O.splice_junction_filter(
        j, hide_unannotated=True, hide_motifs=["non-canonical"], hide_strand="-", min_ends_visible=1, window=(150_000, 250_000),
        min_unique=20, min_total=30, max_multi_fraction=0.4, min_overhang=3,
    )
    return kept.select("fid")
