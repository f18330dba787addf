"""Copy number from depths: line items stand in for variant calls of a single sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from genospan.operators import copynumber as C
from genospan.plans import views as V
from genospan.plans.registry import query
from genospan.plans.views import with_views

BIN = 10_000


def snps(spark, sf):
    """Depth 100 to 149 with a dip in one stretch; every second row is heterozygous."""
    f = V.spread(V.features(spark, sf), "fid")
    dip = F.when((F.col("start") >= 200_000) & (F.col("start") < 260_000), 0.5).otherwise(1.0)
    dp = F.floor((100 + F.col("cents") % 50) * dip)
    return f.select(
        "chr", "start", dp.alias("dp"), (F.col("odd") == 1).alias("is_het"),
        (F.col("cents") % 9 + 1).alias("ref_depth"), (F.col("sample") % 7 + 2).alias("alt_depth"),
    )


_SNPS = """sn AS (SELECT chr, start, CAST(floor((100 + cents % 50) * CASE WHEN start >= 200000 AND start < 260000 THEN 0.5 ELSE 1.0 END) AS BIGINT) AS dp, odd = 1 AS is_het,
      cents % 9 + 1 AS ref_depth, sample % 7 + 2 AS alt_depth FROM features),
    bn AS (SELECT chr, start // 10000 * 10000 AS start, CAST(sum(dp) AS BIGINT) AS dp_sum, count(*) AS dp_count, count(*) FILTER (is_het) AS het_count FROM sn GROUP BY 1, 2)"""


def bins(spark, sf):
    return C.snp_depth_bins(snps(spark, sf), BIN)


def fit(spark, sf):
    return C.rd_histogram_fit(bins(spark, sf))


@query(
    "snp_depth_bins",
    with_views(f"""WITH {_SNPS} SELECT chr, start, start + 10000 AS "end", dp_sum, dp_count, het_count, round(dp_sum / dp_count * (10000.0 / 150), 6) AS score FROM bn""", "features"),
)
def snp_depth_bins(spark, sf):
    return bins(spark, sf).withColumn("score", F.round("score", 6))


@query(
    "rebin",
    with_views(
        f"""WITH {_SNPS} SELECT chr, start // 30000 * 30000 AS start, CAST(sum(dp_sum) AS BIGINT) AS dp_sum, round(sum(dp_sum) / sum(dp_count) * (30000.0 / 150), 6) AS score FROM bn GROUP BY 1, 2""",
        "features",
    ),
)
def rebin(spark, sf):
    return C.rebin(bins(spark, sf), 30_000).select("chr", "start", "dp_sum", F.round("score", 6).alias("score"))


_LL = """ll AS (SELECT chr, start // 10000 * 10000 AS start, ix, sum(CASE WHEN ix IN (0, 99) THEN CAST('-inf' AS DOUBLE) ELSE
      ln(pow(p, ref_depth) * pow(1 - p, alt_depth) + pow(p, alt_depth) * pow(1 - p, ref_depth)) END) AS ll
      FROM (SELECT *, ix / 99.0::DOUBLE AS p FROM (SELECT *, unnest(range(100)) AS ix FROM sn WHERE is_het) a) b GROUP BY 1, 2, 3)"""


@query(
    "baf_likelihood",
    with_views(f"WITH {_SNPS}, {_LL} SELECT chr, start, CAST(ix AS INT) AS ix, round(ll, 4) AS ll FROM ll", "features"),
)
def baf_likelihood(spark, sf):
    ll = C.baf_likelihood(snps(spark, sf), BIN)
    return ll.select("chr", "start", "ix", F.round("ll", 4).alias("ll"))


@query(
    "baf_levels",
    with_views(
        f"""WITH {_SNPS}, {_LL}, t AS (SELECT chr, start, arg_max(ix, (round(ll, 9), -ix)) AS ix FROM ll GROUP BY 1, 2)
            SELECT chr, start, greatest(ix / 100, 1 - ix / 100) AS baf, least(ix / 100, 1 - ix / 100) AS baf_min FROM t""",
        "features",
    ),
)
def baf_levels(spark, sf):
    return C.baf_levels(C.baf_likelihood(snps(spark, sf), BIN))


@query(
    "baf_tracks",
    with_views(
        f"""WITH {_SNPS}, {_LL}, t AS (SELECT chr, start, arg_max(ix, (round(ll, 9), -ix)) AS ix FROM ll GROUP BY 1, 2),
            b AS (SELECT chr, start, greatest(ix / 100, 1 - ix / 100) AS baf FROM t)
            SELECT chr, start, 'baf1' AS track, round(-baf, 6) AS value FROM b UNION ALL SELECT chr, start, 'baf2', round(baf - 1, 6) FROM b WHERE baf <> 0.5""",
        "features",
    ),
)
def baf_tracks(spark, sf):
    tracks = C.baf_tracks(C.baf_levels(C.baf_likelihood(snps(spark, sf), BIN)))
    return tracks.withColumn("value", F.round("value", 6))


@query(
    "score_histogram",
    with_views(
        f"""WITH {_SNPS}, sc AS (SELECT dp_sum / dp_count * (10000.0 / 150) AS score FROM bn), m AS (SELECT greatest(floor(max(score) / 1000), 1) AS w FROM sc)
            SELECT CAST(floor(score / w) * w AS BIGINT) AS x, CAST(count(*) AS DOUBLE) AS y FROM sc, m WHERE score > 0 GROUP BY 1""",
        "features",
    ),
)
def score_histogram(spark, sf):
    return C.score_histogram(bins(spark, sf)).select(F.col("x").cast("long").alias("x"), "y")


@query("rd_histogram_fit")
def rd_histogram_fit(spark, sf):
    return fit(spark, sf)


def gc_table(spark, sf):
    """Base counts of every 10 kb bin that holds data."""
    f = V.features(spark, sf)
    return f.groupBy("chr", (F.floor(F.col("start") / BIN) * BIN).alias("start")).agg(
        F.sum(F.col("cents") % 60 + 20).alias("gc_count"), F.sum(F.col("cents") % 70 + 20).alias("at_count")
    )


_GC = """gc AS (SELECT chr, start // 10000 * 10000 AS start, CAST(floor(sum(cents % 60 + 20) * 100 / sum(cents % 60 + 20 + cents % 70 + 20) + 0.5) AS INT) AS gc FROM features GROUP BY 1, 2)"""


@query("attach_gc", with_views(f"WITH {_SNPS}, {_GC} SELECT chr, start, gc FROM bn JOIN gc USING (chr, start)", "features"))
def attach_gc(spark, sf):
    return C.attach_gc(bins(spark, sf), gc_table(spark, sf), BIN).select("chr", "start", "gc")


@query("gc_correct")
def gc_correct(spark, sf):
    b = C.attach_gc(bins(spark, sf), gc_table(spark, sf), BIN)
    return C.gc_correct(b, fit(spark, sf)).select("chr", "start", "gc", "corrected")


@query("copy_number_tracks")
def copy_number_tracks(spark, sf):
    return C.copy_number_tracks(bins(spark, sf), fit(spark, sf)).select("chr", "start", "value")


@query("meanshift_segments")
def meanshift_segments(spark, sf):
    return C.meanshift_segments(bins(spark, sf), fit(spark, sf), BIN)


@query("combined_segments")
def combined_segments(spark, sf):
    s = snps(spark, sf)
    return C.combined_segments(bins(spark, sf), C.baf_likelihood(s, BIN), fit(spark, sf), BIN)


@query("cnv_calls")
def cnv_calls(spark, sf):
    stats = fit(spark, sf)
    return C.cnv_calls(C.meanshift_segments(bins(spark, sf), stats, BIN), stats, BIN)
