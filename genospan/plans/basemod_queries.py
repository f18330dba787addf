"""Base modifications on reads whose MM and ML tags are derived from the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from genospan.operators import basemods as B
from genospan.operators import reads as O
from genospan.plans.read_queries import reads, sam_sql
from genospan.plans.registry import query
from genospan.sources.sam import with_parts


def modified(spark, sf):
    """Reads with a first modified C after ``mq % 3`` others, and the one after it.

    The tag values depend on mapping quality only, so that SQL can restate them.
    """
    r = reads(spark, sf)
    skip = (F.col("mq") % 3).cast("string")
    mm = F.concat(F.lit("C+m?,"), skip, F.lit(",0;"))
    ml = F.concat(F.lit("C,"), (F.col("mq") * 4).cast("string"), F.lit(",200"))
    tagged = r.withColumn("tags", F.map_concat("tags", F.create_map(F.lit("MM"), mm, F.lit("ML"), ml)))
    return with_parts(tagged)


# On forward reads the n-th C of the sequence, on reverse reads the n-th G from the right.
_CS = """cs AS (SELECT * FROM (SELECT *, CASE WHEN flags & 16 = 0 THEN row_number() OVER (PARTITION BY fid ORDER BY j) ELSE row_number() OVER (PARTITION BY fid ORDER BY j DESC) END - 1 AS nth
      FROM (SELECT *, unnest(range(length(seq))) AS j FROM rd) x
      WHERE substr(seq, CAST(j + 1 AS INT), 1) = CASE WHEN flags & 16 = 0 THEN 'C' ELSE 'G' END) y WHERE nth = mq % 3 OR nth = mq % 3 + 1)"""


@query(
    "parse_base_mods",
    sam_sql(f", {_CS} SELECT CAST(fid AS VARCHAR) AS read_id, 'm' AS mod, CAST(j AS INT) AS read_idx, CAST(CASE WHEN nth = mq % 3 THEN mq * 4 ELSE 200 END AS INT) AS likelihood FROM cs"),
)
def parse_base_mods(spark, sf):
    return B.parse_base_mods(modified(spark, sf), "fid").select("read_id", "mod", "read_idx", "likelihood")


# Read index to position for the three shapes of CIGAR in the read view.
_POS = """CASE WHEN ln % 4 = 1 AND j < 3 THEN NULL WHEN ln % 4 = 1 AND j < q + 3 THEN start + j - 3 WHEN ln % 4 = 1 THEN start + j - 1
    WHEN j < q THEN start + j WHEN ln % 4 = 2 AND j = q THEN NULL WHEN ln % 4 = 2 THEN start + j - 1 WHEN ln % 4 = 3 THEN start + j + 100 ELSE start + j END"""
_CALLS = f"""{_CS}, cl AS (SELECT chr, {_POS} AS pos, CASE WHEN nth = mq % 3 THEN mq * 4 ELSE 200 END AS lh FROM cs)"""


@query(
    "base_mod_counts",
    sam_sql(
        f""", {_CALLS} SELECT chr, pos, 'm' AS mod, count(*) AS n, CAST(count(*) FILTER (lh >= 127.5) AS BIGINT) AS count,
            CAST(coalesce(sum(lh) FILTER (lh >= 127.5), 0) AS BIGINT) AS likelihood_sum FROM cl WHERE pos IS NOT NULL GROUP BY 1, 2"""
    ),
)
def base_mod_counts(spark, sf):
    return B.base_mod_counts(B.base_mod_calls(modified(spark, sf), "fid")).select("chr", "pos", "mod", "n", "count", "likelihood_sum")


@query(
    "base_mod_counts_two_color",
    sam_sql(
        f""", {_CALLS} SELECT chr, pos, CASE WHEN 255 - lh > lh THEN 'NONE_C' ELSE 'm' END AS mod, count(*) AS n,
            round(avg(CASE WHEN greatest(lh, 255 - lh) >= 127.5 THEN greatest(lh, 255 - lh) END) * 100 / 255, 6) AS average_percent
            FROM cl WHERE pos IS NOT NULL GROUP BY 1, 2, 3"""
    ),
)
def base_mod_counts_two_color(spark, sf):
    c = B.base_mod_counts(B.base_mod_calls(modified(spark, sf), "fid"), include_no_mods=True)
    return c.select("chr", "pos", "mod", "n", F.round("average_percent", 6).alias("average_percent"))


@query("simplex_mods", sam_sql(" SELECT unnest(['m', 'NONE_C']) AS mod FROM (SELECT count(*) AS n FROM rd) x"))
def simplex_mods(spark, sf):
    return B.simplex_mods(B.mod_kinds(modified(spark, sf), "fid"))


@query(
    "mod_fraction",
    sam_sql(
        f""", {_CALLS}, mc AS (SELECT chr, pos, count(*) FILTER (lh >= 127.5) AS k FROM cl WHERE pos IS NOT NULL GROUP BY 1, 2),
        bq AS (SELECT b.chr, b.pos, count(*) AS total, count(*) FILTER (b.base IN ('C', 'G')) AS mb,
                 count(*) FILTER ((b.base = 'C' AND b.flags & 16 = 0) OR (b.base = 'G' AND b.flags & 16 <> 0)) AS det FROM bs b GROUP BY 1, 2)
        SELECT chr, pos, round((mb / total) * (k / det), 6) AS fraction FROM mc JOIN bq USING (chr, pos) WHERE det > 0 AND k > 0"""
    ),
)
def mod_fraction(spark, sf):
    m = modified(spark, sf)
    counts = B.base_mod_counts(B.base_mod_calls(m, "fid"))
    pile = O.pileup(O.read_filter(m))
    simplex = B.simplex_mods(B.mod_kinds(m, "fid"))
    return B.mod_fraction(counts, pile, simplex).select("chr", "pos", F.round("fraction", 6).alias("fraction"))
