"""Interval views over the benchmark tables, for Spark and as SQL text.

The benchmark tables hold no genomics.  Each view reads a whole table and gives
it the shape of an interval data set.  One text per view serves both engines;
only quoting and the day / second functions differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genospan.scale import block_of, ordered_scan

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# Fixed value: the chromosome names the line items produce.
CHROMS = ["AF", "NF", "NO", "RF", "AO", "RO"]

_CHROM_CASE = "CASE {k} % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CHROMS)) + " END"
_START = "DAYS(l_shipdate) * 100 + l_orderkey % 100"
_FID = (
    "((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000"
    " + (l_suppkey * 50 + CAST(l_quantity AS BIGINT)) % 10000"
)
_Q = "CAST(l_quantity AS BIGINT)"
_HEX = "concat(md5(CAST({fid} AS VARCHAR(40))), md5(concat('x', CAST({fid} AS VARCHAR(40)))))"

VIEW_SQL = {
    "features": f"""
        SELECT concat(l_returnflag, l_linestatus) AS chr, {_START} AS start, {_START} + {_Q} AS @end,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_suppkey AS sample,
               l_linenumber % 2 AS odd, {_FID} AS fid
        FROM lineitem""",
    "regions": f"""
        SELECT {_CHROM_CASE.format(k='p_partkey')} AS chr, 105000 + (p_partkey * 7919) % 255000 AS start,
               105000 + (p_partkey * 7919) % 255000 + p_partkey % 37 * 10 + 5 AS @end, p_partkey AS region_id
        FROM part""",
    "signal": """
        SELECT chr, start, @end, value FROM (
            SELECT chr, start, coalesce(least(lead(start) OVER (PARTITION BY chr ORDER BY start), start + 600), start + 600) AS @end,
                   CAST(cents AS DOUBLE) AS value
            FROM (SELECT event_type AS chr, SECONDS(ts) AS start, max(CAST(round(value * 100) AS BIGINT)) AS cents
                  FROM events GROUP BY 1, 2) d) s""",
    "pairs": """
        SELECT chr1, start1, start1 + 5 + pid % 7 AS end1, chr2, start2, start2 + 5 + o_custkey % 11 AS end2,
               cents / CAST(100 AS DOUBLE) AS score, pid
        FROM (SELECT o_custkey, o_orderkey AS pid, o_orderstatus AS chr1, DAYS(o_orderdate) * 10 AS start1,
                     CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
                     coalesce(lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderstatus) AS chr2,
                     coalesce(lead(DAYS(o_orderdate) * 10) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), DAYS(o_orderdate) * 10 + 300) AS start2
              FROM orders) o""",
    "samples": """
        SELECT s_suppkey AS sample, n_name AS nation, CAST(n_regionkey AS VARCHAR(10)) AS region,
               CASE WHEN s_suppkey % 10 = 3 THEN 'unknown'
                    ELSE CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS VARCHAR(20)) END AS balance
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "calls": f"""
        SELECT concat(l_returnflag, l_linestatus) AS chr, {_START} AS start, {_START} + {_Q} AS @end,
               l_suppkey AS sample, {_FID} AS fid,
               concat(CAST(CAST(round(l_discount * 100) AS INT) % 2 AS VARCHAR(4)), '/',
                      CASE WHEN CAST(round(l_tax * 100) AS INT) % 3 = 2 THEN '.'
                           ELSE CAST(CAST(round(l_tax * 100) AS INT) % 3 AS VARCHAR(4)) END) AS gt
        FROM lineitem""",
    "chrom_sizes": f"""
        SELECT chr, max(e) AS length FROM (
            SELECT concat(l_returnflag, l_linestatus) AS chr, {_START} + {_Q} AS e FROM lineitem) f
        GROUP BY chr""",
    "sam": f"""
        SELECT fid, chr, start, q, ln, concat('r', CAST(l_orderkey * 4 + (ln - 1 - (ln - 1) % 2) / 2 AS VARCHAR(40))) AS read_name,
               1 + CASE WHEN ln % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN l_partkey % 2 = 1 THEN 16 ELSE 0 END
                 + CASE WHEN l_suppkey % 2 = 1 THEN 32 ELSE 0 END + CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 0 END
                 + CASE WHEN l_suppkey % 50 = 0 THEN 1024 ELSE 0 END + CASE WHEN l_partkey % 41 = 0 THEN 256 ELSE 0 END
                 + CASE WHEN l_partkey % 53 = 0 THEN 512 ELSE 0 END + CASE WHEN l_partkey % 59 = 0 THEN 4 ELSE 0 END
                 + CASE WHEN l_suppkey % 43 = 0 THEN 8 ELSE 0 END + CASE WHEN l_partkey % 61 = 0 THEN 2048 ELSE 0 END AS flags,
               l_partkey % 61 AS mq,
               concat(CASE WHEN ln % 4 = 1 THEN '3S' ELSE '' END, CAST(q AS VARCHAR(10)),
                      CASE ln % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'M2D5M' WHEN 2 THEN 'M1I4M' ELSE 'M100N6M' END) AS cigar,
               CASE WHEN l_suppkey % 10 = 0 THEN 'AF' ELSE '=' END AS rnext,
               start + 1 + l_partkey % 500 AS pnext,
               CASE WHEN l_partkey % 17 = 0 THEN 0 WHEN ln % 2 = 1 THEN l_partkey % 500 + 50 ELSE -(l_partkey % 500) - 50 END AS tlen,
               substr(translate(hex, '0123456789abcdef', 'ACGTACGTACGTACGN'), 1, CAST(seqlen AS INT)) AS seq,
               substr(translate(hex, '0123456789abcdef', 'ABCDEFGHIJKLMNOP'), 1, CAST(seqlen AS INT)) AS qual,
               concat('g', CAST(l_suppkey % 3 AS VARCHAR(4))) AS rg,
               CASE WHEN l_partkey % 37 = 0 THEN concat('RO,', CAST(start + 7 AS VARCHAR(20)), ',+,', CAST(q AS VARCHAR(10)), 'M3S2D4M,30,1;NF,5,-,10M,60,0;') END AS sa
        FROM (SELECT *, {_FID} AS fid, concat(l_returnflag, l_linestatus) AS chr, {_START} AS start, {_Q} AS q,
                     l_linenumber AS ln,
                     {_Q} + CASE l_linenumber % 4 WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 5 ELSE 6 END AS seqlen,
                     {_HEX.format(fid=_FID)} AS hex
              FROM lineitem) l""",
}


def _dialect(text: str, spark: bool) -> str:
    text = text.replace("@end", "`end`" if spark else '"end"')
    out, i = [], 0
    while i < len(text):
        for word in ("DAYS(", "SECONDS("):
            if text.startswith(word, i):
                close = text.index(")", i)
                arg = text[i + len(word) : close]
                if word == "DAYS(":
                    new = f"CAST(datediff(CAST({arg} AS DATE), DATE '1992-01-01') AS BIGINT)" if spark else f"date_diff('day', DATE '1992-01-01', CAST({arg} AS DATE))"
                else:
                    new = f"(unix_micros(CAST({arg} AS TIMESTAMP)) div 1000000)" if spark else f"(epoch_us({arg}) // 1000000)"
                out.append(new)
                i = close + 1
                break
        else:
            out.append(text[i])
            i += 1
    text = "".join(out)
    if spark:
        # Only the bases that stay are translated.
        text = re.sub(r"substr\(translate\(hex, ('\w+', '\w+')\), 1, CAST\(seqlen AS INT\)\)", r"translate(substr(hex, 1, CAST(seqlen AS INT)), \1)", text)
    # Integer division is written `/ 2` only where the dividend is even.
    return text.replace("- (ln - 1) % 2) / 2 AS", "- (ln - 1) % 2) div 2 AS" if spark else "- (ln - 1) % 2) // 2 AS")


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named views, as text for the checking engine."""
    ctes = [f"{n} AS ({_dialect(VIEW_SQL[n], spark=False)})" for n in names]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a single-file benchmark table to all cores.

    A real input of this kind has many file splits; here one task would otherwise
    do all per-row work.  Spark sets the number of parts by measured size, so that
    tasks stay as small when the table grows.
    """
    return df.hint("rebalance", *keys)


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    text = _dialect(VIEW_SQL[name], spark=True)
    used = {}
    for t in TABLES:
        for lead in ("FROM ", "JOIN "):
            if lead + t in text:
                text = text.replace(lead + t, lead + "{" + t + "}")
                used[t] = table(spark, sf, t)
                if name == "sam":
                    used[t] = spread(used[t], "l_orderkey", "l_partkey")
    return spark.sql(text, **used)


def features(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "features")


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "regions")


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """One row per distinct second and type; the next start comes from a blocked scan."""
    sec = F.expr("unix_micros(cast(ts as timestamp)) div 1000000")
    rows = (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("chr"), sec.alias("start"))
        .agg(F.max(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    )
    scanned = ordered_scan(rows, ["chr"], ["start"], block_of("start"), nxt=("lead", F.col("start")))
    return scanned.select("chr", "start", F.least("nxt", F.col("start") + 600).alias("end"), F.col("cents").cast("double").alias("value"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "pairs")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "samples")


def calls(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "calls")


def chromosomes(spark: SparkSession, sf: str) -> DataFrame:
    """Contigs with length and rank (by name)."""
    from pyspark.sql import Window

    sizes = view(spark, sf, "chrom_sizes")
    return sizes.withColumn("ord", (F.row_number().over(Window.orderBy("chr")) - 1).cast("long"))


def sam_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The read view as SAM text, one line per row in ``value``."""
    v = view(spark, sf, "sam")
    tags = F.concat_ws(
        "\t",
        F.concat(F.lit("RG:Z:"), F.col("rg")),
        F.concat(F.lit("FI:i:"), F.col("fid").cast("string")),
        F.concat(F.lit("SA:Z:"), F.col("sa")),
    )
    return v.select(
        as_line(
            "read_name",
            F.col("flags").cast("string"),
            "chr",
            (F.col("start") + 1).cast("string"),
            F.col("mq").cast("string"),
            "cigar",
            "rnext",
            F.col("pnext").cast("string"),
            F.col("tlen").cast("string"),
            "seq",
            "qual",
            tags,
        )
    )


def as_line(*cols, sep: str = "\t"):
    """A text line made of columns, as ``value``.

    The one-element explode keeps later filters and projections from being merged
    into the expression, so a line is built once, as if it came from a file.
    """
    return F.explode(F.array(F.concat_ws(sep, *cols))).alias("value")
