"""Alignments: SAM parsing, flags, CIGAR, pileup, pairs, ordering, down-sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from genospan.functions import reads as R
from genospan.operators import packing as P
from genospan.operators import reads as O
from genospan.operators import sampling as S
from genospan.operators.sequence import attach_base, attach_sequence, to_chunks
from genospan.plans import views as V
from genospan.plans.registry import query
from genospan.plans.views import with_views
from genospan.sources.sam import parse_sam, with_parts

FID = "fid"
MAPPED = "flags & 4 = 0"


def reads(spark, sf):
    return parse_sam(V.sam_lines(spark, sf)).withColumn("fid", F.col("tags")["FI"].cast("long"))


def parts(spark, sf):
    return with_parts(reads(spark, sf))


def kept(spark, sf):
    return with_parts(O.read_filter(reads(spark, sf)))


def sam_sql(body: str) -> str:
    """The read view with its derived columns, as ``rd``."""
    return with_views(
        f"""WITH rd AS (SELECT *, start + reflen AS "end" FROM (SELECT *,
              q + CASE ln % 4 WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN 4 ELSE 106 END AS reflen,
              CASE rnext WHEN '=' THEN chr ELSE rnext END AS mate_chr, pnext - 1 AS mate_pos FROM sam) s WHERE {MAPPED}),
            rk AS (SELECT * FROM rd WHERE flags & 1536 = 0),
            bl AS (SELECT fid, chr, flags, seq, qual, start + x.d AS p, off + x.o AS o, CASE x.n WHEN -1 THEN q ELSE x.n END AS n FROM (
                     SELECT *, CASE ln % 4 WHEN 1 THEN 3 ELSE 0 END AS off FROM rk) k,
                   LATERAL (SELECT * FROM (VALUES (0, 0, -1, -1)) a(d, o, n, k) UNION ALL
                            SELECT q + 2, q, 5, 1 UNION ALL SELECT q, q + 1, 4, 2 UNION ALL SELECT q + 100, q, 6, 3) x
                   WHERE x.k = -1 OR x.k = k.ln % 4),
            bs AS (SELECT fid, chr, flags, p + j AS pos, substr(seq, CAST(o + j + 1 AS INT), 1) AS base,
                          ascii(substr(qual, CAST(o + j + 1 AS INT), 1)) - 33 AS qv
                   FROM (SELECT *, unnest(range(n)) AS j FROM bl) b)
        {body}""",
        "sam",
    )


@query(
    "read_sam",
    sam_sql('SELECT fid, read_name, flags, chr, start, "end", mq, cigar, mate_chr, mate_pos, tlen, seq, qual, rg, sa FROM rd'),
)
def read_sam(spark, sf):
    return reads(spark, sf).select(
        FID, "read_name", F.col("flags").cast("long").alias("flags"), "chr", "start", "end", F.col("mq").cast("long").alias("mq"),
        "cigar", "mate_chr", "mate_pos", "tlen", "seq", "qual", F.col("tags")["RG"].alias("rg"), F.col("tags")["SA"].alias("sa"),
    )


@query(
    "read_filter",
    sam_sql("SELECT fid FROM rd WHERE flags & (512 + 1024 + 256 + 2048) = 0 AND mq >= 20 AND rg IN ('g0', 'g2')"),
)
def read_filter(spark, sf):
    return O.read_filter(reads(spark, sf), secondary=True, supplementary=True, min_mq=20, read_groups=["g0", "g2"]).select(FID)


@query(
    "decode_flags",
    sam_sql(
        "SELECT fid, " + ", ".join(f"flags & {bit} <> 0 AS {name}" for name, bit in R.FLAGS.items()) + ", flags & 16 = 0 AS strand FROM rd"
    ),
)
def decode_flags(spark, sf):
    return reads(spark, sf).select(FID, *R.decode_flags())


@query(
    "first_of_pair_strand",
    sam_sql("SELECT fid, CASE WHEN flags & 64 <> 0 THEN flags & 16 = 0 WHEN flags & 8 = 0 THEN flags & 32 = 0 END AS first_strand FROM rd"),
)
def first_of_pair_strand(spark, sf):
    return reads(spark, sf).select(FID, R.first_of_pair_strand().alias("first_strand"))


_PO = """po AS (SELECT *, CASE WHEN flags & 8 = 0 AND mate_chr = chr THEN
      CASE WHEN (CASE WHEN tlen <> 0 THEN tlen WHEN start < mate_pos THEN mate_pos + reflen - start ELSE mate_pos - reflen - start END) > 0
           THEN own || mate ELSE mate || own END END AS pair_orientation
      FROM (SELECT *, (CASE WHEN flags & 16 = 0 THEN 'F' ELSE 'R' END) || (CASE WHEN flags & 64 <> 0 THEN '1' ELSE '2' END) AS own,
                   (CASE WHEN flags & 32 = 0 THEN 'F' ELSE 'R' END) || (CASE WHEN flags & 64 <> 0 THEN '2' ELSE '1' END) AS mate FROM rd) x)"""


@query("pair_orientation", sam_sql(", " + _PO + " SELECT fid, pair_orientation FROM po"))
def pair_orientation(spark, sf):
    return reads(spark, sf).select(FID, R.pair_orientation().alias("pair_orientation"))


@query(
    "orientation_class",
    sam_sql(
        ", " + _PO + """ SELECT fid, CASE WHEN pair_orientation IN ('F1R2','F2R1') THEN 'LR' WHEN pair_orientation IN ('F1F2','F2F1') THEN 'LL'
        WHEN pair_orientation IN ('R1R2','R2R1') THEN 'RR' WHEN pair_orientation IN ('R1F2','R2F1') THEN 'RL' END AS fr,
        CASE WHEN pair_orientation IN ('R1F2','R2F1') THEN 'LR' WHEN pair_orientation IN ('R1R2','R2R1') THEN 'LL'
        WHEN pair_orientation IN ('F1F2','F2F1') THEN 'RR' WHEN pair_orientation IN ('F1R2','F2R1') THEN 'RL' END AS rf FROM po"""
    ),
)
def orientation_class(spark, sf):
    df = reads(spark, sf).withColumn("pair_orientation", R.pair_orientation())
    return df.select(FID, R.orientation_class("fr").alias("fr"), R.orientation_class("rf").alias("rf"))


@query(
    "cigar_ops",
    sam_sql(
        """SELECT fid, CASE ln % 4 WHEN 0 THEN q || 'M' WHEN 1 THEN '3S ' || q || 'M 2D 5M' WHEN 2 THEN q || 'M 1I 4M'
           ELSE q || 'M 100N 6M' END AS ops FROM rd"""
    ),
)
def cigar_ops(spark, sf):
    ops = F.array_join(F.transform(R.cigar_ops(), lambda o: F.concat(o["len"].cast("string"), o["op"])), " ")
    return reads(spark, sf).select(FID, ops.alias("ops"))


@query(
    "cigar_merge_equal",
    sam_sql("SELECT fid, (q + q + 1) || 'M 2I' AS ops FROM rd"),
)
def cigar_merge_equal(spark, sf):
    v = V.view(spark, sf, "sam").where("flags & 4 = 0")
    doubled = v.select("fid", F.concat(F.col("q").cast("string"), F.lit("M"), (F.col("q") + 1).cast("string"), F.lit("M2I")).alias("cigar"))
    return doubled.select("fid", F.array_join(F.transform(R.cigar_ops(), lambda o: F.concat(o["len"].cast("string"), o["op"])), " ").alias("ops"))


@query(
    "cigar_blocks",
    sam_sql(
        """SELECT fid, CASE ln % 4 WHEN 0 THEN 'M' || start || '+' || q || '@0'
             WHEN 1 THEN 'S' || (start - 3) || '+3@0 M' || start || '+' || q || '@3 D' || (start + q) || '+2@' || (q + 3) || ' M' || (start + q + 2) || '+5@' || (q + 3)
             WHEN 2 THEN 'M' || start || '+' || q || '@0 I' || (start + q) || '+1@' || q || ' M' || (start + q) || '+4@' || (q + 1)
             ELSE 'M' || start || '+' || q || '@0 N' || (start + q) || '+100@' || q || ' M' || (start + q + 100) || '+6@' || q END AS parts,
             CASE ln % 4 WHEN 1 THEN start - 3 ELSE start END AS sc_start, CASE ln % 4 WHEN 1 THEN reflen + 3 ELSE reflen END AS sc_length
           FROM rd"""
    ),
)
def cigar_blocks(spark, sf):
    text = F.array_join(
        F.transform("parts", lambda p: F.concat(p["op"], p["pos"].cast("string"), F.lit("+"), p["len"].cast("string"), F.lit("@"), p["off"].cast("string"))),
        " ",
    )
    return parts(spark, sf).select(FID, text.alias("parts"), *R.soft_clip_extent())


@query("length_on_ref", sam_sql("SELECT fid, reflen AS length_on_ref FROM rd"))
def length_on_ref(spark, sf):
    return reads(spark, sf).select(FID, "length_on_ref")


@query(
    "small_indel_filter",
    sam_sql("SELECT fid, CASE ln % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 3 END AS n FROM rd"),
)
def small_indel_filter(spark, sf):
    """With a threshold of 2 the one-base insertion and the two-base deletion disappear."""
    return parts(spark, sf).select(FID, F.size(R.small_indel_filter(threshold=2)).alias("n"))


@query(
    "base_at",
    sam_sql(
        """SELECT fid, CASE WHEN start + 4 < start + q THEN substr(seq, 5 + CASE ln % 4 WHEN 1 THEN 3 ELSE 0 END, 1)
             WHEN ln % 4 = 1 AND 4 >= q + 2 AND 4 < q + 7 THEN substr(seq, CAST(4 - q - 2 + q + 3 + 1 AS INT), 1)
             WHEN ln % 4 = 2 AND 4 >= q AND 4 < q + 4 THEN substr(seq, CAST(4 - q + q + 1 + 1 AS INT), 1) END AS base,
             CASE WHEN ln % 4 = 1 AND 4 >= q AND 4 < q + 2 THEN 2 WHEN ln % 4 = 3 AND 4 >= q AND 4 < q + 100 THEN 100 ELSE 0 END AS gap,
             CASE WHEN ln % 4 = 2 AND q = 4 THEN substr(seq, 5, 1) END AS inserted
           FROM rd"""
    ),
)
def base_at(spark, sf):
    at = F.col("start") + 4
    return parts(spark, sf).select(
        FID, R.base_at(at).alias("base"), R.gap_size_at(at).cast("int").alias("gap"), R.insertion_at(at).alias("inserted")
    )


@query(
    "parse_sa",
    sam_sql(
        """SELECT fid, 'RO' AS chr, start + 7 AS start, '+' AS strand, 30 AS mapq, 1 AS mismatches, q + 6 AS len_on_ref FROM rd WHERE sa IS NOT NULL
           UNION ALL SELECT fid, 'NF', 5, '-', 60, 0, 10 FROM rd WHERE sa IS NOT NULL"""
    ),
)
def parse_sa(spark, sf):
    return O.split_reads(reads(spark, sf)).select(FID, F.inline(R.parse_sa(F.col("tags")["SA"])))


@query("split_reads", sam_sql('SELECT fid FROM rd WHERE sa IS NOT NULL AND "end" >= 150000 AND start <= 300000'))
def split_reads(spark, sf):
    return O.split_reads(reads(spark, sf), 150_000, 300_000).select(FID)


@query("discordant_pairs", sam_sql("SELECT fid FROM rd WHERE flags & 8 = 0 AND (mate_chr <> chr OR tlen > 400)"))
def discordant_pairs(spark, sf):
    return O.discordant_pairs(reads(spark, sf), 400).select(FID)


_GROUP_SQL = sam_sql(
    ", " + _PO + """ SELECT fid, CASE WHEN flags & 16 = 0 THEN '+' ELSE '-' END AS strand,
      CASE WHEN flags & 8 = 0 THEN mate_chr ELSE '' END AS mate,
      CASE WHEN sa IS NULL THEN '' ELSE 'chimeric' END AS chimeric, CASE WHEN flags & 2048 <> 0 THEN 'supplementary' ELSE '' END AS supp,
      CASE WHEN flags & 64 <> 0 THEN 'first' ELSE 'second' END AS read_order, rg, '' AS phase,
      CASE WHEN pair_orientation IN ('F1R2','F2R1') THEN 'LR' WHEN pair_orientation IN ('F1F2','F2F1') THEN 'LL'
        WHEN pair_orientation IN ('R1R2','R2R1') THEN 'RR' WHEN pair_orientation IN ('R1F2','R2F1') THEN 'RL' ELSE '' END AS po,
      CASE WHEN flags & 64 <> 0 THEN CASE WHEN flags & 16 = 0 THEN '+' ELSE '-' END
           WHEN flags & 8 = 0 THEN CASE WHEN flags & 32 = 0 THEN '+' ELSE '-' END ELSE '' END AS fops
      FROM po"""
)


@query("group_value", _GROUP_SQL)
def group_value(spark, sf):
    g = R.group_value
    return parts(spark, sf).select(
        FID, g("strand").alias("strand"), g("mateChr").alias("mate"), g("chimeric").alias("chimeric"), g("supplementary").alias("supp"),
        g("readOrder").alias("read_order"), g("tag:RG").alias("rg"), g("phase").alias("phase"), g("pairOrientation").alias("po"),
        g("firstOfPairStrand").alias("fops"),
    )


@query(
    "group_by_base",
    sam_sql(
        """SELECT fid, CASE WHEN chr = 'NO' AND start <= 199999 AND "end" > 199999 THEN coalesce(b.base, 'GAP') ELSE '' END AS g
           FROM rd LEFT JOIN (SELECT fid, base FROM bs WHERE chr = 'NO' AND pos = 199999) b USING (fid) WHERE flags & 1536 = 0"""
    ),
)
def group_by_base(spark, sf):
    """Base 200,000 of NO; the leading clips of this data never reach it."""
    return kept(spark, sf).select(FID, R.group_value("base:NO:200,000").alias("g"))


@query(
    "insert_size_class",
    sam_sql(
        """SELECT fid, CASE WHEN flags & 8 = 0 THEN CASE WHEN mate_chr <> chr THEN 'inter' WHEN abs(tlen) < 100 THEN 'small'
           WHEN abs(tlen) > 400 THEN 'large' END END AS size_class FROM rd"""
    ),
)
def insert_size_class(spark, sf):
    return reads(spark, sf).select(FID, R.insert_size_class(100, 400).alias("size_class"))


_ONE_BASE = ", ".join(
    f"""count(*) FILTER (base = '{b}' AND NOT back) AS "pos{b}", count(*) FILTER (base = '{b}' AND back) AS "neg{b}",
        CAST(coalesce(sum(qv) FILTER (base = '{b}'), 0) AS BIGINT) AS "qual{b}" """
    for b in O.BASES
)
_PILE = f"""pile AS (SELECT chr, pos, {_ONE_BASE}, count(base) AS total, CAST(coalesce(sum(qv), 0) AS BIGINT) AS qual,
      CAST(sum(d) AS BIGINT) AS del, CAST(sum(i) AS BIGINT) AS ins FROM (
      SELECT chr, pos, base, flags & 16 <> 0 AS back, qv, 0 AS d, 0 AS i FROM bs
      UNION ALL SELECT chr, start + q + j, NULL, FALSE, NULL, 1, 0 FROM (SELECT *, unnest(range(2)) AS j FROM rk WHERE ln % 4 = 1) x
      UNION ALL SELECT chr, start + q, NULL, FALSE, NULL, 0, 1 FROM rk WHERE ln % 4 = 2) e GROUP BY 1, 2)"""


@query("pileup", sam_sql(", " + _PILE + " SELECT * FROM pile"))
def pileup(spark, sf):
    return O.pileup(kept(spark, sf))


@query("pileup_max", sam_sql(", " + _PILE + ' SELECT chr, max(total) AS max_total FROM pile GROUP BY chr'))
def pileup_max(spark, sf):
    return O.max_coverage(O.pileup(kept(spark, sf)))


@query(
    "base_count",
    sam_sql(""" SELECT chr, pos, CAST(count(*) FILTER (base = 'G') AS BIGINT) AS g, CAST(count(*) FILTER (base = 'T' AND flags & 16 <> 0) AS BIGINT) AS neg_t
        FROM bs GROUP BY 1, 2"""),
)
def base_count(spark, sf):
    pile = O.pileup(kept(spark, sf)).where("total > 0")
    return pile.select("chr", "pos", O.base_count("g").alias("g"), O.base_count("T", "neg").alias("neg_t"))


# A reference made from the positions themselves: chunks of 128 bases named by chromosome and index.
_REF_CHUNK = 128
_REF_SQL = """rf AS (SELECT chr, chunk, translate(repeat(md5(concat(chr, '-', CAST(chunk AS VARCHAR(20)))), 4), '0123456789abcdef', 'ACGTACGTACGTACGN') AS rseq
    FROM (SELECT DISTINCT chr, start // 128 + k AS chunk FROM (SELECT chr, start, unnest(range(4)) AS k FROM sam) s) c)"""


def reference(spark, sf):
    """Reference chunks for every stretch the reads can touch (a read spans at most 156 bases)."""
    v = V.view(spark, sf, "sam")
    near = v.select("chr", F.explode(F.sequence(F.floor(F.col("start") / 128), F.floor(F.col("start") / 128) + 3)).alias("chunk")).distinct()
    seq = F.expr("translate(repeat(md5(concat(chr, '-', cast(chunk as string))), 4), '0123456789abcdef', 'ACGTACGTACGTACGN')")
    return near.select("chr", "chunk", seq.alias("seq"))


@query(
    "mismatch_sites",
    sam_sql(
        ", " + _REF_SQL + """, jb AS (SELECT b.chr, b.pos, b.base, b.qv, substr(rseq, CAST(b.pos % 128 + 1 AS INT), 1) AS ref
            FROM bs b JOIN rf ON rf.chr = b.chr AND rf.chunk = b.pos // 128)
        SELECT chr, pos, ref, CAST(sum(qv) AS BIGINT) AS qual FROM jb GROUP BY chr, pos, ref
        HAVING coalesce(sum(CASE WHEN base <> 'N' AND base <> ref THEN qv END), 0) >= 0.2 * sum(qv)"""
    ),
)
def mismatch_sites(spark, sf):
    pile = O.pileup(kept(spark, sf)).where("total > 0")
    return O.mismatch_sites(pile, reference(spark, sf), _REF_CHUNK).select("chr", "pos", "ref", "qual")


@query(
    "read_mismatches",
    sam_sql(
        ", " + _REF_SQL + """ SELECT fid, pos, base, substr(rseq, CAST(pos % 128 + 1 AS INT), 1) AS ref, qv AS q
        FROM bs JOIN rf ON rf.chr = bs.chr AND rf.chunk = bs.pos // 128 WHERE base <> substr(rseq, CAST(pos % 128 + 1 AS INT), 1)"""
    ),
)
def read_mismatches(spark, sf):
    return O.read_mismatches(kept(spark, sf), reference(spark, sf), _REF_CHUNK, "fid").select("fid", "pos", "base", "ref", "q")


@query(
    "attach_sequence",
    sam_sql(
        ", " + _REF_SQL + """ SELECT rd.fid, substr(concat(a.rseq, b.rseq), CAST(start % 128 + 1 AS INT), CAST(q AS INT)) AS sequence FROM rd
        JOIN rf a ON a.chr = rd.chr AND a.chunk = start // 128 JOIN rf b ON b.chr = rd.chr AND b.chunk = start // 128 + 1"""
    ),
)
def attach_seq(spark, sf):
    v = V.view(spark, sf, "sam").where("flags & 4 = 0").select("fid", "chr", "start", (F.col("start") + F.col("q")).alias("end"))
    return attach_sequence(v, reference(spark, sf), _REF_CHUNK, "fid").select("fid", "sequence")


@query(
    "sequence_chunks",
    sam_sql(
        ", " + _REF_SQL + """ SELECT chr, c AS chunk, substr(rseq, CAST((c % 4) * 32 + 1 AS INT), 32) AS seq
        FROM (SELECT *, unnest(range(chunk * 4, chunk * 4 + 4)) AS c FROM rf) x"""
    ),
)
def sequence_chunks(spark, sf):
    whole = reference(spark, sf).select("chr", (F.col("chunk") * 128).alias("offset"), "seq")
    return to_chunks(whole, 32)


_PAIRABLE = "flags & 8 = 0 AND mate_chr = chr AND flags & (256 + 2048) = 0"


@query(
    "pair_mates",
    sam_sql(
        f"""SELECT read_name, chr, min(start) AS start, max("end") AS "end", count(*) > 1 AS complete
            FROM (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY read_name, chr ORDER BY start, "end", flags, mq, cigar, tlen) AS i FROM rd
                  WHERE {_PAIRABLE} WINDOW w AS (PARTITION BY read_name, chr)) x WHERE i = 1 OR i = n GROUP BY 1, 2"""
    ),
)
def pair_mates(spark, sf):
    return O.pair_mates(reads(spark, sf)).select("read_name", "chr", "start", "end", F.col("second").isNotNull().alias("complete"))


@query(
    "paired_end_stats",
    sam_sql(
        ", " + _PO + """, pp AS (SELECT abs(tlen) AS size, substr(pair_orientation, 1, 1) || substr(pair_orientation, 3, 1) AS k FROM po WHERE flags & 2 <> 0),
        o AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS i, count(*) OVER () AS n FROM pp)
        SELECT count(*) AS n_pairs, CASE WHEN avg(CASE WHEN k IN ('FF','RR') THEN 1 ELSE 0 END) > 0.9 THEN 'ff'
               WHEN avg(CASE WHEN k = 'FR' THEN 1 ELSE 0 END) > 0.9 THEN 'fr' WHEN avg(CASE WHEN k = 'RF' THEN 1 ELSE 0 END) > 0.9 THEN 'rf' END AS orientation,
               (SELECT CAST(size AS DOUBLE) FROM o WHERE i = CAST(floor(n * 0.001) AS BIGINT)) AS min_tlen,
               (SELECT CAST(size AS DOUBLE) FROM o WHERE i = CAST(floor(n * 0.995) AS BIGINT)) AS max_tlen, count(*) > 99 AS usable FROM pp"""
    ),
)
def paired_end_stats(spark, sf):
    return O.paired_end_stats(reads(spark, sf))


@query(
    "sort_reads_at",
    sam_sql(
        """SELECT r.fid, CASE WHEN r.start <= 200000 AND r."end" >= 200000 THEN -CAST(r.mq AS BIGINT) END AS sort_value FROM rd r WHERE chr = 'NO'"""
    ),
)
def sort_reads_at(spark, sf):
    return O.sort_reads_at(parts(spark, sf), "NO", 200_000, "MQ").select(FID, F.col("sort_value").cast("long").alias("sort_value"))


@query("sort_reads_by_base")
def sort_reads_by_base(spark, sf):
    return O.sort_reads_at(kept(spark, sf), "NO", 200_000, "BASE", ref="A").select(FID, "sort_value")


@query(
    "group_order",
    sam_sql(
        """SELECT g, CAST(row_number() OVER (ORDER BY CASE g WHEN '' THEN 1 ELSE 0 END, lower(g)) AS INT) AS ord
           FROM (SELECT DISTINCT CASE WHEN flags & 8 = 0 THEN mate_chr ELSE '' END AS g FROM rd) d"""
    ),
)
def group_order(spark, sf):
    from pyspark.sql import Window

    groups = parts(spark, sf).select(R.group_value("mateChr").alias("group_value")).distinct()
    ranked = groups.withColumn("ord", F.row_number().over(Window.orderBy(*O.group_order("mateChr"))))
    return ranked.select(F.col("group_value").alias("g"), "ord")


@query(
    "downsample_reads",
    sam_sql(
        """, nm AS (SELECT read_name, min((chr, start // 100)) AS p FROM rd GROUP BY 1),
        kp AS (SELECT read_name, row_number() OVER (PARTITION BY p ORDER BY md5(concat_ws('|', '0', read_name)), read_name) AS i FROM nm)
        SELECT fid, chr, start, read_name FROM rd WHERE read_name IN (SELECT read_name FROM kp WHERE i <= 2)"""
    ),
)
def downsample_reads(spark, sf):
    return S.downsample_reads(reads(spark, sf), depth=2).select(FID, "chr", "start", "read_name")


@query(
    "downsample_stats",
    sam_sql(
        """SELECT chr, b * 100 AS start, b * 100 + 100 AS "end", count(*) - 2 AS dropped FROM (
             SELECT read_name, (min((chr, start // 100))) AS p, p[1] AS chr, p[2] AS b FROM rd GROUP BY read_name) x GROUP BY 1, b HAVING count(*) > 2"""
    ),
)
def downsample_stats(spark, sf):
    return S.downsample_stats(reads(spark, sf), depth=2)


@query("pack_reads")
def pack_reads(spark, sf):
    df = reads(spark, sf).select("fid", "chr", "start", "end", "length_on_ref", "flags")
    return P.pack_reads(df, ["chr"], tie=["fid", "flags"]).select("fid", "chr", "start", "row")


@query(
    "pack_full",
    sam_sql(
        """SELECT fid, chr, CAST(row_number() OVER (PARTITION BY chr ORDER BY start, read_name, flags) - 1 AS INT) AS "row"
           FROM rd WHERE "end" >= 150000 AND start <= 180000"""
    ),
)
def pack_full(spark, sf):
    return P.pack_full(reads(spark, sf), 150_000, 180_000, tie=[FID]).select(FID, "chr", "row")
