"""Stored layouts, user readers, service responses and named computations, on the whole feature table.

Queries that store write to a new folder beside the checkpoints and read back what they wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from genospan.operators import intervals as I
from genospan.plans import views as V
from genospan.plans.format_queries import s
from genospan.plans.registry import query
from genospan.plans.views import with_views
from genospan.session import ensure_checkpoint_dir
from genospan.sources import sinks as K
from genospan.sources import tables as T
from genospan.sources.annotations import read_bed


def new_folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def slim(spark, sf):
    return V.features(spark, sf).select("chr", "start", "end", "cents", "fid")


@query("write_features", with_views("""SELECT chr, start, "end", cents, fid FROM features WHERE chr <> 'NO'
    UNION ALL SELECT chr, start, "end", NULL, fid FROM features WHERE chr = 'NO'""", "features"))
def write_features(spark, sf):
    """JSON feature sets written and read back; missing values stay missing."""
    path = new_folder(spark, "features")
    f = slim(spark, sf).withColumn("cents", F.when(F.col("chr") != "NO", F.col("cents")))
    K.write_features(f, path)
    return spark.read.schema(f.schema).json(path)


@query("write_read_bed", with_views("""SELECT chr, start, "end", 'n' || fid AS name FROM features""", "features"))
def write_read_bed(spark, sf):
    path = new_folder(spark, "bed")
    f = V.features(spark, sf)
    K.write_bed(f.select("chr", "start", "end", F.concat(F.lit("n"), s("fid")).alias("name")), path)
    return read_bed(spark, path).select("chr", "start", "end", "name")


@query("stored_range_query", with_views("""SELECT chr, start, "end", fid FROM features WHERE chr IN ('NO', 'RF') AND "end" >= 210000 AND start <= 215000""", "features"))
def stored_range_query(spark, sf):
    """The store is cut by chromosome and start: only the asked stretch of two chromosomes is read back."""
    path = new_folder(spark, "store")
    K.write_intervals(slim(spark, sf), path, longest=51)
    return K.read_intervals(spark, path, ["NO", "RF"], 210_000, 215_000).select("chr", "start", "end", "fid")


@query(
    "stored_regions",
    with_views(
        """SELECT r.region_id, count(*) AS n, CAST(sum(f.cents) AS BIGINT) AS cents FROM features f JOIN regions r
           ON f.chr = r.chr AND f.start < r."end" AND f."end" > r.start GROUP BY 1""",
        "features",
        "regions",
    ),
)
def stored_regions(spark, sf):
    """A whole table of regions against the store."""
    path = new_folder(spark, "store")
    K.write_intervals(slim(spark, sf), path, longest=51)
    return I.overlap_totals(spark.read.parquet(path), V.view(spark, sf, "regions"), "half", sums=["cents"])


@query("read_sharded", with_views("""SELECT chr, start, "end", name FROM (SELECT chr, start, "end", 'n' || fid AS name FROM features) x WHERE chr IN ('AF', 'NO', 'RO')""", "features"))
def read_sharded(spark, sf):
    """One folder a chromosome, written whole; of those only three are opened."""
    path = new_folder(spark, "shards")
    f = V.features(spark, sf)
    named = f.select("chr", "start", "end", F.concat(F.lit("n"), s("fid")).alias("name"))
    lines = K.bed_text(named).withColumn("shard", F.split_part("value", F.lit("\t"), F.lit(1)))
    lines.write.partitionBy("shard").text(path)
    return T.read_sharded(spark, f"{path}/shard=$CHR", V.CHROMS, read_bed, only=["AF", "NO", "RO"]).select("chr", "start", "end", "name")


@query("reader_callback", with_views("""SELECT chr, start, "end", cents FROM features WHERE "end" >= 200000 AND start <= 240000 AND chr = 'AF'""", "features"))
def reader_callback(spark, sf):
    """A user's reader gets the region and answers with features; what lies outside is cut off."""
    T.register_reader("line_items", lambda spark, sf_dir, **region: slim(spark, sf_dir))
    return T.read_with("line_items", spark, sf, chr="AF", start=200_000, end=240_000).select("chr", "start", "end", "cents")


@query(
    "service_response",
    with_views("SELECT chr, start, \"end\", CAST(cents AS DOUBLE) / 100 AS score, 'n' || fid AS name FROM features", "features"),
)
def service_response(spark, sf):
    """JSON answers of a feature service, one per chromosome and stretch, with the service's own names."""
    f = slim(spark, sf)
    feature = F.struct(
        F.col("chr").alias("chromosome"), F.col("start").alias("from"), F.col("end").alias("to"), (F.col("cents") / 100).alias("value"),
        F.concat(F.lit("n"), s("fid")).alias("id"),
    )
    answers = f.groupBy("chr", F.floor(F.col("start") / 1000)).agg(F.to_json(F.collect_list(feature)).alias("value"))
    names = {"chromosome": "chr", "from": "start", "to": "end", "value": "score", "id": "name"}
    return T.parse_service_response(answers, "chromosome string, from long, to long, value double, id string", names)


@query("named_computation", with_views("SELECT chr, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM features GROUP BY 1", "features"))
def named_computation(spark, sf):
    T.register_computation("sum_by_chr", lambda df: df.groupBy("chr").agg(F.sum("cents").alias("total"), F.count(F.lit(1)).alias("n")))
    return T.compute("sum_by_chr", slim(spark, sf))
