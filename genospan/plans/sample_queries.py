"""Sample attributes, filters and orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from genospan.operators import intervals as I
from genospan.operators import samples as S
from genospan.plans import views as V
from genospan.plans.format_queries import SAMPLES_SQL, sample_file
from genospan.plans.interval_queries import LAYOUT
from genospan.plans.registry import query
from genospan.plans.views import with_views
from genospan.sources.samples import long_attributes, parse_sample_info


def attributes(spark, sf):
    wide = V.samples(spark, sf).withColumn("the-region", F.when(F.col("sample") % 7 == 0, "").otherwise(F.col("region")))
    return long_attributes(wide.withColumn("sample", F.col("sample").cast("string")), "sample", ["nation", "the-region", "balance"])


@query("typed_attributes", with_views(f"WITH {SAMPLES_SQL} SELECT * FROM att", "samples"))
def typed_attributes(spark, sf):
    return attributes(spark, sf)


@query(
    "attach_sample_info",
    with_views(
        f"WITH {SAMPLES_SQL} SELECT fid, att.str_value AS nation FROM features f LEFT JOIN att ON att.sample = CAST(f.sample AS VARCHAR) AND attribute = 'nation'",
        "samples",
        "features",
    ),
)
def attach_sample_info(spark, sf):
    info = parse_sample_info(sample_file(spark, sf))
    f = V.features(spark, sf).select("fid", F.concat(F.lit("track"), F.col("sample").cast("string")).alias("sample"))
    nation = info["attributes"].where(F.col("attribute") == "nation").select("sample", F.col("str_value").alias("nation"))
    return S.attach_sample_info(f, nation, info["mapping"]).select("fid", "nation")


@query(
    "attribute_ranges",
    with_views(
        f"""WITH {SAMPLES_SQL} SELECT attribute, min(num_value) AS min_value, max(num_value) AS max_value, CAST(NULL AS VARCHAR) AS str_value FROM att GROUP BY 1 HAVING count(num_value) > 0
            UNION ALL SELECT DISTINCT attribute, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), str_value FROM att WHERE attribute = 'nation'""",
        "samples",
    ),
)
def attribute_ranges(spark, sf):
    return S.attribute_ranges(attributes(spark, sf))


@query(
    "group_counts",
    with_views(f"WITH {SAMPLES_SQL} SELECT str_value, num_value, count(*) AS n, CAST(row_number() OVER (ORDER BY str_value) - 1 AS INT) AS group_index FROM att WHERE attribute = 'nation' GROUP BY 1, 2", "samples"),
)
def group_counts(spark, sf):
    return S.group_counts(attributes(spark, sf), "nation")


def scores_sql(name, start, end):
    return f"""{name} AS (SELECT sample, CAST(CAST(sum((least("end", {end}) - greatest(start, {start})) * cents) AS BIGINT) AS DOUBLE) / {end - start + 1} AS score
    FROM features WHERE chr = 'NO' AND start <= {end} AND "end" >= {start} GROUP BY 1)"""


WIDE, NARROW = (200_000, 260_000), (230_000, 231_000)
_SCORES = scores_sql("sc", *WIDE)


def scores(spark, sf, kind="seg", place=WIDE):
    f = V.features(spark, sf).withColumn("value", F.col("cents"))
    start, end = place
    # One region, made of the whole table of regions.
    region = V.table(spark, sf, "region").agg(
        F.lit("NO").alias("chr"), F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"), F.min("r_regionkey").alias("region_id")
    )
    return I.region_scores(f, region, kind, layout=I.JoinLayout(512, 0, 1)).drop("region_id")


def all_samples(spark, sf):
    return V.samples(spark, sf).select("sample")


@query("sample_filter", with_views(f"WITH {_SCORES} SELECT s.sample FROM samples s JOIN sc USING (sample) WHERE score > 45000 AND score < 60000", "samples", "features"))
def sample_filter(spark, sf):
    sc = scores(spark, sf)
    return S.sample_filter(S.sample_filter(all_samples(spark, sf), sc, ">", 45_000), sc, "<", 60_000)


@query("sample_filter_mutations", with_views(f"WITH {scores_sql('sc', *NARROW)} SELECT s.sample FROM samples s WHERE s.sample NOT IN (SELECT sample FROM sc)", "samples", "features"))
def sample_filter_mutations(spark, sf):
    return S.sample_filter(all_samples(spark, sf), scores(spark, sf, "mut", NARROW), "NOT HAS")


@query("sort_samples_by_value", with_views(f"WITH {_SCORES} SELECT s.sample, round(score, 6) AS score FROM samples s LEFT JOIN sc USING (sample)", "samples", "features"))
def sort_samples_by_value(spark, sf):
    return S.sort_samples_by_value(all_samples(spark, sf), scores(spark, sf)).select("sample", F.round("score", 6).alias("score"))


@query("sort_samples_by_genotype", with_views(f"WITH {_SCORES} SELECT s.sample, CAST(coalesce(floor(score), 0) AS BIGINT) AS score FROM samples s LEFT JOIN sc USING (sample)", "samples", "features"))
def sort_samples_by_genotype(spark, sf):
    sc = scores(spark, sf).withColumn("score", F.floor("score"))
    return S.sort_samples_by_genotype(all_samples(spark, sf), sc)


@query(
    "sort_samples_by_attribute",
    with_views(f"WITH {SAMPLES_SQL} SELECT CAST(s.sample AS VARCHAR) AS sample, str_value, num_value FROM samples s JOIN att ON att.sample = CAST(s.sample AS VARCHAR) AND attribute = 'balance'", "samples"),
)
def sort_samples_by_attribute(spark, sf):
    names = all_samples(spark, sf).select(F.col("sample").cast("string").alias("sample"))
    return S.sort_samples_by_attribute(names, attributes(spark, sf), "balance")


@query("export_samples", with_views("SELECT CAST(sample AS VARCHAR) AS sample FROM samples", "samples"))
def export_samples(spark, sf):
    return S.export_samples(attributes(spark, sf)).where(F.col("json").contains('"nation"')).select("sample")
