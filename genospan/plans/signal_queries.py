"""Signal tracks: summaries, zoom levels, scaling and display ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from genospan.operators import signal as S
from genospan.operators.intervals import merge_tracks
from genospan.plans import views as V
from genospan.plans.registry import query
from genospan.plans.views import with_views


def _summary_sql(how: str) -> str:
    pick = {"mean": "sum(value) / count(value)", "min": "min(value)", "max": "max(value)"}[how]
    return with_views(
        f"""WITH r AS (SELECT *, CAST(floor(start / 3600.0) AS BIGINT) AS sb, CAST(floor("end" / 3600.0) AS BIGINT) AS eb FROM signal),
        l AS (SELECT *, coalesce(sb = lag(eb) OVER (PARTITION BY chr ORDER BY start), FALSE) AS joined FROM r),
        b AS (SELECT chr, b, {pick} AS value FROM (
                SELECT chr, eb AS b, value FROM l UNION ALL SELECT chr, sb, value FROM l WHERE joined AND sb < eb) t GROUP BY 1, 2),
        u AS (SELECT chr, CAST(b * 3600 AS DOUBLE) AS start, CAST((b + 1) * 3600 AS DOUBLE) AS "end", value, 0 AS kind FROM b
              UNION ALL SELECT chr, CAST(start AS DOUBLE), CAST(eb * 3600 AS DOUBLE), value, 1 FROM l WHERE eb > sb + CAST(joined AS INT)),
        m AS (SELECT *, CASE WHEN value = lag(value) OVER w AND start <= lag("end") OVER w THEN 0 ELSE 1 END AS brk FROM u
              WINDOW w AS (PARTITION BY chr ORDER BY start, kind)),
        g AS (SELECT *, sum(brk) OVER (PARTITION BY chr ORDER BY start, kind) AS g FROM m)
        SELECT chr, min(start) AS start, max("end") AS "end", value FROM g GROUP BY chr, g, value""",
        "signal",
    )


for _how in ("mean", "min", "max"):

    @query(f"bin_summarize_{_how}", _summary_sql(_how))
    def _summarize(spark, sf, how=_how):
        return S.bin_summarize(V.signal(spark, sf), 3600, how)


@query(
    "merge_equal_neighbours",
    with_views(
        """WITH c AS (SELECT chr, start, "end", floor(value / 2000) AS value FROM signal),
           m AS (SELECT *, CASE WHEN value = lag(value) OVER w AND start <= lag("end") OVER w THEN 0 ELSE 1 END AS brk FROM c
                 WINDOW w AS (PARTITION BY chr ORDER BY start)),
           g AS (SELECT *, sum(brk) OVER (PARTITION BY chr ORDER BY start) AS g FROM m)
           SELECT chr, min(start) AS start, max("end") AS "end", value FROM g GROUP BY chr, g, value""",
        "signal",
    ),
)
def merge_equal_neighbours(spark, sf):
    s = V.signal(spark, sf).withColumn("value", F.floor(F.col("value") / 2000).cast("double"))
    return S.merge_equal_neighbours(s)


_LEVELS = (3_600, 21_600, 86_400)


@query(
    "zoom_rollup",
    with_views(
        """SELECT chr, CAST(level AS INT) AS level, start // level * level AS start, start // level * level + level AS "end",
                  count(*) AS valid_count, min(value) AS min_value, max(value) AS max_value,
                  sum(value) AS sum_value, sum(value * value) AS sum_squares
           FROM signal CROSS JOIN (VALUES (3600), (21600), (86400)) v(level) GROUP BY 1, 2, 3, 4""",
        "signal",
    ),
)
def zoom_rollup(spark, sf):
    return S.zoom_rollup(V.signal(spark, sf), _LEVELS)


@query(
    "zoom_level_values",
    with_views(
        """SELECT chr, start // 21600 * 21600 AS start, start // 21600 * 21600 + 21600 AS "end", sum(value) / count(*) AS value
           FROM signal GROUP BY 1, 2, 3""",
        "signal",
    ),
)
def zoom_level_values(spark, sf):
    level = S.choose_level(_LEVELS, 30_000)
    return S.level_values(S.zoom_rollup(V.signal(spark, sf), _LEVELS), level)


@query(
    "signal_statistics",
    with_views(
        """SELECT chr, count(*) AS n, min(value) AS min_value, max(value) AS max_value, sum(value) / count(*) AS mean,
                  round(sqrt(sum(value * value) / (count(*) - 1)), 6) AS stddev, 0.0::DOUBLE AS default_min,
                  round(sum(value) / count(*) + 2 * sqrt(sum(value * value) / (count(*) - 1)), 6) AS default_max
           FROM signal GROUP BY chr""",
        "signal",
    ),
)
def signal_statistics(spark, sf):
    finest = S.zoom_rollup(V.signal(spark, sf), _LEVELS[:1])
    s = S.rollup_statistics(finest, ["chr"])
    return s.withColumn("stddev", F.round("stddev", 6)).withColumn("default_max", F.round("default_max", 6))


@query(
    "autoscale",
    with_views(
        """SELECT chr, least(0.0::DOUBLE, min(v)) AS min_value, greatest(0.0::DOUBLE, max(v)) AS max_value
           FROM (SELECT chr, value - 2500 AS v FROM signal) s GROUP BY chr""",
        "signal",
    ),
)
def autoscale(spark, sf):
    return S.autoscale(V.signal(spark, sf).withColumn("value", F.col("value") - 2500), ["chr"])


@query(
    "group_autoscale",
    with_views(
        """SELECT 'g' AS scale_group, least(0.0::DOUBLE, min(v)) AS min_value, greatest(0.0::DOUBLE, max(v)) AS max_value
           FROM (SELECT value AS v FROM signal UNION ALL SELECT CAST(cents AS DOUBLE) / 1000 FROM features) s""",
        "signal",
        "features",
    ),
)
def group_autoscale(spark, sf):
    f = V.features(spark, sf).select("chr", "start", "end", (F.col("cents") / 1000).alias("value"))
    both = merge_tracks({"signal": V.signal(spark, sf), "features": f}).withColumn("scale_group", F.lit("g"))
    return S.autoscale(both, ["scale_group"])


@query(
    "range_extremes",
    with_views(
        """SELECT chr, max(value) AS max_in_range, least(0.0::DOUBLE, min(value)) AS min_in_range FROM signal
           WHERE start <= 1705000000 AND "end" >= 1704500000 GROUP BY chr""",
        "signal",
    ),
)
def range_extremes(spark, sf):
    s = V.signal(spark, sf).where("start <= 1705000000 AND `end` >= 1704500000")
    return S.range_extremes(s, ["chr"])


@query(
    "scale_values",
    with_views(
        "SELECT chr, start, value * (2.0::DOUBLE * 1000000.0::DOUBLE / (SELECT sum(value) FROM signal)) AS value FROM signal", "signal"
    ),
)
def scale_values(spark, sf):
    s = V.signal(spark, sf)
    return S.scale_values(s, 2.0, total=s.agg(F.sum("value"))).select("chr", "start", "value")


@query(
    "finite_only",
    "SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value / nullif(value - 5, 0)) AND value <> 5",
)
def finite_only(spark, sf):
    e = V.table(spark, sf, "events").withColumn(
        "ratio", F.when(F.col("value") == 5, F.lit(float("nan"))).otherwise(F.col("value"))
    )
    return S.finite_only(e, "ratio").select("event_id", "value")
