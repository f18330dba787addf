"""Order-dependent building blocks against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from genospan.scale import order_statistics


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))


def awkward_values():
    rng = random.Random(4)
    close = [1.0 + k * 2.0**-52 for k in range(300)]
    values = {
        "uniform": [rng.random() for _ in range(999)],
        "close": close + [-x for x in close],
        "far": [rng.choice((1, -1)) * 10.0 ** rng.randrange(-320, 308) for _ in range(500)] + [5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308],
        "special": [math.inf, -math.inf, 0.0, -0.0, math.nan, 3.0, 3.0, 3.0],
        "hot": [7.0] * 3000 + [6.999999, 7.000001],
        "one": [42.0],
        "missing": [None, None],
    }
    return [(g, v) for g, vs in values.items() for v in vs], values


@pytest.mark.parametrize("most_sent", [100_000, 0])
def test_order_statistics_by_group(spark, monkeypatch, most_sent):
    monkeypatch.setattr("genospan.scale.MOST_SENT_GROUPS", most_sent)
    rows, values = awkward_values()
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    n = F.col("n")
    ranks = {"first": F.lit(0), "p3": F.floor(n * 0.03), "mid": F.floor(n / 2), "last": n - 1, "beyond": n, "before": F.lit(-1)}
    got = {r["g"]: r for r in order_statistics(df, "v", ranks, ["g"]).collect()}
    assert set(got) == set(values) - {"missing"}
    for g, r in got.items():
        want = sorted(values[g], key=lambda x: (math.isnan(x), x))
        k = len(want)
        assert r["n"] == k and r["beyond"] is None and r["before"] is None
        for name, at in (("first", 0), ("p3", math.floor(k * 0.03)), ("mid", k // 2), ("last", k - 1)):
            assert r[name] == want[at] or (math.isnan(r[name]) and math.isnan(want[at])), (g, name)


def test_order_statistics_without_groups(spark):
    rows, values = awkward_values()
    df = spark.createDataFrame([(v,) for v in values["close"] + values["uniform"]], "v double")
    want = sorted(values["close"] + values["uniform"])
    for at in (0, 17, 600, 601, len(want) - 1):
        found = order_statistics(df, "v", {"x": F.lit(at)}).collect()
        assert [(r["n"], r["x"]) for r in found] == [(len(want), want[at])]
    assert order_statistics(df.where("false"), "v", {"x": F.lit(0)}).count() == 0


@pytest.mark.parametrize("name", ["qtl_axis_max", "paired_end_stats", "contact_percentiles", "contact_filter", "score_histogram"])
def test_no_product_joins(spark, name):
    import __spark_entry__ as entry

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
