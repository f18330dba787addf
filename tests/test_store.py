"""Stored layouts prune what is not asked for; hot bins of the overlap join; user readers and service answers."""

import pytest
from pyspark.sql import functions as F

from genospan.operators import intervals as I
from genospan.sources import sinks as K
from genospan.sources import tables as T


def scan_lines(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PartitionFilters") :]


def test_store_prunes_folders_and_both_ends(spark, tmp_path):
    rows = [(c, k * 10, k * 10 + (35 if k % 50 == 0 else 5), k) for c in "abc" for k in range(2000)]
    K.write_intervals(spark.createDataFrame(rows, "chr string, start long, end long, k long"), str(tmp_path / "s"), partitions=6)
    got = K.read_intervals(spark, str(tmp_path / "s"), ["b"], 5_020, 5_040)
    want = sorted(r for r in rows if r[0] == "b" and r[2] >= 5_020 and r[1] <= 5_040)
    assert sorted((r["chr"], r["start"], r["end"], r["k"]) for r in got.collect()) == want
    assert any(r[3] % 50 == 0 and r[1] < 5_020 for r in want)
    plan = scan_lines(got)
    assert "chr" in plan.split("PushedFilters")[0] and "GreaterThanOrEqual(start,4985)" in plan and "LessThanOrEqual(start,5040)" in plan
    assert K.read_intervals(spark, str(tmp_path / "s"), ["z"], 0, 10**9).count() == 0


@pytest.mark.parametrize("limit", [None, 7])
def test_hot_bin_of_the_overlap_join(spark, monkeypatch, limit):
    """One bin holds two thirds of all features; default arguments apart from the size that counts as hot."""
    features = [("1", 100 + k % 3, 103 + k % 5, k) for k in range(200)] + [("1", 1000 * k, 1000 * k + 50, 1000 + k) for k in range(100)]
    regions = [("1", 95 + 2 * k, 99 + 2 * k, k) for k in range(10)] + [("1", 500 * k, 500 * k + 700, 100 + k) for k in range(20)]
    f = spark.createDataFrame(features, "chr string, start long, end long, fid long")
    r = spark.createDataFrame(regions, "chr string, start long, end long, id long")
    more = {} if limit is None else {"hot_bin_rows": limit}
    got = sorted((x["fid"], x["region_id"]) for x in I.overlap_join(f, r, "half", **more).collect())
    want = sorted((a[3], b[3]) for a in features for b in regions if a[1] < b[2] and a[2] > b[1])
    assert got == want


def test_service_answers_and_reader(spark):
    answers = spark.createDataFrame([('[{"c":"1","s":5,"x":"a"},{"c":"2","s":7}]',), ("[]",), ("no json",), (None,)], "value string")
    rows = T.parse_service_response(answers, "c string, s long, x string", {"c": "chr", "s": "start"})
    assert rows.columns == ["chr", "start", "x"]
    assert sorted((r["chr"], r["start"], r["x"]) for r in rows.collect()) == [("1", 5, "a"), ("2", 7, None)]
    T.register_reader("three", lambda spark, **region: spark.range(3).select(F.lit(region["chr"]).alias("chr"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 5).alias("end")))
    assert [r["start"] for r in T.read_with("three", spark, chr="9", start=8, end=12).collect()] == [10]


def test_overlaps_come_bin_by_bin(spark):
    """A written result repeats few values at a time: rows of one bin lie together, by start of the feature."""
    import __spark_entry__ as entry

    rows = entry.queries()["overlap_join"](spark, "/root/testdata/sf0.01").collect()
    cells = [(x["chr"], max(x["start"], x["region_start"]) // 512) for x in rows]
    follows = [a == b for a, b in zip(cells, cells[1:])]
    assert len(rows) - sum(follows) == len(set(cells)) > 100
    assert all(a["start"] <= b["start"] for a, b, same in zip(rows, rows[1:], follows) if same)


@pytest.mark.parametrize("kind", ["seg", "mut", "sum"])
def test_totals_come_feature_by_feature(spark, monkeypatch, kind):
    """A written result repeats few values at a time: totals lie by their first feature, each with its regions in order."""
    f = spark.createDataFrame([("1", 100 + k % 7, 200, 997 * k % 50, 3 + k % 2) for k in range(50)], "chr string, start long, end long, sample long, value long")
    r = spark.createDataFrame([("1", 90 + 11 * k % 20, 150, k) for k in range(20)], "chr string, start long, end long, region_id long")
    layout = I.JoinLayout(512)
    rows = [tuple(x) for x in I.region_scores(f, r, kind, layout=layout).collect()]
    assert len(rows) == 1000 and [x[0] for x in rows] == [x[0] for x in rows[:20]] * 50
    assert all(len({x[1] for x in rows[k : k + 20]}) == 1 for k in range(0, 1000, 20))
    monkeypatch.setattr(I, "ORDERED_ROWS", 120)
    monkeypatch.setattr(I, "BATCH_ROWS", 7)
    assert sorted(tuple(x) for x in I.region_scores(f, r, kind, layout=layout).collect()) == sorted(rows)


@pytest.mark.parametrize("score", [0.0000005, -0.0000005, 2.0078125, -2.0078125, 1.0000015, 12345.6789012, 0.0, 1e7 / 3, None])
def test_region_scores_rounds_as_before(spark, monkeypatch, score):
    from genospan.plans import interval_queries as Q

    made = spark.createDataFrame([(1, 2, score)], "region_id long, sample long, score double")
    monkeypatch.setattr(I, "region_scores", lambda *a, **b: made)
    got = Q.region_scores(spark, "/root/testdata/sf0.001").first()["score"]
    assert got == made.select(F.round("score", 6)).first()[0]


@pytest.mark.parametrize("limit", [2_000_000, 7])
def test_clustered_overlaps_are_the_same_pairs(spark, limit):
    features = [("1", 100 + k % 3, 103 + k % 5, k) for k in range(200)] + [("1", 1000 * k, 1000 * k + 5000 * (k % 9), 1000 + k) for k in range(100)]
    features += [(None, 100, 103, 5000), ("1", None, 103, 5001), ("1", 100, None, 5002), ("2", 7, 9, 5003), ("2", 7, 9, 5003)]
    regions = [("1", 95 + 2 * k, 99 + 2 * k, k) for k in range(10)] + [("1", 500 * k, 500 * k + 700, 100 + k) for k in range(20)]
    regions += [(None, 90, 200, 300), ("2", 0, 10, 301), ("2", 0, None, 302)]
    f = spark.createDataFrame(features, "chr string, start long, end long, fid long")
    r = spark.createDataFrame(regions, "chr string, start long, end long, id long")
    want = sorted((a[3], b[3]) for a in features for b in regions if None not in (*a, *b) and a[0] == b[0] and a[1] < b[2] and a[2] > b[1])
    for layout in (None, I.JoinLayout(64), I.JoinLayout(64, 1, 1)):
        for hint in ("broadcast", "merge"):
            found = I.overlap_join(f, r.hint(hint), "half", layout=layout, hot_bin_rows=limit, clustered=True)
            assert sorted((x["fid"], x["region_id"]) for x in found.collect()) == want
