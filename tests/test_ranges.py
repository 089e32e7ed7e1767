import random

from quillgrid.operators import ranges


def test_counts_at_ends_and_of_many_equal_values(spark):
    rng = random.Random(7)
    nan, inf = float("nan"), float("inf")
    points = [rng.choice([0.0, -0.0, 1.0, 2.5, 4.0, -3.0, inf, nan, None]) for _ in range(400)]
    boxes = [(k % 50 if k % 7 else None, *sorted(rng.choice([0.0, -0.0, 1.0, 2.5, 4.0, -3.0, 3.0]) for _ in range(2))) for k in range(120)]
    boxes += [(60, 3.0, 1.0), (61, None, 1.0), (62, 1.0, inf), (63, nan, nan), (64, -inf, nan), (65, 5.0, 6.0)]
    p, b = spark.createDataFrame([(v,) for v in points], "v double"), spark.createDataFrame(boxes, "k long, lo double, hi double")
    got = {r["k"]: r["n"] for r in ranges.count_within(p, "v", b, "k", "lo", "hi").collect()}
    want = {r["k"]: r["n"] for r in b.join(p, p["v"].between(b["lo"], b["hi"])).groupBy("k").count().withColumnRenamed("count", "n").collect()}
    assert got == want and None in got and 65 not in got and 60 not in got


def test_work_does_not_grow_with_the_pairs(spark, tmp_path):
    """Every box holds every point: 4e9 pairs, which no join can make in a test's time."""
    p, b = spark.range(200_000).selectExpr("double(id % 100) AS v"), spark.range(20_000).selectExpr("id AS k", "-1.0D AS lo", "100.0D AS hi")
    got = ranges.count_within(p, "v", b, "k", "lo", "hi").selectExpr("count(*) AS keys", "min(n) AS low", "max(n) AS high").first()
    assert (got["keys"], got["low"], got["high"]) == (20_000, 200_000, 200_000)


def test_the_query_makes_no_pairs(spark, sf):
    from quillgrid.catalog import QUERIES

    plan = QUERIES["bbox_join"](spark, sf)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "Generate explode(sequence" not in plan and "c_acctbal" not in plan.split("== Physical Plan ==")[-1]
