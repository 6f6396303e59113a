"""The bucketed operators against plain windows, with one key that holds most rows."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from statloom.operators import skew as K


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(7)
    pool = [-1e9, -3.5, -1e-7, 0.0, 1e-300, 2.0, 2.0000001, 77.0, 1e12]
    rows = [("hot", rng.choice(pool) if rng.random() < 0.5 else rng.uniform(-100, 100)) for _ in range(3000)]
    rows += [(f"g{i % 7}", rng.gauss(0, 1) * 10 ** rng.randint(-5, 5)) for i in range(700)] + [("one", 5.0), ("one", None)]
    return spark.createDataFrame(rows, "g string, v double")


def test_competition_rank(numbers):
    for descending in (True, False):
        order = F.col("v").desc() if descending else F.col("v")
        plain = numbers.filter("v is not null").withColumn("r", F.rank().over(Window.partitionBy("g").orderBy(order)))
        ours = K.competition_rank(numbers, ["g"], "v", "r", descending)
        assert ours.count() == numbers.count()
        assert sorted(map(tuple, plain.collect())) == sorted(tuple(r) for r in ours.filter("v is not null").collect())
        assert ours.filter("v is null and r is not null").count() == 0


def test_exact_percentiles(numbers):
    qs = {"low": 0.025, "mid": 0.5, "high": 0.975}
    want = numbers.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in qs.items()])
    got = {r.g: r for r in K.exact_percentiles(numbers, ["g"], "v", qs).collect()}
    for r in want.collect():
        for n in qs:
            assert got[r.g][n] == pytest.approx(r[n], rel=1e-12, abs=1e-300)


def test_narrow_ranges_are_cut_again(spark, monkeypatch):
    """Values near one level fall into one or two buckets, whose parts stay small."""
    monkeypatch.setattr(K, "BUCKET_VALUES", 50)
    rng = random.Random(5)
    rows = [("hot", 100 + rng.random() / 100) for _ in range(2000)] + [("hot", 100.005)] * 30 + [("other", -100 - rng.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v double")
    plain = df.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy("v")))
    ours = K.competition_rank(df, ["g"], "v", "r", descending=False)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ours.collect()))


def test_order_bucket_never_falls(spark):
    rng = random.Random(1)
    values = sorted({rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(4000)} | {0.0, 5e-324, -5e-324, 1.7e308})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    buckets = [r.b for r in df.select("v", K.order_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert buckets == sorted(buckets)


def test_neighbours_bridge_buckets(spark):
    rng = random.Random(3)
    rows = [("hot", date(2000, 1, 1) + timedelta(days=rng.randint(0, 900)), f"t{i}") for i in range(400)]
    rows += [("cold", date(2000, 1, 1), "x"), ("cold", date(2003, 5, 5), "y")]
    df = spark.createDataFrame(rows, "k string, start date, id string")
    w = Window.partitionBy("k").orderBy("start", "id")
    plain = df.select("id", F.lag("id").over(w).alias("p"), F.lead("id").over(w).alias("n"))
    ours = K.neighbours(df, ["k"], ["start", "id"], F.trunc("start", "month"), ["id"])
    ours = ours.select("id", F.col("previous.id").alias("p"), F.col("following.id").alias("n"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, ours.collect()))


def test_newest_and_top_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, o int, v string")
    assert {tuple(r) for r in K.newest(df, ["k"], ["o"]).collect()} == {("a", 3, "y"), ("b", 2, "z")}
    assert {r.v for r in K.top_rows(df, ["k"], [F.col("o")], 1).collect()} == {"x", "z"}


def test_top_rows_limit_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = K.top_rows(df, ["k"], [F.col("id")], 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
