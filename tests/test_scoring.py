from datetime import date

import pytest
from pyspark.sql import functions as F

from statloom.operators import scoring as S

SCHEMA = "indicator_id string, place string, period_start date, period_end date, period_label string, value double"


def year(y):
    return date(y, 1, 1), date(y, 12, 31), str(y)


def rows(spark, items):
    return spark.createDataFrame(items, SCHEMA)


def test_goalposts_are_percentiles_or_the_target(spark):
    values = [("a", f"p{i}", *year(2020), float(i)) for i in range(41)]
    values += [("b", f"p{i}", *year(2020), float(i)) for i in range(41)]
    values += [("a", "p0", *year(2010), 9999.0), ("a", "all", *year(2020), 9999.0)]
    specs = [S.IndicatorSpec("a", "x", "lower_better"), S.IndicatorSpec("b", "x", "higher_better", target=70.0)]
    got = {r.indicator_id: (r.worst, r.best) for r in S.goalposts(rows(spark, values), specs, date(2015, 1, 1), "all").collect()}
    assert got["a"] == pytest.approx((39.0, 1.0))
    assert got["b"] == pytest.approx((1.0, 70.0))


def test_common_period_and_fallbacks(spark):
    a, b = (date(2019, 1, 1), date(2021, 6, 30), "A"), (date(2023, 1, 1), date(2024, 6, 30), "B")
    items = [("i", p, *a, 1.0) for p in ("p1", "p2", "p3", "p4")] + [("i", p, *b, 2.0) for p in ("p1", "p2")]
    chosen = S.select_values(rows(spark, items), [(2024, date(2024, 12, 31))], "all").collect()
    assert {r.place: r.period_label for r in chosen} == dict.fromkeys(("p1", "p2", "p3", "p4"), "A")


def test_without_a_common_period_each_place_has_its_newest(spark):
    items = [("i", "p1", *year(2020), 1.0), ("i", "p2", *year(2021), 2.0), ("i", "p2", *year(2019), 3.0)]
    chosen = S.select_values(rows(spark, items), [(2024, date(2024, 12, 31))], "all").collect()
    assert {(r.place, r.period_label) for r in chosen} == {("p1", "2020"), ("p2", "2021")}


def test_values_too_old_or_in_the_future_are_ignored(spark):
    items = [("i", "p1", *year(2015), 1.0), ("i", "p1", *year(2026), 2.0)]
    assert S.select_values(rows(spark, items), [(2024, date(2024, 12, 31))], "all").count() == 0


def test_leap_day_cutoff(spark):
    items = [("i", "p1", date(2018, 1, 1), date(2018, 2, 28), "x", 1.0)]
    assert S.select_values(rows(spark, items), [(2024, date(2024, 2, 29))], "all").count() == 1


def test_ranks_are_shared_on_one_decimal(spark):
    scores = spark.createDataFrame(
        [(2024, "pillar", "k", "a", 70.04), (2024, "pillar", "k", "b", 70.01), (2024, "pillar", "k", "c", 65.0), (2024, "pillar", "k", "all", 99.0)],
        "edition int, level string, key string, place string, score double",
    )
    peers = spark.createDataFrame([("a", "g"), ("b", "h"), ("c", "g")], "place string, peer_group string")
    got = {r.place: (r.rank_overall, r.rank_peer) for r in S.rank_scores(scores, peers).collect()}
    assert got == {"a": (1, 1), "b": (1, 1), "c": (3, 2), "all": (None, None)}


def test_partial_coverage(spark):
    """Eight pillars of five indicators: three of five score in six pillars, two of five in two."""
    specs = [S.IndicatorSpec(f"i{p}{k}", f"p{p}", "higher_better") for p in range(8) for k in range(5)]
    have = [(p, k) for p in range(6) for k in range(3)] + [(p, k) for p in (6, 7) for k in range(2)]
    values = rows(spark, [(f"i{p}{k}", "x", *year(2023), 50.0) for p, k in have])
    posts = spark.createDataFrame([(s.id, 0.0, 100.0) for s in specs], "indicator_id string, worst double, best double")
    places = spark.createDataFrame([("x", "g"), ("empty", "g")], "place string, peer_group string")
    out = S.score_all(values, posts, specs, [], places, [(2024, date(2024, 12, 31))], "all", "main").collect()
    main = {r.place: r for r in out if r.level == "composite"}
    assert main["x"].score == pytest.approx(50.0)
    assert main["x"].coverage == pytest.approx(6 / 8)
    assert main["x"].rank_overall == 1
    assert main["empty"].score is None and main["empty"].coverage == 0.0
    low = [r for r in out if r.level == "pillar" and r.place == "x" and r.key in ("p6", "p7")]
    assert [r.score for r in low] == [None, None]
    assert all(r.coverage == pytest.approx(0.4) for r in low)
    assert len([r for r in out if r.level == "pillar"]) == 3 * 8


def test_hdi_needs_every_dimension(spark):
    index = S.IndexSpec("hdi", "hdi", {"Health": ["life"], "Knowledge": ["e1", "e2"], "Income": ["inc"]})
    values = [("life", "x", *year(2023), 85.0), ("e1", "x", *year(2023), 120.0), ("inc", "x", *year(2023), 500000.0)]
    values += [("life", "y", *year(2023), 70.0), ("e1", "y", *year(2023), 50.0)]
    specs = [S.IndicatorSpec(i, None, "higher_better") for i in ("life", "e1", "e2", "inc")]
    posts = spark.createDataFrame([], "indicator_id string, worst double, best double")
    places = spark.createDataFrame([("x", "g"), ("y", "g")], "place string, peer_group string")
    out = S.score_all(rows(spark, values), posts, specs + [S.IndicatorSpec("z", "p", "higher_better")], [index], places, [(2024, date(2024, 12, 31))], "all", "main")
    got = {r.place: r.score for r in out.filter("key = 'hdi'").collect()}
    assert got["x"] == pytest.approx(100.0)
    assert got["y"] is None


def test_log_scale(spark):
    df = spark.createDataFrame([(100.0, 10.0, 1000.0)], "v double, w double, b double")
    assert df.select(S.scaled(F.col("v"), F.col("w"), F.col("b"), F.lit(True))).first()[0] == pytest.approx(50.0)


def test_versions_compare_as_numbers(spark):
    stored = spark.createDataFrame(
        [("1.9", "i", 1.0, 2.0), ("1.10", "i", 3.0, 4.0), ("2.0", "j", 5.0, 6.0)], "version string, indicator_id string, worst double, best double"
    )
    assert [tuple(r) for r in S.inherit_latest(stored, "2.0").collect()] == [("i", 3.0, 4.0)]
