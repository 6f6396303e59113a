from datetime import date

import pytest
from pyspark.sql import functions as F

from statloom.functions import periods as P
from statloom.functions import text as T
from statloom.operators import cleaning as C
from statloom.operators import resolve as R
from statloom.operators import validate as V
from statloom.operators import vintage as N

OBS = (
    "indicator_id string, place string, period_start date, period_end date, period_label string, value double, is_provisional boolean"
)


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "want"),
    [("J & K", "j and k"), ("The Dadra* 12", "dadra"), ("Ōdisha", "odisha"), ("A. & N.  Islands (UT)", "a and n islands ut"), ("Ĳsland", "ijsland"), (None, None)],
)
def test_normalize_name(spark, raw, want):
    assert one(spark, raw, T.normalize_name) == want


def test_every_character_with_an_ascii_part_is_folded(spark):
    df = spark.createDataFrame([("Ⅳ ﬁ Ⓐ",), ("𝐊𝐞𝐫𝐚𝐥𝐚 ㎏ ½",), ("Ⓔn Ġ क़िला",), ("plain & simple",), (None,)], "c string")
    rows = df.select(T.normalize_name(F.col("c")), T.normalize_text(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [
        ("iv fi a", "iv fi a"), ("kerala kg", "kerala kg 1 2"), ("en g", "en g \u0915\u093c\u093f\u0932\u093e"),
        ("plain and simple", "plain and simple"), (None, None),
    ]


def test_person_cells(spark):
    cells = ["'''Shri A Kumar''', IAS", "B Rao (in-charge)", "align=center|C Das, Indian Police Service", "{{x|y}}D (born 1960)", "", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [tuple(r) for r in df.select(*T.clean_person(F.col("c"))).collect()]
    assert got == [
        ("A Kumar", False, False), ("B Rao", True, False), ("C Das", False, False), ("D (born 1960)", False, False), ("", False, False), (None, None, None)
    ]


def test_numbers(spark):
    assert one(spark, "1,234.5", T.clean_number) == 1234.5
    assert one(spark, "(12.0)", T.clean_number) == 12.0
    assert [one(spark, x, T.clean_number) for x in ("NA", "-", "*", "", "abc")] == [None] * 5
    assert one(spark, "1,051 *", lambda c: T.number_and_flag(c)[0]) == 1051.0
    assert one(spark, "1,051*", lambda c: T.number_and_flag(c)[1]) is True


def test_footnotes_and_status(spark):
    assert one(spark, "stunted (height-for-age)18 (%)", T.strip_footnotes) == "stunted (height-for-age) (%)"
    assert one(spark, "2023-24 (RE)", lambda c: T.status_of(c)[1]) == "RE"
    assert one(spark, "2023-24", lambda c: T.status_of(c)[1]) == "A"
    assert one(spark, "total", lambda c: T.status_of(c)[1]) is None


@pytest.mark.parametrize(
    ("label", "start", "end", "shown"),
    [
        ("2023-24", date(2023, 4, 1), date(2024, 3, 31), "2023-24"),
        ("FY 2023-2024", date(2023, 4, 1), date(2024, 3, 31), "2023-24"),
        ("1999-00", date(1999, 4, 1), date(2000, 3, 31), "1999-00"),
        ("2024*", date(2024, 1, 1), date(2024, 12, 31), "2024"),
        ("June, 2026", date(2026, 6, 1), date(2026, 6, 30), "Jun 2026"),
        ("Feb 2024", date(2024, 2, 1), date(2024, 2, 29), "Feb 2024"),
    ],
)
def test_period_labels(spark, label, start, end, shown):
    df = spark.createDataFrame([(label,)], "l string")
    good, bad = P.parse_period(df, "l")
    row = good.first()
    assert (row.period_start, row.period_end, row.period_label) == (start, end, shown)
    assert bad.count() == 0


@pytest.mark.parametrize("label", ["2023-25", "2023-2025", "Foo 2024", "n/a", ""])
def test_rejected_labels(spark, label):
    good, bad = P.parse_period(spark.createDataFrame([(label,)], "l string"), "l")
    assert good.count() == 0 and bad.count() == 1


def test_fiscal_quarters_and_midpoint(spark):
    df = spark.range(1)
    q4 = df.select(*P.fiscal_quarter(F.lit(2023), F.lit(4)).columns()).first()
    assert (q4.period_start, q4.period_end, q4.period_label) == (date(2024, 1, 1), date(2024, 3, 31), "Q4 2023-24")
    mid = df.select(P.midpoint(F.lit(date(2023, 1, 1)), F.lit(date(2023, 12, 31))).alias("m")).first().m
    assert mid == date(2023, 7, 2)


@pytest.fixture(scope="module")
def names(spark):
    places = spark.createDataFrame(
        [
            ("old-a", "Alpha", "state", None, date(2014, 6, 1)), ("a", "Alpha", "state", date(2014, 6, 2), None),
            ("b", "Beta", "state", date(2014, 6, 2), None), ("x", "Twin", "state", None, None), ("y", "Twin", "ut", None, None),
            ("town", "Gamma", "city", None, None),
        ],
        "slug string, name string, type string, valid_from date, valid_to date",
    )
    aliases = spark.createDataFrame(
        [("Bêta & Co", "b", None, None), ("Older", "a", None, date(2015, 12, 31))], "alias string, slug string, period_from date, period_to date"
    )
    return R.name_table(places, aliases)


@pytest.mark.parametrize(
    ("raw", "year", "place", "state"),
    [
        ("ALPHA", 2010, "old-a", "matched"), ("Alpha*", 2020, "a", "matched"), ("beta and co", 2020, "b", "matched"),
        ("Beta", 2010, None, "out of validity"), ("Twin", 2020, None, "ambiguous"), ("Nowhere", 2020, None, "unknown"),
        ("Total (States)", 2020, None, "skipped"), ("Gamma", 2020, None, "out of validity"), ("Older", 2015, "a", "matched"),
        ("Older", 2016, None, "out of validity"),
    ],
)
def test_resolution_follows_the_period(spark, names, raw, year, place, state):
    df = spark.createDataFrame([(raw, date(year, 1, 1), date(year, 12, 31))], "raw string, period_start date, period_end date")
    row = R.resolve(df, names, "raw").first()
    assert (row.place, row.resolution) == (place, state)


def test_loading_twice_writes_nothing(spark, tmp_path):
    from statloom.sources.exports import append_vintage

    path = str(tmp_path / "history")
    y = (date(2020, 1, 1), date(2020, 12, 31), "2020")
    batch = [("i", p, *y, v, False) for p, v in (("a", 1.0), ("b", 2.0))]
    first = spark.createDataFrame(batch, OBS).withColumn("run_id", F.lit(1)).withColumn("change", F.lit("new"))
    append_vintage(first, path)

    def load(rows, run):
        latest = N.latest_vintage(spark.read.parquet(path).select(*N.KEY, "value", "is_provisional", "run_id"))
        changes = N.detect_changes(spark.createDataFrame(rows, OBS).withColumn("run_id", F.lit(run)), latest)
        counts = N.load_counts(changes).first()
        append_vintage(changes, path)
        return tuple(counts)

    assert load(batch, 2) == (2, 0, 0, 2)
    assert load([("i", "a", *y, 1.5, False), batch[1]], 3) == (2, 0, 1, 1)
    assert load([("i", "a", *y, 1.5, True), batch[1]], 4) == (2, 0, 1, 1)
    assert spark.read.parquet(path).count() == 4


def test_validation_rules(spark):
    y = (date(2020, 1, 1), date(2020, 12, 31), "2020")
    rows = [
        ("i", "a", *y, 5.0, False), ("i", "a", *y, 6.0, False), ("i", "b", *y, -1.0, False), ("i", "c", *y, 101.0, False),
        ("i", "d", *y, float("nan"), False), ("j", "a", *y, 5.0, False),
    ]
    indicators = spark.createDataFrame([("i", 0.0, 100.0)], "indicator_id string, valid_min double, valid_max double")
    got = sorted((r.rule, r.key) for r in V.validate(spark.createDataFrame(rows, OBS), indicators).collect())
    assert got == [
        ("above maximum", "i c 2020"), ("below minimum", "i b 2020"), ("duplicate", "i a 2020-01-01 2020-12-31"),
        ("not a number", "i d 2020"), ("unknown indicator", "j"),
    ]


def test_unknown_place_refuses_the_batch(spark):
    y = (date(2020, 1, 1), date(2020, 12, 31), "2020")
    obs = spark.createDataFrame([("i", "a", *y, 1.0, False), ("i", "zz", *y, 1.0, False)], OBS)
    places = spark.createDataFrame([("a",)], "slug string")
    with pytest.raises(ValueError):
        N.assert_known_places(obs, places)
    N.assert_known_places(obs.filter("place = 'a'"), places)


def test_release_summary(spark):
    def row(place, y, run):
        return ("i", place, date(y, 1, 1), date(y, 12, 31), str(y), 1.0, False, run)

    obs = spark.createDataFrame([row("a", 2020, 1), row("a", 2020, 2), row("a", 2021, 2)], OBS + ", run_id long")
    runs = spark.createDataFrame([(2, "loaded"), (9, "loaded")], "run_id long, status string")
    event = N.release_events(obs, runs).collect()
    assert len(event) == 1
    assert event[0].summary == "1 new and 1 revised figures across 1 indicator"
    assert event[0].periods == ["2021", "2020"]


def test_fingerprint_ignores_order_but_not_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    digest = N.fingerprint(a, ["i", "s"]).first().digest
    assert N.fingerprint(a.orderBy(F.desc("i")).repartition(3), ["i", "s"]).first().digest == digest
    assert N.fingerprint(a.union(a), ["i", "s"]).first().digest != digest


def test_guarded_relabel(spark):
    df = spark.createDataFrame([("x",), ("y",)], "l string")
    read, problem = C.guarded_relabel(df, "l", {"x": "1", "y": "2"})
    assert sorted(r.l for r in read.collect()) == ["1", "2"] and problem.count() == 0
    read, problem = C.guarded_relabel(df, "l", {"x": "1"})
    assert read.count() == 0 and problem.count() == 1
