from datetime import date

import pytest
from pyspark.sql import functions as F

from statloom.operators import terms as T

TODAY = date(2026, 1, 1)
RAW = (
    "statement_id string, position string, person string, person_name string, start date, end date, parties array<struct<party:string,label:string>>"
)


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame(
        [("old", date(1900, 1, 1), date(2014, 6, 1)), ("new", date(2014, 6, 2), None)], "slug string, valid_from date, valid_to date"
    )


@pytest.fixture(scope="module")
def positions(spark):
    return spark.createDataFrame(
        [("P1", "old", "chief_minister", "Chief"), ("P1", "new", "chief_minister", "Chief")], "position string, place string, office_type string, title string"
    )


def build(spark, places, positions, rows):
    raw = spark.createDataFrame(rows, RAW)
    return T.build_terms(raw, positions, places, TODAY, date(2000, 1, 1))


def test_terms_are_clipped_at_the_split(spark, places, positions):
    rows = [
        ("s1", "P1", "Q1", "Ann", date(2010, 1, 1), date(2016, 1, 1), []), ("s2", "P1", "Q1", "Ann", date(2010, 1, 1), date(2016, 1, 1), []),
        ("s3", "P1", "Q2", "Bob", date(2015, 1, 1), None, []), ("s4", "P1", "Q3", "Old", date(1990, 1, 1), date(1999, 1, 1), []),
        ("s5", "P1", "Q4", "Nil", None, None, []),
    ]
    got = {(r.external_id, r.start, r.end) for r in build(spark, places, positions, rows).collect()}
    assert got == {
        ("s1:old", date(2010, 1, 1), date(2014, 6, 1)), ("s1:new", date(2014, 6, 2), date(2016, 1, 1)), ("s3:new", date(2015, 1, 1), None),
    }
    problems = T.undated_problems(spark.createDataFrame(rows, RAW), date(2000, 1, 1)).collect()
    assert [p.problem for p in problems] == ["Nil (Q4): term has no start date; skipped"]


def test_party_needs_agreement(spark, places, positions):
    a, b = ("A", "Party A"), ("B", "Party B")
    rows = [
        ("s1", "P1", "Q1", "Ann", date(2015, 1, 1), None, [a]), ("s2", "P1", "Q2", "Bob", date(2015, 1, 1), None, [a]),
        ("s3", "P1", "Q3", "Cid", date(2015, 1, 1), None, []), ("s4", "P1", "Q4", "Dan", date(2015, 1, 1), None, [a, b]),
    ]
    members = spark.createDataFrame(
        [("Q1", "A", "Party A", None, None), ("Q2", "B", "Party B", None, None), ("Q2", "A", "Party A", None, date(2014, 1, 1))],
        "person string, party string, label string, start date, end date",
    )
    got = {r.person: (r.party, list(r.advisories)) for r in T.resolve_party(build(spark, places, positions, rows), members).collect()}
    assert got["Q1"] == ("A", [])
    assert got["Q2"] == (None, ["party sources disagree"])
    assert got["Q3"] == (None, ["no party recorded"])
    assert got["Q4"] == (None, ["several possible parties: Party A, Party B"])


def test_notes(spark, places, positions):
    rows = [("s1", "P1", "Q1", "Q1", date(2015, 1, 1), None, []), ("s2", "P1", "Q2", "Bob", date(2016, 1, 1), date(2015, 1, 1), [])]
    got = {r.person: list(r.notes) for r in T.term_notes(build(spark, places, positions, rows), TODAY).collect()}
    assert got["Q1"] == [T.NO_NAME, f"in office since 2015-01-01 with no end date; {T.STALE}"]
    assert got["Q2"] == ["term ends before it starts"]


def test_holders_are_matched_to_the_period(spark):
    terms = spark.createDataFrame(
        [("x", "A", date(2016, 1, 1), date(2021, 5, 1)), ("x", "B", date(2021, 5, 2), None), ("y", "C", date(2000, 1, 1), None)],
        "place string, person string, start date, end date",
    )
    years = [(p, date(y, 1, 1), date(y, 12, 31), str(y)) for p in ("x", "y") for y in (1999, 2019, 2021, 2024)]
    periods = spark.createDataFrame(years, "place string, period_start date, period_end date, period_label string")
    got = sorted((r.place, r.period_label, r.person) for r in T.holders_during(terms, periods).collect())
    assert got == [("x", "2019", "A"), ("x", "2021", "A"), ("x", "2021", "B"), ("x", "2024", "B"), ("y", "2019", "C"), ("y", "2021", "C"), ("y", "2024", "C")]


def test_holders_during_periods_over_several_years(spark):
    terms = spark.createDataFrame([("x", "A", date(2016, 3, 1), date(2023, 5, 1))], "place string, person string, start date, end date")
    periods = spark.createDataFrame([("x", date(2015, 1, 1), date(2030, 12, 31), "long")], "place string, period_start date, period_end date, period_label string")
    assert T.holders_during(terms, periods).count() == 1


STATE = "external_id string, place string, office_type string, person_name string, start date, end date, verified date, note string"


def test_observed_terms_open_persist_and_close(spark):
    def listed(*names):
        return spark.createDataFrame([("x", "dgp", n, "seen") for n in names], "place string, office_type string, person_name string, note string")

    def day(n):
        return date(2026, 1, n)

    state = spark.createDataFrame([], STATE)
    first = T.observe(state, listed("Ann"), day(1))
    assert tuple(T.observe_counts(first).first()) == (1, 0, 0)
    second = T.observe(first.drop("action"), listed("Ann"), day(2))
    assert tuple(T.observe_counts(second).first()) == (0, 0, 1)
    third = T.observe(second.drop("action"), listed("Bob"), day(3))
    assert tuple(T.observe_counts(third).first()) == (1, 1, 0)
    fourth = T.observe(third.drop("action"), listed("Ann"), day(4))
    got = {r.person_name: (r.start, r.end, r.action) for r in fourth.collect()}
    assert got == {"Ann": (day(1), None, "reopened"), "Bob": (day(3), day(3), "closed")}
    with pytest.raises(ValueError):
        T.assert_enough(listed("Ann"))


def test_offices_that_are_not_listed_stay_open(spark):
    state = spark.createDataFrame([("e", "y", "dgp", "Cid", date(2020, 1, 1), None, None, None)], STATE)
    listed = spark.createDataFrame([("x", "dgp", "Ann", None)], "place string, office_type string, person_name string, note string")
    got = {r.person_name: r.action for r in T.observe(state, listed, TODAY).collect()}
    assert got == {"Cid": "kept", "Ann": "opened"}


def test_fingerprint_of_terms_sees_a_change(spark):
    rows = spark.createDataFrame([("e", "p", date(2020, 1, 1), None, "A", False)], "external_id string, person string, start date, end date, party string, needs_review boolean")
    changed = rows.withColumn("party", F.lit("B"))
    assert T.terms_fingerprint(rows).first().digest != T.terms_fingerprint(changed).first().digest


def test_redirects_of_any_length_and_circles(spark):
    hops = [(f"a{i}", f"a{i + 1}") for i in range(37)] + [("x", "y"), ("y", "z"), ("z", "y"), ("s", "s"), ("u", "v"), ("u", "w"), (None, "a1"), ("b", None)]
    asked = ["a0", "a5", "a36", "a37", "x", "y", "s", "u", "b", "other", None, "a0"]
    titles = spark.createDataFrame([(t,) for t in asked], "title string")
    got = sorted((str(r.title), r.final, r.circular) for r in T.follow_redirects(titles, spark.createDataFrame(hops, "source string, target string")).collect())
    chain = [("a0", "a37", False), ("a0", "a37", False), ("a36", "a37", False), ("a37", "a37", False), ("a5", "a37", False)]
    assert got == sorted([*chain, ("x", None, True), ("y", None, True), ("s", None, True), ("u", "v", False), ("b", "b", False), ("other", "other", False), ("None", None, False)], key=lambda r: r[0])
    empty = spark.createDataFrame([], "source string, target string")
    assert T.follow_redirects(titles, empty).filter("final <=> title and not circular").count() == len(asked)
