"""Tables of cities and of suicides, read from page text."""

from datetime import date

import pytest

from statloom.operators import resolve as R
from statloom.plans import jobs as J

PAGES = "doc_id long, year int, page int, text string"
TABLES = {"1B.3": J.CityTable(r"^TABLE 1B\.3", "crime", "charge"), "2B.1": J.CityTable(r"^TABLE 2B\.1", "murder")}


@pytest.fixture(scope="module")
def ref(spark):
    day = "date"
    places = spark.createDataFrame(
        [("goa", "Goa", "state", None, None), ("assam", "Assam", "state", None, None), ("india", "India", "country", None, None)],
        f"slug string, name string, type string, valid_from {day}, valid_to {day}",
    )
    aliases = spark.createDataFrame([("All India", "india", None, None)], f"alias string, slug string, period_from {day}, period_to {day}")
    cities = spark.createDataFrame([("goa", "panaji", "panaji"), ("assam", "guwahati", "guwahati"), ("x", "twin", "one"), ("y", "twin", "two")], "parent string, key string, city string")
    return J.Reference(R.name_table(places, aliases), date(2024, 1, 1), "india", cities=cities)


def figures(result):
    return {(r.indicator_id, r.place, r.period_label): r.value for r in result[0].collect()}, sorted(r.problem for r in result[1].collect())


def test_cities(spark, ref):
    pages = spark.createDataFrame([
        (1, 2021, 1, "TABLE 1B.3\nCities\n1 Panaji 10 20 30 2.0 15.0 60.5\nGuwahati\n2 1,000 - 3,000 4.0 - -\n3 Atlantis 1 1 1 1.0 1.0 1.0\n4 Panaji 1 2"),
        (2, 2022, 1, "TABLE 1B.3\n1 Panaji 22 33 44 2.0 - 61.0\n2 Guwahati 1 2 3 - 7.5 -\n3 Twin 1 1 1 1.0 1.0 1.0"),
        (2, 2022, 2, "TABLE 2B.1\n1 Panaji 1 2 3 2.0 1.5 -"),
        (2, 2022, 3, "TABLE 9Z.9\n1 Panaji 1 2 3 2.0 99 99"),
    ], PAGES)
    got, problems = figures(J.metro_crime({"pages": pages}, ref, TABLES, 2))
    assert got == {
        ("crime", "panaji", "2021"): 15.0, ("crime", "panaji", "2020"): 10.0, ("crime", "panaji", "2019"): 5.0,
        ("crime", "guwahati", "2019"): 250.0, ("crime", "guwahati", "2022"): 7.5,
        ("charge", "panaji", "2021"): 60.5, ("charge", "panaji", "2022"): 61.0,
        ("murder", "panaji", "2022"): 1.5, ("murder", "panaji", "2021"): 1.0, ("murder", "panaji", "2020"): 0.5,
    }
    assert problems == [
        "table 1B.3 of 1: unknown city 'Atlantis'", "table 1B.3 of 2: unknown city 'Twin'", "table 2B.1 of 1: not found", "table 2B.1 of 2: few cities read",
    ]


def test_suicides_stop_at_the_total(spark, ref):
    pages = spark.createDataFrame([
        (1, 2023, 1, "Incidence and Rate of Suicides - 2023\n1 Goa 30 1.0 15.0 20.5\n2 Goa 1 1 1 1.0"),
        (1, 2023, 2, "3 Assam 60 2.0 350.0 -\nTOTAL (ALL INDIA) 90 100.0 1400 12.3\n1 Assam 7 7 7 7.0"),
        (1, 2023, 3, "2 Assam 8 8 8 8.0"),
        (2, 2022, 1, "Incidence and Rate of Suicides – 2021\n1 Assam 60 2.0 350.0 4.5"),
        (3, 2020, 1, None), (4, 2020, 1, ""),
    ], PAGES)
    got, problems = figures(J.suicides({"pages": pages}, ref, 2))
    assert got == {("suicide-rate", "goa", "2023"): 20.5, ("suicide-rate", "india", "2023"): 12.3, ("suicide-rate", "assam", "2022"): 4.5}
    assert problems == sorted([
        "table of suicides of 2: title not found", "table of suicides of 2: few rows read",
        *[f"table of suicides of {d}: {what}" for d in (3, 4) for what in ("title not found", "not found")],
    ])
    assert J.suicides({"pages": pages.limit(0)}, ref)[0].count() == 0


def test_road_deaths_without_year_columns(spark, ref):
    people = spark.createDataFrame([("goa", 2020, 1_000_000.0)], "place string, year int, people double")
    with_people = J.Reference(ref.names, ref.today, ref.national, people)
    good = spark.createDataFrame([("Goa", "50")], "state string, `2020 Killed` string")
    got, problems = figures(J.road_deaths({"wide": good}, with_people, 2019))
    assert got == {("road-deaths", "goa", "2020"): 5.0} and problems == []
    lost = good.withColumnRenamed("2020 Killed", "Persons killed in 2020")
    assert figures(J.road_deaths({"wide": lost}, with_people, 2019)) == ({}, ["road deaths: no column of a year with figures"])
