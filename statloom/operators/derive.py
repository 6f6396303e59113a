"""Derived indicators: rates, ratios, growth, rolling and year-to-date figures, gap filling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.text import round_at
from statloom.operators.skew import newest

# --- Denominators ------------------------------------------------------------------------------


def rate(
    df: DataFrame, population: DataFrame, keys: Sequence[str], per: float, value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """(value per `per` people, problems of keys without a denominator). `population`: keys + people."""
    joined = df.join(population.select(*keys, "people"), list(keys), "left")
    have = F.col("people") > 0
    missing = joined.filter(~F.coalesce(have, F.lit(False))).select(
        F.concat_ws(" ", *[F.col(k).cast("string") for k in keys], F.lit("has no denominator")).alias("problem")
    )
    rated = joined.filter(have).withColumn("rate", F.col(value) / F.col("people") * per).drop("people")
    return rated, missing.distinct()


def ratio(num: DataFrame, den: DataFrame, keys: Sequence[str], form: str = "percent", cap: float | None = None) -> DataFrame:
    """Two tables joined on their keys: num/den × 100, or num/(num + den) × 100 as a share."""
    a, b = F.col("a"), F.col("b")
    joined = num.select(*keys, F.col("value").alias("a")).join(den.select(*keys, F.col("value").alias("b")), list(keys))
    below = a + b if form == "share" else b
    value = F.when(below != 0, a / below * 100)
    if cap is not None:
        value = F.least(value, F.lit(cap))
    return joined.select(*keys, value.alias("value")).filter("value is not null")


def density(df: DataFrame, area: DataFrame, per: float, since: int) -> DataFrame:
    """Length per `per` units of area; flagged cells and years before `since` are skipped."""
    usable = df.filter((F.col("year") >= since) & ~F.col("flagged") & F.col("value").isNotNull())
    return usable.join(area.select("place", "area"), "place").select(
        "place", "year", (F.col("value") / F.col("area") * per).alias("value")
    )


def fill_missing(
    primary: DataFrame, fallback: DataFrame, keys: Sequence[str], primary_factor: float = 1.0
) -> DataFrame:
    """The primary source's value (times a unit factor), and the fallback's where it has none."""
    a = primary.select(*keys, (F.col("value") * primary_factor).alias("_a"))
    b = fallback.select(*keys, F.col("value").alias("_b"))
    joined = a.join(b, list(keys), "full")
    source = F.when(F.col("_a").isNotNull(), "primary").otherwise("fallback")
    return joined.select(*keys, F.coalesce("_a", "_b").alias("value"), source.alias("source"))


def only_uncovered(df: DataFrame, covered: DataFrame, keys: Sequence[str] = ("place",)) -> DataFrame:
    return df.join(covered.select(*keys).distinct(), list(keys), "left_anti")


def prefer(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of sources where, per key, the earliest listed source wins."""
    out = None
    for i, part in enumerate(parts):
        numbered = part.withColumn("_rank", F.lit(-i))
        out = numbered if out is None else out.unionByName(numbered)
    return newest(out, keys, ["_rank"]).drop("_rank")


def override_union(first: DataFrame, later: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both sources; the later one overrides per key."""
    return prefer([later, first], keys)


def back_rates(counts: DataFrame) -> DataFrame:
    """Own-year rates and the rates of earlier years from the counts an edition repeats.

    `counts`: place, year, rate, cases (array of counts, oldest first, ending the year before),
    people. Returns place, year, value, back (0 for the edition's own figure).
    """
    own = counts.select("place", "year", F.col("rate").alias("value"), F.lit(0).alias("back"))
    exploded = counts.select("place", "year", "people", F.size("cases").alias("_n"), F.posexplode("cases").alias("_i", "_c"))
    back = F.col("_n") - F.col("_i")
    earlier = exploded.filter(F.col("_c").isNotNull() & (F.col("people") > 0)).select(
        "place", (F.col("year") - back).alias("year"), round_at(F.col("_c") / F.col("people"), 1).alias("value"),
        back.alias("back"),
    )
    return own.filter("value is not null").unionByName(earlier)


def prefer_own_edition(df: DataFrame) -> DataFrame:
    """A year's own edition wins; figures recomputed by later editions only fill gaps."""
    closest = df.withColumn("_rank", -F.col("back"))
    return newest(closest, ["place", "year"], ["_rank"]).drop("_rank")


def sum_components(df: DataFrame, components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value of a place as the sum of its components' values. `components`: place, component."""
    parts = df.withColumnRenamed("place", "component").join(components, "component")
    return parts.groupBy("place", *keys).agg(F.sum("value").alias("value"))


def merge_successors(df: DataFrame, mapping: Mapping[str, str], since: date, combined: Sequence[str] = ()) -> DataFrame:
    """After the merger the old names mean the successor; a combined name back-filled to earlier
    years matches no single place and is dropped."""
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    after = F.col("period_end") >= F.lit(since)
    kept = df.filter(after | ~F.col("place").isin(list(combined)))
    return kept.withColumn("place", F.when(after, F.coalesce(literal[F.col("place")], F.col("place"))).otherwise(F.col("place")))


# --- Growth and rolling figures -----------------------------------------------------------------


def yoy_growth(df: DataFrame, keys: Sequence[str], year: str = "year") -> DataFrame:
    """Growth in % against the year before, where that year is there and positive.

    An equi join on (key, year): no series is sorted, and a missing year is no match.
    """
    base = df.select(*keys, (F.col(year) + 1).alias(year), F.col("value").alias("_base"))
    joined = df.join(base, [*keys, year]).filter("_base > 0")
    return joined.select(*keys, year, ((F.col("value") / F.col("_base") - 1) * 100).alias("growth"))


def rolling_mean_consecutive(df: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    """Mean over n consecutive periods, provisional if any is, labelled 'first to last'.

    Each row is added to the n windows it belongs to, so the sums combine before the shuffle. A
    window counts only if its periods follow each other day by day.
    """
    start = F.year("period_start")
    offered = df.withColumn("_w", F.explode(F.sequence(start, start + (n - 1))))
    days = F.datediff("period_end", "period_start") + 1
    grouped = offered.groupBy(*keys, "_w").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(days).alias("_days"), F.avg("value").alias("value"),
        F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"),
        F.min(F.struct("period_start", "period_label")).alias("_first"),
        F.max(F.struct("period_start", "period_label")).alias("_last"),
        F.max("is_provisional").alias("is_provisional"),
    )
    whole = (F.col("_n") == n) & (F.col("_days") == F.datediff("period_end", "period_start") + 1)
    label = F.concat("_first.period_label", F.lit(" to "), "_last.period_label")
    return grouped.filter(whole).select(
        *keys, "period_start", "period_end", label.alias("period_label"), "value", "is_provisional"
    )


def round_change(
    df: DataFrame, since: int = 2011, split: Sequence[str] = (), split_since: int = 2021
) -> DataFrame:
    """Change in % between successive rounds that were measured alike.

    `df`: place, year, value, flagged. A place has one row per round, so its window stays short.
    """
    rounds = Window.partitionBy("place").orderBy("year")
    before = df.select(
        "*", F.lag("year").over(rounds).alias("_y"), F.lag("value").over(rounds).alias("_v"),
        F.lag("flagged").over(rounds).alias("_f"),
    )
    alike = (F.col("_f") == F.col("flagged")) & (F.col("_y") >= since)
    allowed = ~F.col("place").isin(list(split)) | (F.col("_y") >= split_since)
    return before.filter(alike & allowed & (F.col("_v") != 0)).select(
        "place", "year", F.col("_y").alias("from_year"), ((F.col("value") - F.col("_v")) / F.col("_v") * 100).alias("change")
    )


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the source's own (explicit) order, reduced on the map side."""
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c) for c in [*order, *rest]])).alias("_f"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_f.{c}").alias(c) for c in df.columns])


# --- Aggregations ------------------------------------------------------------------------------


def component_ratio(df: DataFrame, keys: Sequence[str], part: str, num: str, den: str) -> DataFrame:
    """Sums of two components per key, their ratio capped at 1, in %."""

    def total(p: str) -> Column:
        return F.sum(F.when(F.col(part) == p, F.col("value")))

    sums = df.groupBy(*keys).agg(total(num).alias("num"), total(den).alias("den"))
    return sums.filter("den <> 0 and num is not null").withColumn(
        "value", F.least(F.col("num") / F.col("den"), F.lit(1.0)) * 100
    )


def preferred_mean(df: DataFrame, keys: Sequence[str], unit: str, source: str, order: Sequence[str], digits: int = 1) -> DataFrame:
    """Per unit the value of the best source it has, then the mean over the units of a key."""
    best = F.coalesce(*[F.max(F.when(F.col(source) == s, F.col("value"))) for s in order])
    units = df.groupBy(*keys, unit).agg(best.alias("value")).filter("value is not null")
    return units.groupBy(*keys).agg(
        round_at(F.avg("value"), digits).alias("value"), F.count(F.lit(1)).alias("units")
    )


def daily_rollup(readings: DataFrame, city_map: DataFrame, national: str) -> DataFrame:
    """Per day: state means with their worst city, and the mean over all readings, mapped or not.

    `readings`: day, city, value; `city_map`: city, state. Readings of a city and day are summed
    before anything is joined.
    """
    city_days = readings.groupBy("day", "city").agg(
        F.sum("value").alias("_sum"), F.count("value").alias("_n"), F.max("value").alias("_worst")
    )
    joined = city_days.join(city_map.select("city", "state"), "city", "left")
    # Every city day counts once for its state, where it has one, and once for the whole.
    placed = joined.withColumn(
        "place", F.explode(F.array_compact(F.array(F.col("state"), F.lit(national))))
    )
    return placed.groupBy("day", "place").agg(
        (F.sum("_sum") / F.sum("_n")).alias("mean"), F.sum("_n").alias("readings"),
        F.max(F.struct(F.col("_worst"), F.col("city"))).alias("_top"),
    ).select("day", "place", "mean", "readings", F.col("_top.city").alias("worst_city"), F.col("_top._worst").alias("worst"))


def annual_windows(quarterly: DataFrame, population: DataFrame, national: str) -> DataFrame:
    """Per person totals over complete calendar years, and over the latest four quarters.

    `quarterly`: place, year, quarter, value; `population`: place, year, people. The latest four
    quarters are left out when they are a calendar year. The national figure is the sum of places.
    """
    index = F.col("year") * 4 + F.col("quarter")
    quarters = quarterly.select("year", "quarter").distinct()  # one row per quarter of the calendar
    full = quarters.groupBy("year").agg(F.count(F.lit(1)).alias("n")).filter("n = 4")
    years = quarters.join(full.select("year"), "year").select(
        "year", "quarter", F.col("year").cast("string").alias("window"), F.col("year").alias("end_year")
    )
    last = quarters.orderBy(F.col("year").desc(), F.col("quarter").desc()).limit(4)
    bounds = last.agg(
        F.max(index).alias("_hi"), F.min(index).alias("_lo"), F.count(F.lit(1)).alias("_n"),
        F.max(F.struct("year", "quarter")).alias("_last"), F.min(F.struct("year", "quarter")).alias("_first"),
    ).filter("_n = 4 and _last.quarter <> 4")

    def text(c: str) -> Column:
        return F.concat(F.col(f"{c}.year").cast("string"), F.lit("Q"), F.col(f"{c}.quarter").cast("string"))

    trailing = (
        bounds.withColumn("_q", F.explode(F.sequence("_lo", "_hi")))
        .select(
            F.floor((F.col("_q") - 1) / 4).cast("int").alias("year"),
            (F.pmod(F.col("_q") - 1, F.lit(4)) + 1).cast("int").alias("quarter"),
            F.concat(text("_first"), F.lit("–"), text("_last")).alias("window"),
            F.col("_last.year").alias("end_year"),
        )
        .join(quarters, ["year", "quarter"], "left_semi")
    )
    windows = years.unionByName(trailing)
    placed = quarterly.withColumn("place", F.explode(F.array(F.col("place"), F.lit(national))))
    sums = placed.groupBy("place", "year", "quarter").agg(F.sum("value").alias("value")).join(
        windows, ["year", "quarter"]
    )
    totals = sums.groupBy("window", "end_year", "place").agg(F.sum("value").alias("total"))
    people = population.select("place", F.col("year").alias("end_year"), "people")
    return totals.join(people, ["place", "end_year"]).select(
        "place", "window", "total", (F.col("total") / F.col("people")).alias("per_person")
    )


def mean_if_complete(df: DataFrame, keys: Sequence[str], part: str, parts: Sequence[str]) -> DataFrame:
    """Mean of the named component series where all of them are present."""
    wanted = df.filter(F.col(part).isin(list(parts)))
    sums = wanted.groupBy(*keys).agg(
        F.avg("value").alias("value"), *[F.max(F.when(F.col(part) == p, 1)).alias(f"_{i}") for i, p in enumerate(parts)]
    )
    for i in range(len(parts)):
        sums = sums.filter(F.col(f"_{i}").isNotNull())
    return sums.select(*keys, "value")


def mean_of_means(df: DataFrame, subjects: Mapping[int, int], national: str) -> DataFrame:
    """Grade means over subjects, and the mean of grade means, for places with every grade.

    `df`: place, grade, subject, local, national; `subjects`: grade -> number of subjects. Each
    report repeats the national averages, so those of one complete report stand for the whole.
    """
    want = F.create_map(*[F.lit(x) for pair in subjects.items() for x in pair])
    grade = df.groupBy("place", "grade").agg(
        round_at(F.avg("local"), 1).alias("local"), round_at(F.avg("national"), 1).alias("national"),
        F.count(F.lit(1)).alias("_n"),
    )
    grade = grade.filter(F.col("_n") == want[F.col("grade")])
    # A place holds one row per grade here.
    cards = grade.groupBy("place").agg(
        F.collect_list(F.struct("grade", "local", "national")).alias("_g"),
        round_at(F.avg("local"), 1).alias("_local"), round_at(F.avg("national"), 1).alias("_national"),
    ).filter(F.size("_g") == len(subjects))

    def rows(place: Column, which: str) -> Column:
        per_grade = F.transform(
            "_g",
            lambda g: F.struct(
                place.alias("place"), F.concat(F.lit("grade-"), g["grade"].cast("string")).alias("key"), g[which].alias("value")
            ),
        )
        overall = F.struct(place.alias("place"), F.lit("overall").alias("key"), F.col(f"_{which}").alias("value"))
        return F.concat(per_grade, F.array(overall))

    own = cards.select(F.explode(rows(F.col("place"), "local")).alias("r")).select("r.*")
    one = newest(cards.withColumn("_one", F.lit(1)), ["_one"], ["place"])
    total = one.select(F.explode(rows(F.lit(national), "national")).alias("r")).select("r.*")
    return own.unionByName(total)


def mean_bodies(df: DataFrame, place: str, body: str) -> DataFrame:
    """Mean over the bodies that report for one place, with a note naming them when several do."""
    bodies = df.groupBy(place, body).agg(F.avg("value").alias("value"))
    names = F.array_join(F.array_sort(F.collect_list(body)), " and ")
    return bodies.groupBy(place).agg(
        F.floor(F.avg("value") + 0.5).cast("bigint").alias("value"),
        F.when(F.count(F.lit(1)) > 1, F.concat(F.lit("mean of "), names)).alias("note"),
    )


def annualise(df: DataFrame, keys: Sequence[str], months: Column) -> DataFrame:
    """Year-to-date totals scaled to twelve months. `months`: months covered by a row's period."""
    totals = df.withColumn("_m", months).groupBy(*keys, "_m").agg(F.sum("value").alias("total"))
    return totals.withColumn("value", F.col("total") * 12 / F.col("_m")).drop("_m")


def ytd_growth(this: Column, last: Column) -> Column:
    """Growth in % over the same months of last year; NULL without a positive base."""
    return F.when(last > 0, (this / last - 1) * 100)


def vacancy(sanctioned: Column, actual: Column) -> Column:
    return F.when(sanctioned != 0, (sanctioned - actual) / sanctioned * 100)


# --- Reference joins ---------------------------------------------------------------------------


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Each pair listed once, made to hold in both directions."""
    both = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.explode(both).alias("e")).select("e.a", "e.b").distinct()


def verify(latest: DataFrame, expected: DataFrame) -> DataFrame:
    """Published figures against ours: pass within the tolerance, a missing figure fails.

    `expected`: indicator_id, place, period_label, published, tolerance.
    """
    ours = latest.select("indicator_id", "place", "period_label", "value")
    joined = expected.join(ours, ["indicator_id", "place", "period_label"], "left")
    passed = F.coalesce(F.abs(F.col("value") - F.col("published")) <= F.col("tolerance"), F.lit(False))
    return joined.withColumn("ok", passed)


def with_reference_series(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds the reference place's value of the same indicator and period."""
    ref = reference.select("indicator_id", "period_label", F.col("value").alias("reference"))
    return df.join(ref, ["indicator_id", "period_label"], "left")


def with_indicator(places: DataFrame, obs: DataFrame, indicator: str) -> DataFrame:
    """Places that have any value of an indicator."""
    having = obs.filter(F.col("indicator_id") == indicator).select("place")
    return places.join(having, "place", "left_semi")
