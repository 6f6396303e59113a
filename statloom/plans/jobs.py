"""One job per kind of source: landed tables or text to observations and problems.

A job gets its landed DataFrames by role and the shared reference tables, and returns lazily
(observations, problems). Fetching and binary decoding happen before a job starts. The registry at
the end is a plain dictionary.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import periods as P
from statloom.functions import text as T
from statloom.operators import cleaning as C
from statloom.operators import derive as D
from statloom.operators import extract as X
from statloom.operators import resolve as R
from statloom.operators import validate as V
from statloom.operators.skew import newest
from statloom.session import materialize

OBS = [
    "indicator_id", "place", "period_start", "period_end", "period_label", "period_type", "value", "ci_low", "ci_high",
    "is_provisional", "note",
]
KEY = ["place", "period_start", "period_end", "period_label", "period_type"]
Landed = Mapping[str, DataFrame]
Result = tuple[DataFrame, DataFrame]


@dataclass(frozen=True)
class Reference:
    """Shared reference tables of a run."""

    names: DataFrame  # resolve.name_table()
    today: date
    national: str
    population: DataFrame | None = None  # place, year, people
    area: DataFrame | None = None  # place, area
    cities: DataFrame | None = None  # parent, key, city


def observations(df: DataFrame, indicator: str | Column, value: Column | None = None, note: str | Column | None = None) -> DataFrame:
    """Rows in the observation schema; columns the source lacks are NULL (or false)."""
    indicator = F.lit(indicator) if isinstance(indicator, str) else indicator
    have = set(df.columns)

    def optional(name: str, kind: str, default=None) -> Column:
        return F.col(name) if name in have else F.lit(default).cast(kind)

    text = note if isinstance(note, Column) else F.lit(note).cast("string")
    return df.select(
        indicator.alias("indicator_id"), *KEY, (F.col("value") if value is None else value).cast("double").alias("value"),
        optional("ci_low", "double").alias("ci_low"), optional("ci_high", "double").alias("ci_high"),
        optional("is_provisional", "boolean", False).alias("is_provisional"), text.alias("note"),
    ).filter("value is not null")


def _problems(*parts: DataFrame) -> DataFrame:
    return V.all_problems(*[p.select("problem") for p in parts])


def _dated(df: DataFrame, period: P.Period) -> DataFrame:
    return df.select("*", *period.columns())


def _placed(df: DataFrame, ref: Reference, column: str = "state") -> tuple[DataFrame, DataFrame]:
    found = R.resolve(C.clean_place_rows(df, column), ref.names, column)
    return R.resolved(found), R.problems_of(found)


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- Record sources ------------------------------------------------------------------------------


def national_accounts(landed: Landed, ref: Reference) -> Result:
    """`rows`: indicator_id, state, year, value (text). Back-cast to today's boundaries."""
    good, bad = P.parse_period(landed["rows"].withColumn("value", T.clean_number(F.col("value"))).filter("value is not null"), "year")
    found = R.resolve_as_of(good, ref.names, "state", ref.today)
    rows = C.flag_recent_provisional(R.resolved(found), ref.today)
    obs = observations(rows, F.col("indicator_id"), note="back-cast to current boundaries")
    growth = rows.filter("indicator_id = 'growth-real'")
    rolled = D.rolling_mean_consecutive(growth, ["place"]).withColumn("period_type", F.lit("multi_year"))
    three = observations(rolled.withColumn("value", F.round("value", 2)), "growth-real-3yr", note="mean of three years")
    return _union(obs, three), _problems(R.problems_of(found), bad)


def labour_force(landed: Landed, ref: Reference, expected: Mapping[str, object], indicator: str) -> Result:
    """`rows`: state, year, value and the survey's breakdown columns; `shares`: state, year, status, value."""
    rows = C.match_all(landed["rows"], expected).withColumn("value", T.clean_number(F.col("value"))).filter("value is not null")
    placed, bad = _placed(_dated(rows, P.calendar_year(F.col("year").cast("int"))), ref)
    ok, off = V.check_shares(landed["shares"], ["state", "year"], "status", "value", ["3", "4", "5"])
    regular, bad_share = _placed(_dated(ok.filter("`4` is not null"), P.calendar_year(F.col("year").cast("int"))), ref)
    skipped = off.filter("`4` is not null").select(
        F.concat(F.lit("shares of "), "state", F.lit(" "), F.col("year").cast("string"), F.lit(" do not add up to 100; skipped")).alias("problem")
    )
    obs = _union(observations(placed, indicator), observations(regular, "regular-wage-share", F.col("`4`")))
    return obs, _problems(bad, bad_share, skipped)


def consumer_prices(landed: Landed, ref: Reference, partial: list[str], merger: date) -> Result:
    """`rows`: state, year, month (name), subgroup, inflation (text), status."""
    rows = C.match_all(landed["rows"], {"subgroup": "General-Overall"}).withColumn("value", T.clean_number(F.col("inflation")))
    label = F.concat(F.col("month"), F.lit(" "), F.col("year").cast("string"))
    good, bad = P.parse_period(rows.filter("value is not null").withColumn("label", label), "label")
    kept, dropped = C.drop_partial_areas(good, "state", partial, merger)
    placed, unknown = _placed(kept.withColumn("is_provisional", F.col("status") == "P"), ref)
    return observations(placed, "cpi-inflation"), _problems(unknown, dropped, bad)


def family_health_records(landed: Landed, ref: Reference, labels: Mapping[str, str], rounds: Mapping[str, tuple[date, date, str]], skip: list[tuple[str, str]]) -> Result:
    """`rows`: sub_indicator, survey, sector, state, value (text)."""
    rows = C.map_labels(C.match_all(landed["rows"], {"sector": "Rural + Urban (Combined)"}), "sub_indicator", labels)
    rows = C.exclude_pairs(rows.withColumn("survey", F.lower("survey")), ["indicator_id", "survey"], skip)
    spec = rows.sparkSession.createDataFrame(
        [(k, a, b, label, "survey_round") for k, (a, b, label) in rounds.items()],
        "survey string, period_start date, period_end date, period_label string, period_type string",
    )
    dated = rows.join(spec, "survey").withColumn("value", T.clean_number(F.col("value"))).filter("value is not null")
    placed, bad = _placed(dated, ref)
    return observations(placed, F.col("indicator_id")), _problems(bad)


def family_health_sheets(landed: Landed, ref: Reference, labels: Mapping[str, str], period: tuple[date, date, str]) -> Result:
    """`sheets`: doc_id, state, text, released (a later sheet of a state overrides an earlier one)."""
    items = X.segment_items(landed["sheets"])
    literal = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    rows = items.withColumn("indicator_id", literal[F.col("label")]).filter("indicator_id is not null")
    rows = _dated(rows, P.span(F.lit(period[0]), F.lit(period[1]), F.lit(period[2]), "survey_round"))
    rows = R.resolve_with_repairs(rows, ref.names, "state").withColumn("value", T.clean_number(F.element_at("values", -1)))
    unknown = rows.filter("place is null").select(F.concat(F.lit("unknown place name '"), "state", F.lit("'")).alias("problem"))
    kept = D.newest(rows.filter("place is not null").select(*KEY, "indicator_id", "value", "released", "item"), [*KEY, "indicator_id"], ["released", "item"])
    return observations(kept, F.col("indicator_id")), _problems(unknown)


def schools(landed: Landed, ref: Reference, series: Mapping[str, Mapping[str, object]], unreliable: str) -> Result:
    """`rows`: state, year, value and breakdown columns; `series`: indicator -> columns it must match."""
    parts = [C.match_all(landed["rows"], match).withColumn("indicator_id", F.lit(i)) for i, match in series.items()]
    rows = _union(*parts).withColumn("value", T.clean_number(F.col("value"))).filter("value is not null")
    marked = rows.withColumn("place", F.col("state")).withColumn("period_label", F.col("year"))
    kept, dropped = C.drop_sentinel(marked, unreliable, 0.0)
    good, bad = P.parse_period(kept.drop("place", "period_label"), "year")
    found = R.resolve_current_first(good, ref.names, "state", ref.today)
    return observations(R.resolved(found), F.col("indicator_id")), _problems(R.problems_of(found), dropped, bad)


def consumption_gini(landed: Landed, ref: Reference) -> Result:
    """`rows`: state, year (survey year start), sector (rural, urban), value."""
    rows = landed["rows"].withColumn("value", T.clean_number(F.col("value"))).filter("value is not null")
    placed, bad = _placed(_dated(rows, P.survey_year(F.col("year"))), ref)
    both = D.mean_if_complete(placed, KEY, "sector", ["rural", "urban"]).withColumn("value", F.round("value", 4))
    single = observations(placed, F.concat(F.lit("gini-"), "sector"))
    return _union(single, observations(both, "consumption-gini", note="mean of rural and urban")), _problems(bad)


def environment(landed: Landed, ref: Reference, columns: Mapping[str, str], merged: Mapping[str, str], since: date) -> Result:
    """`air`: state, year, city, network, label, value; `waste`: state, year, part, value; `vehicles`: state, year, value."""
    air, unexpected = C.guarded_relabel(landed["air"], "label", columns)
    air = _dated(air.filter("label = 'PM2.5'"), P.calendar_year(F.col("year")))
    waste = _dated(landed["waste"], P.fiscal_year(F.col("year")))
    cars = _dated(landed["vehicles"], P.calendar_year(F.col("year")))
    placed = [_placed(x, ref) for x in (air, waste, cars)]
    a, w, c = (D.merge_successors(p, merged, since) for p, _ in placed)
    pm = D.preferred_mean(a, KEY, "city", "network", ["CAAQMS", "NAMP"])
    processed = D.component_ratio(w, KEY, "part", "Treated", "Generated").withColumn("value", T.round_at(F.col("value"), 1))
    sums = c.groupBy(*KEY).agg(F.sum("value").alias("value")).withColumn("year", F.year("period_start"))
    per, missing = D.rate(sums, ref.population, ["place", "year"], 1000)
    obs = _union(
        observations(pm, "pm25-annual"), observations(processed, "waste-processed"), observations(per, "vehicles-per-1000", T.round_at(F.col("rate"), 0))
    )
    return obs, _problems(*[b for _, b in placed], unexpected, missing)


def air_quality(landed: Landed, ref: Reference) -> Result:
    """`readings`: day, city, value; `cities`: city, state."""
    daily = D.daily_rollup(landed["readings"], landed["cities"], ref.national)
    _, unmapped = R.lookup_or_problem(landed["readings"].select("city").distinct(), landed["cities"], "city", "city")
    note = F.when(F.col("place") != ref.national, F.concat(F.lit("worst: "), F.col("worst_city").cast("string")))
    rows = _dated(daily.withColumn("value", F.col("mean")), P.day_period(F.col("day")))
    return observations(rows, "aqi-daily-mean", note=note), _problems(unmapped)


def digital_payments(landed: Landed, ref: Reference) -> Result:
    """`quarters`: state, year, quarter, value; all years on today's boundaries."""
    rows = _dated(landed["quarters"], P.calendar_year(F.col("year")))
    found = R.resolve_current_first(rows, ref.names, "state", ref.today)
    windows = D.annual_windows(R.resolved(found).select("place", "year", "quarter", "value"), ref.population, ref.national)
    first = F.to_date(F.concat(F.substring("window", 1, 4), F.lit("-01-01")))
    quarterly = F.col("window").contains("Q")
    start = F.add_months(first, F.when(quarterly, (F.substring("window", 6, 1).try_cast("int") - 1) * 3).otherwise(0))
    end = F.date_sub(F.add_months(start, 12), 1)
    kind = F.when(quarterly, "multi_year").otherwise("calendar_year")
    dated = windows.withColumn("value", T.round_at(F.col("per_person"), 1)).select(
        "*", start.alias("period_start"), end.alias("period_end"), F.col("window").alias("period_label"), kind.alias("period_type")
    )
    return observations(dated, "digital-payments-per-capita"), _problems(R.problems_of(found))


def road_deaths(landed: Landed, ref: Reference, first_good_year: int) -> Result:
    """`wide`: state and one column '<year> Killed' per year."""
    cells = X.wide_to_long(landed["wide"], ["state"]).withColumn("year", F.regexp_extract("label", r"^(\d{4}) Killed$", 1).try_cast("int"))
    rows = C.drop_footnoted(cells.filter("year is not null"), "state", "year", first_good_year)
    rows = rows.withColumn("value", T.clean_number(F.col("value").cast("string"))).filter("value is not null")
    placed, bad = _placed(_dated(rows, P.calendar_year(F.col("year"))), ref)
    per, missing = D.rate(placed, ref.population, ["place", "year"], 100_000)
    lost = cells.agg(F.count("year").alias("_n")).filter("_n = 0").select(F.lit("road deaths: no column of a year with figures").alias("problem"))
    return observations(per, "road-deaths", T.round_at(F.col("rate"), 1)), _problems(bad, missing, lost)


# --- Text sources ---------------------------------------------------------------------------------


def _printed(lines: DataFrame, size: int, shares: tuple[int, ...] = ()) -> DataFrame:
    """Lines that end with `size` numbers at least, as (name, values); `shares`: which of them, from the right, are per cents."""
    name, values = X.trailing_values(F.col("text"), rf"(?:{X.VALUE}%?)")
    rows = lines.withColumn("name", name).withColumn("values", values).filter((F.size("values") >= size) & (F.col("name") != ""))
    for position in shares:
        rows = rows.filter(F.try_element_at("values", F.lit(position)).endswith("%"))
    return rows


def _printed_number(position: int) -> Column:
    return T.clean_number(F.try_element_at("values", F.lit(position)))


def _few_rows(pages: DataFrame, rows: DataFrame, min_rows: int, what: str) -> DataFrame:
    """Problems of documents without any row of the table they should hold, or with fewer places than `min_rows`."""
    short = V.row_count_problems(rows, ["doc_id"], "place", min_rows, pages)
    state = F.when(F.col("rows_read") == 0, "not found").otherwise("few rows read")
    return short.select(F.concat(F.lit(f"{what} of "), F.col("doc_id").cast("string"), F.lit(": "), state).alias("problem"))


# The heading of the tax table, and the word before its month.
TAX_TABLE, TAX_UNTIL = "table2:", "till"


def tax_collections(landed: Landed, ref: Reference, min_rows: int = 1) -> Result:
    """`reports`: doc_id, text with 'Table-2: … till <Month>, <year>' and rows of last and this year."""
    # The first line of the heading, and the two words after 'till' in it: the month and its year.
    lines = F.filter(X.lines_of(F.col("text")), lambda x: F.replace(F.replace(F.lower(x), F.lit(" ")), F.lit("-")).contains(TAX_TABLE))
    words = F.split(F.get(lines, F.lit(0)), r"\s+")
    until = F.array_position(F.transform(words, F.lower), TAX_UNTIL).cast("int")
    pages = landed["reports"].withColumn("month", F.when(until > 0, F.array_join(F.slice(words, until + 1, F.lit(2)), " "))).filter("month is not null")
    dated, bad = P.parse_period(pages, "month")
    # Of the month, then of the year so far: last year's sum, this year's, change in per cent.
    lines = X.carry_pending(dated.select("doc_id", "text", F.col("period_end").alias("_end")), r"%\s*$")
    rows = _printed(lines, 6, (-4, -1)).select(
        "doc_id", "_end", "line_no", F.col("name").alias("state"), _printed_number(-3).alias("last"), _printed_number(-2).alias("this")
    )
    rows = rows.filter(~F.col("state").rlike("(?i)^other territory")).withColumn(
        "state", F.when(F.col("state").rlike("(?i)grand total"), "All India").otherwise(F.col("state"))
    )
    placed, unknown = _placed(_dated(rows, P.fiscal_to_date(F.col("_end"))), ref)
    first = D.first_wins(placed.select("doc_id", *KEY, "line_no", "last", "this"), ["doc_id", *KEY], ["line_no"])
    first = first.withColumn("year", F.year("period_start")).withColumn("value", F.col("this") * 1e7)
    per, missing = D.rate(first, ref.population, ["place", "year"], 1)
    growth = D.ytd_growth(F.col("this"), F.col("last"))
    obs = _union(
        observations(per, "collection-per-capita", T.round_at(F.col("rate"), 0)), observations(first, "collection-growth", T.round_at(growth, 1))
    )
    return obs, _problems(unknown, bad, missing, _few_rows(landed["reports"], first, min_rows, "tax table"))


def tap_water(landed: Landed, ref: Reference, min_rows: int = 1) -> Result:
    """`pages`: doc_id, printed (date), text with 'name households connections percent'."""
    rows = _printed(X.explode_lines(landed["pages"]), 3).filter((F.size("values") == 3) & F.try_element_at("values", F.lit(-1)).contains("."))
    rows = rows.filter(~F.col("name").rlike(r"\d")).withColumn("state", F.col("name")).withColumn("value", _printed_number(-1))
    placed, bad = _placed(_dated(rows, P.day_period(F.col("printed"))), ref)
    return observations(placed, "tap-water"), _problems(bad, _few_rows(landed["pages"], placed, min_rows, "water table"))


def learning_survey(landed: Landed, ref: Reference, subjects: Mapping[int, int], period: tuple[date, date, str]) -> Result:
    """`charts`: place, grade, text of one grade's comparison chart."""
    pairs = X.pair_chart(landed["charts"]).withColumnRenamed("label", "subject")
    means = D.mean_of_means(pairs, subjects, ref.national).withColumnRenamed("key", "measure")
    rows = _dated(means, P.span(F.lit(period[0]), F.lit(period[1]), F.lit(period[2]), "survey_round"))
    read = pairs.select("place").distinct()
    short = landed["charts"].select("place").distinct().join(means.select("place").distinct(), "place", "left_anti").unionByName(
        landed["charts"].select("place").distinct().join(read, "place", "left_anti")
    )
    problems = short.select(F.concat(F.lit("charts of "), F.col("place").cast("string"), F.lit(" not read in full")).alias("problem"))
    return observations(rows, F.concat(F.lit("learning-"), "measure")), _problems(problems)


def airport_traffic(landed: Landed, ref: Reference) -> Result:
    """`lines`: month_end, text; `airports`: airport, place.

    A line: number, city, AIRPORT, passengers of the month, of last year's, change, then the same of the year so far.
    """
    rows = _printed(landed["lines"], 6).filter(F.col("name").rlike(r"^\d")).withColumn("value", _printed_number(-3))
    capitals = F.filter(F.split("name", " +"), lambda w: (w == F.upper(w)) & ~w.rlike(r"^\d+$"))
    rows = rows.withColumn("airport", F.array_join(capitals, " "))
    found, missing = R.lookup_or_problem(rows, landed["airports"], "airport", "airport")
    dated = _dated(found, P.fiscal_to_date(F.col("month_end")))
    scaled = D.annualise(dated, KEY, P.months_to_date(F.col("period_end"))).withColumn("year", F.year("period_start"))
    per, no_people = D.rate(scaled, ref.population, ["place", "year"], 100)
    return observations(per, "air-passengers-per-100", T.round_at(F.col("rate"), 1)), _problems(missing, no_people)


# What the heading lines of the printed city rankings hold.
RANKING_HEADINGS = ("rank", "score", "ranking", "population", "©", "report", "ulb name", "state/ut", "state/ ut")


def _goes_on(name: Column) -> Column:
    """Whether a body's name is not over: it ends in 'of', in a sign that joins, or inside a bracket that says what body it is."""
    open_bracket = F.when(~F.substring_index(name, "(", -1).contains(")") & name.contains("("), F.lower(F.substring_index(name, "(", -1)))
    return (F.lower(F.substring_index(name, " ", -1)) == "of") | F.right(name, F.lit(1)).isin("-", "+") | F.coalesce(open_bracket.isin("", "m", "m."), F.lit(False))


def ranked_bodies(pages: DataFrame, names: DataFrame, day: Column) -> DataFrame:
    """Ranking rows 'rank, state and body, score, three more numbers' as (doc_id, place, rest, score).

    A body's name may be wrapped around its numbers, or its last word may end on the next line.
    """
    def is_row(c: Column) -> Column:
        return c.rlike(rf"^\d+\s+\S.*?(?:\s+{X.VALUE}){{4}}$")

    def beside(c: str) -> Column:
        heading = [F.lower(c).contains(word) for word in RANKING_HEADINGS]
        return F.when(~is_row(F.col(c)) & ~reduce(Column.__or__, heading), F.col(c)).otherwise("")

    name, values = X.trailing_values(F.regexp_replace("text", r"^\d+\s+", ""))
    rows = X.with_neighbours(pages).filter(is_row(F.col("text"))).select(
        "doc_id", name.alias("name"), T.clean_number(F.get(values, 0)).alias("score"), beside("before").alias("before"), beside("after").alias("after")
    )
    split = R.split_prefix(rows, names, "name", day).filter("place is not null")
    rest = F.col("rest")
    around = F.trim(F.regexp_replace(F.concat_ws(" ", "before", "rest", "after"), " +", " "))
    whole = F.when((rest == "") | _goes_on(rest), around).when(F.col("after").rlike("^[A-Z]{1,3}$"), F.concat("rest", "after")).otherwise(rest)
    return split.select("doc_id", "place", whole.alias("rest"), "score")


def city_cleanliness(
    landed: Landed, ref: Reference, year: int, period: tuple[date, date, str], shared: Mapping[str, str] | None = None, min_rows: int = 1
) -> Result:
    """`pages`: doc_id, text of ranking pages; `league`: text lines 'State: a, b'.

    `shared`: bodies that share a city, body key -> city key; their scores are averaged.
    """
    day = F.lit(date(year, 7, 2))
    listed = ranked_bodies(landed["pages"], ref.names, day)
    key = T.clean_body_name(F.col("rest"))
    if shared:
        key = F.coalesce(F.create_map(*[F.lit(x) for pair in shared.items() for x in pair])[key], key)
    keyed = listed.withColumn("key", key).withColumnRenamed("place", "parent")
    scored = R.lookup_city(keyed, ref.cities, "parent", "key").filter("city is not null")
    body = F.initcap(F.trim(F.substring_index("rest", "(", 1)))
    means = D.mean_bodies(scored.withColumn("rest", body).withColumn("value", F.col("score")), "city", "rest").withColumnRenamed("city", "place")
    members = X.explode_members(landed["league"])
    named = R.resolve_on(members, ref.names, "group", [day])
    league = R.lookup_city(named.withColumn("key", T.clean_body_name(F.col("member"))).withColumnRenamed("place", "parent"), ref.cities, "parent", "key")
    span = P.span(F.lit(period[0]), F.lit(period[1]), F.lit(period[2]), "survey_round")
    first = observations(_dated(means, span), "cleanliness-score", note=F.col("note"))
    member = league.filter("city is not null").select(F.col("city").alias("place"), F.lit(1.0).alias("value")).distinct()
    unknown = league.filter("city is null").select(F.concat(F.lit("no city for '"), "member", F.lit("'")).alias("problem"))
    few = _few_rows(landed["pages"], listed.select("doc_id", F.concat_ws("/", "place", "rest").alias("place")), min_rows, "ranking")
    return _union(first, observations(_dated(member, span), "cleanliness-league")), _problems(unknown, few)


def municipal_finance(landed: Landed, ref: Reference, min_rows: int = 1) -> Result:
    """`pages`: doc_id, html of the own-revenue statement; one without its header, or with few places, is a problem."""
    cells = X.html_table_cells(landed["pages"], "html", r"(?i)^state\s*/\s*ut")
    start, status = T.status_of(F.col("label"))
    rows = cells.withColumn("_start", start).withColumn("status", status).withColumn("value", T.clean_number(F.col("raw")))
    rows = rows.filter(F.col("status").isin("A", "RE") & F.col("value").isNotNull()).withColumn("is_provisional", F.col("status") == "RE")
    dated = C.clean_place_rows(_dated(rows, P.fiscal_year(F.col("_start"))), "name")
    found = materialize(R.resolve(dated, ref.names, "name"), "municipal")  # read by figures and both kinds of problems
    placed, bad = R.resolved(found), R.problems_of(found)
    few = _few_rows(landed["pages"], placed, min_rows, "statement of own revenue")
    return observations(placed, "municipal-own-revenue-share", T.round_at(F.col("value") * 100, 1)), _problems(bad, few)


def numbered_table(landed: Landed, ref: Reference, headings: Mapping[str, str], columns: Mapping[str, int], min_rows: int) -> Result:
    """Crime and similar tables: `pages`: doc_id, year, page, text.

    `columns`: indicator -> position of its value from the right. City rows below the total are cut
    off; the first row of a place wins.
    """
    pages = X.rows_until(X.locate_tables(landed["pages"], headings), "TOTAL (ALL INDIA)")
    rows = X.rejoin_wrapped(pages).withColumn("state", F.col("name"))
    placed, bad = _placed(_dated(rows, P.calendar_year(F.col("year"))), ref)
    first = D.first_wins(placed.select("doc_id", "table_id", *KEY, "page", "line_no", "values"), ["doc_id", "table_id", *KEY], ["page", "line_no"])
    parts = [
        observations(first, indicator, T.clean_number(F.element_at("values", -position)), F.concat(F.lit("table "), "table_id"))
        for indicator, position in columns.items()
    ]
    wanted = landed["pages"].select("doc_id").distinct().withColumn("table_id", F.explode(F.array(*[F.lit(k) for k in headings])))
    state = F.when(F.col("rows_read") == 0, ": not found").otherwise(": few rows read")
    short = V.row_count_problems(first, ["doc_id", "table_id"], "place", min_rows, wanted).select(
        F.concat(F.lit("table "), "table_id", F.lit(" of "), F.col("doc_id").cast("string"), state).alias("problem")
    )
    return _union(*parts), _problems(bad, short)


# The heading of the subscribers' table, its day, its total, the word before places counted in, names it prints in another way.
SUBSCRIBERS_HEADING = r"(?i)State/UT wise number of Internet Subscribers per 100 population"
SUBSCRIBERS_DAY = r"(?i)at the end of ([a-z]{3}-\d{2})"
SUBSCRIBERS_TOTAL = r"^Total\s+(.*)$"
SUBSCRIBERS_INCLUDED = "incl."
SUBSCRIBERS_NAMES = {r"(?i)\bdaman\b": "Dadra & Nagar Haveli and Daman & Diu"}


def internet_subscribers(landed: Landed, ref: Reference, min_rows: int = 1, spelled: Mapping[str, str] = SUBSCRIBERS_NAMES) -> Result:
    """`pages`: doc_id, page, text; of a report the first page with the table counts, of a row the last of six numbers."""
    marked = landed["pages"].filter(F.col("text").rlike(SUBSCRIBERS_HEADING))
    newest = F.to_date(F.initcap(F.regexp_extract("text", SUBSCRIBERS_DAY, 1)), "MMM-yy")
    first_page = marked.groupBy("doc_id").agg(F.min("page").alias("page"))
    pages = marked.join(first_page, ["doc_id", "page"]).withColumn("_month", newest)
    undated = pages.filter("_month is null").select(F.concat(F.lit("table of subscribers of "), F.col("doc_id").cast("string"), F.lit(": no month")).alias("problem"))
    rows = X.rejoin_wrapped(pages.filter("_month is not null"), 6, SUBSCRIBERS_TOTAL)
    # Without brackets, up to the word that says what is counted in.
    words = F.split(F.concat(F.substring_index("name", "(", 1), F.when(F.col("name").contains(")"), F.substring_index("name", ")", -1)).otherwise("")), " +")
    counted_in = F.array_position(F.transform(words, lambda w: F.lower(w).startswith(SUBSCRIBERS_INCLUDED)), F.lit(True)).cast("int")
    plain = F.trim(F.array_join(F.when(counted_in > 0, F.slice(words, F.lit(1), counted_in - 1)).otherwise(words), " "))
    state = F.coalesce(*[F.when(F.col("name").rlike(pattern), name) for pattern, name in spelled.items()], plain)
    dated = _dated(rows.withColumn("state", state).withColumn("value", _printed_number(-1)).filter("value is not null"), P.month_period(F.col("_month")))
    placed, bad = _placed(dated, ref)
    first = D.first_wins(placed.select("doc_id", *KEY, "line_no", "value"), ["doc_id", *KEY], ["line_no"])
    note = F.concat(F.lit("end of "), "period_label")
    few = _few_rows(landed["pages"], first, min_rows, "table of subscribers")
    return observations(first, "internet-subscribers-per-100", note=note), _problems(bad, undated, few)


@dataclass(frozen=True)
class CityTable:
    """A table of cities: its heading, the indicator of the rate and, if it is printed, that of the last column."""

    heading: str
    rate: str
    last: str | None = None


def metro_crime(landed: Landed, ref: Reference, tables: Mapping[str, CityTable], min_rows: int = 1) -> Result:
    """`pages`: doc_id, year, page, text of yearly editions; rows hold the counts of three years, people, rate and a last share.

    A name that does not fit stands on the line before its numbers. Rates of the two earlier years are worked
    out from the counts; a year's own edition wins, then the next one. Of a city named twice the last row counts.
    """
    pages = X.locate_tables(landed["pages"], {k: v.heading for k, v in tables.items()})
    lines = X.with_neighbours(pages).filter(F.col("text").rlike(X.ROW))
    name, values = X.trailing_values(F.regexp_extract("text", X.ROW, 2))
    rows = lines.withColumn("values", values).withColumn("name", F.when(name == "", F.col("before")).otherwise(name)).filter(F.size("values") == 6)
    rows = rows.withColumn("key", T.normalize_name(F.col("name"))).withColumn("parent", F.lit(None).cast("string"))
    found = R.lookup_city(rows, ref.cities, "parent", "key")
    unknown = found.filter("city is null").select(
        F.format_string("table %s of %s: unknown city '%s'", "table_id", F.col("doc_id").cast("string"), "name").alias("problem")
    ).distinct()
    read = newest(found.filter("city is not null").select("doc_id", "year", "table_id", "city", "page", "line_no", "values"), ["doc_id", "year", "table_id", "city"], ["page", "line_no"])
    number = [T.clean_number(F.get("values", F.lit(i))) for i in range(6)]

    def named(pick: Callable[[CityTable], str | None]) -> Column:
        return F.coalesce(*[F.when(F.col("table_id") == k, F.lit(pick(v)).cast("string")) for k, v in tables.items()])

    series = F.struct(named(lambda v: v.rate).alias("indicator_id"), "city", "table_id").alias("place")
    counts = read.select(series, "year", number[4].alias("rate"), F.array(number[0], number[1]).alias("cases"), number[3].alias("people"))
    rates = D.prefer_own_edition(D.back_rates(counts)).select("place.*", "year", "value", (F.col("year") + F.col("back")).alias("edition"))
    shares = read.select(named(lambda v: v.last).alias("indicator_id"), "city", "table_id", "year", number[5].alias("value"), F.col("year").alias("edition"))
    both = _dated(rates.unionByName(shares.filter("indicator_id is not null and value is not null")).withColumnRenamed("city", "place"), P.calendar_year(F.col("year")))
    note = F.concat(F.lit("table "), "table_id", F.lit(" of "), F.col("edition").cast("string"))
    wanted = landed["pages"].select("doc_id").distinct().withColumn("table_id", F.explode(F.array(*[F.lit(k) for k in tables])))
    short = V.row_count_problems(read, ["doc_id", "table_id"], "city", min_rows, wanted)
    state = F.when(F.col("rows_read") == 0, ": not found").otherwise(": few cities read")
    few = short.select(F.concat(F.lit("table "), "table_id", F.lit(" of "), F.col("doc_id").cast("string"), state).alias("problem"))
    return observations(both, F.col("indicator_id"), note=note), _problems(unknown, few)


# The title of the table of suicides (its dash may be a hyphen) and its total.
SUICIDES_TITLE, SUICIDES_TOTAL = "Incidence and Rate of Suicides – ", "TOTAL (ALL INDIA)"


def suicides(landed: Landed, ref: Reference, min_rows: int = 1) -> Result:
    """`pages`: doc_id, year, page, text of one table over several pages: states, the national total, then cities.

    What follows the total, on its page and on later ones, is not read; the first row of a place wins and its last number is the rate.
    """
    pages = landed["pages"]
    has_total = F.col("text").contains(SUICIDES_TOTAL)
    title = F.replace("text", F.lit("-"), F.lit("–")).contains(F.concat(F.lit(SUICIDES_TITLE), F.col("year").cast("string")))
    known = pages.groupBy("doc_id").agg(F.min(F.when(has_total, F.col("page"))).alias("_end"), F.coalesce(F.bool_or(title), F.lit(False)).alias("_titled"))
    untitled = known.filter("not _titled").select(F.concat(F.lit("table of suicides of "), F.col("doc_id").cast("string"), F.lit(": title not found")).alias("problem"))
    body = pages.join(known, "doc_id").filter("_end is null or page <= _end").drop("_end", "_titled")
    rows = X.rejoin_wrapped(X.rows_until(body, SUICIDES_TOTAL)).withColumn("state", F.col("name"))
    placed, bad = _placed(_dated(rows, P.calendar_year(F.col("year"))), ref)
    first = D.first_wins(placed.select("doc_id", *KEY, "page", "line_no", "values"), ["doc_id", *KEY], ["page", "line_no"])
    few = _few_rows(pages, first, min_rows, "table of suicides")
    note = F.concat(F.lit("table of suicides, "), "period_label")
    return observations(first, "suicide-rate", T.clean_number(F.element_at("values", -1)), note), _problems(bad, untitled, few)


def mortality_report(landed: Landed, ref: Reference, heading: str, indicator: str, min_rows: int = 1) -> Result:
    """`pages`: doc_id, page, text with a period header and annual or pooled columns; text may follow a row's numbers."""
    body = F.regexp_extract("text", rf"(?ms)^({heading}.*)", 1)
    pages = landed["pages"].filter(F.col("text").rlike(rf"(?m)^{heading}")).withColumn("text", body)
    cells = X.zip_periods(pages).withColumn("_label", F.col("period_label")).drop("period_label")
    period = P.pooled_span(F.col("_label")).otherwise(P.calendar_year(F.col("_label").try_cast("int")))
    dated = _dated(cells, period)
    found, bad = _placed(dated, ref, "name")
    return observations(found, indicator), _problems(bad, _few_rows(landed["pages"], found, min_rows, f"table {heading}"))


def life_tables(landed: Landed, ref: Reference, heading: str, indicator: str, period: P.Period, min_rows: int = 1) -> Result:
    """`pages`: doc_id, page, text; below a section's heading the first number of a row is its value."""
    rows = _printed(X.rows_after_heading(landed["pages"], heading, r"^\p{L}\D*\d"), 1)
    placed, bad = _placed(_dated(rows.withColumn("value", _printed_number(1)), period), ref, "name")
    first = D.first_wins(placed.select("doc_id", *KEY, "row_no", "value"), ["doc_id", *KEY], ["row_no"])
    return observations(first, indicator), _problems(bad, _few_rows(landed["pages"], first, min_rows, f"table {heading}"))


def rates_with_interval(landed: Landed, ref: Reference, indicator: str, period: P.Period, min_rows: int = 1) -> Result:
    """`pages`: doc_id, text with 'name value ( low , high )' rows."""
    rows = X.extract_ci_rows(X.explode_lines(landed["pages"]))
    placed, bad = _placed(_dated(rows, period), ref, "name")
    first = D.first_wins(placed.select("doc_id", *KEY, "line_no", "value", "ci_low", "ci_high"), ["doc_id", *KEY], ["line_no"])
    return observations(first, indicator), _problems(bad, _few_rows(landed["pages"], first, min_rows, "table of rates"))


def police_strength(landed: Landed, ref: Reference, min_rows: int = 1) -> Result:
    """`pages`: doc_id, day, text with '<no> name … sanctioned actual x y' rows."""
    rows = X.rejoin_wrapped(landed["pages"], min_values=6).withColumn("state", F.col("name"))
    placed, bad = _placed(_dated(rows, P.day_period(F.col("day"))), ref)
    value = D.vacancy(T.clean_number(F.element_at("values", -4)), T.clean_number(F.element_at("values", -3)))
    short = _few_rows(landed["pages"], placed, min_rows, "strength table")
    return observations(placed, "police-vacancy", F.round(value, 2)), _problems(bad, short)


def population_projections(landed: Landed, ref: Reference, components: DataFrame, last_year: int) -> Result:
    """`words`: word positions of the pages; `columns`: doc_id, page, place_no, place (report's areas)."""
    table, bad = X.words_to_table(landed["words"])
    named = table.join(landed["columns"], ["doc_id", "page", "place_no"]).filter(F.col("year") <= last_year)
    own = named.select("place", "year", F.col("persons").alias("value"))
    sums = D.sum_components(own, components, ["year"])
    rows = _dated(_union(own, sums.select("place", "year", "value")), P.day_period(F.make_date("year", F.lit(7), F.lit(1))))
    at = [F.col(c).cast("string") for c in ("page", "doc_id", "year")]
    column = (F.col("place_no") + 1).cast("string")
    text = F.concat(F.lit("page "), at[0], F.lit(" of "), at[1], F.lit(", "), at[2], F.lit(", column "), column, F.lit(": "), "problem")
    problem = bad.select(text.alias("problem"))
    return observations(rows, "population"), _problems(problem)


# Kind of source -> job. Sources that print alike share a job with other parameters.
JOBS: dict[str, Callable[..., Result]] = {
    "national-accounts": national_accounts,
    "labour-force": labour_force,
    "consumer-prices": consumer_prices,
    "family-health-records": family_health_records,
    "family-health-sheets": family_health_sheets,
    "schools": schools,
    "higher-education": schools,
    "consumption-gini": consumption_gini,
    "environment": environment,
    "air-quality": air_quality,
    "digital-payments": digital_payments,
    "tax-collections": tax_collections,
    "tap-water": tap_water,
    "learning-survey": learning_survey,
    "airport-traffic": airport_traffic,
    "city-cleanliness": city_cleanliness,
    "municipal-finance": municipal_finance,
    "crime": numbered_table,
    "metro-crime": metro_crime,
    "suicides": suicides,
    "road-deaths": road_deaths,
    "mortality-report": mortality_report,
    "maternal-mortality": rates_with_interval,
    "life-tables": life_tables,
    "internet-subscribers": internet_subscribers,
    "police-strength": police_strength,
    "population-projections": population_projections,
}


def run(kind: str, landed: Landed, ref: Reference, **options) -> Result:
    """Looks a job up and runs it."""
    if kind not in JOBS:
        raise KeyError(f"no job for {kind!r}; known: {', '.join(sorted(JOBS))}")
    return JOBS[kind](landed, ref, **options)
