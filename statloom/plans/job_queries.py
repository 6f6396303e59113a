"""Registered queries that run whole source jobs; observations are summed per indicator, place and period."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import periods as P
from statloom.operators import resolve as R
from statloom.operators.extract import explode_lines
from statloom.plans import bindings as B
from statloom.plans import jobs as J
from statloom.plans import text_queries as X
from statloom.plans.core_queries import aliases
from statloom.plans.handbook import TITLES, state_handbook
from statloom.plans.derive_queries import city_map, nation_sales
from statloom.plans.registry import Tables, query, view


def reference(t: Tables) -> J.Reference:
    """Nations by name, the whole by 'All India', and two long names; customers per year as people."""
    none = F.lit(None).cast("date")
    letter = B.letter(F.col("n_nationkey"))
    slug = F.concat(F.lit("nation-"), F.lower(letter)).alias("slug")
    long_names = t.nation.select(
        F.explode(F.array(*[F.concat(F.lit(p), letter) for p in ("Upper and Lower Nation ", "Lower Nation ")])).alias("alias"), slug,
        none.alias("period_from"), none.alias("period_to"),
    )
    whole = t.region.filter("r_regionkey = 0").select(
        F.lit("All India").alias("alias"), F.lit(B.NATIONAL).alias("slug"), none.alias("period_from"), none.alias("period_to")
    )
    names = R.name_table(B.places(t), aliases(t).unionByName(long_names).unionByName(whole))
    years = F.explode(F.sequence(F.lit(1994), F.lit(2001)))
    people = B.people(t)
    former = people.filter(F.col("place").isin(*[f"nation-{x}" for x in "abcd"])).withColumn("place", F.concat("place", F.lit("-undivided")))
    population = people.unionByName(former).withColumn("year", years)
    area = people.unionByName(former).select("place", (F.col("people") * 2.0).alias("area"))
    return J.Reference(names, B.TODAY, B.NATIONAL, population, area)


def summed(result: J.Result) -> DataFrame:
    return result[0].groupBy("indicator_id", "place", "period_label").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def state() -> Column:
    """'Nation A' from 'nation-a'."""
    return F.concat(F.lit("Nation "), F.upper(F.substring("place", -1, 1)))


# A nation's place on a day: the four split ones were undivided before 1998.
def _place(letter: str, day: str) -> str:
    return f"'nation-' || lower({letter}) || case when lower({letter}) in ('a', 'b', 'c', 'd') and {day} < date '1998-01-01' then '-undivided' else '' end"


@query("JOB_crime", """
  with r as (select 'nation-' || lower(letter) as place, n, returned from report_rows
    union all select 'all', sum(n), sum(returned) from report_rows group by doc_id)
  select 'lines' as indicator_id, place, '2000' as period_label, count(*) as n, sum(n)::double as total from r group by 2
  union all select 'returned', place, '2000', count(*), sum(returned)::double from r where returned > 0 group by 2
""", "total")
def job_crime(t: Tables) -> DataFrame:
    pages = X.crime_pages(t).withColumn("year", F.lit(2000))
    out = J.run("crime", {"pages": pages}, reference(t), headings={"1A.1": r"^TABLE\s+1A\.1\s*$"}, columns={"lines": 3, "returned": 1}, min_rows=20)
    return summed(out)


def _some_lost(pages: DataFrame) -> DataFrame:
    """Every seventh document turns out to be another report."""
    return pages.withColumn("text", F.when(F.col("doc_id") % 7 == 0, "Another report").otherwise(F.col("text")))


def _few(what: str, rows: str, least: int) -> str:
    return f"""
      select '{what} of ' || doc_id || ': ' || case when doc_id % 7 = 0 then 'not found' else 'few rows read' end as problem
      from report_rows group by doc_id having doc_id % 7 = 0 or {rows} < {least}
    """


@query("JOB_crime_problems", _few("table 1A.1", "count(*) + 1", 30))
def job_crime_problems(t: Tables) -> DataFrame:
    pages = _some_lost(X.crime_pages(t)).withColumn("year", F.lit(2000))
    return J.run("crime", {"pages": pages}, reference(t), headings={"1A.1": r"^TABLE\s+1A\.1\s*$"}, columns={"lines": 3}, min_rows=30)[1]


@query("JOB_tax_collections", """
  with r as (select 'nation-' || lower(letter) as place, returned as last, n as this from report_rows
    union all select 'all', 10, 11 from report_rows group by doc_id)
  select 'collection-per-capita' as indicator_id, place, 'Apr–Jul 2001 (FY 2001-02 to date)' as period_label, count(*) as n,
         sum(floor(this * 1e7 / people + 0.5)) as total from r join population using (place) group by 2
  union all select 'collection-growth', place, 'Apr–Jul 2001 (FY 2001-02 to date)', count(*), sum(floor(((this / last::double - 1) * 100) * 10 + 0.5) / 10)
  from r where last > 0 group by 2
""", "total")
def job_tax(t: Tables) -> DataFrame:
    return summed(J.run("tax-collections", {"reports": X.revenue_pages(t)}, reference(t)))


@query("JOB_tax_problems", _few("tax table", "count(*) + 1", 26))
def job_tax_problems(t: Tables) -> DataFrame:
    return J.run("tax-collections", {"reports": _some_lost(X.revenue_pages(t))}, reference(t), min_rows=26)[1]


@query("JOB_tap_water", """
  select 'tap-water' as indicator_id, 'nation-' || lower(letter) as place, '2001-06-30' as period_label, count(*) as n, sum(returned + 0.25::double) as total
  from report_rows group by 2
""", "total")
def job_water(t: Tables) -> DataFrame:
    return summed(J.run("tap-water", {"pages": _water_pages(t)}, reference(t)))


@query("JOB_tap_water_problems", _few("water table", "count(*)", 25))
def job_water_problems(t: Tables) -> DataFrame:
    return J.run("tap-water", {"pages": _some_lost(_water_pages(t))}, reference(t), min_rows=25)[1]


def _water_pages(t: Tables) -> DataFrame:
    numbers = F.concat_ws(" ", F.format_number("quantity", 0), F.format_number("n", 0), F.format_number(F.col("returned") + 0.25, 2))
    pages = X.printed(t, F.concat(F.lit("Nation "), "letter", F.lit(" "), numbers), "Name Households Connections %", "Page 3")
    return pages.withColumn("printed", F.lit(date(2001, 6, 30)))


@query("JOB_airport_traffic", """
  with r as (select 'nation-' || lower(letter) as place, sum(quantity) as v from report_rows group by 1)
  select 'air-passengers-per-100' as indicator_id, place, 'Apr–Jul 2001 (FY 2001-02 to date)' as period_label, 1 as n,
         floor(v * 12 / 4.0::double / people * 100 * 10 + 0.5) / 10 as total from r join population using (place)
""", "total")
def job_airports(t: Tables) -> DataFrame:
    """A line per nation's airport, of four months; the other numbers of a line must not count."""
    numbers = F.concat_ws(" ", "n", "n", F.lit("-3.5%"), "quantity", "n", F.lit("12.0%"))
    line = F.concat((F.col("nation") + 1).cast("string"), F.lit(" Town NATION "), "letter", F.lit(" "), numbers)
    lines = explode_lines(X.printed(t, line, "No City Airport", "end")).withColumn("month_end", F.lit(date(2001, 7, 31)))
    letter = B.letter(F.col("n_nationkey"))
    airports = t.nation.select(F.concat(F.lit("NATION "), letter).alias("airport"), F.concat(F.lit("nation-"), F.lower(letter)).alias("place"))
    return summed(J.run("airport-traffic", {"lines": lines, "airports": airports}, reference(t)))


@query("JOB_life_tables", """
  select 'life-expectancy' as indicator_id, 'nation-' || lower(letter) as place, '1999-01' as period_label, count(*) as n, sum(quantity)::double as total
  from report_rows group by 2
""", "total")
def job_life(t: Tables) -> DataFrame:
    return summed(_life(t, _life_pages(t)))


@query("JOB_life_tables_problems", _few("table Expectation of life", "count(*)", 25))
def job_life_problems(t: Tables) -> DataFrame:
    return _life(t, _some_lost(_life_pages(t)), min_rows=25)[1]


def _life_pages(t: Tables) -> DataFrame:
    """Rows above the heading belong to another table."""
    line = F.concat(F.lit("Nation "), "letter", F.lit(" "), F.concat_ws(" ", "quantity", "n", "returned"))
    return X.printed(t, line, "Nation A 7 8 9\nExpectation of life", "end")


def _life(t: Tables, pages: DataFrame, **options) -> J.Result:
    period = P.pooled_span(F.lit("1999-01"))
    return J.run("life-tables", {"pages": pages}, reference(t), heading="Expectation of life", indicator="life-expectancy", period=period, **options)


@query("JOB_family_health_records", f"""
  with c as (select right(place, 1) as x, priority, year < 1998 as early, count(*) as v from nation_sales group by 1, 2, 3)
  select case priority when '1-URGENT' then 'urgent' else 'high' end as indicator_id,
         {_place('x', "case when early then date '1995-12-31' else date '1999-12-31' end")} as place,
         case when early then 'Round 1' else 'Round 2' end as period_label, 1 as n, v::double as total
  from c where priority = '2-HIGH' or (priority = '1-URGENT' and not early)
""", "total")
def job_health(t: Tables) -> DataFrame:
    """Two rounds; two of the priorities are wanted, one of them was asked about differently in the first round."""
    survey = F.when(F.col("year") < 1998, "Survey 1").otherwise("Survey 2")
    rows = nation_sales(t).groupBy(state().alias("state"), F.col("priority").alias("sub_indicator"), survey.alias("survey")).agg(
        F.count(F.lit(1)).cast("string").alias("value")
    )
    rounds = {"survey 1": (date(1995, 1, 1), date(1996, 12, 31), "Round 1"), "survey 2": (date(1999, 1, 1), date(2000, 12, 31), "Round 2")}
    landed = {"rows": rows.withColumn("sector", F.lit("Rural + Urban (Combined)"))}
    labels = {"1-URGENT": "urgent", "2-HIGH": "high"}
    return summed(J.run("family-health-records", landed, reference(t), labels=labels, rounds=rounds, skip=[("urgent", "survey 1")]))


@query("JOB_family_health_sheets", """
  with c as (select right(place, 1) as x, year, count(*) as v, count(*) filter (where status = 'P') as p from nation_sales group by 1, 2)
  select 'sales-' || year as indicator_id, 'nation-' || x as place, 'Round 3' as period_label, 1 as n, (case when year < 1998 then p else v end)::double as total
  from c where year < 2001
""", "total")
def job_sheets(t: Tables) -> DataFrame:
    """A sheet per nation, its name broken in two; a later sheet of the years since 1998 prints the numbers the other way round."""
    counts = nation_sales(t).groupBy(state().alias("state"), "year").agg(
        F.count(F.lit(1)).cast("string").alias("v"), F.count_if(F.col("status") == "P").cast("string").alias("p")
    )
    year = F.col("year").cast("string")

    def sheet(rows: DataFrame, first: str, last: str, day: date) -> DataFrame:
        item = F.concat((F.col("year") - 1990).cast("string"), F.lit(". Sales in "), year, F.lit(" of\n"), first, F.lit(" "), last, F.lit(" the place12 (%) and more"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", item.alias("i")))), lambda x: x["i"]), "\n")
        return rows.groupBy("state").agg(F.concat(F.lit("Key Indicators\n"), text).alias("text")).withColumn("released", F.lit(day))

    both = sheet(counts, "v", "p", date(2000, 3, 1)).unionByName(sheet(counts.filter("year >= 1998"), "p", "v", date(2001, 3, 1)))
    sheets = both.select(
        F.concat_ws(" ", "state", F.col("released").cast("string")).alias("doc_id"), F.replace("state", F.lit("Nation"), F.lit("Na tion")).alias("state"), "text", "released"
    )
    labels = {f"Sales in {y} of the place (%)": f"sales-{y}" for y in range(1995, 2001)}
    return summed(J.run("family-health-sheets", {"sheets": sheets}, reference(t), labels=labels, period=(date(1999, 1, 1), date(2000, 12, 31), "Round 3")))


def _projections(t: Tables, words: DataFrame) -> J.Result:
    """Columns are the nations of a region in the order of their keys; a region is the sum of its nations."""
    before = t.nation.select(F.col("n_regionkey").alias("_r"), F.col("n_nationkey").alias("_k"))
    columns = t.nation.join(before, (F.col("n_regionkey") == F.col("_r")) & (F.col("_k") < F.col("n_nationkey")), "left").groupBy(
        F.col("n_regionkey").alias("doc_id"), F.lit(1).alias("page"), "n_nationkey"
    ).agg(F.count("_k").cast("int").alias("place_no"))
    place = F.concat(F.lit("nation-"), F.lower(B.letter(F.col("n_nationkey"))))
    columns = columns.select("doc_id", "page", "place_no", place.alias("place"))
    components = columns.select(F.concat(F.lit("region-"), F.col("doc_id").cast("string")).alias("place"), F.col("place").alias("component"))
    return J.run("population-projections", {"words": words, "columns": columns}, reference(t), components=components, last_year=2000)


@query("JOB_population_projections", """
  with c as (select 'nation-' || lower(chr(65 + c_nationkey)) as place, 'region-' || n_regionkey as region, year(o_orderdate) as year, count(*)::double as v
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3)
  select 'population' as indicator_id, place, year || '-07-01' as period_label, 1 as n, v as total from c where year <= 2000
  union all select 'population', region, year || '-07-01', 1, sum(v) from c where year <= 2000 group by 2, 3
""", "total")
def job_projections(t: Tables) -> DataFrame:
    return summed(_projections(t, X.projection_words(t)))


@query("JOB_projections_problems", """
  with c as (select n_nationkey as k, year(o_orderdate) as year from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    where n_regionkey = 2 group by 1, 2)
  select 'page 1 of 2, ' || year || ', column 1: cells without exactly one value' as problem from c
  where k = (select min(n_nationkey) from nation where n_regionkey = 2)
""")
def job_projections_problems(t: Tables) -> DataFrame:
    """The second numbers of the first column of page 2 are lost."""
    return _projections(t, X.projection_words(t).filter("not (doc_id = 2 and x0 = 126)"))[1]


_SUBSCRIBERS = "State/UT wise number of Internet Subscribers per 100 population at the end of Jun-01"


def _subscriber_pages(t: Tables) -> DataFrame:
    """Rows of six numbers; nations below 5 carry a bracket, those up to 9 a remark, those from 20 wrap; the table of contents is no table."""
    values = F.concat_ws(" ", "n", F.lit("1.5 - 2 3"), F.concat("quantity", F.lit(".25")))
    number, nation = (F.col("nation") + 1).cast("string"), F.col("nation")
    name = F.concat(F.lit("Nation "), "letter", F.when(nation < 5, " (A+B)").when(nation < 10, " incl. Town").otherwise(""))
    line = F.when(nation >= 20, F.concat(F.lit("Nation\n"), number, F.lit(" "), values, F.lit("\n"), "letter")).otherwise(
        F.concat(number, F.lit(" "), name, F.lit(" "), values)
    )
    total = F.concat(F.lit("Total "), F.concat_ws(" ", "n", F.lit("1 2 3 -"), "quantity"))
    pages = X.printed(t, line, _SUBSCRIBERS, total)
    contents = pages.select("doc_id", F.lit(0).alias("page"), F.lit("Contents\nInternet subscribers 7").alias("text"))
    return pages.unionByName(contents)


@query("JOB_internet_subscribers", """
  select 'internet-subscribers-per-100' as indicator_id, 'nation-' || lower(letter) as place, 'Jun 2001' as period_label, count(*) as n, sum(quantity + 0.25)::double as total
  from report_rows group by 2
  union all select 'internet-subscribers-per-100', 'all', 'Jun 2001', count(distinct doc_id), sum(quantity)::double from report_rows
""", "total")
def job_subscribers(t: Tables) -> DataFrame:
    return summed(J.run("internet-subscribers", {"pages": _subscriber_pages(t)}, reference(t)))


@query("JOB_internet_problems", _few("table of subscribers", "count(*) + 1", 26))
def job_subscribers_problems(t: Tables) -> DataFrame:
    return J.run("internet-subscribers", {"pages": _some_lost(_subscriber_pages(t))}, reference(t), min_rows=26)[1]


def _cleanliness(t: Tables, pages: DataFrame, **options) -> J.Result:
    k, letter = F.col("n_nationkey"), B.letter(F.col("n_nationkey"))
    key = F.when(k < 5, "town").when(k < 10, F.concat(F.lit("town "), F.lower(letter))).when(k < 20, "townhouse").otherwise(F.concat(F.lit("town of "), F.lower(letter)))
    cities = t.nation.select(F.concat(F.lit("nation-"), F.lower(letter)).alias("parent"), key.alias("key"), F.concat(F.lit("city-"), F.lower(letter)).alias("city"))
    league = t.nation.filter(k >= 20).select(F.concat(F.lit("The league of All Nations: Town of "), letter, F.lit(", Nowhere")).alias("text"))
    ref = replace(reference(t), cities=cities)
    shared = {"town east": "town", "town west": "town"}
    period = (date(2000, 4, 1), date(2001, 7, 17), "Round 9")
    return J.run("city-cleanliness", {"pages": pages, "league": league}, ref, year=2001, period=period, shared=shared, **options)


def _ranking_pages(t: Tables) -> DataFrame:
    """Two bodies share the town of nations below 5; from 10 the last word is broken, from 20 the name wraps around its numbers."""
    nation, number = F.col("nation"), (F.col("nation") + 1).cast("string")
    values = F.concat_ws(" ", "quantity", F.lit("-3 12 7"))
    side = F.when(F.col("doc_id") % 2 == 0, " TOWN EAST (MC) ").otherwise(" TOWN WEST (MC) ")
    start = F.concat(number, F.lit(" Nation "), "letter")
    line = (
        F.when(nation < 5, F.concat(start, side, values))
        .when(nation < 10, F.concat(start, F.lit(" TOWN "), "letter", F.lit(" (M. Corp) "), values))
        .when(nation < 20, F.concat(start, F.lit(" TOWNHOUS "), values, F.lit("\nE")))
        .otherwise(F.concat(F.lit("TOWN OF\n"), start, F.lit(" "), values, F.lit("\n"), "letter", F.lit(" (MC)")))
    )
    return X.printed(t, line, "Ranking of Big Cities based on total score\nRank State/UT ULB Name Score", "© Report 2001")


@query("JOB_city_cleanliness", """
  with b as (select lower(letter) as x, case when nation < 5 then doc_id % 2 else 0 end as body, avg(quantity) as v from report_rows group by 1, 2)
  select 'cleanliness-score' as indicator_id, 'city-' || x as place, 'Round 9' as period_label, 1 as n, floor(avg(v) + 0.5)::double as total from b group by x
  union all select 'cleanliness-league', 'city-' || letter, 'Round 9', 1, 1.0 from nations where n_nationkey >= 20
""", "total")
def job_cleanliness(t: Tables) -> DataFrame:
    return summed(_cleanliness(t, _ranking_pages(t)))


@query("JOB_cleanliness_problems", _few("ranking", "count(*)", 25) + """
  union all select distinct 'no city for ' || chr(39) || 'Nowhere' || chr(39) from nations where n_nationkey >= 20
""")
def job_cleanliness_problems(t: Tables) -> DataFrame:
    return _cleanliness(t, _some_lost(_ranking_pages(t)), min_rows=25)[1]


@query("JOB_maternal_mortality", """
  select 'maternal-mortality' as indicator_id, 'nation-' || lower(letter) as place, '1999-01' as period_label, count(*) as n, sum(quantity)::double as total
  from report_rows group by 2
""", "total")
def job_mmr(t: Tables) -> DataFrame:
    q, n = F.col("quantity"), F.col("n")
    text = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in (q, q - n, q + n)]
    line = F.concat(F.lit("Nation "), "letter", F.lit(" "), text[0], F.lit(" ( "), text[1], F.lit(" , "), text[2], F.lit(" )"))
    pages = X.printed(t, line, "MMR", "Subtotal 5 ( 1 , 9 )")
    return summed(J.run("maternal-mortality", {"pages": pages}, reference(t), indicator="maternal-mortality", period=P.pooled_span(F.lit("1999-01"))))


@query("JOB_mortality_report", f"""
  with d as (select doc_id, letter from statement_rows group by 1, 2), g as (select doc_id, letter, y from d cross join (select unnest(range(1995, 2002)) as y))
  select 'annual-lines' as indicator_id, {_place('g.letter', "make_date(y::int, 7, 2)")} as place, y::varchar as period_label, count(*) as n,
         sum(coalesce(s.n, 0))::double as total
  from g left join statement_rows s on s.doc_id = g.doc_id and s.letter = g.letter and s.year = g.y group by 2, 3
""", "total")
def job_mortality(t: Tables) -> DataFrame:
    return summed(J.run("mortality-report", {"pages": X.statement_pages(t)}, reference(t), heading="Statement 5:", indicator="annual-lines"))


def _municipal_pages(t: Tables) -> DataFrame:
    number = F.col("nation") + 1
    dash = F.when(F.col("returned") == 0, "-").otherwise(F.col("returned").cast("string"))
    line = F.concat(
        F.lit("<tr><td>"), number.cast("string"), F.lit(". Nation&nbsp;"), "letter", F.lit("</td><td><b>"), F.format_number("n", 0),
        F.lit("</b></td><td>"), dash, F.lit("</td><td>1</td></tr>"),
    )
    head = (
        "<table><tr><th>State/UT</th><th colspan=3>Own Revenue</th></tr><tr><th>1999-00 (A)</th><th>2000-01 (RE)</th><th>2001-02 (BE)</th></tr>"
    )
    return X.printed(t, line, head, "</table>")


@query("JOB_municipal_finance", """
  select 'municipal-own-revenue-share' as indicator_id, 'nation-' || lower(letter) as place, '1999-00' as period_label, count(*) as n, sum(n * 100.0)::double as total
  from report_rows group by 2
  union all select 'municipal-own-revenue-share', 'nation-' || lower(letter), '2000-01', count(*), sum(returned * 100.0)::double from report_rows where returned > 0 group by 2
""", "total")
def job_municipal(t: Tables) -> DataFrame:
    return summed(J.run("municipal-finance", {"pages": _municipal_pages(t).withColumnRenamed("text", "html")}, reference(t)))


@query("JOB_municipal_problems", _few("statement of own revenue", "count(*)", 25))
def job_municipal_problems(t: Tables) -> DataFrame:
    return J.run("municipal-finance", {"pages": _some_lost(_municipal_pages(t)).withColumnRenamed("text", "html")}, reference(t), min_rows=25)[1]


@query("JOB_learning_survey", """
  with c as (select o_custkey as place, count(*) as n, count(*) filter (where o_orderstatus = 'F') as f,
    count(*) filter (where o_orderstatus = 'P') as p from orders group by 1),
  m as (select place, floor(((f * 100 // n) + (p * 100 // n)) / 2.0 * 10 + 0.5) / 10 as v from c)
  select 'learning-' || k as indicator_id, place::varchar as place, 'round 1' as period_label, 1 as n, v::double as total from m, (select unnest(['grade-3', 'overall']) as k)
  union all select 'learning-' || k, 'all', 'round 1', 1, 33.5 from (select unnest(['grade-3', 'overall']) as k)
""", "total")
def job_learning(t: Tables) -> DataFrame:
    st = F.col("o_orderstatus")
    counts = t.orders.groupBy(F.col("o_custkey").cast("string").alias("place")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(st == "F").alias("f"), F.count_if(st == "P").alias("p")
    )

    def pct(c: str) -> Column:
        return F.concat(F.floor(F.col(c) * 100 / F.col("n")).cast("string"), F.lit("%"))

    text = F.concat(F.lit("Comparison of State Average with National\n"), pct("f"), F.lit("\nFilled\n33%\n"), pct("p"), F.lit("\nPending\n34%\nState National"))
    charts = counts.select("place", F.lit(3).alias("grade"), text.alias("text"))
    period = (date(2000, 1, 1), date(2000, 12, 31), "round 1")
    return summed(J.run("learning-survey", {"charts": charts}, reference(t), subjects={3: 2}, period=period))


@query("JOB_air_quality", """
  with r as (select strftime(ts, '%Y-%m-%d') as day, user_id as city, cast(value as decimal(10,2)) as value from events)
  select 'aqi-daily-mean' as indicator_id, place, day as period_label, 1 as n, sum(value)::double / count(*) as total from (
    select state as place, day, value from r join city_map using (city) union all select 'all', day, value from r) group by 2, 3
""", "total")
def job_air(t: Tables) -> DataFrame:
    readings = t.events.select(
        F.to_date("ts").alias("day"), F.col("user_id").alias("city"), F.col("value").cast("decimal(10,2)").alias("value")
    )
    return summed(J.run("air-quality", {"readings": readings, "cities": city_map(t)}, reference(t)))


view("quarter_rows", "select place, year, quarter, count(*) as value from nation_sales group by 1, 2, 3")


@query("JOB_digital_payments", """
  with q as (select * from quarter_rows union all select 'all', year, quarter, sum(value) from quarter_rows group by 2, 3)
  select 'digital-payments-per-capita' as indicator_id, place, year || '' as period_label, 1 as n, floor(sum(value)::double / any_value(people) * 10 + 0.5) / 10 as total
  from q join population using (place) where year < 2001 group by 2, 3
  union all
  select 'digital-payments-per-capita', place, '2000Q4–2001Q3', 1, floor(sum(value)::double / any_value(people) * 10 + 0.5) / 10
  from q join population using (place) where year * 10 + quarter > 20003 group by 2
""", "total")
def job_payments(t: Tables) -> DataFrame:
    quarters = nation_sales(t).groupBy("place", "year", "quarter").agg(F.count(F.lit(1)).alias("value"))
    landed = quarters.select(state().alias("state"), "year", "quarter", "value")
    return summed(J.run("digital-payments", {"quarters": landed}, reference(t)))


@query("JOB_national_accounts", """
  with g as (select place, year, count(*) as v from nation_sales group by 1, 2),
  l as (select *, year || '-' || lpad(((year + 1) % 100)::varchar, 2, '0') as label from g)
  select 'growth-real' as indicator_id, place, label as period_label, 1 as n, v::double as total from l
  union all select 'growth-real-3yr', a.place, a.label || ' to ' || c.label, 1, round((a.v + b.v + c.v) / 3.0::double, 2)
  from l a join l b on b.place = a.place and b.year = a.year + 1 join l c on c.place = a.place and c.year = a.year + 2
""", "total")
def job_accounts(t: Tables) -> DataFrame:
    counts = nation_sales(t).groupBy("place", "year").agg(F.count(F.lit(1)).alias("v"))
    rows = counts.select(
        F.lit("growth-real").alias("indicator_id"), state().alias("state"), P.fiscal_label(F.col("year")).alias("year"), F.format_number("v", 0).alias("value")
    )
    return summed(J.run("national-accounts", {"rows": rows}, reference(t)))


@query("JOB_labour_force", f"""
  with c as (select right(place, 1) as x, year, count(*) as n, count(*) filter (where status = 'P') as p,
    count(*) filter (where priority = '1-URGENT') as u from nation_sales group by 1, 2)
  select 'urgent-rate' as indicator_id, {_place('x', "make_date(year::int, 7, 2)")} as place, year::varchar as period_label, 1 as n, u::double as total from c
  union all select 'regular-wage-share', {_place('x', "make_date(year::int, 7, 2)")}, year::varchar, 1, 100.0 * p::double / n from c where p > 0 and year <> 1999
""", "total")
def job_labour(t: Tables) -> DataFrame:
    """Shares of the three statuses; in 1999 one of them is printed twice as large and the year is skipped."""
    sales = nation_sales(t).withColumn("state", state())
    rows = sales.groupBy("state", "year", F.col("priority").alias("kind")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    code = F.when(F.col("status") == "F", "3").when(F.col("status") == "P", "4").otherwise("5")
    parts = sales.groupBy("state", "year", code.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    totals = parts.groupBy("state", "year").agg(F.sum("n").alias("all"))
    factor = F.when(F.col("year") == 1999, 200.0).otherwise(100.0)
    shares = parts.join(totals, ["state", "year"]).withColumn("value", factor * F.col("n") / F.col("all"))
    return summed(J.run("labour-force", {"rows": rows, "shares": shares}, reference(t), expected={"kind": "1-URGENT"}, indicator="urgent-rate"))


@query("JOB_consumer_prices", f"""
  with c as (select right(place, 1) as x, year, month, count(*) as v from nation_sales group by 1, 2, 3)
  select 'cpi-inflation' as indicator_id, {_place('x', "make_date(year::int, month::int, 15)")} as place, strftime(make_date(year::int, month::int, 1), '%b %Y') as period_label,
         1 as n, v::double as total from c where not (x in ('f', 'g') and make_date(year::int, month::int, 1) >= date '2000-01-26')
""", "total")
def job_prices(t: Tables) -> DataFrame:
    counts = nation_sales(t).withColumn("state", state()).groupBy("state", "year", "month").agg(F.count(F.lit(1)).alias("v"))
    name = F.date_format(F.make_date(F.lit(2000), "month", F.lit(1)), "MMMM")
    rows = counts.select(
        "state", "year", name.alias("month"), F.lit("General-Overall").alias("subgroup"), F.col("v").cast("string").alias("inflation"), F.lit("F").alias("status")
    )
    out = J.run("consumer-prices", {"rows": rows}, reference(t), partial=["nation f", "Nation G"], merger=date(2000, 1, 26))
    return summed(out)


@query("JOB_road_deaths", f"""
  with c as (select right(place, 1) as x, year, count(*) as v from nation_sales group by 1, 2)
  select 'road-deaths' as indicator_id, {_place('x', "make_date(year::int, 7, 2)")} as place, year::varchar as period_label, 1 as n,
         floor(v * 100000.0::double / people * 10 + 0.5) / 10 as total
  from c join population p on p.place = 'nation-' || x where not (x = 'k' and year < 1999)
""", "total")
def job_roads(t: Tables) -> DataFrame:
    years = list(range(1995, 2002))
    counts = nation_sales(t).withColumn("state", F.when(F.col("place") == "nation-k", "Nation K #").otherwise(state()))
    wide = counts.groupBy("state").agg(*[F.nullif(F.count_if(F.col("year") == y), F.lit(0).cast("bigint")).alias(f"{y} Killed") for y in years])
    return summed(J.run("road-deaths", {"wide": wide}, reference(t), first_good_year=1999))


CITY_TABLES = {
    "1B.3": J.CityTable(r"^TABLE\s+1B\.3\s*$", "crime-rate", "charge-rate"),
    "2B.1": J.CityTable(r"^TABLE\s+2B\.1\s*$", "murder-rate"),
}
view("metro_years", "select place, year, count(*) as n, count(*) filter (where status = 'P') as n_p from nation_sales group by 1, 2")
view("metro_rows", """
  select right(y.place, 1) as x, y.year, y.n, y.n_p, b.n as n1, b.n_p as p1, c.n as n2, c.n_p as p2 from metro_years y
  left join metro_years b on b.place = y.place and b.year = y.year - 1 left join metro_years c on c.place = y.place and c.year = y.year - 2
""")


def _metro_pages(t: Tables) -> DataFrame:
    """Yearly editions with one page a table: names from U on wrap, 1998 prints no rate, editions before lack the second table."""
    now = nation_sales(t).groupBy("place", "year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "P").alias("n_p"))
    back = [now.select("place", (F.col("year") + k).alias("year"), F.col("n").alias(f"n{k}"), F.col("n_p").alias(f"p{k}")) for k in (1, 2)]
    rows = now.join(back[0], ["place", "year"], "left").join(back[1], ["place", "year"], "left")
    letter = F.upper(F.substring("place", -1, 1))

    def count(c: str) -> Column:
        return F.coalesce(F.format_number(c, 0), F.lit("-"))

    def page(table: str, rate: Column, counts: list[str], last: Column) -> DataFrame:
        values = F.concat_ws(" ", *[count(c) for c in counts], F.lit("2.0"), rate, last)
        number = (F.ascii(letter) - 64).cast("string")
        line = F.when(letter >= "U", F.concat(F.lit("Town "), letter, F.lit("\n"), number, F.lit(" "), values)).otherwise(
            F.concat(number, F.lit(" Town "), letter, F.lit(" "), values)
        )
        body = rows.groupBy("year").agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", line.alias("l"))))["l"], "\n").alias("_b"))
        text = F.concat(F.lit(f"TABLE {table}\nTowns\n"), "_b", F.lit("\n97 Town A 1 2 3\n98 Elsewhere 1 1 1 1.0 1.0 1.0\nSource: records"))
        return body.select(F.col("year").alias("doc_id"), "year", F.lit(1).alias("page"), text.alias("text"))

    first = page("1B.3", F.when(F.col("year") == 1998, "-").otherwise(F.format_number("n", 1)), ["n2", "n1", "n"], F.format_number(F.col("n") % 100 + 0.5, 1))
    second = page("2B.1", F.format_number("n_p", 1), ["p2", "p1", "n_p"], F.lit("-")).filter("year >= 1998").withColumn("page", F.lit(2))
    return first.unionByName(second)


def _metro(t: Tables, min_rows: int = 1) -> J.Result:
    letter = F.lower(B.letter(F.col("n_nationkey")))
    cities = t.nation.select(F.concat(F.lit("nation-"), letter).alias("parent"), F.concat(F.lit("town "), letter).alias("key"), F.concat(F.lit("city-"), letter).alias("city"))
    return J.run("metro-crime", {"pages": _metro_pages(t)}, replace(reference(t), cities=cities), tables=CITY_TABLES, min_rows=min_rows)


@query("JOB_metro_crime", """
  with every as (
    select 'crime-rate' as i, x, year, case when year <> 1998 then n::double end as v, 0 as back from metro_rows
    union all select 'crime-rate', x, year - 1, floor(n1 / 2.0 * 10 + 0.5) / 10, 1 from metro_rows
    union all select 'crime-rate', x, year - 2, floor(n2 / 2.0 * 10 + 0.5) / 10, 2 from metro_rows
    union all select 'murder-rate', x, year, n_p::double, 0 from metro_rows where year >= 1998
    union all select 'murder-rate', x, year - 1, floor(p1 / 2.0 * 10 + 0.5) / 10, 1 from metro_rows where year >= 1998
    union all select 'murder-rate', x, year - 2, floor(p2 / 2.0 * 10 + 0.5) / 10, 2 from metro_rows where year >= 1998
    union all select 'charge-rate', x, year, n % 100 + 0.5, 0 from metro_rows)
  select i as indicator_id, 'city-' || x as place, year::varchar as period_label, 1 as n, v as total from every where v is not null
  qualify row_number() over (partition by i, x, year order by back) = 1
""", "total")
def job_metro(t: Tables) -> DataFrame:
    return summed(_metro(t))


@query("JOB_metro_problems", """
  with p as (select distinct year, unnest(case when year >= 1998 then ['1B.3', '2B.1'] else ['1B.3'] end) as t from metro_rows)
  select 'table ' || t || ' of ' || year || ': unknown city ''Elsewhere''' as problem from p
  union all select distinct 'table 2B.1 of ' || year || ': not found' from metro_rows where year < 1998
  union all select 'table ' || t || ' of ' || year || ': few cities read' from p where (select count(*) from metro_rows m where m.year = p.year) < 25
""")
def job_metro_problems(t: Tables) -> DataFrame:
    return _metro(t, 25)[1]


def _suicide_pages(t: Tables) -> DataFrame:
    """Three pages: nations below 12, the rest with the total and a city, then cities alone; every fourth title has a hyphen."""
    number = (F.col("nation") + 1).cast("string")
    values = F.concat_ws(" ", F.format_number("n", 0), F.lit("4.0 -"), F.format_number(F.col("returned") + 0.5, 1))
    line = F.when(F.col("nation") >= 20, F.concat(F.lit("Nation\n"), number, F.lit(" "), values, F.lit("\n"), "letter")).otherwise(
        F.concat(number, F.lit(" Nation "), "letter", F.lit(" "), values)
    )
    lines = X.report_rows(t).select("doc_id", "nation", line.alias("_line"), "n", "returned")

    def body(which: Column) -> Column:
        chosen = F.array_sort(F.collect_list(F.when(which, F.struct("nation", "_line"))))
        return F.array_join(F.transform(chosen, lambda x: x["_line"]), "\n")

    pages = lines.groupBy("doc_id").agg(body(F.col("nation") < 12).alias("_a"), body(F.col("nation") >= 12).alias("_b"), F.sum("n").alias("_n"), F.sum("returned").alias("_r"))
    title = F.concat(F.lit("Table 2.2\nIncidence and Rate of Suicides "), F.when(F.col("doc_id") % 4 == 0, "- 2000").otherwise("– 2000"), F.lit(" (State/UT-wise)\n"))
    total = F.concat(F.lit("\nTOTAL (ALL INDIA) "), F.format_number("_n", 0), F.lit(" 100.0 - "), F.format_number(F.col("_r") + 0.5, 1))
    texts = F.array(F.concat(title, "_a"), F.concat(F.col("_b"), total, F.lit("\n1 Nation A 7 7 7 7.0")), F.lit("2 Nation B 8 8 8 8.0\nTOTAL (CITIES) 9 9 9 9.0"))
    return pages.select("doc_id", F.lit(2000).alias("year"), F.posexplode(texts).alias("page", "text"))


@query("JOB_suicides", """
  with r as (select 'nation-' || lower(letter) as place, returned from report_rows union all select 'all', sum(returned) from report_rows group by doc_id)
  select 'suicide-rate' as indicator_id, place, '2000' as period_label, count(*) as n, sum(returned + 0.5)::double as total from r group by 2
""", "total")
def job_suicides(t: Tables) -> DataFrame:
    return summed(J.run("suicides", {"pages": _suicide_pages(t)}, reference(t)))


@query("JOB_suicides_problems", _few("table of suicides", "count(*) + 1", 26) + """
  union all select 'table of suicides of ' || doc_id || ': title not found' from report_rows where doc_id % 7 = 0 group by doc_id
""")
def job_suicides_problems(t: Tables) -> DataFrame:
    return J.run("suicides", {"pages": _some_lost(_suicide_pages(t))}, reference(t), min_rows=26)[1]


@query("JOB_consumption_gini", f"""
  with c as (select right(place, 1) as x, year, count(*) filter (where status = 'F')::double as f, count(*) filter (where status = 'P')::double as p
    from nation_sales group by 1, 2),
  l as (select *, {_place('x', "make_date(year::int, 8, 1) + 182")} as place, year || '-' || lpad(((year + 1) % 100)::varchar, 2, '0') as label from c)
  select 'gini-rural' as indicator_id, place, label as period_label, 1 as n, f as total from l where f > 0
  union all select 'gini-urban', place, label, 1, p from l where p > 0
  union all select 'consumption-gini', place, label, 1, (f + p) / 2 from l where f > 0 and p > 0
""", "total")
def job_gini(t: Tables) -> DataFrame:
    sector = F.when(F.col("status") == "F", "rural").otherwise("urban")
    rows = nation_sales(t).filter("status <> 'O'").withColumn("state", state()).groupBy("state", "year", sector.alias("sector")).agg(
        F.count(F.lit(1)).cast("string").alias("value")
    )
    return summed(J.run("consumption-gini", {"rows": rows}, reference(t)))


@query("JOB_environment", f"""
  with c as (select right(place, 1) as x, year, count(*) filter (where priority = '1-URGENT')::double as u, count(*) filter (where priority = '5-LOW')::double as l,
    count(*) as v from nation_sales group by 1, 2),
  air as (select x, year, floor(avg(coalesce(f, p)) * 10 + 0.5) / 10 as v from (
    select chr(97 + c_nationkey) as x, year(o_orderdate) as year, o_custkey, max(o_totalprice) filter (where o_orderstatus = 'F') as f,
      max(o_totalprice) filter (where o_orderstatus = 'P') as p from orders join customer on o_custkey = c_custkey group by 1, 2, 3)
    where coalesce(f, p) is not null group by 1, 2)
  select 'pm25-annual' as indicator_id, {_place('x', "make_date(year::int, 7, 2)")} as place, year::varchar as period_label, 1 as n, v::double as total from air
  union all select 'waste-processed', {_place('x', "make_date(year::int, 9, 30)")}, year || '-' || lpad(((year + 1) % 100)::varchar, 2, '0'), 1,
    floor(least(u / l, 1) * 100 * 10 + 0.5) / 10 from c where l > 0 and u > 0
  union all select 'vehicles-per-1000', {_place('x', "make_date(year::int, 7, 2)")}, year::varchar, 1, floor(v * 1000.0::double / people + 0.5)
  from c join population p on p.place = 'nation-' || x
""", "total")
def job_environment(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    nation = F.concat(F.lit("Nation "), B.letter(F.col("c_nationkey")))
    st = F.col("o_orderstatus")
    label = F.when(st == "O", "Nitrogen").otherwise("SO2")
    air = joined.select(
        nation.alias("state"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("city"),
        F.when(st == "F", "CAAQMS").otherwise("NAMP").alias("network"), label.alias("label"), F.col("o_totalprice").alias("value"),
    )
    sales = nation_sales(t).withColumn("state", state())
    part = F.when(F.col("priority") == "1-URGENT", "Treated").when(F.col("priority") == "5-LOW", "Generated")
    waste = sales.withColumn("part", part).filter("part is not null").groupBy("state", "year", "part").agg(F.count(F.lit(1)).cast("double").alias("value"))
    cars = sales.groupBy("state", "year").agg(F.count(F.lit(1)).cast("double").alias("value"))
    out = J.run(
        "environment", {"air": air, "waste": waste, "vehicles": cars}, reference(t), columns={"Nitrogen": "SO2", "SO2": "PM2.5"},
        merged={"nation-zz": "nation-z"}, since=date(2000, 1, 26),
    )
    return summed(out)


@query("JOB_schools", """
  with c as (select place, year, count(*) filter (where priority = '1-URGENT')::double as u, count(*) filter (where status = 'F' and priority = '1-URGENT')::double as z
    from nation_sales group by 1, 2),
  l as (select *, year || '-' || lpad(((year + 1) % 100)::varchar, 2, '0') as label from c)
  select 'enrolment' as indicator_id, place, label as period_label, 1 as n, u as total from l where u > 0
  union all select 'dropout', place, label, 1, z from l where u > 0 and z <> 0
""", "total")
def job_schools(t: Tables) -> DataFrame:
    urgent = nation_sales(t).filter("priority = '1-URGENT'").withColumn("state", state())
    counts = urgent.groupBy("state", "year").agg(F.count(F.lit(1)).alias("u"), F.count_if(F.col("status") == "F").alias("z"))
    measures = F.explode(F.array(F.struct(F.lit("a").alias("k"), F.col("u").alias("v")), F.struct(F.lit("b").alias("k"), F.col("z").alias("v"))))
    rows = counts.select("state", P.fiscal_label(F.col("year")).alias("year"), measures.alias("m")).select(
        "state", "year", F.col("m.k").alias("measure"), F.col("m.v").cast("string").alias("value")
    )
    return summed(J.run("schools", {"rows": rows}, reference(t), series={"enrolment": {"measure": "a"}, "dropout": {"measure": "b"}}, unreliable="dropout"))


@query("JOB_police_strength", """
  select 'police-vacancy' as indicator_id, 'nation-' || lower(letter) as place, '2001-01-01' as period_label, count(*) as n,
         sum(round((quantity - n) / quantity::double * 100, 2)) as total from report_rows group by 2
""", "total")
def job_police(t: Tables) -> DataFrame:
    values = F.concat_ws(" ", F.lit("1 2"), F.format_number("quantity", 0), F.format_number("n", 0), F.lit("5 6"))
    line = F.concat((F.col("nation") + 1).cast("string"), F.lit(" Nation "), "letter", F.lit(" "), values)
    pages = X.printed(t, line, "TABLE 3.1.1", "end").withColumn("day", F.lit(date(2001, 1, 1)))
    return summed(J.run("police-strength", {"pages": pages}, reference(t)))


@query("JOB_police_problems", _few("strength table", "count(*)", 25))
def job_police_problems(t: Tables) -> DataFrame:
    line = F.concat((F.col("nation") + 1).cast("string"), F.lit(" Nation "), "letter", F.lit(" 1 2 3 4 5 6"))
    pages = _some_lost(X.printed(t, line, "TABLE 3.1.1", "end")).withColumn("day", F.lit(date(2001, 1, 1)))
    return J.run("police-strength", {"pages": pages}, reference(t), min_rows=25)[1]


# Two tables are not there, one has another title.
NOT_THERE, RETITLED = (153, 173), 149
SURVEYS = {"NFHS-4": (date(1995, 1, 1), date(1996, 12, 31), "1995-96"), "NFHS-5": (date(1999, 1, 1), date(2001, 12, 31), "1999-01")}


def printed_sheets(t: Tables) -> DataFrame:
    """Sums per nation and year, printed as the handbook prints its tables, all in one landed table."""
    st, years = F.col("status"), list(range(1995, 2002))
    conditions = {"f": st == "F", "p": st == "P", "o": st == "O", "a": F.lit(True)}
    sums = [F.sum(F.when((F.col("year") == y) & c, F.col("price"))).cast("double").alias(f"{k}{y}") for k, c in conditions.items() for y in years]
    wide = nation_sales(t).withColumn("state", state()).groupBy("state").agg(*sums).withColumn("x", F.right("state", F.lit(1)))

    def of(kind: str, chosen: list[int] = years, factor: float = 1.0) -> list[str]:
        return [f"cast({kind}{y} * {factor}D as string)" for y in chosen]

    def only(condition: str, columns: list[str], otherwise: str = "null") -> list[str]:
        return [f"if({condition}, {c}, {otherwise.format(c)})" for c in columns]

    fiscal = [f"{y}-{(y + 1) % 100:02d}" for y in years]
    march = [str(y + 1) for y in years]
    stock = [*march[:3], "1998*", *march[4:]]
    waters = [f"Stage of Ground Water Extraction (%) ({y})" for y in (1997, 2000)]
    printed = {
        10: (["NFHS-4", "NFHS-5", "Other"], of("f", [1995]) + of("o", [1999]) + of("a", [1995])), 20: (fiscal, of("a", factor=0.125)),
        21: (fiscal, only("x not in ('X', 'Y')", of("a"))), 22: (fiscal, of("o")),
        99: (["1995", "1997", "1999*", "2000*", "2001*"], of("a", [1995, 1997, 1999]) + only("x <> 'X'", of("a", [2000, 2001]))),
        107: (["Net Annual", *waters], of("f", [1995]) + only("x <> 'C'", of("a", [1997, 2000]), "{0} || '*'")),
        138: (fiscal, of("f", factor=0.5)), 140: (fiscal, of("o")), 143: (march, of("p")),
        144: (stock, of("f")), 145: (stock, of("p")), 146: (stock, only("x <> 'D'", of("o"), "{0} || ' *'")), 147: (stock, of("a")),
        164: (fiscal, of("f")), 166: (fiscal, of("o")), 168: (fiscal, of("p")),
        174: ([f"{y} ({'BE' if y == '2001-02' else 'RE'})" for y in fiscal], of("p")), 181: (fiscal, of("a", factor=0.001)),
    }
    heads, bodies = [], []

    def head(number: int, part: int, at: int, *texts: str | None) -> None:
        heads.append({"table_no": number, "sheet": part, "row_no": at, "cells": texts})

    def body(number: int, part: int, columns: list[str]) -> None:
        bodies.append(f"named_struct('table_no', {number}, 'sheet', {part}, 'row_no', ascii(x), 'cells', array(state, {', '.join(columns)}))")

    for number, (labels, values) in printed.items():
        head(number, 1, 1, f"TABLE {number}", "(₹ Lakh)" if number in (21, 22) else "(₹ crore)")
        if number == 22:  # the years stand in a second header row
            head(number, 1, 2, "State/Union Territory", *["Base: 1995-96"] * len(labels))
            head(number, 1, 3, None, *labels)
        else:
            head(number, 1, 2, "State/Union Territory", *labels)
        head(number, 1, 900, "Note: as reported", *["1"] * len(labels))
        body(number, 1, values)
    for i, y in enumerate(years):
        head(176, i, 1, f"TABLE 176: LIABILITIES - {y + 1}", None)
        head(176, i, 2, "State", "Loans", "Outstanding Liabilities")
        body(176, i, ["'1'", f"cast(f{y} * if(x = 'E', {1000 if y == 1998 else 1}D, 1D) as string)"])
    sheets = F.from_json(F.lit(json.dumps(heads)), "array<struct<table_no int, sheet int, row_no int, cells array<string>>>")
    rows = t.region.filter("r_regionkey = 0").select(F.inline(sheets))
    return rows.unionByName(wide.selectExpr(f"inline(array({', '.join(bodies)}))"))


def _landed_handbook(t: Tables) -> dict[str, DataFrame]:
    listed = [(n, f"Table {n}: " + ("Fax Machines" if n == RETITLED else title)) for n, title in TITLES.items() if n not in NOT_THERE]
    product = nation_sales(t).filter("place in ('nation-x', 'nation-y')").groupBy("place", "year").agg((F.sum("price").cast("double") * 2).alias("value"))
    fallback = product.select("place", P.fiscal_label(F.col("year")).alias("period_label"), "value")
    covered = B.people(t).filter("place < 'nation-k'").select("place")
    return {
        "sheets": t.stored("handbook_sheets", printed_sheets), "listing": t.spark.createDataFrame(listed, "number int, title string"),
        "fallback": fallback, "covered": covered,
    }


def _handbook(t: Tables) -> J.Result:
    return state_handbook(
        _landed_handbook(t), reference(t), rounds=SURVEYS, since=1995, base=1995,
        merged={"Nation Y": "Nation X"}, merged_since=2000, split=["nation-b", "nation-b-undivided"],
    )


# Debts as printed (one with three more digits), and whether they stand far above both their neighbours.
HANDBOOK_DEBTS = """
  with printed as (
    select upper(right(place, 1)) as x, year, sum(price)::double * case when place = 'nation-e' and year = 1998 then 1000 else 1 end as owed
    from nation_sales where status = 'F' group by place, year)
  select n.*, coalesce(b.owed <> 0 and z.owed <> 0 and n.owed > 2.5 * greatest(b.owed, z.owed), false) as spike
  from printed n left join printed b on b.x = n.x and b.year = n.year - 1 left join printed z on z.x = n.x and z.year = n.year + 1
"""


@query("JOB_state_handbook", f"""
  with c as (select upper(right(place, 1)) as x, year, sum(price) filter (where status = 'F')::double as f, sum(price) filter (where status = 'P')::double as p,
    sum(price) filter (where status = 'O')::double as o, sum(price)::double as a from nation_sales group by 1, 2),
  l as (select *, {_place('x', "make_date(year::int, 9, 30)")} as place, year || '-' || lpad(((year + 1) % 100)::varchar, 2, '0') as label,
    case when x in ('X', 'Y') then a * 2 else a / 100 end as product from c),
  d as (select l.*, people, people * 2.0 as area, l.place < 'nation-k' and l.place not like '%undivided' as covered from l join population q on q.place = 'nation-' || lower(x)),
  debts as ({HANDBOOK_DEBTS}),
  one as (
    select 'fiscal-deficit-share' as indicator_id, place, label as period_label, f / product * 100 as v from d
    union all select 'own-tax-share', place, label, p / product * 100 from d
    union all select 'debt-share', place, label, owed / product * 100 from d join debts using (x, year) where not spike
    union all select 'capital-share', place, label, p / (p + o) * 100 from d where year < 2001
    union all select 'net-product-per-person', place, label, a * 0.125 from d where not covered
    union all select 'product-current', place, label, a / 100 from d where not covered and x not in ('X', 'Y')
    union all select 'product-constant', place, label, o / 100 from d where not covered
    union all select 'power-per-person', place, label, f * 0.5 from d
    union all select 'renewable-share', place, label, least(p / o * 100, 100) from d where o > 0 and p is not null
    union all select 'exports-per-person', place, label, a * 0.001 / people * 1e6 from d
    union all select 'road-density', place, label, o / area * 100 from d where x <> 'D'
    union all select 'national-highway-density', place, label, f / area * 1000 from d
    union all select 'state-highway-density', place, label, a / area * 1000 from d
    union all select 'rail-density', place, label, p / area * 1000 from d
    union all select 'ground-water-stage', {_place('x', "make_date(year::int, 7, 2)")}, year::varchar, a from c where year in (1997, 2000) and x <> 'C'
    union all select 'poverty-headcount', {_place('x', "date '1996-01-01'")}, '1995-96', f from c where year = 1995
    union all select 'poverty-headcount', 'nation-' || lower(x), '1999-01', o from c where year = 1999
    union all select 'forest-change', case when k.x = 'Y' and b.year >= 2000 then 'nation-x' else {_place('k.x', "make_date(k.year::int, 7, 2)")} end, k.year::varchar, (k.a - b.a) / b.a * 100
      from c k join c b on b.x = k.x and (b.year, k.year) in ((1995, 1997), (1999, 2000), (2000, 2001)) where (k.x <> 'B' or b.year >= 2000) and (k.x <> 'X' or b.year = 1995)),
  growth as (select y.place, y.label, y.year, floor((y.o / z.o - 1) * 100 * 100 + 0.5) / 100 as v from d y join d z on z.place = y.place and z.year = y.year - 1 where not y.covered and z.o > 0),
  rounded as (
    select indicator_id, place, period_label, floor(v * 1000 + 0.5) / 1000 as v from one where v is not null
    union all select 'growth-real', place, label, v from growth where v is not null
    union all select 'growth-real-3y', g.place, i.label || ' to ' || g.label, floor((g.v + h.v + i.v) / 3 * 100 + 0.5) / 100
      from growth g join growth h on h.place = g.place and h.year = g.year - 1 join growth i on i.place = g.place and i.year = g.year - 2 where g.v + h.v + i.v is not null)
  select indicator_id, place, period_label, count(*) as n, sum(v) as total from rounded group by 1, 2, 3
""", "total")
def job_handbook(t: Tables) -> DataFrame:
    """The four split nations are found under their name of the time; two nations have no product of their own."""
    return summed(_handbook(t))


@query("JOB_handbook_problems", f"""
  select unnest(['table 149 (Telephones per 100 Population): other title', 'table 153 (Credit-Deposit Ratio of Scheduled Commercial Banks): missing',
    'table 173 (Capital Expenditure): missing']) as problem
  union all select 'table 176: Nation ' || x || ' ' || year || ' skipped as a likely typo' from ({HANDBOOK_DEBTS}) where spike
""")
def job_handbook_problems(t: Tables) -> DataFrame:
    return _handbook(t)[1]
