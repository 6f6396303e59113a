"""Registered queries of derived indicators: rates, growth, windows, gap filling."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators import derive as D
from statloom.plans import bindings as B
from statloom.plans.registry import Tables, query, view

# Sales per customer, year and quarter: the finest series the queries below start from.
view("sales", """
  select o_custkey as place, year(o_orderdate) as year, quarter(o_orderdate) as quarter, month(o_orderdate) as month,
         cast(o_totalprice as decimal(14,2)) as price, o_orderstatus as status, o_orderpriority as priority from orders
""")
view("yearly", """
  select place, year, sum(price)::double as value, count(*) as n, count(*) filter (where status = 'P') as n_p
  from sales group by 1, 2
""")


def sales(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("place"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"),
        F.month("o_orderdate").alias("month"), F.col("o_totalprice").cast("decimal(14,2)").alias("price"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


def yearly(t: Tables) -> DataFrame:
    return sales(t).groupBy("place", "year").agg(
        F.sum("price").cast("double").alias("value"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "P").alias("n_p")
    )


def nation_of(c: str):
    return F.concat(F.lit("nation-"), F.lower(B.letter(F.col(c))))


def nation_sales(t: Tables) -> DataFrame:
    """Sales with the customer's nation as place."""
    joined = sales(t).join(t.customer.select("c_custkey", "c_nationkey"), F.col("place") == F.col("c_custkey"))
    return joined.withColumn("place", nation_of("c_nationkey")).drop("c_custkey", "c_nationkey")


view("nation_sales", """
  select 'nation-' || lower(chr(65 + c_nationkey)) as place, year, quarter, month, price, status, priority
  from sales s join customer on s.place = c_custkey
""")
view("nation_people", "select place, people from population where place <> 'nation-e'")


def nation_people(t: Tables) -> DataFrame:
    """Denominators; one nation has none."""
    return B.people(t).filter("place <> 'nation-e'")


@query("J8_rate", """
  select place, year, 100000.0 * n / people as rate from (
    select place, year, count(*) as n from nation_sales group by 1, 2) join nation_people using (place)
""", "rate")
def j8(t: Tables) -> DataFrame:
    counts = nation_sales(t).groupBy("place", "year").agg(F.count(F.lit(1)).alias("value"))
    rated, _ = D.rate(counts, nation_people(t), ["place"], 100_000)
    return rated.select("place", "year", "rate")


@query("J8_missing_denominators", "select 'nation-e has no denominator' as problem")
def j8_missing(t: Tables) -> DataFrame:
    counts = nation_sales(t).groupBy("place", "year").agg(F.count(F.lit(1)).alias("value"))
    return D.rate(counts, nation_people(t), ["place"], 100_000)[1]


view("urgent_low", """
  select place, year, sum(price) filter (where priority = '1-URGENT')::double as u,
         sum(price) filter (where priority = '5-LOW')::double as l from sales group by 1, 2
""")


@query("J9_ratio", """
  select place, year, 'percent' as form, least(u / l * 100, 100) as value from urgent_low where u is not null and l <> 0
  union all select place, year, 'share', u / (u + l) * 100 from urgent_low where u is not null and l is not null
""", "value")
def j9(t: Tables) -> DataFrame:
    def part(priority: str) -> DataFrame:
        rows = sales(t).filter(F.col("priority") == priority)
        return rows.groupBy("place", "year").agg(F.sum("price").cast("double").alias("value"))

    num, den, keys = part("1-URGENT"), part("5-LOW"), ["place", "year"]
    percent = D.ratio(num, den, keys, "percent", 100.0).withColumn("form", F.lit("percent"))
    return percent.unionByName(D.ratio(num, den, keys, "share").withColumn("form", F.lit("share")))


@query("J10_density", """
  select place, year, n * 1000.0 / (place + 1) as value from yearly where year >= 1997 and n_p = 0
""", "value")
def j10(t: Tables) -> DataFrame:
    rows = yearly(t).select("place", "year", F.col("n").cast("double").alias("value"), (F.col("n_p") > 0).alias("flagged"))
    area = t.customer.select(F.col("c_custkey").alias("place"), (F.col("c_custkey") + 1.0).alias("area"))
    return D.density(rows, area, 1000.0, 1997)


@query("J11_fill_missing", """
  with a as (select place, year, sum(price)::double / 100 as value from sales where status = 'F' group by 1, 2),
  b as (select place, year, sum(price)::double as value from sales where status <> 'F' group by 1, 2)
  select place, year, coalesce(a.value, b.value) as value, case when a.value is not null then 'primary' else 'fallback' end as source
  from a full join b using (place, year)
""", "value")
def j11(t: Tables) -> DataFrame:
    def part(condition: str) -> DataFrame:
        return sales(t).filter(condition).groupBy("place", "year").agg(F.sum("price").cast("double").alias("value"))

    return D.fill_missing(part("status = 'F'"), part("status <> 'F'"), ["place", "year"], 1 / 100)


@query("J12_only_uncovered", """
  select place, year, n from yearly where place not in (select place from sales where priority = '1-URGENT')
""")
def j12(t: Tables) -> DataFrame:
    covered = sales(t).filter("priority = '1-URGENT'")
    return D.only_uncovered(yearly(t), covered).select("place", "year", "n")


@query("J13_G11_prefer_own_edition", """
  with own as (select place, year, n::double as value, 0 as back, year as edition from yearly where year <> 1998),
  earlier as (select place, year, floor(n / 2.0 * 10 + 0.5) / 10 as value, b as back, year + b as edition
              from yearly, (select unnest([1, 2]) as b) where year + b in (select year from yearly y2 where y2.place = yearly.place)),
  every as (select * from own union all select * from earlier)
  select place, year, value, back from every
  qualify row_number() over (partition by place, year order by back) = 1
""", "value")
def j13(t: Tables) -> DataFrame:
    """Each yearly edition repeats the counts of the two years before; 1998 printed no own rate."""
    rows = yearly(t).select("place", "year", F.col("n").cast("double").alias("n"))
    repeated = rows.select(
        "place", F.explode(F.array(*[F.struct((F.col("year") + b).alias("year"), F.lit(b).alias("back")) for b in (0, 1, 2)])).alias("e"), "n"
    )

    def at(back: int):
        return F.max(F.when(F.col("e.back") == back, F.col("n")))

    editions = repeated.groupBy("place", F.col("e.year").alias("year")).agg(
        at(0).alias("n"), F.array(at(2), at(1)).alias("cases")
    ).filter("n is not null")
    editions = editions.withColumn("rate", F.when(F.col("year") != 1998, F.col("n"))).withColumn("people", F.lit(2.0))
    return D.prefer_own_edition(D.back_rates(editions)).select("place", "year", "value", "back")


@query("J14_override_union", """
  select place, year, coalesce(p.n, f.n) as n from
    (select place, year, count(*) as n from sales where status = 'F' group by 1, 2) f
  full join (select place, year, count(*) as n from sales where status = 'P' group by 1, 2) p using (place, year)
""")
def j14(t: Tables) -> DataFrame:
    def part(status: str) -> DataFrame:
        return sales(t).filter(F.col("status") == status).groupBy("place", "year").agg(F.count(F.lit(1)).alias("n"))

    return D.override_union(part("F"), part("P"), ["place", "year"])


@query("J15_sum_components", """
  select peer_group as place, year, sum(price)::double as value from nation_sales join nations using (place) group by 1, 2
""", "value")
def j15(t: Tables) -> DataFrame:
    parts = nation_sales(t).groupBy("place", "year").agg(F.sum("price").alias("value"))
    components = B.ranked_places(t).select(F.col("peer_group").alias("place"), F.col("place").alias("component"))
    return D.sum_components(parts, components, ["year"]).withColumn("value", F.col("value").cast("double"))


@query("J16_merge_successors", """
  select case when place in ('nation-f', 'nation-g') and year >= 1998 then 'nation-fg' else place end as place, year,
         sum(price)::double as value
  from nation_sales where not (place = 'nation-h' and year < 1998) group by 1, 2
""", "value")
def j16(t: Tables) -> DataFrame:
    rows = nation_sales(t).withColumn("period_end", F.make_date("year", F.lit(12), F.lit(31)))
    merged = D.merge_successors(
        rows, {"nation-f": "nation-fg", "nation-g": "nation-fg"}, date(1998, 6, 1), combined=["nation-h"]
    )
    return merged.groupBy("place", "year").agg(F.sum("price").cast("double").alias("value"))


@query("J26_symmetric_edges", """
  with e as (select distinct c_nationkey as a, s_nationkey as b from orders join customer on o_custkey = c_custkey
    join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey where c_nationkey < s_nationkey)
  select a, b from e union select b, a from e
""")
def j26(t: Tables) -> DataFrame:
    """Nations that trade with each other, listed once with the smaller key first."""
    trade = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"))
        .filter("a < b")
    )
    return D.symmetric_edges(trade.distinct())


@query("J28_verify", """
  select indicator_id, place, period_label, published, tolerance, ok from (
    select o.indicator_id, o.place, o.period_label, floor(o.value * 100 + 0.5) / 100 as published, 0.004::double as tolerance,
           abs(o.value - floor(o.value * 100 + 0.5) / 100) <= 0.004 as ok
    from obs o where place = 'all'
    union all select distinct 'no-such-figure', place, period_label, 1.0, 0.5::double, false from obs where place = 'all')
""", "published")
def j28(t: Tables) -> DataFrame:
    obs = B.observations(t)
    national = obs.filter("place = 'all'")
    published = national.select(
        "indicator_id", "place", "period_label", (F.floor(F.col("value") * 100 + 0.5) / 100).alias("published"),
        F.lit(0.004).alias("tolerance"),
    )
    absent = national.select(
        F.lit("no-such-figure").alias("indicator_id"), "place", "period_label", F.lit(1.0).alias("published"),
        F.lit(0.5).alias("tolerance"),
    ).distinct()
    return D.verify(obs, published.unionByName(absent)).drop("value")


@query("J29_with_reference_series", """
  select place, indicator_id, period_label, value, reference from (
    select place, indicator_id, period_label, value,
           max(value) filter (where place = 'all') over (partition by indicator_id, period_label) as reference from obs)
  where place <> 'all'
""", "value reference")
def j29(t: Tables) -> DataFrame:
    obs = B.observations(t)
    rows = D.with_reference_series(obs.filter("place <> 'all'"), obs.filter("place = 'all'"))
    return rows.select("place", "indicator_id", "period_label", "value", "reference")


@query("J30_with_indicator", """
  select place, peer_group from nations where place in (select place from obs where indicator_id = 'price-per-unit')
""")
def j30(t: Tables) -> DataFrame:
    return D.with_indicator(B.ranked_places(t), B.observations(t), "price-per-unit")


# --- Windows over time -------------------------------------------------------------------------


@query("N3_yoy_growth", """
  select a.place, a.year, (a.value / b.value - 1) * 100 as growth from yearly a
  join yearly b on a.place = b.place and a.year = b.year + 1 where b.value > 0
""", "growth")
def n3(t: Tables) -> DataFrame:
    return D.yoy_growth(yearly(t), ["place"])


@query("N4_rolling_mean_consecutive", """
  select a.place, strftime(make_date(a.year::int, 1, 1), '%Y-%m-%d') as period_start, c.year || '' as last_label,
         a.year || ' to ' || c.year as period_label, (a.value + b.value + c.value) / 3 as value, c.year >= 2001 as is_provisional
  from yearly a join yearly b on b.place = a.place and b.year = a.year + 1
  join yearly c on c.place = a.place and c.year = a.year + 2
""", "value")
def n4(t: Tables) -> DataFrame:
    from statloom.functions.periods import calendar_year

    rows = yearly(t).select("place", "value", *calendar_year(F.col("year")).columns(), (F.col("year") >= 2001).alias("is_provisional"))
    rolled = D.rolling_mean_consecutive(rows, ["place"])
    return rolled.select(
        "place", "period_start", F.date_format("period_end", "yyyy").alias("last_label"), "period_label", "value", "is_provisional"
    )


@query("N5_round_change", """
  select place, year, from_year, (value - before) / before * 100 as change from (
    select place, year, value, (n_p > 0) as flagged, lag(year) over w as from_year, lag(value) over w as before,
           lag(n_p > 0) over w as flag_before from yearly window w as (partition by place order by year))
  where flagged = flag_before and from_year >= 1997 and (place not in (1, 2, 3) or from_year >= 1999)
""", "change")
def n5(t: Tables) -> DataFrame:
    rows = yearly(t).select("place", "year", "value", (F.col("n_p") > 0).alias("flagged"))
    return D.round_change(rows, 1997, [1, 2, 3], 1999)


@query("N6_first_wins", """
  select l_orderkey, l_returnflag, l_linenumber, l_quantity from lineitem
  qualify row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_quantity, l_partkey) = 1
""", "l_quantity")
def n6(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity", "l_partkey")
    first = D.first_wins(rows, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_quantity", "l_partkey"])
    return first.drop("l_partkey")


# --- Aggregations ------------------------------------------------------------------------------


@query("G1_component_ratio", """
  select place, year, num, den, least(num / den, 1) * 100 as value from (
    select place, year, sum(price) filter (where priority = '1-URGENT')::double as num,
           sum(price) filter (where priority = '2-HIGH')::double as den from sales group by 1, 2)
  where num is not null and den <> 0
""", "num den value")
def g1(t: Tables) -> DataFrame:
    rows = sales(t).withColumn("value", F.col("price"))
    sums = D.component_ratio(
        rows.groupBy("place", "year", "priority").agg(F.sum("value").cast("double").alias("value")),
        ["place", "year"], "priority", "1-URGENT", "2-HIGH",
    )
    return sums


@query("G2_preferred_mean", """
  select place, year, floor(avg(v) * 10 + 0.5) / 10 as value, count(*) as units from (
    select 'nation-' || lower(chr(65 + c_nationkey)) as place, year(o_orderdate) as year, o_custkey,
           coalesce(max(o_totalprice) filter (where o_orderstatus = 'F'), max(o_totalprice) filter (where o_orderstatus = 'P')) as v
    from orders join customer on o_custkey = c_custkey group by 1, 2, 3) where v is not null group by 1, 2
""", "value")
def g2(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = joined.select(
        nation_of("c_nationkey").alias("place"), F.year("o_orderdate").alias("year"), "o_custkey", "o_orderstatus",
        F.col("o_totalprice").alias("value"),
    )
    return D.preferred_mean(rows, ["place", "year"], "o_custkey", "o_orderstatus", ["F", "P"])


view("city_map", "select user_id as city, 'state-' || (user_id // 10) as state from (select distinct user_id from events) where user_id < 120")


def city_map(t: Tables) -> DataFrame:
    """Every reading place below 120 belongs to a state of ten."""
    cities = t.events.select(F.col("user_id").alias("city")).distinct().filter("city < 120")
    return cities.withColumn("state", F.concat(F.lit("state-"), F.floor(F.col("city") / 10).cast("string")))


@query("G3_daily_rollup", """
  with r as (select strftime(ts, '%Y-%m-%d') as day, user_id as city, cast(value as decimal(10,2)) as value from events),
  c as (select day, city, sum(value) as s, count(*) as n, max(value) as w from r group by 1, 2)
  select day, state as place, sum(s)::double / sum(n) as mean, sum(n)::bigint as readings,
         arg_max(city, w::double * 1e6 + city) as worst_city, max(w)::double as worst
  from c join city_map using (city) group by 1, 2
  union all select day, 'all', sum(s)::double / sum(n), sum(n)::bigint, arg_max(city, w::double * 1e6 + city), max(w)::double
  from c group by 1
""", "mean worst")
def g3(t: Tables) -> DataFrame:
    readings = t.events.select(
        F.to_date("ts").alias("day"), F.col("user_id").alias("city"), F.col("value").cast("decimal(10,2)").alias("value")
    )
    out = D.daily_rollup(readings, city_map(t), "all")
    return out.withColumn("mean", F.col("mean").cast("double")).withColumn("worst", F.col("worst").cast("double"))


@query("G4_annual_windows", """
  with q as (select place, year, quarter, count(*) as value from nation_sales group by 1, 2, 3
    union all select 'all', year, quarter, count(*) from nation_sales group by 2, 3),
  qs as (select distinct year, quarter from q),
  last4 as (select * from qs order by year desc, quarter desc limit 4),
  w as (select year, quarter, year || '' as "window", year as end_year from qs
        where year in (select year from qs group by 1 having count(*) = 4)
        union all select year, quarter, (select min(year * 10 + quarter) from last4) // 10 || 'Q' || (select min(year * 10 + quarter) from last4) % 10
          || '–' || (select max(year * 10 + quarter) from last4) // 10 || 'Q' || (select max(year * 10 + quarter) from last4) % 10,
          (select max(year) from last4) from last4
        where (select max(year * 10 + quarter) from last4) % 10 <> 4)
  select place, "window", sum(value)::bigint as total, sum(value)::double / (any_value(people) + any_value(end_year)) as per_person
  from q join w using (year, quarter) join population using (place) group by 1, 2
""", "per_person")
def g4(t: Tables) -> DataFrame:
    quarterly = nation_sales(t).groupBy("place", "year", "quarter").agg(F.count(F.lit(1)).alias("value"))
    years = F.explode(F.sequence(F.lit(1995), F.lit(2001)))
    people = B.people(t).withColumn("year", years).withColumn("people", F.col("people") + F.col("year"))
    return D.annual_windows(quarterly, people, "all")


@query("G5_mean_if_complete", """
  select place, year, (f + p) / 2 as value from (
    select place, year, sum(price) filter (where status = 'F')::double as f, sum(price) filter (where status = 'P')::double as p
    from sales group by 1, 2) where f is not null and p is not null
""", "value")
def g5(t: Tables) -> DataFrame:
    parts = sales(t).groupBy("place", "year", "status").agg(F.sum("price").cast("double").alias("value"))
    return D.mean_if_complete(parts, ["place", "year"], "status", ["F", "P"])


view("subject_scores", """
  select o_custkey as place, case o_orderstatus when 'F' then 3 when 'P' then 6 else 9 end as grade, o_orderpriority as subject,
         avg(o_totalprice / 1000) as local from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by 1, 2, 3
""")


@query("G6_mean_of_means", """
  with g as (select place, grade, floor(avg(local) * 10 + 0.5) / 10 as local, avg(grade * 10.0) as national
             from subject_scores group by 1, 2 having count(*) = case grade when 3 then 2 else 1 end),
  c as (select place from g group by 1 having count(*) = 3)
  select place, 'grade-' || grade as key, local as value from g join c using (place)
  union all select place, 'overall', floor(avg(local) * 10 + 0.5) / 10 from g join c using (place) group by 1
  union all select -1, 'grade-' || grade, national from g where place = (select max(place) from c)
  union all select -1, 'overall', floor(avg(national) * 10 + 0.5) / 10 from g where place = (select max(place) from c) having count(*) > 0
""", "value")
def g6(t: Tables) -> DataFrame:
    grade = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 6).otherwise(9)
    kept = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    rows = kept.groupBy(F.col("o_custkey").alias("place"), grade.alias("grade"), F.col("o_orderpriority").alias("subject")).agg(
        F.avg(F.col("o_totalprice") / 1000).alias("local")
    )
    rows = rows.withColumn("national", F.col("grade") * 10.0)
    return D.mean_of_means(rows, {3: 2, 6: 1, 9: 1}, -1)


@query("G7_mean_bodies", """
  with b as (select p_brand, p_name, avg(p_size::double) as v from part group by 1, 2)
  select p_brand, floor(avg(v) + 0.5)::bigint as value,
         case when count(*) > 1 then 'mean of ' || string_agg(p_name, ' and ' order by p_name) end as note from b group by 1
""")
def g7(t: Tables) -> DataFrame:
    return D.mean_bodies(t.part.withColumn("value", F.col("p_size").cast("double")), "p_brand", "p_name")


@query("G8_annualise", """
  select place, year, total, total * 12 / m as value from (
    select place, year, sum(price)::double as total, case when year = 2001 then 7 else 12 end as m from nation_sales
    where not (year = 2001 and month > 7) group by 1, 2)
""", "total value")
def g8(t: Tables) -> DataFrame:
    rows = nation_sales(t).filter("not (year = 2001 and month > 7)").withColumn("value", F.col("price").cast("decimal(18,2)"))
    months = F.when(F.col("year") == 2001, 7).otherwise(12)
    scaled = D.annualise(
        rows.groupBy("place", "year").agg(F.sum("value").cast("double").alias("value")), ["place", "year"], months
    )
    return scaled.select("place", "year", "total", "value")


@query("G9_ytd_growth", """
  select place, year, case when l > 0 then (t / l - 1) * 100 end as growth from (
    select a.place, a.year, a.v as t, b.v as l from
      (select place, year, sum(price)::double as v from nation_sales where month <= 7 group by 1, 2) a
      join (select place, year + 1 as year, sum(price)::double as v from nation_sales where month <= 7 group by 1, 2) b
      using (place, year))
""", "growth")
def g9(t: Tables) -> DataFrame:
    ytd = nation_sales(t).filter("month <= 7").groupBy("place", "year").agg(F.sum("price").cast("double").alias("v"))
    last = ytd.select("place", (F.col("year") + 1).alias("year"), F.col("v").alias("last"))
    return ytd.join(last, ["place", "year"]).select("place", "year", D.ytd_growth(F.col("v"), F.col("last")).alias("growth"))


@query("G10_vacancy", "select place, year, (n - n_p) * 100.0 / n as vacancy from yearly", "vacancy")
def g10(t: Tables) -> DataFrame:
    return yearly(t).select("place", "year", D.vacancy(F.col("n"), F.col("n_p")).alias("vacancy"))
