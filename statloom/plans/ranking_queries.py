"""Registered queries that read the score and figure tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.text import normalize_name
from statloom.operators import derive as D
from statloom.operators import ranking as R
from statloom.operators.scoring import version_key
from statloom.plans import bindings as B
from statloom.plans.core_queries import _names, aliases, stored
from statloom.plans.registry import Tables, query, view
from statloom.plans.scoring_queries import SCORED, k3, scores
from statloom.sources import exports as E
from statloom.sources import reference as S

EDITION = 2000
PILLARS = ["pricing", "quality", "service", "trade", "volume"]

view("directions", "select * from (values " + ", ".join(
    f"('{i}', '{p or ''}', '{d}', {str(p is not None).lower()})" for i, p, d, *_ in B.INDICATORS
) + ") d(indicator_id, pillar, direction, rankable)")


def indicators(t: Tables) -> DataFrame:
    rows = [(i, i.replace("-", " "), p, d, p is not None, "orders" if p else None) for i, p, d, *_ in B.INDICATORS]
    return t.spark.createDataFrame(
        rows, "indicator_id string, name string, pillar string, direction string, rankable boolean, source string"
    )


@query("N2_latest_value", """
  select place, indicator_id, period_label, value from latest
  qualify row_number() over (partition by place, indicator_id order by period_end desc, period_start desc) = 1
""", "value")
def n2(t: Tables) -> DataFrame:
    return R.latest_value(B_latest(t)).select("place", "indicator_id", "period_label", "value")


def B_latest(t: Tables) -> DataFrame:
    from statloom.operators.vintage import latest_vintage

    return latest_vintage(stored(t))


@query("N9_most_improved", """
  select a.place, a.score, b.score as base, a.score - b.score as change from
    (select * from scores where edition = 2000 and key = 'trade-index' and place <> 'all') a
    join (select * from scores where edition = 1997 and key = 'trade-index') b using (place)
  where a.score is not null and b.score is not null order by change desc, place limit 5
""", "score base change")
def n9(t: Tables) -> DataFrame:
    return R.most_improved(scores(t), B.COMPOSITE, B.NATIONAL, EDITION)


@query("N10_leaders", """
  with r as (select peer_group, place, score, rank_peer from scores join nations using (place)
             where edition = 2000 and key = 'trade-index' and rank_peer is not null)
  select peer_group, place, score, rank_peer, 'top' as "end", row_number() over (partition by peer_group order by rank_peer, place) as position
  from r qualify position <= 2
  union all
  select peer_group, place, score, rank_peer, 'bottom', row_number() over (partition by peer_group order by rank_peer desc, place desc) as p
  from r where peer_group in (select peer_group from r group by 1 having count(*) > 4) qualify p <= 2
""", "score")
def n10(t: Tables) -> DataFrame:
    return R.leaders(scores(t), B.ranked_places(t), B.COMPOSITE, EDITION, k=2)


@query("N11_strengths", """
  with r as (select place, key as indicator_id, score from scores where edition = 2000 and level = 'indicator')
  select place, indicator_id, score, 'strength' as "end", row_number() over (partition by place order by score desc, indicator_id) as position
  from r qualify position <= 5
  union all select place, indicator_id, score, 'weakness', row_number() over (partition by place order by score, indicator_id desc) as p
  from r qualify p <= 5
""", "score")
def n11(t: Tables) -> DataFrame:
    return R.strengths(scores(t), EDITION)


@query("N12_index_leaders", """
  select key, place, score, rank_overall, row_number() over (partition by key order by rank_overall, place) as position
  from scores where edition = 2000 and key in ('demand-index', 'care-index', 'human-index') and rank_overall is not null
  qualify position <= 3
""", "score")
def n12(t: Tables) -> DataFrame:
    return R.index_leaders(scores(t), [x.id for x in B.INDICES], EDITION)


view("newest_figures", """
  select * from obs qualify row_number() over (partition by place, indicator_id order by period_end desc, period_start desc) = 1
""")


@query("N13_value_rank", """
  select indicator_id, place, period_label, value, rank() over (partition by indicator_id order by
    case when direction = 'lower_better' then -value else value end desc) as position
  from newest_figures join directions using (indicator_id) where place <> 'all'
""", "value")
def n13(t: Tables) -> DataFrame:
    latest = R.latest_value(B.observations(t)).select("indicator_id", "place", "period_label", "value")
    return R.value_rank(latest, indicators(t).select("indicator_id", "direction"), B.NATIONAL)


@query("N13_value_rank_customers", """
  select c_mktsegment as indicator_id, c_custkey::varchar as place, rank() over (partition by c_mktsegment order by c_acctbal) as position
  from customer
""")
def n13_customers(t: Tables) -> DataFrame:
    """Few groups with very many places each."""
    rows = t.customer.select(F.col("c_mktsegment").alias("indicator_id"), F.col("c_custkey").cast("string").alias("place"), F.col("c_acctbal").alias("value"))
    low = rows.select("indicator_id").distinct().withColumn("direction", F.lit("lower_better"))
    return R.value_rank(rows, low, "-").select("indicator_id", "place", "position")


@query("N14_trailing_mean", """
  with d as (select user_id as place, ts::date as day, sum(cast(value as decimal(10,2))) as s, count(*) as n from events group by 1, 2),
  l as (select place, max(day) as last from d group by 1)
  select place, strftime(last, '%Y-%m-%d') as latest_day, max(s / n) filter (where day = last) as latest,
         sum(s)::double / sum(n) as mean, count(*) as days from d join l using (place) where day >= last - 6
  group by 1, 2
""", "latest mean")
def n14(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("user_id").alias("place"), F.to_date("ts").alias("day"), F.col("value").cast("decimal(10,2)").alias("value")
    )
    out = R.trailing_mean(rows, days=7)
    return out.withColumn("latest", F.col("latest").cast("double")).withColumn("mean", F.col("mean").cast("double"))


HEADLINE = [i for i, *_ in reversed(B.INDICATORS)]
view("headline", "select * from (values " + ", ".join(f"('{h}', {i + 1})" for i, h in enumerate(HEADLINE)) + ") h(indicator_id, pos)")


@query("N15_trend_series", """
  with c as (select place, indicator_id, pos from obs join headline using (indicator_id) group by 1, 2, 3 having count(*) >= 3),
  s as (select *, row_number() over (partition by place order by pos) as chart from c qualify chart <= 9),
  r as (select *, row_number() over (partition by place, indicator_id order by period_end desc) as age from obs qualify age <= 5)
  select place, indicator_id, chart, period_label, strftime(period_end, '%Y-%m-%d') as period_end, value
  from r join s using (place, indicator_id)
""", "value")
def n15(t: Tables) -> DataFrame:
    return R.trend_series(B.observations(t), HEADLINE, periods=5)


@query("N16_score_history", """
  select edition, place, level, key, score from scores where place = 'nation-c' and level <> 'indicator' and score is not null
""", "score")
def n16(t: Tables) -> DataFrame:
    return R.score_history(scores(t), "nation-c")


@query("N17_best_of", """
  with r as (select indicator_id, period_label, place, value, case when direction = 'lower_better' then -value else value end as s
             from obs join directions using (indicator_id) where place <> 'all' and rankable),
  b as (select indicator_id, period_label, count(*) as n, max(s) as m, arg_max(place, s) as p from r group by 1, 2)
  select b.indicator_id, b.period_label, case when n >= 2 and ties = 1 then p end as best from b
  join (select r.indicator_id, r.period_label, count(*) as ties from r join b using (indicator_id, period_label)
        where r.s = b.m group by 1, 2) using (indicator_id, period_label)
""")
def n17(t: Tables) -> DataFrame:
    rows = B.observations(t).filter("place <> 'all'").join(indicators(t), "indicator_id")
    keyed = rows.withColumn("year", F.col("period_label"))
    return R.best_of(keyed, ["indicator_id", "year"]).withColumnRenamed("year", "period_label")


view("shown", """
  select n.place, n.indicator_id, s.score, coalesce(u.value, n.value) as value, coalesce(u.period_label, n.period_label) as period_label,
         coalesce(u.period_end, n.period_end) as period_end, coalesce(u.period_label <> n.period_label, false) as newer_exists
  from newest_figures n left join (select place, key, score, period_label from scores where edition = 2000 and level = 'indicator') s
    on s.place = n.place and s.key = n.indicator_id
  left join obs u on u.place = n.place and u.indicator_id = n.indicator_id and u.period_label = s.period_label
""")


@query("N18_scored_value", "select * replace (strftime(period_end, '%Y-%m-%d') as period_end) from shown", "score value")
def n18(t: Tables) -> DataFrame:
    return R.scored_value(scores(t), B.observations(t), EDITION)


@query("G17_data_year", """
  select place, year(list_sort(list(period_end))[count(*) // 2 + 1]) as data_year from shown where score is not null group by 1
""")
def g17(t: Tables) -> DataFrame:
    return R.data_year(R.scored_value(scores(t), B.observations(t), EDITION))


view("cuts_by_indicator", """
  select indicator_id, list_sort(list_distinct([l[least(n, n * i // 5 + 1)] for i in [1, 2, 3, 4]])) as breaks from (
    select indicator_id, list_sort(list(value)) as l, count(*) as n from newest_figures where place <> 'all' group by 1)
""")


@query("N19_class_breaks", """
  select indicator_id, place, value, len(breaks) as n_breaks, floor(len([c for c in breaks if value >= c]) * 4.0 / len(breaks) + 0.5)::bigint as step
  from newest_figures join cuts_by_indicator using (indicator_id) where place <> 'all'
""", "value")
def n19(t: Tables) -> DataFrame:
    latest = R.latest_value(B.observations(t)).filter("place <> 'all'").select("indicator_id", "place", "value")
    cuts = R.class_breaks(latest, ["indicator_id"], "value")
    step = R.map_class(F.col("value"), F.col("cuts"))
    return latest.join(cuts, "indicator_id").select(
        "indicator_id", "place", "value", F.size("cuts").alias("n_breaks"), step.alias("step")
    )


@query("N22_pillar_table", """
  select n.place, score, rank_overall as rank from nations n left join
    (select * from scores where edition = 2000 and key = 'quality') s using (place)
""", "score")
def n22(t: Tables) -> DataFrame:
    return R.pillar_table(scores(t), B.ranked_places(t), "quality", EDITION)


@query("N23_rankings", """
  select place, peer_group, max(score) filter (where key = 'trade-index') as score,
         max(rank_overall) filter (where key = 'trade-index') as rank, max(rank_peer) filter (where key = 'trade-index') as rank_peer,
""" + ", ".join(f"max(score) filter (where key = '{p}' and level = 'pillar') as {p}" for p in PILLARS) + """
  from scores join nations using (place) where edition = 2000 group by 1, 2
""", "score " + " ".join(PILLARS))
def n23(t: Tables) -> DataFrame:
    return R.rankings(scores(t), B.ranked_places(t), PILLARS, B.COMPOSITE, EDITION)


_CELLS = """
  with chosen_four as (select * from (values ('nation-f', 1), ('nation-c', 2), ('nation-y', 3)) c(place, slot)),
  cells as (
    select level as section, key, place, slot, score as value, 'higher_better' as direction, '' as period_label, true as rankable
    from scores join chosen_four using (place) where edition = 2000 and level <> 'indicator'
    union all
    select 'indicator', indicator_id, place, slot, value, direction, period_label, rankable
    from newest_figures join chosen_four using (place) join directions using (indicator_id)),
  called as (select *, case when direction = 'lower_better' then -value else value end as s from cells where value is not null and rankable),
  top as (select section, key, count(*) as n, max(s) as m, count(distinct period_label) as labels from called group by 1, 2),
  best as (select section, key, case when any_value(n) >= 2 and any_value(labels) = 1 and count(*) = 1 then min(place) end as best
           from called join top using (section, key) where s = m group by 1, 2)
"""


@query("N24_compare", _CELLS + """
  select section, key, max(value) filter (where slot = 1) as place_1, max(value) filter (where slot = 2) as place_2,
         max(value) filter (where slot = 3) as place_3, cast(null as double) as place_4, any_value(best) as best
  from cells left join best using (section, key) group by 1, 2
""", "place_1 place_2 place_3")
def n24(t: Tables) -> DataFrame:
    """Three known places asked for, one twice, and one nobody knows."""
    latest = R.latest_value(B.observations(t))
    slugs = ["nation-f,nowhere", "Nation-C", "nation-f", "nation-y"]
    return R.compare(scores(t), latest, indicators(t), B.ranked_places(t), slugs, EDITION)


@query("N25_series", """
  select indicator_id, place, period_label, value from obs where place = 'nation-b' and indicator_id = 'mean-quantity'
""", "value")
def n25(t: Tables) -> DataFrame:
    rows = R.series(B.observations(t), B.places(t), indicator="mean-quantity", place="nation-b", place_type="state")
    return rows.select("indicator_id", "place", "period_label", "value")


def releases(t: Tables) -> DataFrame:
    """Releases as the event stream has them: one dataset per user, purchases release something."""
    return t.events.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("dataset_id"), F.col("ts").alias("happened_at"), "event_id", "value"
    )


def dataset_titles(t: Tables) -> DataFrame:
    ids = t.events.select(F.col("user_id").alias("dataset_id")).distinct()
    return ids.withColumn("title", F.concat(F.lit("Dataset "), F.col("dataset_id").cast("string")))


@query("N26_latest_releases", """
  select user_id as dataset_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as happened_at, event_id, value from events
  where event_type = 'purchase' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1
  order by ts desc, event_id desc limit 6
""", "value")
def n26(t: Tables) -> DataFrame:
    return R.latest_releases(releases(t))


@query("G19_releases", """
  select dataset_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as happened_at, event_id, value, title,
         strftime(ts + interval 330 minute, '%Y-%m-%d') as local_day
  from (select user_id as dataset_id, ts, event_id, value, 'Dataset ' || user_id as title from events
        where event_type = 'purchase' order by ts desc, event_id desc limit 50)
""", "value")
def g19(t: Tables) -> DataFrame:
    return R.releases(releases(t), dataset_titles(t), 50)


@query("G19_release_days", """
  select strftime(ts + interval 330 minute, '%Y-%m-%d') as local_day, count(*) as n,
         array_to_string(list_sort(list(distinct title)), ', ') as titles
  from (select ts, 'Dataset ' || user_id as title from events where event_type = 'purchase' order by ts desc, event_id desc limit 50)
  group by 1
""")
def g19_days(t: Tables) -> DataFrame:
    return R.release_days(releases(t), dataset_titles(t), 50)


@query("G16_peer_stats", """
  select peer_group, level, key, count(score) as scored, avg(score) as mean from scores join nations using (place)
  where edition = 2000 and level <> 'indicator' group by 1, 2, 3
""", "mean")
def g16(t: Tables) -> DataFrame:
    return R.peer_stats(scores(t), B.ranked_places(t), EDITION)


@query("G18_latest_edition", "select max(edition)::bigint as edition from scores")
def g18(t: Tables) -> DataFrame:
    return R.latest_edition(scores(t))


@query("G20_indicator_table", """
  select n.place, f.value, f.period_label, (select count(*) from newest_figures where indicator_id = 'price-per-unit' and place <> 'all') as with_data,
         (select count(*) from nations) as places
  from nations n left join (select * from newest_figures where indicator_id = 'price-per-unit') f using (place)
""", "value")
def g20(t: Tables) -> DataFrame:
    return R.indicator_table(R.latest_value(B.observations(t)), B.ranked_places(t), "price-per-unit")


@query("G15_search_places", """
  select place as slug, array_to_string(list_sort(list_distinct(['land ' || letter || ' and isles'] ||
    case when n_nationkey % 5 = 1 then ['former ' || letter] else [] end || case when n_nationkey % 5 = 2 then ['old land'] else [] end)), ',') as aliases
  from nations
""")
def g15(t: Tables) -> DataFrame:
    current = B.places(t).filter("type = 'state' and valid_to is null").select("slug")
    found = aliases(t).groupBy("slug").agg(F.array_sort(F.collect_set(normalize_name(F.col("alias")))).alias("aliases"))
    joined = current.join(found, "slug", "left")
    empty = F.array().cast("array<string>")
    return joined.select("slug", F.array_join(F.coalesce("aliases", empty), ",").alias("aliases"))


@query("J25_goalposts_for", """
  select s.indicator_id, s.pillar, coalesce(o.worst, i.worst, c.worst) as worst, coalesce(o.best, i.best, c.best) as best
  from specs s left join (select * from stored_posts where version = '2.0') o using (indicator_id)
  left join (select * from stored_posts where version = '1.10') i using (indicator_id)
  left join posts c using (indicator_id) where s.pillar is not null
""", "worst best")
def j25(t: Tables) -> DataFrame:
    rows = k3(t).filter((F.col("version") == "2.0") & F.col("pillar").isNotNull())
    return rows.select("indicator_id", "pillar", "worst", "best").orderBy("pillar", "indicator_id")


@query("J23_catalogue", """
  select d.indicator_id, d.direction, nullif(pillar, '') as pillar, n from directions d
  left join (select indicator_id, count(*) as n from obs group by 1) using (indicator_id)
""")
def j23(t: Tables) -> DataFrame:
    base = indicators(t)
    pillars = base.select("indicator_id", "pillar").filter("pillar is not null")
    counts = B.observations(t).groupBy("indicator_id").agg(F.count(F.lit(1)).alias("n"))
    rows = E.catalogue(base.select("indicator_id", "direction"), pillars)
    return rows.join(counts, "indicator_id", "left").select("indicator_id", "direction", "pillar", "n")


@query("J27_renamed_slug", """
  select distinct 'former ' || letter as name, place as slug from nations where n_nationkey % 5 = 1
  union all select distinct 'Land ' || upper(letter) || ' & Isles', place from nations
""")
def j27(t: Tables) -> DataFrame:
    """Old and alternate names, whenever they were in use, to the place of today."""
    from statloom.operators.resolve import resolve_on

    names = aliases(t).select("alias").distinct().withColumn("name", F.lower("alias"))
    names = names.select(F.when(F.col("alias").startswith("Land"), F.col("alias")).otherwise(F.col("name")).alias("name"))
    now = _names_any_time(t)
    found = resolve_on(names, now, "name", [F.lit(B.TODAY)])
    return found.filter("place is not null").select("name", F.col("place").alias("slug"))


def _names_any_time(t: Tables) -> DataFrame:
    from statloom.operators.resolve import name_table

    none = F.lit(None).cast("date")
    timeless = aliases(t).withColumn("period_from", none).withColumn("period_to", none)
    current = B.places(t).filter("type in ('state', 'ut', 'country') and valid_to is null")
    return name_table(current.withColumn("valid_from", none), timeless)


# --- Exports and documents ----------------------------------------------------------------------

_EXPORT = """
  select n.indicator_id, replace(n.indicator_id, '-', ' ') as indicator_name, n.place, p.name as place_name, q.name as parent_name,
         n.period_label as period, strftime(n.period_start, '%Y-%m-%d') as period_start, strftime(n.period_end, '%Y-%m-%d') as period_end,
         n.value, n.is_provisional as provisional, case when d.pillar <> '' then 'orders' end as source
  from latest n join all_places p on p.slug = n.place left join all_places q on q.slug = p.parent
  join directions d using (indicator_id)
"""


@query("S9_J24_export_latest", _EXPORT, "value")
def s9(t: Tables) -> DataFrame:
    return E.export_latest(B_latest(t), B.places(t), indicators(t))


@query("S9_export_indicator", _EXPORT + " where n.indicator_id = 'mean-tax'", "value")
def s9_one(t: Tables) -> DataFrame:
    return E.export_latest(B_latest(t), B.places(t), indicators(t), "mean-tax")


@query("S10_export_catalogue", """
  select indicator_id, pillar as category_id, case when rankable then 'orders' end as dataset_id, upper(pillar) as category,
         case when rankable then 'Order book' end as source, n from directions join
    (select indicator_id, count(*) as n from obs group by 1) using (indicator_id) where pillar <> ''
  union all select indicator_id, null, null, null, null, n from directions join
    (select indicator_id, count(*) as n from obs group by 1) using (indicator_id) where pillar = ''
""")
def s10(t: Tables) -> DataFrame:
    counts = B.observations(t).groupBy("indicator_id").agg(F.count(F.lit(1)).alias("n"))
    rows = indicators(t).select("indicator_id", F.col("pillar").alias("category_id"), F.col("source").alias("dataset_id"))
    categories = t.spark.createDataFrame([(p, p.upper()) for p in PILLARS], "category_id string, category string")
    sources = t.spark.createDataFrame([("orders", "Order book")], "dataset_id string, source string")
    return E.export_catalogue(rows.join(counts, "indicator_id"), categories, sources)


@query("S11_csv_columns", "select indicator_id, place, period_label, case when is_provisional then 'yes' else 'no' end as is_provisional from obs")
def s11(t: Tables) -> DataFrame:
    """Written as CSV and read back, so that quoting and flags are those of the file."""
    from statloom.session import fresh_path

    path = fresh_path(t.spark, "csv")
    E.write_csv(B.observations(t).select("indicator_id", "place", "period_label", "is_provisional"), path)
    return t.spark.read.schema("indicator_id string, place string, period_label string, is_provisional string").option(
        "header", True
    ).csv(path)


@query("S12_rankings_document", """
  select place, max(rank_overall) filter (where key = 'trade-index') as rank, max(score) filter (where key = 'trade-index') as score,
         max(rank_overall_prev) filter (where key = 'trade-index') as rank_previous, count(*) filter (where level = 'pillar') as pillars,
         max(score) filter (where key = 'quality') as quality
  from scores where edition = 2000 and level <> 'indicator' group by 1
""", "score quality")
def s12(t: Tables) -> DataFrame:
    docs = E.rankings_document(scores(t), B.COMPOSITE, EDITION)
    return docs.select(
        "place", "composite.rank", "composite.score", "composite.rank_previous", F.size("pillars").alias("pillars"),
        F.col("pillars")["quality"]["score"].alias("quality"),
    )


@query("S13_place_document", """
  select n.place, 'Nation ' || upper(letter) as name, s.rank_overall as rank, count(*) as figures, sum(o.value) as total,
         min(o.period_label) as first_label
  from nations n join (select * from scores where edition = 2000 and key = 'trade-index') s using (place)
  join obs o using (place) group by 1, 2, 3
""", "total")
def s13(t: Tables) -> DataFrame:
    current = B.places(t).filter("type = 'state' and valid_to is null")
    rankings = E.rankings_document(scores(t), B.COMPOSITE, EDITION)
    docs = E.place_document(current, rankings, B.observations(t))
    total = F.aggregate("observations", F.lit(0.0), lambda acc, o: acc + o["value"])
    return docs.select(
        "place", "name", F.col("composite.rank").alias("rank"), F.size("observations").alias("figures"), total.alias("total"),
        F.array_min(F.transform("observations", lambda o: o["period_label"])).alias("first_label"),
    )


@query("S14_indicator_document", """
  select indicator_id, direction, count(*) as figures, sum(value) as total from obs join directions using (indicator_id) group by 1, 2
""", "total")
def s14(t: Tables) -> DataFrame:
    docs = E.indicator_document(indicators(t).select("indicator_id", "direction"), B.observations(t), parts=64)
    sums = docs.select(
        "indicator_id", "direction", F.size("observations").alias("figures"),
        F.aggregate("observations", F.lit(0.0), lambda acc, o: acc + o["value"]).alias("total"),
    )
    return sums.groupBy("indicator_id", "direction").agg(F.sum("figures").alias("figures"), F.sum("total").alias("total"))


@query("S16_places_listing", """
  select slug, name, type, case when type = 'state' then peer_group end as peer_group, case when type = 'city' then parent end as state,
         case when type = 'city' then peer_group = 'million_plus' end as million_plus
  from all_places where type in ('state', 'city') and valid_to is null
""")
def s16(t: Tables) -> DataFrame:
    return E.places_listing(B.places(t))


# --- Sources ------------------------------------------------------------------------------------


@query("S1_read_reference", "select n_nationkey as id, case when n_regionkey <> 1 then n_name end as name, n_regionkey as region from nation")
def s1(t: Tables) -> DataFrame:
    """The nations written as a reference CSV with empty fields, and read with a fixed schema."""
    from statloom.session import fresh_path

    path = fresh_path(t.spark, "reference")
    rows = t.nation.select(
        F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("name"), F.col("n_regionkey").alias("region")
    )
    E.write_csv(rows, path)
    return S.read_reference(t.spark, path, "id int, name string, region int")


@query("S2_roster_to_places", """
  select 'city-' || c_custkey as slug, c_name as name, 'city' as type,
         case when c_acctbal * 200 >= 1000000 then 'million_plus' else 'other' end as peer_group, c_nationkey::varchar as parent,
         case when c_mktsegment <> 'BUILDING' then 'id-' || c_custkey end as external_id from customer
  union all select n_nationkey::varchar, n_name, 'state', null, null, 'n-' || n_nationkey from nation
""")
def s2(t: Tables) -> DataFrame:
    external = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("n-"), F.col("c_nationkey").cast("string"))).otherwise(
        F.concat(F.lit("id-"), F.col("c_custkey").cast("string"))
    )
    cities = t.customer.select(
        F.concat(F.lit("city-"), F.col("c_custkey").cast("string")).alias("slug"), F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("string").alias("parent"), (F.col("c_acctbal") * 200).alias("population"), external.alias("external_id"),
    )
    states = t.nation.select(
        F.col("n_nationkey").cast("string").alias("slug"), F.col("n_name").alias("name"), F.lit("state").alias("type"),
        F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("external_id"),
    )
    return S.roster_to_places(cities, states).select("slug", "name", "type", "peer_group", "parent", "external_id")


@query("S3_build_lookup", """
  with c as (select p_partkey, p_brand as parent, p_name, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from part),
  k as (select parent, a || ' ' || b as key, 0 as found_by, p_partkey from c union all select parent, a, 1, p_partkey from c
        union all select parent, b, 2, p_partkey from c union all select parent, 'old ' || a, 3, p_partkey from c)
  select parent, key, min(found_by)::bigint as found_by from k group by 1, 2
""")
def s3(t: Tables) -> DataFrame:
    """Parts as twin cities "red-bolt": found by the whole name, by either half, or by a former name."""
    words = F.split("p_name", " ")
    cities = t.part.select(
        F.col("p_partkey").alias("slug"), F.col("p_brand").alias("parent"), F.translate("p_name", " ", "-").alias("name"),
        F.when(F.col("p_size") > 100, F.col("p_name")).alias("other"),
    )
    renames = t.part.select(F.col("p_partkey").alias("slug"), F.concat(F.lit("Old "), words[0]).alias("former"))
    found = S.build_lookup(cities, ["name", "other"], renames)
    owner = t.part.select(F.col("p_partkey").alias("city"), words[0].alias("a"), words[1].alias("b"))
    key = F.col("key")
    at = (
        F.when(key == F.concat_ws(" ", "a", "b"), 0).when(key == F.col("a"), 1).when(key == F.col("b"), 2).otherwise(3)
    )
    return found.join(owner, "city").select("parent", "key", at.cast("bigint").alias("found_by"))


@query("S4_read_paged", "select 'nation-' || c_nationkey as source, count(*) as records, sum(c_custkey)::bigint as total from customer group by 1")
def s4(t: Tables) -> DataFrame:
    """Customers landed as JSON pages of their nation (a page per 5,000 keys), and read back."""
    from pyspark.sql import Window

    from statloom.session import fresh_path

    keyed = t.customer.withColumn("block", F.floor(F.col("c_custkey") / 5000))
    pages = keyed.groupBy("c_nationkey", "block").agg(F.collect_list(F.create_map(F.lit("key"), F.col("c_custkey").cast("string"))).alias("data"))
    source = Window.partitionBy("c_nationkey")  # numbers of blocks only; the pages themselves meet no window
    numbers = keyed.select("c_nationkey", "block").distinct().select(
        "c_nationkey", "block", F.row_number().over(source.orderBy("block")).alias("page"), F.count(F.lit(1)).over(source).alias("totalPages")
    )
    landed = pages.join(numbers, ["c_nationkey", "block"]).select(
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("source"), "page", "totalPages", "data"
    )
    path = fresh_path(t.spark, "pages")
    landed.write.json(path)
    rows = S.read_paged(t.spark, path)
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.col("record")["key"].cast("bigint")).alias("total")
    )


@query("S17_sum_nested", """
  select o_custkey as place, count(*) filter (where o_orderstatus = 'F') * 10 + count(*) filter (where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')
    as total from orders group by 1
""")
def s17(t: Tables) -> DataFrame:
    """Nested metrics per order: only those of type TOTAL count."""
    kind = F.when(F.col("o_orderstatus") == "F", "TOTAL").otherwise("PART")
    metrics = F.array(
        F.struct(kind.alias("type"), F.lit(10).alias("count")),
        F.struct(kind.alias("type"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("count")),
    )
    rows = t.orders.select(F.col("o_custkey").alias("place"), metrics.alias("metric"))
    return rows.withColumn("n", S.sum_nested(rows, "metric", "TOTAL")).groupBy("place").agg(F.sum("n").alias("total"))


@query("S5_append_vintage", "select run_id, count(*) as rows, sum(value) as total from stored group by 1", "total")
def s5(t: Tables) -> DataFrame:
    """Three loads appended to one history, each compared with what is there."""
    from statloom.operators.vintage import KEY, detect_changes, latest_vintage
    from statloom.session import fresh_path

    path = fresh_path(t.spark, "history")
    runs = B.vintages(t)
    first = runs.filter("run_id = 1").withColumn("change", F.lit("new"))
    E.append_vintage(first, path)
    for run in (2, 3):
        latest = latest_vintage(t.spark.read.parquet(path).select(*KEY, "value", "is_provisional", "run_id"))
        E.append_vintage(detect_changes(runs.filter(F.col("run_id") == run), latest), path)
    return t.spark.read.parquet(path).groupBy(F.col("run_id").cast("bigint").alias("run_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")
    )


@query("S6_write_scores", """
  select '1.0' as methodology_version, edition, count(*) as n from scores where level = 'pillar' group by 2
  union all select '1.1', edition, count(*) from scores where level = 'composite' and edition <> 1997 group by 2
  union all select '1.1', 1997, count(*) from scores where level = 'pillar' and edition = 1997
""")
def s6(t: Tables) -> DataFrame:
    """Version 1.1 is written twice; the second time replaces the editions it has and no other."""
    from statloom.session import fresh_path

    path = fresh_path(t.spark, "score-table")
    table = scores(t)
    old = table.filter("level = 'pillar'")
    E.write_scores(old.withColumn("methodology_version", F.lit("1.0")), path)
    E.write_scores(old.withColumn("methodology_version", F.lit("1.1")), path)
    new = table.filter("level = 'composite' and edition <> 1997")
    E.write_scores(new.withColumn("methodology_version", F.lit("1.1")), path)
    back = t.spark.read.option("basePath", path).parquet(path)
    return back.groupBy(F.col("methodology_version").cast("string").alias("methodology_version"), "edition").agg(F.count(F.lit(1)).alias("n"))


@query("S7_upsert", """
  select c_custkey as id, case when c_mktsegment = 'BUILDING' then 'new' else 'old' end as state from customer
  union all select -s_suppkey - 1, 'new' from supplier
""")
def s7(t: Tables) -> DataFrame:
    target = t.customer.select(F.col("c_custkey").alias("id"), F.lit("old").alias("state"))
    incoming = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.lit("new").alias("state"))
    incoming = incoming.unionByName(t.supplier.select((-F.col("s_suppkey") - 1).alias("id"), F.lit("new").alias("state")))
    return E.upsert(target, incoming, ["id"])


@query("S8_upsert_status", """
  select c_custkey as id, case when c_nationkey between 10 and 12 then 'paused' when c_mktsegment = 'BUILDING' then 'broken'
    when c_mktsegment = 'FURNITURE' and c_nationkey >= 5 then 'paused' else 'active' end as status from customer
""")
def s8(t: Tables) -> DataFrame:
    seg = F.col("c_mktsegment")
    status = F.when(seg == "BUILDING", "broken").when(seg == "FURNITURE", "paused").otherwise("active")
    target = t.customer.select(F.col("c_custkey").alias("id"), status.alias("status"))
    pausing = F.col("c_nationkey").between(10, 12)
    incoming = t.customer.filter((F.col("c_nationkey") < 5) | pausing).select(
        F.col("c_custkey").alias("id"), F.when(pausing, "paused").otherwise("active").alias("status")
    )
    return E.upsert_status(target, incoming, "id")
