"""Registered queries of cleaning, periods, name resolution, validation and revision history."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import periods as P
from statloom.functions import text as X
from statloom.operators import cleaning as C
from statloom.operators import resolve as R
from statloom.operators import validate as V
from statloom.operators import vintage as N
from statloom.plans import bindings as B
from statloom.plans.registry import Tables, fingerprint_sql, query, view
from statloom.plans.scoring_queries import scores

# --- Cleaning ----------------------------------------------------------------------------------


@query("F1_match_all", """
  select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'
""", "o_totalprice")
def f1(t: Tables) -> DataFrame:
    rows = C.match_all(t.orders, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    return rows.select("o_orderkey", "o_totalprice")


def _cells(t: Tables) -> DataFrame:
    """Balances printed the way sources print numbers; the segment chooses the style."""
    text, seg = F.format_number("c_acctbal", 2), F.col("c_mktsegment")
    printed = (
        F.when(seg == "HOUSEHOLD", F.concat(text, F.lit("*"))).when(seg == "MACHINERY", F.concat(F.lit("("), text, F.lit(")")))
        .when(seg == "FURNITURE", F.lit("NA")).when(seg == "BUILDING", F.lit(" - ")).otherwise(text)
    )
    return t.customer.select("c_custkey", printed.alias("raw"))


@query("F2_clean_number", """
  select c_custkey, case when c_mktsegment not in ('FURNITURE', 'BUILDING', 'HOUSEHOLD') then c_acctbal end as value
  from customer
""", "value")
def f2(t: Tables) -> DataFrame:
    return _cells(t).select("c_custkey", X.clean_number(F.col("raw")).alias("value"))


@query("F3_number_and_flag", """
  select c_custkey, case when c_mktsegment not in ('FURNITURE', 'BUILDING', 'MACHINERY') then c_acctbal end as value,
         c_mktsegment = 'HOUSEHOLD' as flagged from customer
""", "value")
def f3(t: Tables) -> DataFrame:
    value, flagged = X.number_and_flag(F.col("raw"))
    return _cells(t).select("c_custkey", value.alias("value"), flagged.alias("flagged"))


@query("F4_normalize_name", r"""
  select doc_id, md5(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(regexp_replace(
    strip_accents(text), '[^\x00-\x7F]+', '', 'g')), '&', ' and '), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')),
    '^the ', '')) as digest from documents
""")
def f4(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.normalize_name(F.col("text"))).alias("digest"))


@query("F5_map_labels", """
  select p_partkey, 'small-parts' as indicator_id from part where p_type = 'SMALL'
  union all select p_partkey, 'promo-parts' from part where p_type = 'PROMO'
""")
def f5(t: Tables) -> DataFrame:
    label = F.concat(F.lit("Share of "), F.lower("p_type"), F.col("p_size").cast("string"), F.lit(" (%)"))
    rows = t.part.select("p_partkey", label.alias("label"))
    mapping = {"Share of small (%)": "small-parts", "Share of promo (%)": "promo-parts"}
    return C.map_labels(rows, "label", mapping).select("p_partkey", "indicator_id")


@query("F6_exclude_pairs", """
  select o_orderkey from orders where not (o_orderstatus = 'F' and o_orderpriority = '5-LOW')
    and not (o_orderstatus = 'P' and o_orderpriority = '2-HIGH')
""")
def f6(t: Tables) -> DataFrame:
    pairs = [("F", "5-LOW"), ("P", "2-HIGH")]
    return C.exclude_pairs(t.orders, ["o_orderstatus", "o_orderpriority"], pairs).select("o_orderkey")


@query("F7_guarded_relabel", """
  select case l_returnflag when 'A' then 'accepted' when 'N' then 'none' else 'returned' end as l_returnflag,
         count(*) as n from lineitem group by 1
  union all select 'unexpected labels in l_linestatus; not read', 0
""")
def f7(t: Tables) -> DataFrame:
    read, _ = C.guarded_relabel(t.lineitem, "l_returnflag", {"A": "accepted", "N": "none", "R": "returned"})
    none, problem = C.guarded_relabel(t.lineitem, "l_linestatus", {"F": "filled", "X": "extra"})
    counted = read.unionByName(none).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(problem.select(F.col("problem").alias("l_returnflag"), F.lit(0).cast("long").alias("n")))


@query("F8_parse_status", """
  select o_orderkey, year(o_orderdate) as start_year,
         case o_orderstatus when 'F' then 'A' when 'P' then 'RE' end as status,
         o_orderstatus = 'P' as is_provisional from orders where o_orderstatus <> 'O'
""")
def f8(t: Tables) -> DataFrame:
    """Column heads like '1997-98 (RE)': actuals and revised estimates are kept, budgets are not."""
    mark = F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "P", " (RE)").otherwise(" (BE)")
    label = F.concat(P.fiscal_label(F.year("o_orderdate")), mark)
    start, status = X.status_of(label)
    rows = t.orders.select("o_orderkey", start.alias("start_year"), status.alias("status"))
    return rows.filter(F.col("status").isin("A", "RE")).withColumn("is_provisional", F.col("status") == "RE")


@query("F9_recent_provisional", """
  select indicator_id, place, period_label, period_end >= date '2000-03-31' as is_provisional from obs
""")
def f9(t: Tables) -> DataFrame:
    rows = C.flag_recent_provisional(B.observations(t), B.TODAY)
    return rows.select("indicator_id", "place", "period_label", "is_provisional")


@query("F10_drop_sentinel", """
  select 'kept ' || l_linenumber as what, count(*) as n from lineitem where l_discount <> 0 group by 1
  union all select 'dropped', count(*) from lineitem where l_discount = 0
""")
def f10(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.lit("discount").alias("indicator_id"), F.col("l_orderkey").cast("string").alias("place"),
        F.col("l_linenumber").cast("string").alias("period_label"), F.col("l_discount").alias("value"),
    )
    kept, dropped = C.drop_sentinel(rows, "discount", 0.0)
    return (
        kept.groupBy(F.concat(F.lit("kept "), "period_label").alias("what")).agg(F.count(F.lit(1)).alias("n"))
        .unionByName(dropped.agg(F.lit("dropped").alias("what"), F.count("problem").alias("n")))
    )


@query("F11_clean_place_rows", """
  select name, count(*) as n from (
    select case when c_mktsegment = 'BUILDING' then 'All India' else 'Nation ' || chr(65 + c_nationkey) end as name
    from customer where c_mktsegment not in ('AUTOMOBILE', 'FURNITURE')) group by 1
""")
def f11(t: Tables) -> DataFrame:
    seg = F.col("c_mktsegment")
    nation = F.concat(F.lit("Nation "), B.letter(F.col("c_nationkey")))
    raw = (
        F.when(seg == "BUILDING", "Total").when(seg == "AUTOMOBILE", "Northern Region")
        .when(seg == "FURNITURE", F.concat(F.lit("Note: "), nation)).when(seg == "MACHINERY", F.concat(nation, F.lit(" **")))
        .otherwise(nation)
    )
    rows = C.clean_place_rows(t.customer.select(raw.alias("name")), "name")
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("F12_clean_body_name", "select s_suppkey, 'supplier town' as name from supplier")
def f12(t: Tables) -> DataFrame:
    raw = F.when(F.col("s_suppkey") < 50, F.concat("s_name", F.lit(" TOWN (M. Corp)"))).otherwise(
        F.concat(F.lit("Supplier"), F.col("s_suppkey").cast("string"), F.lit(" - Town_M"))
    )
    return t.supplier.select("s_suppkey", F.translate(X.clean_body_name(raw), "-", " ").alias("name"))


@query("F13_drop_footnoted", """
  select o_orderkey from orders where not (o_orderstatus = 'P' and year(o_orderdate) < 1998)
""")
def f13(t: Tables) -> DataFrame:
    name = F.when(F.col("o_orderstatus") == "P", "Somewhere *").otherwise("Somewhere")
    rows = t.orders.select("o_orderkey", name.alias("name"), F.year("o_orderdate").alias("year"))
    return C.drop_footnoted(rows, "name", "year", 1998).select("o_orderkey")


@query("F14_drop_partial_areas", """
  select n_name as name, count(*) as n from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey
  where not (n_name in ('NATION_1', 'NATION_7') and o_orderdate >= timestamp '1998-01-01') group by 1
  union all select n_name || ': part of a merged place only; skipped', 0 from nation
  where n_name in ('NATION_1', 'NATION_7')
""")
def f14(t: Tables) -> DataFrame:
    rows = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("name"), F.to_date("o_orderdate").alias("period_start"))
    )
    kept, reported = C.drop_partial_areas(rows, "name", ["nation_1", "Nation_7"], date(1998, 1, 1))
    return kept.groupBy("name").agg(F.count(F.lit(1)).alias("n")).unionByName(
        reported.select(F.col("problem").alias("name"), F.lit(0).cast("long").alias("n"))
    )


@query("F15_localized", """
  select n_nationkey, case when n_regionkey = 2 then n_name else 'राज्य ' || n_nationkey end as name from nation
""")
def f15(t: Tables) -> DataFrame:
    hindi = F.when(F.col("n_regionkey") != 2, F.concat(F.lit("राज्य "), F.col("n_nationkey").cast("string")))
    rows = t.nation.select("n_nationkey", F.col("n_name").alias("name"), hindi.alias("name_hi"))
    return C.localized(rows, "hi", ["name"])


@query("F16_where_optional", """
  select 'all' as what, count(*) as n from orders union all
  select 'urgent', count(*) from orders where o_orderpriority = '1-URGENT'
""")
def f16(t: Tables) -> DataFrame:
    parts = [("all", None), ("urgent", "1-URGENT")]
    frames = [
        C.where_optional(t.orders, "o_orderpriority", v).agg(F.lit(k).alias("what"), F.count(F.lit(1)).alias("n"))
        for k, v in parts
    ]
    return frames[0].unionByName(frames[1])


@query("F17_band_distribution", """
  select peer_group, count(*) filter (where score >= 100) as achiever,
         count(*) filter (where score >= 65 and score < 100) as "frontRunner",
         count(*) filter (where score >= 50 and score < 65) as performer,
         count(*) filter (where score < 50) as aspirant
  from scores join nations using (place) where level = 'composite' and key = 'trade-index' and edition = 2000
  group by 1
""")
def f17(t: Tables) -> DataFrame:
    rows = scores(t).filter("level = 'composite' and key = 'trade-index' and edition = 2000")
    return C.band_distribution(rows.join(B.ranked_places(t), "place"))


@query("F18_category_counts", """
  select strftime(ts, '%Y-%m-%d') as day, case when value <= 50 then 'good' when value <= 100 then 'satisfactory'
    when value <= 200 then 'moderate' when value <= 300 then 'poor' when value <= 400 then 'veryPoor'
    else 'severe' end as category, count(*) as n from events group by 1, 2
""")
def f18(t: Tables) -> DataFrame:
    return C.category_counts(t.events.select(F.to_date("ts").alias("day"), "value"))


@query("F19_rank_change", """
  select edition, place, key, rank_overall_prev - rank_overall as change from scores where level = 'pillar'
""")
def f19(t: Tables) -> DataFrame:
    change = C.rank_change(F.col("rank_overall"), F.col("rank_overall_prev"))
    return scores(t).filter("level = 'pillar'").select("edition", "place", "key", change.alias("change"))


@query("F20_filter_cities", """
  select slug, name from all_places where type = 'city' and parent = 'nation-c' and peer_group = 'million_plus'
""")
def f20(t: Tables) -> DataFrame:
    return C.filter_cities(B.places(t), "nation-c", True).select("slug", "name")


@query("F21_derive_slugs", """
  select p_partkey, case when p_name in (select p_name from part where p_type = 'PROMO')
    then replace(p_name, ' ', '-') || '-city' else replace(p_name, ' ', '-') end as slug from part
""")
def f21(t: Tables) -> DataFrame:
    taken = t.part.filter("p_type = 'PROMO'").select(F.translate("p_name", " ", "-").alias("slug"))
    return C.derive_slugs(t.part, "p_name", taken).select("p_partkey", "slug")


@query("F22_build_roster", """
  select lower(replace(c_name, '#', '-')) || case when c_mktsegment = 'FURNITURE' then '-old' else '' end as slug,
         replace(c_name, '#', ' ') as name, c_nationkey as parent, cast(c_acctbal * 100 as bigint) as population,
         c_mktsegment = 'BUILDING' as is_capital,
         case when c_mktsegment = 'HOUSEHOLD' and c_nationkey <> 3 then 99.0 else c_nationkey end as lat,
         c_nationkey * 2.0 as lon
  from customer where (cast(c_acctbal * 100 as bigint) >= 400000 or c_mktsegment = 'BUILDING') and c_nationkey <> 5
""", "lat lon")
def f22(t: Tables) -> DataFrame:
    """Customers as towns; names differ by letters only, since digits do not count in a name."""
    digits, letters = "0123456789", "abcdefghij"
    name = F.translate("c_name", "#", " ")
    coded = F.translate(name, digits, letters)
    base = t.customer.select(
        "c_mktsegment", coded.alias("name"), name.alias("shown"), F.col("c_nationkey").alias("parent"),
        F.floor(F.col("c_acctbal") * 100 + 1e-6).cast("bigint").alias("population"),
        F.col("c_nationkey").cast("double").alias("lat"), (F.col("c_nationkey") * 2.0).alias("lon"),
    )
    listed = base.select("name", "parent", "population", "lat", "lon")
    capitals = base.filter("c_mktsegment = 'BUILDING'").select("name", "parent")
    excluded = base.filter("parent = 5").select("name", "parent")
    renames = base.select("name", F.col("shown").alias("new_name")).filter("false")
    slug = F.translate("name", " ", "-")
    previous = base.filter("c_mktsegment = 'FURNITURE'").select(
        "name", "parent", F.concat(F.lower(slug), F.lit("-old")).alias("slug")
    )
    overrides = base.filter("c_mktsegment = 'HOUSEHOLD' and parent <> 3").select(
        F.lower(slug).alias("slug"), F.lit(99.0).alias("lat"), F.col("lon")
    )
    taken = t.nation.select(F.lower("n_name").alias("slug"))
    out = C.build_roster(listed, capitals, excluded, renames, previous, overrides, taken)

    def back(c: str):
        """Letters of the code back to digits, behind the word the name starts with."""
        return F.concat(F.substring(c, 1, 9), F.translate(F.substring(c, 10, 9), letters, digits), F.substring(c, 19, 9))

    return out.withColumn("slug", back("slug")).withColumn("name", back("name"))


# --- Periods -----------------------------------------------------------------------------------

view("months", "select distinct date_trunc('month', o_orderdate)::date as day from orders")


def _months(t: Tables) -> DataFrame:
    return t.orders.select(F.trunc(F.to_date("o_orderdate"), "month").alias("day")).distinct()


def _frame(df: DataFrame, kind: str, period: P.Period) -> DataFrame:
    return df.select("day", F.lit(kind).alias("kind"), *period.columns())


@query("D1_D2_D3_D4_periods", """
  select day, kind, strftime(s, '%Y-%m-%d') as period_start, strftime(e, '%Y-%m-%d') as period_end,
         label as period_label, type as period_type from (
    select strftime(day, '%Y-%m-%d') as day, u.* from (
      select day, year(day) as y, year(day) - (month(day) < 4)::int as fy, (month(day) + 8) % 12 // 3 + 1 as q
      from months), lateral (
      select 'year' as kind, make_date(y::int, 1, 1) as s, make_date(y::int, 12, 31) as e, y::varchar as label,
             'calendar_year' as type
      union all select 'fiscal', make_date(fy::int, 4, 1), make_date(fy::int + 1, 3, 31),
             fy || '-' || lpad(((fy + 1) % 100)::varchar, 2, '0'), 'fiscal_year'
      union all select 'quarter', date_trunc('quarter', day)::date,
             last_day(date_trunc('quarter', day)::date + interval 2 month),
             'Q' || q || ' ' || fy || '-' || lpad(((fy + 1) % 100)::varchar, 2, '0'), 'quarter'
      union all select 'month', day, last_day(day), strftime(day, '%b %Y'), 'month'
      union all select 'day', day, day, strftime(day, '%Y-%m-%d'), 'day') u)
""")
def d1(t: Tables) -> DataFrame:
    days = _months(t)
    day, fy = F.col("day"), P.fiscal_start_year(F.col("day"))
    quarter = F.floor((P.months_to_date(day) - 1) / 3) + 1
    parts = [
        ("year", P.calendar_year(F.year(day))), ("fiscal", P.fiscal_year(fy)),
        ("quarter", P.fiscal_quarter(fy, quarter)), ("month", P.month_period(day)), ("day", P.day_period(day)),
    ]
    out = None
    for kind, period in parts:
        part = _frame(days, kind, period)
        out = part if out is None else out.unionByName(part)
    return out


view("labelled", """
  select o_orderkey, o_orderdate::date as day, o_orderpriority as pr, year(o_orderdate) as y from orders
""")


def _labelled(t: Tables) -> DataFrame:
    day, y = F.to_date("o_orderdate"), F.year("o_orderdate")
    pr = F.col("o_orderpriority")
    label = (
        F.when(pr == "1-URGENT", P.fiscal_label(y)).when(pr == "2-HIGH", F.concat(F.lit("FY "), y, F.lit("-"), y + 1))
        .when(pr == "3-MEDIUM", F.concat(y.cast("string"), F.lit(" *"))).when(pr == "5-LOW", F.concat(y, F.lit("-"), y + 2))
        .otherwise(F.date_format(day, "MMMM, yyyy"))
    )
    return t.orders.select("o_orderkey", label.alias("label"))


@query("D5_parse_period", """
  select o_orderkey, strftime(case pr when '1-URGENT' then make_date(y::int, 4, 1) when '2-HIGH' then make_date(y::int, 4, 1)
           when '3-MEDIUM' then make_date(y::int, 1, 1) else date_trunc('month', day)::date end, '%Y-%m-%d') as period_start,
         case pr when '3-MEDIUM' then y::varchar when '4-NOT SPECIFIED' then strftime(day, '%b %Y')
           else y || '-' || lpad(((y + 1) % 100)::varchar, 2, '0') end as period_label from labelled where pr <> '5-LOW'
""")
def d5(t: Tables) -> DataFrame:
    good, _ = P.parse_period(_labelled(t), "label")
    return good.select("o_orderkey", "period_start", "period_label")


@query("D5_rejected_labels", """
  select 'unrecognised period label ''' || y || '-' || (y + 2) || '''' as problem, count(*) as n
  from labelled where pr = '5-LOW' group by 1
""")
def d5_rejected(t: Tables) -> DataFrame:
    _, bad = P.parse_period(_labelled(t), "label")
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("D6_D7_midpoint", """
  select l_orderkey, l_linenumber, strftime(s + ((e - s) // 2)::int, '%Y-%m-%d') as mid, e - s + 1 as days, e >= s as valid
  from (select l_orderkey, l_linenumber, o_orderdate::date as s, l_shipdate::date as e
        from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate)
""")
def d6(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", F.to_date("o_orderdate").alias("period_start"),
        F.to_date("l_shipdate").alias("period_end"), F.lit("multi_year").alias("period_type"),
    )
    s, e = F.col("period_start"), F.col("period_end")
    ok = rows.filter(P.valid_period(rows))
    return ok.select(
        "l_orderkey", "l_linenumber", P.midpoint(s, e).alias("mid"), P.days_in(s, e).alias("days"),
        P.valid_period(ok).alias("valid"),
    )


@query("D8_D9_D10_D11_spans", """
  select strftime(day, '%Y-%m-%d') as day, strftime(make_date(y::int, 8, 1), '%Y-%m-%d') as survey_start,
         strftime(make_date(y::int + 2, 12, 31), '%Y-%m-%d') as pooled_end,
         y || '-' || lpad(((y + 1) % 100)::varchar, 2, '0') as december_label,
         (y - 1) || '-' || lpad((y % 100)::varchar, 2, '0') as march_label,
         strftime(make_date(fy::int, 4, 1), '%Y-%m-%d') as ytd_start, strftime(last_day(day), '%Y-%m-%d') as ytd_end,
         'Apr–' || strftime(day, '%b %Y') || ' (FY ' || fy || '-' || lpad(((fy + 1) % 100)::varchar, 2, '0')
           || ' to date)' as ytd_label, (month(day) + 8) % 12 + 1 as months
  from (select day, year(day) as y, year(day) - (month(day) < 4)::int as fy from months)
""")
def d8(t: Tables) -> DataFrame:
    y, day = F.year("day"), F.col("day")
    pooled = F.concat(y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 2, F.lit(100)).cast("string"), 2, "0"))
    ytd = P.fiscal_to_date(F.last_day(day))
    return _months(t).select(
        "day", P.survey_year(y).start.alias("survey_start"), P.pooled_span(pooled).end.alias("pooled_end"),
        P.stock_year_to_fy(F.concat(y.cast("string"), F.lit("*"))).label.alias("december_label"),
        P.stock_year_to_fy(y.cast("string")).label.alias("march_label"),
        ytd.start.alias("ytd_start"), ytd.end.alias("ytd_end"), ytd.label.alias("ytd_label"),
        P.months_to_date(day).alias("months"),
    )


@query("D12_display_label", """
  select strftime(day, '%Y-%m-%d') as label, day(day) || ' ' || strftime(day, '%b %Y') as shown from months
  union all select strftime(day, '%b %Y'), strftime(day, '%b %Y') from months
""")
def d12(t: Tables) -> DataFrame:
    labels = F.explode(F.array(F.date_format("day", "yyyy-MM-dd"), P.month_label(F.col("day"))))
    rows = _months(t).select(labels.alias("label"))
    return rows.select("label", P.display_label(F.col("label")).alias("shown"))


# --- Name resolution ---------------------------------------------------------------------------


def aliases(t: Tables) -> DataFrame:
    """Other names of nations: one for all time, one until 1996 (region 1), one shared (region 2)."""
    nation = t.nation.withColumn("letter", B.letter(F.col("n_nationkey")))
    slug = F.concat(F.lit("nation-"), F.lower("letter")).alias("slug")
    none = F.lit(None).cast("date")
    always = nation.select(
        F.concat(F.lit("Land "), "letter", F.lit(" & Isles")).alias("alias"), slug,
        none.alias("period_from"), none.alias("period_to"),
    )
    former = nation.filter("n_regionkey = 1").select(
        F.concat(F.lit("Former "), "letter").alias("alias"), slug, none.alias("period_from"),
        F.lit(date(1996, 12, 31)).alias("period_to"),
    )
    shared = nation.filter("n_regionkey = 2").select(
        F.lit("Old Land").alias("alias"), slug, none.alias("period_from"), none.alias("period_to")
    )
    return always.unionByName(former).unionByName(shared)


def spelled(t: Tables) -> DataFrame:
    """(raw name, year, orders): how the order's priority and status spell its nation."""
    who = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("year"), B.letter(F.col("c_nationkey")).alias("x")
    )
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    raw = (
        F.when(pr == "1-URGENT", F.concat(F.lit("NATION "), "x"))
        .when(pr == "2-HIGH", F.concat(F.lit("The Nâtion "), "x", F.lit("* 12")))
        .when(pr == "3-MEDIUM", F.concat(F.lit("Land "), "x", F.lit(" & Isles")))
        .when(pr == "4-NOT SPECIFIED", F.concat(F.lit("former ("), "x", F.lit(")")))
        .when(st == "F", F.lit("Total (States)")).when(st == "P", F.lit("Old  Land")).otherwise(F.lit("Nowhere"))
    )
    counted = who.groupBy(raw.alias("raw"), "year").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("raw", "year", "n", *P.calendar_year(F.col("year")).columns())


view("spelled", """
  select raw, year, count(*) as n, any_value(letter) as letter, any_value(pr) as pr, any_value(st) as st,
         any_value(nk) as nk from (
    select case when o_orderpriority = '1-URGENT' then 'NATION ' || x
      when o_orderpriority = '2-HIGH' then 'The Nâtion ' || x || '* 12'
      when o_orderpriority = '3-MEDIUM' then 'Land ' || x || ' & Isles'
      when o_orderpriority = '4-NOT SPECIFIED' then 'former (' || x || ')'
      when o_orderstatus = 'F' then 'Total (States)' when o_orderstatus = 'P' then 'Old  Land' else 'Nowhere' end as raw,
      year, lower(x) as letter, o_orderpriority as pr, o_orderstatus as st, c_nationkey as nk
    from (select *, year(o_orderdate) as year, chr(65 + c_nationkey) as x from orders join customer on o_custkey = c_custkey))
  group by 1, 2
""")


def _resolution_sql(day: str) -> str:
    """Expected verdicts: written from the rules of the names above, not from the resolver."""
    return f"""
  select raw, year, n, case
      when pr in ('1-URGENT', '2-HIGH') then 'nation-' || letter
        || case when nk < 4 and {day} < date '1998-01-01' then '-undivided' else '' end
      when pr = '3-MEDIUM' and not (nk < 4 and {day} < date '1998-01-01') then 'nation-' || letter
      when pr = '4-NOT SPECIFIED' and nk % 5 = 1 and {day} <= date '1996-12-31'
        and not (nk < 4) then 'nation-' || letter end as place,
    case when pr in ('1-URGENT', '2-HIGH') then 'matched'
      when pr = '3-MEDIUM' then case when nk < 4 and {day} < date '1998-01-01' then 'out of validity' else 'matched' end
      when pr = '4-NOT SPECIFIED' then case when nk % 5 <> 1 then 'unknown'
        when {day} <= date '1996-12-31' and nk >= 4 then 'matched' else 'out of validity' end
      when st = 'F' then 'skipped' when st = 'P' then 'ambiguous' else 'unknown' end as resolution
  from spelled"""


def _names(t: Tables) -> DataFrame:
    return R.name_table(B.places(t), aliases(t))


@query("J1_resolve", _resolution_sql("make_date(year::int, 7, 2)"))
def j1(t: Tables) -> DataFrame:
    return R.resolve(spelled(t), _names(t), "raw").select("raw", "year", "n", "place", "resolution")


@query("J1_problems", f"""
  select distinct resolution || ' place name ''' || raw || '''' as problem
  from ({_resolution_sql("make_date(year::int, 7, 2)")}) where resolution not in ('matched', 'skipped')
""")
def j1_problems(t: Tables) -> DataFrame:
    return R.problems_of(R.resolve(spelled(t), _names(t), "raw"))


@query("J2_resolve_current_first", f"""
  select c.raw, c.year, c.n, coalesce(c.place, p.place) as place,
         case when p.resolution = 'matched' then 'matched' else c.resolution end as resolution
  from ({_resolution_sql("date '2001-08-01'")}) c join ({_resolution_sql("make_date(year::int, 7, 2)")}) p
  using (raw, year)
""")
def j2(t: Tables) -> DataFrame:
    rows = R.resolve_current_first(spelled(t), _names(t), "raw", B.TODAY)
    return rows.select("raw", "year", "n", "place", "resolution")


@query("J3_resolve_as_of", _resolution_sql("date '2001-08-01'"))
def j3(t: Tables) -> DataFrame:
    rows = R.resolve_as_of(spelled(t), _names(t), "raw", B.TODAY)
    return rows.select("raw", "year", "n", "place", "resolution")


@query("J4_resolve_with_repairs", """
  select c_custkey, case when c_mktsegment <> 'MACHINERY' then 'nation-' || lower(chr(65 + c_nationkey)) end as place
  from customer
""")
def j4(t: Tables) -> DataFrame:
    """Names broken by stray blanks; one segment's names are broken twice and stay unknown."""
    seg, x = F.col("c_mktsegment"), B.letter(F.col("c_nationkey"))
    raw = (
        F.when(seg == "HOUSEHOLD", F.concat(F.lit("Na tion "), x)).when(seg == "BUILDING", F.concat(F.lit("Natio n "), x))
        .when(seg == "MACHINERY", F.concat(F.lit("N at ion "), x)).otherwise(F.concat(F.lit("Nation "), x))
    )
    rows = t.customer.select("c_custkey", raw.alias("raw"), *P.calendar_year(F.lit(2000)).columns())
    return R.resolve_with_repairs(rows, _names(t), "raw").select("c_custkey", "place")


@query("J5_split_prefix", """
  select s_suppkey, case when s_acctbal >= 1000 then 'nation-' || lower(chr(65 + s_nationkey)) end as place,
         case when s_acctbal >= 1000 then s_name else 'Province of ' || s_name end as rest
  from supplier
""")
def j5(t: Tables) -> DataFrame:
    x, rich = B.letter(F.col("s_nationkey")), F.col("s_acctbal") >= 5000
    text = F.when(rich, F.concat(F.lit("LAND "), x, F.lit(" & ISLES "), "s_name")).when(
        F.col("s_acctbal") >= 1000, F.concat(F.lit("Nation "), x, F.lit(" "), "s_name")
    ).otherwise(F.concat(F.lit("Province of "), "s_name"))
    rows = R.split_prefix(t.supplier.withColumn("text", text), _names(t), "text", F.lit(B.TODAY))
    return rows.select("s_suppkey", "place", "rest")


@query("J6_lookup_or_problem", """
  select r_name as what, count(*) as n from customer join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey where r_name <> 'ASIA' group by 1
  union all select distinct 'nation ''' || c_nationkey || ''' is not mapped', 0
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'
""")
def j6(t: Tables) -> DataFrame:
    dim = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name <> 'ASIA'")
    dim = dim.select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    found, problems = R.lookup_or_problem(t.customer, dim, "c_nationkey", "nation")
    return found.groupBy(F.col("r_name").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        problems.select(F.col("problem").alias("what"), F.lit(0).cast("long").alias("n"))
    )


@query("J7_lookup_city", """
  with l as (select distinct p_brand as parent, p_name as key, p_brand || ' ' || p_name as city from part),
  one as (select key, min(city) as city from l group by 1 having count(distinct city) = 1),
  asked as (select ps.p_partkey, 'Brand#1' as parent, ps.p_name as key from part ps)
  select p_partkey, coalesce(l.city, one.city) as city from asked left join l using (parent, key)
  left join one using (key)
""")
def j7(t: Tables) -> DataFrame:
    lookup = t.part.select(
        F.col("p_brand").alias("parent"), F.col("p_name").alias("key"),
        F.concat_ws(" ", "p_brand", "p_name").alias("city"),
    ).distinct()
    asked = t.part.select("p_partkey", F.lit("Brand#1").alias("state"), "p_name")
    return R.lookup_city(asked, lookup, "state", "p_name").select("p_partkey", "city")


# --- Validation --------------------------------------------------------------------------------

view("bounds", """
  select indicator_id, 20.0 as valid_min, case when indicator_id like '%share' then 45.0 end as valid_max
  from (select distinct indicator_id from obs) where indicator_id not in ('orders-total', 'mean-tax', 'mean-discount')
""")
view("batch", """
  select * exclude (value), case when indicator_id = 'mean-quantity' and place = 'nation-b' then 'nan'::double
    else value end as value from obs
  union all select * exclude (value, run_id), value from obs_runs where run_id = 2 and place = 'all'
""")


def _batch(t: Tables) -> DataFrame:
    """This year's figures with the national rows delivered twice and one place unreadable."""
    rows = B.vintages(t).filter("run_id = 3 or (run_id = 2 and place = 'all')")
    broken = (F.col("indicator_id") == "mean-quantity") & (F.col("place") == "nation-b") & (F.col("run_id") == 3)
    return rows.withColumn("value", F.when(broken, F.lit(float("nan"))).otherwise(F.col("value"))).drop("run_id")


def _bounds(t: Tables) -> DataFrame:
    ids = [i for i, *_ in B.INDICATORS if i not in ("orders-total", "mean-tax", "mean-discount")]
    rows = [(i, 20.0, 45.0 if i.endswith("share") else None) for i in ids]
    return t.spark.createDataFrame(rows, "indicator_id string, valid_min double, valid_max double")


@query("V1_validate", """
  with k as (select b.*, u.valid_min, u.valid_max, u.indicator_id is not null as known
             from batch b left join bounds u using (indicator_id)),
  label as (select *, indicator_id || ' ' || place || ' ' || period_label as key from k)
  select 'hard' as severity, 'unknown indicator' as rule, indicator_id as key, count(*) as n from label where not known
    group by 3
  union all select 'hard', 'not a number', key, count(*) from label where known and isnan(value) group by 3
  union all select 'hard', 'below minimum', key, count(*) from label where known and not isnan(value)
    and value < valid_min group by 3
  union all select 'hard', 'above maximum', key, count(*) from label where known and not isnan(value)
    and value > valid_max group by 3
  union all select 'hard', 'duplicate', indicator_id || ' ' || place || ' ' || period_start || ' ' || period_end, 1
    from label where known and not isnan(value) group by indicator_id, place, period_start, period_end having count(*) > 1
""")
def v1(t: Tables) -> DataFrame:
    problems = V.validate(_batch(t), _bounds(t))
    return V.summary_counts(problems, ["severity", "rule", "key"])


@query("V2_coverage_notes", """
  select indicator_id, period_label, count(distinct place) as reported from obs where place <> 'all'
  group by 1, 2 having count(distinct place) < 0.8 * 25
""")
def v2(t: Tables) -> DataFrame:
    return V.coverage_notes(B.observations(t), B.places(t), 25)


@query("V3_check_reference", """
  select 'hard' as severity, 'order without a priced customer' as rule, cast(o_custkey as varchar) as key
  from (select distinct o_custkey from orders) where o_custkey not in (select c_custkey from customer where c_acctbal > 0)
  union all select 'hard', 'part name used twice', p_name from part group by p_name having count(*) > 1
""")
def v3(t: Tables) -> DataFrame:
    return V.check_reference(
        [("order without a priced customer", t.orders, "o_custkey", t.customer.filter("c_acctbal > 0"), "c_custkey")],
        [("part name used twice", t.part, ["p_name"])],
    )


@query("V4_check_shares", """
  with s as (select c_nationkey as nation, o_orderstatus as part, 100.0 * count(*) / sum(count(*)) over
    (partition by c_nationkey) as share from orders join customer on o_custkey = c_custkey group by 1, 2)
  select nation, 'all parts' as what, sum(share) as total from s group by 1 having abs(sum(share) - 100) <= 2
  union all select nation, 'two parts', sum(share) filter (where part in ('F', 'P')) from s group by 1
  having abs(sum(share) filter (where part in ('F', 'P')) - 100) > 2
""", "total")
def v4(t: Tables) -> DataFrame:
    counts = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("nation"), F.col("o_orderstatus").alias("part"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("nation").agg(F.sum("n").alias("all"))
    shares = counts.join(totals, "nation").withColumn("share", 100.0 * F.col("n") / F.col("all"))
    ok, _ = V.check_shares(shares, ["nation"], "part", "share", ["F", "O", "P"])
    _, off = V.check_shares(shares, ["nation"], "part", "share", ["F", "P"])
    return ok.select("nation", F.lit("all parts").alias("what"), "total").unionByName(
        off.select("nation", F.lit("two parts").alias("what"), "total")
    )


@query("V5_drop_spikes", """
  with y as (select o_custkey, year(o_orderdate) as year, sum(cast(o_totalprice as decimal(14,2)))::double as value
             from orders group by 1, 2)
  select a.o_custkey, a.year, a.value, b.value as before, c.value as after,
         coalesce(a.value > 2.5 * greatest(b.value, c.value) and b.value is not null and c.value is not null, false) as spike
  from y a left join y b on b.o_custkey = a.o_custkey and b.year = a.year - 1
  left join y c on c.o_custkey = a.o_custkey and c.year = a.year + 1
""", "value before after")
def v5(t: Tables) -> DataFrame:
    yearly = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("value")
    )
    return V.drop_spikes(yearly, ["o_custkey"], "year", "value")


@query("V6_shrink_guard", """
  select (select count(*) from orders where o_orderstatus = 'F') as new_rows, count(*) as old_rows,
         'smaller than the previous load' as refusal from orders
""")
def v6(t: Tables) -> DataFrame:
    return V.shrink_guard(t.orders.filter("o_orderstatus = 'F'"), t.orders)


@query("V7_summary_counts", "select p_brand, p_type, count(*) as n from part group by 1, 2")
def v7(t: Tables) -> DataFrame:
    return V.summary_counts(t.part, ["p_brand", "p_type"])


@query("V8_all_problems", """
  select distinct 'brand ' || p_brand as problem from part union select distinct 'type ' || p_type from part
""")
def v8(t: Tables) -> DataFrame:
    brands = t.part.select(F.concat(F.lit("brand "), "p_brand").alias("problem"))
    return V.all_problems(brands, t.part.select(F.concat(F.lit("type "), "p_type").alias("problem")), brands)


@query("X21_row_count_problems", """
  select p_brand, count(distinct p_name) as rows_read from part group by 1 having count(distinct p_name) < 46
  union all select 'Brand of ' || n_name, 0 from nation
""")
def x21(t: Tables) -> DataFrame:
    """All brands are expected, and one of each nation that no part has."""
    brands = t.part.select("p_brand").unionByName(t.nation.select(F.concat(F.lit("Brand of "), "n_name").alias("p_brand")))
    return V.row_count_problems(t.part, ["p_brand"], "p_name", 46, brands)


# --- Revision history --------------------------------------------------------------------------

view("stored", """
  select * from (
    select *, lag(value) over w as old, lag(is_provisional) over w as old_flag from obs_runs
    window w as (partition by indicator_id, place, period_start, period_end order by run_id))
  where old is null or abs(old - value) > 1e-9 or old_flag is distinct from is_provisional
""")


def stored(t: Tables) -> DataFrame:
    return N.stored_history(B.vintages(t))


view("latest", """
  select * from stored
  qualify row_number() over (partition by indicator_id, place, period_start, period_end order by run_id desc) = 1
""")
view("latest_before", """
  select * from stored where run_id <= 2
  qualify row_number() over (partition by indicator_id, place, period_start, period_end order by run_id desc) = 1
""")


@query("N1_latest_vintage", "select indicator_id, place, period_label, value from latest", "value")
def n1(t: Tables) -> DataFrame:
    return N.latest_vintage(stored(t)).select("indicator_id", "place", "period_label", "value")


@query("J18_detect_changes", """
  select indicator_id, place, period_label, case when old is null then 'new' when abs(old - value) > 1e-9 then 'revised' else 'unchanged' end as change
  from (
    select *, max(value) filter (where not incoming) over (partition by indicator_id, place, period_start) as old from (
      select true as incoming, indicator_id, place, period_start, period_label, value from obs
      union all select false, indicator_id, place, period_start, period_label, value from latest_before))
  where incoming
""")
def j18(t: Tables) -> DataFrame:
    latest = N.latest_vintage(stored(t).filter("run_id <= 2"))
    rows = N.detect_changes(B.observations(t), latest)
    return rows.select("indicator_id", "place", "period_label", "change")


@query("J19_unknown_places", """
  select distinct place from obs where place not in (select slug from all_places where type <> 'country')
""")
def j19(t: Tables) -> DataFrame:
    return N.unknown_places(B.observations(t), B.places(t).filter("type <> 'country'"))


@query("J21_revised_flag", """
  select run_id, indicator_id, place, period_label, old is not null as revised from stored
""")
def j21(t: Tables) -> DataFrame:
    return N.revised_flag(stored(t)).select("run_id", "indicator_id", "place", "period_label", "revised")


@query("G12_load_counts", """
  select count(*) as received, count(*) filter (where o.value is null) as new,
         count(*) filter (where abs(o.value - n.value) > 1e-9) as revised,
         count(*) filter (where abs(o.value - n.value) <= 1e-9) as unchanged
  from obs n left join latest_before o using (indicator_id, place, period_start)
""")
def g12(t: Tables) -> DataFrame:
    latest = N.latest_vintage(stored(t).filter("run_id <= 2"))
    return N.load_counts(N.detect_changes(B.observations(t), latest))


view("release_rows", """
  select run_id, count(*) as total, count(*) filter (where old is not null) as revised,
         list_sort(list(distinct indicator_id)) as indicators from stored group by 1
""")
view("release_labels", """
  select run_id, list(period_label order by ends desc, period_label desc)[1:6] as periods from (
    select run_id, period_label, max(period_end) as ends from stored group by 1, 2) group by 1
""")
view("releases_sql", """
  select run_id, total, revised, array_to_string(indicators, ',') as indicators, array_to_string(periods, ',') as periods,
    concat_ws(' and ', case when total > revised then format('{:,} new', total - revised) end,
      case when revised > 0 then format('{:,} revised', revised) end)
    || ' figures across ' || len(indicators) || case when len(indicators) = 1 then ' indicator' else ' indicators' end
    as summary
  from release_rows join release_labels using (run_id)
""")


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("indicators", F.array_join("indicators", ",")).withColumn("periods", F.array_join("periods", ","))


def load_runs(t: Tables) -> DataFrame:
    """The three loads, one of them with its event already recorded."""
    return stored(t).select("run_id").distinct().withColumn("status", F.lit("loaded"))


@query("G13_release_events", "select * from releases_sql")
def g13(t: Tables) -> DataFrame:
    return _flat(N.release_events(stored(t), load_runs(t)))


@query("J22_runs_without_event", "select distinct run_id, 'loaded' as status from stored where run_id <> 2")
def j22(t: Tables) -> DataFrame:
    runs = load_runs(t)
    return N.runs_without_event(runs, runs.filter("run_id = 2"))


@query("H7_backfill_releases", "select * from releases_sql where run_id <> 2")
def h7(t: Tables) -> DataFrame:
    runs = load_runs(t)
    return _flat(N.backfill_releases(stored(t), runs, runs.filter("run_id = 2")))


view("line_texts", """
  select l_orderkey, l_linenumber, cast(l_quantity as decimal(12,2)) as quantity, l_shipdate::date as day from lineitem
""")
_LINE = ["l_orderkey", "l_linenumber", "quantity", "day"]


@query("G14_fingerprint", fingerprint_sql("line_texts", _LINE))
def g14(t: Tables) -> DataFrame:
    """Digest of every line; the quantity as a decimal, which engines write alike."""
    quantity, day = F.col("l_quantity").cast("decimal(12,2)").alias("quantity"), F.col("l_shipdate").cast("date").alias("day")
    return N.fingerprint(t.lineitem.select("l_orderkey", "l_linenumber", quantity, day), _LINE)
