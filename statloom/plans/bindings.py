"""Binds the roles of the data model (places, observations, …) to the given tables.

Nations are the first-level places, regions their peer groups, order years the periods. Four
nations were split on 1 January 1998, so their names mean another place before that day.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import periods as P
from statloom.operators.scoring import IndexSpec, IndicatorSpec
from statloom.plans.registry import Tables, view

NATIONAL = "all"
COMPOSITE = "trade-index"
TODAY = date(2001, 8, 1)
GOALPOST_BASE = date(1996, 1, 1)
FIRST_EDITION = 1997
MIN_PILLARS = 4

# Indicator id, pillar, direction, target, log scale, formula over the yearly sums of a place.
INDICATORS = [
    ("mean-order-value", "trade", "higher_better", None, True, "cast(price as double) / n_orders"),
    ("orders-per-customer", "trade", "higher_better", None, False, "cast(n_orders as double) / people"),
    ("large-order-share", "trade", "higher_better", 60.0, False, "100.0 * cast(n_large as double) / n_orders"),
    ("urgent-share", "service", "lower_better", None, False, "100.0 * cast(n_urgent as double) / n_orders"),
    ("fulfilled-share", "service", "higher_better", None, False, "100.0 * cast(n_fulfilled as double) / n_orders"),
    ("pending-share", "service", "lower_better", 20.0, False, "100.0 * cast(n_pending as double) / n_orders"),
    ("mean-discount", "pricing", "lower_better", None, False, "100.0 * cast(discount as double) / n_lines"),
    ("mean-tax", "pricing", "lower_better", None, False, "100.0 * cast(tax as double) / n_lines"),
    (
        "price-per-unit", "pricing", "lower_better", None, True,
        "case when n_urgent * 5 > n_orders then cast(extended as double) / cast(quantity as double) end",
    ),
    ("mean-quantity", "volume", "higher_better", None, False, "cast(quantity as double) / n_lines"),
    ("lines-per-order", "volume", "higher_better", None, False, "cast(n_lines as double) / n_orders"),
    ("sales-per-customer", "volume", "higher_better", None, True, "cast(extended as double) / people"),
    ("return-share", "quality", "lower_better", None, False, "100.0 * cast(n_returned as double) / n_lines"),
    ("accepted-share", "quality", "higher_better", None, False, "100.0 * cast(n_accepted as double) / n_lines"),
    ("open-line-share", "quality", "lower_better", None, False, "100.0 * cast(n_open as double) / n_lines"),
    ("orders-total", None, "higher_better", None, False, "cast(n_orders as double)"),
    ("high-priority-share", None, "lower_better", None, False, "100.0 * cast(n_high as double) / n_orders"),
]
SPECS = [IndicatorSpec(i, p, d, t, 1.0, log) for i, p, d, t, log, _ in INDICATORS if i != "orders-total"]
INDICES = [
    IndexSpec("demand-index", "mean", {
        "Orders": ["mean-order-value", "orders-per-customer", "large-order-share"],
        "Lines": ["mean-quantity", "lines-per-order", "price-per-unit"],
    }),
    IndexSpec("care-index", "mean", {
        "Speed": ["urgent-share", "high-priority-share", "fulfilled-share"],
        "Returns": ["return-share", "open-line-share"],
        "Price": ["price-per-unit", "mean-tax", "mean-discount"],
    }),
    IndexSpec("human-index", "hdi", {
        "Health": ["fulfilled-share"],
        "Knowledge": ["return-share", "accepted-share"],
        "Income": ["mean-order-value"],
    }),
]
SUMS = [
    "n_orders", "price", "n_large", "n_urgent", "n_high", "n_fulfilled", "n_pending", "n_lines", "quantity",
    "discount", "tax", "extended", "n_returned", "n_accepted", "n_open",
]
# Knowledge cut-offs: what run 1, 2 and 3 of the yearly figures had seen.
RUN_CUTS = ["2000-07-01", "2001-01-01"]


def letter(key: Column) -> Column:
    return F.char((key + 65).cast("bigint"))


def places(t: Tables) -> DataFrame:
    """The national total, current and former first-level places, and customers as towns."""
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey",
        F.lower(letter(F.col("n_nationkey"))).alias("letter"),
        F.lower("r_name").alias("peer_group"),
    )
    split = F.col("n_nationkey") < 4
    name = F.concat(F.lit("Nation "), F.upper("letter"))
    none = F.lit(None)
    current = nation.select(
        F.concat(F.lit("nation-"), "letter").alias("slug"), name.alias("name"), F.lit("state").alias("type"),
        "peer_group", F.when(split, F.lit(date(1998, 1, 1))).alias("valid_from"),
        none.cast("date").alias("valid_to"), F.lit(NATIONAL).alias("parent"),
    )
    former = nation.filter(split).select(
        F.concat(F.lit("nation-"), "letter", F.lit("-undivided")).alias("slug"), name.alias("name"),
        F.lit("state").alias("type"), "peer_group", none.cast("date").alias("valid_from"),
        F.lit(date(1997, 12, 31)).alias("valid_to"), F.lit(NATIONAL).alias("parent"),
    )
    towns = t.customer.select(
        F.lower(F.translate("c_name", "#", "-")).alias("slug"),
        F.translate("c_name", "#", " ").alias("name"),
        F.lit("city").alias("type"),
        F.when(F.col("c_acctbal") >= 5000, "million_plus").otherwise("other").alias("peer_group"),
        none.cast("date").alias("valid_from"), none.cast("date").alias("valid_to"),
        F.concat(F.lit("nation-"), F.lower(letter(F.col("c_nationkey")))).alias("parent"),
    )
    total = t.spark.createDataFrame(
        [(NATIONAL, "All Nations", "country")], "slug string, name string, type string"
    )
    return (
        current.unionByName(former).unionByName(towns).unionByName(total, allowMissingColumns=True)
    )


def ranked_places(t: Tables) -> DataFrame:
    """(place, peer_group) of the current nations."""
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("nation-"), F.lower(letter(F.col("n_nationkey")))).alias("place"),
        F.lower("r_name").alias("peer_group"),
    )


def people(t: Tables) -> DataFrame:
    """Denominators: customers per nation and in total."""
    per = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("people"))
    place = F.concat(F.lit("nation-"), F.lower(letter(F.col("c_nationkey"))))
    per = per.select(F.explode(F.array(place, F.lit(NATIONAL))).alias("place"), "people")
    return per.groupBy("place").agg(F.sum("people").alias("people"))


def yearly_sums(t: Tables) -> DataFrame:
    """Sums per nation, order year and first run that knew the order; exact (decimals and counts).

    Lines are summed under the keys of their order at once: sums per order would fill a map of as many
    orders as a split holds. The orders of a partition are hashed, so that lines need no sort.
    """
    run = F.lit(1)
    for cut in RUN_CUTS:
        run = run + F.when(F.col("o_orderdate") >= F.lit(cut).cast("timestamp"), 1).otherwise(0)
    nations = t.customer.select("c_custkey", "c_nationkey")
    orders = t.orders.join(nations, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "c_nationkey",
        F.year("o_orderdate").alias("year"), run.alias("known_run"),
    )
    keys = ["c_nationkey", "year", "known_run"]
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    lines = t.lineitem.join(
        orders.select("o_orderkey", *keys).hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")
    ).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("quantity"),
        F.sum(F.col("l_discount").cast("decimal(6,2)")).alias("discount"),
        F.sum(F.col("l_tax").cast("decimal(6,2)")).alias("tax"),
        F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).alias("extended"),
        F.count_if(flag == "R").alias("n_returned"),
        F.count_if(flag == "A").alias("n_accepted"),
        F.count_if(status == "O").alias("n_open"),
    )
    priority, order_status = F.col("o_orderpriority"), F.col("o_orderstatus")
    sums = orders.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.col("o_totalprice").cast("decimal(14,2)")).alias("price"),
        F.count_if(F.col("o_totalprice") >= 250000).alias("n_large"),
        F.count_if(priority == "1-URGENT").alias("n_urgent"),
        F.count_if(priority.isin("1-URGENT", "2-HIGH")).alias("n_high"),
        F.count_if(order_status == "F").alias("n_fulfilled"),
        F.count_if(order_status == "P").alias("n_pending"),
    )
    # One row of each kind per key, at most: what the other kind lacks is NULL and adds nothing.
    return (
        sums.unionByName(lines, allowMissingColumns=True).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])
        .withColumn("place", F.concat(F.lit("nation-"), F.lower(letter(F.col("c_nationkey")))))
        .drop("c_nationkey")
    )


def _to_observations(t: Tables, sums: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the national totals, applies the formulas and turns columns into rows."""
    both = F.explode(F.array(F.col("place"), F.lit(NATIONAL)))
    whole = sums.withColumn("place", both).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])
    whole = whole.join(people(t), "place")
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("indicator_id"), F.expr(formula).alias("value"))
            for i, _, _, _, _, formula in INDICATORS
        ]
    )
    period = P.calendar_year(F.col("year"))
    rows = whole.withColumn("_pair", F.explode(pairs)).filter("_pair.value is not null")
    return rows.select(
        F.col("_pair.indicator_id").alias("indicator_id"), "place", *period.columns(),
        F.col("_pair.value").alias("value"), (F.col("year") >= 2001).alias("is_provisional"),
        *[k for k in keys if k not in ("place", "year")],
    )


def load_observations(t: Tables) -> DataFrame:
    """Latest yearly figures per nation and in total, straight from the orders."""
    return _to_observations(t, yearly_sums(t), ["place", "year"])


def observations(t: Tables) -> DataFrame:
    return t.stored("observations", load_observations)


def vintages(t: Tables) -> DataFrame:
    return t.stored("vintages", load_vintages)


def load_vintages(t: Tables) -> DataFrame:
    """The same figures as each of the three runs had them (run_id 1, 2, 3)."""
    runs = F.sequence(F.col("known_run"), F.lit(len(RUN_CUTS) + 1))
    sums = yearly_sums(t).withColumn("run_id", F.explode(runs))
    return _to_observations(t, sums, ["place", "year", "run_id"])


# --- The same bindings in SQL ------------------------------------------------------------------

view("nations", """
  select n_nationkey, lower(chr(65 + n_nationkey)) as letter, 'nation-' || lower(chr(65 + n_nationkey)) as place,
         lower(r_name) as peer_group
  from nation join region on n_regionkey = r_regionkey
""")
view("all_places", """
  select place as slug, 'Nation ' || upper(letter) as name, 'state' as type, peer_group,
         case when n_nationkey < 4 then date '1998-01-01' end as valid_from, cast(null as date) as valid_to,
         'all' as parent
  from nations
  union all
  select place || '-undivided', 'Nation ' || upper(letter), 'state', peer_group, null, date '1997-12-31', 'all'
  from nations where n_nationkey < 4
  union all
  select lower(replace(c_name, '#', '-')), replace(c_name, '#', ' '), 'city',
         case when c_acctbal >= 5000 then 'million_plus' else 'other' end, null, null,
         'nation-' || lower(chr(65 + c_nationkey))
  from customer
  union all select 'all', 'All Nations', 'country', null, null, null, null
""")
view("population", """
  select 'nation-' || lower(chr(65 + c_nationkey)) as place, count(*) as people from customer group by 1
  union all select 'all', count(*) from customer
""")
view("order_sums", """
  select 'nation-' || lower(chr(65 + c_nationkey)) as place, year(o_orderdate) as year,
         1 + (o_orderdate >= timestamp '2000-07-01')::int + (o_orderdate >= timestamp '2001-01-01')::int as known_run,
         count(*) as n_orders, sum(cast(o_totalprice as decimal(14,2))) as price,
         count(*) filter (where o_totalprice >= 250000) as n_large,
         count(*) filter (where o_orderpriority = '1-URGENT') as n_urgent,
         count(*) filter (where o_orderpriority in ('1-URGENT', '2-HIGH')) as n_high,
         count(*) filter (where o_orderstatus = 'F') as n_fulfilled,
         count(*) filter (where o_orderstatus = 'P') as n_pending,
         sum(n_lines) as n_lines, sum(quantity) as quantity, sum(discount) as discount, sum(tax) as tax,
         sum(extended) as extended, sum(n_returned) as n_returned, sum(n_accepted) as n_accepted,
         sum(n_open) as n_open
  from orders join customer on o_custkey = c_custkey
  left join (
    select l_orderkey, count(*) as n_lines, sum(cast(l_quantity as decimal(12,2))) as quantity,
           sum(cast(l_discount as decimal(6,2))) as discount, sum(cast(l_tax as decimal(6,2))) as tax,
           sum(cast(l_extendedprice as decimal(14,2))) as extended,
           count(*) filter (where l_returnflag = 'R') as n_returned,
           count(*) filter (where l_returnflag = 'A') as n_accepted,
           count(*) filter (where l_linestatus = 'O') as n_open
    from lineitem group by l_orderkey) on l_orderkey = o_orderkey
  group by 1, 2, 3
""", shared=True)
_SUM_LIST = ", ".join(f"sum({c}) as {c}" for c in SUMS)
view("run_sums", f"""
  select coalesce(place, 'all') as place, year, run_id, {_SUM_LIST}
  from order_sums join (select unnest([1, 2, 3]) as run_id) on run_id >= known_run
  group by grouping sets ((place, year, run_id), (year, run_id))
""", shared=True)
view("obs_runs", " union all ".join(
    f"""
  select '{i}' as indicator_id, place, make_date(year::int, 1, 1) as period_start,
         make_date(year::int, 12, 31) as period_end, cast(year as varchar) as period_label,
         'calendar_year' as period_type, {formula} as value, year >= 2001 as is_provisional, run_id
  from run_sums join population using (place) where ({formula}) is not null"""
    for i, _, _, _, _, formula in INDICATORS
))
view("obs", "select * exclude (run_id) from obs_runs where run_id = 3")
