"""Registered queries of the streaming jobs; each runs its stream to the end and reads the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.vintage import latest_vintage
from statloom.plans import bindings as B
from statloom.plans.registry import Tables, query, view
from statloom.session import fresh_path, numbered
from statloom.streaming import jobs as J


def readings(t: Tables) -> DataFrame:
    """The event table as a stream of readings."""
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events*.parquet")
    return stream.select(
        "event_id", F.col("user_id").alias("place"), F.col("ts").cast("timestamp").alias("observed_at"),
        F.col("value").cast("decimal(10,2)").alias("value"),
    )


def _through(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    path = fresh_path(t.spark, name)
    J.run_available(stream, f"{path}-checkpoint", path=path)
    return t.spark.read.schema(stream.schema).parquet(path)


@query("ST1_daily_means", """
  select user_id as place, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as day, sum(cast(value as decimal(10,2)))::double / count(*) as mean, count(*) as readings
  from events group by 1, 2, date_trunc('day', ts)
  having date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 1 day
""", "mean")
def st1(t: Tables) -> DataFrame:
    stream = readings(t).withColumn("value", F.col("value").cast("double"))
    return _through(t, J.daily_means(stream), "daily")


@query("ST5_sliding_means", """
  with d as (select user_id as place, date_trunc('day', ts)::date as day, sum(cast(value as decimal(10,2))) as s, count(*) as n from events group by 1, 2),
  e as (select unnest(generate_series(date '2024-01-02', date '2024-02-10', interval 1 day))::date as until)
  select place, strftime(until, '%Y-%m-%d %H:%M:%S') as until, sum(s)::double / sum(n) as mean, sum(n)::bigint as readings
  from d join e on day < until and day >= until - 7
  where until <= (select max(ts) from events) - interval 1 day group by 1, 2
""", "mean")
def st5(t: Tables) -> DataFrame:
    stream = J.sliding_means(readings(t), days=7)
    out = _through(t, stream, "sliding")
    return out.withColumn("mean", F.col("mean").cast("double"))


def _landed_twice(t: Tables) -> DataFrame:
    """All events, and the last seven days once more, as a daily job that re-reads a week lands them."""
    path = fresh_path(t.spark, "landed")
    t.events.write.parquet(f"{path}/run=1")
    last = t.events.agg(F.max("ts")).scalar()
    t.events.filter(F.col("ts") >= last - F.expr("interval 7 days")).write.parquet(f"{path}/run=2")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{path}/run=*")
    return stream.withColumn("observed_at", F.col("ts").cast("timestamp"))


@query("ST4_deduplicated", "select strftime(ts, '%Y-%m-%d') as day, count(*) as readings from events group by 1")
def st4(t: Tables) -> DataFrame:
    stream = J.deduplicated(_landed_twice(t), "event_id", "40 days")
    out = _through(t, stream, "unique")
    return out.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("readings"))


@query("ST2_load_batches", "select indicator_id, place, period_label, value, is_provisional from latest", "value")
def st2(t: Tables) -> DataFrame:
    """An empty delivery and three of the yearly figures; a file is a batch, and only changes are kept.

    The last delivery comes through a stream of its own, whose checkpoint knows nothing of the history.
    """
    landed, history = fresh_path(t.spark, "deliveries"), fresh_path(t.spark, "history")
    rows = B.vintages(t)
    for run in (0, 1, 2, 3):
        rows.filter(F.col("run_id") == run).write.parquet(f"{landed}/delivery={run}")
    for deliveries in ("[012]", "3"):
        stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{landed}/delivery={deliveries}")
        checkpoint = fresh_path(t.spark, "loads")
        J.run_available(stream, checkpoint, each=J.load_batches(history, checkpoint))
    latest = latest_vintage(t.spark.read.parquet(history))
    return latest.select("indicator_id", "place", "period_label", "value", "is_provisional")


STATE = (
    "external_id string, place string, office_type string, person_name string, start date, end date, verified date, note string"
)
view("weekly_lists", """
  select distinct (user_id // 10)::varchar as place, event_type as office, user_id, date_trunc('week', ts)::date as day from events
""")
view("all_lists", """
  select place, office, user_id, day from weekly_lists
  union all select place, office, user_id, day + 3 from weekly_lists where user_id = (select min(user_id) from weekly_lists)
""")
view("trusted_lists", "select * from all_lists where day in (select day from all_lists group by day having count(*) >= 50)")


def _observed(t: Tables) -> str:
    """Where the states of weekly lists of office-holders are, an office per kind of event and ten users.

    In between, a list holds one user only. A delivery without lists, the first two weeks and the rest
    come through a stream each, so every checkpoint but the first meets states it did not write.
    """
    landed, states = fresh_path(t.spark, "lists"), fresh_path(t.spark, "states")
    letters = F.translate(F.col("user_id").cast("string"), "0123456789", "abcdefghij")
    weekly = t.events.select("user_id", "event_type", F.trunc("ts", "week").alias("day")).distinct()
    lone = weekly.filter(F.col("user_id") == weekly.agg(F.min("user_id")).scalar()).withColumn("day", F.date_add("day", 3))
    lists = weekly.unionByName(lone).select(
        F.floor(F.col("user_id") / 10).cast("string").alias("place"), F.col("event_type").alias("office_type"),
        F.concat(F.lit("clerk "), letters).alias("person_name"), F.lit("listed").alias("note"), "day",
    )
    third = F.date_add(lists.agg(F.min("day")).scalar(), 14)
    for number, which in enumerate((F.lit(False), F.col("day") < third, F.col("day") >= third)):
        lists.filter(which).write.parquet(f"{landed}/delivery={number}")
        stream = t.spark.readStream.schema(lists.schema).parquet(f"{landed}/delivery={number}")
        checkpoint = fresh_path(t.spark, "observed")
        J.run_available(stream, checkpoint, each=J.observe_batches(states, checkpoint, t.spark.createDataFrame([], STATE)))
    return states


@query("ST3_observe_batches", """
  select user_id as person, office, strftime(first, '%Y-%m-%d') as "start", strftime(next - 1, '%Y-%m-%d') as "end" from (
    select user_id, l.office, min(day) as first,
      (select min(o.day) from trusted_lists o where o.place = l.place and o.office = l.office and o.day > max(l.day)) as next
    from trusted_lists l group by user_id, l.place, l.office)
""")
def st3(t: Tables) -> DataFrame:
    states = _observed(t)
    final = t.spark.read.parquet(f"{states}/state={numbered(t.spark, states, 'state')[-1]}")
    person = F.translate(F.substring_index("external_id", "-", -1), "abcdefghij", "0123456789").cast("bigint")
    return final.select(person.alias("person"), F.col("office_type").alias("office"), "start", "end")


@query("ST3_refused_days", """
  select strftime(day, '%Y-%m-%d') as day, count(*) as listed from all_lists group by all_lists.day having count(*) < 50
""")
def st3_refused(t: Tables) -> DataFrame:
    return t.spark.read.parquet(f"{_observed(t)}/refused=*").select("day", "listed")
