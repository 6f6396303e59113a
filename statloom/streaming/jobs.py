"""Structured Streaming jobs: readings rolled up as they arrive, incremental loads, daily snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators.terms import MIN_OBSERVED, observe_days, refused_days
from statloom.operators.vintage import KEY, detect_changes, latest_vintage
from statloom.session import make_folder, numbered


def daily_means(readings: DataFrame, delay: str = "1 day") -> DataFrame:
    """Mean per place and day of a stream of readings (place, observed_at, value).

    Rows later than the watermark are dropped; a day is final once the watermark has passed it.
    """
    days = readings.withWatermark("observed_at", delay).groupBy(F.window("observed_at", "1 day"), "place")
    return days.agg(F.avg("value").alias("mean"), F.count("value").alias("readings")).select(
        "place", F.col("window.start").alias("day"), "mean", "readings"
    )


def sliding_means(readings: DataFrame, days: int = 30, delay: str = "1 day") -> DataFrame:
    """Mean over the last `days` days, one window per day.

    Readings are summed per day first, so that a window's state grows with days, not with readings.
    """
    daily = readings.withWatermark("observed_at", delay).groupBy(F.window("observed_at", "1 day").alias("day"), "place").agg(
        F.sum("value").alias("s"), F.count("value").alias("n")
    )
    spans = daily.groupBy(F.window(F.window_time("day"), f"{days} days", "1 day").alias("span"), "place")
    return spans.agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("readings")).select(
        "place", F.col("span.end").alias("until"), "mean", "readings"
    )


def deduplicated(readings: DataFrame, key: str, delay: str = "10 days") -> DataFrame:
    """Readings re-read by later runs count once (their copies arrive within the delay)."""
    return readings.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark([key])


def _claim(spark: SparkSession, checkpoint: str, batch_id: int, free: int) -> int:
    """The number a batch writes under: noted in the checkpoint before its first attempt, so that a retry finds it."""
    note = f"{checkpoint}/numbers/batch={batch_id}"
    noted = numbered(spark, note, "number")
    if not noted:
        make_folder(spark, f"{note}/number={free}")
    return noted[0] if noted else free


#: Runs after which the current state is written anew, and the parts it is dealt into by key.
SNAPSHOT_EVERY, BUCKETS = 8, 64
STATE = [*KEY, "value", "is_provisional"]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def current_state(spark: SparkSession, path: str, run: int, known: list[int], touched: list[int] | None = None, buckets: int = BUCKETS) -> DataFrame | None:
    """The newest row of every key as it was before `run`, or of the keys of `touched` buckets; None before the first run.

    The state is the newest snapshot of an earlier run and what the runs after it have changed: the partitions of the
    history are those changes. Of a snapshot only the touched buckets are read, and only runs after it, so that what a
    batch reads follows the keys that it brings and not the length of the history.
    """
    place = f"{path}/_current-{buckets}"
    snapshots = [n for n in numbered(spark, place, "run_id", "_SUCCESS") if n < run]
    last = snapshots[-1] if snapshots else None
    recent = [k for k in known if k < run and (last is None or k > last)]
    parts = []
    if last is not None:
        kept = spark.read.parquet(f"{place}/run_id={last}")
        parts.append((kept if touched is None else kept.filter(F.col("bucket").isin(touched))).select(*STATE, F.lit(last).alias("run_id")))
    if recent:
        changes = spark.read.option("basePath", path).parquet(*[f"{path}/run_id={k}" for k in recent])
        changes = changes.withColumn("bucket", _bucket(buckets))
        parts.append((changes if touched is None else changes.filter(F.col("bucket").isin(touched))).select(*STATE, F.col("run_id").cast("int").alias("run_id")))
    if not parts:
        return None
    return latest_vintage(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def load_batches(path: str, checkpoint: str, every: int = SNAPSHOT_EVERY, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: appends what is new or revised against the history at `path`.

    A batch is the run after the last one listed in the history, whatever its id, and the number is
    noted in the stream's `checkpoint`. A batch that is retried keeps its number, sees only earlier
    runs and overwrites its own partition, so every batch lands exactly once; a new checkpoint over
    an old history goes on after it. A batch without rows writes nothing. Every `every` runs the state
    is written as a snapshot, dealt into `buckets` by key, in a folder beside the partitions that readers
    of the history pass over; a history without snapshots gets its first one then.
    """
    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        rows = batch.drop("run_id")
        known = numbered(spark, path, "run_id")
        run = _claim(spark, checkpoint, batch_id, max(known, default=-1) + 1)
        touched = [r[0] for r in rows.select(_bucket(buckets)).distinct().collect()]  # `buckets` numbers at most
        state = current_state(spark, path, run, known, touched, buckets)
        changed = rows.withColumn("change", F.lit("new")) if state is None else detect_changes(rows, state)
        kept = changed.filter("change <> 'unchanged'").drop("change").withColumn("run_id", F.lit(run))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
        if (run + 1) % every == 0:
            known = numbered(spark, path, "run_id")
            whole = current_state(spark, path, run + 1, known, None, buckets)
            if whole is not None:
                dealt = whole.select(*STATE, _bucket(buckets).alias("bucket")).repartition("bucket")
                dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/_current-{buckets}/run_id={run}")

    return load


def observe_batches(path: str, checkpoint: str, empty: DataFrame, minimum: int = MIN_OBSERVED) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: office-holders after the lists of all days that have landed.

    A day's list is a snapshot: who is absent matters. A list of fewer than `minimum` rows closes
    nothing; it is left out and reported under `refused=n`. States are written as `state=n`, each
    from the one before, with numbers given as for loads; a retried batch starts from the same state.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = numbered(spark, path, "state", "_SUCCESS")
        number = _claim(spark, checkpoint, batch_id, max(done, default=-1) + 1)
        before = [n for n in done if n < number]
        state = spark.read.schema(empty.schema).parquet(f"{path}/state={before[-1]}") if before else empty
        lists = batch.persist()
        refused_days(lists, minimum).write.mode("overwrite").parquet(f"{path}/refused={number}")
        observe_days(state, lists, minimum).write.mode("overwrite").parquet(f"{path}/state={number}")
        lists.unpersist()

    return step


def run_available(stream: DataFrame, checkpoint: str, *, path: str | None = None, each: Callable | None = None) -> None:
    """Processes everything that has landed and stops; sinks are files or a foreachBatch function."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if each is not None:
        query = writer.foreachBatch(each).start()
    else:
        query = writer.format("parquet").outputMode("append").option("path", path).start()
    query.awaitTermination()
