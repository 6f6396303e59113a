"""Append-only revision history: what changed, what is latest, and the release events of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.operators.skew import newest, top_rows

KEY = ["indicator_id", "place", "period_start", "period_end"]
# Fixed value: differences below this are rounding noise, not revisions.
TOLERANCE = 1e-9
PERIODS_SHOWN = 6


def latest_vintage(obs: DataFrame) -> DataFrame:
    """The newest run's row of each key, reduced before the shuffle."""
    return newest(obs, KEY, ["run_id"])


def detect_changes(incoming: DataFrame, latest: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds `change`: new, revised (value or provisional flag differs) or unchanged."""
    stored = latest.select(*KEY, F.col("value").alias("_old"), F.col("is_provisional").alias("_old_flag"))
    moved = (F.abs(F.col("_old") - F.col("value")) > tolerance) | ~F.col("_old_flag").eqNullSafe(
        F.col("is_provisional")
    )
    change = F.when(F.col("_old").isNull(), "new").when(moved, "revised").otherwise("unchanged")
    return incoming.join(stored, KEY, "left").withColumn("change", change).drop("_old", "_old_flag")


def unknown_places(obs: DataFrame, places: DataFrame) -> DataFrame:
    """Places of the batch the reference table lacks; must be empty for a load."""
    known = places.select(F.col("slug").alias("place"))
    return obs.select("place").distinct().join(known, "place", "left_anti")


def assert_known_places(obs: DataFrame, places: DataFrame) -> None:
    """Refuses the whole batch when any place is unknown."""
    if not unknown_places(obs, places).isEmpty():
        raise ValueError("observations name places missing from the reference table")


def load_counts(changes: DataFrame) -> DataFrame:
    """received, new, revised and unchanged rows of a compared batch."""
    change = F.col("change")
    return changes.agg(
        F.count(F.lit(1)).alias("received"), F.count_if(change == "new").alias("new"),
        F.count_if(change == "revised").alias("revised"), F.count_if(change == "unchanged").alias("unchanged"),
    )


def revised_flag(obs: DataFrame) -> DataFrame:
    """Adds `revised`: an earlier run already had the key."""
    first = obs.groupBy(*KEY).agg(F.min("run_id").alias("_first"))
    return obs.join(first, KEY).withColumn("revised", F.col("run_id") > F.col("_first")).drop("_first")


def runs_without_event(runs: DataFrame, events: DataFrame) -> DataFrame:
    return runs.filter("status = 'loaded'").join(events.select("run_id").distinct(), "run_id", "left_anti")


def release_events(obs: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: figures, revised ones, indicators, newest six periods and a summary line.

    `runs` (run_id, …) names the runs wanted; a run that changed nothing gets no event.
    """
    flagged = revised_flag(obs).join(runs.select("run_id").distinct(), "run_id", "left_semi")
    counts = flagged.groupBy("run_id", "indicator_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("revised").alias("r")
    )
    # At most one row per catalogue indicator reaches the collection below.
    totals = counts.groupBy("run_id").agg(
        F.sum("n").alias("total"), F.sum("r").alias("revised"),
        F.array_sort(F.collect_set("indicator_id")).alias("indicators"),
    )
    labels = flagged.groupBy("run_id", "period_label").agg(F.max("period_end").alias("ends"))
    newest_first = [F.col("ends").desc(), F.col("period_label").desc()]
    periods = top_rows(labels, ["run_id"], newest_first, PERIODS_SHOWN).groupBy("run_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "period_label"))), lambda x: x["period_label"]
        ).alias("periods")
    )
    new = F.col("total") - F.col("revised")
    parts = F.concat_ws(
        " and ",
        F.when(new > 0, F.concat(F.format_number(new, 0), F.lit(" new"))),
        F.when(F.col("revised") > 0, F.concat(F.format_number("revised", 0), F.lit(" revised"))),
    )
    size = F.size("indicators")
    noun = F.when(size == 1, " indicator").otherwise(" indicators")
    summary = F.concat(parts, F.lit(" figures across "), size.cast("string"), noun)
    return totals.join(periods, "run_id").withColumn("summary", summary)


def backfill_releases(obs: DataFrame, runs: DataFrame, events: DataFrame) -> DataFrame:
    """Release events of every loaded run that has none, in one pass."""
    return release_events(obs, runs_without_event(runs, events))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, digest) that does not depend on the order of the rows, nor on the engine.

    A row is the text of its columns, each with its length in front ('-' for NULL). The four quarters of
    its MD5 are summed exactly, so nothing is gathered or sorted and equal rows do not cancel out.
    """
    texts = [F.col(c).cast("string") for c in columns]
    row = F.concat(*[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts])
    # Quarters are added as longs within a partition (at most 2^31 rows) and as decimals over all of them.
    hashed = df.select(F.md5(F.encode(row, "UTF-8")).alias("_h"), F.spark_partition_id().alias("_part"))
    quarters = [F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    parts = hashed.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(q).alias(f"p{i}") for i, q in enumerate(quarters)])
    totals = [F.coalesce(F.sum(F.col(f"p{i}").cast("decimal(20,0)")), F.lit(0)).alias(f"p{i}") for i in range(4)]
    sums = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *totals)
    text = F.concat_ws("-", F.col("rows").cast("string"), *[F.col(f"p{i}").cast("string") for i in range(4)])
    return sums.select("rows", F.sha2(text, 256).alias("digest"))


def stored_history(snapshots: DataFrame) -> DataFrame:
    """Full snapshots per run reduced to the rows an append-only load would have kept.

    A key has one row per run, so the window holds as many rows as there were runs.
    """
    runs = Window.partitionBy(*KEY).orderBy("run_id")
    before, flag = F.lag("value").over(runs), F.lag("is_provisional").over(runs)
    kept = before.isNull() | (F.abs(before - F.col("value")) > TOLERANCE) | ~flag.eqNullSafe(F.col("is_provisional"))
    return snapshots.withColumn("_keep", kept).filter("_keep").drop("_keep")
