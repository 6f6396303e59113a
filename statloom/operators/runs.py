"""Bookkeeping of ingestion runs, load decisions, health of the sources and alerts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Typical days between releases (none: no regular schedule) and the limits.
CADENCE_DAYS = {
    "hourly": 1, "daily": 2, "weekly": 7, "monthly": 30, "quarterly": 92, "annual": 365, "biennial": 730,
}
STALE_FACTOR = 1.5
ABANDONED_HOURS = 2
ABANDONED = "abandoned: the run stopped without recording a result"
GOOD = ("loaded", "unchanged")
BAD = ("failed", "rejected", "running")
DETAIL_PROBLEMS = 5


def _older(started: Column, now: Column | datetime, hours: float) -> Column:
    moment = now if isinstance(now, Column) else F.lit(now)
    return started < moment - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(hours * 60)))


def start_run(runs: DataFrame, starting: DataFrame, now: datetime) -> DataFrame:
    """Adds the starting runs (run_id, dataset_id); older running runs of these datasets are abandoned."""
    mine = starting.select("dataset_id").distinct().withColumn("_mine", F.lit(True))
    joined = runs.join(mine, "dataset_id", "left")
    lost = F.col("_mine") & (F.col("status") == "running") & _older(F.col("started_at"), now, ABANDONED_HOURS)
    lost = F.coalesce(lost, F.lit(False))
    changed = {
        "status": F.when(lost, "failed").otherwise(F.col("status")),
        "finished_at": F.when(lost, F.lit(now)).otherwise(F.col("finished_at")),
        "error": F.when(lost, ABANDONED).otherwise(F.col("error")),
    }
    updated = joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in runs.columns])
    new = starting.select("run_id", "dataset_id").withColumn("status", F.lit("running")).withColumn("started_at", F.lit(now))
    return updated.unionByName(new, allowMissingColumns=True)


def finish_run(runs: DataFrame, results: DataFrame, now: datetime) -> DataFrame:
    """Records results (run_id, status, rows_loaded, error) of finished runs."""
    r = results.select("run_id", *[F.col(c).alias(f"_{c}") for c in ("status", "rows_loaded", "error")])
    done = F.col("_status").isNotNull()
    changed = {
        "status": F.coalesce("_status", "status"),
        "finished_at": F.when(done, F.lit(now)).otherwise(F.col("finished_at")),
        "rows_loaded": F.when(done, F.col("_rows_loaded")).otherwise(F.col("rows_loaded")),
        "error": F.when(done, F.col("_error")).otherwise(F.col("error")),
    }
    return runs.join(r, "run_id", "left").select(*[changed[c].alias(c) if c in changed else F.col(c) for c in runs.columns])


def mark_checked(datasets: DataFrame, checks: DataFrame, now: datetime) -> DataFrame:
    """Stamps checked datasets; the change stamp only moves when something changed."""
    c = checks.select("dataset_id", F.col("fingerprint").alias("_f"), F.col("changed").alias("_c"))
    seen = F.col("_f").isNotNull()
    changed = {
        "last_checked_at": F.when(seen, F.lit(now)).otherwise(F.col("last_checked_at")),
        "last_fingerprint": F.coalesce("_f", "last_fingerprint"),
        "last_changed_at": F.when(F.coalesce("_c", F.lit(False)), F.lit(now)).otherwise(F.col("last_changed_at")),
    }
    return datasets.join(c, "dataset_id", "left").select(
        *[changed[x].alias(x) if x in changed else F.col(x) for x in datasets.columns]
    )


def load_decision(batches: DataFrame, datasets: DataFrame) -> DataFrame:
    """What to do with each fetched batch.

    `batches`: dataset_id, probe, fingerprint, hard_problems, error. A probe equal to the stored
    fingerprint means unchanged without a fetch; then failures, rejections and equal content.
    """
    stored = datasets.select("dataset_id", "last_fingerprint")
    last = F.col("last_fingerprint")
    decision = (
        F.when(F.col("probe") == last, "unchanged").when(F.col("error").isNotNull(), "failed")
        .when(F.col("hard_problems") > 0, "rejected").when(F.col("fingerprint") == last, "unchanged").otherwise("loaded")
    )
    return batches.join(stored, "dataset_id", "left").withColumn("decision", decision)


def run_state(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest run of each dataset and the start of its failure streak.

    One dataset may own a third of all runs: both steps are plain aggregates that combine before
    the shuffle, and the streak is the first bad run after the last good one.
    """
    good = F.col("status").isin(*GOOD)
    last_row = F.struct("run_id", "status", "started_at", "error")
    summary = runs.groupBy("dataset_id").agg(F.max(last_row).alias("_last"), F.max(F.when(good, F.col("run_id"))).alias("_ok"))
    later = runs.join(summary.select("dataset_id", "_ok"), "dataset_id").filter(
        F.col("status").isin(*BAD) & (F.coalesce(F.col("run_id") > F.col("_ok"), F.lit(True)))
    )
    streak = later.groupBy("dataset_id").agg(F.min("started_at").alias("failing_since"))
    return (
        datasets.join(summary, "dataset_id", "left").join(streak, "dataset_id", "left")
        .select(
            *datasets.columns, F.col("_last.run_id").alias("run_id"), F.col("_last.status").alias("run_status"),
            F.col("_last.started_at").alias("run_started"), F.col("_last.error").alias("run_error"), "failing_since",
        )
    )


def health(datasets: DataFrame, runs: DataFrame, now: datetime) -> DataFrame:
    """State of every dataset that is not paused: failing, stale, unknown or ok, since when and why.

    `datasets`: dataset_id, title, cadence, status, last_changed_at; `runs` may carry `hard`, the
    problems that rejected a run.
    """
    state = run_state(datasets.filter("status <> 'paused'"), runs)
    abandoned = (F.col("run_status") == "running") & _older(F.col("run_started"), now, ABANDONED_HOURS)
    failing = F.coalesce(F.col("run_status").isin("failed", "rejected") | abandoned, F.lit(False))
    days = F.create_map(*[F.lit(x) for pair in CADENCE_DAYS.items() for x in pair])[F.col("cadence")]
    minutes = (days * F.lit(STALE_FACTOR * 24 * 60)).cast("int")
    limit = F.lit(now) - F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    overdue = F.coalesce(F.col("last_changed_at") < limit, F.lit(False))
    never = F.col("last_changed_at").isNull() & days.isNotNull()
    kind = (
        F.when(failing, "failing").when(F.col("run_status").isNull(), "unknown")
        .when(days.isNotNull() & (never | overdue), "stale").otherwise("ok")
    )
    since = (
        F.when(F.col("kind") == "failing", F.to_date(F.coalesce("failing_since", "run_started")))
        .when(F.col("kind") == "stale", F.to_date("last_changed_at"))
    )
    detail = (
        F.when(
            (F.col("kind") == "failing") & (F.col("run_status") == "rejected"),
            F.concat(F.lit("Rejected by validation: "), F.coalesce("run_error", F.lit(""))),
        )
        .when((F.col("kind") == "failing") & (F.col("run_status") == "running"), "The run stopped without recording a result.")
        .when(F.col("kind") == "failing", F.coalesce("run_error", F.lit("Failed without an error message.")))
        .when((F.col("kind") == "stale") & F.col("last_changed_at").isNull(), "No data has been loaded from this source yet.")
        .when(
            F.col("kind") == "stale",
            F.concat(F.lit("No new data since "), F.to_date("last_changed_at").cast("string"), F.lit("; it usually releases "), "cadence"),
        )
    )
    return state.withColumn("kind", kind).select(
        "dataset_id", "title", "kind", since.alias("since"), detail.alias("detail")
    )


def problems(states: DataFrame) -> DataFrame:
    return states.filter(F.col("kind").isin("failing", "stale"))


def alert_diff(states: DataFrame, open_alerts: DataFrame, datasets: DataFrame, kinds: Sequence[str] = ("failing", "stale")) -> DataFrame:
    """What to do with each alert: open, update or close. Alerts of other titles are left alone.

    `open_alerts`: number, title.
    """
    title = F.concat(F.lit("Data source "), F.col("kind"), F.lit(": "), F.col("dataset_id").cast("string"))
    wanted = problems(states).select(title.alias("title"), "detail")
    managed = datasets.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds]))).select(title.alias("title"))
    known = open_alerts.join(managed, "title", "left_semi")
    joined = wanted.withColumn("_w", F.lit(True)).join(known, "title", "full")
    action = F.when(F.col("number").isNull(), "open").when(F.col("_w"), "update").otherwise("close")
    return joined.select("title", "number", action.alias("action"), "detail")
