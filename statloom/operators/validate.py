"""Checks on batches and reference tables; each returns problem rows instead of raising row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["indicator_id", "place", "period_start", "period_end"]


def _problem(df: DataFrame, severity: str, rule: str, *key: str) -> DataFrame:
    return df.select(
        F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
        F.concat_ws(" ", *[F.col(k).cast("string") for k in key]).alias("key"),
    )


def validate(obs: DataFrame, indicators: DataFrame) -> DataFrame:
    """Hard problems of a batch: unknown indicator, not a number, out of bounds, duplicate.

    `indicators`: indicator_id, valid_min, valid_max. The row rules share one scan; the first that
    applies stops the rest, except that a value may break both of its bounds.
    """
    known = indicators.select("indicator_id", "valid_min", "valid_max", F.lit(True).alias("_known"))
    rows = obs.join(known, "indicator_id", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    value = F.col("value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    rules = (
        F.when(~F.col("_known"), F.array(F.lit("unknown indicator")))
        .when(~finite, F.array(F.lit("not a number")))
        .otherwise(
            F.array_compact(
                F.array(
                    F.when(value < F.col("valid_min"), "below minimum"),
                    F.when(value > F.col("valid_max"), "above maximum"),
                )
            )
        )
    )
    label = F.concat_ws(" ", "indicator_id", "place", "period_label")
    row_problems = rows.select(
        F.lit("hard").alias("severity"), F.explode(rules).alias("rule"),
        F.when(F.col("_known"), label).otherwise(F.col("indicator_id")).alias("key"),
    )
    twice = rows.filter(F.col("_known") & finite).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return row_problems.unionByName(_problem(twice, "hard", "duplicate", *KEY))


def coverage_notes(obs: DataFrame, places: DataFrame, current: int, share: float = 0.8) -> DataFrame:
    """Soft problems: an indicator and period reported by less than 80 % of the current places."""
    counted = places.filter(F.col("type").isin("state", "ut")).select(F.col("slug").alias("place"))
    pairs = obs.join(counted, "place", "left_semi").groupBy("indicator_id", "period_label", "place").agg(
        F.lit(1).alias("_one")
    )
    thin = pairs.groupBy("indicator_id", "period_label").agg(F.count("_one").alias("reported"))
    return thin.filter(F.col("reported") < share * current)


def check_reference(checks: Sequence[tuple[str, DataFrame, str, DataFrame, str]], unique: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """Dangling references and repeated keys of reference tables.

    `checks`: (rule, child, column, parent, parent column); `unique`: (rule, table, key columns).
    """
    out = None
    for rule, child, column, parent, parent_column in checks:
        bad = child.filter(F.col(column).isNotNull()).select(F.col(column).alias("_v")).join(
            parent.select(F.col(parent_column).alias("_v")), "_v", "left_anti"
        )
        part = _problem(bad.distinct(), "hard", rule, "_v")
        out = part if out is None else out.unionByName(part)
    for rule, table, key in unique:
        bad = table.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        part = _problem(bad, "hard", rule, *key)
        out = part if out is None else out.unionByName(part)
    return out


def check_shares(
    df: DataFrame, keys: Sequence[str], part: str, value: str, parts: Sequence[str], tolerance: float = 2.0
) -> tuple[DataFrame, DataFrame]:
    """(groups whose parts add to 100 ± 2, the others). A missing part counts as 0."""
    sums = df.filter(F.col(part).isin(list(parts))).groupBy(*keys).agg(
        F.sum(value).alias("total"),
        *[F.max(F.when(F.col(part) == p, F.col(value))).alias(p) for p in parts],
    )
    ok = F.abs(F.col("total") - 100) <= tolerance
    return sums.filter(ok), sums.filter(~ok)


def drop_spikes(df: DataFrame, keys: Sequence[str], year: str, value: str, factor: float = 2.5) -> DataFrame:
    """Adds `spike`: the value exceeds 2.5 × both the previous and the next year's.

    Each row is offered to the years beside it; a group holds three rows at most per year, so a long
    series is never sorted in one task.
    """
    offered = df.select(
        *keys, value,
        F.explode(
            F.array(
                F.struct(F.col(year).alias("_y"), F.lit("now").alias("_role")),
                F.struct((F.col(year) + 1).alias("_y"), F.lit("before").alias("_role")),
                F.struct((F.col(year) - 1).alias("_y"), F.lit("after").alias("_role")),
            )
        ).alias("_o"),
    )

    def of(role: str):
        return F.max(F.when(F.col("_o._role") == role, F.col(value)))

    beside = offered.groupBy(*keys, F.col("_o._y").alias(year)).agg(
        of("now").alias(value), of("before").alias("before"), of("after").alias("after")
    )
    both = (F.coalesce("before", F.lit(0.0)) != 0) & (F.coalesce("after", F.lit(0.0)) != 0)
    return beside.filter(F.col(value).isNotNull()).withColumn(
        "spike", both & (F.col(value) > factor * F.greatest("before", "after"))
    )


def shrink_guard(new: DataFrame, previous: DataFrame, share: float = 0.8, min_rows: int = 50) -> DataFrame:
    """One row: sizes of both loads and why the new one must be refused (NULL when it may pass)."""
    sizes = new.select(F.lit(1).alias("new"), F.lit(0).alias("old")).unionByName(
        previous.select(F.lit(0).alias("new"), F.lit(1).alias("old"))
    )
    counted = sizes.agg(F.coalesce(F.sum("new"), F.lit(0)).alias("new_rows"), F.coalesce(F.sum("old"), F.lit(0)).alias("old_rows"))
    return counted.withColumn(
        "refusal",
        F.when(F.col("new_rows") < min_rows, "too few rows").when(
            F.col("new_rows") < F.col("old_rows") * share, "smaller than the previous load"
        ),
    )


def summary_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def all_problems(*parts: DataFrame) -> DataFrame:
    """Distinct problems of several steps, sorted."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct().orderBy(*out.columns)


def row_count_problems(rows: DataFrame, table: Sequence[str], item: str, expected: int, tables: DataFrame) -> DataFrame:
    """Of the `tables` that must be there, those with fewer distinct items than expected; rows_read is 0 where nothing was read."""
    counted = rows.groupBy(*table, item).agg(F.lit(1).alias("_one")).groupBy(*table).agg(F.count("_one").alias("_read"))
    asked = tables.select(*table).distinct().join(counted, list(table), "left")
    return asked.withColumn("rows_read", F.coalesce("_read", F.lit(0))).drop("_read").filter(F.col("rows_read") < expected)
