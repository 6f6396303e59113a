"""Exports and documents built from the stored tables, and the writers that keep them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.periods import display_label
from statloom.functions.text import yes_no
from statloom.operators.cleaning import where_optional


def export_latest(
    latest: DataFrame, places: DataFrame, indicators: DataFrame, indicator_id: str | None = None
) -> DataFrame:
    """Newest figures with place, parent and source. `places`: slug, name, parent; `indicators`:
    indicator_id, name, source. The parent's name comes from a second look at the places."""
    rows = where_optional(latest, "indicator_id", indicator_id)
    parents = places.select(F.col("slug").alias("parent"), F.col("name").alias("parent_name"))
    named = places.select(F.col("slug").alias("place"), F.col("name").alias("place_name"), "parent")
    return (
        rows.join(named, "place")
        .join(parents, "parent", "left")
        .join(indicators.select("indicator_id", F.col("name").alias("indicator_name"), "source"), "indicator_id")
        .select(
            "indicator_id", "indicator_name", "place", "place_name", "parent_name",
            display_label(F.col("period_label")).alias("period"), "period_start", "period_end", "value",
            F.col("is_provisional").alias("provisional"), "source",
        )
    )


def export_catalogue(indicators: DataFrame, categories: DataFrame, sources: DataFrame) -> DataFrame:
    """Indicators with their category and source; both may be missing."""
    return indicators.join(categories, "category_id", "left").join(sources, "dataset_id", "left")


def catalogue(indicators: DataFrame, pillars: DataFrame) -> DataFrame:
    """Indicators with the pillar they count in, if any."""
    return indicators.join(pillars, "indicator_id", "left")


def to_csv_columns(df: DataFrame) -> DataFrame:
    """Booleans as yes/no; nested columns as JSON text."""
    columns = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.BooleanType):
            c = yes_no(c)
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """RFC 4180: quotes doubled, empty for NULL, one file set per partition value."""
    writer = to_csv_columns(df).write.option("header", True).option("quote", '"').option("escape", '"')
    writer = writer.option("emptyValue", "").option("nullValue", "")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def rankings_document(scores: DataFrame, composite: str, edition: int) -> DataFrame:
    """One row per place: the composite's struct and a map pillar -> struct, best rank first."""
    rows = scores.filter((F.col("edition") == edition) & F.col("level").isin("pillar", "composite"))
    ranks = [
        "score", F.col("rank_overall").alias("rank"), F.col("rank_peer").alias("rank_peer"),
        F.col("rank_overall_prev").alias("rank_previous"), F.col("rank_peer_prev").alias("rank_peer_previous"),
    ]
    main = (F.col("level") == "composite") & (F.col("key") == composite)
    # A place has one row per pillar and index.
    entry = F.struct(F.col("key"), F.struct(*ranks, "coverage"))
    grouped = rows.groupBy("place").agg(
        F.max(F.when(main, F.struct(*ranks))).alias("composite"),
        F.map_from_entries(F.collect_list(F.when(F.col("level") == "pillar", entry))).alias("pillars"),
    )
    return grouped.orderBy(F.col("composite.rank").asc_nulls_last(), "place")


def _figure(*extra: str):
    return F.struct(*extra, "period_label", "period_start", "period_end", "value", "is_provisional")


def place_document(places: DataFrame, rankings: DataFrame, latest: DataFrame) -> DataFrame:
    """Attributes, rankings and the observation array of each place.

    The array holds one entry per indicator and period of a single place, so its size follows the
    catalogue and the calendar, not the number of places or revisions.
    """
    figures = latest.groupBy("place").agg(
        F.array_sort(F.collect_list(_figure("indicator_id"))).alias("observations")
    )
    attributes = places.select(F.col("slug").alias("place"), "name", "type", "peer_group")
    return attributes.join(rankings, "place").join(figures, "place", "left")


def indicator_document(indicators: DataFrame, latest: DataFrame, parts: int, place: str | None = None) -> DataFrame:
    """The figures of each indicator as documents keyed by (indicator_id, part), optionally of one place.

    An indicator may hold a third of all figures: the caller says into how many parts every indicator
    is cut, and a place is always in the same part (its hash modulo `parts`).
    """
    rows = where_optional(latest, "place", place).withColumn("part", F.pmod(F.xxhash64("place"), F.lit(parts)))
    cut = rows.groupBy("indicator_id", "part").agg(F.collect_list(_figure("place")).alias("observations"))
    return indicators.join(cut, "indicator_id")


def source_listing(datasets: DataFrame, health: DataFrame) -> DataFrame:
    """Every dataset with its state of health."""
    state = health.select("dataset_id", "kind", "since", "detail")
    return datasets.join(state, "dataset_id", "left").withColumn("state", F.coalesce("kind", F.lit("ok"))).drop("kind")


def places_listing(places: DataFrame) -> DataFrame:
    """Current first-level places and cities in one list; what only one kind has is NULL for the other."""
    first = places.filter(F.col("type").isin("state", "ut") & F.col("valid_to").isNull()).select(
        "slug", "name", "type", "peer_group"
    )
    cities = places.filter("type = 'city'").select(
        "slug", "name", "type", F.col("parent").alias("state"), (F.col("peer_group") == "million_plus").alias("million_plus")
    )
    return first.unionByName(cities, allowMissingColumns=True)


# --- Writers ------------------------------------------------------------------------------------


def append_vintage(changed: DataFrame, path: str) -> None:
    """Appends the new and revised rows of a run; the history is partitioned by run."""
    rows = changed.filter("change <> 'unchanged'").drop("change")
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Replaces the editions of the methodology versions at hand and leaves other versions alone."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "methodology_version", "edition"
    ).parquet(path)


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace those of the same key; nothing else is deleted."""
    return incoming.unionByName(target.join(incoming.select(*keys), list(keys), "left_anti"))


def upsert_status(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """As upsert, but an incoming pause wins and what was marked broken stays broken otherwise."""
    old = target.select(key, F.col("status").alias("_old"))
    joined = incoming.withColumnRenamed("status", "_new").join(old, key, "left")
    status = (
        F.when(F.col("_new") == "paused", "paused")
        .when(F.col("_old") == "broken", "broken")
        .otherwise(F.col("_new"))
    )
    return upsert(target, joined.withColumn("status", status).select(*target.columns), [key])
