"""Ranked tables, comparisons and the figures shown on cards and maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.operators.skew import competition_rank, newest, top_rows, values_at

MAX_COMPARED = 4
MAP_STEPS = 5


def latest_value(obs: DataFrame) -> DataFrame:
    """Newest figure of each (place, indicator) by period end, then start and label."""
    return newest(obs, ["place", "indicator_id"], ["period_end", "period_start", "period_label"])


def composite_rows(scores: DataFrame, composite: str) -> DataFrame:
    """Rows of the main index; other indices share its level and must not mix in."""
    return scores.filter((F.col("level") == "composite") & (F.col("key") == composite))


def latest_edition(scores: DataFrame) -> DataFrame:
    return scores.agg(F.max("edition").alias("edition"))


def most_improved(scores: DataFrame, composite: str, national: str, edition: int, years: int = 3, k: int = 5) -> DataFrame:
    """The k places whose composite rose most since the edition `years` earlier."""
    rows = composite_rows(scores, composite).filter(
        F.col("edition").isin(edition, edition - years) & (F.col("place") != national) & F.col("score").isNotNull()
    )
    at = F.col("edition")
    both = rows.groupBy("place").agg(
        F.max(F.when(at == edition, F.col("score"))).alias("score"),
        F.max(F.when(at == edition - years, F.col("score"))).alias("base"),
    )
    change = both.withColumn("change", F.col("score") - F.col("base")).filter("change is not null")
    return change.orderBy(F.col("change").desc(), "place").limit(k)


def leaders(scores: DataFrame, peers: DataFrame, composite: str, edition: int, k: int = 3) -> DataFrame:
    """Top k of each peer group, and bottom k of groups with more than 2k ranked places."""
    rows = composite_rows(scores, composite).filter((F.col("edition") == edition) & F.col("rank_peer").isNotNull())
    rows = rows.join(peers, "place").select("peer_group", "place", "score", "rank_peer")
    sizes = rows.groupBy("peer_group").agg(F.count(F.lit(1)).alias("ranked"))
    top = top_rows(rows, ["peer_group"], [F.col("rank_peer"), F.col("place")], k)
    bottom = top_rows(rows, ["peer_group"], [F.col("rank_peer").desc(), F.col("place").desc()], k)
    bottom = bottom.join(sizes.filter(F.col("ranked") > 2 * k), "peer_group", "left_semi")
    return top.withColumn("end", F.lit("top")).unionByName(bottom.withColumn("end", F.lit("bottom")))


def strengths(scores: DataFrame, edition: int, k: int = 5) -> DataFrame:
    """The k best and k worst indicator scores of each place."""
    rows = scores.filter((F.col("edition") == edition) & (F.col("level") == "indicator") & F.col("score").isNotNull())
    rows = rows.select("place", F.col("key").alias("indicator_id"), "score")
    best = top_rows(rows, ["place"], [F.col("score").desc(), F.col("indicator_id")], k)
    worst = top_rows(rows, ["place"], [F.col("score"), F.col("indicator_id").desc()], k)
    return best.withColumn("end", F.lit("strength")).unionByName(worst.withColumn("end", F.lit("weakness")))


def index_leaders(scores: DataFrame, keys: Sequence[str], edition: int, k: int = 3) -> DataFrame:
    rows = scores.filter(
        (F.col("edition") == edition) & (F.col("level") == "composite") & F.col("key").isin(list(keys))
        & F.col("rank_overall").isNotNull()
    )
    rows = rows.select("key", "place", "score", "rank_overall")
    return top_rows(rows, ["key"], [F.col("rank_overall"), F.col("place")], k)


def value_rank(latest: DataFrame, directions: DataFrame, national: str) -> DataFrame:
    """Position of each place's newest figure among all places; ties share the first position.

    `directions`: indicator_id, direction. Lower-is-better figures are ranked with their sign
    turned; ranks are counted per value bucket (see skew.competition_rank).
    """
    sign = F.when(F.col("direction") == "lower_better", -1.0).otherwise(1.0)
    rows = latest.filter(F.col("place") != national).join(directions, "indicator_id")
    rows = rows.withColumn("_signed", F.col("value") * sign)
    return competition_rank(rows, ["indicator_id"], "_signed", "position").drop("_signed", "direction")


def trailing_mean(readings: DataFrame, days: int = 30) -> DataFrame:
    """Mean over the days up to each place's own newest day, and its newest reading.

    `readings`: place, day, value (one or more per day). The days of a place are summed first, so a
    place holds one row per day whatever the number of its readings.
    """
    daily = readings.groupBy("place", "day").agg(F.sum("value").alias("_sum"), F.count("value").alias("_n"))
    last = daily.groupBy("place").agg(F.max(F.struct("day", (F.col("_sum") / F.col("_n")).alias("value"))).alias("_last"))
    recent = daily.join(last, "place").filter(F.col("day") >= F.date_sub("_last.day", days - 1))
    return recent.groupBy("place").agg(
        F.max("_last.day").alias("latest_day"), F.max("_last.value").alias("latest"),
        (F.sum("_sum") / F.sum("_n")).alias("mean"), F.count(F.lit(1)).alias("days"),
    )


def trend_series(obs: DataFrame, headline: Sequence[str], periods: int = 8, points: int = 3, series: int = 9) -> DataFrame:
    """Last 8 periods of a place's headline series with 3 points or more; the first 9 in list order."""
    position = F.create_map(*[x for i, name in enumerate(headline) for x in (F.lit(name), F.lit(i + 1))])
    rows = obs.filter(F.col("indicator_id").isin(list(headline)))
    long_enough = rows.groupBy("place", "indicator_id").agg(F.count(F.lit(1)).alias("points")).filter(F.col("points") >= points)
    shown = top_rows(
        long_enough.withColumn("_at", position[F.col("indicator_id")]), ["place"], [F.col("_at")], series, "chart"
    ).select("place", "indicator_id", "chart")
    order = [F.col("period_end").desc(), F.col("period_start").desc()]
    recent = top_rows(rows, ["place", "indicator_id"], order, periods, "_age")
    return recent.join(shown, ["place", "indicator_id"]).select(
        "place", "indicator_id", "chart", "period_label", "period_end", "value"
    )


def score_history(scores: DataFrame, place: str | None = None) -> DataFrame:
    rows = scores.filter(F.col("level").isin("pillar", "composite") & F.col("score").isNotNull())
    if place is not None:
        rows = rows.filter(F.col("place") == place)
    return rows.select("edition", "place", "level", "key", "score").orderBy("level", "key", "place", "edition")


def best_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where one place is best: direction known, two or more values, one period, no tie.

    `rows`: keys, place, value, direction, period_label, rankable. Values are counted per (key,
    value) first, so ties need no list of places.
    """
    signed = F.col("value") * F.when(F.col("direction") == "lower_better", -1.0).otherwise(1.0)
    called = rows.filter(F.col("value").isNotNull() & (F.col("direction") != "neutral") & F.col("rankable"))
    per_value = called.groupBy(*keys, signed.alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("place").alias("place"),
        F.min(F.coalesce("period_label", F.lit(""))).alias("_lo"), F.max(F.coalesce("period_label", F.lit(""))).alias("_hi"),
    )
    best = per_value.groupBy(*keys).agg(
        F.max(F.struct("_s", "_n", "place")).alias("_b"), F.sum("_n").alias("_n"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
    )
    clear = (F.col("_n") >= 2) & (F.col("_lo") == F.col("_hi")) & (F.col("_b._n") == 1)
    return best.select(*keys, F.when(clear, F.col("_b.place")).alias("best"))


def scored_value(scores: DataFrame, obs: DataFrame, edition: int) -> DataFrame:
    """The figure behind each indicator score: the one of the scored period, else the newest."""
    own = scores.filter((F.col("edition") == edition) & (F.col("level") == "indicator")).select(
        "place", F.col("key").alias("indicator_id"), "score", F.col("period_label").alias("scored_label")
    )
    latest = latest_value(obs).select(
        "place", "indicator_id", F.col("period_label").alias("newest_label"), F.col("value").alias("newest"),
        F.col("period_end").alias("_newest_end"),
    )
    used = obs.select(
        "place", "indicator_id", F.col("period_label").alias("scored_label"), F.col("value").alias("_used"),
        F.col("period_end").alias("_used_end"),
    )
    joined = latest.join(own, ["place", "indicator_id"], "left").join(used, ["place", "indicator_id", "scored_label"], "left")
    found = F.col("_used").isNotNull()
    return joined.select(
        "place", "indicator_id", "score",
        F.when(found, F.col("_used")).otherwise(F.col("newest")).alias("value"),
        F.when(found, F.col("scored_label")).otherwise(F.col("newest_label")).alias("period_label"),
        F.when(found, F.col("_used_end")).otherwise(F.col("_newest_end")).alias("period_end"),
        (found & (F.col("scored_label") != F.col("newest_label"))).alias("newer_exists"),
    )


def data_year(shown: DataFrame) -> DataFrame:
    """Year of the median period end (element ⌊n/2⌋) behind each place's scored figures."""
    rows = shown.filter("score is not null").select("place", F.datediff("period_end", F.lit("1970-01-01").cast("date")).alias("d"))
    middle = F.array(F.struct(F.lit("m").alias("slot"), F.floor(F.col("total") / 2).cast("long").alias("position")))
    return values_at(rows, ["place"], "d", middle).select(
        "place", F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.col("d"))).alias("data_year")
    )


def class_breaks(values: DataFrame, groups: Sequence[str], value: str, classes: int = MAP_STEPS) -> DataFrame:
    """Quantile class breaks per group: the values at ⌊i·n/classes⌋, without repeats, ascending."""
    size = F.col("total")
    slots = F.array(
        *[
            F.struct(
                F.lit(i).alias("slot"),
                F.least(size - 1, F.floor(size * i / F.lit(classes)).cast("long")).alias("position"),
            )
            for i in range(1, classes)
        ]
    )
    picked = values_at(values, groups, value, slots)
    return picked.groupBy(*groups).agg(F.array_sort(F.collect_set(value)).alias("cuts"))


def map_class(value: Column, cuts: Column, steps: int = MAP_STEPS) -> Column:
    """Colour step of a value; fewer classes spread over the ramp so that the darkest is used."""
    index = F.size(F.filter(cuts, lambda c: value >= c))
    return F.when(F.size(cuts) == 0, F.lit(steps - 1)).otherwise(
        F.floor(index * (steps - 1) / F.size(cuts) + 0.5).cast("int")
    )


def pillar_table(scores: DataFrame, places: DataFrame, key: str, edition: int) -> DataFrame:
    """Every place with its score and rank in one pillar or index; places without one come last."""
    rows = scores.filter((F.col("edition") == edition) & (F.col("key") == key) & (F.col("level") != "indicator"))
    rows = rows.select("place", "score", F.col("rank_overall").alias("rank"))
    return places.select("place").join(rows, "place", "left").orderBy(F.col("rank").asc_nulls_last(), "place")


def rankings(scores: DataFrame, peers: DataFrame, pillars: Sequence[str], composite: str, edition: int) -> DataFrame:
    """One row per place: composite, ranks and a column per pillar, in order of peer group and rank."""
    rows = scores.filter((F.col("edition") == edition) & F.col("level").isin("pillar", "composite"))
    key = F.col("key")
    wide = rows.groupBy("place").agg(
        F.max(F.when(key == composite, F.col("score"))).alias("score"),
        F.max(F.when(key == composite, F.col("rank_overall"))).alias("rank"),
        F.max(F.when(key == composite, F.col("rank_peer"))).alias("rank_peer"),
        *[F.max(F.when((key == p) & (F.col("level") == "pillar"), F.col("score"))).alias(p) for p in pillars],
    )
    return wide.join(peers, "place").orderBy("peer_group", F.col("rank_peer").asc_nulls_last(), "place")


def chosen_places(slugs: Sequence[str]) -> list[str]:
    """Distinct requested slugs in order ("a,b" counts as two); unknown ones drop out in the join."""
    return list(dict.fromkeys(s.strip().lower() for part in slugs for s in part.split(",")))


def compare(scores: DataFrame, latest: DataFrame, indicators: DataFrame, places: DataFrame, slugs: Sequence[str], edition: int) -> DataFrame:
    """Rows (section, key) with one column per place position and the best place.

    Scores of pillars and indices, and the newest figures of indicators, of two to four places.
    """
    asked = chosen_places(slugs)
    order = F.create_map(*[x for i, s in enumerate(asked) for x in (F.lit(s), F.lit(i))])
    known = places.filter(F.col("place").isin(asked)).select("place", order[F.col("place")].alias("_at"))
    chosen = top_rows(known.withColumn("_g", F.lit(1)), ["_g"], [F.col("_at")], MAX_COMPARED, "slot").select("place", "slot")
    rated = (
        scores.filter((F.col("edition") == edition) & F.col("level").isin("pillar", "composite"))
        .join(chosen, "place")
        .select(
            F.col("level").alias("section"), "key", "place", "slot", F.col("score").alias("value"),
            F.lit("higher_better").alias("direction"), F.lit("").alias("period_label"), F.lit(True).alias("rankable"),
        )
    )
    figures = latest.join(chosen, "place").join(indicators.select("indicator_id", "direction", "rankable"), "indicator_id").select(
        F.lit("indicator").alias("section"), F.col("indicator_id").alias("key"), "place", "slot", "value", "direction",
        "period_label", "rankable",
    )
    cells = rated.unionByName(figures)
    wide = cells.groupBy("section", "key").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("value"))).alias(f"place_{i}") for i in range(1, MAX_COMPARED + 1)]
    )
    return wide.join(best_of(cells, ["section", "key"]), ["section", "key"], "left")


def peer_stats(scores: DataFrame, peers: DataFrame, edition: int) -> DataFrame:
    """Scored places and mean score per peer group and key."""
    rows = scores.filter((F.col("edition") == edition) & F.col("level").isin("pillar", "composite")).join(peers, "place")
    return rows.groupBy("peer_group", "level", "key").agg(F.count("score").alias("scored"), F.avg("score").alias("mean"))


def indicator_table(latest: DataFrame, places: DataFrame, indicator: str) -> DataFrame:
    """Every place with its newest figure, if any, and how many of all places have one."""
    rows = latest.filter(F.col("indicator_id") == indicator).select("place", "value", "period_label")
    joined = places.select("place").join(rows, "place", "left")
    counted = joined.agg(F.struct(F.count("value").alias("with_data"), F.count(F.lit(1)).alias("places")).alias("_n")).scalar()
    return joined.withColumn("_n", counted).select(*joined.columns, "_n.with_data", "_n.places")


def series(
    obs: DataFrame, places: DataFrame, indicator: str | None = None, place: str | None = None, place_type: str | None = None
) -> DataFrame:
    """Figures of one indicator, one place or one type of place, ordered by period end."""
    rows = obs
    if indicator is not None:
        rows = rows.filter(F.col("indicator_id") == indicator)
    if place is not None:
        rows = rows.filter(F.col("place") == place)
    if place_type is not None:
        rows = rows.join(places.filter(F.col("type") == place_type).select(F.col("slug").alias("place")), "place", "left_semi")
    return rows.orderBy("period_end", "indicator_id", "place")


def latest_releases(events: DataFrame, k: int = 6) -> DataFrame:
    """Newest release of each dataset, the newest k of them."""
    last = newest(events, ["dataset_id"], ["happened_at", "event_id"])
    return last.orderBy(F.col("happened_at").desc(), F.col("event_id").desc()).limit(k)


def releases(events: DataFrame, datasets: DataFrame, limit: int, tz: str = "Asia/Kolkata") -> DataFrame:
    """Newest releases with their dataset's title and the local day they belong to."""
    newest_first = events.orderBy(F.col("happened_at").desc(), F.col("event_id").desc()).limit(limit)
    return newest_first.join(datasets.select("dataset_id", "title"), "dataset_id").withColumn(
        "local_day", F.to_date(F.from_utc_timestamp("happened_at", tz))
    )


def release_days(events: DataFrame, datasets: DataFrame, limit: int, tz: str = "Asia/Kolkata") -> DataFrame:
    """Releases per local day, at most `limit` in all."""
    return releases(events, datasets, limit, tz).groupBy("local_day").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("title")), ", ").alias("titles")
    )
