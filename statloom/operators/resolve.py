"""Place names to places valid in the period of the data. A name is matched or reported, never guessed."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.periods import midpoint
from statloom.functions.text import normalize_name

TOP_LEVEL = ("country", "state", "ut")
# Labels of aggregate rows, dropped instead of matched.
AGGREGATE_LABELS = (
    "total states", "states total", "total state", "total uts", "uts total", "total ut",
    "total union territories", "union territories total",
)


def name_table(places: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """key -> windows: what a normalised name can mean and when.

    `places`: slug, name, type, valid_from, valid_to; `aliases`: alias, slug, period_from, period_to.
    Places that share a name, type and window are folded to the least and greatest slug (enough to
    tell one place from several), so a key's windows stay few however many places share the name.
    """
    own = places.select(
        F.explode(F.array("name", F.translate("slug", "-", " "))).alias("raw"), "slug", "type",
        F.col("valid_from").alias("since"), F.col("valid_to").alias("until"),
    )
    if aliases is not None:
        scoped = aliases.join(places.select("slug", "type", "valid_from", "valid_to"), "slug").select(
            F.col("alias").alias("raw"), "slug", "type",
            F.greatest("valid_from", "period_from").alias("since"),
            F.least("valid_to", "period_to").alias("until"),
        )
        own = own.unionByName(scoped)
    keyed = own.select(normalize_name(F.col("raw")).alias("key"), "slug", "type", "since", "until")
    windows = (
        keyed.filter("key <> ''")
        .groupBy("key", "type", "since", "until")
        .agg(F.min("slug").alias("least"), F.max("slug").alias("most"))
    )
    return windows.groupBy("key").agg(
        F.collect_list(F.struct("type", "since", "until", "least", "most")).alias("windows")
    )


def _valid(windows: Column, day: Column, types: Sequence[str]) -> Column:
    return F.filter(
        windows,
        lambda w: w["type"].isin(list(types))
        & F.coalesce(w["since"] <= day, F.lit(True))
        & F.coalesce(w["until"] >= day, F.lit(True)),
    )


def resolve_on(
    df: DataFrame, names: DataFrame, raw: str, days: Sequence[Column], types: Sequence[str] = TOP_LEVEL
) -> DataFrame:
    """Adds `place`, `resolution` and `problem`, trying the given days in turn.

    One equi join on the normalised name; the validity test is an expression over the name's few
    windows, so rows are neither multiplied nor regrouped. Resolution is matched, skipped
    (aggregate label), ambiguous, out of validity or unknown.
    """
    keyed = df.withColumn("_key", normalize_name(F.col(raw)))
    joined = keyed.join(names.withColumnRenamed("key", "_key"), "_key", "left")
    place, several = F.lit(None).cast("string"), F.lit(False)
    for day in reversed(days):
        valid = _valid(F.col("windows"), day, types)
        least = F.array_min(F.transform(valid, lambda w: w["least"]))
        most = F.array_max(F.transform(valid, lambda w: w["most"]))
        place = F.coalesce(F.when(least == most, least), place)
        several = several | F.coalesce(least != most, F.lit(False))
    skipped = F.coalesce(F.col("_key").isin(*AGGREGATE_LABELS), F.lit(False))
    joined = joined.withColumn("_place", place).withColumn("_several", several)
    resolution = (
        F.when(skipped, "skipped")
        .when(F.col("_place").isNotNull(), "matched")
        .when(F.col("_several"), "ambiguous")
        .when(F.col("windows").isNotNull(), "out of validity")
        .otherwise("unknown")
    )
    out = joined.withColumn("resolution", resolution)
    problem = F.when(
        F.col("resolution").isin("ambiguous", "out of validity", "unknown"),
        F.concat(F.col("resolution"), F.lit(" place name '"), F.coalesce(F.col(raw), F.lit("")), F.lit("'")),
    )
    return out.select(
        *df.columns,
        F.when(F.col("resolution") == "matched", F.col("_place")).alias("place"),
        "resolution",
        problem.alias("problem"),
    )


def resolve(df: DataFrame, names: DataFrame, raw: str, types: Sequence[str] = TOP_LEVEL) -> DataFrame:
    """Resolves on the midpoint of each row's period."""
    return resolve_on(df, names, raw, [midpoint(F.col("period_start"), F.col("period_end"))], types)


def resolve_current_first(
    df: DataFrame, names: DataFrame, raw: str, today: date, types: Sequence[str] = TOP_LEVEL
) -> DataFrame:
    """Today's boundaries first, then those of the period."""
    days = [F.lit(today), midpoint(F.col("period_start"), F.col("period_end"))]
    return resolve_on(df, names, raw, days, types)


def resolve_as_of(
    df: DataFrame, names: DataFrame, raw: str, day: date, types: Sequence[str] = TOP_LEVEL
) -> DataFrame:
    """For series back-cast to the boundaries of one day."""
    return resolve_on(df, names, raw, [F.lit(day)], types)


def resolved(df: DataFrame) -> DataFrame:
    return df.filter("resolution = 'matched'").drop("resolution", "problem")


def problems_of(df: DataFrame) -> DataFrame:
    return df.filter("problem is not null").select("problem").distinct()


def resolve_with_repairs(
    df: DataFrame, names: DataFrame, raw: str, types: Sequence[str] = TOP_LEVEL
) -> DataFrame:
    """Retries a name with each of its blanks removed ("Ha ryana"); the earliest repair wins.

    Works on the distinct (name, period) pairs, each with as many candidates as the name has blanks.
    """
    asked = df.select(raw, "period_start", "period_end").distinct()
    text = F.col(raw)
    gaps = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substr(text, i, F.lit(1)) == " ")
    repaired = F.transform(gaps, lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))
    tried = asked.select("*", F.posexplode(F.concat(F.array(text), repaired)).alias("_no", "_candidate"))
    found = resolve(tried, names, "_candidate", types).filter("place is not null")
    first = found.groupBy(raw, "period_start", "period_end").agg(F.min(F.struct("_no", "place")).alias("_hit"))
    keys = [raw, "period_start", "period_end"]
    return df.join(first, keys, "left").select(*df.columns, F.col("_hit.place").alias("place"))


def split_prefix(
    df: DataFrame, names: DataFrame, text: str, day: Column, types: Sequence[str] = TOP_LEVEL
) -> DataFrame:
    """The longest leading run of words that names a place, and the rest of the text.

    Runs reach as far as the longest name could: every word of it may be followed by a mark, and an
    article may come first.
    """
    longest = names.agg(F.max(F.size(F.split("key", " "))) * 2 + 1).scalar()
    asked = df.select(text).distinct()
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    tried = asked.withColumn("_words", words).withColumn(
        "_k", F.explode(F.sequence(F.lit(1), F.least(F.size("_words"), longest)))
    )
    tried = tried.withColumn("_prefix", F.array_join(F.slice("_words", 1, F.col("_k")), " "))
    found = resolve_on(tried, names, "_prefix", [day], types).filter("place is not null")
    rest = F.array_join(F.slice(F.col("_words"), F.col("_k") + 1, F.greatest(F.size("_words"), F.lit(1))), " ")
    best = found.withColumn("rest", rest).groupBy(text).agg(F.max(F.struct("_k", "place", "rest")).alias("_hit"))
    return df.join(best, text, "left").select(
        *df.columns, F.col("_hit.place").alias("place"), F.coalesce("_hit.rest", F.col(text)).alias("rest")
    )


def lookup_or_problem(df: DataFrame, dim: DataFrame, key: str, what: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the dimension's columns, one problem per unmatched key)."""
    found = df.join(dim, key)
    missing = df.join(dim, key, "left_anti").select(
        F.concat(F.lit(f"{what} '"), F.col(key).cast("string"), F.lit("' is not mapped")).alias("problem")
    )
    return found, missing.distinct()


def lookup_city(df: DataFrame, lookup: DataFrame, parent: str, name: str) -> DataFrame:
    """City by (parent, name), else by the name alone where only one city bears it."""
    exact = lookup.select(F.col("parent").alias(parent), F.col("key").alias(name), F.col("city").alias("_exact"))
    alone = (
        lookup.groupBy(F.col("key").alias(name))
        .agg(F.min("city").alias("_least"), F.max("city").alias("_most"))
        .filter("_least = _most")
        .select(name, F.col("_least").alias("_alone"))
    )
    joined = df.join(exact, [parent, name], "left").join(alone, name, "left")
    return joined.select(*df.columns, F.coalesce("_exact", "_alone").alias("city"))
