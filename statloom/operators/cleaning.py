"""Row filters and clean-up steps that sources need before their figures can be used."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.text import normalize_name, slugify, strip_footnotes

# Region totals and notes among the rows of a state table.
SKIP_ROWS = r"(?i)^(northern|north-eastern|eastern|central|western|southern) region|^others$|^all states"
NATIONAL_ROWS = r"(?i)^(all[- ]india|total)$"
NOTE_ROWS = r"^(?:-|\.|\*|\d+\.\s|Note|Source|SDLs|[A-Z]{1,3}:)"
# Score bands and air-quality categories with their upper ends.
SCORE_BANDS = ((100.0, "achiever"), (65.0, "frontRunner"), (50.0, "performer"))
AQI_CATEGORIES = ((50, "good"), (100, "satisfactory"), (200, "moderate"), (300, "poor"), (400, "veryPoor"))


def match_all(df: DataFrame, expected: Mapping[str, object]) -> DataFrame:
    """Rows equal on every expected column (NULL equals NULL); pushes down to the scan."""
    for column, value in expected.items():
        df = df.filter(F.col(column).isNull() if value is None else F.col(column) == F.lit(value))
    return df


def map_labels(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Labels without footnote numbers mapped to indicators; other rows drop out."""
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn("indicator_id", literal[strip_footnotes(F.col(column))]).filter("indicator_id is not null")


def exclude_pairs(df: DataFrame, columns: Sequence[str], pairs: Sequence[Sequence[str]]) -> DataFrame:
    """Drops listed combinations, e.g. an indicator whose figures in one round are another's."""
    listed = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, pair)]) for pair in pairs])
    return df.filter(~F.coalesce(F.array_contains(listed, F.struct(*columns)), F.lit(False)))


def guarded_relabel(df: DataFrame, column: str, mapping: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Relabels only if the labels are exactly those expected; otherwise reads nothing and reports.

    Labels are reduced to two counts first, so the guard is one row whatever the number of labels.
    """
    known = list(mapping)
    labels = df.select(F.col(column).alias("label")).distinct()
    guard = labels.agg(
        F.count_if(F.col("label").isin(known)).alias("_known"),
        F.count_if(~F.coalesce(F.col("label").isin(known), F.lit(False))).alias("_other"),
    ).withColumn("ok", (F.col("_known") == len(known)) & (F.col("_other") == 0))
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    read = df.filter(guard.select("ok").scalar()).withColumn(column, literal[F.col(column)])
    problem = guard.filter("not ok").select(F.lit(f"unexpected labels in {column}; not read").alias("problem"))
    return read, problem


def flag_recent_provisional(df: DataFrame, today: date) -> DataFrame:
    """Periods ending on or after 31 March of last year are provisional."""
    return df.withColumn("is_provisional", F.col("period_end") >= F.lit(date(today.year - 1, 3, 31)))


def drop_sentinel(df: DataFrame, indicator: str, sentinel: float) -> tuple[DataFrame, DataFrame]:
    """A value that means "not measured" for one indicator leaves the rows and is reported."""
    hit = (F.col("indicator_id") == indicator) & (F.col("value") == sentinel)
    problem = F.concat(
        F.lit(f"{indicator} of {sentinel:g} for "), "place", F.lit(" "), "period_label", F.lit(" skipped as unreliable")
    )
    return df.filter(~F.coalesce(hit, F.lit(False))), df.filter(hit).select(problem.alias("problem"))


def clean_place_rows(df: DataFrame, column: str) -> DataFrame:
    """Stars off names; notes, regions and blanks dropped; national totals named as such."""
    name = F.regexp_replace(F.trim(F.col(column)), r"\s*\*+$", "")
    kept = (name != "") & ~name.rlike(NOTE_ROWS) & ~name.rlike(SKIP_ROWS)
    national = F.when(name.rlike(NATIONAL_ROWS), "All India").otherwise(name)
    return df.filter(kept).withColumn(column, national)


def drop_footnoted(df: DataFrame, name: str, year: str, first_good_year: int, pattern: str = r"[*#@$]\s*$") -> DataFrame:
    """Rows whose name carries a footnote mark are unusable before a year."""
    noted = F.col(name).rlike(pattern) & (F.col(year) < first_good_year)
    return df.filter(~F.coalesce(noted, F.lit(False)))


def drop_partial_areas(df: DataFrame, name: str, names: Sequence[str], since: date) -> tuple[DataFrame, DataFrame]:
    """After a merger the parts may not stand for the whole; each is reported once."""
    partial = F.lower(F.trim(F.col(name))).isin([n.lower() for n in names]) & (F.col("period_start") >= F.lit(since))
    partial = F.coalesce(partial, F.lit(False))
    reported = df.filter(partial).select(
        F.concat(F.col(name), F.lit(": part of a merged place only; skipped")).alias("problem")
    )
    return df.filter(~partial), reported.distinct()


def localized(df: DataFrame, lang: str, columns: Sequence[str]) -> DataFrame:
    """Each column's translation where there is one."""
    return df.select(
        *[
            F.coalesce(F.col(f"{c}_{lang}"), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in df.columns
            if not any(c == f"{x}_{lang}" for x in columns)
        ]
    )


def where_optional(df: DataFrame, column: str, value: object | None) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def score_band(score: Column) -> Column:
    out = None
    for floor, name in SCORE_BANDS:
        out = F.when(score >= floor, name) if out is None else out.when(score >= floor, name)
    return out.when(score.isNotNull(), "aspirant")


def band_distribution(scores: DataFrame) -> DataFrame:
    """Places per score band in each peer group."""
    names = [n for _, n in SCORE_BANDS] + ["aspirant"]
    banded = scores.withColumn("band", score_band(F.col("score"))).filter("band is not null")
    return banded.groupBy("peer_group").pivot("band", names).agg(F.count(F.lit(1))).na.fill(0, names)


def aqi_category(value: Column) -> Column:
    out = None
    for top, name in AQI_CATEGORIES:
        out = F.when(value <= top, name) if out is None else out.when(value <= top, name)
    return out.when(value.isNotNull(), "severe")


def category_counts(readings: DataFrame) -> DataFrame:
    return readings.groupBy("day", aqi_category(F.col("value")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def rank_change(current: Column, previous: Column) -> Column:
    """Places gained since the previous edition; NULL when either rank is missing."""
    return previous - current


def filter_cities(cities: DataFrame, parent: str | None = None, million_plus: bool | None = None) -> DataFrame:
    out = where_optional(cities.filter("type = 'city'"), "parent", parent)
    if million_plus is not None:
        out = out.filter((F.col("peer_group") == "million_plus") == F.lit(million_plus))
    return out


def derive_slugs(df: DataFrame, name: str, taken: DataFrame, suffix: str = "-city") -> DataFrame:
    """Slug of each name; one that is taken gets a suffix."""
    slugs = df.withColumn("_slug", slugify(F.col(name)))
    used = taken.select(F.col("slug").alias("_slug"), F.lit(True).alias("_used")).distinct()
    slug = F.when(F.col("_used"), F.concat("_slug", F.lit(suffix))).otherwise(F.col("_slug"))
    return slugs.join(used, "_slug", "left").select(*df.columns, slug.alias("slug"))


def build_roster(
    listed: DataFrame,
    capitals: DataFrame,
    excluded: DataFrame,
    renames: DataFrame,
    previous: DataFrame,
    overrides: DataFrame,
    taken: DataFrame,
    min_population: int = 400_000,
) -> DataFrame:
    """Cities to follow: large enough or a capital, without exclusions, renamed and corrected.

    `listed`: name, parent, population, lat, lon; `capitals`, `excluded`: name, parent; `renames`:
    name, new_name; `previous`: name, parent, slug (kept once given); `overrides`: slug, lat, lon.
    """
    keyed = listed.withColumn("_key", normalize_name(F.col("name")))

    def key_of(df: DataFrame) -> DataFrame:
        return df.select(normalize_name(F.col("name")).alias("_key"), "parent").distinct()

    marked = keyed.join(key_of(capitals).withColumn("is_capital", F.lit(True)), ["_key", "parent"], "left")
    marked = marked.withColumn("is_capital", F.coalesce("is_capital", F.lit(False)))
    chosen = marked.filter((F.col("population") >= min_population) | F.col("is_capital"))
    chosen = chosen.join(key_of(excluded), ["_key", "parent"], "left_anti")
    new_names = renames.select(normalize_name(F.col("name")).alias("_key"), "new_name")
    chosen = chosen.join(new_names, "_key", "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")
    before = previous.select(normalize_name(F.col("name")).alias("_now"), "parent", F.col("slug").alias("_before"))
    slugged = derive_slugs(chosen, "name", taken).withColumn("_now", normalize_name(F.col("name")))
    slugged = slugged.join(before, ["_now", "parent"], "left").withColumn("slug", F.coalesce("_before", "slug"))
    corrected = overrides.select("slug", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    return slugged.join(corrected, "slug", "left").select(
        "slug", "name", "parent", "population", "is_capital",
        F.coalesce("_lat", "lat").alias("lat"), F.coalesce("_lon", "lon").alias("lon"),
    )
