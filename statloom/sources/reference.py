"""Reference tables and landed payloads as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statloom.functions.text import normalize_name
from statloom.operators.skew import newest


def read_reference(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A reference CSV with a fixed schema; an empty field is NULL and a bad row fails the read."""
    return (
        spark.read.schema(schema).option("header", True).option("nullValue", "").option("emptyValue", "")
        .option("mode", "FAILFAST").option("quote", '"').option("escape", '"').csv(path)
    )


def roster_to_places(cities: DataFrame, places: DataFrame, million: int = 1_000_000) -> DataFrame:
    """City rows as places: size class as peer group; an external id shared with the parent is dropped.

    `cities`: slug, name, parent, population, external_id; `places`: slug, external_id, ….
    """
    parent_ids = places.select(F.col("slug").alias("parent"), F.col("external_id").alias("_parent_id"))
    rows = cities.join(parent_ids, "parent", "left")
    as_places = rows.select(
        "slug", "name", F.lit("city").alias("type"),
        F.when(F.col("population") >= million, "million_plus").otherwise("other").alias("peer_group"), "parent",
        "population", F.when(~F.col("external_id").eqNullSafe(F.col("_parent_id")), F.col("external_id")).alias("external_id"),
    )
    return places.unionByName(as_places, allowMissingColumns=True)


def build_lookup(cities: DataFrame, alt_names: list[str], renames: DataFrame) -> DataFrame:
    """(parent, key) -> city from several name columns and former names; the first source wins.

    Twin names ("A-B", "A & B") also count by their parts. `cities`: slug, parent, name columns;
    `renames`: slug, former.
    """
    def keys(name: Column) -> Column:
        return F.concat(F.array(name), F.filter(F.split(name, r"\s*[-–&]\s*"), lambda p: p != name))

    # Priority: position of the name column, then the position of the part in the name.
    own = F.array(*[F.struct(F.lit(i).alias("at"), F.col(c).alias("raw")) for i, c in enumerate(alt_names)])
    former = renames.select("slug", F.struct(F.lit(len(alt_names)).alias("at"), F.col("former").alias("raw")).alias("n"))
    named = cities.select("slug", F.explode(own).alias("n")).unionByName(former).filter("n.raw is not null")
    parts = named.select("slug", "n.at", F.posexplode(keys(F.col("n.raw"))).alias("part", "raw"))
    keyed = parts.join(cities.select("slug", "parent"), "slug").withColumn("key", normalize_name(F.col("raw")))
    ranked = keyed.filter("key <> ''").select(
        "parent", "key", (-F.col("at")).alias("_at"), (-F.col("part")).alias("_part"), F.col("slug").alias("city")
    )
    return newest(ranked, ["parent", "key"], ["_at", "_part"]).select("parent", "key", "city")


PAGE_SCHEMA = "source string, page int, totalPages int, error string, data array<map<string,string>>"


def read_paged(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON pages (one per record); see `complete_pages`."""
    return complete_pages(spark.read.schema(PAGE_SCHEMA).json(path))


def incomplete_sources(pages: DataFrame) -> DataFrame:
    """Sources with an error payload or without every page from 1 to totalPages."""
    distinct = pages.groupBy("source", "page").agg(F.max("totalPages").alias("total"), F.max("error").alias("error"))
    state = distinct.groupBy("source").agg(
        F.max("error").alias("error"), F.max("total").alias("total"),
        F.count_if((F.col("page") >= 1) & (F.col("page") <= F.col("total"))).alias("pages"),
    )
    return state.filter(F.col("error").isNotNull() | (F.col("pages") < F.col("total")))


def complete_pages(pages: DataFrame) -> DataFrame:
    """Rows of all pages; fails the read when a source is incomplete or carries an error."""
    bad = incomplete_sources(pages)
    if not bad.isEmpty():
        raise ValueError("landed pages hold an error or are incomplete; see incomplete_sources()")
    return pages.select("source", "page", F.explode("data").alias("record"))


def sum_nested(df: DataFrame, metrics: str, kind: str) -> Column:
    """Sum of `count` over the entries of one type in an array<struct<type, count>> column."""
    wanted = F.filter(F.col(metrics), lambda m: m["type"] == kind)
    return F.aggregate(wanted, F.lit(0).cast("bigint"), lambda acc, m: acc + m["count"].cast("bigint"))
