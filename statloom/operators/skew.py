"""Order-dependent building blocks that never gather one whole group in one task.

A plain window over a handful of groups sorts each group in a single task. The functions here cut
every group into value buckets first: rows only meet the rows of their own bucket, and what crosses
buckets is a small summary (one row per bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per e-fold of magnitude: values 0.1 % apart fall into different buckets.
RESOLUTION = 1024
# Distinct values of a bucket from which on it is cut again, evenly between its least and greatest value.
BUCKET_VALUES = 10_000


def order_bucket(value: Column, resolution: int = RESOLUTION) -> Column:
    """Bucket number that never falls when the value grows (logarithm and floor are monotone).

    Signs get their own half line; the magnitude is shifted so that every non-zero double has a
    positive logarithm.
    """
    magnitude = F.floor((F.log(F.abs(value)) + 800.0) * resolution).cast("long")
    return F.when(value > 0, magnitude).when(value < 0, -magnitude).otherwise(F.lit(0).cast("long"))


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def value_positions(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with `n` rows, `below` rows smaller and `total` rows in the group.

    Rows are counted per distinct value on the map side, so heavy ties cost nothing. A bucket of very many
    values (an index near 100) is cut into parts; what crosses parts and buckets is one row of each.
    """
    groups = list(groups)
    number = F.col(value).cast("double")
    counts = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n")).withColumn("_bucket", order_bucket(number))
    buckets = counts.groupBy(*groups, "_bucket").agg(
        F.sum("n").alias("_bucket_n"), F.ceil(F.count(F.lit(1)) / BUCKET_VALUES).alias("_parts"), F.min(number).alias("_low"), F.max(number).alias("_high")
    )
    over_buckets = Window.partitionBy(*groups)
    before = F.sum("_bucket_n").over(over_buckets.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bucket_n")
    buckets = buckets.select(
        *groups, "_bucket", "_parts", "_low", "_high", before.alias("_bucket_below"), F.sum("_bucket_n").over(over_buckets).alias("total")
    )
    share = F.floor((number - F.col("_low")) / (F.col("_high") - F.col("_low")) * F.col("_parts")).cast("long")
    part = F.when((F.col("_parts") > 1) & (F.col("_high") > F.col("_low")), F.least(share, F.col("_parts") - 1)).otherwise(F.lit(0).cast("long"))
    cut = counts.alias("c").join(buckets.alias("b"), _same("c", "b", [*groups, "_bucket"])).select(
        *[F.col(f"c.{g}").alias(g) for g in groups], F.col(f"c.{value}").alias(value), "n", F.col("c._bucket").alias("_bucket"),
        part.alias("_part"), "_parts", "_bucket_below", "total",
    )
    inside = Window.partitionBy(*groups, "_bucket", "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("_below", F.sum("n").over(inside) - F.col("n"))
    # Only buckets that were cut have earlier parts: few rows, as a rule none.
    parts = cut.filter("_parts > 1").groupBy(*groups, "_bucket", "_part").agg(F.sum("n").alias("_part_n"))
    over_parts = Window.partitionBy(*groups, "_bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_part_below", F.sum("_part_n").over(over_parts) - F.col("_part_n"))
    joined = cut.alias("c").join(parts.alias("p"), _same("c", "p", [*groups, "_bucket", "_part"]), "left")
    earlier = F.col("_bucket_below") + F.coalesce("_part_below", F.lit(0).cast("long")) + F.col("_below")
    return joined.select(*[F.col(f"c.{c}").alias(c) for c in [*groups, value]], "n", earlier.alias("below"), "total")


def competition_rank(
    df: DataFrame, groups: Sequence[str], value: str, rank: str, descending: bool = True
) -> DataFrame:
    """Adds `rank` (1, 2, 2, 4 …) of each row's value within its group; NULL values get no rank."""
    groups = list(groups)
    places = value_positions(df.filter(F.col(value).isNotNull()), groups, value)
    position = F.col("total") - F.col("below") - F.col("n") if descending else F.col("below")
    places = places.select(
        *[F.col(g).alias(f"_r_{g}") for g in groups], F.col(value).alias("_r_value"), (position + 1).alias(rank)
    )
    condition = F.col(value) == F.col("_r_value")
    for g in groups:
        condition = condition & F.col(g).eqNullSafe(F.col(f"_r_{g}"))
    return df.join(places, condition, "left").drop("_r_value", *[f"_r_{g}" for g in groups])


def values_at(df: DataFrame, groups: Sequence[str], value: str, index: Column, name: str = "slot") -> DataFrame:
    """The values at given 0-based positions of each sorted group.

    `index` is an array<struct<slot, position>> expression over the column `total` (the group size).
    Returns groups, slot, value.
    """
    groups = list(groups)
    places = value_positions(df.filter(F.col(value).isNotNull()), groups, value)
    wanted = places.withColumn("_want", F.explode(index))
    return wanted.filter(
        (F.col("_want.position") >= F.col("below")) & (F.col("_want.position") < F.col("below") + F.col("n"))
    ).select(*groups, F.col("_want.slot").alias(name), F.col(value))


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles, one column per name, without gathering a group."""
    groups = list(groups)
    size = F.col("total")
    slots = []
    for name, q in quantiles.items():
        low = F.floor((size - 1) * F.lit(q)).cast("long")
        slots.append(F.struct(F.lit(f"{name}_low").alias("slot"), low.alias("position")))
        slots.append(
            F.struct(F.lit(f"{name}_high").alias("slot"), F.least(low + 1, size - 1).alias("position"))
        )
    places = value_positions(df.filter(F.col(value).isNotNull()), groups, value)
    picked = places.withColumn("_want", F.explode(F.array(*slots))).filter(
        (F.col("_want.position") >= F.col("below")) & (F.col("_want.position") < F.col("below") + F.col("n"))
    )

    def slot(label: str) -> Column:
        return F.max(F.when(F.col("_want.slot") == label, F.col(value)))

    out = []
    for name, q in quantiles.items():
        position = (F.max("total") - 1) * F.lit(q)
        low, high = slot(f"{name}_low"), slot(f"{name}_high")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return picked.groupBy(*groups).agg(*out)


def neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, payload: Sequence[str]
) -> DataFrame:
    """Adds structs `previous` and `following`: the payload of the rows next in order.

    `bucket` must not fall along the order (for dates: the month). A hot key is cut by bucket; the
    first and last row of every bucket bridge to the neighbouring buckets.
    """
    keys, order, payload = list(keys), list(order), list(payload)
    carried = F.struct(*[F.col(c) for c in payload])
    edge = F.struct(*[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)], *[F.col(c) for c in payload])
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = rows.withColumn("previous", F.lag(carried).over(inside)).withColumn(
        "following", F.lead(carried).over(inside)
    )
    edges = df.withColumn("_bucket", bucket).groupBy(*keys, "_bucket").agg(
        F.min(edge).alias("_first"), F.max(edge).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_bucket")

    def narrowed(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{p}").alias(p) for p in payload]))

    edges = edges.withColumn("_before", F.lag("_last").over(across)).withColumn(
        "_after", F.lead("_first").over(across)
    )
    edges = edges.select(
        *keys, "_bucket", narrowed("_before").alias("_before"), narrowed("_after").alias("_after")
    )
    joined = rows.alias("r").join(edges.alias("e"), _same("r", "e", [*keys, "_bucket"]))
    kept = [F.col(f"r.{c}").alias(c) for c in df.columns]
    return joined.select(
        *kept,
        F.coalesce(F.col("r.previous"), F.col("e._before")).alias("previous"),
        F.coalesce(F.col("r.following"), F.col("e._after")).alias("following"),
    )


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest in `order`, reduced on the map side."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in [*order, *rest]])).alias("_top"))
    return top.select(*[F.col(c) if c in keys else F.col(f"_top.{c}").alias(c) for c in df.columns])


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "position") -> DataFrame:
    """The first k rows of each key. Spark limits each task to k rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
