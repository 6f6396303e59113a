"""Mixing sources to target weights with distributed prefix sums over hash-random keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.session import materialize

#: Documents that a range of keys holds on average.
RANGE_ROWS = 4096


def word_count(text: Column) -> Column:
    """Runs between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def targets(totals: DataFrame, weights: list[float], most: float, budget: Column) -> DataFrame:
    """source, source_size, target of each source.

    `totals` (source, source_size) is one row per source. Sources sorted by code point, null last,
    take the weights in turn and share `budget` by them. A share above `most` times the source's size
    stops there and the excess goes to the others by weight, until none is above: sources sorted by
    size / weight fill in that order, so running sums over the sources find all stops at once. A
    source is above exactly when what is left over those before it, by weight, exceeds its stop.
    """
    placed = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0.0))
    level = (F.lit(1.0) * F.col("budget") - filled) / F.sum("weight").over(onward)
    levels = weighed.withColumn("budget", budget.cast("double")).withColumn("level", level)
    stopped = levels.withColumn("stopped", F.col("level") * F.col("weight") >= most * F.col("source_size"))
    free = F.max(F.when(~F.col("stopped"), F.col("level"))).over(Window.partitionBy())
    return stopped.select(
        "source", "source_size",
        F.when(F.col("stopped"), most * F.col("source_size")).otherwise(free * F.col("weight")).alias("target"),
    )


def mix(
    documents: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), most: float = 3.0, share: float = 1.0, seed: int = 17
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and key of every document.

    Every document gets a hash-random key of (seed, doc_id, text). Within its source the documents lie
    in key order; the source's words are taken in that order, over again for each epoch, and cut at the
    exact budget: floor(target) words. `taken` counts the words of a document that fall into the
    budget, repeats included; the document at the cut counts in part, and none exceeds
    ceil(most) * size. The keys are cut into ranges; sums per (source, range) are added up over the
    ranges and documents are sorted inside a range only, so that a source of any share of the rows
    is spread evenly. Sizes are words; a null text has none and takes none. A null source is a source
    of its own. Ties of the key are rows of one id and text, which are interchangeable. An empty
    table gives no rows. Columns besides doc_id, text and source are ignored.
    """
    sized = documents.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("key"),
    )
    sized = materialize(sized, "sized")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("held"))
    total = F.sum("source_size").over(Window.partitionBy())
    goals = targets(per_source.withColumn("all", total), list(weights), most, share * F.col("all"))
    ranges = per_source.select("source", F.ceil(F.col("held") / RANGE_ROWS).alias("ranges"))
    goals = materialize(goals.alias("g").join(ranges.alias("r"), F.expr("g.source <=> r.source")).select("g.*", "r.ranges"), "targets")

    dealt = sized.alias("d").join(goals.alias("g"), F.expr("d.source <=> g.source")).select("d.*", "g.source_size", "g.target", "g.ranges")
    # The key's place among all keys, as a fraction, picks the range: equal ranges of a hash hold equal shares.
    fraction = F.col("key") / F.lit(2.0**64) + 0.5
    dealt = dealt.withColumn("range", F.least(F.floor(fraction * F.col("ranges")), F.col("ranges") - 1))
    sums = dealt.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"))
    joined = dealt.alias("d").join(offsets.alias("o"), F.expr("d.source <=> o.source and d.range = o.range")).select("d.*", "o.offset")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - F.col("before")))
    return joined.withColumn("before", before).select(
        "doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("bigint").alias("taken"), "key"
    )


def mixed_documents(documents: DataFrame, seed: int = 17, **options: float) -> DataFrame:
    """`documents` that the mix takes, with n_words and taken; repeated rows come as one, their words added up.

    `options` are those of `mix`. The join is on the key and source of a document, which spread its rows evenly.
    """
    mixed = mix(documents, seed=seed, **options).where("taken > 0")
    taken = mixed.groupBy("key", "source").agg(F.max("size").alias("n_words"), F.sum("taken").alias("taken"))
    taken = taken.select(F.col("key").alias("__key"), F.col("source").alias("__source"), "n_words", "taken")
    named = documents.drop("n_words", "taken").withColumn("__key", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))).dropDuplicates(["__key", "doc_id", "source"])
    kept = named.alias("d").join(taken.alias("t"), (F.col("d.__key") == F.col("t.__key")) & F.col("d.source").cast("string").eqNullSafe(F.col("t.__source")))
    return kept.select(*[f"d.{c}" for c in documents.columns if c not in ("n_words", "taken")], "t.n_words", "t.taken")
