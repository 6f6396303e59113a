"""How filters interact: what each removes after which others, from tables of failing ids."""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text: few words, few distinct words, capitals, symbols."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failing_ids(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The stored rows of `documents` (row, part, good, toxic) and, per filter, the stored table of those that fail it.

    `part` is lang (null: empty string). Filters A to D look at a row's own text (null: empty); E fails a row
    whose text is also that of a smaller doc_id anywhere in the table. Each row has a number of its own, so that
    repeated rows count as often as they stand there and a null doc_id (which has no labels, and is smaller than
    none) is a row like any other. Of repeated labels of a doc_id one with quality 1 or toxic 1 is enough. Other
    columns are ignored; empty tables give empty tables.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    worded = plain.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    own = text_failures(F.col("text"), F.col("words"))
    told = worded.select("doc_id", "part", F.sha2("text", 256).alias("digest"), *[c.alias(name) for name, c in own.items()])
    labelled = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic")
    )
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    facts = told.join(labelled, "doc_id", "left").select("doc_id", "part", "digest", *own, *flags)
    facts = materialize(facts.withColumn("row", F.monotonically_increasing_id()), "facts")

    # Of equal texts only the ends matter; a text that one doc_id has alone joins with nothing.
    seen = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    seen = materialize(seen.where("first < last").select("digest", "first"), "repeated")
    fails = {name: facts.where(name) for name in own} | {"E": facts.join(seen, "digest").where("doc_id > first")}
    ids = ["row", "part", "good", "toxic"]
    return facts.select(ids), {name: materialize(df.select(ids), f"fails-{name}") for name, df in fails.items()}


def audit(ids: DataFrame, failing: dict[str, DataFrame], orders: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """part, filter_order, step, filter and the counts of every step of every order, zeros included.

    `ids` has (row, part) of every row, `failing` per filter the rows (row, part, good, toxic) that fail it. What a
    step removes depends on the set of filters before it, not on their order. A failing row is tried under every
    set that lacks its filter: the left-anti join with the rows that fail a filter of the set leaves what the step
    removes, the left-semi join what an earlier filter has removed already. Both meet on `row`, by which the ids are
    dealt once, before sets are tried; the sets (2^(filters - 1), so a dozen filters at most) are never shuffled.

    kept: rows of the part after the step; removed: here; redundant: failing, but removed earlier; unique_fails:
    failing this filter only; good_lost, toxic_lost: labelled rows among the removed; shapley: removed by this
    filter, added up over all the orders.
    """
    names = list(failing)
    bits = {name: 1 << i for i, name in enumerate(names)}
    every = (1 << len(names)) - 1
    fails = None
    for name, df in failing.items():
        marked = df.select("row", "part", "good", "toxic", F.lit(bits[name]).alias("bit"))
        fails = marked if fails is None else fails.unionByName(marked)
    sets = F.filter(F.sequence(F.lit(0), F.lit(every)), lambda p: p.bitwiseAND(F.col("bit")) == 0)
    tried = fails.repartition("row").withColumn("before", F.explode(sets)).alias("t")
    others = fails.select("row", F.col("bit").alias("other")).alias("o")
    earlier = (F.col("t.row") == F.col("o.row")) & (F.col("t.before").bitwiseAND(F.col("o.other")) != 0)
    key = ["part", "bit", "before"]
    removed = tried.join(others, earlier, "left_anti").groupBy(*key).agg(
        F.count("*").alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost")
    )
    redundant = tried.join(others, earlier, "left_semi").groupBy(*key).agg(F.count("*").alias("redundant"))

    steps = []
    for order in permutations(names) if orders is None else orders:
        before = 0
        for step, name in enumerate(order, 1):
            steps.append({"filter_order": "".join(order), "step": step, "filter": name, "bit": bits[name], "before": before})
            before |= bits[name]
    grid = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, filter string, bit int, before int>>")
    parts = ids.groupBy("part").agg(F.count("*").alias("total"))
    told = parts.select("part", "total", F.inline(grid)).join(removed, key, "left").join(redundant, key, "left")
    told = told.na.fill(0, ["removed", "redundant", "good_lost", "toxic_lost"])
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    alone = removed.where((F.col("before") + F.col("bit")) == every).select("part", "bit", F.col("removed").alias("unique_fails"))
    shares = told.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return told.withColumn("kept", F.col("total") - F.sum("removed").over(so_far)).join(alone, ["part", "bit"], "left").join(shares, ["part", "bit"]).select(
        "part", "filter_order", "step", "filter", "kept", "removed", "redundant",
        F.coalesce("unique_fails", F.lit(0)).cast("bigint").alias("unique_fails"), "good_lost", "toxic_lost", "shapley",
    )
