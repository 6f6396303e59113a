"""Benchmark decontamination by Wu-Manber multi-pattern search over whole texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.texts import alnum_words
from statloom.session import materialize

#: Bytes of a block: the shift tables and the suffix buckets are keyed by this many bytes.
BLOCK = 12
#: Bytes of item texts that are broadcast at once; more items are searched in further passes.
SHARD_BYTES = 16 << 20

FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<bigint>"


class WuManber:
    """Finds every occurrence of byte patterns in a text.

    Patterns are grouped by the power of two below their length, so that short ones do not shorten
    the shifts of long ones. In a group with shortest pattern m, the shift of a block is how far its
    last place in the first m bytes of any pattern is from m; blocks of no pattern move by
    m - block + 1. A shift of 0 leads to the bucket of patterns whose first m bytes end in the block,
    and these are compared directly.
    """

    def __init__(self, patterns: Iterable[bytes], block: int = BLOCK) -> None:
        groups: dict[int, list[bytes]] = defaultdict(list)
        for p in set(patterns):
            groups[len(p).bit_length()].append(p)
        self.tables = [self._table(group, block) for _, group in sorted(groups.items())]

    @staticmethod
    def _table(patterns: list[bytes], block: int) -> tuple[int, int, dict[bytes, int], dict[bytes, list[bytes]]]:
        m = min(map(len, patterns))
        block = min(block, m)
        shift: dict[bytes, int] = {}
        buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(block, m + 1):
                key = p[end - block : end]
                shift[key] = min(shift.get(key, m), m - end)
            buckets[p[m - block : m]].append(p)
        return m, block, shift, dict(buckets)

    def occurrences(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(start, pattern) of all occurrences, overlapping ones included."""
        n = len(text)
        for m, block, shift, buckets in self.tables:
            far, at = m - block + 1, m
            while at <= n:
                key = text[at - block : at]
                move = shift.get(key, far)
                if not move:
                    for p in buckets[key]:
                        if text.startswith(p, at - m):
                            yield at - m, p
                    move = 1
                at += move


def item_windows(text: str | None, window: int) -> set[bytes]:
    """The windows of an item as searched: words between single spaces, a space at either end."""
    words = alnum_words(text)
    return {b" %b " % b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


def search(documents: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """`documents` with n_words, spans (of hit words, merged, end excluded) and items (sorted ids of items found).

    Words are lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII. A window is
    `window` consecutive words of an item; a shorter item with words is one window; an item without
    words matches nothing. A null text has no words. Items of equal id count as one; a window of an
    item without id hits words but names no item. Rows are neither lost nor moved: repeated rows stay.
    The items are dealt by a hash into as many shards as their bytes need, whatever their number; each
    shard is broadcast on its own, at about `shard_bytes` (one item is never split).
    Columns of `documents` named like the three new ones are replaced.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // shard_bytes) or 1
    kept = documents.drop("n_words", "spans", "items")
    found = kept.select("*", F.lit(None).cast("bigint").alias("n_words"), F.expr("cast(null as array<struct<start:bigint,end:bigint>>) as spans"), F.expr("cast(null as array<bigint>) as items"))
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).collect()
        found = _search_shard(found, [(r.item_id, r.text) for r in part], window)
        if shards > 1:
            found = materialize(found, "decontamination")
    return found


def _search_shard(found: DataFrame, items: list[tuple[int | None, str | None]], window: int) -> DataFrame:
    named: dict[bytes, set[int | None]] = defaultdict(set)
    for item_id, text in items:
        for w in item_windows(text, window):
            named[w].add(item_id)
    table = found.sparkSession.sparkContext.broadcast((WuManber(named), dict(named)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, whose = table.value
        for batch in batches:
            columns = {name: batch[name] for name in batch.schema.names}
            results = [_one(t.as_py(), s.as_py(), i.as_py(), finder, whose) for t, s, i in zip(batch["text"], batch["spans"], batch["items"], strict=True)]
            columns["n_words"] = pa.array([r[0] for r in results], pa.int64())
            columns["spans"] = pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in results], batch.schema.field("spans").type)
            columns["items"] = pa.array([r[2] for r in results], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return found.mapInArrow(run, found.schema)


def _one(text: str | None, spans: list[dict] | None, items: list[int] | None, finder: WuManber, whose: dict) -> tuple[int, list[tuple[int, int]], list[int]]:
    words = alnum_words(text)
    line = b" %b " % b" ".join(words)
    marks, names = [(s["start"], s["end"]) for s in spans or ()], set(items or ())
    starts = None
    for at, pattern in finder.occurrences(line) if words else ():
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        first = int(np.searchsorted(starts, at))
        marks.append((first, first + pattern.count(b" ") - 1))
        names |= whose[pattern]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(marks):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return len(words), merged, sorted(names - {None})


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of the rows of `search`."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    joined = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def clean(found: DataFrame) -> DataFrame:
    """The rows of `search` without a hit, as they came."""
    return found.where(F.size("spans") == 0).drop("n_words", "spans", "items")
