"""Periodic runs of words, found on a Re-Pair grammar of the word ids."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.texts import CACHE_WORDS, CHUNK_WORDS, mix

#: A run is at least this many words long (fixed values of the contract), and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Odd multiplier of the rolling hash that strikes periods out; what it lets through is compared word by word.
BASE = np.uint64(0x9E3779B97F4A7C15)


class WordIds(dict):
    """A number for every word, remembered for some chunks."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word ids, by start and period.

    A run is a stretch with smallest period q and at least max(6, 4 q) long that no neighbour extends.
    """
    found: list[tuple[int, int, int]] = []
    for low, high in stretches(ids, np.zeros(len(ids), np.int64)):
        found += [(low + s, e, q) for s, e, q in _grammar_runs(ids[low:high])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ids: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a sequence of texts (`text` numbers the text of each word) outside of which no run can lie.

    Three words in a row inside a run come back within it a period away, which is a quarter of the run at most.
    So a stretch goes on while three words come back, before or after, at a distance of at most a quarter of
    the stretch; cutting and measuring go on until nothing changes. Nothing is lost by it: a run lies in one stretch.
    """
    n = len(ids) - 2
    if n < LEAST_WORDS - 2:
        return []
    grams = mix(mix(mix(ids[:-2].astype(np.uint64)) + ids[1:-1].astype(np.uint64)) + ids[2:].astype(np.uint64)) + text[:-2].astype(np.uint64) * BASE
    order = np.argsort(grams, kind="stable")
    gap = np.diff(order)
    gap[grams[order[1:]] != grams[order[:-1]]] = n + 2
    nearest = np.full(n, n + 2)
    nearest[order[1:]] = gap
    nearest[order[:-1]] = np.minimum(nearest[order[:-1]], gap)
    nearest[text[2:] != text[:-2]] = n + 2
    fine = nearest <= n
    while True:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], fine.view(np.int8), [0]])))
        low, high = edges[::2], edges[1::2]
        width = high - low + 2
        enough = width >= LEAST_WORDS
        reach = np.repeat(np.where(enough, width, 0), high - low)
        keep = nearest[fine] * LEAST_PERIODS <= reach
        if keep.all():
            return list(zip(low.tolist(), (high + 2).tolist(), strict=True))
        fine[np.flatnonzero(fine)[~keep]] = False


def repair(ids: list[int]) -> tuple[list[tuple[int, int]], list[int], int]:
    """Re-Pair: (left, right) of every rule in the order they were made, the sequence that is left, the first rule's symbol.

    The most frequent pair of neighbours becomes a new symbol, over and over, until no pair occurs twice; of
    equally frequent pairs the one seen first goes first, which keeps the grammar flat. Links between neighbours
    and lists of places make the whole about linear.
    """
    n = len(ids)
    first = max(ids, default=-1) + 1
    symbol, before, after = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in range(n - 1):
        places[symbol[i], symbol[i + 1]].append(i)
    # Pairs by their number of places, which only falls once a pair is listed: a stale number is listed again lower.
    listed: dict[int, deque] = defaultdict(deque)
    top = 0
    for pair, at in places.items():
        if len(at) > 1:
            listed[len(at)].append(pair)
            top = max(top, len(at))
    rules: list[tuple[int, int]] = []
    while top > 1:
        if not listed[top]:
            top -= 1
            continue
        pair = listed[top].popleft()
        a, b = pair
        live, end = [], -1
        for i in places.pop(pair, ()):
            if i >= end and symbol[i] == a and after[i] < n and symbol[after[i]] == b:
                live.append(i)
                end = after[after[i]] if a == b else end
        if len(live) < 2:
            continue
        if len(live) < top:
            places[pair] = live
            listed[len(live)].append(pair)
            continue
        new = first + len(rules)
        rules.append(pair)
        fresh: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in live:
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                fresh[new, symbol[k]].append(i)
            if (h := before[i]) >= 0:
                fresh[symbol[h], new].append(h)
        for made, at in fresh.items():
            if len(at) > 1:
                places[made] = at
                listed[len(at)].append(made)
                top = max(top, len(at))
    left, i = [], 0
    while i < n:
        left.append(i)
        i = after[i]
    return rules, [symbol[i] for i in left], first


def _grammar_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of one stretch: those across the boundary of every symbol of its grammar, at all places of the symbol."""
    n = len(ids)
    _, small = np.unique(ids, return_inverse=True)
    rules, sequence, first = repair(small.tolist())
    # What is left of the text is one more rule, cut in halves, so that every boundary belongs to a symbol.
    queue = sequence
    while len(queue) > 1:
        paired = [first + len(rules) + k for k in range(len(queue) // 2)]
        rules += list(zip(queue[0::2], queue[1::2], strict=False))
        queue = paired + queue[len(queue) // 2 * 2 :]
    widths = [1] * first
    for a, b in rules:
        widths.append(widths[a] + widths[b])
    # Places of every symbol, from the top down.
    places: list[list] = [[] for _ in widths]
    if queue:
        places[queue[0]].append(np.zeros(1, np.int64))
    look = _Stretch(small)
    crossing: dict[int, list[np.ndarray]] = defaultdict(list)
    for s in range(len(widths) - 1, first - 1, -1):
        if widths[s] < LEAST_WORDS:
            continue
        at = np.concatenate(places[s])
        places[s] = []
        a, b = rules[s - first]
        if widths[a] >= LEAST_WORDS:
            places[a].append(at)
        if widths[b] >= LEAST_WORDS:
            places[b].append(at + widths[a])
        here = int(at[0])
        for start, end, q in look.across(here, here + widths[a], here + widths[s]):
            crossing[q].append(np.stack([at + (start - here), at + (end - here)], axis=1))
    return [run for q, spans in crossing.items() for run in _merged(np.concatenate(spans), q)]


def _merged(spans: np.ndarray, q: int) -> list[tuple[int, int, int]]:
    """Maximal intervals of one period: two that share at least a period are parts of one run."""
    spans = spans[np.lexsort((-spans[:, 1], spans[:, 0]))]
    ends = np.maximum.accumulate(spans[:, 1])
    opens = np.flatnonzero(np.concatenate([[True], spans[1:, 0] + q > ends[:-1]]))
    closes = np.concatenate([opens[1:] - 1, [len(spans) - 1]])
    return [(int(s), int(e - s), q) for s, e in zip(spans[opens, 0], ends[closes], strict=True)]


class _Stretch:
    """A sequence with what it takes to find runs across a boundary inside any part of it."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, n = ids, len(ids)
        values = mix(ids.astype(np.uint64) + np.uint64(1))
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))
        # sums[i] = sum of values[k] * BASE**k for k < i: equal blocks differ by a power of BASE only.
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * self.powers[:-1])])
        # Places of equal pairs of words, in order: a boundary's candidates are slices of it.
        pairs = ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:]
        self.order = np.argsort(pairs, kind="stable")
        self.rank = np.empty(n - 1, np.int64)
        self.rank[self.order] = np.arange(n - 1)
        sorted_pairs = pairs[self.order]
        edges = np.flatnonzero(np.concatenate([[True], sorted_pairs[1:] != sorted_pairs[:-1], [True]]))
        group = np.cumsum(np.concatenate([[0], sorted_pairs[1:] != sorted_pairs[:-1]]))[self.rank]
        self.first, self.last = edges[group].tolist(), edges[group + 1].tolist()
        self.rank = self.rank.tolist()

    def same(self, i: np.ndarray | int, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the blocks at i and j > i are equal, by hash."""
        x, y = self.sums[i + length] - self.sums[i], self.sums[j + length] - self.sums[j]
        return x * self.powers[j - i] == y

    def extent(self, q: int, at: int, low: int, high: int) -> tuple[int, int]:
        """The widest [start, end) in [low, high) around `at` (where words at and at + q are equal) with period q."""
        end = at
        step = 64
        while end + q < high:
            unequal = np.flatnonzero(self.ids[end : min(end + step, high - q)] != self.ids[end + q : min(end + q + step, high)])
            if len(unequal):
                end += int(unequal[0])
                break
            end, step = min(end + step, high - q), step * 2
        start, step = at, 64
        while start > low:
            back = max(low, start - step)
            unequal = np.flatnonzero(self.ids[back:start] != self.ids[back + q : start + q])
            if len(unequal):
                start = back + int(unequal[-1]) + 1
                break
            start, step = back, step * 2
        return start, end + q

    def across(self, low: int, cut: int, high: int) -> list[tuple[int, int, int]]:
        """(start, end, period) of runs within [low, high), maximal there, that hold the words on both sides of `cut`.

        A run of four periods has two of them on one side of the cut. If on the right, the pair of words at the
        cut comes back one period later, with the whole period before it; if on the left, one period earlier. So
        candidates are places of that pair, struck out by comparing blocks of a period by hash. A candidate whose
        two periods lie inside a run of a smaller period is a repetition of that one and no run of its own.
        """
        found: list[tuple[int, int, int]] = []
        pair = cut - 1
        rank, order = self.rank[pair], self.order
        most = (high - low) // LEAST_PERIODS
        limit = min(most, (high - cut) // 2)
        right = order[rank + 1 : self.last[pair]]
        if limit and len(right) and right[0] - pair <= limit:
            periods = right[: np.searchsorted(right, pair + limit, "right")] - pair
            periods = periods[self.same(pair, pair + periods, periods + 1)]
            while len(periods):
                q = int(periods[0])
                start, end = self.extent(q, pair, low, high)
                if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
                    found.append((start, end, q))
                    periods = periods[cut + 2 * periods > end]
                periods = periods[periods > q]
        limit = min(most, (cut - low) // 2)
        left = order[self.first[pair] : rank]
        if limit and len(left) and pair - left[-1] <= limit:
            periods = pair - left[np.searchsorted(left, pair - limit) :][::-1]
            periods = periods[self.same(cut - 2 * periods, cut - periods, periods + 1)]
            for start, _, q in found:
                periods = periods[(periods < q) | (cut - 2 * periods < start)]
            while len(periods):
                q = int(periods[0])
                start, end = self.extent(q, cut - 2 * q, low, high)
                if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
                    if (start, end, q) not in found:
                        found.append((start, end, q))
                    periods = periods[cut - 2 * periods < start]
                periods = periods[periods > q]
        return found


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document; of one id in ten, those from some place on repeat a period."""
    hashed = zlib.crc32(str(doc_id).encode()) if doc_id is not None and words else 1
    if hashed % 10:
        return words
    g = hashed // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(len(words) - a)]


FOUND = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def collapse(documents: DataFrame, plant: bool = False, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_runs, the longest run, digests of all runs and of the words that stay; with the texts on request.

    Words are runs between ASCII white space. A run is a stretch of consecutive words with smallest period q, at
    least max(6, 4 q) words long, that no neighbouring word extends. All words of a run after its first period go.
    With `plant`, the words of one document in ten (by the crc32 of its id) are first made periodic from some
    place on. `keep_text` adds `runs` (start, length, period) and `collapsed`, the words that stay. Every row has
    a result of its own, repeated ids and rows included; a null or empty text has no words and no runs, a null id
    has no planted words. Other columns are ignored; an empty table gives no rows. No row needs another: nothing
    is shuffled, and a task holds a bounded number of words, a single longer text aside.
    """
    extra = ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string" if keep_text else ""
    schema = f"doc_id bigint, n_words bigint, {FOUND}{extra}"

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordIds()
        for batch in batches:
            yield from _collapsed(batch, numbers, plant, keep_text)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def _collapsed(batch: pa.RecordBatch, numbers: WordIds, plant: bool, keep_text: bool) -> Iterator[pa.RecordBatch]:
    doc_ids = batch["doc_id"].to_pylist()
    start = 0
    while start < len(doc_ids):
        words: list[list[bytes]] = []
        held, end = 0, start
        while end < len(doc_ids) and (held < CHUNK_WORDS or end == start):
            text = batch["text"][end].as_py()
            words.append(text.encode("utf-8", "surrogatepass").split() if text else [])
            held, end = held + len(words[-1]), end + 1
        yield _chunk(doc_ids[start:end], words, numbers, plant, keep_text)
        start = end


def _chunk(doc_ids: list[int | None], words: list[list[bytes]], numbers: WordIds, plant: bool, keep_text: bool) -> pa.RecordBatch:
    if len(numbers) > CACHE_WORDS:
        numbers.clear()
    if plant:
        words = [planted(w, doc_id) for w, doc_id in zip(words, doc_ids, strict=True)]
    lengths = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    text_of = np.repeat(np.arange(len(words)), lengths)
    for low, high in stretches(ids, text_of):
        k = int(text_of[low])
        found[k] += [(int(low - offsets[k]) + s, length, q) for s, length, q in _grammar_runs(ids[low:high])]
    rows = []
    for k, doc_id in enumerate(doc_ids):
        runs = sorted(found.get(k, ()), key=lambda r: (r[0], r[2]))
        kept = words[k]
        if runs:
            change = np.zeros(len(kept) + 1, np.int64)
            for s, length, q in runs:
                change[s + q] += 1
                change[s + length] -= 1
            kept = [kept[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        collapsed = b" ".join(kept)
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
        row = (doc_id, len(words[k]), len(runs), s, length, q, 1000 * length // q if runs else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(collapsed).hexdigest())
        if keep_text:
            row += ([{"start": s, "length": length, "period": q} for s, length, q in runs], collapsed.decode("utf-8", "surrogatepass"))
        rows.append(row)
    big, text = pa.int64(), pa.string()
    kinds = [big] * 7 + [text] * 2
    names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    if keep_text:
        kinds += [pa.list_(pa.struct([("start", big), ("length", big), ("period", big)])), text]
        names += ["runs", "collapsed"]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)
