"""N-gram Jaccard join by prefix filters under several global token orders."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.bitmaps import holds, marked, spread
from statloom.llm.components import connected_components
from statloom.llm.texts import WordHashes, mix, shingle_sets
from statloom.session import materialize

#: Seeds of the global orders. The first one makes the candidates, the others must agree.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Frequent tokens that are told apart by their count; it bounds a broadcast and changes no result.
RANKED_TOKENS = 1 << 18
#: Nodes of a token up to which its pairs are listed; those of larger ones all join one family.
SMALL_BLOCK = 128
#: The first order starts with the tokens of a share of all hashes, which are counted one by one: this many times what a
#: prefix takes, so that prefixes hold the rarest of them.
SCOUTED = 2.5
#: Counts at which a counted token stands in a later class of the first order.
LEVELS = (2, 4, 16, 64)
#: Bits of a class's bitmap (8 MB each, whatever the size of the input), and buckets in which tokens are counted.
SLOT_BITS, BUCKET_BITS = 26, 10
#: Tokens, and nodes, that make one side of a tile.
TILE_TOKENS, TILE_NODES = 1 << 19, 1024
#: Tokens after which a task reports those of the counted share, and which others it saw often.
COUNTED_TOKENS = 1_500_000

SUMMARY = "doc_id bigint, n bigint, node binary, texthash bigint, rowhash bigint, bucket int, tokens binary, counts binary"


def component_table(documents: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Two documents link when 100 * |intersection| >= percent * |union| of their distinct `width`-word
    shingles; component_id is the smallest doc_id reachable by links. Documents of equal sets are one
    node of the graph. Under each global order (frequent tokens last, the rest by a seeded hash; the
    first one starts with counted tokens, the rarest first) a pair that links shares a token of both prefixes. Candidates come from the first order and must fit
    in size and position; they tie nodes into families, and inside a family only pairs that all
    orders agree on are verified on their whole sets.
    Null or empty texts have an empty set, link with nothing and keep their own doc_id (which may be
    null). Repeated rows and repeated ids stay rows of their own; null ids never become a component
    id unless a component has no other. Other columns of `documents` are ignored.
    """
    rows, placed = _placed(documents, width, percent)
    found = rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(placed.select("node", "component_id"), "node", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """`documents` with one row of every component: that of its smallest doc_id (null last, then by text).

    Rows without words are linked with nothing and all stay. Of rows that repeat the id and text that
    stays, one stays.
    """
    rows, placed = _placed(documents, width, percent)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "texthash", "rowhash")
    first = rows.join(placed.select("node", "label"), "node").groupBy("label").agg(F.min(order).alias("kept"))
    keys = first.select("kept.texthash", "kept.rowhash").withColumn("held", F.lit(True))
    keyed = documents.withColumns({"__texthash": F.xxhash64(F.col("text").cast("string")), "__rowhash": _rowhash()})
    words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    kept = keyed.where(words).join(keys, (F.col("__texthash") == F.col("texthash")) & (F.col("__rowhash") == F.col("rowhash")), "left_semi")
    kept = kept.dropDuplicates(["__texthash", "__rowhash"])
    return kept.unionByName(keyed.where(~words)).drop("__texthash", "__rowhash")


def _rowhash() -> F.Column:
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def _placed(documents: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """A row (doc_id, n, node, texthash, rowhash) per document, and (node, label, component_id) per distinct set."""
    data = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), _rowhash().alias("rowhash"))
    data = data.withColumn("texthash", F.xxhash64("text"))
    stored = materialize(data.mapInArrow(lambda batches: _summaries(batches, width, percent), SUMMARY), "shingles")
    rows = stored.where("n is not null").select("doc_id", "n", "node", "texthash", "rowhash")
    ranked = _ranked(stored.where("n is null"))
    known = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("texthash").alias("texthash"), F.first("n").alias("n"))
    families = _families(data, ranked, width, percent)
    links = _links(data, materialize(known.join(families, "node"), "wanted"), ranked, width, percent)
    nodes = known.join(connected_components(links), "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows, nodes.join(least, "label").select("node", "label", "component_id")


def _node(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _scouted(mixed: np.ndarray, percent: int) -> np.ndarray:
    """Whether tokens, mixed with the seed of the first order, are of the share that is counted."""
    return mixed <= np.uint64(min(2**64 - 1, int(SCOUTED * (1 - percent / 100) * 2**64)))


def _half(tokens: np.ndarray) -> np.ndarray:
    """The upper half of tokens, by which they are counted: two tokens of one half only look more frequent."""
    return (tokens >> np.uint64(32)).astype(np.uint32)


def _counted(halves: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct halves, and the sum of their counts (1 each if there are none)."""
    order = np.argsort(halves, kind="stable") if counts is not None else None
    halves = np.sort(halves) if order is None else halves[order]
    first = np.flatnonzero(np.concatenate(([True], halves[1:] != halves[:-1]))) if len(halves) else np.empty(0, np.int64)
    if order is None or not len(halves):
        return halves[first], np.diff(first, append=len(halves))
    return halves[first], np.add.reduceat(counts[order].astype(np.int64), first)


def _summaries(batches: Iterable[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows without n that hold tokens by bucket: all of the counted share, of the others those that many of a task's documents have."""
    hashes, held, seen, documents = WordHashes(), [], 0, 0

    def often() -> pa.RecordBatch:
        tokens = np.concatenate(held)
        held.clear()
        all_of = _scouted(mix(tokens ^ np.uint64(ORDERS[0])), percent)
        halves, counts = _counted(_half(tokens[all_of]))
        others, theirs = _counted(_half(tokens[~all_of]))
        keep = theirs >= max(3, documents // 2000)
        halves, counts = np.concatenate([halves, others[keep]]), np.concatenate([counts, theirs[keep]])
        order = np.argsort(halves, kind="stable")
        halves, counts = halves[order], np.minimum(counts[order], 65535).astype(np.uint16)
        cuts = np.searchsorted(halves, np.arange(1 << BUCKET_BITS, dtype=np.uint32) << np.uint32(32 - BUCKET_BITS))
        cuts = [*cuts.tolist(), len(halves)]
        return _batch([(*[None] * 5, i, halves[x:y].tobytes(), counts[x:y].tobytes()) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x])

    for batch in _slices(batches):
        rows = []
        sets = shingle_sets((x.as_py() for x in batch["text"]), width, hashes)
        for doc_id, texthash, rowhash, tokens in zip(*(batch[c].to_pylist() for c in ("doc_id", "texthash", "rowhash")), sets, strict=True):
            rows.append((doc_id, len(tokens), _node(tokens) if len(tokens) else None, texthash, rowhash, None, None, None))
            held.append(tokens)
            seen, documents = seen + len(tokens), documents + 1
            if seen >= COUNTED_TOKENS:
                yield often()
                seen = documents = 0
        if rows:
            yield _batch(rows)
    if seen:
        yield often()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    names = ["doc_id", "n", "node", "texthash", "rowhash", "bucket", "tokens", "counts"]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _ranked(reports: DataFrame) -> tuple[Broadcast, Broadcast, Broadcast]:
    """The most frequent tokens (halves, sorted), their counts, and a bitmap for each of LEVELS of the tokens seen that often.

    At most RANKED_TOKENS, as many of every bucket, and bitmaps of fixed size, whatever the size of the input.
    """
    slots, top = 1 << (SLOT_BITS - BUCKET_BITS), RANKED_TOKENS >> BUCKET_BITS

    def count(table: pa.Table) -> pa.Table:
        halves, seen = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[c]]) for c, kind in (("tokens", np.uint32), ("counts", np.uint16)))
        halves, seen = _counted(halves, seen)
        at, bits = (halves >> np.uint32(32 - SLOT_BITS)) & np.uint32(slots - 1), np.zeros((len(LEVELS), slots), bool)
        for mine, level in zip(bits, LEVELS, strict=True):
            mine[at[seen >= level]] = True
        often = np.flatnonzero(seen >= 3)
        often = np.sort(often[np.lexsort((halves[often], -seen[often]))[:top]])
        told = table["bucket"][0].as_py(), np.packbits(bits, bitorder="little").tobytes(), halves[often].tobytes(), seen[often].tobytes()
        return pa.table({"bucket": pa.array([told[0]], pa.int32())} | {c: pa.array([x], pa.binary()) for c, x in zip(("levels", "tokens", "counts"), told[1:], strict=True)})

    counted = reports.select("bucket", "tokens", "counts").groupBy("bucket").applyInArrow(count, "bucket int, levels binary, tokens binary, counts binary").toArrow()
    bits = np.zeros((len(LEVELS), 1 << BUCKET_BITS, slots // 8), np.uint8)
    for bucket, levels in zip(counted["bucket"].to_pylist(), counted["levels"], strict=True):
        bits[:, bucket] = np.frombuffer(levels.as_buffer(), np.uint8).reshape(len(LEVELS), -1)
    tokens, counts = (np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in counted[c])]) for c, kind in (("tokens", np.uint32), ("counts", np.int64)))
    order = np.argsort(tokens)
    context = reports.sparkSession.sparkContext
    return tuple(context.broadcast(x) for x in (tokens[order].astype(np.uint64), counts[order].astype(np.uint64), bits.reshape(len(LEVELS), -1)))


def _level(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """How many of LEVELS each token of the counted share may have reached: 0 only for tokens of a single document."""
    at = tokens >> np.uint64(64 - SLOT_BITS)
    return sum((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 for bits in levels)


def prefix(tokens: np.ndarray, seed: int, percent: int, ranked: tuple[np.ndarray, np.ndarray], levels: np.ndarray | None = None) -> np.ndarray:
    """The first n - ceil(percent * n / 100) + 1 tokens of a set under one global order.

    With `levels` the counted share comes first, by level and count; then, and without, the others by count.
    """
    known, counts = ranked
    n = len(tokens)
    take, mixed = n + (-percent * n // 100) + 1, mix(tokens ^ np.uint64(seed))
    first = _scouted(mixed, percent) if levels is not None else None
    if first is not None and np.count_nonzero(first) >= take:
        tokens, mixed, first = tokens[first], mixed[first], first[first]
    often = np.zeros(len(tokens), np.uint64)
    if len(known):
        halves = tokens >> np.uint64(32)
        at = np.minimum(np.searchsorted(known, halves), len(known) - 1)
        often = np.where(known[at] == halves, counts[at], often)
    if first is not None:
        often |= np.where(first, _level(tokens, levels).astype(np.uint64), np.uint64(len(LEVELS) + 1)) << np.uint64(56)
    return tokens[np.lexsort((mixed, often))[:take]]


def _families(data: DataFrame, ranked: tuple[Broadcast, Broadcast, Broadcast], width: int, percent: int) -> DataFrame:
    """(node, family) of every node that has a candidate under the first order; candidates share their family.

    Pairs of tokens that few nodes hold are counted: sharing one token of the prefixes is not enough
    where the sizes ask for more. Nodes of a token that many hold all join the family of the smallest.
    Tokens counted once are in no other document and are not written.
    """

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, levels = WordHashes(), (ranked[0].value, ranked[1].value), ranked[2].value
        for batch in _slices(batches):
            sets = [s for s in shingle_sets((x.as_py() for x in batch["text"]), width, hashes) if len(s)]
            if not sets:
                continue
            found = [prefix(s, ORDERS[0], percent, known, levels) for s in sets]
            lengths, tokens = [len(p) for p in found], np.concatenate(found)
            again = ~_scouted(mix(tokens ^ np.uint64(ORDERS[0])), percent) | (_level(tokens, levels) > 0)
            whose = pa.array(np.repeat(np.arange(len(sets)), lengths)[again])
            node, n = (pa.array(c, t).take(whose) for c, t in (([_node(s) for s in sets], pa.binary()), ([len(s) for s in sets], pa.int64())))
            columns = [tokens[again].view(np.int64), node, n, np.concatenate([np.arange(x) for x in lengths])[again]]
            yield pa.RecordBatch.from_arrays(columns, ["token", "node", "n", "place"])

    postings = materialize(data.select("text").mapInArrow(post, "token bigint, node binary, n bigint, place bigint"), "postings")
    shared = materialize(postings.groupBy("token").agg(F.count("*").alias("held")).where("held > 1").select("token"), "shared")
    members = holds(postings, "token", spread(shared, "token")).join(shared, "token", "left_semi")
    members = materialize(members.groupBy("token", "node").agg(F.first("n").alias("n"), F.first("place").alias("place")), "members")
    blocks = members.groupBy("token").agg(F.count("*").alias("held"), F.min("node").alias("pivot")).where("held > 1")
    placed = members.join(blocks, "token")

    small = placed.where(F.col("held") <= SMALL_BLOCK).select("token", "node", "n", "place")
    a, b = (small.select("token", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "place"))) for side in "ab")
    sizes = F.expr(f"node_a < node_b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    shared = a.join(b, "token").where(sizes).groupBy("node_a", "node_b")
    shared = shared.agg(F.count("*").alias("c"), *(F.max(x).alias(x) for x in ("place_a", "place_b", "n_a", "n_b")))
    # What can be common: the shared prefix tokens, and after the last of them (or after the prefix that
    # ends first) no more than either set has left.
    most = f"c + least(n_a - place_a - 1, n_b - place_b - 1, ({percent} * greatest(n_a, n_b) + 99) div 100 - 1)"
    listed = shared.where(F.expr(f"{100 + percent} * ({most}) >= {percent} * (n_a + n_b)")).selectExpr("node_a as a", "node_b as b")
    starred = placed.where((F.col("held") > SMALL_BLOCK) & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    return connected_components(listed.unionByName(starred)).withColumnRenamed("label", "family")


def _links(data: DataFrame, wanted: DataFrame, ranked: tuple[Broadcast, Broadcast, Broadcast], width: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes: of every tile a spanning forest of its links.

    A family is dealt into parts of bounded size by a hash of the node; every pair of parts is a group
    of its own, so that no task holds more than two parts however large the family is.
    """

    may = spread(wanted, "texthash")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, met = WordHashes(), set()
        for batch in _slices(batches):
            batch = batch.filter(marked(batch["texthash"], may))
            new = [i for i, h in enumerate(batch["texthash"].to_pylist()) if h not in met and not met.add(h)]
            texts = batch["text"].take(pa.array(new, pa.int64()))
            tokens = [s.tobytes() for s in shingle_sets((x.as_py() for x in texts), width, hashes)]
            yield pa.RecordBatch.from_arrays([batch["texthash"].take(pa.array(new, pa.int64())), pa.array(tokens, pa.binary())], ["texthash", "tokens"])

    found = data.select("text", "texthash").mapInArrow(sets, "texthash bigint, tokens binary").groupBy("texthash").agg(F.first("tokens").alias("tokens"))
    parts = wanted.groupBy("family").agg(F.ceil(F.greatest(F.sum("n") / TILE_TOKENS, F.count("*") / TILE_NODES)).alias("parts"))
    dealt = wanted.select("texthash", "node", "family").join(parts, "family").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    placed = found.join(dealt, "texthash").select("family", "node", "tokens", "part", every.alias("other"))
    tiles = placed.select("family", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "node", "tokens")

    def compare(table: pa.Table) -> pa.Table:
        links = _tile(table, (ranked[0].value, ranked[1].value), percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    return tiles.groupBy("family", "x", "y").applyInArrow(compare, "a binary, b binary")


def _tile(table: pa.Table, known: tuple[np.ndarray, np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between the nodes of one tile."""
    nodes = table["node"].to_pylist()
    sets = [np.frombuffer(t.as_py(), np.uint64) for t in table["tokens"]]
    sizes = np.array([len(s) for s in sets], np.int32)
    root = np.arange(len(nodes))
    may = np.ones((len(nodes), len(nodes)), bool)
    for seed in ORDERS:
        may &= _overlaps([prefix(s, seed, percent, known) for s in sets]) > 0
    may = np.triu(may, 1) & (100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes))
    links = []
    # Whole sets are intersected for pairs that all orders agree on and that no links tie yet.
    for i in np.flatnonzero(may.any(axis=1)):
        others = np.flatnonzero(may[i] & (root != root[i]))
        for j, both in zip(others, _common(sets[i], [sets[j] for j in others]), strict=True):
            if root[i] != root[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links.append((nodes[i], nodes[j]))
                root[root == root[j]] = root[i]
    return links


def _common(one: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """Sizes of the intersections of a set with each of others, none of them empty."""
    if not others:
        return []
    one, tokens = np.sort(one), np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, tokens), len(one) - 1)] == tokens
    return np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *map(len, others[:-1])])).tolist()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of membership columns, a bounded number of columns at a time."""
    tokens, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    whose = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.cumsum(held > 1) - 1
    keep = held[column] > 1
    whose, column = whose[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    whose, column = whose[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    step = 2048
    for start in range(0, int(shared[-1]) + 1 if len(shared) else 0, step):
        at = slice(*np.searchsorted(column, (start, start + step)))
        dense = np.zeros((len(sets), step), np.float32)
        dense[whose[at], column[at] - start] = 1
        total += dense @ dense.T
    return total.astype(np.int32)
