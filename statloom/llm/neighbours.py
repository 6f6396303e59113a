"""Nearest neighbours by inner product: a graph built by NN-descent, searched greedily."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.session import materialize

#: Neighbours a node keeps, and incoming links it looks along besides.
KEPT, INCOMING = 50, 50
#: Nodes of a block at most; fewer where vectors are long, so that what a block meets stays within BLOCK_BYTES.
BLOCK_NODES, BLOCK_BYTES = 4096, 1 << 28
#: Nodes that a first group compares, and hyperplanes that order nodes into groups and blocks.
GROUP_NODES, PLANES = 512, 12
#: Better neighbours that a block offers a node in one round.
OFFERED = 16
#: Rounds end when fewer than this share of the links is new; each round only ever improves the lists.
SETTLED, ROUNDS = 0.1, 12
#: Candidates that a search keeps, those of them it follows in a round, and queries of a block at most.
BEAM, FOLLOWED, QUERY_NODES = 64, 20, 256
#: Offers are thinned out whenever a task holds that many.
PENDING = 2_000_000
_OFFER_BITS, _PLACE_BITS, _BLOCK_BITS = 22, 21, 24
#: Links are known by their remainder (a prime below 2 ** 16): of 50 known ones, one in 1,300 new ones looks known.
_MARKS = 65_521


@dataclass
class Index:
    """nodes (node, dim, v, turned): distinct vectors; members (node, vec_id): their rows; links (node, neighbours)."""

    nodes: DataFrame
    members: DataFrame
    links: DataFrame


def fine(v: Column) -> Column:
    """Whether an array<double> is a vector that takes part: not null, empty or zero, without null or non-finite components."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def build(embeddings: DataFrame, kept: int = KEPT, incoming: int = INCOMING) -> Index:
    """The neighbour graph of `embeddings` (vec_id, embedding).

    Every row is indexed, but for those with a null vec_id or a vector that is null, empty, zero or holds null or
    non-finite components. Equal vectors are one node; vectors of different lengths are never neighbours. So that
    the largest inner product is the nearest, vectors are scaled by the largest norm of their length and get one
    more component that fills them up to norm 1 (`turned`, single precision; it places nodes in the graph only).

    Nodes are ordered by the signs of random projections and cut into blocks of about BLOCK_NODES; the order tells
    near from far, the hash of a vector cuts what has equal signs. The first lists come from groups of GROUP_NODES
    under two such orders and one by hash. A round of NN-descent then joins every node's neighbours and incoming
    links (the `incoming` nearest, as the method samples them) and compares neighbours of neighbours where one of
    the two links is new; the best `kept` of old and offered links stay. A block gets every vector it needs once,
    however many of its nodes name it.
    """
    data = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    data = data.where(F.col("vec_id").isNotNull() & fine(F.col("v"))).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    data = data.withColumn("same", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256))
    vectors = materialize(data.groupBy("same").agg(F.first("v").alias("v")).withColumn("dim", F.size("v")), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    lengths = {r.dim: (r.n, r.longest) for r in vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("longest")).collect()}
    # Two blocks a core at least; beyond that as many as their size asks for.
    cores = 2 * embeddings.sparkSession.sparkContext.defaultParallelism
    per_block = {dim: max(64, min(BLOCK_NODES, BLOCK_BYTES // (4 * (kept + incoming) * dim), -(-n // cores))) for dim, (n, _) in lengths.items()}
    first_block, at = {}, 0
    for dim, (n, _) in sorted(lengths.items()):
        first_block[dim], at = at, at + n // per_block[dim] + 1
    scaled = vectors.withColumn("longest", _by_length({dim: longest for dim, (_, longest) in lengths.items()}, "double"))
    coded = materialize(scaled.mapInArrow(_turn, "same string, v array<double>, dim int, turned array<float>, code0 int, code1 int"), "turned")

    placed = coded.withColumn("at0", _order(coded, "code0")).withColumn("at1", _order(coded, "code1"))
    block = _by_length(first_block, "bigint") + F.floor(F.col("at0") / _by_length(per_block, "bigint"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy("same"))
    placed = placed.withColumn("block", block).withColumn("node", F.shiftleft("block", _BLOCK_BITS) + inside)
    placed = materialize(placed.select("node", "dim", "same", "v", "turned", "at0", "at1"), "nodes")
    members = materialize(data.select("vec_id", "same").distinct().join(placed.select("node", "same"), "same").select("node", "vec_id"), "members")
    nodes = placed.select("node", "dim", "v", "turned")

    groups = {dim: n // GROUP_NODES + 1 for dim, (n, _) in lengths.items()}
    edges = materialize(_best(_first_links(placed, groups, kept).withColumn("known", F.lit(False)), kept).select("node", "to", "near", F.lit(True).alias("fresh")), "links")
    for _ in range(ROUNDS):
        edges = materialize(_round(nodes, edges, kept, incoming), "links")
        told = edges.agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh")).first()
        if told.fresh <= SETTLED * told.n:
            break
    links = materialize(_lists(edges, incoming).select("node", F.array_distinct("neighbours.to").alias("neighbours")), "lists")
    return Index(nodes, members, links)


def _by_length(values: dict[int, object], kind: str) -> Column:
    """What a few lengths of vectors have each, as a column of `dim`."""
    told = json.dumps({str(dim): value for dim, value in values.items()})
    return F.from_json(F.lit(told), f"map<string, {kind}>")[F.col("dim").cast("string")]


def _order(coded: DataFrame, code: str) -> Column:
    """The place of a node among all of its length, by code: hashes spread those of one code evenly over its places."""
    counts = coded.groupBy("dim", code).agg(F.count("*").alias("n")).collect()  # at most 2 ** PLANES rows a length
    starts: dict[int, list] = {}
    ends: dict[int, int] = {}
    for r in sorted(counts, key=lambda r: (r.dim, r[code])):
        mine = starts.setdefault(r.dim, [[0, 0] for _ in range(1 << PLANES)])
        mine[r[code]] = [ends.get(r.dim, 0), r.n]
        ends[r.dim] = ends.get(r.dim, 0) + r.n
    start, n = (_by_length(starts, "array<array<bigint>>")[F.col(code)][k] for k in (0, 1))
    share = F.xxhash64(F.lit(code), "same") / F.lit(2.0**64) + 0.5
    return F.least(start + F.floor(share * n), start + n - 1)


def _turn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the filled-up vector and its codes under two sets of random hyperplanes (the same in every task)."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        turned, codes = [], []
        for v, longest in zip(batch["v"], batch["longest"].to_pylist(), strict=True):
            x = v.values.to_numpy(zero_copy_only=False)
            n = len(x)
            if n not in planes:
                planes[n] = np.random.default_rng(n).normal(size=(n + 1, 2 * PLANES))
            x = x / longest if np.isfinite(longest) and longest > 0 else x / np.abs(x).max() / np.sqrt(n)
            x = np.append(x, np.sqrt(max(0.0, 1.0 - float(x @ x))))
            turned.append(x.astype(np.float32))
            codes.append(((x @ planes[n]) > 0).reshape(2, PLANES) @ (1 << np.arange(PLANES)))
        codes = np.array(codes).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch["same"], batch["v"], batch["dim"], pa.array(turned, pa.list_(pa.float32())), pa.array(codes[:, 0], pa.int32()), pa.array(codes[:, 1], pa.int32())],
            ["same", "v", "dim", "turned", "code0", "code1"],
        )


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float32) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(len(column), -1)


def _best(offers: DataFrame, kept: int) -> DataFrame:
    """The `kept` nearest links (node, to, near, known) of every node, each once; each task first keeps that many of its own."""
    place = F.dense_rank().over(Window.partitionBy("node").orderBy(F.desc("near"), "to"))
    nearest = offers.withColumn("place", place).where(F.col("place") <= kept)
    return nearest.groupBy("node", "to").agg(F.max("near").alias("near"), F.max("known").alias("known"))


def _first_links(placed: DataFrame, groups: dict[int, int], kept: int) -> DataFrame:
    """Links (node, to, near) within groups of about GROUP_NODES: by either order, and by hash."""
    each = kept // 3 + 1
    by_hash = F.pmod(F.xxhash64(F.lit("group"), "node"), _by_length(groups, "bigint"))
    parts = F.array(F.floor(F.col("at0") / GROUP_NODES), F.floor(F.col("at1") / GROUP_NODES), by_hash)
    dealt = placed.select("dim", "node", "turned", F.posexplode(parts).alias("kind", "part"))

    def compare(table: pa.Table) -> pa.Table:
        names, x = table["node"].to_numpy(), _matrix(table["turned"])
        k = min(each, len(names) - 1)
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]
        for start in range(0, len(names) if k else 0, GROUP_NODES):
            near = x[start : start + GROUP_NODES] @ x.T
            rows = np.arange(len(near))
            near[rows, rows + start] = -np.inf
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            out[0].append(np.repeat(names[start : start + GROUP_NODES], k))
            out[1].append(names[top].ravel())
            out[2].append(np.take_along_axis(near, top, 1).ravel())
        return pa.table(dict(zip(("node", "to", "near"), map(np.concatenate, out), strict=True)))

    return dealt.groupBy("dim", "kind", "part").applyInArrow(compare, "node bigint, to bigint, near float")


def _lists(edges: DataFrame, incoming: int) -> DataFrame:
    """(node, neighbours): the links of a node and its `incoming` nearest incoming ones, each with `fresh`."""
    place = F.row_number().over(Window.partitionBy("to").orderBy(F.desc("near"), "node"))
    back = edges.withColumn("place", place).where(F.col("place") <= incoming).select(F.col("to").alias("node"), F.col("node").alias("to"), "fresh")
    both = edges.select("node", "to", "fresh").unionByName(back)
    return both.groupBy("node").agg(F.collect_list(F.struct("to", "fresh")).alias("neighbours"))


def _round(nodes: DataFrame, edges: DataFrame, kept: int, incoming: int) -> DataFrame:
    """One round: (node, to, near, fresh) after the neighbours of every node have been compared with each other."""
    lists = materialize(_lists(edges, incoming).where(F.exists("neighbours", lambda x: x["fresh"])).withColumn("block", F.shiftright("node", _BLOCK_BITS)), "around")
    needed = lists.select("block", F.explode("neighbours.to").alias("node")).distinct()
    # What a node has to beat, the last of its list if that is full, and marks of those it knows.
    mark = (F.pmod("to", F.lit(_MARKS)) - F.lit(1 << 15)).cast("smallint")
    bars = edges.groupBy("node").agg(
        F.when(F.count("*") >= kept, F.min("near")).otherwise(F.lit(-2.0)).cast("float").alias("bar"), F.collect_list(mark).alias("known")
    )
    vectors = needed.join(nodes.select("node", "turned").join(bars, "node", "left"), "node")
    nothing = F.lit(None)
    rows = vectors.select("block", "node", "turned", "bar", "known", nothing.cast("array<bigint>").alias("to"), nothing.cast("array<boolean>").alias("fresh")).unionByName(
        lists.select("block", "node", nothing.cast("array<float>").alias("turned"), nothing.cast("float").alias("bar"), nothing.cast("array<smallint>").alias("known"), F.col("neighbours.to").alias("to"), F.col("neighbours.fresh").alias("fresh"))
    )
    offers = rows.groupBy("block").applyInArrow(_join_neighbours, "node bigint, to bigint, near float")
    old = edges.select("node", "to", "near", F.lit(True).alias("known"))
    found = _best(offers.withColumn("known", F.lit(False)).unionByName(old), kept)
    return found.select("node", "to", "near", (~F.col("known")).alias("fresh"))


def _join_neighbours(table: pa.Table) -> pa.Table:
    """Offers (node, to, near) among the neighbours of every node of a block, the OFFERED best for each node."""
    table = table.combine_chunks()
    listed = np.flatnonzero(table["turned"].is_null().to_numpy(zero_copy_only=False))
    held = table.filter(table["turned"].is_valid())
    names = held["node"].to_numpy()
    order = np.argsort(names)
    names, x = names[order], _matrix(held["turned"])[order] if len(order) else np.empty((0, 1), np.float32)
    bars = held["bar"].fill_null(-2.0).to_numpy()[order].copy()
    counts = pa.compute.list_value_length(held["known"]).fill_null(0).to_numpy().astype(np.int64)
    known = pa.compute.list_flatten(held["known"]).to_numpy().astype(np.int64) + (1 << 15)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    known = _distinct((np.repeat(place, counts) << 16) | known)
    marks = names % _MARKS

    def thinned(offers: np.ndarray) -> np.ndarray:
        return _thinned(offers, bars, known, marks)

    to, fresh = table["to"], table["fresh"]
    sides = []
    for i in listed.tolist():
        at = np.searchsorted(names, to[i].values.to_numpy(zero_copy_only=False))
        new = fresh[i].values.to_numpy(zero_copy_only=False)
        new = _distinct(at[new])
        old = _distinct(at)
        sides.append((new, old[~_among(old, new)]))
    sides.sort(key=lambda s: (len(s[0]), len(s[1])))
    pending: list[np.ndarray] = []
    waiting = 0
    for start in range(0, len(sides), 64):
        some = sides[start : start + 64]
        rows = max(len(new) for new, _ in some)
        width = max(len(new) + len(old) for new, old in some)
        at = np.full((len(some), width), -1)
        n_new = np.array([len(new) for new, _ in some])
        for k, (new, old) in enumerate(some):
            at[k, : len(new)] = new
            at[k, len(new) : len(new) + len(old)] = old
        v = x[at]
        near = np.matmul(v[:, :rows], v.transpose(0, 2, 1))
        empty = at < 0
        near[np.broadcast_to(empty[:, None, :], near.shape)] = -3
        near[np.arange(rows)[None, :] >= n_new[:, None]] = -3
        near[:, np.arange(rows), np.arange(rows)] = -3
        bar = np.where(empty, 3, bars[at])
        # A pair is an offer to its new end, and to its other end; pairs of two new ends stand there twice.
        g, i, j = np.nonzero(near > bar[:, :rows, None])
        pending.append(_packed(at[g, i], at[g, j], near[g, i, j]))
        g, i, j = np.nonzero((near > bar[:, None, :]) & (np.arange(width)[None, None, :] >= n_new[:, None, None]))
        pending.append(_packed(at[g, j], at[g, i], near[g, i, j]))
        waiting += len(pending[-1]) + len(pending[-2])
        if waiting > PENDING:
            pending = [thinned(np.concatenate(pending))]
            waiting = len(pending[0])
    offers = thinned(np.concatenate(pending)) if pending else np.empty(0, np.uint64)
    node, other = _ends(offers)
    near = np.einsum("ij,ij->i", x[node], x[other]) if len(offers) else np.empty(0, np.float32)
    return pa.table({"node": pa.array(names[node]), "to": pa.array(names[other]), "near": pa.array(near.astype(np.float32))})


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct integers (np.unique hashes them, which takes many times as long)."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _among(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted `others`."""
    if not len(others):
        return np.zeros(len(values), bool)
    return others[np.minimum(np.searchsorted(others, values), len(others) - 1)] == values


def _packed(node: np.ndarray, other: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Offers as integers that sort by node, then nearest first (22 bits of it), then by the other end."""
    far = np.clip((1.0 - near) * ((1 << _OFFER_BITS) / 2.5), 0, (1 << _OFFER_BITS) - 1).astype(np.uint64)
    return (node.astype(np.uint64) << np.uint64(_OFFER_BITS + _PLACE_BITS)) | (far << np.uint64(_PLACE_BITS)) | other.astype(np.uint64)


def _ends(offers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    node = (offers >> np.uint64(_OFFER_BITS + _PLACE_BITS)).astype(np.int64)
    return node, (offers & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)


def _thinned(offers: np.ndarray, bars: np.ndarray, known: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The OFFERED best offers of every node that it has no link of, each once; what a node has to beat rises with them."""
    offers = _distinct(offers)
    node, other = _ends(offers)
    offers = offers[~_among((node << 16) | marks[other], known)]
    node, _ = _ends(offers)
    opens = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else node
    sizes = np.diff(np.append(opens, len(node)))
    rank = np.arange(len(node)) - np.repeat(opens, sizes)
    last = offers[rank == OFFERED - 1]
    if len(last):
        far = ((last >> np.uint64(_PLACE_BITS)) & np.uint64((1 << _OFFER_BITS) - 1)).astype(np.float64)
        at = _ends(last)[0]
        bars[at] = np.maximum(bars[at], 1.0 - (far + 1) * (2.5 / (1 << _OFFER_BITS)))
    return offers[rank < OFFERED]


def search(index: Index, queries: DataFrame, k: int = 20, beam: int = BEAM, followed: int = FOLLOWED) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of every row of `queries` (vec_id), itself left out.

    `queries` are rows of the index. Greedy search: a query starts at its own node and holds the `beam` nearest
    nodes it has met; in each round it follows the links of the `followed` nearest that it has not followed, and
    ends when all that it holds are followed. Queries end of themselves: what they hold only gets nearer. A hub
    that many queries follow at once is one short list, joined to them. Scores are inner products of the original
    vectors in double precision. Of rows with equal vectors those with smaller vec_id come first, and only the
    first k + 1 can be among the nearest. Queries that are not in the index give no rows.
    """
    nodes, members = index.nodes, index.members
    asked = members.join(queries.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = materialize(asked, "asked")
    begun = asked.select(F.col("node").alias("query")).distinct()
    held = materialize(begun.select("query", F.col("query").alias("node"), F.lit(float("inf")).alias("score"), F.lit(False).alias("done")), "held")
    # Queries meet in the blocks of their nodes, cut so that what they look at fits: about QUERY_NODES a cut.
    block = F.shiftright("query", _BLOCK_BITS)
    told = begun.groupBy(block.alias("block")).count().agg(F.max("count").alias("most")).first()
    dim = nodes.agg(F.max("dim").alias("dim")).first().dim or 1
    room = max(8, min(QUERY_NODES, BLOCK_BYTES // (8 * dim * followed * (KEPT + INCOMING))))
    block = F.struct(block, F.pmod(F.xxhash64("query"), F.lit(-(-(told.most or 0) // room) or 1)))
    while True:
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
        ahead = held.where(~F.col("done")).withColumn("place", place).where(F.col("place") <= followed)
        met = ahead.join(index.links, "node").select("query", F.explode("neighbours").alias("node")).unionByName(ahead.where(F.col("query") == F.col("node")).select("query", "node")).distinct()
        bars = held.where("score < double('infinity')").groupBy("query").agg(F.when(F.count("*") >= beam, F.min("score")).alias("bar"))
        new = met.join(held.where("score < double('infinity')").select("query", "node"), ["query", "node"], "left_anti")
        new = materialize(new.groupBy("query").agg(F.collect_list("node").alias("to")).join(bars, "query", "left").withColumn("block", block), "met")
        scored = _scored(new, nodes, beam)
        followed_now = ahead.select("query", "node", F.lit(True).alias("now"))
        old = held.where("score < double('infinity')").join(followed_now, ["query", "node"], "left").select("query", "node", "score", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        fresh = scored.select("query", "node", "score", (F.col("query") == F.col("node")).alias("done"))
        held = materialize(old.unionByName(fresh).withColumn("place", place).where(F.col("place") <= beam).drop("place"), "held")
        if held.where(~F.col("done")).limit(1).count() == 0:
            break

    # Rows of the nodes held: of each node the k + 1 smallest vec_ids.
    first = members.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("place") <= k + 1).drop("place")
    found = held.join(first, "node").withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    told = materialize(found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found")), "found")
    # A query's list is the same for all rows of its vector, but for the row itself.
    own = asked.select(F.col("node").alias("query"), F.col("vec_id").alias("query_id")).join(told, "query")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("place", "hit")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def _scored(met: DataFrame, nodes: DataFrame, beam: int) -> DataFrame:
    """query, node, score of met (block, query, to, bar): inner products of the original vectors, above the bar only."""
    asked = met.join(nodes.select(F.col("node").alias("query"), "v"), "query")
    needed = met.select("block", F.explode("to").alias("node")).distinct().join(nodes.select("node", "v"), "node")
    rows = needed.select("block", "node", "v", F.lit(None).cast("array<bigint>").alias("to"), F.lit(None).cast("double").alias("bar")).unionByName(
        asked.select("block", F.col("query").alias("node"), "v", "to", "bar")
    )

    def score(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ask, have = table.filter(table["to"].is_valid()), table.filter(table["to"].is_null())
        names = have["node"].to_numpy()
        order = np.argsort(names)
        names, x = names[order], _matrix(have["v"], np.float64)[order]
        query, node, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for q, v, to, bar in zip(ask["node"].to_pylist(), ask["v"], ask["to"], ask["bar"].to_pylist(), strict=True):
            at = np.searchsorted(names, to.values.to_numpy(zero_copy_only=False))
            near = np.einsum("ij,j->i", x[at], v.values.to_numpy(zero_copy_only=False))
            at, near = (at, near) if bar is None else (at[near >= bar], near[near >= bar])
            if len(near) > beam:
                least = np.partition(near, -beam)[-beam]
                at, near = at[near >= least], near[near >= least]
            query.append(np.full(len(at), q))
            node.append(names[at])
            scores.append(near)
        return pa.table({"query": np.concatenate(query), "node": np.concatenate(node), "score": np.concatenate(scores)})

    return rows.groupBy("block").applyInArrow(score, "query bigint, node bigint, score double")
