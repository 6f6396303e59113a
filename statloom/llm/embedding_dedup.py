"""Near-duplicate embeddings by tiles in principal-component order with early stops."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.components import connected_components
from statloom.session import materialize

#: Vectors on one side of a tile.
TILE_ROWS = 4096
#: Dimensions that are added up between two looks at the bounds.
STEP = 16
#: Leading components that place a vector in a cell of the grid.
GRID = 2
#: What bounds leave for rounding; links are decided on the vectors themselves, in double precision.
SLACK = 1e-6


def link_table(embeddings: DataFrame, threshold: float = 0.95, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.

    Two vectors link at a cosine, in double precision, of at least `threshold`; component_id is the
    smallest vec_id reachable by links and kept says whether it is the vector's own. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing and keep their own id;
    vectors of different lengths never link. Equal vectors are compared once, and count as links of
    one another; repeated rows are rows of their own, a null id stays null. Labels and other columns
    play no part. `threshold` must be over 0.

    Unit vectors are turned to their principal components (from sums over all vectors). Vectors that
    link lie in the same or neighbouring cells of a grid over the leading components, as wide as two
    linked vectors can be apart. Cells are dealt into packs of at most about `tile_rows` vectors, and
    pairs of packs of neighbouring cells are compared as tiles. No links are listed: a tile gives the
    number of links of each vector and a spanning forest.
    """
    spark = embeddings.sparkSession
    data = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    marked = data.withColumn("node", F.when(fine, F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256)))
    ids = marked.select("vec_id", "node")
    nodes = materialize(marked.where("node is not null").groupBy("node").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "vectors")
    turns = {n: spark.sparkContext.broadcast(_components_of(nodes.where(F.size("v") == n), n)) for n in [r[0] for r in nodes.select(F.size("v")).distinct().collect()]}

    parts = [_tiles(nodes.where(F.size("v") == n), turn, threshold, tile_rows) for n, turn in turns.items()]
    if not parts:
        return ids.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = materialize(found, "tiles")
    labels = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = nodes.select("node", "copies", "least").join(labels, "node", "left").join(counts, "node", "left")
    known = known.select("node", "least", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    placed = known.join(least, "label").select("node", "n_links", "component_id")
    result = ids.join(placed, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return result.withColumn("kept", F.expr("vec_id <=> component_id"))


def _components_of(vectors: DataFrame, n: int) -> np.ndarray:
    """Principal axes of the unit vectors as columns, widest first; from an n x n sum per task."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean, rows = np.zeros((n, n)), np.zeros(n), 0
        for batch in batches:
            unit = _unit(_matrix(batch["v"], n))
            total, mean, rows = total + unit.T @ unit, mean + unit.sum(axis=0), rows + len(unit)
        yield pa.RecordBatch.from_arrays([np.repeat(np.arange(n + 1), n), np.tile(np.arange(n), n + 1), np.concatenate([total.ravel(), mean])], ["i", "j", "x"])

    summed = vectors.select("v").mapInArrow(sums, "i bigint, j bigint, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    found = np.zeros((n + 1, n))
    for r in summed:
        found[r.i, r.j] = r.x
    rows = max(1.0, np.trace(found[:n]))
    mean = found[n] / rows
    _, axes = np.linalg.eigh(found[:n] / rows - np.outer(mean, mean))
    return axes[:, ::-1].copy()


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _unit(m: np.ndarray) -> np.ndarray:
    scaled = m / np.abs(m).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _tiles(nodes: DataFrame, turn: Broadcast, threshold: float, tile_rows: int) -> DataFrame:
    """Rows (a, null, links) with the links of a vector in a tile, and (a, b, null) of its spanning forest."""
    n = turn.value.shape[0]
    grid = min(GRID, n)
    wide = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = _unit(_matrix(batch["v"], n)) @ turn.value[:, :grid]
            cells = np.floor(lead / wide).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["node"], batch["copies"], batch["v"], pa.array(list(cells), pa.list_(pa.int64()))], ["node", "copies", "v", "cell"])

    placed = nodes.select("node", "copies", "v").mapInArrow(place, "node string, copies bigint, v array<double>, cell array<bigint>")
    placed = materialize(placed, "cells")
    # A cell is dealt into packs by a hash; its packs and those of the cells around make the tiles.
    packs = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).alias("packs"))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = packs.select("cell", F.col("packs").alias("own"), F.explode(around).alias("d0"))
    for k in range(1, grid):
        near = near.withColumn(f"d{k}", F.explode(around))
    near = near.select("cell", "own", F.array(*[(F.element_at("cell", k + 1) + F.col(f"d{k}")) for k in range(grid)]).alias("other"))
    met = near.join(packs.select(F.col("cell").alias("other"), F.col("packs").alias("theirs")), "other").where("cell <= other")
    pairs = met.select(
        "cell", "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("own") - 1)).alias("x"), "theirs"
    ).select("cell", "other", "x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("theirs") - 1)).alias("y")).where("cell < other or x <= y")
    pairs = pairs.withColumn("tile", F.struct("cell", "x", "other", "y"))
    sides = pairs.select("tile", F.lit(0).alias("side"), "cell", F.col("x").alias("pack")).unionByName(
        pairs.where("cell < other or x < y").select("tile", F.lit(1).alias("side"), F.col("other").alias("cell"), F.col("y").alias("pack"))
    )
    dealt = placed.join(packs, "cell").select("node", "copies", "v", "cell", F.pmod(F.xxhash64("node"), F.col("packs")).alias("pack"))
    rows = dealt.join(sides, ["cell", "pack"]).select("tile", "side", "node", "copies", "v")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table["side"].to_numpy()
        matrix = _matrix(table["v"].combine_chunks(), n)
        names, copies = np.array(table["node"].to_pylist(), object), table["copies"].to_numpy()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        links, forest = _compare(matrix, left, right, copies, turn.value, threshold)
        at = np.flatnonzero(links)
        a = [*names[at], *(names[i] for i, _ in forest)]
        b = [None] * len(at) + [names[j] for _, j in forest]
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "links": pa.array([*links[at].tolist(), *[None] * len(forest)], pa.int64())})

    return rows.groupBy("tile").applyInArrow(compare, "a string, b string, links bigint")


def _compare(matrix: np.ndarray, left: np.ndarray, right: np.ndarray, copies: np.ndarray, axes: np.ndarray, threshold: float, block: int = 512) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links per vector, and a spanning forest, between two sides of a tile (or within one).

    Blocks of rows are compared on the leading STEP components. A pair whose sum so far and product of
    the norms of what is left cannot reach the threshold stops there; the rest add the next
    components, and so on; those left at the end are decided on the vectors themselves.
    """
    unit = _unit(matrix)
    turned = unit @ axes
    # norms[:, k]: length of the components from the k-th step on.
    tails = [np.linalg.norm(turned[:, k:], axis=1) for k in range(0, turned.shape[1] + STEP, STEP)]
    links, forest, root = np.zeros(len(matrix), np.int64), [], np.arange(len(matrix))
    lead = np.hstack([turned[:, :STEP], tails[1][:, None]])
    same = left is right
    for start in range(0, len(left), block):
        rows = left[start : start + block]
        others = right[start:] if same else right
        i, j = np.nonzero(lead[rows] @ lead[others].T >= threshold - SLACK)
        a, b = rows[i], others[j]
        if same:
            a, b = a[a < b], b[a < b]
        so_far = np.einsum("ij,ij->i", turned[a, :STEP], turned[b, :STEP])
        for k in range(1, len(tails) - 1):
            at = slice(k * STEP, (k + 1) * STEP)
            so_far = so_far + np.einsum("ij,ij->i", turned[a, at], turned[b, at])
            keep = so_far + tails[k + 1][a] * tails[k + 1][b] >= threshold - SLACK
            a, b, so_far = a[keep], b[keep], so_far[keep]
        x, y = matrix[a], matrix[b]
        exact = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
        a, b = a[exact >= threshold], b[exact >= threshold]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        for p, q in zip(a, b, strict=True):
            if root[p] != root[q]:
                forest.append((p, q))
                root[root == root[q]] = root[p]
    return links, forest
