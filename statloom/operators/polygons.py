"""Which polygon holds a point: a quadtree cover per polygon, so that a point meets the edges of one small cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.session import materialize

#: Cells with more edges are cut into FAN x FAN.
EDGES = 64
FAN = 4
#: Cells are cut at most so often: the last are a millionth of the polygon wide (edges that share a vertex are never parted).
DEPTH = 10
SALTS = 16
INF = float("inf")
_EDGE = ["x1", "y1", "x2", "y2"]
_CELL = ["polygon_id", "_w", "_ix", "_iy"]


def _meets_at(y: str, e: str = "") -> str:
    """SQL: longitude at which an edge meets a latitude (null for level edges). `e`: prefix of the edge's columns."""
    return f"(({e}x2 - {e}x1) * ({y} - {e}y1) / nullif({e}y2 - {e}y1, 0d) + {e}x1)"


def _side(x: str, border: str, y: str, e: str = "") -> str:
    """SQL: whether the edge is right of a point; beyond the edge's ends, whether that end is right of the border."""
    return (
        f"(case when {y} < least({e}y1, {e}y2) then {border} < if({e}y1 <= {e}y2, {e}x1, {e}x2) "
        f"when {y} >= greatest({e}y1, {e}y2) then {border} < if({e}y1 <= {e}y2, {e}x2, {e}x1) else {x} < {_meets_at(y, e)} end)"
    )


def _flips(x: str, y: str, right: str, top: str, e: str = "") -> str:
    """SQL: whether the edge is met an odd number of times on the way right to the border and up to the corner.

    Summed over closed rings this is exact, not only up to rounding: the meeting point never falls (or
    never rises) along an edge, and at a vertex the sides of its edges, an even number, cancel.
    """
    return f"({_side(x, right, y, e)} <> {_side(right, right, top, e)})"


def _salted(edges: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with their cell's columns; a cell that holds most edges is spread over SALTS keys."""
    salted = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("_salt", F.pmod(F.xxhash64(*_EDGE), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def _cut(edges: DataFrame, parents: DataFrame, keys: list[str], fan: int) -> tuple[DataFrame, DataFrame]:
    """Children of the parents: their edges, and the cells with their corner's parity and number of edges.

    `parents`: keys, _odd (parity of the upper right corner), _right and _top (that corner), _cw (side of
    a child), _cx, _cy (first child).
    """
    inside = materialize(_salted(edges, parents, keys), "cut")
    corners = [(i, j) for i in range(fan) for j in range(fan)]
    met = [F.expr(f"count_if({_flips(f'(_cx + {i + 1}) * _cw', f'(_cy + {j + 1}) * _cw', '_right', '_top')}) as _f{i}_{j}") for i, j in corners]
    children = ", ".join(f"struct(_cx + {i} as _ix, _cy + {j} as _iy, _f{i}_{j} as _n)" for i, j in corners)
    cells = parents.join(inside.groupBy(*keys).agg(*met), keys).withColumn("_c", F.expr(f"explode(array({children}))")).selectExpr(
        "polygon_id", "_cw as _w", "_c._ix", "_c._iy", "_odd <> (_c._n % 2 = 1) as _odd"
    )
    # Rows an edge passes (with the row below an edge that starts on a border), then its columns within each.
    rows = inside.selectExpr("*", "ceil(least(y1, y2) / _cw) - 1 as _low", "floor(greatest(y1, y2) / _cw) as _high")
    rows = rows.filter(f"_low <= _cy + {fan - 1} and _high >= _cy").withColumn(
        "_row", F.expr(f"explode(sequence(greatest(_cy, _low), least(_cy + {fan - 1}, greatest(_cy, _high))))")
    )
    clipped = "greatest(least(y1, y2), least(greatest(y1, y2), {} * _cw))"
    enter, leave = _meets_at(clipped.format("_row")), _meets_at(clipped.format("(_row + 1)"))
    slack = "(abs(x1) + abs(x2)) * 1e-12"
    rows = rows.selectExpr("*", f"coalesce({enter}, x1) as _enter", f"coalesce({leave}, x2) as _leave").selectExpr(
        "*", f"greatest(floor((least(_enter, _leave) - {slack}) / _cw), _cx) as _l",
        f"least(floor((greatest(_enter, _leave) + {slack}) / _cw), _cx + {fan - 1}) as _r",
    )
    moved = rows.filter("_l <= _r").selectExpr("polygon_id", "_cw as _w", "explode(sequence(_l, _r)) as _ix", "_row as _iy", *_EDGE)
    moved = materialize(moved, "edges")
    counted = moved.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("_n"))
    return moved, materialize(cells.join(counted, _CELL, "left").withColumn("_n", F.coalesce("_n", F.lit(0))), "cells")


def cover(edges: DataFrame, most: int = EDGES, depth: int = DEPTH) -> tuple[DataFrame, DataFrame, int]:
    """Quadtree cover of each polygon: (polygons with their first cells, leaf cells, cuts made).

    A leaf holds the parity of its upper right corner and its edges (`most` at most, but for edges that
    `depth` cuts do not part); one without edges lies inside or outside as a whole. Cells are
    multiples of powers of four, so borders are exact. Rings must be closed.
    """
    edges = edges.select("polygon_id", *[F.col(c).cast("double").alias(c) for c in _EDGE]).dropna()
    box = edges.groupBy("polygon_id").agg(
        F.min(F.least("x1", "x2")).alias("_x"), F.min(F.least("y1", "y2")).alias("_y"),
        F.max(F.greatest("x1", "x2")).alias("_x1"), F.max(F.greatest("y1", "y2")).alias("_y1"), F.count(F.lit(1)).alias("_n"),
    )
    extent = F.greatest(F.col("_x1") - F.col("_x"), F.col("_y1") - F.col("_y"), F.lit(1e-9))
    # A first cell is at least as wide as the polygon, so two by two hold it.
    box = box.withColumn("_cw", F.pow(F.lit(4.0), F.floor(F.log2(extent) / 2) + 1))
    polygons = materialize(box.select(
        "polygon_id", "_n", "_cw", F.floor(F.col("_x") / F.col("_cw")).alias("_cx"), F.floor(F.col("_y") / F.col("_cw")).alias("_cy")
    ), "polygons")
    # A polygon of few edges is one leaf: the whole plane, numbered -1.
    small = edges.join(polygons.filter(F.col("_n") <= most).select("polygon_id"), "polygon_id", "left_semi")
    whole = small.groupBy("polygon_id").agg(F.collect_list(F.struct(*_EDGE)).alias("_edges")).selectExpr(
        "polygon_id", "0d as _w", "0L as _ix", "0L as _iy", "false as _odd", "_edges", "-1 as _cut"
    )
    large = polygons.filter(F.col("_n") > most).drop("_n")
    if large.isEmpty():
        return polygons, whole, -1
    roots = large.withColumns({"_odd": F.lit(False), "_right": F.lit(INF), "_top": F.lit(INF)})
    held, cells = _cut(edges, roots, ["polygon_id"], 2)
    leaves, cuts = [whole], 0
    while True:
        full = F.col("_n") > (most if cuts < depth else 2**62)
        leaf = cells.filter(~full)
        own = _salted(held, leaf.filter("_n > 0").select(*_CELL), _CELL)
        arrays = own.groupBy(*_CELL).agg(F.collect_list(F.struct(*_EDGE)).alias("_edges"))
        leaves.append(leaf.join(arrays, _CELL, "left").select(*_CELL, "_odd", "_edges", F.lit(cuts).alias("_cut")))
        dense = cells.filter(full)
        if dense.isEmpty():
            break
        parents = dense.selectExpr(
            *_CELL, "_odd", "(_ix + 1) * _w as _right", "(_iy + 1) * _w as _top",
            f"_w / {FAN} as _cw", f"_ix * {FAN} as _cx", f"_iy * {FAN} as _cy",
        )
        held, cells = _cut(held, parents, _CELL, FAN)
        cuts += 1
    out = leaves[0]
    for leaf in leaves[1:]:
        out = out.unionByName(leaf)
    return polygons, out, cuts


def points_in_polygons(points: DataFrame, edges: DataFrame, most: int = EDGES, depth: int = DEPTH) -> DataFrame:
    """Adds `inside`: whether each point lies in the polygon it is asked about (crossings of a ray to the right are odd).

    `points`: point_id, polygon_id, lon, lat; `edges`: polygon_id, x1, y1, x2, y2, closed rings in any
    order. A point meets one row: the leaf of its polygon's cover that holds it. A point without a
    position, or of a polygon without edges, is not inside; every row of `points` stays.
    """
    polygons, leaves, cuts = cover(edges, most, depth)
    covered = "coalesce(floor(lon / _cw) - _cx between 0 and 1 and floor(lat / _cw) - _cy between 0 and 1, false)"
    cut = f"if(coalesce(_n, 0) <= {most}, array(-1), if({covered}, sequence(0, {max(cuts, 0)}), array(0)))"
    asked = points.join(polygons, "polygon_id", "left").selectExpr("*", f"_n > {most} and {covered} as _covered", f"explode({cut}) as _cut")
    asked = asked.selectExpr("*", f"if(_cut < 0, 0d, _cw / pow({FAN}d, _cut)) as _w").selectExpr(
        "*", "if(_cut < 0, 0L, floor(lon / _w)) as _ix", "if(_cut < 0, 0L, floor(lat / _w)) as _iy"
    )
    found = asked.join(leaves, [*_CELL, "_cut"], "left").filter("coalesce(not _covered, true) or _odd is not null")
    met = f"size(filter(_edges, e -> {_flips('lon', 'lat', '_right', '_top', 'e.')})) % 2 = 1"
    found = found.selectExpr("*", *[f"if(_cut < 0, double('infinity'), ({c} + 1) * _w) as {name}" for c, name in (("_ix", "_right"), ("_iy", "_top"))])
    return found.select(*[F.col(c) for c in points.columns], F.expr(f"coalesce(_odd <> if(_edges is null, false, {met}), false)").alias("inside"))
