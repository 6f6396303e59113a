"""The cover of polygons against counting the crossings of every edge."""

import math
import random

from pyspark.sql import functions as F

from statloom.operators.polygons import cover, points_in_polygons


def ring(corners):
    return list(zip(corners, corners[1:] + corners[:1]))


def wiggly(n, seed, cx=0.0, cy=0.0, r=1.0, wild=0.3):
    rng = random.Random(seed)
    return ring([
        (cx + r * (1 + wild * rng.random()) * math.cos(2 * math.pi * i / n), cy + r * (1 + wild * rng.random()) * math.sin(2 * math.pi * i / n))
        for i in range(n)
    ])


def plain(edges, x, y):
    return sum(
        ((y1 > y) != (y2 > y)) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in edges
    ) % 2 == 1


def tables(spark, shapes, asked):
    edges = [(k, *map(float, a + b)) for k, es in shapes.items() for a, b in es]
    rows = [(i, k, float(x), float(y)) for i, (k, x, y) in enumerate(asked)]
    return (
        spark.createDataFrame(rows, "point_id long, polygon_id string, lon double, lat double"),
        spark.createDataFrame(edges, "polygon_id string, x1 double, y1 double, x2 double, y2 double"),
    )


def test_every_shape_and_border(spark):
    square = ring([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])
    hole = ring([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)])
    # Many level and upright edges on the borders of cells.
    comb = ring([p for i in range(40) for p in [(i / 4, 0.0), (i / 4, 1 + i % 3), (i / 4 + 0.125, 1 + i % 3), (i / 4 + 0.125, 0.0)]] + [(10.0, -1.0), (0.0, -1.0)])
    star = [e for i in range(60) for e in ring([(0.5, 0.5), (0.5 + math.cos(i), 0.5 + math.sin(i)), (0.5 + math.cos(i + 0.04), 0.5 + math.sin(i + 0.04))])]
    shapes = {
        "holed": square + hole, "comb": comb, "star": star, "wild": wiggly(700, 1, -0.1, 0.2), "far": wiggly(300, 2, 1e6, -3e5, 1e-3),
        "flat": ring([(0.0, 1.0), (5.0, 1.0), (2.0, 1.0)]), "twice": square + square,
    }
    rng = random.Random(9)
    asked = []
    for k, es in shapes.items():
        xs, ys = [p[0] for e in es for p in e], [p[1] for e in es for p in e]
        asked += [(k, rng.uniform(min(xs) - 0.1, max(xs) + 0.1), rng.uniform(min(ys) - 0.1, max(ys) + 0.1)) for _ in range(200)]
        asked += [(k, rng.uniform(min(xs), max(xs)), rng.uniform(min(ys), max(ys))) for _ in range(200)]
        # Vertices, points level with vertices, middles of edges.
        for (x1, y1), (x2, y2) in rng.sample(es, min(len(es), 80)):
            asked += [(k, x1, y1), (k, rng.uniform(min(xs), max(xs)), y1), (k, (x1 + x2) / 2, (y1 + y2) / 2), (k, x1, rng.uniform(min(ys), max(ys)))]
    points, edges = tables(spark, shapes, asked)
    got = {r.point_id: r.inside for r in points_in_polygons(points, edges, most=8, depth=4).collect()}
    want = {i: plain(shapes[k], x, y) for i, (k, x, y) in enumerate(asked)}
    assert len(got) == len(asked)
    assert [i for i in want if want[i] != got[i]] == []


def test_a_hot_polygon_is_cut_into_small_cells(spark):
    """A third of all edges crowd in a corner of one polygon; no leaf holds more than the limit."""
    n = 20000
    coast = [(i / n, 1e-3 * random.Random(i).random()) for i in range(n)] + [(1.0, 50.0), (-50.0, 50.0), (-50.0, 0.0)]
    shapes = {"hot": ring(coast), "cold": wiggly(50, 4)}
    rng = random.Random(2)
    asked = [("hot", rng.random(), 1e-3 * rng.random()) for _ in range(300)] + [("cold", rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(50)]
    points, edges = tables(spark, shapes, asked)
    _, leaves, cuts = cover(edges)
    assert cuts > 2
    sizes = leaves.groupBy("polygon_id").agg(F.max(F.size("_edges")).alias("most"), F.sum(F.greatest(F.size("_edges"), F.lit(0))).alias("held"))
    for r in sizes.collect():
        assert r.most <= 64 and r.held < 3 * n
    got = {r.point_id: r.inside for r in points_in_polygons(points, edges).collect()}
    assert all(got[i] == plain(shapes[k], x, y) for i, (k, x, y) in enumerate(asked))


def test_missing_values_and_empty_tables(spark):
    points, edges = tables(spark, {"a": ring([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])}, [("a", 0.2, 0.2), ("a", 0.2, 0.2), ("b", 0.2, 0.2), ("a", 9.0, 9.0)])
    nulls = spark.createDataFrame([(9, "a", None, 0.2), (10, None, 0.2, 0.2)], points.schema)
    got = sorted((r.point_id, r.inside) for r in points_in_polygons(points.unionByName(nulls), edges).collect())
    assert got == [(0, True), (1, True), (2, False), (3, False), (9, False), (10, False)]
    assert points_in_polygons(points, edges.limit(0)).filter("inside").count() == 0
    assert points_in_polygons(points.limit(0), edges).count() == 0
