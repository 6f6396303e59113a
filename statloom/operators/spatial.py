"""Points, boxes, rings and clusters on grid cells: no operator compares everything with everything."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.text import ascii_fold, slugify
from statloom.operators.skew import top_rows
from statloom.session import materialize

# Fixed values of the method.
EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0
NEAR_KM = 2.0
MIN_KM2, MAX_KM2 = 5.0, 1600.0
# Words that name the body rather than the place.
BODY_WORDS = (
    r"\b(municipal|corporation|city|nagar nigam|mahanagar palika|mahanagarapalike|greater|brihan|bruhat|council|"
    r"municipality|cantonment|urban|the|of)\b"
)
MUNICIPAL = r"(?i)municipal|corporation|nagar nigam|palika|palike"


def bounding_boxes(vertices: DataFrame, key: str) -> DataFrame:
    return vertices.groupBy(key).agg(
        F.min("lon").alias("lon0"), F.min("lat").alias("lat0"), F.max("lon").alias("lon1"), F.max("lat").alias("lat1")
    )


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def bbox_join(features: DataFrame, boxes: DataFrame, size: float = 1.0) -> DataFrame:
    """Pairs of boxes that overlap (touching does not count). Both sides: a key, lon0 … lat1.

    Boxes are cut into grid cells; a pair is kept in the cell of the lower left corner of what the
    two share, hence once.
    """
    fk, bk = features.columns[0], boxes.columns[0]

    def gridded(df: DataFrame) -> DataFrame:
        return df.withColumn("_x", F.explode(_cells(F.col("lon0"), F.col("lon1"), size))).withColumn(
            "_y", F.explode(_cells(F.col("lat0"), F.col("lat1"), size))
        )

    a, b = gridded(features).alias("a"), gridded(boxes).alias("b")
    overlap = (
        (F.col("a.lon0") < F.col("b.lon1")) & (F.col("a.lon1") > F.col("b.lon0"))
        & (F.col("a.lat0") < F.col("b.lat1")) & (F.col("a.lat1") > F.col("b.lat0"))
    )
    corner = (F.floor(F.greatest("a.lon0", "b.lon0") / size) == F.col("a._x")) & (
        F.floor(F.greatest("a.lat0", "b.lat0") / size) == F.col("a._y")
    )
    same = (F.col("a._x") == F.col("b._x")) & (F.col("a._y") == F.col("b._y"))
    return a.join(b, same & overlap & corner).select(F.col(f"a.{fk}").alias(fk), F.col(f"b.{bk}").alias(bk))


def meeting_any(features: DataFrame, boxes: DataFrame, size: float = 1.0) -> DataFrame:
    """The features whose box overlaps any of the boxes (touching does not count), each once.

    A feature's cells ask for a box until one is found, so dense cells emit no pairs. The features'
    first column is their key.
    """
    key = features.columns[0]
    a = features.withColumn("_x", F.explode(_cells(F.col("lon0"), F.col("lon1"), size)))
    a = a.withColumn("_y", F.explode(_cells(F.col("lat0"), F.col("lat1"), size))).alias("a")
    b = boxes.withColumn("_x", F.explode(_cells(F.col("lon0"), F.col("lon1"), size)))
    b = b.withColumn("_y", F.explode(_cells(F.col("lat0"), F.col("lat1"), size))).alias("b")
    overlap = (
        (F.col("a.lon0") < F.col("b.lon1")) & (F.col("a.lon1") > F.col("b.lon0"))
        & (F.col("a.lat0") < F.col("b.lat1")) & (F.col("a.lat1") > F.col("b.lat0"))
    )
    same = (F.col("a._x") == F.col("b._x")) & (F.col("a._y") == F.col("b._y"))
    return a.join(b, same & overlap, "left_semi").drop("_x", "_y").dropDuplicates([key])


def bounds_around(lon: Column, lat: Column, km: float) -> list[Column]:
    """Box of about ±km around a point, as four columns."""
    dlat = F.lit(km / KM_PER_DEGREE)
    dlon = F.lit(km / KM_PER_DEGREE) / F.cos(F.radians(lat))
    return [(lon - dlon).alias("lon0"), (lat - dlat).alias("lat0"), (lon + dlon).alias("lon1"), (lat + dlat).alias("lat1")]


def great_circle_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2.0))
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * EARTH_KM)


def nearest_vertex(points: DataFrame, vertices: DataFrame, cell: float = 0.02) -> DataFrame:
    """Distance in km from each point to the nearest vertex of the shape it is asked about.

    `points`: point_id, shape_id, lon, lat; `vertices`: shape_id, lon, lat. Vertices fall into cells of
    `cell` degrees, one vertex standing for each. A point meets those first and then only the vertices of
    cells that may hold a nearer one: no vertex is farther from its cell's than the cell is long and wide.
    """
    reach = EARTH_KM * math.radians(2 * cell) + 1e-6
    v = vertices.select(
        "shape_id", F.floor(F.col("lon") / cell).alias("_x"), F.floor(F.col("lat") / cell).alias("_y"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat")
    ).distinct()
    km = great_circle_km(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"))
    standing = v.groupBy("shape_id", "_x", "_y").agg(F.min(F.struct("_lon", "_lat")).alias("_v")).select("shape_id", "_x", "_y", "_v.*")
    asked = points.select("point_id", "shape_id", "lon", "lat")
    first = asked.join(standing, "shape_id").select("point_id", "shape_id", "lon", "lat", "_x", "_y", km.alias("_km"))
    least = first.groupBy("point_id", "shape_id").agg(F.min("_km").alias("_least"))
    near = first.join(least, ["point_id", "shape_id"]).filter(F.col("_km") - reach <= F.col("_least")).drop("_km", "_least")
    return near.join(v, ["shape_id", "_x", "_y"]).groupBy("point_id", "shape_id").agg(F.min(km).alias("km"))


def polygon_areas(edges: DataFrame) -> DataFrame:
    """Area in km² of each polygon from its edges (shoelace on a local flat projection)."""
    shrink = F.cos(F.radians((F.col("y1") + F.col("y2")) / 2))
    doubled = (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) * shrink
    return edges.groupBy("polygon_id").agg((F.abs(F.sum(doubled)) / 2 * KM_PER_DEGREE**2).alias("km2"))


def core_name(c: Column) -> Column:
    """A boundary's name without the words for its body."""
    text = F.trim(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z]+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, BODY_WORDS, " "), r"\s+", " "))


def choose_boundary(candidates: DataFrame, cities: DataFrame) -> DataFrame:
    """The boundary of each city: same external id first, then the most local level of the same name.

    `candidates`: city, boundary_id, label, external_id, level, km2, holds, km; `cities`: city, name,
    external_id. A level 6 area counts by name only if the name says it is the municipal body. The
    shape must hold the city's point or lie within 2 km, and measure 5–1,600 km².
    """
    c = cities.select("city", core_name(F.col("name")).alias("_name"), F.col("external_id").alias("_id"))
    joined = candidates.join(c, "city")
    by_id = F.coalesce(F.col("external_id") == F.col("_id"), F.lit(False))
    tehsil = (F.col("level") == 6) & ~F.col("label").rlike(MUNICIPAL)
    by_name = ~tehsil & (core_name(F.col("label")) == F.col("_name"))
    how = F.when(by_id, "id").when(by_name, "name")
    near = F.col("holds") | (F.col("km") <= NEAR_KM)
    good = joined.withColumn("how", how).filter(F.col("how").isNotNull() & near & F.col("km2").between(MIN_KM2, MAX_KM2))
    order = [F.col("how"), F.col("level").desc(), F.col("boundary_id")]
    return top_rows(good, ["city"], order, 1).select("city", "boundary_id", "how", "level")


def match_shapes(shapes: DataFrame, places: DataFrame) -> DataFrame:
    """Shapes matched to places by name: matched, or the problem (unmatched, duplicate, missing).

    `shapes`: shape_name; `places`: slug.
    """
    named = shapes.select("shape_name", slugify(F.replace(F.lower("shape_name"), F.lit("&"), F.lit(" and "))).alias("slug"))
    counted = named.groupBy("slug").agg(F.count(F.lit(1)).alias("shapes"), F.min("shape_name").alias("shape_name"))
    joined = counted.join(places.select("slug", F.lit(True).alias("_known")), "slug", "full")
    state = (
        F.when(F.col("shapes").isNull(), "missing").when(F.col("_known").isNull(), "unmatched")
        .when(F.col("shapes") > 1, "duplicate").otherwise("matched")
    )
    return joined.select("slug", "shape_name", state.alias("state"))


# --- Clusters -----------------------------------------------------------------------------------


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node each node is connected with.

    Alternates two star contractions until no edge changes; every round is a few joins on edges and
    a table in the shared folder, and the number of rounds grows with the logarithm of the size.
    `edges`: a, b; `nodes`: node.
    """
    current = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def signature(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return row["n"], row["x"]

    last = signature(current)
    while last[0]:
        # Larger neighbours of every node move to the least node of its neighbourhood.
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Then every node and its smaller neighbours move to the least of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        current = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        now = signature(current)
        if now == last:
            break
        last = now
    roots = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def clusters(points: DataFrame, distance: float, parts: int = 8) -> DataFrame:
    """Single-linkage clusters of points within a distance: adds `cluster` (least point id) and `size`.

    `points`: point_id, x, y. In a cell of side distance/√2 all points belong together, so cells
    are the nodes. Two cells (at most two steps apart) are linked at once when the boxes of two of
    their sub-cells lie within the distance wherever the points are, never when they lie apart; only
    sub-cells in between compare their distinct points, and only for cells not linked already.
    """
    side = distance / math.sqrt(2) * (1 - 1e-9)
    step = side / parts
    located = points.select(
        "point_id", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"),
        F.floor(F.col("x") / step).alias("sx"), F.floor(F.col("y") / step).alias("sy"),
    )
    boxes = located.groupBy("cx", "cy", "sx", "sy").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    boxes = materialize(boxes, "boxes")
    # Half of the neighbourhood is enough: pairs are symmetric.
    offsets = [(dx, dy) for dx in range(0, 3) for dy in range(-2, 3) if dx > 0 or dy > 0]
    shift = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets]))
    a = boxes.withColumn("_o", shift).withColumn("nx", F.col("cx") + F.col("_o.dx")).withColumn("ny", F.col("cy") + F.col("_o.dy")).alias("a")
    b = boxes.alias("b")

    def gap(lo1: str, hi1: str, lo2: str, hi2: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(lo2) - F.col(hi1), F.col(lo1) - F.col(hi2))

    def reach(lo1: str, hi1: str, lo2: str, hi2: str) -> Column:
        return F.greatest(F.col(hi2) - F.col(lo1), F.col(hi1) - F.col(lo2))

    near = F.hypot(gap("a.x0", "a.x1", "b.x0", "b.x1"), gap("a.y0", "a.y1", "b.y0", "b.y1"))
    far = F.hypot(reach("a.x0", "a.x1", "b.x0", "b.x1"), reach("a.y0", "a.y1", "b.y0", "b.y1"))
    pairs = a.join(b, (F.col("a.nx") == F.col("b.cx")) & (F.col("a.ny") == F.col("b.cy"))).filter(near <= distance).select(
        *[F.col(f"a.{c}").alias(f"a_{c}") for c in ("cx", "cy", "sx", "sy")],
        *[F.col(f"b.{c}").alias(f"b_{c}") for c in ("cx", "cy", "sx", "sy")], (far <= distance).alias("sure"),
    )
    cells = ["a_cx", "a_cy", "b_cx", "b_cy"]
    pairs = materialize(pairs, "pairs")
    sure = pairs.filter("sure").select(*cells).distinct()
    unsure = pairs.join(sure, cells, "left_anti")
    distinct = located.select("sx", "sy", "x", "y").distinct()
    left = distinct.select(F.col("sx").alias("a_sx"), F.col("sy").alias("a_sy"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    right = distinct.select(F.col("sx").alias("b_sx"), F.col("sy").alias("b_sy"), F.col("x").alias("bx"), F.col("y").alias("by"))
    checked = unsure.join(left, ["a_sx", "a_sy"]).join(right, ["b_sx", "b_sy"]).filter(
        F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= distance
    )
    linked = sure.unionByName(checked.select(*cells).distinct())
    members = located.groupBy("cx", "cy").agg(F.min("point_id").alias("node"))
    ends = linked.join(members.select(F.col("cx").alias("a_cx"), F.col("cy").alias("a_cy"), F.col("node").alias("a")), ["a_cx", "a_cy"]).join(
        members.select(F.col("cx").alias("b_cx"), F.col("cy").alias("b_cy"), F.col("node").alias("b")), ["b_cx", "b_cy"]
    )
    components = connected_components(ends.select("a", "b"), members.select("node"))
    labelled = located.select("point_id", "cx", "cy").join(members, ["cx", "cy"]).join(components, "node")
    sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return labelled.join(sizes, "component").select("point_id", F.col("component").alias("cluster"), "size")


def cluster_bounds(points: DataFrame, labels: DataFrame, pad: float = 0.35, min_lon: float = 0.12, min_lat: float = 0.1) -> DataFrame:
    """Padded box of each cluster of two points or more."""
    joined = points.join(labels, "point_id").filter("size >= 2")
    box = joined.groupBy("cluster", "size").agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1")
    )
    px = F.greatest(F.lit(min_lon), (F.col("_x1") - F.col("_x0")) * pad)
    py = F.greatest(F.lit(min_lat), (F.col("_y1") - F.col("_y0")) * pad)
    return box.select(
        "cluster", "size", (F.col("_x0") - px).alias("lon0"), (F.col("_y0") - py).alias("lat0"),
        (F.col("_x1") + px).alias("lon1"), (F.col("_y1") + py).alias("lat1"),
    )
