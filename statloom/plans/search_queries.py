"""Registered queries of search and spatial operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.text import normalize_text
from statloom.operators import polygons
from statloom.operators import search as Q
from statloom.operators import spatial as L
from statloom.plans import bindings as B
from statloom.plans.core_queries import aliases
from statloom.plans.registry import Tables, query, view

# --- Search -------------------------------------------------------------------------------------


def entries(t: Tables) -> DataFrame:
    """Parts by name, nations with their other names, regions and suppliers."""
    parts = t.part.groupBy("p_name").agg(F.min("p_type").alias("kind")).select(
        F.lit("indicator").alias("type"), F.col("p_name").alias("title"), F.array("p_name").alias("names"),
        F.concat(F.lit("Sold as "), "kind", F.lit(" goods")).alias("text"),
    )
    other = aliases(t).groupBy("slug").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    nations = B.places(t).filter("type = 'state' and valid_to is null").join(other, "slug", "left").select(
        F.lit("state").alias("type"), F.col("name").alias("title"),
        F.array(F.col("name"), F.concat(F.lit("राज्य "), F.substring("name", 8, 1))).alias("names"), "aliases",
        F.concat(F.lit("Trade of the region "), "peer_group").alias("text"),
    )
    regions = t.region.select(F.lit("pillar").alias("type"), F.initcap("r_name").alias("title"), F.array("r_name").alias("names"))
    suppliers = t.supplier.select(F.lit("city").alias("type"), F.col("s_name").alias("title"), F.array("s_name").alias("names"))
    rows = Q.search_index([parts, nations, regions, suppliers])
    return rows.withColumn("entry_id", F.concat_ws(":", "type", "title"))


def asked(t: Tables) -> DataFrame:
    """Whole names, their beginnings, and names with a letter missing; also other names of nations."""
    names = t.part.select(F.col("p_name").alias("n")).distinct().unionByName(
        t.supplier.select(F.translate("s_name", "#", " ").alias("n"))
    ).unionByName(t.region.select(F.lower("r_name").alias("n")))
    n = F.col("n")
    forms = names.select(
        F.explode(
            F.array(
                n, F.substring(n, 1, 3), F.concat(F.substring(n, 1, 2), F.substring(n, 4, 20)),
                F.concat(F.substring_index(n, " ", -1), F.lit(" "), F.substring(n, 1, 2)), F.substring(n, 3, 4),
            )
        ).alias("raw")
    )
    others = aliases(t).select(F.col("alias").alias("raw"))
    words = t.part.select(F.concat(F.lit("goods "), F.substring("p_type", 1, 4)).alias("raw"))
    return forms.unionByName(others).unionByName(words).distinct()


def _norm(c: str) -> str:
    return f"trim(regexp_replace(replace(lower(strip_accents({c})), '&', ' and '), '[^a-z0-9ऀ-ॿ]+', ' ', 'g'))"


view("entry_rows", f"""
  select 'indicator' as type, p_name as title, [{_norm('p_name')}] as names, cast([] as varchar[]) as aliases,
         {_norm("'Sold as ' || min(p_type) || ' goods'")} as text from part group by p_name
  union all
  select 'state', 'Nation ' || upper(letter), ['nation ' || letter, 'राज्य ' || letter],
    ['land ' || letter || ' and isles'] || case when n_nationkey % 5 = 1 then ['former ' || letter] else [] end
      || case when n_nationkey % 5 = 2 then ['old land'] else [] end, 'trade of the region ' || {_norm('peer_group')} from nations
  union all select 'pillar', array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' '), [{_norm('r_name')}], [], '' from region
  union all select 'city', s_name, [{_norm('s_name')}], [], '' from supplier
""")
view("asked_rows", f"""
  with n as (select distinct p_name as n from part union all select replace(s_name, '#', ' ') from supplier union all select lower(r_name) from region),
  f as (select unnest([n, n[1:3], n[1:2] || n[4:23], string_split(n, ' ')[-1] || ' ' || n[1:2], n[3:6]]) as raw from n
    union all select unnest(['Land ' || upper(letter) || ' & Isles'] || case when n_nationkey % 5 = 1 then ['Former ' || upper(letter)] else [] end
      || case when n_nationkey % 5 = 2 then ['Old Land'] else [] end) from nations
    union all select 'goods ' || p_type[1:4] from part)
  select distinct {_norm('raw')} as query from f
""")
_TERM = """case when {t} = query then 100.0 when starts_with({t}, query) then 80.0
  when len(list_filter(string_split({t}, ' '), lambda w: starts_with(w, query))) > 0 then 60.0
  when len(tokens) > 1 and len(list_filter(tokens, lambda k: len(list_filter(string_split({t}, ' '), lambda w: starts_with(w, k))) = 0)) = 0 then 50.0
  {inside} when length(query) >= 5 and len(list_filter(string_split({t}, ' '), lambda w: levenshtein(w, query) <= 1)) > 0 then 25.0 else 0.0 end"""
view("term_scores", f"""
  select type, title, query, score + case type when 'state' then 5 when 'city' then 3 when 'pillar' then 4 else 0 end as score from (
    select type, title, query, case when greatest(nm, al) > 0 then greatest(nm, al)
      when length(query) >= 3 and len(list_filter(tokens, lambda k: len(list_filter(string_split(text, ' '), lambda w: starts_with(w, k))) = 0)) = 0 then 10.0
      else 0.0 end as score
    from (
      select e.type, e.title, e.text, a.query, a.tokens,
        list_max(list_transform(names, lambda x: {_TERM.format(t='x', inside="when length(query) >= 4 and contains(x, query) then 30.0")}))::double as nm,
        coalesce(list_max(list_transform(aliases, lambda x: {_TERM.format(t='x', inside='')})), 0)::double * 0.9 as al
      from entry_rows e cross join (select query, string_split(query, ' ') as tokens from asked_rows where query <> '') a))
  where score > 0
""")


@query("Q1_search_index", """
  select type, title, array_to_string(names, '|') as names, array_to_string(list_sort(aliases), '|') as aliases, text from entry_rows
""")
def q1(t: Tables) -> DataFrame:
    rows = entries(t)
    return rows.select(
        "type", "title", F.array_join("names", "|").alias("names"), F.array_join(F.array_sort("aliases"), "|").alias("aliases"), "text"
    )


@query("Q2_normalize_text", f"select doc_id, md5({_norm('text')}) as digest from documents")
def q2(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(normalize_text(F.col("text"))).alias("digest"))


@query("Q3_score_terms", "select query, type, title, score::double as score from term_scores", "score")
def q3(t: Tables) -> DataFrame:
    wanted = asked(t).select(normalize_text(F.col("raw")).alias("query")).filter("query <> ''").distinct()
    return Q.score_terms(entries(t), wanted).select("query", "type", "title", "score")


@query("Q4_search", """
  select query, type, title, score::double as score, row_number() over (partition by query order by score desc, length(title), title, type) as position
  from term_scores qualify position <= 8
""", "score")
def q4(t: Tables) -> DataFrame:
    return Q.search(entries(t), asked(t)).select("query", "type", "title", "score", "position")


# --- Spatial: the first two dimensions of each vector are a point, labels are areas ---------------

view("points", "select vec_id as point_id, label, 77.0 + embedding[1]::double * 10 as lon, 20.0 + embedding[2]::double * 10 as lat from embeddings")


def points(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select(
        F.col("vec_id").alias("point_id"), "label", (F.lit(77.0) + F.get(e, F.lit(0)).cast("double") * 10).alias("lon"),
        (F.lit(20.0) + F.get(e, F.lit(1)).cast("double") * 10).alias("lat"),
    )


view("area_boxes", "select label, min(lon) as lon0, min(lat) as lat0, max(lon) as lon1, max(lat) as lat1 from points group by 1")
view("town_boxes", """
  select point_id, lon - 0.2 / cos(radians(lat)) * 10 / 111.0 as lon0, lat - 0.2 * 10 / 111.0 as lat0,
         lon + 0.2 / cos(radians(lat)) * 10 / 111.0 as lon1, lat + 0.2 * 10 / 111.0 as lat1 from points
""")


@query("L1_bbox_join", """
  select a.label, b.point_id from area_boxes a join town_boxes b on a.lon0 < b.lon1 and a.lon1 > b.lon0 and a.lat0 < b.lat1 and a.lat1 > b.lat0
""")
def l1(t: Tables) -> DataFrame:
    areas = L.bounding_boxes(points(t), "label")
    towns = points(t).select("point_id", *L.bounds_around(F.col("lon"), F.col("lat"), 2.0))
    return L.bbox_join(areas, towns)


@query("L1_features_in_boxes", """
  select point_id from town_boxes b where point_id % 3 > 0 and exists (select 1 from town_boxes a
    where a.point_id % 3 = 0 and a.lon0 < b.lon1 and a.lon1 > b.lon0 and a.lat0 < b.lat1 and a.lat1 > b.lat0)
""")
def l1_any(t: Tables) -> DataFrame:
    """Which towns meet any of every third town."""
    towns = points(t).select("point_id", *L.bounds_around(F.col("lon"), F.col("lat"), 2.0))
    return L.meeting_any(towns.filter("point_id % 3 > 0"), towns.filter("point_id % 3 = 0")).select("point_id")


@query("L2_bounds_around", "select * from town_boxes", "lon0 lat0 lon1 lat1")
def l2(t: Tables) -> DataFrame:
    return points(t).select("point_id", *L.bounds_around(F.col("lon"), F.col("lat"), 2.0))


# Each label's area: a hexagon around the mean of its points, 1.2 standard deviations wide.
HEX = [(1.0, 0.0), (0.5, 0.8), (-0.5, 0.8), (-1.0, 0.0), (-0.5, -0.8), (0.5, -0.8)]
view("hexagons", """
  select label, k, round(cx, 6) + dx * round(r, 6) as lon, round(cy, 6) + dy * round(r, 6) as lat
  from (select label, avg(lon) as cx, avg(lat) as cy, 1.2 * stddev_pop(lon) as r from points group by 1),
  (values """ + ", ".join(f"({i}, {x}::double, {y}::double)" for i, (x, y) in enumerate(HEX)) + """) h(k, dx, dy)
""")
view("hex_edges", """
  select a.label as polygon_id, a.lon as x1, a.lat as y1, b.lon as x2, b.lat as y2
  from hexagons a join hexagons b on a.label = b.label and b.k = (a.k + 1) % 6
""")


def hexagons(t: Tables) -> DataFrame:
    stats = points(t).groupBy("label").agg(
        F.round(F.avg("lon"), 6).alias("cx"), F.round(F.avg("lat"), 6).alias("cy"), F.round(1.2 * F.stddev_pop("lon"), 6).alias("r")
    )
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for i, (x, y) in enumerate(HEX)]))
    return stats.withColumn("h", corners).select(
        "label", "h.k", (F.col("cx") + F.col("h.dx") * F.col("r")).alias("lon"), (F.col("cy") + F.col("h.dy") * F.col("r")).alias("lat")
    )


def hex_edges(t: Tables) -> DataFrame:
    corner = hexagons(t)
    following = corner.select("label", F.pmod(F.col("k") + 5, F.lit(6)).alias("k"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    return corner.join(following, ["label", "k"]).select(
        F.col("label").alias("polygon_id"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), "x2", "y2"
    )


_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(h.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(h.lat)) * pow(sin(radians(h.lon - p.lon) / 2), 2))))"


@query("L3_nearest_vertex", f"""
  select point_id, p.label as shape_id, min({_KM}) as km from points p join hexagons h on p.label = h.label group by 1, 2
""", "km")
def l3(t: Tables) -> DataFrame:
    asked_points = points(t).select("point_id", F.col("label").alias("shape_id"), "lon", "lat")
    return L.nearest_vertex(asked_points, hexagons(t).select(F.col("label").alias("shape_id"), "lon", "lat"))


view("inside_rows", """
  select p.point_id, p.label, count(*) filter (where (y1 > lat) <> (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1 as inside
  from points p join hex_edges on polygon_id = p.label group by 1, 2
""")


@query("L4_points_in_polygons", "select point_id, label as polygon_id, inside from inside_rows")
def l4(t: Tables) -> DataFrame:
    asked_points = points(t).select("point_id", F.col("label").alias("polygon_id"), "lon", "lat")
    return polygons.points_in_polygons(asked_points, hex_edges(t)).select("point_id", "polygon_id", "inside")


@query("L5_choose_boundary", """
  with c as (select o_custkey as city, o_orderkey as boundary_id, o_orderstatus as st, o_orderpriority as pr, o_totalprice / 200 as km2,
      6 + o_orderpriority[1]::int % 3 as level, o_totalprice / 100000 as km from orders),
  h as (select *, case when st = 'F' and pr = '1-URGENT' then 'id' when st = 'P' and not level = 6 then 'name'
      when st = 'F' and not (pr = '1-URGENT') then 'name' end as how from c)
  select city, boundary_id, how, level from h where how is not null and (pr = '2-HIGH' or km <= 2.0) and km2 between 5 and 1600
  qualify row_number() over (partition by city order by how, level desc, boundary_id) = 1
""")
def l5(t: Tables) -> DataFrame:
    """Orders as candidate boundaries of their customer: filled ones bear the municipal name."""
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    name = F.concat(F.lit("Tówn "), F.translate(F.col("o_custkey").cast("string"), "0123456789", "abcdefghij"))
    label = F.when(st == "F", F.concat(F.lit("Greater "), name, F.lit(" Municipal Corporation"))).when(st == "P", name).otherwise("Elsewhere")
    ext = F.when((st == "F") & (pr == "1-URGENT"), F.col("o_custkey")).otherwise(-F.col("o_orderkey") - 1)
    candidates = t.orders.select(
        F.col("o_custkey").alias("city"), F.col("o_orderkey").alias("boundary_id"), label.alias("label"), ext.alias("external_id"),
        (F.pmod(F.substring(pr, 1, 1).cast("int"), F.lit(3)) + 6).alias("level"), (F.col("o_totalprice") / 200).alias("km2"),
        (pr == "2-HIGH").alias("holds"), (F.col("o_totalprice") / 100000).alias("km"),
    )
    town = F.concat(F.lit("Town "), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    cities = t.customer.select(F.col("c_custkey").alias("city"), town.alias("name"), F.col("c_custkey").alias("external_id"))
    return L.choose_boundary(candidates, cities)


@query("L6_match_shapes", """
  select place as slug, 'Nation ' || upper(letter) as shape_name, case when n_nationkey = 3 then 'duplicate' else 'matched' end as state from nations where n_nationkey <> 7
  union all select place, null, 'missing' from nations where n_nationkey = 7
  union all select 'land-h-and-isles', 'Land H & Isles', 'unmatched' from nations where n_nationkey = 7
""")
def l6(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Nation "), B.letter(F.col("n_nationkey")))
    shown = F.when(F.col("n_nationkey") == 7, "Land H & Isles").otherwise(name)
    copies = F.when(F.col("n_nationkey") == 3, F.array(shown, F.lower(shown))).otherwise(F.array(shown))
    shapes = t.nation.select(F.explode(copies).alias("shape_name"))
    return L.match_shapes(shapes, B.ranked_places(t).select(F.col("place").alias("slug")))


CLUSTER_KM = 0.12


def _flat(t: Tables) -> DataFrame:
    return points(t).select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y"))


view("cluster_rows", f"""
  select node as point_id, min(other) as cluster from (
    with recursive near as (select a.point_id as a, b.point_id as b from points a join points b on sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) <= {CLUSTER_KM}),
    reach as (select a as node, b as other from near union select r.node, n.b from reach r join near n on r.other = n.a)
    select * from reach) group by 1
""")


@query("L7_clusters", """
  select point_id, cluster, count(*) over (partition by cluster) as size from cluster_rows
""")
def l7(t: Tables) -> DataFrame:
    return L.clusters(_flat(t), CLUSTER_KM)


@query("L8_cluster_bounds", """
  select cluster, count(*) as size, min(lon) - greatest(0.12, (max(lon) - min(lon)) * 0.35) as lon0, min(lat) - greatest(0.1, (max(lat) - min(lat)) * 0.35) as lat0,
         max(lon) + greatest(0.12, (max(lon) - min(lon)) * 0.35) as lon1, max(lat) + greatest(0.1, (max(lat) - min(lat)) * 0.35) as lat1
  from cluster_rows join points using (point_id) group by 1 having count(*) >= 2
""", "lon0 lat0 lon1 lat1")
def l8(t: Tables) -> DataFrame:
    flat = _flat(t)
    return L.cluster_bounds(flat, L.clusters(flat, CLUSTER_KM))
