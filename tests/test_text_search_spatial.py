import math
import random

import pytest
from pyspark.sql import functions as F

from statloom.operators import extract as X
from statloom.operators import polygons
from statloom.operators import search as Q
from statloom.operators import spatial as L


def page(spark, text):
    return spark.createDataFrame([(1, 1, text)], "doc_id int, page int, text string")


def test_wrapped_names_and_totals(spark):
    text = "TABLE 1A.1\n1 Alpha 1,234 5 6.5\nDadra and Nagar\n2 7 - 8\nHaveli\n3 Short 1 2\nTOTAL (ALL INDIA) 10 11 12\n4 City 9 9 9"
    got = [(r.name, r["values"]) for r in X.rejoin_wrapped(X.rows_until(page(spark, text), "TOTAL (ALL INDIA)")).orderBy("line_no").collect()]
    assert got == [("Alpha", ["1,234", "5", "6.5"]), ("Dadra and Nagar Haveli", ["7", "-", "8"]), ("All India", ["10", "11", "12"])]


def test_last_page_only(spark):
    pages = spark.createDataFrame([(1, 1, "TABLE 2\nx"), (1, 2, "TABLE 2\n(Concluded)")], "doc_id int, page int, text string")
    assert [r.page for r in X.locate_tables(pages, {"2": r"^TABLE 2$"}, ["2"]).collect()] == [2]


def test_items_with_values_inside_the_label(spark):
    text = "State - Key Indicators\n1. Women age 20-24 years\n12.5 (33.0) married18 (%) x\n2. No values here\n3. Rate 5 of 7.1 8.2 *"
    got = {r.item: (r.label, r["values"]) for r in X.segment_items(page(spark, text)).collect()}
    assert got == {0: ("Women age 20-24 years married (%)", ["12.5", "(33.0)"]), 2: ("Rate 5 of", ["7.1", "8.2", "*"])}


def test_header_periods_stop_at_the_second_block(spark):
    text = "Statement 5\n2019 to 2021\n2019 2020-22 2021 2019 2020-22\nAlpha 1 2 3 4 5\nBeta 7 8 9\nGamma 1 2"
    got = sorted((r.name, r.period_label, r.value) for r in X.zip_periods(page(spark, text), r"^([A-Z][a-z]+)\s+((?:\d+\s*)+)$").collect())
    assert got == [
        ("Alpha", "2019", 1.0), ("Alpha", "2020-22", 2.0), ("Alpha", "2021", 3.0), ("Beta", "2019", 7.0), ("Beta", "2020-22", 8.0), ("Beta", "2021", 9.0),
    ]


def test_chart_ends_at_the_legend(spark):
    text = "x\nComparison of State Average with National\n45%\nThe World\nAround Us\n50%\n60%\nMaths\n55%\nState National\n1%\nno\n2%"
    got = [(r.label, r.local, r.national) for r in X.pair_chart(page(spark, text)).collect()]
    assert got == [("The World Around Us", 45.0, 50.0), ("Maths", 60.0, 55.0)]


def test_words_table_reports_bad_cells(spark):
    def words(extra):
        head = [("Persons", 100), ("Males", 130), ("Females", 160)]
        base = [(1, 1, t, float(x), float(x + 20), 50.0) for t, x in head] + [(1, 1, "2001", 40.0, 60.0, 70.0)]
        return spark.createDataFrame(base + extra, "doc_id int, page int, text string, x0 double, x1 double, top double")

    good = [(1, 1, "30", 101.0, 119.0, 71.0), (1, 1, "10", 131.0, 149.0, 69.0), (1, 1, "20", 162.0, 178.0, 70.0)]
    table, bad = X.words_to_table(words(good))
    assert [(r.year, r.persons, r.males, r.females) for r in table.collect()] == [(2001, 30.0, 10.0, 20.0)] and bad.count() == 0
    table, bad = X.words_to_table(words(good + [(1, 1, "5", 132.0, 140.0, 70.0)]))
    assert table.count() == 0 and bad.count() == 1
    table, bad = X.words_to_table(words([good[0], good[1], (1, 1, "25", 162.0, 178.0, 70.0)]))
    assert table.count() == 0 and bad.first().problem.startswith("persons")


def test_empty_pages_give_no_rows(spark):
    empty = page(spark, "")
    for fn in (X.rejoin_wrapped, X.segment_items, X.pair_chart, X.wikitext_rows):
        assert fn(empty).count() == 0
    assert X.html_table_cells(empty, "text", "x").count() == 0
    assert X.zip_periods(empty, r"^(a)(b)$").count() == 0


@pytest.fixture(scope="module")
def entries(spark):
    part = spark.createDataFrame(
        [
            ("state", "Odisha", ["Odisha", "ओडिशा"], ["Orissa"], "eastern state"), ("city", "Bhubaneswar", ["Bhubaneswar"], [], ""),
            ("city", "Port Blair", ["Port Blair"], [], ""), ("indicator", "Air quality", ["Air quality"], [], "mean of readings"),
            ("pillar", "Health", ["Health"], [], "doctors and air quality"),
        ],
        "type string, title string, names array<string>, aliases array<string>, text string",
    )
    return Q.search_index([part]).withColumn("entry_id", F.col("title"))


@pytest.mark.parametrize(
    ("raw", "first"),
    [("orissa", "Odisha"), ("ORIS", "Odisha"), ("bhubneswar", "Bhubaneswar"), ("air", "Air quality"), ("blair", "Port Blair"), ("ओडिशा", "Odisha"), ("quality air", "Air quality"), ("aneswa", "Bhubaneswar"), ("doctors", "Health")],
)
def test_search_finds(spark, entries, raw, first):
    hits = Q.search(entries, spark.createDataFrame([(raw,)], "raw string")).orderBy("position").collect()
    assert hits and hits[0].title == first


def test_search_does_not_look_inside_words_for_short_queries(spark, entries):
    hits = Q.search(entries, spark.createDataFrame([("air",)], "raw string")).collect()
    assert "Port Blair" not in {h.title for h in hits}
    assert Q.search(entries, spark.createDataFrame([("zzzz",), ("",)], "raw string")).count() == 0


def test_blocking_misses_nothing(spark):
    """Candidates against brute force on random words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 7)))
    rows = [("page", f"t{i}", [f"{word()} {word()}"], [word()], f"{word()} {word()}") for i in range(120)]
    entries = Q.search_index([spark.createDataFrame(rows, "type string, title string, names array<string>, aliases array<string>, text string")])
    entries = entries.withColumn("entry_id", F.col("title"))
    queries = spark.createDataFrame([(q,) for q in {word() for _ in range(40)} | {f"{word()} {word()}" for _ in range(20)}], "query string")
    ours = {(r.query, r.title, r.score) for r in Q.score_terms(entries, queries).collect()}
    pairs = entries.join(queries, F.lit(True)).withColumn("_t", F.split("query", " "))
    q, tokens = F.col("query"), F.col("_t")
    names = F.array_max(F.transform("names", lambda n: Q.term_score(n, q, tokens, True)))
    alias = F.coalesce(F.array_max(F.transform("aliases", lambda a: Q.term_score(a, q, tokens, False))) * 0.9, F.lit(0.0))
    text = (F.length(q) >= 3) & F.forall(tokens, lambda t: F.exists(F.split("text", " "), lambda w: w.startswith(t)))
    score = F.greatest(names, alias)
    score = F.when(score > 0, score).when(text, 10.0).otherwise(0.0)
    brute = pairs.withColumn("s", score).filter("s > 0").select("query", "title", (F.col("s") - 2).alias("s"))
    assert ours == {(r.query, r.title, r.s) for r in brute.collect()}


def test_clusters_against_union_find(spark):
    rng = random.Random(11)
    pts = [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(250)] + [(1000 + i, 3 + rng.gauss(0, 0.05), 3 + rng.gauss(0, 0.05)) for i in range(250)]
    pts += [(5000, 50.0, 50.0), (5001, 50.0, 50.5), (5002, 50.0, 51.0), (6000, -5.0, -5.0), (6001, -5.0, -5.0)]
    parent = {p[0]: p[0] for p in pts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in pts:
        for b in pts:
            if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= 0.5:
                ra, rb = find(a[0]), find(b[0])
                parent[max(ra, rb)] = min(ra, rb)
    got = {r.point_id: r.cluster for r in L.clusters(spark.createDataFrame(pts, "point_id long, x double, y double"), 0.5).collect()}
    assert got == {p[0]: find(p[0]) for p in pts}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(303)], "node long")
    got = {r.node: r.component for r in L.connected_components(edges, nodes).collect()}
    assert {got[i] for i in range(301)} == {0} and got[301] == 301 and got[302] == 302


def test_point_in_polygon_and_boxes(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    edges = [("s", *a, *b) for a, b in zip(square, square[1:] + square[:1])]
    e = spark.createDataFrame(edges, "polygon_id string, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, "s", 2.0, 2.0), (2, "s", 5.0, 2.0), (3, "s", -1.0, 3.5), (4, "s", 0.5, 3.9)], "point_id int, polygon_id string, lon double, lat double")
    assert {r.point_id: r.inside for r in polygons.points_in_polygons(p, e).collect()} == {1: True, 2: False, 3: False, 4: True}
    a = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 10.0)], "f string, lon0 double, lat0 double, lon1 double, lat1 double")
    b = spark.createDataFrame([("in", 1.0, 1.0, 2.0, 2.0), ("touch", 10.0, 0.0, 11.0, 1.0), ("over", 9.0, 9.0, 30.0, 30.0)], "b string, lon0 double, lat0 double, lon1 double, lat1 double")
    assert sorted(r.b for r in L.bbox_join(a, b).collect()) == ["in", "over"]


def test_nearest_vertex_of_a_hot_shape(spark):
    rng = random.Random(11)
    corners = [("s", 77 + rng.random(), 20 + rng.random()) for _ in range(400)] + [("t", 10.0, 50.0), ("t", 10.0, 50.0)]
    asked = [(i, "s" if i % 5 else "t", 76 + 3 * rng.random(), 19 + 3 * rng.random()) for i in range(60)]

    def km(lon1, lat1, lon2, lat2):
        a, b = math.radians(lat2 - lat1) / 2, math.radians(lon2 - lon1) / 2
        return 2 * L.EARTH_KM * math.asin(min(1, math.sqrt(math.sin(a) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(b) ** 2)))

    want = {i: min(km(x, y, cx, cy) for s, cx, cy in corners if s == shape) for i, shape, x, y in asked}
    vertices = spark.createDataFrame(corners, "shape_id string, lon double, lat double")
    for cell in (0.02, 0.3):
        got = L.nearest_vertex(spark.createDataFrame(asked, "point_id int, shape_id string, lon double, lat double"), vertices, cell)
        assert {r.point_id: r.km for r in got.collect()} == pytest.approx(want, abs=1e-9)


def test_features_that_meet_any_box(spark):
    rng = random.Random(2)
    features, boxes = ([(i, x := rng.uniform(0, 9), y := rng.uniform(0, 9), x + rng.uniform(0.1, 2.5), y + 0.4) for i in range(80)] for _ in range(2))
    schema = "id int, lon0 double, lat0 double, lon1 double, lat1 double"
    got = L.meeting_any(spark.createDataFrame(features, schema), spark.createDataFrame(boxes[:30], schema))
    want = {f[0] for f in features if any(f[1] < b[3] and f[3] > b[1] and f[2] < b[4] and f[4] > b[2] for b in boxes[:30])}
    rows = [r.id for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def _random_entries(spark, rng, n):
    """Few letters and short words, so that every kind of match and many ties occur."""
    def word():
        return "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))

    def term():
        return " ".join(word() for _ in range(rng.randint(1, 3)))

    rows = [
        (rng.choice(["state", "city", "page"]), term(), [term() for _ in range(rng.randint(0, 2))] + ["common"], [term()] * rng.randint(0, 1), term())
        for _ in range(n)
    ]
    part = spark.createDataFrame(rows, "type string, title string, names array<string>, aliases array<string>, text string")
    queries = sorted({word() for _ in range(60)} | {term() for _ in range(40)} | {"common", "c", "comon", "ommo", "a"})
    return Q.search_index([part]).withColumn("entry_id", F.monotonically_increasing_id()), spark.createDataFrame([(q,) for q in queries], "raw string")


@pytest.mark.parametrize("k", [1, 3, 8])
def test_heads_of_lists_hold_the_best(spark, k):
    entries, queries = _random_entries(spark, random.Random(k), 250)
    entries = spark.createDataFrame(entries.collect(), entries.schema)
    order = [F.col("score").desc(), F.length("title"), F.col("title"), F.col("entry_id")]
    every = Q.score_terms(entries, queries.select(F.col("raw").alias("query")))
    want = Q.top_rows(every, ["query"], order, k).select("query", "position", "entry_id", "score")
    got = Q.search(entries, queries, k).select("query", "position", "entry_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_one_letter_scores_few_of_many(spark):
    """20,000 entries begin with the letter: what is scored depends on k and the types, not on their number."""
    n, k = 20_000, 8
    entries = spark.range(n).select(
        F.col("id").alias("entry_id"), F.lit("city").alias("type"), F.format_string("a%05d", "id").alias("title"),
        F.array(F.format_string("a%05d", "id"), F.lit("all of them")).alias("names"), F.array(F.lit("alias")).alias("aliases"), F.lit("at large").alias("text"),
    )
    pairs = Q.best_candidates(entries, spark.createDataFrame([("a",), ("all",), ("them",)], "query string"), k)
    counts = {r["query"]: r["count"] for r in pairs.groupBy("query").count().collect()}
    assert set(counts) == {"a", "all", "them"} and max(counts.values()) <= 8 * k
