"""The filter audit, periodic runs and nearest neighbours: brute force, nulls, empty and long texts, repeats, empty tables."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statloom.llm import filter_audit, neighbours, periodic_runs

DOCS = "doc_id bigint, text string, lang string, source string, row bigint, part string, bit int, node string, block string"


def document(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", 1, "clash", 2, "clash", "clash")


def failures(text, ids, doc_id, texts):
    t, w = text or "", (text or "").split()
    told = ""
    told += "A" if len(w) < 200 else ""
    told += "B" if 100 * len(set(w)) < 50 * len(w) else ""
    told += "C" if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else ""
    told += "D" if any(c in "#$%&*|" for c in t) else ""
    return told + ("E" if doc_id is not None and any(o == t and i is not None and i < doc_id for i, o in zip(ids, texts, strict=True)) else "")


def test_audit_equals_every_order_applied(spark):
    r = random.Random(3)
    long = " ".join(f"w{i}" for i in range(260))
    texts = [None, "", "one two", long, long, long + " UPPER CASE WORDS" * 9, "a b " * 150, long + " #", "THE SAME $", "THE SAME $", "é " * 250]
    rows = [document(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(70)]
    rows += [rows[0], rows[0], document(None, long), document(None, long), document(3, "another text of an id")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 60, 2)] + [(0, 1, 1), (None, 1, 1)]
    ids, failing = filter_audit.failing_ids(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {(x.part, x.filter_order, x.step): x for x in filter_audit.audit(ids, failing).collect()}
    told = [(x[0], x[2] or "", failures(x[1], [y[0] for y in rows], x[0], [y[1] or "" for y in rows])) for x in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {p for _, p, _ in told}
    assert len(got) == len(parts) * 600
    shapley = dict.fromkeys([(p, f) for p in parts for f in "ABCDE"], 0)
    for p in parts:
        mine = [(i, f) for i, q, f in told if q == p]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                fails = sum(f in x[1] for x in mine)
                left = [x for x in left if f not in x[1]]
                shapley[p, f] += len(gone)
                x = got[p, order, step]
                assert (x.filter, x.kept, x.removed, x.redundant) == (f, len(left), len(gone), fails - len(gone))
                assert x.unique_fails == sum(y[1] == f for y in mine)
                assert (x.good_lost, x.toxic_lost) == (sum(y[0] in good for y in gone), sum(y[0] in toxic for y in gone))
    assert all(x.shapley == shapley[x.part, x.filter] for x in got.values())


def test_audit_of_chosen_orders_and_of_nothing(spark):
    rows = spark.createDataFrame([document(1, "a b c"), document(2, "a b c")], DOCS)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    ids, failing = filter_audit.failing_ids(rows, labels)
    some = filter_audit.audit(ids, {k: failing[k] for k in "AE"}, orders=["EA"]).orderBy("step").collect()
    assert [(x.filter, x.kept, x.removed, x.redundant) for x in some] == [("E", 1, 1, 0), ("A", 0, 1, 1)]
    ids, failing = filter_audit.failing_ids(rows.limit(0), labels)
    assert filter_audit.audit(ids, failing).count() == 0


def plain_runs(w):
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                part = w[start : i + q]
                if not any(part[p:] == part[: len(part) - p] for p in range(1, q)):
                    found.add((start, len(part), q))
            i += i == start
    return sorted(found, key=lambda x: (x[0], x[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(0, 59), st.integers(1, 9), st.integers(0, 40))
def test_runs_equal_brute_force(words, at, period, repeats):
    at = min(at, len(words))
    block = words[at : at + period]
    words = words[:at] + (block * repeats)[:80] + words[at:]
    assert periodic_runs.runs_of(np.array(words, np.int64)) == plain_runs(words)


def test_rules_of_the_grammar_give_the_sequence_back():
    r = random.Random(8)
    for _ in range(200):
        w = [r.randrange(3) for _ in range(r.randrange(60))]
        rules, sequence, first = periodic_runs.repair(w)

        def spelled(s, first=first, rules=rules):
            return [s] if s < first else [x for part in rules[s - first] for x in spelled(part)]

        assert [x for s in sequence for x in spelled(s)] == w
        pairs = list(zip(sequence, sequence[1:], strict=False))
        assert all(pairs.count(p) < 2 or p[0] == p[1] for p in pairs)


def test_long_texts_of_few_words_are_quick():
    for w in (np.zeros(400_000, np.int64), np.tile(np.arange(7), 60_000), np.random.default_rng(1).integers(0, 2, 60_000)):
        assert periodic_runs.runs_of(w)


@pytest.mark.parametrize("plant", [False, True])
def test_collapsed_texts(spark, plant):
    r = random.Random(4)
    prose = " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(400))
    texts = [None, "", " \t\x0b ", "no " * 9, "a b a b a b a b a", "x y z " * 5 + "tail", prose, "Word word " * 6, "ü ä " * 700, "solo"]
    rows = [document(i, texts[i % len(texts)]) for i in range(80)] + [document(None, "q q q q q q q"), document(3, "no " * 9), document(3, "no " * 9), document(-7, prose)]
    got = periodic_runs.collapse(spark.createDataFrame(rows, DOCS), plant=plant, keep_text=True).collect()
    want = []
    for doc_id, text, *_ in rows:
        w = (text or "").split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if plant and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        kept = " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        want.append((doc_id, len(w), len(runs), *top, top[1] and 1000 * top[1] // top[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)), kept))
    assert sorted((tuple(x[:9]) + (x.collapsed,) for x in got), key=str) == sorted(want, key=str)
    assert all([tuple(x) for x in row.runs] == sorted((tuple(x) for x in row.runs), key=lambda x: (x[0], x[2])) for row in got)
    assert periodic_runs.collapse(spark.createDataFrame([], DOCS), plant=plant).count() == 0


VECTORS = "vec_id bigint, embedding array<double>, label int, node bigint, block string, to bigint"


def vectors(spark, n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim)) * np.linspace(0.5, 2, n)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(45)] + [rows[20], rows[20]]
    rows += [(2000, None), (2020, []), (2040, [0.0] * dim), (2060, [None] * dim), (2080, [float("nan")] * dim), (2100, [float("inf")] * dim), (None, rows[3][1])]
    rows += [(3000 + 20 * i, [float(i + 1), 1.0]) for i in range(3)]
    return rows, spark.createDataFrame([(*r, 0, 9, "clash", 9) for r in rows], VECTORS)


def test_neighbours_of_a_table_that_one_group_holds_are_exact(spark):
    rows, table = vectors(spark, 300, 8, 2)
    got = neighbours.search(neighbours.build(table), table.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect()
    fine = {i: v for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    for q in [i for i in fine if i % 20 == 0]:
        near = sorted(((-float(np.dot(fine[q], v)), i) for i, v in fine.items() if i != q and len(v) == len(fine[q])))
        mine = [x for x in got if x.query_id == q]
        assert [x.rank for x in mine] == list(range(1, min(20, len(near)) + 1))
        assert np.allclose([x.score for x in mine], [-s for s, _ in near[:20]], rtol=1e-12, atol=1e-12)
        copies = [x.vec_id for x in mine if 1000 <= x.vec_id < 2000 or x.vec_id == 7]
        assert copies == sorted(copies)
    assert {x.query_id for x in got} == {i for i in fine if i % 20 == 0}
    assert neighbours.search(neighbours.build(table.limit(0)), table.limit(0)).count() == 0


def test_recall_over_many_groups(spark):
    x = np.random.default_rng(5).normal(size=(3000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = neighbours.search(neighbours.build(table), table.where("vec_id % 20 = 0"), k=20).toPandas()
    hits = 0
    for q, mine in got.groupby("query_id"):
        near = x @ x[q]
        near[q] = -np.inf
        hits += len(set(np.argsort(-near)[:20]) & set(mine.vec_id))
    assert hits / len(got) >= 0.95
