"""The n-gram join where many documents share passages: what it writes, and its result against all pairs."""

import random

import numpy as np
import pytest

from statloom.llm import ngram_join
from statloom.llm.texts import mix


def corpus(n, copies=0, seed=5):
    """Documents of their own words between passages that some six documents hold each; every `copies`th one repeats another but for a word."""
    r, own = random.Random(seed), iter(range(10**6))
    passages = [[f"p{i}{c}" for c in "abcdef"] for i in range(n // 2)]
    texts = []
    for i in range(n):
        if copies and i % copies == copies - 1:
            w = texts[r.randrange(len(texts))].split()
            texts.append(" ".join([*w[:-1], f"o{next(own)}"]))
            continue
        w = []
        for p in r.sample(passages, 3):
            w += [f"o{next(own)}" for _ in range(12)] + p
        texts.append(" ".join(w))
    return list(enumerate(texts))


@pytest.fixture
def written(monkeypatch):
    rows, write = {}, ngram_join.materialize

    def counted(df, name):
        df = write(df, name)
        rows[name] = df.count()
        return df

    monkeypatch.setattr(ngram_join, "materialize", counted)
    return rows


def test_passages_of_a_few_documents_make_no_candidates(spark, written):
    table = spark.createDataFrame(corpus(240), "doc_id bigint, text string").repartition(8)
    assert {tuple(x) for x in ngram_join.component_table(table).select("doc_id", "component_id").collect()} == {(i, i) for i in range(240)}
    # Every document has tokens of its own for a whole prefix, and those are not written; hash collisions aside.
    assert written["members"] == 0 and written["wanted"] == 0 and written["postings"] < 240


@pytest.mark.parametrize("block", [2, 128])
def test_counted_order_finds_what_all_pairs_find(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "SMALL_BLOCK", block)
    rows = corpus(150, copies=3) + [(1000 + i, "p0a p0b p0c p0d" + " x" * (i % 3)) for i in range(12)]
    sets = [{tuple(x) for x in zip(w, w[1:], w[2:], strict=False)} for w in (t.split() for _, t in rows)]
    label = [i for i, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert len(set(label)) < 120
    got = ngram_join.component_table(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == sorted((i, c) for (i, _), c in zip(rows, label, strict=True))


def test_counted_tokens_come_first_and_rarest_first():
    tokens = mix(np.arange(1, 401, dtype=np.uint64))
    mixed = mix(tokens ^ np.uint64(ngram_join.ORDERS[0]))
    share = tokens[ngram_join._scouted(mixed, 90)]
    levels = np.zeros((len(ngram_join.LEVELS), (1 << ngram_join.SLOT_BITS) // 8), np.uint8)
    for i, t in enumerate(share[: len(share) - 30]):  # all but 30 were counted more than once
        at = int(t) >> (64 - ngram_join.SLOT_BITS)
        levels[: 1 + i % 4, at >> 3] |= np.uint8(1 << (at & 7))
    none = np.empty(0, np.uint64), np.empty(0, np.uint64)
    got = ngram_join.prefix(tokens, ngram_join.ORDERS[0], 90, none, levels)
    assert len(got) == 41 and set(got[:30]) == set(share[-30:])
    found = ngram_join._level(got, levels)
    assert (np.diff(found.astype(int)) >= 0).all() and set(got) <= set(share)
    few = share[:1], tokens[~ngram_join._scouted(mixed, 90)][:39]  # too few of the share: the others follow
    assert ngram_join.prefix(np.concatenate(few), ngram_join.ORDERS[0], 90, none, levels)[0] == share[0]
