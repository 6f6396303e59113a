"""Nothing lost by rows of two sources, long texts in linear time, wide permutations, archives read by many tasks."""

import base64
import random
import time

from pyspark.sql import functions as F

from statloom.llm import mixing, secrets, surrogates, warc


def test_mixed_documents_hold_every_word_of_the_mix(spark):
    rows = [(1, "a b c", "A"), (1, "a b c", "B"), (2, "d e", "A"), (3, "f g h i", "B"), (3, "f g h i", "B"), (None, "x y", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    whole = mixing.mix(table, weights=[1.0], most=1.0).agg(F.sum("taken")).first()[0]
    assert whole == 18
    assert mixing.mixed_documents(table, weights=[1.0], most=1.0).agg(F.sum("taken")).first()[0] == whole


def test_long_texts_take_time_by_their_length():
    r = random.Random(2)
    blob = base64.b64encode(bytes(r.randrange(256) for _ in range(300_000))).decode()
    for text in (blob, "a" * 400_000, "a." * 200_000, "key=" * 100_000, "key: " * 80_000, 'key="' * 80_000, "1 " * 200_000, "{password:" * 40_000):
        started = time.perf_counter()
        assert sum(1 for _ in secrets.candidates(text)) >= 0 and sum(1 for _ in surrogates.mentions(text)) >= 0
        assert time.perf_counter() - started < 15


def test_values_that_end_together_give_the_whole_and_the_innermost():
    def found(text):
        return [text[c.start : c.end] for c in secrets.candidates(text)]

    assert found("secrets: token=abc123") == ["token=abc123", "abc123"]
    assert found("key=key=key=xyz") == ["key=key=xyz", "xyz"]
    assert found('secret="token=abc" password=hunter2!') == ["token=abc", "abc", "hunter2!"]


def test_no_letter_of_a_long_address_stays_for_long():
    r = random.Random(6)
    same = [0] * 200
    for k in range(12):
        local = "".join(r.choice("bcdfghjklmnpqrstvwxyz") for _ in range(200))
        made = surrogates.surrogate("email", f"{local}@example.org", b"%d" % k)
        for i, (a, b) in enumerate(zip(local, made, strict=False)):
            same[i] += a == b
    assert max(same) <= 6 and sum(same) < 12 * 200 / 21 * 1.6


def test_numbers_are_no_telephone_numbers():
    for text in ("12.345.678 people", "10 000 000 euros", "2023 1000 2000", "20 30 40 50"):
        assert not list(surrogates.mentions(text))
    for text in ("call 20 30 40 50 60", "Tel.: 12.345.678", "415 555 0123", "555-123-4567", "(415) 555-0123", "+33 1 23 45 67 89", "01 23 45 67 89"):
        assert [k for k, _ in surrogates.mentions(text)] == ["phone"]


def test_texts_that_have_to_know_something_and_others_come_out_alike(spark):
    names = [f"bob{i}@x.org" for i in range(40)]
    rows = [(i, f"write to {n} or Mr Miller, and Miller again; ask {names[i - 1]}") for i, n in enumerate(names)] + [(99, "nothing here"), (100, None), (100, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in surrogates.replace(table, b"k").collect()}
    assert len(got) == len({r[0] for r in rows}) and got[99].text == "nothing here" and got[100].text is None
    made = {}
    for i, n in enumerate(names):
        words = got[i].text.split()
        assert got[i].n_entities == 4 and "Miller" not in got[i].text and n not in got[i].text.split()
        assert made.setdefault(n, words[2]) == words[2] and made.setdefault(names[i - 1], words[-1]) == words[-1]
    assert len(set(made.values())) == len(names) and not set(made.values()) & set(names)


def test_archives_are_read_by_as_many_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "y" * 3000 + str(i)) for i in range(60)], "page_id bigint, url string, html string").repartition(12)
    manifest = warc.write_archives(warc.with_references(pages, 0), str(tmp_path), archive_bytes=200)
    chunks = warc.read_chunks(manifest, with_data=False)
    archives = manifest.count()
    assert archives >= 8
    tasks = chunks.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > archives // 3 and chunks.where("is_last").count() == 60
