import random
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import functions as F

from statloom.operators import terms as T
from statloom.operators.vintage import latest_vintage
from statloom.streaming import jobs as J

OBS = (
    "indicator_id string, place string, period_start date, period_end date, period_label string, value double, is_provisional boolean"
)
YEAR = (date(2020, 1, 1), date(2020, 12, 31), "2020")
STATE = (
    "external_id string, place string, office_type string, person_name string, start date, end date, verified date, note string"
)
LISTS = "place string, office_type string, person_name string, note string, day date"


def figures(spark, *values):
    return spark.createDataFrame([("i", place, *YEAR, value, False) for place, value in values], OBS)


def test_a_retried_batch_lands_once(spark, tmp_path):
    path = str(tmp_path / "history")
    load = J.load_batches(path, str(tmp_path / "mark"))
    first, second = figures(spark, ("a", 1.0), ("b", 2.0)), figures(spark, ("a", 1.5), ("b", 2.0))
    load(first, 0)
    load(second, 1)
    load(second, 1)
    rows = spark.read.parquet(path)
    assert rows.count() == 3
    assert {r.place: r.value for r in latest_vintage(rows).collect()} == {"a": 1.5, "b": 2.0}


def test_an_empty_first_batch(spark, tmp_path):
    path = str(tmp_path / "history")
    load = J.load_batches(path, str(tmp_path / "mark"))
    load(figures(spark, ("a", 1.0)).limit(0), 0)
    load(figures(spark, ("a", 1.0)), 1)
    load(figures(spark, ("a", 1.0)), 2)
    assert [(r.place, r.run_id) for r in spark.read.parquet(path).collect()] == [("a", 0)]


def test_a_new_checkpoint_goes_on_after_the_history(spark, tmp_path):
    path = str(tmp_path / "history")
    J.load_batches(path, str(tmp_path / "old"))(figures(spark, ("a", 1.0), ("b", 2.0)), 0)
    fresh = J.load_batches(path, str(tmp_path / "new"))
    fresh(figures(spark, ("a", 1.5), ("b", 2.0)), 0)
    fresh(figures(spark, ("a", 1.5), ("b", 2.0)), 0)
    rows = {(r.place, r.value, r.run_id) for r in spark.read.parquet(path).collect()}
    assert rows == {("a", 1.0, 0), ("b", 2.0, 0), ("a", 1.5, 1)}


def test_what_a_load_reads_does_not_grow_with_the_history(spark, tmp_path):
    path, want, files = str(tmp_path / "history"), {}, []
    load = J.load_batches(path, str(tmp_path / "mark"), every=4, buckets=4)
    for run in range(17):
        values = {f"p{k}": float(run // (k + 1)) for k in range(12)}
        known = J.numbered(spark, path, "run_id")
        state = J.current_state(spark, path, run, known, buckets=4)
        if state is not None:
            files.append(len(state.inputFiles()))
            assert {r.place: r.value for r in state.collect()} == want
            one = J.current_state(spark, path, run, known, touched=[2], buckets=4)
            assert {r.place for r in one.collect()} < set(want)
        load(figures(spark, *values.items()), run)
        if run % 5 == 0:
            load(figures(spark, *values.items()), run)  # a retry, also of runs that end in a snapshot
        want.update(values)
    rows = spark.read.parquet(path)
    assert {r.place: r.value for r in latest_vintage(rows).collect()} == want
    assert rows.count() == sum(1 + sum(r // (k + 1) != (r - 1) // (k + 1) for r in range(1, 17)) for k in range(12))
    assert max(files) <= 4 + 3 * 4  # a snapshot of four buckets and three runs, however many there are


def test_a_history_without_snapshots_goes_on(spark, tmp_path):
    path = str(tmp_path / "history")
    for run in range(3):
        J.load_batches(path, str(tmp_path / "old"), every=100)(figures(spark, ("a", 1.0 + run), ("b", 2.0)), run)
    for run in range(3):
        J.load_batches(path, str(tmp_path / "new"), every=2)(figures(spark, ("a", 5.0 + run), ("b", 2.0)), run)
    rows = sorted((r.place, r.value, r.run_id) for r in spark.read.parquet(path).collect())
    assert rows == [*(("a", float(v), n) for n, v in enumerate([1, 2, 3, 5, 6, 7])), ("b", 2.0, 0)]


def test_late_readings_are_dropped(spark, tmp_path):
    schema = "place string, observed_at timestamp, value double"
    land = str(tmp_path / "land")
    Path(land).mkdir()
    stream = spark.readStream.schema(schema).parquet(land)
    sink, mark = str(tmp_path / "sink"), str(tmp_path / "mark")

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(land)
        J.run_available(J.daily_means(stream, "1 day"), mark, path=sink)

    run([("x", datetime(2024, 1, 1, 8), 10.0), ("x", datetime(2024, 1, 1, 9), 20.0), ("x", datetime(2024, 1, 5), 1.0)])
    run([("x", datetime(2024, 1, 1, 10), 900.0), ("x", datetime(2024, 1, 9), 1.0)])
    days = {r.day.day: (r["mean"], r.readings) for r in spark.read.parquet(sink).collect()}
    assert days == {1: (15.0, 2), 5: (1.0, 1)}


def test_daily_lists_over_two_triggers(spark, tmp_path):
    land, states, mark = str(tmp_path / "land"), str(tmp_path / "states"), str(tmp_path / "mark")
    empty = spark.createDataFrame([], STATE)
    Path(land).mkdir()
    stream = spark.readStream.schema(LISTS).parquet(land)

    def run(rows):
        spark.createDataFrame([("p", "dgp", n, "seen", d) for n, d in rows], LISTS).write.mode("append").parquet(land)
        J.run_available(stream, mark, each=J.observe_batches(states, mark, empty, minimum=1))

    run([("Ann", date(2024, 1, 1)), ("Ann", date(2024, 1, 2)), ("Bob", date(2024, 1, 3))])
    run([("Cid", date(2024, 1, 4))])
    final = spark.read.parquet(f"{states}/state=1")
    got = {r.person_name: (r.start, r.end) for r in final.select("person_name", "start", F.col("end")).collect()}
    assert got == {
        "Ann": (date(2024, 1, 1), date(2024, 1, 2)), "Bob": (date(2024, 1, 3), date(2024, 1, 3)), "Cid": (date(2024, 1, 4), None),
    }


def test_a_short_list_closes_nothing_and_is_reported(spark, tmp_path):
    states, mark = str(tmp_path / "states"), str(tmp_path / "mark")
    step = J.observe_batches(states, mark, spark.createDataFrame([], STATE), minimum=2)
    rows = [("p", "dgp", n, "seen", d) for n, d in [("Ann", date(2024, 1, 1)), ("Bob", date(2024, 1, 1)), ("Cid", date(2024, 1, 2))]]
    step(spark.createDataFrame(rows, LISTS), 0)
    assert {(r.person_name, r.end) for r in spark.read.parquet(f"{states}/state=0").collect()} == {("Ann", None), ("Bob", None)}
    assert [tuple(r) for r in spark.read.parquet(f"{states}/refused=0").collect()] == [(date(2024, 1, 2), 1, 2)]


def test_days_in_one_pass_equal_days_one_by_one(spark):
    dice = random.Random(5)
    people = [(place, office, name) for place in "pq" for office in ("dgp", "governor") for name in ("Ann", "Bob", "Cid")]
    days = [date(2024, 1, d) for d in range(1, 8)]
    rows = []
    for day in days:
        offices = {(p, o) for p, o, _ in people if dice.random() < 0.7}
        rows += [(p, o, n, dice.choice(["seen", None]), day) for p, o, n in people if (p, o) in offices and dice.random() < 0.5]
    old = [
        (f"observed:{p}:{o}:{n.lower()}", p, o, n, date(2023, 1, 1), dice.choice([None, date(2023, 6, 1)]), date(2023, 1, 1), "old")
        for p, o, n in people if dice.random() < 0.6
    ]
    lists, current = spark.createDataFrame(rows, LISTS), spark.createDataFrame(old, STATE)
    state = current
    for day in days:
        seen = T.observe(state, lists.filter(F.col("day") == F.lit(day)).drop("day"), day).drop("action")
        state = spark.createDataFrame(seen.collect(), STATE)
    in_one = T.observe_days(current, lists, 1).select(*state.columns)
    assert sorted(map(repr, in_one.collect())) == sorted(map(repr, state.collect()))
