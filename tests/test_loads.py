"""Loads and jobs over large tables: results of odd rows, and plans that hold or parse no more than they must."""

from datetime import datetime
from decimal import Decimal

import pytest

from statloom.operators import extract as X
from statloom.operators import resolve as R
from statloom.plans import bindings as B
from statloom.plans import jobs as J
from statloom.plans import text_queries as T
from statloom.plans.registry import Tables


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Orders without lines or a date, lines without an order, an order of an unknown customer, NULL keys."""
    folder = str(tmp_path_factory.mktemp("odd"))
    day = datetime(2000, 8, 1)
    tables = {
        "customer": ([(1, "Customer#1", 0, 1.0, "A"), (2, "Customer#2", None, 1.0, "A")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": (
            [(1, 1, "F", 300000.0, day, "1-URGENT"), (2, 1, "P", 5.5, day, "2-HIGH"), (3, 1, "O", 7.25, None, None), (4, 2, "F", 1.0, day, "5-LOW"), (5, 9, "F", 1.0, day, "5-LOW"), (None, 1, None, None, day, None)],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        ),
        "lineitem": (
            [(1, 1, 1, 1, 2.0, 10.5, 0.1, 0.02, "R", "O", day), (1, 1, 1, 2, 3.0, None, None, 0.03, "A", "F", day), (4, 1, 2, 1, 4.0, 8.0, 0.0, 0.0, None, None, day),
             (5, 1, 1, 1, 9.0, 9.0, 0.0, 0.0, "R", "O", day), (7, 1, 1, 1, 9.0, 9.0, 0.0, 0.0, "R", "O", day), (None, 1, 1, 1, 9.0, 9.0, 0.0, 0.0, "R", "O", day)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, folder)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_yearly_sums_of_odd_rows(odd):
    got = {(r.place, r.year): r for r in B.yearly_sums(odd).collect()}
    assert set(got) == {("nation-a", 2000), ("nation-a", None), (None, 2000)}
    both, undated, nowhere = got["nation-a", 2000], got["nation-a", None], got[None, 2000]
    assert (both.known_run, both.n_orders, both.price, both.n_large, both.n_urgent, both.n_high) == (2, 3, Decimal("300005.50"), 1, 1, 2)
    assert (both.n_lines, both.quantity, both.discount, both.tax, both.extended) == (2, 5, Decimal("0.10"), Decimal("0.05"), Decimal("10.50"))
    assert (both.n_returned, both.n_accepted, both.n_open) == (1, 1, 1)
    assert (undated.known_run, undated.n_orders, undated.n_lines, undated.quantity) == (1, 1, None, None)
    assert (nowhere.n_orders, nowhere.n_lines, nowhere.quantity, nowhere.n_returned) == (1, 1, 4, 0)


def test_yearly_sums_keep_no_row_per_order(odd):
    """A map of sums per order grew with the split that a task reads."""
    text = plan(B.yearly_sums(odd))
    assert "ShuffledHashJoin [l_orderkey" in text
    assert "HashAggregate(keys=[l_orderkey" not in text and "Sort [l_orderkey" not in text


HEAD = "<table><tr><th>State/UT</th><th colspan=2>Own Revenue</th></tr><tr><th>1999-00 (A)</th><th>2000-01 (RE)</th></tr>"


def test_html_pages_are_parsed_once(spark):
    """A filter on the header's row moved below the parsed rows, so that every page was parsed a second time."""
    pages = spark.createDataFrame(
        [(1, f"{HEAD}<tr><td>1. X</td><td>5</td><td>6</td></tr></table>"), (2, "Another report"), (3, None), (4, HEAD), (5, "<tr><th>State/UT</th></tr>"),
         (6, f"<tr><td>z</td></tr>{HEAD}<tr><td>Y</td><td>7</td></tr><tr><td>Z</td><td>8</td><td>9</td><td>1</td></tr>")],
        "doc_id int, html string",
    )
    cells = X.html_table_cells(pages, "html", r"(?i)^state\s*/\s*ut")
    a, b = "1999-00 (A)", "2000-01 (RE)"
    assert sorted(map(tuple, cells.collect())) == [(1, "X", a, "5"), (1, "X", b, "6"), (6, "Z", a, "8"), (6, "Z", b, "9")]
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2  # its rows, and the cells of a row


def test_municipal_problems_read_placed_rows(spark):
    """Both kinds of problems and the figures start from one resolved table instead of parsing the pages each."""
    places = spark.createDataFrame([("x", "Xland", "state", None, None)], "slug string, name string, type string, valid_from date, valid_to date")
    pages = spark.createDataFrame([(1, f"{HEAD}<tr><td>1. Xland</td><td>0.5</td><td>-</td></tr><tr><td>Nowhere</td><td>1</td><td>2</td></tr>"), (2, "Another")], "doc_id int, html string")
    obs, problems = J.run("municipal-finance", {"pages": pages}, J.Reference(R.name_table(places), B.TODAY, B.NATIONAL), min_rows=2)
    assert [(r.place, r.period_label, r.value, r.is_provisional) for r in obs.collect()] == [("x", "1999-00", 50.0, False)]
    assert [r.problem for r in problems.collect()] == [
        "statement of own revenue of 1: few rows read", "statement of own revenue of 2: not found", "unknown place name 'Nowhere'",
    ]
    assert "(?is)<tr" not in problems._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("load", [T.load_report_rows, T.load_statement_pages])
def test_report_loads_sort_no_lines(odd, load):
    """Sorting the lines of a partition for the join took most of a task's memory."""
    text = plan(load(odd))
    assert "ShuffledHashJoin [l_orderkey" in text and "Sort [l_orderkey" not in text


def test_report_loads_of_odd_rows(odd):
    rows = T.load_report_rows(odd).select("doc_id", "nation", "n", "quantity", "returned", "letter").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 2, 5, 1, "A"), (2, None, 1, 4, 0, None)]
    second = {r.doc_id: r.text for r in T.load_statement_pages(odd).collect() if r.page == 2}
    assert set(second) == {1, 2} and "Nation A* 0 0 0 0 0 2 0 0 0" in second[1].split("\n")
