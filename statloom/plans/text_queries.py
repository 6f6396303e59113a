"""Registered queries of text extraction. Spark prints tables as page text; parsing must give them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.text import clean_number, status_of
from statloom.operators import extract as X
from statloom.plans import bindings as B
from statloom.plans.derive_queries import yearly
from statloom.plans.registry import Tables, query, view

# Lines shipped per supplier and customer nation: the table each supplier's report prints.
view("report_rows", """
  select l_suppkey as doc_id, c_nationkey as nation, chr(65 + c_nationkey) as letter, count(*) as n,
         sum(l_quantity)::bigint as quantity, count(*) filter (where l_returnflag = 'R') as returned
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2
""")


def load_report_rows(t: Tables) -> DataFrame:
    """The orders of a partition are hashed, so that lines need no sort."""
    who = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return (
        t.lineitem.join(who.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("l_suppkey").alias("doc_id"), F.col("c_nationkey").alias("nation"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"),
            F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        )
        .withColumn("letter", B.letter(F.col("nation")))
    )


def report_rows(t: Tables) -> DataFrame:
    return t.stored("report_rows", load_report_rows)


def _text(c: Column) -> Column:
    return c.cast("string")


def _dash(c: Column) -> Column:
    return F.when(c == 0, "-").otherwise(F.format_number(c, 0))


def printed(t: Tables, line: Column, head: Column | str, tail: Column | str) -> DataFrame:
    """One page per supplier: a head, one line per nation (25 at most), a tail."""
    rows = report_rows(t).withColumn("_line", line)
    pages = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("nation", "_line"))).alias("_l"), F.sum("n").alias("n"),
        F.sum("quantity").alias("quantity"), F.sum("returned").alias("returned"),
    )
    body = F.array_join(F.transform("_l", lambda x: x["_line"]), "\n")
    head = F.lit(head) if isinstance(head, str) else head
    tail = F.lit(tail) if isinstance(tail, str) else tail
    return pages.select("doc_id", F.lit(1).alias("page"), F.concat_ws("\n", head, body, tail).alias("text"))


def crime_pages(t: Tables) -> DataFrame:
    """Numbered rows; the names of nations U and above wrap around their numbers."""
    values = F.concat_ws(" ", F.format_number("n", 0), F.format_number("quantity", 0), _dash(F.col("returned")))
    number = _text(F.col("nation") + 1)
    line = F.when(F.col("nation") >= 20, F.concat(F.lit("Nation\n"), number, F.lit(" "), values, F.lit("\n"), "letter")).otherwise(
        F.concat(number, F.lit(" Nation "), "letter", F.lit(" "), values)
    )
    total = F.concat_ws(" ", F.lit("TOTAL (ALL INDIA)"), F.format_number("n", 0), F.format_number("quantity", 0), _dash(F.col("returned")))
    head = F.concat(F.lit("  TABLE 1A.1\nLines by nation"), F.when(F.col("doc_id") < 40, " (Concluded)").otherwise(""), F.lit("\nSL State/UT A B C"))
    return printed(t, line, head, F.concat(total, F.lit("\n1 Some City 1 2 3\nSource: records")))


@query("X1_explode_lines", """
  select doc_id, len(string_split(text, chr(10))) as lines, sum(length(trim(l, ' '))) as chars
  from documents, lateral (select unnest(string_split(text, chr(10))) as l) group by doc_id, text
""")
def x1(t: Tables) -> DataFrame:
    lines = X.explode_lines(t.documents.select("doc_id", "text"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


@query("X2_locate_tables", """
  select doc_id, 'all' as table_id from report_rows group by 1 union all
  select doc_id, 'last' from report_rows where doc_id < 40 group by 1
""")
def x2(t: Tables) -> DataFrame:
    headings = {"all": r"^TABLE\s+1A\.1\s*$", "last": r"^TABLE\s+1A\.1\s*$", "other": r"^TABLE\s+2B\.1\s*$"}
    return X.locate_tables(crime_pages(t), headings, ["last"]).select("doc_id", "table_id")


@query("X3_split_trailing_values", """
  select doc_id, nation, 'Nation ' || letter as name, 3 as n_values, quantity from report_rows where nation < 20
""")
def x3(t: Tables) -> DataFrame:
    lines = X.split_trailing_values(X.explode_lines(crime_pages(t)))
    rows = lines.filter(F.col("name").rlike(r"^\d+ Nation "))
    return rows.select(
        "doc_id", (F.regexp_extract("name", r"^(\d+)", 1).cast("bigint") - 1).alias("nation"),
        F.regexp_replace("name", r"^\d+ ", "").alias("name"), F.size("values").alias("n_values"),
        clean_number(F.col("values")[1]).cast("bigint").alias("quantity"),
    )


@query("X4_X24_rejoin_wrapped", """
  select doc_id, 'Nation ' || letter as name, n, quantity, nullif(returned, 0) as returned from report_rows
  union all select doc_id, 'All India', sum(n)::bigint, sum(quantity)::bigint, nullif(sum(returned)::bigint, 0) from report_rows group by 1
""")
def x4(t: Tables) -> DataFrame:
    """City rows below the total are cut off first."""
    rows = X.rejoin_wrapped(X.rows_until(crime_pages(t), "TOTAL (ALL INDIA)"))
    values = [clean_number(F.col("values")[i]).cast("bigint") for i in range(3)]
    return rows.select("doc_id", "name", values[0].alias("n"), values[1].alias("quantity"), values[2].alias("returned"))


def revenue_pages(t: Tables) -> DataFrame:
    values = F.concat_ws(" ", F.format_number("n", 0), F.format_number("quantity", 0), F.lit("5%"), F.format_number("returned", 0), F.format_number("n", 0), F.lit("-3%"))
    line = F.when(F.col("nation") >= 15, F.concat(F.lit("Upper and\nLower Nation "), "letter", F.lit(" "), values)).otherwise(
        F.concat(F.lit("Nation "), "letter", F.lit(" "), values)
    )
    return printed(t, line, "Table-2: collections till July, 2001\nState 2000 2001 growth", "Other Territory 1 2 3% 4 5 6%\nGrand Total 7 8 9% 10 11 12%")


@query("X5_X6_carry_pending", """
  select doc_id, case when nation >= 15 then 'Upper and Lower Nation ' else 'Nation ' end || letter as name, returned as last, n as this from report_rows
  union all select doc_id, 'Other Territory', 4, 5 from report_rows group by 1
  union all select doc_id, 'Grand Total', 10, 11 from report_rows group by 1
""")
def x5(t: Tables) -> DataFrame:
    lines = X.carry_pending(revenue_pages(t), r"%\s*$")
    rows = X.split_trailing_values(lines, value=rf"(?:{X.VALUE}%?)").filter("size(values) = 6")
    rows = rows.select("doc_id", "name", *[clean_number(F.get("values", F.lit(k))).alias(c) for k, c in ((3, "last"), (4, "this"))])
    return rows.select("doc_id", "name", F.col("last").cast("bigint").alias("last"), F.col("this").cast("bigint").alias("this"))


@query("X7_extract_ci_rows", """
  select doc_id, 'Nation ' || letter as name, quantity as value, quantity - n as ci_low, quantity + n as ci_high from report_rows
""")
def x7(t: Tables) -> DataFrame:
    q, n = F.col("quantity"), F.col("n")
    line = F.concat(F.lit("Nation "), "letter", F.lit(" "), _text(q), F.lit(" ( "), _text(q - n), F.lit(" , "), _text(q + n), F.lit(" ) x"))
    pages = printed(t, line, "MMR table", "Subtotal 5 ( 1 , 9 )\nOther States 6 ( 2 , 8 )")
    rows = X.extract_ci_rows(X.explode_lines(pages))
    return rows.select("doc_id", "name", *[F.col(c).cast("bigint").alias(c) for c in ("value", "ci_low", "ci_high")])


# Orders per customer nation and year, printed per nation of the supplier as an annual statement.
view("statement_rows", """
  select l_suppkey as doc_id, chr(65 + c_nationkey) as letter, year(o_orderdate) as year, count(*) as n
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2, 3
""")
YEARS = list(range(1995, 2002))


def load_statement_pages(t: Tables) -> DataFrame:
    """Two pages per supplier: one only mentions the statement, the next one has its table.

    The header names the seven years twice (a second block follows); the second block repeats the
    first two years.
    """
    who = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", B.letter(F.col("c_nationkey")).alias("letter"), F.year("o_orderdate").alias("year")
    )
    lines = t.lineitem.join(who.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.groupBy(F.col("l_suppkey").alias("doc_id"), "letter").agg(
        *[F.count_if(F.col("year") == y).alias(f"y{y}") for y in YEARS]
    )
    values = [_text(F.col(f"y{y}")) for y in YEARS]
    line = F.concat(F.lit("Nation "), "letter", F.lit("* "), F.concat_ws(" ", *values, *values[:2]))
    pages = rows.withColumn("_line", line).groupBy("doc_id").agg(F.array_sort(F.collect_list("_line")).alias("_l"))
    header = " ".join(str(y) for y in YEARS + YEARS[:2])
    second = F.concat_ws(
        "\n", F.lit(f"Nation Z 9 9 9 9 9 9 9\nStatement 5: Lines from 1995 to 2001\n{header}"), F.array_join("_l", "\n"), F.lit("Note")
    )
    both = F.array(
        F.struct(F.lit(1).alias("page"), F.lit("Contents\nStatement 5: Lines\nnothing here").alias("text")),
        F.struct(F.lit(2).alias("page"), second.alias("text")),
    )
    return pages.select("doc_id", F.explode(both).alias("p")).select("doc_id", "p.page", "p.text")


def statement_pages(t: Tables) -> DataFrame:
    return t.stored("statement_pages", load_statement_pages)


STATEMENT_ROW = r"^([A-Za-z][A-Za-z&*().,' -]*?)\s+((?:\d+(?:\.\d+)?)(?:\s+\d+(?:\.\d+)?)*)$"


@query("X8_rows_after_heading", "select doc_id, 2 as page, count(distinct letter) as rows from statement_rows group by 1")
def x8(t: Tables) -> DataFrame:
    found = X.rows_after_heading(statement_pages(t), "Statement 5:", r"^Nation [A-Z]\* \d")
    return found.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("rows"))


@query("X9_X10_zip_periods", """
  with d as (select doc_id, letter from statement_rows group by 1, 2)
  select doc_id, 'Nation ' || letter as name, y::varchar as period_label, coalesce(n, 0)::double as value
  from d cross join (select unnest(range(1995, 2002)) as y) left join statement_rows s using (doc_id, letter) where s.year = y
  union all select doc_id, 'Nation ' || letter, y::varchar, 0.0 from d cross join (select unnest(range(1995, 2002)) as y)
  where not exists (select 1 from statement_rows s where s.doc_id = d.doc_id and s.letter = d.letter and s.year = y)
""")
def x9(t: Tables) -> DataFrame:
    pages = statement_pages(t).filter("page = 2").withColumn("text", F.regexp_replace("text", r"(?s)^.*?Statement 5:", "Statement 5:"))
    rows = X.zip_periods(pages, STATEMENT_ROW)
    return rows.filter(F.col("name").startswith("Nation")).select("doc_id", "name", "period_label", "value")


@query("X11_segment_items", """
  select place as doc_id, 'Sales in ' || year || ' of the place (%)' as label, n || ',' || n_p as values from yearly
""")
def x11(t: Tables) -> DataFrame:
    """A fact sheet per customer: one numbered item per year, its label wrapped around two numbers."""
    n = F.row_number().over
    from pyspark.sql import Window

    numbered = yearly(t).withColumn("_no", n(Window.partitionBy("place").orderBy("year")))
    item = F.concat(
        _text(F.col("_no")), F.lit(". Sales in "), _text(F.col("year")), F.lit(" of\n"), _text(F.col("n")), F.lit(" "), _text(F.col("n_p")),
        F.lit(" the place12 (%) and more"),
    )
    docs = numbered.groupBy(F.col("place").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("_no", item.alias("i")))).alias("_l"))
    docs = docs.select("doc_id", F.concat(F.lit("State - Key Indicators\n"), F.array_join(F.transform("_l", lambda x: x["i"]), "\n")).alias("text"))
    rows = X.segment_items(docs)
    return rows.select("doc_id", "label", F.array_join("values", ",").alias("values"))


@query("X12_pair_chart", """
  with c as (select o_custkey as doc_id, count(*) as n, count(*) filter (where o_orderstatus = 'F') as f,
             count(*) filter (where o_orderstatus = 'P') as p from orders group by 1)
  select doc_id, 'Orders filled' as label, (f * 100 // n)::double as local, 33.0::double as national from c
  union all select doc_id, 'Pending', (p * 100 // n)::double, 34.0::double from c
""")
def x12(t: Tables) -> DataFrame:
    st = F.col("o_orderstatus")
    counts = t.orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(st == "F").alias("f"), F.count_if(st == "P").alias("p")
    )

    def pct(c: str) -> Column:
        return F.concat(_text(F.floor(F.col(c) * 100 / F.col("n"))), F.lit("%"))

    text = F.concat(
        F.lit("GRADE 3\nComparison of State Average with National\n"), pct("f"), F.lit("\nOrders\nfilled\n33%\n"), pct("p"),
        F.lit("\nPending\n34%\nState National\n99%\nnot a row\n98%"),
    )
    return X.pair_chart(counts.select("doc_id", text.alias("text")))


@query("X13_words_to_table", """
  select r as doc_id, 1 as page, year, rank as place_no, n::double as persons, f::double as males, (n - f)::double as females
  from (select n_regionkey as r, n_nationkey, year(o_orderdate) as year, count(*) as n, count(*) filter (where o_orderstatus = 'F') as f
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3)
  join (select n_nationkey as k, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as rank from nation) on k = n_nationkey
""")
def x13(t: Tables) -> DataFrame:
    table, _ = X.words_to_table(projection_words(t))
    return table


def projection_words(t: Tables) -> DataFrame:
    """Order counts of a region's nations and years, scattered as words over a page."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    nations = t.nation.select("n_nationkey", "n_regionkey", rank.alias("k"))
    counts = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_regionkey", "k", F.year("o_orderdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    )

    def word(text: Column, x: Column, top: Column) -> Column:
        return F.struct(text.alias("text"), x.cast("double").alias("x0"), (x + 20).cast("double").alias("x1"), top.cast("double").alias("top"))

    at, top = F.col("k") * 90 + 100, (F.col("year") - 1990) * 12 + 60
    numbers = F.array(
        word(F.format_number("n", 0), at + 3, top + 1), word(F.format_number("f", 0), at + 30 - 4, top - 1),
        word(F.format_number(F.col("n") - F.col("f"), 0), at + 60 + 2, top),
    )
    cells = counts.select(F.col("n_regionkey").alias("doc_id"), F.explode(numbers).alias("w"))
    years = counts.select(F.col("n_regionkey").alias("doc_id"), word(_text(F.col("year")), F.lit(40), top).alias("w")).distinct()
    heads = nations.select(
        F.col("n_regionkey").alias("doc_id"),
        F.explode(F.array(word(F.lit("Persons"), at, F.lit(50)), word(F.lit("Males"), at + 30, F.lit(50)), word(F.lit("Females"), at + 60, F.lit(50)))).alias("w"),
    )
    noise = t.region.select(F.col("r_regionkey").alias("doc_id"), word(F.lit("7"), F.lit(300), F.lit(900)).alias("w"))
    return cells.unionByName(years).unionByName(heads).unionByName(noise).select("doc_id", F.lit(1).alias("page"), "w.*")


@query("X14_F8_html_table_cells", """
  select doc_id, 'Nation ' || letter as name, 1999 as start_year, 'A' as status, n::double as value from report_rows
  union all select doc_id, 'Nation ' || letter, 2000, 'RE', case when returned > 0 then returned::double end from report_rows
""")
def x14(t: Tables) -> DataFrame:
    line = F.concat(
        F.lit("<tr><td>"), _text(F.col("nation") + 1), F.lit(". Nation&nbsp;"), "letter", F.lit("</td><td><b>"), F.format_number("n", 0),
        F.lit("</b></td><td>"), _dash(F.col("returned")), F.lit("</td><td>1</td><td>8</td></tr>"),
    )
    head = (
        "<html><table><tr><td>Statement 3</td></tr><tr><th>State/UT</th><th colspan='3'>Own Revenue</th><th>Other</th></tr>"
        "<tr><th>1999-00 (A)</th><th>2000-01 (RE)</th><th>2001-02 (BE)</th><th>1999-00 (A)</th></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr>"
    )
    pages = printed(t, line, head, "</table></html>")
    cells = X.html_table_cells(pages, "text", r"(?i)^state\s*/\s*ut")
    start, status = status_of(F.col("label"))
    rows = cells.select("doc_id", "name", start.alias("start_year"), status.alias("status"), clean_number(F.col("raw")).alias("value"))
    return rows.filter("status <> 'BE'")


@query("X15_wikitext_rows", """
  select o_custkey as doc_id, 'Order ' || o_orderkey as title, case when o_orderstatus = 'F' then 'O' || o_orderkey else 'Order ' || o_orderkey end as name,
         'Nation ' || chr(65 + c_nationkey) as parent, 100000 + floor(o_totalprice)::bigint as population,
         case when o_orderstatus <> 'P' then c_nationkey + 0.5::double end as lat, case when o_orderstatus <> 'P' then -c_nationkey - 0.25::double end as lon
  from orders join customer on o_custkey = c_custkey
""")
def x15(t: Tables) -> DataFrame:
    """Wiki pages per customer with its orders as table rows, at most a thousand to a page."""
    key = F.concat(F.lit("Order "), _text(F.col("o_orderkey")))
    link = F.when(F.col("o_orderstatus") == "F", F.concat(key, F.lit("|O"), _text(F.col("o_orderkey")), F.lit(", Town"))).otherwise(key)
    n = F.col("c_nationkey")
    coord = F.when(F.col("o_orderstatus") == "P", "").otherwise(
        F.concat(F.lit("{{Coord|"), _text(n + 0.5), F.lit("|"), _text(-n - 0.25), F.lit("|display=inline}}"))
    )
    row = F.concat(
        F.lit("\n|-\n| [["), link, F.lit("]] || [[Nation "), B.letter(n), F.lit("]] || "), F.format_number(F.floor("o_totalprice") + 100000, 0),
        F.lit(" || 7 || "), coord,
    )
    docs = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_custkey").alias("doc_id"), F.floor(F.col("o_orderkey") / 1000))
        .agg(F.array_join(F.collect_list(row), "").alias("_rows"))
        .select("doc_id", F.concat(F.lit("Intro\n{| class=wikitable"), "_rows", F.lit("\n|-\n| [[Broken]] || no number ||\n|}\nOutro")).alias("text"))
    )
    return X.wikitext_rows(docs).drop("row_no")


@query("X17_wide_to_long", """
  select c_nationkey as nation, s as label, (select count(*) from orders join customer c2 on o_custkey = c2.c_custkey
    where c2.c_nationkey = c.c_nationkey and o_orderstatus = s) as value
  from (select distinct c_nationkey from orders join customer on o_custkey = c_custkey) c, (select unnest(['F', 'O', 'P']) as s)
""")
def x17(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    wide = joined.groupBy(F.col("c_nationkey").alias("nation")).agg(
        *[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FOP"]
    )
    return X.wide_to_long(wide, ["nation"])


@query("X18_merge_headers", """
  select o_orderkey, case when o_orderstatus = 'F' then 'State|' || year(o_orderdate) || '|Last' else 'State|First|Last' end as header from orders
""")
def x18(t: Tables) -> DataFrame:
    first = F.array(F.lit("State"), F.lit("First"), F.lit("Last"))
    second = F.when(F.col("o_orderstatus") == "F", F.array(F.lit(None).cast("string"), _text(F.year("o_orderdate")), F.lit(""))).otherwise(
        F.array(F.lit(None).cast("string"), F.lit("Headcount"), F.lit(""))
    )
    return t.orders.select("o_orderkey", F.array_join(X.merge_headers(first, second), "|").alias("header"))


view("listed_pages", r"""
  select page_id, url, regexp_extract(url, '^https?://[^/]*?([a-z]+\.[a-z]+)/', 1) as host, regexp_extract(url, '/(\d+)', 1) as number from pages
""")


def listing(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url", F.regexp_extract("url", r"^https?://[^/]*?([a-z]+\.[a-z]+)/", 1).alias("host"))


@query("X19_latest_editions", """
  select page_id, host, number::bigint as edition from (select distinct url, min(page_id) as page_id, host, number from listed_pages where number <> '' group by 1, 3, 4)
  qualify row_number() over (partition by host order by number::bigint desc, url) <= 3
""")
def x19(t: Tables) -> DataFrame:
    unique = listing(t).groupBy("url", "host").agg(F.min("page_id").alias("page_id"))
    return X.latest_editions(unique, ["host"], "url", r"/(\d+)", 3).select("page_id", "host", "edition")


@query("X20_drop_shared_urls", """
  select page_id from listed_pages where host || '/' || number not in (select host || '/' || number from listed_pages group by 1 having count(*) > 1)
""")
def x20(t: Tables) -> DataFrame:
    rows = listing(t).withColumn("address", F.concat("host", F.lit("/"), F.regexp_extract("url", r"/(\d+)", 1)))
    return X.drop_shared_urls(rows, ["host"], "address").select("page_id")


@query("X22_missing_tables", """
  select p_partkey as number, p_type || ' part' as phrase, case when p_size < 40 then p_type || ' Part' || case when p_brand = 'Brand#1' then 'y' else '' end
    else null end as title, 'missing' as state from part where p_size >= 40
  union all select p_partkey, p_type || ' part', 'Renamed', 'other title' from part where p_size < 40 and p_brand = 'Brand#7'
""")
def x22(t: Tables) -> DataFrame:
    expected = t.part.select(F.col("p_partkey").alias("number"), F.concat("p_type", F.lit(" part")).alias("phrase"))
    title = F.when(F.col("p_brand") == "Brand#7", "Renamed").otherwise(F.concat("p_type", F.lit(" Part list")))
    listed = t.part.filter("p_size < 40").select(F.col("p_partkey").alias("number"), title.alias("title"))
    return X.missing_tables(listed, expected)


@query("X23_explode_members", """
  select 'Brand Number' as "group", p_partkey, p_name as member from part union all
  select 'Brand Number', p_partkey, p_type from part
""")
def x23(t: Tables) -> DataFrame:
    line = F.concat(F.lit("* Brand Number: "), "p_name", F.lit(",  "), "p_type")
    return X.explode_members(t.part.select("p_partkey", line.alias("text")))


@query("X25_columns_by_header", """
  select p_partkey as table_id, 1 as row_no, 'price' as name, p_retailprice::varchar as raw from part
  union all select p_partkey, 1, 'size', p_size::varchar from part
""")
def x25(t: Tables) -> DataFrame:
    """Columns come in either order; their headers tell which is which."""
    swap = F.col("p_size") > 25
    price, size = F.struct(F.lit("Retail Price (Rs)").alias("h"), _text(F.col("p_retailprice")).alias("v")), F.struct(
        F.lit("Size of part").alias("h"), _text(F.col("p_size")).alias("v")
    )
    note = F.struct(F.lit("Remarks").alias("h"), F.lit("x").alias("v"))
    ordered = F.when(swap, F.array(size, note, price)).otherwise(F.array(note, price, size))
    cells = t.part.select(F.col("p_partkey").alias("table_id"), F.posexplode(ordered).alias("column_no", "c"))
    values = cells.select("table_id", F.lit(1).alias("row_no"), "column_no", F.col("c.v").alias("raw"))
    headers = cells.select("table_id", "column_no", F.col("c.h").alias("header"))
    return X.columns_by_header(values, headers, {"price": "(?i)price", "size": "(?i)^size"})
