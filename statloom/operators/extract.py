"""Rows from the text of landed pages: tables, wrapped names, charts, HTML and wikitext.

A page is one row with its text. Lines stay an array on that row, so neighbouring lines are looked up
by position and nothing is shuffled; only finished table rows are exploded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.text import clean_number, strip_footnotes
from statloom.operators.skew import top_rows

# How sources print a number, a row and a total.
VALUE = r"(?:-?\d[\d,]*(?:\.\d+)?|-)"
ROW = r"^(\d{1,2})\s+(.*)$"
TOTAL = r"(?i)^total\s*\(?all[- ]india\)?\s+(.*)$"
NATIONAL = "All India"
ITEM_VALUE = r"(?:\(?\d+(?:\.\d+)?\)?|\*|na)"
PERCENT = r"^(\d{1,3})%$"


def lines_of(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def explode_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row per line with its 0-based number."""
    kept = [c for c in pages.columns if c != text]
    return pages.select(*kept, F.posexplode(lines_of(F.col(text))).alias("line_no", "text"))


def first_line(text: Column) -> Column:
    return F.trim(F.substring_index(F.regexp_replace(text, r"^\s+", ""), "\n", 1))


def locate_tables(pages: DataFrame, headings: Mapping[str, str], last_only: Sequence[str] = ()) -> DataFrame:
    """Pages whose first line matches a wanted heading, with the table's id.

    `headings`: table id -> regular expression. Of `last_only` tables just the page marked as the
    concluding one counts.
    """
    first = first_line(F.col("text"))
    heading = F.regexp_extract("text", r"(?s)^(.*?)(?:\n\s*\d{1,2}\s|$)", 1)  # all lines above the first numbered row
    concluded = heading.contains("(Concluded)")
    found = F.array_compact(
        F.array(
            *[
                F.when(first.rlike(pattern) & (concluded if table in last_only else F.lit(True)), table)
                for table, pattern in headings.items()
            ]
        )
    )
    return pages.withColumn("table_id", F.explode(found))


def trailing_values(line: Column, value: str = VALUE) -> tuple[Column, Column]:
    """(name, values) of a line: the longest run of numbers at its end, and the text before it."""
    text = F.trim(line)
    run = F.regexp_extract(text, rf"(?:^|\s)({value}(?:\s+{value})*)$", 1)
    name = F.trim(F.substr(text, F.lit(1), F.length(text) - F.length(run)))
    return name, F.filter(F.split(run, r"\s+"), lambda v: v != "")


def with_neighbours(pages: DataFrame) -> DataFrame:
    """One row per line with the lines before and after it ('' at the ends of the page)."""
    kept = [c for c in pages.columns if c != "text"]
    lines, size = F.col("_lines"), F.size("_lines")
    blank = F.array(F.lit(""))
    zipped = F.arrays_zip(
        lines.alias("text"),
        F.concat(blank, F.slice(lines, F.lit(1), size - 1)).alias("before"),
        F.concat(F.slice(lines, 2, F.greatest(size, F.lit(1))), blank).alias("after"),
    )
    split = pages.select(*kept, lines_of(F.col("text")).alias("_lines"))
    rows = split.select(*kept, F.posexplode(zipped).alias("line_no", "_l"))
    return rows.select(*kept, "line_no", "_l.text", "_l.before", "_l.after")


def split_trailing_values(lines: DataFrame, column: str = "text", value: str = VALUE) -> DataFrame:
    name, values = trailing_values(F.col(column), value)
    return lines.withColumn("name", name).withColumn("values", values)


def rejoin_wrapped(pages: DataFrame, min_values: int = 3, total: str = TOTAL) -> DataFrame:
    """Numbered table rows as (line_no, name, values) and the national total (`total`: its line, numbers in group 1).

    A name wrapped around its numbers is put together from the lines before and after.
    """
    kept = [c for c in pages.columns if c != "text"]
    line = F.col("text")
    rows = with_neighbours(pages).withColumn("_total", line.rlike(total)).filter(F.col("_total") | line.rlike(ROW))
    rest = F.when(F.col("_total"), F.regexp_extract(line, total, 1)).otherwise(F.regexp_extract(line, ROW, 2))
    name, values = trailing_values(F.col("_rest"))
    rows = rows.withColumn("_rest", rest).withColumn("_name", name).withColumn("values", values)
    good = F.when(F.col("_total"), (F.col("_name") == "") & (F.size("values") > 0)).otherwise(F.size("values") >= min_values)
    wrapped = F.trim(F.concat("before", F.lit(" "), "after"))
    name = F.when(F.col("_total"), NATIONAL).when(F.col("_name") == "", wrapped).otherwise(F.col("_name"))
    return rows.filter(good).select(*kept, "line_no", name.alias("name"), "values")


def carry_pending(pages: DataFrame, row_pattern: str) -> DataFrame:
    """Rows matching a pattern, as text, with the digit-free line just before put in front."""
    kept = [c for c in pages.columns if c != "text"]
    rows = with_neighbours(pages).filter(F.col("text").rlike(row_pattern))
    pending = (F.col("before") != "") & ~F.col("before").rlike(r"\d")
    whole = F.when(pending, F.concat("before", F.lit(" "), "text")).otherwise(F.col("text"))
    return rows.select(*kept, "line_no", whole.alias("text"))


def extract_rows(lines: DataFrame, pattern: str, groups: Mapping[str, int], numbers: Sequence[str] = ()) -> DataFrame:
    """Lines matching a pattern, its groups as columns; the named ones as numbers."""
    text = F.col("text")
    found = lines.filter(text.rlike(pattern))
    columns = []
    for name, i in groups.items():
        part = F.trim(F.regexp_extract(text, pattern, i))
        columns.append((clean_number(part) if name in numbers else part).alias(name))
    return found.select(*[c for c in lines.columns if c != "text"], *columns)


def extract_ci_rows(lines: DataFrame) -> DataFrame:
    """Rows 'name value ( low , high )' without subtotals and remainders."""
    name, values = trailing_values(F.substring_index("text", "(", 1))
    bounds = F.split(F.substring_index(F.substring_index("text", "(", -1), ")", 1), ",")
    rows = lines.filter(F.col("text").contains("(")).withColumn("name", name).withColumn("_v", F.concat(values, bounds))
    rows = rows.filter((F.size(values) == 1) & (F.size("_v") == 3) & F.col("name").rlike(r"^\p{L}\D*$"))
    numbers = [clean_number(F.get("_v", F.lit(i))).alias(c) for i, c in enumerate(("value", "ci_low", "ci_high"))]
    rows = rows.select(*[c for c in lines.columns if c != "text"], "name", *numbers).na.drop(subset=["value", "ci_low", "ci_high"])
    return rows.filter(~F.col("name").rlike(r"(?i)subtotal|other states"))


def rows_after_heading(pages: DataFrame, heading: str, row_pattern: str) -> DataFrame:
    """Matching lines below a heading, of the first page of each document that has any.

    `pages`: doc_id, page, text. A page is cut on its own; only the number of the first useful page
    is aggregated per document.
    """
    body = F.regexp_replace(F.col("text"), rf"(?s)^.*?{heading}", "")
    found = F.filter(lines_of(body), lambda x: x.rlike(row_pattern))
    useful = pages.filter(F.col("text").rlike(heading)).withColumn("_found", found).filter(F.size("_found") > 0)
    first = useful.groupBy("doc_id").agg(F.min("page").alias("page"))
    return useful.join(first, ["doc_id", "page"], "left_semi").select(
        "doc_id", "page", F.posexplode("_found").alias("row_no", "text")
    )


def header_periods(text: Column) -> Column:
    """Ordered labels of the first column block, from the first line naming three or more periods.

    The block ends where its first label comes again.
    """
    def labels(line: Column) -> Column:
        all_labels = F.regexp_extract_all(line, F.lit(r"(?<!\S)((?:19|20)\d\d(?:-\d\d)?)(?!\S)"), 1)
        again = F.array_position(F.slice(all_labels, 2, F.greatest(F.size(all_labels), F.lit(1))), F.get(all_labels, F.lit(0)))
        return F.when(again > 0, F.slice(all_labels, 1, again.cast("int"))).otherwise(all_labels)

    return F.get(F.filter(F.transform(lines_of(text), labels), lambda x: F.size(x) >= 3), F.lit(0))


def leading_values(line: Column) -> tuple[Column, Column]:
    """(name, values) of a line: the words before its first number, and the run of numbers that starts there."""
    words = F.split(F.trim(line), r"\s+")
    numbers = F.transform(words, lambda w: w.rlike(rf"^{VALUE}$"))
    first = F.array_position(numbers, F.lit(True)).cast("int")
    start = F.when(first > 0, first).otherwise(F.size(words) + 1)
    rest = F.slice(numbers, start, F.size(words))
    ends = F.array_position(rest, F.lit(False)).cast("int")
    run = F.when(ends > 0, ends - 1).otherwise(F.size(rest))
    return F.array_join(F.slice(words, F.lit(1), start - 1), " "), F.slice(words, start, run)


def zip_periods(pages: DataFrame, row_pattern: str | None = None) -> DataFrame:
    """Table rows of a page paired with its header periods: one row per (name, period), first block only.

    Row pattern groups: 1 the name, 2 the run of values. Without a pattern a row is a name, which starts with a
    letter, and the numbers behind it; text may follow them.
    """
    kept = [c for c in pages.columns if c != "text"]
    headed = pages.withColumn("_periods", header_periods(F.col("text")))
    is_row = row_pattern or r"^\p{L}.*\d"
    rows = headed.select(*kept, "_periods", F.explode(F.filter(lines_of(F.col("text")), lambda x: x.rlike(is_row))).alias("_line"))
    name, values = leading_values(F.col("_line"))
    if row_pattern:
        name, values = F.regexp_extract("_line", row_pattern, 1), F.split(F.trim(F.regexp_extract("_line", row_pattern, 2)), r"\s+")
    enough = rows.withColumn("name", F.trim(F.rtrim(name, F.lit("* ")))).withColumn("_values", values).filter(F.size("_values") >= F.size("_periods"))
    zipped = F.arrays_zip(F.col("_periods").alias("period"), F.slice("_values", 1, F.size("_periods")).alias("value"))
    out = enough.select(*kept, "name", F.explode(zipped).alias("_z"))
    return out.select(*kept, "name", F.col("_z.period").alias("period_label"), clean_number(F.col("_z.value")).alias("value"))


def segment_items(docs: DataFrame) -> DataFrame:
    """Numbered items of a text as (item, label, values).

    The values are the last run of two or more numbers among the item's words; the label is the
    other words, cut after '(%)'.
    """
    kept = [c for c in docs.columns if c != "text"]
    parts = F.filter(F.split(F.col("text"), r"(?m)(?=^\d{1,3}\.\s)"), lambda p: p.rlike(r"^\d{1,3}\.\s"))
    items = docs.select(*kept, F.posexplode(parts).alias("item", "_part"))
    # Words apart by one blank, a blank at both ends, the item's number off.
    body = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.trim("_part"), r"\s+", " "), r"^\S+ ?", "")), F.lit(" "))
    items = items.withColumn("_body", body)
    runs = F.regexp_extract_all("_body", F.lit(rf"(?i)(?<= )({ITEM_VALUE}(?: {ITEM_VALUE})+)(?= )"), 1)
    items = items.withColumn("_run", F.get(runs, F.size(runs) - 1)).filter("_run is not null")
    # The last place of the run, found from the end.
    spaced = F.concat(F.lit(" "), "_run", F.lit(" "))
    after = F.instr(F.reverse("_body"), F.reverse(spaced))
    cut = F.length("_body") - after - F.length(spaced) + 2
    rest = F.concat(F.substr("_body", F.lit(1), cut), F.substr(F.col("_body"), cut + F.length(spaced), F.length("_body")))
    label = F.regexp_replace(F.trim(rest), r"(\(%\)).*$", "$1")
    return items.withColumn("_cut", cut).select(*kept, "item", strip_footnotes(label).alias("label"), F.split("_run", " ").alias("values"))


def pair_chart(docs: DataFrame, heading: str = "Comparison of") -> DataFrame:
    """Chart text 'local % / label lines / national %' below a heading as (label, local, national).

    The first line that is neither a percentage nor part of a label (the legend) ends the chart.
    """
    kept = [c for c in docs.columns if c != "text"]
    lines = lines_of(F.col("text"))
    marks = F.transform(lines, lambda x: x.contains(heading))
    at = F.array_position(marks, F.lit(True)).cast("int")
    body = F.when(at > 0, F.slice(lines, at + 1, F.greatest(F.size(lines), F.lit(1))))
    none = F.lit(None).cast("double")
    start = F.struct(
        none.alias("pending"), F.lit("").alias("label"),
        F.array().cast("array<struct<label:string,local:double,national:double>>").alias("out"), F.lit(False).alias("done"),
    )

    def step(acc: Column, line: Column) -> Column:
        percent = F.regexp_extract(line, PERCENT, 1).try_cast("double")
        is_pct = line.rlike(PERCENT)
        pair = is_pct & acc["pending"].isNotNull() & (acc["label"] != "")
        done = acc["done"] | (~is_pct & acc["pending"].isNull())
        entry = F.struct(acc["label"].alias("label"), acc["pending"].alias("local"), percent.alias("national"))
        live = F.struct(
            F.when(pair, none).when(is_pct, percent).otherwise(acc["pending"]).alias("pending"),
            F.when(pair, "").when(is_pct, acc["label"]).otherwise(F.trim(F.concat(acc["label"], F.lit(" "), line))).alias("label"),
            F.when(pair, F.concat(acc["out"], F.array(entry))).otherwise(acc["out"]).alias("out"),
            done.alias("done"),
        )
        kept_as_is = F.struct(acc["pending"].alias("pending"), acc["label"].alias("label"), acc["out"].alias("out"), F.lit(True).alias("done"))
        return F.when(done, kept_as_is).otherwise(live)

    pairs = F.aggregate(body, start, step, lambda acc: acc["out"])
    return docs.filter(F.col("text").contains(heading)).select(*kept, F.explode(pairs).alias("_p")).select(*kept, "_p.*")


def words_to_table(words: DataFrame, header_words: Sequence[str] = ("Persons", "Males", "Females")) -> tuple[DataFrame, DataFrame]:
    """A table rebuilt from word positions: (page rows, problems).

    `words`: doc_id, page, text, x0, x1, top. The header words give the columns (in threes:
    persons, males, females), the year words left of them the rows; every number belongs to the
    nearest column and row. A cell must hold exactly one number and persons must be males plus
    females within 2. A page has few columns and years: they travel as arrays beside its words.
    """
    page = ["doc_id", "page"]
    centre = (F.col("x0") + F.col("x1")) / 2
    heads = words.filter(F.col("text").isin(list(header_words))).groupBy(*page).agg(
        F.array_sort(F.collect_list(centre)).alias("_columns"), F.min("top").alias("_top"), F.min("x0").alias("_left")
    )
    below = words.join(heads, page).filter(F.col("top") > F.col("_top"))
    is_year = F.col("text").rlike(r"^(?:19|20)\d\d$") & (F.col("x0") < F.col("_left") - 5)
    years = below.filter(is_year).groupBy(*page).agg(
        F.collect_list(F.struct(F.col("top"), F.col("text").cast("int").alias("year"))).alias("_years")
    )
    numbers = below.filter(~is_year & F.col("text").rlike(r"^\d[\d,]*$")).join(years, page)
    ends = numbers.withColumn("_lo", F.array_min(F.transform("_years", lambda y: y["top"])) - 8).withColumn(
        "_hi", F.array_max(F.transform("_years", lambda y: y["top"])) + 8
    ).filter((F.col("top") >= F.col("_lo")) & (F.col("top") <= F.col("_hi")))
    row = F.array_min(F.transform("_years", lambda y: F.struct(F.abs(y["top"] - F.col("top")).alias("d"), y["year"].alias("year"))))["year"]
    col = F.array_min(
        F.transform("_columns", lambda c, i: F.struct(F.abs(c - (F.col("x0") + F.col("x1")) / 2).alias("d"), i.alias("i")))
    )["i"]
    cells = ends.select(*page, row.alias("year"), col.alias("column"), clean_number(F.col("text")).alias("value"))
    part = F.pmod("column", F.lit(3))

    def only(j: int) -> Column:
        return F.max(F.when(part == j, F.col("value")))

    table = cells.groupBy(*page, "year", F.floor(F.col("column") / 3).cast("int").alias("place_no")).agg(
        only(0).alias("persons"), only(1).alias("males"), only(2).alias("females"),
        F.count(F.lit(1)).alias("_n"), F.count_distinct("column").alias("_cells"),
    )
    sound = (F.col("_n") == 3) & (F.col("_cells") == 3)
    adds = F.abs(F.col("persons") - F.col("males") - F.col("females")) <= 2
    problem = F.when(~sound, "cells without exactly one value").when(~adds, "persons differ from males plus females")
    checked = table.withColumn("problem", problem)
    return (
        checked.filter("problem is null").drop("_n", "_cells", "problem"),
        checked.filter("problem is not null").select(*page, "year", "place_no", "problem"),
    )


def _clean_cell(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?s)<[^>]+>", " ")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(ch))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_rows(html: Column) -> Column:
    """Table rows of a page as arrays of (colspan, text) cells."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)

    def cell(c: Column) -> Column:
        span = F.regexp_extract(c, r"""(?i)^<t[dh][^>]*colspan\s*=\s*['"]?(\d+)""", 1).try_cast("int")
        return F.struct(F.coalesce(span, F.lit(1)).alias("span"), _clean_cell(c).alias("text"))

    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>.*?</t[dh]>"), 0), cell))


def html_table_cells(pages: DataFrame, html: str, header: str) -> DataFrame:
    """Cells of the first column group of a table: (name, label, value text).

    The header row starts with `header`; the width of its second cell says how many of the labels
    in the next row belong to the group.
    """
    kept = [c for c in pages.columns if c != html]
    parsed = pages.withColumn("_rows", html_rows(F.col(html)))
    at = F.array_position(F.transform("_rows", lambda r: F.coalesce(F.get(r, F.lit(0))["text"].rlike(header), F.lit(False))), F.lit(True)).cast("int")
    # A page without the header has no body. A filter on `_at` would move below and parse every page once more.
    parsed = parsed.withColumn("_at", at)
    head = F.get("_rows", F.col("_at") - 1)
    parsed = parsed.withColumn("_width", F.get(head, F.lit(1))["span"])
    labels = F.transform(F.slice(F.coalesce(F.get("_rows", F.col("_at")), F.array().cast("array<struct<span:int,text:string>>")), 1, F.coalesce("_width", F.lit(0))), lambda c: c["text"])
    body = F.when(F.col("_at") > 0, F.slice("_rows", F.col("_at") + 2, F.greatest(F.size("_rows"), F.lit(1))))
    rows = parsed.select(*kept, labels.alias("_labels"), F.explode(body).alias("_row"))
    rows = rows.filter((F.size("_row") > F.size("_labels")) & ~F.get("_row", F.lit(0))["text"].rlike(r"^\d+$"))
    name = F.regexp_replace(F.get("_row", F.lit(0))["text"], r"^\d+\.\s*", "")
    values = F.transform(F.slice("_row", 2, F.size("_labels")), lambda c: c["text"])
    zipped = rows.select(*kept, name.alias("name"), F.explode(F.arrays_zip(F.col("_labels").alias("label"), values.alias("raw"))).alias("_z"))
    return zipped.select(*kept, "name", "_z.label", "_z.raw")


def wikitext_rows(docs: DataFrame, min_links: int = 2) -> DataFrame:
    """Rows of the first wiki table: first link's title and name, second link, population, coordinates."""
    kept = [c for c in docs.columns if c != "text"]
    table = F.regexp_extract("text", r"(?s)(\{\|.*?)\n\|\}", 1)
    rows = F.split(table, r"\n\|-")
    out = docs.select(*kept, F.posexplode(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))).alias("row_no", "_row"))
    # A link is [[title]] or [[title|shown]]; cells are parted by ||, and a population has six characters or more.
    opened = F.split("_row", r"\[\[")
    links = F.transform(F.filter(F.slice(opened, 2, F.size(opened)), lambda x: x.contains("]]")), lambda x: F.substring_index(x, "]]", 1))
    cells = F.transform(F.split("_row", r"\|\|"), lambda x: F.trim(x))
    inner = F.slice(cells, 2, F.greatest(F.size(cells) - 2, F.lit(0)))
    counts = F.filter(inner, lambda x: (F.translate(x, "0123456789,", "") == "") & (F.length(x) >= 6))
    at = F.instr(F.lower("_row"), "{{coord|")
    place = F.split(F.when(at > 0, F.substr("_row", at + 8)), r"[|}]")
    parsed = out.withColumn("_links", links).withColumn("_p", F.get(counts, F.lit(0))).withColumn("_at", place)
    parsed = parsed.filter((F.size("_links") >= min_links) & F.col("_p").isNotNull())

    def shown(i: int) -> Column:
        return F.substring_index(F.get("_links", F.lit(i)), "|", -1)

    return parsed.select(
        *kept, "row_no", F.trim(F.substring_index(F.get("_links", F.lit(0)), "|", 1)).alias("title"),
        F.trim(F.substring_index(shown(0), ",", 1)).alias("name"), F.trim(shown(1)).alias("parent"),
        F.replace(F.col("_p"), F.lit(","), F.lit("")).cast("bigint").alias("population"),
        F.get("_at", F.lit(0)).try_cast("double").alias("lat"), F.get("_at", F.lit(1)).try_cast("double").alias("lon"),
    )


def wide_to_long(df: DataFrame, ids: Sequence[str], label: str = "label", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], label, value)


def merge_headers(first: Column, second: Column) -> Column:
    """Column labels where a second header row with years overrides the first where it is filled."""
    years = F.exists(second, lambda c: F.coalesce(c.rlike(r"^\d{4}(-\d{2})?.*"), F.lit(False)))
    merged = F.zip_with(first, second, lambda a, b: F.coalesce(F.when(b != "", b), a))
    return F.when(F.coalesce(years, F.lit(False)), merged).otherwise(first)


def latest_editions(listing: DataFrame, series: Sequence[str], column: str, pattern: str, n: int = 1) -> DataFrame:
    """The newest n items of each series whose text carries an edition number."""
    edition = F.regexp_extract(F.col(column), pattern, 1).try_cast("bigint")
    rows = listing.withColumn("edition", edition).filter("edition is not null")
    return top_rows(rows, list(series), [F.col("edition").desc(), F.col(column)], n)


def drop_shared_urls(listing: DataFrame, group: Sequence[str], url: str = "url") -> DataFrame:
    """Items of a group whose URL is listed once; a URL under two names tells nothing."""
    shared = listing.groupBy(*group, url).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return listing.join(shared, [*group, url], "left_anti")


def missing_tables(listing: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected tables that are not listed, or listed under another title.

    `listing`: number, title; `expected`: number, phrase.
    """
    joined = expected.join(listing.select("number", "title"), "number", "left")
    state = F.when(F.col("title").isNull(), "missing").when(~F.lower("title").contains(F.lower("phrase")), "other title")
    return joined.withColumn("state", state).filter("state is not null").select("number", "phrase", "title", "state")


def explode_members(lines: DataFrame) -> DataFrame:
    """'Group: a, b, c' as one row per member. The group is the run of capitalised words before the last colon."""
    parts = F.split("text", ":")
    members = F.split(F.element_at(parts, -1), ",")
    before = F.split(F.trim(F.get(parts, F.size(parts) - 2)), " +")
    lowered = F.array_position(F.transform(F.reverse(before), lambda w: w.rlike(r"^\p{Lu}\p{Ll}+$")), F.lit(False)).cast("int")
    run = F.when(lowered > 0, lowered - 1).otherwise(F.size(before))
    group = F.array_join(F.slice(before, F.size(before) - run + 1, run), " ")
    kept = [c for c in lines.columns if c != "text"]
    rows = lines.filter(F.col("text").contains(":")).select(*kept, group.alias("group"), F.explode(members).alias("member"))
    return rows.withColumn("member", F.trim("member")).filter("group <> '' and member <> ''")


def rows_until(pages: DataFrame, marker: str) -> DataFrame:
    """The page's text up to and including the first line that carries a marker."""
    lines = F.split(F.col("text"), "\n")
    at = F.array_position(F.transform(lines, lambda x: x.contains(marker)), F.lit(True)).cast("int")
    cut = F.when(at > 0, F.array_join(F.slice(lines, F.lit(1), at), "\n")).otherwise(F.col("text"))
    return pages.withColumn("text", cut)


def columns_by_header(cells: DataFrame, headers: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Cells named by what their column's header says, not by position.

    `cells`: table_id, row_no, column_no, raw; `headers`: table_id, column_no, header.
    """
    name = None
    for target, pattern in patterns.items():
        hit = F.col("header").rlike(pattern)
        name = F.when(hit, target) if name is None else name.when(hit, target)
    named = headers.withColumn("name", name).filter("name is not null").select("table_id", "column_no", "name")
    return cells.join(named, ["table_id", "column_no"]).select("table_id", "row_no", "name", "raw")
