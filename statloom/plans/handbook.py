"""The state handbook: two dozen printed tables, read by one table of rules.

All sheets land as rows of cells in one table. One pass finds the headers, one unpivot makes cells, one
resolution names the places and one aggregate puts the figures of a place and period on a card; what
tables stand for together (shares of the product, densities, shares of each other) is read off the card.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import periods as P
from statloom.functions import text as T
from statloom.operators import derive as D
from statloom.operators import extract as X
from statloom.operators import validate as V
from statloom.session import materialize
from statloom.plans.jobs import KEY, Landed, Reference, Result, _placed, _problems, _union, observations

# Numbers and titles the handbook prints.
TITLES = {
    10: "Poverty Estimates - Multi-dimensional Poverty Index",
    16: "Health Infrastructure - Doctors and Specialists",
    17: "Number of Government Hospitals and Beds",
    20: "Per Capita Net State Domestic Product (Constant Prices)",
    21: "Gross State Domestic Product (Current Prices)",
    22: "Gross State Domestic Product (Constant Prices)",
    99: "Forest Cover",
    107: "Status of Ground Water Extraction",
    138: "Per Capita Availability of Power",
    140: "Installed Capacity of Power",
    143: "Installed Capacity of Grid Interactive Renewable Power",
    144: "Length of National Highways",
    145: "Railway Route",
    146: "Length of Roads",
    147: "Length of State Highways",
    149: "Telephones per 100 Population",
    153: "Credit-Deposit Ratio of Scheduled Commercial Banks",
    164: "Gross Fiscal Deficit",
    166: "Revenue Expenditure",
    168: "Own Tax Revenue",
    173: "Capital Expenditure",
    174: "Capital Outlay",
    176: "Composition of Outstanding Liabilities",
    181: "State-wise Exports",
}
# Printed headings.
TOTAL_DEBT, GROUND_WATER = "Outstanding Liabilities", "Stage of Ground Water Extraction"
PRODUCT, REAL_PRODUCT, FOREST, DEBT = 21, 22, 99, 176
#: How the columns of a table tell periods. fiscal: '2023-24 (RE)'; stock: '2024' at end-March or '2024*' at
#: end-December, the latter inside the next fiscal year; march: '2024' closes a fiscal year; round: '2023' or
#: '2023*', measured otherwise; assessment: a year in brackets; survey: the name of a round; sheet: the year of the sheet.
COLUMNS = {
    10: "survey", 20: "fiscal", 21: "fiscal", 22: "fiscal", 99: "round", 107: "assessment", 138: "fiscal", 140: "fiscal", 143: "march",
    144: "stock", 145: "stock", 146: "stock", 147: "stock", 164: "fiscal", 166: "fiscal", 168: "fiscal", 174: "fiscal", 176: "sheet", 181: "fiscal",
}


@dataclass(frozen=True)
class Figure:
    """An indicator: a table's figure by itself or (`form`) over the product, another table, area or people."""

    indicator: str
    table: int
    form: str = "own"
    other: int = 0
    factor: float = 1.0
    since: str = ""  # "current": from the first year of today's boundaries; "base": from the base year of the series
    revised: bool = False  # revised estimates count, as provisional
    uncovered: bool = False  # only for places the main source does not cover


FIGURES = (
    Figure("net-product-per-person", 20, since="base", uncovered=True),
    Figure("product-current", 21, since="base", uncovered=True),
    Figure("product-constant", 22, since="base", uncovered=True),
    Figure("fiscal-deficit-share", 164, "product", factor=100, since="current", revised=True),
    Figure("own-tax-share", 168, "product", factor=100, since="current", revised=True),
    Figure("debt-share", 176, "product", factor=100, since="current", revised=True),
    Figure("capital-share", 174, "part", 166, 100, "current", revised=True),
    Figure("power-per-person", 138),
    Figure("renewable-share", 143, "capped", 140, 100),
    Figure("ground-water-stage", 107),
    Figure("forest-change", 99),
    Figure("poverty-headcount", 10),
    Figure("exports-per-person", 181, "people", factor=1e6, revised=True),
    Figure("road-density", 146, "area", factor=100),
    Figure("national-highway-density", 144, "area", factor=1000),
    Figure("state-highway-density", 147, "area", factor=1000),
    Figure("rail-density", 145, "area", factor=1000),
)


def cells(sheets: DataFrame) -> DataFrame:
    """table_no, state, label, raw, unit, sheet_year of every cell below a sheet's header.

    `sheets`: table_no, sheet, row_no, cells (the first names the row). The header is the first row that starts
    with 'State' or 'Region/State'; a later row without a name but with years overrides it where it is filled.
    The unit (lakh or crore) and the year of a sheet stand in the rows above. Sheets without a header give nothing.
    """
    first = F.trim(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    row = F.struct("row_no", "cells")
    years = F.exists("cells", lambda c: F.coalesce(c.rlike(r"^\d{4}(-\d{2})?"), F.lit(False)))
    headed = F.lower(first).rlike("^(region/)?state")
    heads = sheets.groupBy("table_no", "sheet").agg(
        F.min(F.when(headed, row)).alias("head"), F.min(F.when((first == "") & years, row)).alias("second"),
        F.max(F.nullif(F.regexp_extract(F.lower(F.array_join("cells", " ")), r"₹\s*(lakh|crore)", 1), F.lit(""))).alias("unit"),
        F.max(F.when(first.rlike(r"(?i)^table \d+.*- \d{4}"), F.regexp_extract(first, r"- (\d{4})", 1).try_cast("int"))).alias("sheet_year"),
    )
    below = sheets.join(heads.filter("head is not null"), ["table_no", "sheet"]).filter((F.col("row_no") > F.col("head.row_no")) & (first != ""))
    pairs = F.arrays_zip(X.merge_headers(F.col("head.cells"), F.col("second.cells")).alias("label"), F.col("cells").alias("raw"))
    named = below.select("table_no", "unit", "sheet_year", first.alias("state"), F.inline(F.slice(pairs, 2, F.greatest(F.size("cells") - 1, F.lit(0)))))
    return named.withColumn("label", F.trim("label")).filter("label <> ''")


def _dated(found: DataFrame, rounds: Mapping[str, tuple[date, date, str]], since: int) -> DataFrame:
    """Cells with value, status, flags and their period; columns that tell no period and cells without a figure go."""
    kind = F.create_map(*[F.lit(x) for pair in COLUMNS.items() for x in pair])[F.col("table_no")]
    value, flagged = T.number_and_flag(F.col("raw"))
    start, status = T.status_of(F.col("label"))
    year = F.when(F.col("label").rlike(r"^\d{4}\*?$"), F.left("label", F.lit(4)).try_cast("int"))
    assessed = F.regexp_extract("label", GROUND_WATER + r".*\((\d{4})\)", 1).try_cast("int")
    rows = found.withColumns({"kind": kind, "value": value, "flagged": flagged, "start": start, "status": status, "year": year, "assessed": assessed})
    k = F.col("kind")
    period = P.fiscal_year(F.col("start")).when((k == "fiscal") & F.col("status").isin("A", "RE"))
    period = period.otherwise(P.stock_year_to_fy(F.col("label")).when((k == "stock") & ~F.col("flagged") & (F.col("year") > since)))
    period = period.otherwise(P.fiscal_year(F.col("year") - 1).when((k == "march") & ~F.col("label").endswith("*")))
    period = period.otherwise(P.calendar_year(F.col("year")).when(k == "round"))
    period = period.otherwise(P.calendar_year(F.col("assessed")).when((k == "assessment") & ~F.col("flagged")))
    period = period.otherwise(P.fiscal_year(F.col("sheet_year") - 1).when((k == "sheet") & (F.col("label") == TOTAL_DEBT)))
    for name, (low, high, label) in rounds.items():
        known = P.span(F.lit(low), F.lit(high), F.lit(label), "survey_round")
        period = period.otherwise(known.when((k == "survey") & F.lower("label").startswith(name.lower())))
    lakh = F.when((F.col("unit") == "lakh") & F.col("table_no").isin(PRODUCT, REAL_PRODUCT), 100.0).otherwise(1.0)
    dated = rows.withColumn("value", F.col("value") / lakh).select("table_no", "state", "value", "label", F.coalesce("status", F.lit("A")).alias("status"), *period.columns())
    return dated.filter("period_start is not null and value is not null")


def state_handbook(
    landed: Landed, ref: Reference, rounds: Mapping[str, tuple[date, date, str]], since: int = 2014, base: int = 2011,
    merged: Mapping[str, str] | None = None, merged_since: int = 2021, split: Sequence[str] = (),
) -> Result:
    """`sheets`: rows of all tables (see `cells`); `listing`: number and title of the files that are there;
    `fallback`: place, period_label, value of the product in crore, used where table 21 has none; `covered`: places
    whose product the main source has.

    `since` is the first fiscal year within today's boundaries, `base` the base year of the product series and the first
    forest round that compares. From round `merged_since` on a place of `merged` (printed name: place's name) is
    reported for the whole it went into; places of `split` compare only from that round on.
    """
    dated = materialize(_dated(cells(landed["sheets"]), rounds, since), "handbook")
    # Debt: a figure far above both its neighbours is a misprint; by printed name, as places change over the years.
    owed = dated.filter(F.col("table_no") == DEBT).withColumn("year", F.year("period_start"))
    spikes = V.drop_spikes(owed, ["state"], "year", "value").filter("spike").select(F.lit(DEBT).alias("table_no"), "state", F.make_date("year", F.lit(4), F.lit(1)).alias("period_start"), "value")
    # Forest: the change between rounds measured alike takes the place of the figure.
    forest = dated.filter((F.col("table_no") == FOREST) & (F.col("value") != 0)).select("state", F.col("state").alias("place"), F.year("period_start").alias("year"), "value", F.col("label").endswith("*").alias("flagged"))
    change = D.round_change(forest.drop("state"), since=base)
    change = change.select(
        F.lit(FOREST).alias("table_no"), F.col("place").alias("state"), F.col("change").alias("value"), F.lit("").alias("label"), F.lit("A").alias("status"),
        *P.calendar_year(F.col("year")).columns(), "from_year",
    )
    if merged:
        renamed = F.create_map(*[F.lit(x) for pair in merged.items() for x in pair])[F.col("state")]
        change = change.withColumn("state", F.when(F.col("from_year") >= merged_since, F.coalesce(renamed, "state")).otherwise(F.col("state")))
    plain = dated.filter(F.col("table_no") != FOREST).join(spikes.drop("value"), ["table_no", "state", "period_start"], "left_anti").withColumn("from_year", F.lit(None).cast("int"))
    placed, unknown = _placed(plain.unionByName(change), ref)
    placed = placed.filter(F.col("from_year").isNull() | (F.col("from_year") >= merged_since) | ~F.col("place").isin(*split))

    card = placed.groupBy(*KEY).agg(*[F.max(F.when(F.col("table_no") == n, F.struct("value", "status"))).alias(f"t{n}") for n in COLUMNS])
    year = F.year("period_start")
    card = materialize(card.withColumn("year", year), "handbook-cards").join(landed["fallback"].select("place", "period_label", F.col("value").alias("fallback")), ["place", "period_label"], "left")
    card = card.join(landed["covered"].select("place", F.lit(True).alias("covered")).distinct(), "place", "left")
    card = card.join(ref.population.select("place", "year", "people"), ["place", "year"], "left").join(ref.area.select("place", "area"), "place", "left")
    figures = F.array(*[_figure(f, since, base) for f in FIGURES])
    found = card.select(*KEY, F.inline(F.filter(figures, lambda f: f["value"].isNotNull())))

    real = card.filter((F.col(f"t{REAL_PRODUCT}.status") == "A") & F.col("covered").isNull()).select("place", "year", F.col(f"t{REAL_PRODUCT}.value").alias("value"))
    growth = D.yoy_growth(real, ["place"]).filter(F.col("year") > base)
    growth = growth.select("place", T.round_at(F.col("growth"), 2).alias("value"), F.lit(False).alias("is_provisional"), *P.fiscal_year(F.col("year")).columns())
    three = D.rolling_mean_consecutive(growth, ["place"]).withColumn("period_type", F.lit("multi_year")).withColumn("value", T.round_at(F.col("value"), 2))
    obs = _union(
        observations(found, F.col("indicator"), T.round_at(F.col("value"), 3), F.col("note")),
        observations(growth, "growth-real", note=f"table {REAL_PRODUCT}"), observations(three, "growth-real-3y", note=f"table {REAL_PRODUCT}"),
    )

    wanted = placed.sparkSession.createDataFrame(list(TITLES.items()), "number int, phrase string")
    missing = X.missing_tables(landed["listing"], wanted).select(F.concat(F.lit("table "), F.col("number").cast("string"), F.lit(" ("), "phrase", F.lit("): "), "state").alias("problem"))
    typos = spikes.select(F.concat(F.lit(f"table {DEBT}: "), "state", F.lit(" "), F.year("period_start").cast("string"), F.lit(" skipped as a likely typo")).alias("problem"))
    return obs, _problems(unknown, missing, typos)


def _figure(f: Figure, since: int, base: int) -> Column:
    """indicator, value, is_provisional and note of a figure on a card; the value is null where it has none."""
    own, other = F.col(f"t{f.table}"), F.col(f"t{f.other}") if f.other else None
    allowed = F.lit(True) if f.revised else own["status"] == "A"
    provisional = own["status"] == "RE"
    if f.since:
        allowed = allowed & (F.col("year") >= (since if f.since == "current" else base))
    if f.uncovered:
        allowed = allowed & F.col("covered").isNull()
    product = F.coalesce(F.col(f"t{PRODUCT}.value"), "fallback")
    over = {"own": F.lit(1.0), "product": product, "area": F.col("area"), "people": F.col("people")}
    if f.form in over:
        value = own["value"] / F.when(over[f.form] != 0, over[f.form]) * f.factor
    elif f.form == "part":
        value = own["value"] / F.when(own["value"] + other["value"] != 0, own["value"] + other["value"]) * f.factor
        provisional = provisional | (other["status"] == "RE")
    else:
        share = own["value"] / F.when((other["status"] == "A") & (other["value"] > 0), other["value"]) * f.factor
        value = F.when(share > 100, 100.0).otherwise(share)
    return F.struct(
        F.lit(f.indicator).alias("indicator"), F.when(allowed, value).alias("value"), F.coalesce(provisional, F.lit(False)).alias("is_provisional"),
        F.lit(f"table {f.table}" + (f" and {f.other}" if f.other else "")).alias("note"),
    )
