"""Scores places 0–100 against fixed goalposts and rolls them up, all editions in one plan.

Catalogue data (indicator specs, index definitions, edition cut-offs) are short Python lists; they
enter the plan as literals. Everything that grows with places, periods or editions is a DataFrame.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.functions.text import round_at
from statloom.operators.skew import exact_percentiles, newest
from statloom.session import materialize

# Fixed values of the method.
COMMON_SHARE = 0.8
MAX_AGE_MONTHS = 72
MIN_SHARE = 0.6
MIN_PILLARS = 6
LOW_Q, HIGH_Q = 0.025, 0.975
LOG_FLOOR = 1e-9
SHARE_SLACK = 1e-9
HDI_LIFE = (20.0, 85.0)
HDI_INCOME = (10_000.0, 500_000.0)
HDI_ENROLMENT_CAP = 100.0
PERIOD = ["period_start", "period_end", "period_label"]


@dataclass(frozen=True)
class IndicatorSpec:
    id: str
    pillar: str | None
    direction: str  # higher_better, lower_better
    target: float | None = None
    weight: float = 1.0
    log: bool = False


@dataclass(frozen=True)
class IndexSpec:
    id: str
    kind: str  # mean, hdi
    dimensions: Mapping[str, Sequence[str]]


SPEC_SCHEMA = "indicator_id string, pillar string, direction string, target double, weight double, log boolean"


def spec_frame(spark: SparkSession, specs: Sequence[IndicatorSpec]) -> DataFrame:
    rows = [(s.id, s.pillar, s.direction, s.target, s.weight, s.log) for s in specs]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def wanted_specs(specs: Sequence[IndicatorSpec], indices: Sequence[IndexSpec]) -> list[IndicatorSpec]:
    """Indicators of a pillar, plus those only a thematic index uses."""
    members = {i for x in indices for part in x.dimensions.values() for i in part}
    return [s for s in specs if s.pillar or s.id in members]


def editions(first: int, today: date) -> list[tuple[int, date]]:
    """Edition year and its cut-off: 31 December, or today for the running year."""
    return [(y, today if y == today.year else date(y, 12, 31)) for y in range(first, today.year + 1)]


def peer_groups(places: DataFrame) -> DataFrame:
    """Current first-level places with their peer group."""
    return places.filter(
        F.col("type").isin("state", "ut") & F.col("valid_to").isNull() & F.col("peer_group").isNotNull()
    ).select(F.col("slug").alias("place"), "peer_group")


def scoring_values(latest: DataFrame, places: DataFrame, specs: Sequence[IndicatorSpec]) -> DataFrame:
    """Latest values of the wanted indicators, cities left out."""
    wanted = latest.filter(F.col("indicator_id").isin([s.id for s in specs]))
    towns = places.filter(F.col("type") == "city").select(F.col("slug").alias("place"))
    return wanted.join(towns, "place", "left_anti")


def goalposts(
    values: DataFrame, specs: Sequence[IndicatorSpec], base: date, national: str
) -> DataFrame:
    """(indicator_id, worst, best): ends of the 2.5–97.5 % range, the target replacing the best end."""
    rows = values.filter((F.col("place") != national) & (F.col("period_end") >= F.lit(base)))
    ends = exact_percentiles(rows, ["indicator_id"], "value", {"low": LOW_Q, "high": HIGH_Q})
    spec = spec_frame(values.sparkSession, specs)
    higher = F.col("direction") == "higher_better"
    return (
        ends.join(spec, "indicator_id")
        .select(
            "indicator_id",
            F.when(higher, F.col("low")).otherwise(F.col("high")).alias("worst"),
            F.coalesce("target", F.when(higher, F.col("high")).otherwise(F.col("low"))).alias("best"),
        )
        .filter("worst != best")
    )


def version_key(version: Column) -> Column:
    """'1.10' as [1, 10], so that versions compare as numbers."""
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int"))


def inherit_latest(stored: DataFrame, version: str) -> DataFrame:
    """Each indicator's goalposts in the newest other version."""
    other = stored.filter(F.col("version") != version).withColumn("_v", version_key(F.col("version")))
    return newest(other, ["indicator_id"], ["_v"]).select("indicator_id", "worst", "best")


def ensure_goalposts(stored: DataFrame, version: str, computed: DataFrame, specs: Sequence[IndicatorSpec]) -> DataFrame:
    """Goalposts to use: stored for this version, else inherited, else freshly computed."""
    wanted = spec_frame(stored.sparkSession, specs).select("indicator_id", "pillar", "weight")
    own = stored.filter(F.col("version") == version).select("indicator_id", "worst", "best")
    ranked = (
        own.withColumn("origin", F.lit("1 stored"))
        .unionByName(inherit_latest(stored, version).withColumn("origin", F.lit("2 inherited")))
        .unionByName(computed.select("indicator_id", "worst", "best").withColumn("origin", F.lit("3 computed")))
    )
    best = ranked.groupBy("indicator_id").agg(F.min(F.struct("origin", "worst", "best")).alias("pick"))
    return wanted.join(best, "indicator_id").select(
        F.lit(version).alias("version"),
        "indicator_id",
        "pillar",
        "weight",
        F.col("pick.worst").alias("worst"),
        F.col("pick.best").alias("best"),
        F.substring("pick.origin", 3, 20).alias("origin"),
    )


def sync_membership(stored: DataFrame, version: str, specs: Sequence[IndicatorSpec]) -> DataFrame:
    """Rows of this version follow the specs: unused indicators go, pillars are re-pointed."""
    spec = spec_frame(stored.sparkSession, specs).select("indicator_id", F.col("pillar").alias("_pillar"))
    current = stored.filter(F.col("version") == version)
    kept = current.join(spec, "indicator_id").withColumn("pillar", F.col("_pillar")).drop("_pillar")
    return stored.filter(F.col("version") != version).unionByName(kept)


def select_values(values: DataFrame, cutoffs: Sequence[tuple[int, date]], national: str) -> DataFrame:
    """The value each edition uses for every (indicator, place).

    Of the values ended within six years of the cut-off, the newest period reported by 80 % of the
    places is common to all; a place outside it falls back to its newest value up to that period,
    then to its newest value.
    """
    cut = F.array(*[F.struct(F.lit(e).alias("edition"), F.lit(c).alias("cutoff")) for e, c in cutoffs])
    end = F.col("period_end")
    rows = (
        values.select("indicator_id", "place", *PERIOD, "value")
        .withColumn(
            "_cut",
            F.explode(
                F.filter(cut, lambda x: (end <= x["cutoff"]) & (end >= F.add_months(x["cutoff"], -MAX_AGE_MONTHS)))
            ),
        )
        .select("*", F.col("_cut.edition").alias("edition"))
        .drop("_cut")
    )
    local = rows.filter(F.col("place") != national)
    group = ["edition", "indicator_id"]
    # One row per place first, so that the counts below are plain (map-side) sums.
    places = local.groupBy(*group, "place").agg(F.lit(1).alias("_one")).groupBy(*group).agg(
        F.count("_one").alias("places")
    )
    reported = (
        local.groupBy(*group, *PERIOD, "place").agg(F.lit(1).alias("_one"))
        .groupBy(*group, *PERIOD).agg(F.count("_one").alias("reported"))
    )
    common = (
        reported.join(places, group)
        .filter(F.col("reported") / F.col("places") >= COMMON_SHARE)
        .groupBy(*group)
        .agg(F.max(F.struct("period_end", "period_start", "period_label")).alias("common"))
    )
    key = F.struct("period_end", "period_start", "period_label")
    choice = F.struct(
        F.coalesce(key == F.col("common"), F.lit(False)).alias("in_common"),
        F.coalesce(end <= F.col("common.period_end"), F.lit(False)).alias("in_time"),
        *[F.col(c) for c in ("period_end", "period_start", "period_label", "value")],
    )
    picked = rows.join(common, group, "left").groupBy(*group, "place").agg(F.max(choice).alias("pick"))
    return picked.select(*group, "place", *[F.col(f"pick.{c}").alias(c) for c in [*PERIOD, "value"]])


def scaled(value: Column, worst: Column, best: Column, log: Column) -> Column:
    """0–100 between the goalposts, clipped; distances on a log scale where asked."""

    def on_log(c: Column) -> Column:
        return F.log(F.greatest(c, F.lit(LOG_FLOOR)))

    linear = (value - worst) / (best - worst)
    span = on_log(best) - on_log(worst)
    logged = F.when(span == 0, F.lit(0.0)).otherwise((on_log(value) - on_log(worst)) / span)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(log, logged).otherwise(linear) * 100))


def indicator_scores(chosen: DataFrame, posts: DataFrame, specs: Sequence[IndicatorSpec]) -> DataFrame:
    """Every chosen value with its score; NULL where the indicator has no goalposts."""
    spec = spec_frame(chosen.sparkSession, specs).select("indicator_id", "pillar", "weight", "log")
    return (
        chosen.join(spec, "indicator_id")
        .join(posts.select("indicator_id", "worst", "best"), "indicator_id", "left")
        .select(
            "edition", "place", "indicator_id", "pillar", "weight", "value", "period_label", "period_end",
            F.when(
                F.col("worst").isNotNull(),
                scaled(F.col("value"), F.col("worst"), F.col("best"), F.col("log")),
            ).alias("score"),
        )
    )


def scorecards(ind: DataFrame, places: DataFrame, years: Sequence[int]) -> DataFrame:
    """One row per edition and place with a map indicator -> (score, value, period_label).

    A card holds at most one entry per catalogue indicator. Every roll-up below is an expression
    over the card, so pillars, composite and indices share this single shuffle. Places without any
    value get an empty card: their pillar and composite rows exist with a NULL score.
    """
    entry = F.struct("indicator_id", F.struct("score", "value", "period_label"))
    cards = ind.groupBy("edition", "place").agg(F.map_from_entries(F.collect_list(entry)).alias("card"))
    scaffold = places.select("place").withColumn("edition", F.explode(F.array(*[F.lit(y) for y in years])))
    return scaffold.join(cards, ["edition", "place"], "left")


def _entry(key: Column, score: Column, coverage: Column) -> Column:
    return F.struct(
        key.alias("key"), score.cast("double").alias("score"), coverage.cast("double").alias("coverage")
    )


def _members(pairs: Sequence[tuple[str, float]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(w).alias("weight")) for i, w in pairs])


def _weighted(members: Column, finish: Callable[[Column], Column]) -> Column:
    """Folds the scores of the card's members into (points, weight); `finish` makes the result."""
    start = F.struct(F.lit(0.0).alias("points"), F.lit(0.0).alias("weight"))

    def add(acc: Column, m: Column) -> Column:
        score = F.col("card")[m["id"]]["score"]
        return F.struct(
            (acc["points"] + F.coalesce(score * m["weight"], F.lit(0.0))).alias("points"),
            (acc["weight"] + F.when(score.isNotNull(), m["weight"]).otherwise(0.0)).alias("weight"),
        )

    return F.aggregate(members, start, add, finish)


def pillar_entries(specs: Sequence[IndicatorSpec]) -> Column:
    """Per pillar the weighted mean of its scores if 60 % of the weight is there; an entry either way."""
    members: dict[str, list[tuple[str, float]]] = {}
    for s in specs:
        if s.pillar:
            members.setdefault(s.pillar, []).append((s.id, s.weight))
    pillars = F.array(
        *[
            F.struct(
                F.lit(name).alias("key"), _members(part).alias("members"),
                F.lit(float(sum(w for _, w in part))).alias("total"),
            )
            for name, part in sorted(members.items())
        ]
    )

    def finish(p: Column, acc: Column) -> Column:
        coverage = acc["weight"] / p["total"]
        enough = (acc["weight"] > 0) & (coverage >= MIN_SHARE - SHARE_SLACK)
        return _entry(p["key"], F.when(enough, acc["points"] / acc["weight"]), coverage)

    return F.transform(pillars, lambda p: _weighted(p["members"], lambda acc: finish(p, acc)))


def _mean_if(values: Column, enough: Callable[[Column], Column]) -> Column:
    """Mean of an array without its NULLs, kept only where `enough` of its size holds."""
    return F.aggregate(
        values,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda acc, v: F.struct(
            (acc["sum"] + F.coalesce(v, F.lit(0.0))).alias("sum"),
            (acc["n"] + F.when(v.isNotNull(), 1).otherwise(0)).alias("n"),
        ),
        lambda acc: F.struct(
            F.when((acc["n"] > 0) & enough(acc["n"]), acc["sum"] / acc["n"]).alias("mean"), acc["n"].alias("n")
        ),
    )


def composite_entry(pillars: Column, key: str, min_pillars: int = MIN_PILLARS) -> Column:
    """Mean of the scored pillars when there are enough of them; coverage is their share."""
    folded = _mean_if(F.transform(pillars, lambda x: x["score"]), lambda n: n >= min_pillars)
    return _entry(F.lit(key), folded["mean"], folded["n"] / F.size(pillars))


def _index_entries(indices: Sequence[IndexSpec]) -> Column:
    """Mean-type indices: dimension means where 60 % of members score, then the mean of dimensions."""
    literal = F.array(
        *[
            F.struct(
                F.lit(x.id).alias("key"),
                F.array(
                    *[
                        F.struct(_members([(m, 1.0) for m in part]).alias("members"), F.lit(len(part)).alias("size"))
                        for part in x.dimensions.values()
                    ]
                ).alias("dimensions"),
            )
            for x in indices
        ]
    )

    def dimension(d: Column) -> Column:
        return _weighted(
            d["members"],
            lambda acc: F.when(
                (acc["weight"] > 0) & (acc["weight"] / d["size"] >= MIN_SHARE - SHARE_SLACK),
                acc["points"] / acc["weight"],
            ),
        )

    def index(x: Column) -> Column:
        size = F.size(x["dimensions"])
        folded = _mean_if(
            F.transform(x["dimensions"], dimension), lambda n: n / size >= MIN_SHARE - SHARE_SLACK
        )
        return _entry(x["key"], folded["mean"], folded["n"] / size)

    return F.transform(literal, index)


def hdi_entry(index: IndexSpec) -> Column:
    """Geometric mean of life, knowledge and (log) income indices, × 100; NULL when one is missing."""

    def raw(indicator_id: str) -> Column:
        return F.col("card")[indicator_id]["value"]

    def clip(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    life, income = raw(index.dimensions["Health"][0]), raw(index.dimensions["Income"][0])
    enrolment = [raw(i) for i in index.dimensions["Knowledge"]]
    known = F.filter(F.array(*enrolment), lambda e: e.isNotNull())
    taught = F.transform(known, lambda e: F.least(e, F.lit(HDI_ENROLMENT_CAP)))
    have = F.size(taught)
    capped = F.aggregate(taught, F.lit(0.0), lambda acc, e: acc + e)
    health = clip((life - HDI_LIFE[0]) / (HDI_LIFE[1] - HDI_LIFE[0]))
    low, high = math.log(HDI_INCOME[0]), math.log(HDI_INCOME[1])
    wealth = clip((F.log(income) - low) / (high - low))
    whole = life.isNotNull() & (income > 0) & (have > 0)
    score = F.when(whole, F.pow(health * clip(capped / have / 100) * wealth, F.lit(1.0 / 3.0)) * 100)
    return _entry(F.lit(index.id), score, F.when(score.isNotNull(), 1.0).otherwise(0.0))


def index_entries(indices: Sequence[IndexSpec]) -> Column:
    parts = [F.array(hdi_entry(x)) for x in indices if x.kind == "hdi"]
    means = [x for x in indices if x.kind == "mean"]
    return F.concat(*([_index_entries(means)] if means else []), *parts)


def entry_rows(cards: DataFrame, entries: Column) -> DataFrame:
    """Cards to rows (edition, place, key, score, coverage)."""
    rows = cards.withColumn("_e", F.explode(entries))
    return rows.select("edition", "place", "_e.key", "_e.score", "_e.coverage")


def rank_scores(scores: DataFrame, peers: DataFrame, group: Sequence[str] = ("edition", "level", "key")) -> DataFrame:
    """Adds rank_overall and rank_peer (1, 2, 2, 4) on scores rounded to one decimal.

    A 0–100 score has at most 1,001 rounded values, so the ranks come from a histogram of that size
    per (edition, key, peer group); places are never sorted. Places outside `peers` get no rank.
    """
    group = list(group)
    rated = scores.withColumn("_tenth", round_at(F.col("score"), 1)).join(peers, "place", "left")
    ranked = rated.filter(F.col("peer_group").isNotNull() & F.col("_tenth").isNotNull())
    bars = ranked.groupBy(*group, "peer_group", "_tenth").agg(F.count(F.lit(1)).alias("n"))
    down = F.col("_tenth").desc()
    above = Window.partitionBy(*group).orderBy(down).rangeBetween(Window.unboundedPreceding, 0)
    above_peers = Window.partitionBy(*group, "peer_group").orderBy(down).rangeBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy(*group, "_tenth")
    bars = bars.select(
        *group, "peer_group", "_tenth",
        (F.sum("n").over(above) - F.sum("n").over(level) + 1).alias("rank_overall"),
        (F.sum("n").over(above_peers) - F.col("n") + 1).alias("rank_peer"),
    )
    return rated.join(bars, [*group, "peer_group", "_tenth"], "left").select(
        *scores.columns, "rank_overall", "rank_peer"
    )


def with_previous(scores: DataFrame) -> DataFrame:
    """Ranks of the edition one year earlier beside the current ones.

    Every row is offered to its own edition and, as the past, to the next one; the table is read
    once and an edition that is missing leaves NULL.
    """
    id_columns = ["place", "level", "key"]
    rest = [c for c in scores.columns if c not in id_columns and c != "edition"]
    now = F.struct(*[F.col(c) for c in rest])
    past = F.struct("rank_overall", "rank_peer")
    offered = scores.select(
        *id_columns,
        F.explode(
            F.array(
                F.struct(F.col("edition"), now.alias("now"), F.when(F.lit(False), past).alias("past")),
                F.struct(
                    (F.col("edition") + 1).alias("edition"), F.when(F.lit(False), now).alias("now"), past.alias("past")
                ),
            )
        ).alias("_o"),
    )
    merged = offered.groupBy(F.col("_o.edition").alias("edition"), *id_columns).agg(
        F.max("_o.now").alias("now"), F.max("_o.past").alias("past")
    )
    return merged.filter(F.col("now").isNotNull()).select(
        "edition", *id_columns, *[F.col(f"now.{c}").alias(c) for c in rest],
        F.col("past.rank_overall").alias("rank_overall_prev"), F.col("past.rank_peer").alias("rank_peer_prev"),
    )


def score_all(
    values: DataFrame,
    posts: DataFrame,
    specs: Sequence[IndicatorSpec],
    indices: Sequence[IndexSpec],
    places: DataFrame,
    cutoffs: Sequence[tuple[int, date]],
    national: str,
    composite: str,
    min_pillars: int = MIN_PILLARS,
) -> DataFrame:
    """Indicator, pillar and composite scores of every place and edition, with ranks.

    `places` holds (place, peer_group) of the ranked places; the national total is scored as well
    but not ranked. Cards are written once to the shared folder, since ranks read them twice.
    """
    peers = places.select("place", "peer_group")
    total = values.sparkSession.createDataFrame([(national,)], "place string")
    everyone = peers.select("place").unionByName(total)
    chosen = select_values(values, cutoffs, national)
    ind = indicator_scores(chosen, posts, specs)
    cards = materialize(scorecards(ind, everyone, [y for y, _ in cutoffs]), "cards")
    pillars = F.col("pillars")
    cards = cards.withColumn("pillars", pillar_entries(specs))
    main = F.array(composite_entry(pillars, composite, min_pillars))
    upper = (
        cards.withColumn("upper", F.concat(main, index_entries(indices)) if indices else main)
        .withColumn(
            "_e",
            F.explode(
                F.concat(
                    F.transform(pillars, lambda x: F.struct(F.lit("pillar").alias("level"), x.alias("e"))),
                    F.transform("upper", lambda x: F.struct(F.lit("composite").alias("level"), x.alias("e"))),
                )
            ),
        )
        .select("edition", "place", "_e.level", "_e.e.key", "_e.e.score", "_e.e.coverage")
    )
    ranked = with_previous(rank_scores(upper, peers))
    lower = (
        cards.select("edition", "place", F.explode("card").alias("key", "v"))
        .filter("v.score is not null")
        .select(
            "edition", "place", F.lit("indicator").alias("level"), "key", F.col("v.score").alias("score"),
            F.col("v.period_label").alias("period_label"),
        )
    )
    return ranked.unionByName(lower, allowMissingColumns=True)
