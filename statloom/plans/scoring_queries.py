"""Registered queries of the scoring engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators import scoring as S
from statloom.operators.skew import exact_percentiles
from statloom.plans import bindings as B
from statloom.plans.registry import Tables, query, view
from statloom.session import materialize

CUTOFFS = S.editions(B.FIRST_EDITION, B.TODAY)
SCORED = S.wanted_specs(B.SPECS, B.INDICES)


def _text(value) -> str:
    return "null" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


view("specs", "select * from (values " + ", ".join(
    f"('{s.id}', {_text(s.pillar)}, '{s.direction}', cast({_text(s.target)} as double), {s.weight}::double, {s.log})"
    for s in SCORED
) + ") s(indicator_id, pillar, direction, target, weight, log)")
view("cuts", "select * from (values " + ", ".join(f"({y}, date '{d}')" for y, d in CUTOFFS) + ") c(edition, cutoff)")
view("scoring_obs", "select obs.* from obs join specs using (indicator_id)")
view("posts", f"""
  select indicator_id, worst, best from (
    select indicator_id,
           case when direction = 'higher_better' then low else high end as worst,
           coalesce(target, case when direction = 'higher_better' then high else low end) as best
    from (select indicator_id, quantile_cont(value, 0.025) as low, quantile_cont(value, 0.975) as high
          from scoring_obs where place <> 'all' and period_end >= date '{B.GOALPOST_BASE}' group by 1)
    join specs using (indicator_id)) where worst <> best
""")
view("edition_rows", """
  select edition, o.* from scoring_obs o join cuts
    on period_end <= cutoff and period_end >= cutoff - interval 72 month
""")
view("common_period", """
  select edition, indicator_id, arg_max(period_end, period_end) as c_end, arg_max(period_start, period_end) as c_start,
         arg_max(period_label, period_end) as c_label
  from (select edition, indicator_id, period_end, period_start, period_label, count(distinct place) as reported
        from edition_rows where place <> 'all' group by all)
  join (select edition, indicator_id, count(distinct place) as n_places from edition_rows where place <> 'all'
        group by all) using (edition, indicator_id)
  where reported / n_places >= 0.8 group by 1, 2
""")
view("chosen", """
  select edition, indicator_id, place, period_start, period_end, period_label, value from (
    select e.*, row_number() over (partition by edition, indicator_id, place order by
             coalesce(period_end = c_end and period_start = c_start and period_label = c_label, false) desc,
             coalesce(period_end <= c_end, false) desc, period_end desc, period_start desc) as pos
    from edition_rows e left join common_period using (edition, indicator_id)) where pos = 1
""")
view("ind_scores", """
  select edition, place, indicator_id, pillar, weight, period_label, period_end,
         greatest(0, least(100, 100 * case
           when log and ln(greatest(best, 1e-9)) = ln(greatest(worst, 1e-9)) then 0
           when log then (ln(greatest(value, 1e-9)) - ln(greatest(worst, 1e-9)))
                         / (ln(greatest(best, 1e-9)) - ln(greatest(worst, 1e-9)))
           else (value - worst) / (best - worst) end)) as score
  from chosen join posts using (indicator_id) join specs using (indicator_id)
""")
view("everyone", "select place, peer_group from nations union all select 'all', null")
view("pillar_rows", """
  select edition, place, key, case when coverage >= 0.6 - 1e-9 then points / w end as score, coverage from (
    select c.edition, e.place, p.pillar as key, sum(score * i.weight) as points, sum(i.weight) as w,
           coalesce(sum(i.weight), 0) / any_value(p.total) as coverage
    from cuts c cross join everyone e
    cross join (select pillar, sum(weight) as total from specs where pillar is not null group by 1) p
    left join ind_scores i on i.edition = c.edition and i.place = e.place and i.pillar = p.pillar
    group by 1, 2, 3)
""")
view("composite_rows", f"""
  select edition, place, '{B.COMPOSITE}' as key,
         case when count(score) >= {B.MIN_PILLARS} then avg(score) end as score, count(score) / count(*) as coverage
  from pillar_rows group by 1, 2
""")
view("index_members", "select * from (values " + ", ".join(
    f"('{x.id}', '{d}', '{m}', {len(ms)}, {len(x.dimensions)})"
    for x in B.INDICES if x.kind == "mean" for d, ms in x.dimensions.items() for m in ms
) + ") m(key, dimension, indicator_id, members, dims)")
view("index_rows", """
  select c.edition, e.place, k.key, case when cov >= 0.6 - 1e-9 then mean end as score, coalesce(cov, 0) as coverage
  from cuts c cross join everyone e cross join (select distinct key from index_members) k
  left join (
    select edition, place, key, avg(m) as mean, count(*) / any_value(dims) as cov from (
      select edition, place, key, dimension, dims, avg(score) as m
      from ind_scores join index_members using (indicator_id)
      group by edition, place, key, dimension, dims, members having count(*) / members >= 0.6 - 1e-9)
    group by 1, 2, 3) s on s.edition = c.edition and s.place = e.place and s.key = k.key
""")
view("hdi_rows", """
  select edition, place, key, score, case when score is null then 0.0 else 1.0 end as coverage from (
    select c.edition, e.place, 'human-index' as key, case when life is not null and income > 0 and enrol is not null
      then 100 * pow(greatest(0, least(1, (life - 20) / 65.0)) * greatest(0, least(1, enrol / 100))
             * greatest(0, least(1, (ln(income) - ln(10000.0)) / (ln(500000.0) - ln(10000.0)))), 1 / 3.0) end as score
    from cuts c cross join everyone e left join (
      select edition, place, max(value) filter (where indicator_id = 'fulfilled-share') as life,
             max(value) filter (where indicator_id = 'mean-order-value') as income,
             avg(least(value, 100)) filter (where indicator_id in ('return-share', 'accepted-share')) as enrol
      from chosen group by 1, 2) v on v.edition = c.edition and v.place = e.place)
""")
view("upper_rows", """
  select 'pillar' as level, * from pillar_rows union all select 'composite', * from composite_rows
  union all select 'composite', * from index_rows union all select 'composite', * from hdi_rows
""")
view("upper_ranked", """
  select u.*, peer_group,
    case when score is not null and peer_group is not null then rank() over (
      partition by edition, level, key, (score is not null and peer_group is not null)
      order by floor(score * 10 + 0.5) desc) end as rank_overall,
    case when score is not null and peer_group is not null then rank() over (
      partition by edition, level, key, peer_group, score is not null
      order by floor(score * 10 + 0.5) desc) end as rank_peer
  from upper_rows u join everyone using (place)
""")
view("scores", """
  select edition, place, 'indicator' as level, indicator_id as key, score, cast(null as double) as coverage,
         period_label, cast(null as bigint) as rank_overall, cast(null as bigint) as rank_peer,
         cast(null as bigint) as rank_overall_prev, cast(null as bigint) as rank_peer_prev
  from ind_scores
  union all
  select u.edition, u.place, u.level, u.key, u.score, u.coverage, null, u.rank_overall, u.rank_peer,
         b.rank_overall, b.rank_peer
  from upper_ranked u left join upper_ranked b
    on b.edition = u.edition - 1 and b.place = u.place and b.level = u.level and b.key = u.key
""")


def values(t: Tables) -> DataFrame:
    return B.observations(t).filter(F.col("indicator_id").isin([s.id for s in SCORED]))


def posts(t: Tables, rows: DataFrame) -> DataFrame:
    return S.goalposts(rows, SCORED, B.GOALPOST_BASE, B.NATIONAL)


def chosen(t: Tables) -> DataFrame:
    return S.select_values(values(t), CUTOFFS, B.NATIONAL)


def load_scores(t: Tables) -> DataFrame:
    """The whole score table from the stored yearly figures."""
    rows = values(t)
    return S.score_all(
        rows, posts(t, rows), SCORED, B.INDICES, B.ranked_places(t), CUTOFFS, B.NATIONAL, B.COMPOSITE, B.MIN_PILLARS
    )


def scores(t: Tables) -> DataFrame:
    return t.stored("scores", load_scores)


def _everyone(t: Tables) -> DataFrame:
    total = t.spark.createDataFrame([(B.NATIONAL,)], "place string")
    return B.ranked_places(t).select("place").unionByName(total)


def _indicator_scores(t: Tables) -> DataFrame:
    rows = values(t)
    return S.indicator_scores(S.select_values(rows, CUTOFFS, B.NATIONAL), posts(t, rows), SCORED)


def _cards(t: Tables) -> DataFrame:
    return S.scorecards(_indicator_scores(t), _everyone(t), YEARS)


YEARS = [y for y, _ in CUTOFFS]


@query("K1_percentile", """
  select indicator_id, quantile_cont(value, 0.025) as low, quantile_cont(value, 0.5) as middle,
         quantile_cont(value, 0.975) as high from obs group by 1
""", rounds="low middle high")
def k1(t: Tables) -> DataFrame:
    return exact_percentiles(
        B.observations(t), ["indicator_id"], "value", {"low": 0.025, "middle": 0.5, "high": 0.975}
    )


@query("K1_percentile_lines", """
  select l_returnflag, quantile_cont(l_extendedprice, 0.025) as low, quantile_cont(l_extendedprice, 0.975) as high
  from lineitem group by 1
""", rounds="low high")
def k1_lines(t: Tables) -> DataFrame:
    return exact_percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"low": 0.025, "high": 0.975})


@query("K2_goalposts", "select * from posts", rounds="worst best")
def k2(t: Tables) -> DataFrame:
    return posts(t, values(t))


def _stored_posts(t: Tables) -> DataFrame:
    """Stored goalposts: 1.9 and 1.10 came from the two earlier runs; 2.0 froze the trade pillar."""
    rows = B.vintages(t).filter(F.col("indicator_id").isin([s.id for s in SCORED]))
    first = S.goalposts(rows.filter("run_id = 1"), SCORED, B.GOALPOST_BASE, B.NATIONAL)
    second = S.goalposts(
        rows.filter("run_id = 2 and indicator_id <> 'mean-tax'"), SCORED, B.GOALPOST_BASE, B.NATIONAL
    )
    frozen = first.filter(F.col("indicator_id").isin("mean-order-value", "urgent-share"))
    return (
        first.filter("indicator_id not in ('mean-tax', 'lines-per-order')").withColumn("version", F.lit("1.9"))
        .unionByName(second.filter("indicator_id <> 'lines-per-order'").withColumn("version", F.lit("1.10")))
        .unionByName(frozen.withColumn("version", F.lit("2.0")))
        .withColumn("pillar", F.lit("trade"))
    )


def _posts_sql(run: int) -> str:
    return f"""
    select indicator_id, worst, best from (
      select indicator_id, case when direction = 'higher_better' then low else high end as worst,
             coalesce(target, case when direction = 'higher_better' then high else low end) as best
      from (select indicator_id, quantile_cont(value, 0.025) as low, quantile_cont(value, 0.975) as high
            from obs_runs where run_id = {run} and place <> 'all' and period_end >= date '{B.GOALPOST_BASE}'
            group by 1)
      join specs using (indicator_id)) where worst <> best"""


view("stored_posts", f"""
  select '1.9' as version, * from ({_posts_sql(1)}) where indicator_id not in ('mean-tax', 'lines-per-order')
  union all select '1.10', * from ({_posts_sql(2)}) where indicator_id not in ('mean-tax', 'lines-per-order')
  union all select '2.0', * from ({_posts_sql(1)}) where indicator_id in ('mean-order-value', 'urgent-share')
""")


@query("N21_inherit_latest", """
  select indicator_id, worst, best from stored_posts where version <> '2.0'
  qualify row_number() over (partition by indicator_id
    order by list_transform(string_split(version, '.'), lambda x: cast(x as int)) desc) = 1
""", rounds="worst best")
def n21(t: Tables) -> DataFrame:
    return S.inherit_latest(_stored_posts(t), "2.0")


@query("K3_ensure_goalposts", """
  select '2.0' as version, s.indicator_id, s.pillar, s.weight,
         coalesce(o.worst, i.worst, c.worst) as worst, coalesce(o.best, i.best, c.best) as best,
         case when o.worst is not null then 'stored' when i.worst is not null then 'inherited' else 'computed' end
           as origin
  from specs s left join (select * from stored_posts where version = '2.0') o using (indicator_id)
  left join (select * from stored_posts where version = '1.10') i using (indicator_id)
  left join posts c using (indicator_id)
  where coalesce(o.worst, i.worst, c.worst) is not null
""", rounds="worst best weight")
def k3(t: Tables) -> DataFrame:
    return S.ensure_goalposts(_stored_posts(t), "2.0", posts(t, values(t)), SCORED)


@query("K4_sync_membership", """
  select version, indicator_id, worst, best, 'trade' as pillar from stored_posts where version <> '1.10'
  union all
  select version, s.indicator_id, worst, best, p.pillar from stored_posts s join specs p using (indicator_id)
  where version = '1.10' and p.pillar in ('trade', 'quality')
""", rounds="worst best")
def k4(t: Tables) -> DataFrame:
    kept = [s for s in SCORED if s.pillar in ("trade", "quality")]
    return S.sync_membership(_stored_posts(t), "1.10", kept)


@query("K5_specs", "select indicator_id, pillar, direction, target, log from specs", rounds="target")
def k5(t: Tables) -> DataFrame:
    """The indicators scored, as the figures at hand carry them."""
    wanted = S.spec_frame(t.spark, S.wanted_specs(B.SPECS, B.INDICES)).drop("weight")
    return wanted.join(B.observations(t).select("indicator_id").distinct(), "indicator_id", "left_semi")


@query("K6_select_values", "select * from chosen", rounds="value")
def k6(t: Tables) -> DataFrame:
    return chosen(t)


@query("K7_indicator_scores", "select edition, place, indicator_id, period_label, score from ind_scores", rounds="score")
def k7(t: Tables) -> DataFrame:
    scored = _indicator_scores(t).filter("score is not null")
    return scored.select("edition", "place", "indicator_id", "period_label", "score")


@query("K8_pillar_scores", "select * from pillar_rows", rounds="score coverage")
def k8(t: Tables) -> DataFrame:
    return S.entry_rows(_cards(t), S.pillar_entries(SCORED))


@query("K9_composite_scores", "select * from composite_rows", rounds="score coverage")
def k9(t: Tables) -> DataFrame:
    entry = S.composite_entry(S.pillar_entries(SCORED), B.COMPOSITE, B.MIN_PILLARS)
    return S.entry_rows(_cards(t), F.array(entry))


@query("K10_index_scores", "select * from index_rows", rounds="score coverage")
def k10(t: Tables) -> DataFrame:
    return S.entry_rows(_cards(t), S.index_entries([x for x in B.INDICES if x.kind == "mean"]))


@query("K11_hdi_scores", "select edition, place, key, score, cast(coverage as double) as coverage from hdi_rows", rounds="score coverage")
def k11(t: Tables) -> DataFrame:
    return S.entry_rows(_cards(t), F.array(S.hdi_entry(B.INDICES[2])))


@query("K12_editions", """
  select edition, strftime(cutoff, '%Y-%m-%d') as cutoff, count(*) as figures from cuts join obs
  on period_end <= cutoff group by 1, 2
""")
def k12(t: Tables) -> DataFrame:
    cut = F.explode(F.array(*[F.struct(F.lit(y).alias("edition"), F.lit(d).alias("cutoff")) for y, d in CUTOFFS]))
    rows = B.observations(t).withColumn("c", cut).filter("period_end <= c.cutoff")
    return rows.groupBy("c.edition", "c.cutoff").agg(F.count(F.lit(1)).alias("figures"))


@query("K13_score_all", "select * from scores", rounds="score coverage")
def k13(t: Tables) -> DataFrame:
    """From the orders to the ranked score table, without using any stored step."""
    rows = materialize(B.load_observations(t).filter(F.col("indicator_id").isin([s.id for s in SCORED])), "values")
    return S.score_all(
        rows, posts(t, rows), SCORED, B.INDICES, B.ranked_places(t), CUTOFFS, B.NATIONAL, B.COMPOSITE, B.MIN_PILLARS
    )


@query("K14_scoring_values", """
  select indicator_id, place, period_label, value from scoring_obs
  union all select indicator_id, place || '-undivided', period_label, value from scoring_obs
  where place in ('nation-a', 'nation-b', 'nation-c', 'nation-d') and period_label < '1998'
""", rounds="value")
def k14(t: Tables) -> DataFrame:
    """Figures of nations, their former selves and a few towns; the towns are left out."""
    obs = B.observations(t)
    former = obs.filter(F.col("place").isin(*[f"nation-{x}" for x in "abcd"]) & (F.col("period_label") < "1998"))
    former = former.withColumn("place", F.concat("place", F.lit("-undivided")))
    towns = t.customer.select(
        F.lit("mean-tax").alias("indicator_id"), F.lower(F.translate("c_name", "#", "-")).alias("place"),
        F.lit("2000").alias("period_label"), F.col("c_acctbal").alias("value"),
    )
    rows = obs.unionByName(former).select("indicator_id", "place", "period_label", "value").unionByName(towns)
    return S.scoring_values(rows, B.places(t), SCORED)


@query("K15_peer_groups", "select place, peer_group from nations")
def k15(t: Tables) -> DataFrame:
    return S.peer_groups(B.places(t))


@query("N7_rank_scores", """
  select edition, place, level, key, rank_overall, rank_peer from scores where level <> 'indicator'
""")
def n7(t: Tables) -> DataFrame:
    upper = scores(t).filter("level <> 'indicator'")
    return upper.select("edition", "place", "level", "key", "rank_overall", "rank_peer")


@query("N7_rank_customers", """
  select segment as key, place, rank() over (partition by segment order by floor(score * 10 + 0.5) desc) as rank_overall,
         rank() over (partition by segment, peer_group order by floor(score * 10 + 0.5) desc) as rank_peer
  from (select c_mktsegment as segment, cast(c_custkey as varchar) as place, 'nation-' || c_nationkey as peer_group,
        greatest(0, least(100, c_acctbal / 100)) as score from customer)
""")
def n7_customers(t: Tables) -> DataFrame:
    """Every customer ranked in its segment and within its nation: many places, few groups."""
    rows = t.customer.select(
        F.col("c_mktsegment").alias("key"), F.col("c_custkey").cast("string").alias("place"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("c_acctbal") / 100)).alias("score"),
    )
    peers = t.customer.select(
        F.col("c_custkey").cast("string").alias("place"),
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("peer_group"),
    )
    return S.rank_scores(rows, peers, ["key"]).select("key", "place", "rank_overall", "rank_peer")


@query("N8_with_previous", """
  select edition, place, level, key, rank_overall, rank_overall_prev, rank_peer, rank_peer_prev
  from scores where level <> 'indicator'
""")
def n8(t: Tables) -> DataFrame:
    return scores(t).filter("level <> 'indicator'").select(
        "edition", "place", "level", "key", "rank_overall", "rank_overall_prev", "rank_peer", "rank_peer_prev"
    )
