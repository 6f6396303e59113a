"""Registered queries of office-holder terms, runs and health."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.periods import calendar_year
from statloom.functions.text import clean_person
from statloom.operators import runs as H
from statloom.operators import terms as T
from statloom.plans import bindings as B
from statloom.plans.registry import Tables, fingerprint_sql, query, view
from statloom.session import materialize
from statloom.sources import exports as E

EARLIEST = date(1996, 1, 1)
NOW = datetime(2024, 1, 31)

# --- Terms: an order is a statement that its priority clerk held the customer's office ----------

_OFFICES = {
    "BUILDING": "chief_minister", "MACHINERY": "lieutenant_governor", "HOUSEHOLD": "administrator",
    "FURNITURE": "governor", "AUTOMOBILE": "dgp",
}
# Fixed windows of party membership per person: (person, party, from, to).
_MEMBERS = [
    ("Q1", "A", None, date(1997, 6, 30)), ("Q1", "N", date(1997, 7, 1), None), ("Q2", "R", None, None),
    ("Q3", "A", None, None), ("Q3", "N", None, None), ("Q5", "N", date(1999, 1, 1), None),
]


def statements(t: Tables) -> DataFrame:
    """One row per (order, return flag): the flags of an urgent or high order are its parties."""
    lines = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.max("l_shipdate").alias("ship"))
    rows = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    person = F.concat(F.lit("Q"), F.substring(pr, 1, 1))
    name = F.when(pr == "4-NOT SPECIFIED", person).otherwise(F.initcap(F.lower(F.substring(pr, 3, 20))))
    undated = (st == "O") & (pr == "5-LOW")
    return rows.select(
        F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("statement_id"),
        F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("position"), person.alias("person"), name.alias("person_name"),
        F.when(~undated, F.to_date("o_orderdate")).alias("start"),
        F.when(st != "P", F.to_date(F.col("o_orderdate")) + F.make_interval(days=(F.col("o_totalprice") / 1000).cast("int"))).cast("date").alias("end"),
        F.when(pr.isin("1-URGENT", "2-HIGH"), F.col("l_returnflag")).alias("party"), F.lit(None).cast("string").alias("party_label"),
    )


def positions(t: Tables) -> DataFrame:
    """Offices of the customer's segment; the four split nations share each position with the former one."""
    office = F.create_map(*[F.lit(x) for pair in _OFFICES.items() for x in pair])[F.col("c_mktsegment")]
    place = F.concat(F.lit("nation-"), F.lower(B.letter(F.col("c_nationkey"))))
    both = F.when(F.col("c_nationkey") < 4, F.array(place, F.concat(place, F.lit("-undivided")))).otherwise(F.array(place))
    return t.customer.select(
        F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("position"), F.explode(both).alias("place"),
        office.alias("office_type"), F.concat(F.lit("Office of "), "c_name").alias("title"),
    )


def members(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(_MEMBERS, "person string, party string, start date, end date")
    people = t.orders.select(F.concat(F.lit("Q"), F.substring("o_orderpriority", 1, 1)).alias("person")).distinct()
    return T.memberships(rows.join(people, "person", "left_semi").withColumn("party_label", F.concat(F.lit("Party "), "party")))


def built(t: Tables) -> DataFrame:
    raw = T.group_statements(statements(t))
    terms = T.build_terms(raw, positions(t), B.places(t), B.TODAY, EARLIEST)
    return T.term_notes(T.resolve_party(terms, members(t)), B.TODAY)


view("raw_terms", """
  select 's' || o_orderkey as statement_id, 'P' || o_custkey as position, 'Q' || o_orderpriority[1] as person,
         case when o_orderpriority = '4-NOT SPECIFIED' then 'Q4' else upper(o_orderpriority[3]) || lower(o_orderpriority[4:]) end as person_name,
         case when not (o_orderstatus = 'O' and o_orderpriority = '5-LOW') then o_orderdate::date end as "start",
         case when o_orderstatus <> 'P' then o_orderdate::date + floor(o_totalprice / 1000)::int end as "end",
         case when o_orderpriority in ('1-URGENT', '2-HIGH') then coalesce(flags, []) else [] end as parties
  from orders left join (select l_orderkey, list_sort(list(distinct l_returnflag)) as flags from lineitem group by 1) on l_orderkey = o_orderkey
""")
view("unique_terms", f"""
  select * from raw_terms where "end" is null or "end" >= date '{EARLIEST}'
  qualify row_number() over (partition by position, person, "start", "end" order by statement_id) = 1
""")
view("term_offices", """
  select 'P' || c_custkey as position, slug as place, valid_from, valid_to, case c_mktsegment """ + " ".join(
    f"when '{k}' then '{v}'" for k, v in _OFFICES.items()
) + """ end as office_type, 'Office of ' || c_name as title
  from customer join all_places on type = 'state' and slug in ('nation-' || lower(chr(65 + c_nationkey)),
    'nation-' || lower(chr(65 + c_nationkey)) || '-undivided')
""")
view("terms_built", f"""
  select statement_id || ':' || place as external_id, place, office_type, title, person, person_name, parties,
         u."start" as raw_start, u."end" as raw_end, greatest(u."start", valid_from) as "start",
         case when valid_to is not null and (u."end" is null or u."end" > valid_to) then valid_to else u."end" end as "end"
  from unique_terms u join term_offices using (position)
  where u."start" is not null and coalesce(coalesce(u."end", date '{B.TODAY}') >= valid_from, true) and coalesce(u."start" <= valid_to, true)
""")


@query("B1_group_statements", """
  select statement_id, position, person, person_name, strftime("start", '%Y-%m-%d') as "start", strftime("end", '%Y-%m-%d') as "end",
         array_to_string(parties, ',') as parties from raw_terms
""")
def b1(t: Tables) -> DataFrame:
    rows = T.group_statements(statements(t))
    return rows.withColumn("parties", F.array_join(F.transform("parties", lambda p: p["party"]), ","))


@query("B2_memberships", "select * from (values " + ", ".join(
    f"('{p}', '{q}', 'Party {q}', {repr(str(a)) if a else 'null'}, {repr(str(b)) if b else 'null'})" for p, q, a, b in _MEMBERS
) + ') m(person, party, label, "start", "end")')
def b2(t: Tables) -> DataFrame:
    return members(t)


_DATES = """strftime("start", '%Y-%m-%d') as "start", strftime("end", '%Y-%m-%d') as "end\""""


@query("B3_build_terms", f"select external_id, place, office_type, person, {_DATES} from terms_built")
def b3(t: Tables) -> DataFrame:
    raw = T.group_statements(statements(t))
    terms = T.build_terms(raw, positions(t), B.places(t), B.TODAY, EARLIEST)
    return terms.select("external_id", "place", "office_type", "person", "start", "end")


@query("B3_undated_problems", """
  select person_name || ' (' || person || '): term has no start date; skipped' as problem, count(*) as n
  from unique_terms where "start" is null group by 1
""")
def b3_undated(t: Tables) -> DataFrame:
    bad = T.undated_problems(T.group_statements(statements(t)), EARLIEST)
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


view("terms_party", """
  select b.*, case when office_type = 'chief_minister' and len(pick) = 1 then pick[1] end as party,
    case when office_type <> 'chief_minister' or len(pick) = 1 then '' when len(parties) > 0 and len(m) > 0 then 'party sources disagree'
      when len(pick) = 0 then 'no party recorded'
      else 'several possible parties: ' || array_to_string(list_transform(pick, lambda x: case when len(parties) > 0 then x else 'Party ' || x end), ', ') end as advisory
  from (select c.*, case when len(parties) > 0 and len(m) > 0 then list_sort(list_intersect(parties, m)) when len(parties) > 0 then parties else m end as pick
    from (select b.*, coalesce((select list_sort(list(distinct party)) from (values """ + ", ".join(
    f"('{p}', '{q}', {f'date {chr(39)}{a}{chr(39)}' if a else 'cast(null as date)'}, {f'date {chr(39)}{z}{chr(39)}' if z else 'cast(null as date)'})"
    for p, q, a, z in _MEMBERS
) + """) v(person, party, s, e) where v.person = b.person and coalesce(s <= raw_start, true) and coalesce(e >= raw_start, true)), []) as m
      from terms_built b) c) b
""")


@query("B4_resolve_party", "select external_id, party, advisory from terms_party")
def b4(t: Tables) -> DataFrame:
    return built(t).select("external_id", "party", F.array_join("advisories", "; ").alias("advisory"))


view("terms_noted", f"""
  select *, list_filter([case when raw_end < raw_start then 'term ends before it starts' end,
    case when person_name = person then 'no English name in the source' end,
    case when "end" is null and date '{B.TODAY}' - "start" > {T.STALE_DAYS} then 'in office since ' || strftime("start", '%Y-%m-%d') || ' with no end date; possibly out of date' end],
    lambda x: x is not null) as notes from terms_party
""")


@query("B5_term_notes", "select external_id, array_to_string(notes, '; ') as notes from terms_noted")
def b5(t: Tables) -> DataFrame:
    return built(t).select("external_id", F.array_join("notes", "; ").alias("notes"))


def overrides(t: Tables) -> DataFrame:
    """Decisions on every fifth-priority term of large orders, and some on terms nobody has."""
    big = t.orders.filter("o_totalprice > 400000")
    key = F.concat(F.lit("s"), F.col("o_orderkey").cast("string"), F.lit(":nation-"))
    who = big.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None)
    return who.select(
        F.concat(key, F.lower(B.letter(F.col("c_nationkey")))).alias("external_id"),
        F.when(F.col("o_orderstatus") == "F", "X").alias("party"), none.cast("string").alias("party_label"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Named Person").alias("person_name"), none.cast("date").alias("start"),
        F.when(F.col("o_orderstatus") == "P", F.lit(B.TODAY)).alias("end"), F.lit("https://example.org/decision").alias("source_url"),
        (F.col("o_orderpriority") == "1-URGENT").alias("reviewed"), F.when(F.col("o_orderstatus") == "O", "checked").alias("note"),
    )


view("term_overrides", f"""
  select 's' || o_orderkey || ':nation-' || lower(chr(65 + c_nationkey)) as external_id, case when o_orderstatus = 'F' then 'X' end as o_party,
         case when o_orderpriority = '4-NOT SPECIFIED' then 'Named Person' end as o_name, case when o_orderstatus = 'P' then date '{B.TODAY}' end as o_end,
         o_orderpriority = '1-URGENT' as o_reviewed, case when o_orderstatus = 'O' then 'checked' end as o_note
  from orders join customer on o_custkey = c_custkey where o_totalprice > 400000
""")
view("terms_decided", """
  select b.* exclude (party, person_name, "end", notes, advisory), coalesce(o_party, party) as party, coalesce(o_name, person_name) as person_name,
    coalesce(o_end, "end") as "end", coalesce(o_reviewed, false) as reviewed, o_reviewed is not null as decided,
    list_filter(notes, lambda n: not (o_name is not null and n = 'no English name in the source')
      and not (o_reviewed is not null and coalesce(o_end, "end") is not null and n like '%possibly out of date')) as notes,
    case when o_party is not null and advisory like '%part%' then '' else advisory end
      || case when o_note is null then '' when advisory = '' or (o_party is not null and advisory like '%part%') then 'maintainer: ' || o_note
           else '; maintainer: ' || o_note end as advisory
  from terms_noted b left join term_overrides using (external_id)
""")
_KEEP = [
    "external_id", "place", "office_type", "title", "person", "person_name", "start", "end", "party", "party_label",
    "source_url", "source_type", "reviewed", "advisories", "notes", "conflicts",
]


@query("B6_apply_overrides", """
  select external_id, party, person_name, strftime("end", '%Y-%m-%d') as "end", reviewed, array_to_string(notes, '; ') as notes, advisory
  from terms_decided
""")
def b6(t: Tables) -> DataFrame:
    rows = T.apply_overrides(built(t).select(*_KEEP), overrides(t))
    return rows.select(
        "external_id", "party", "person_name", "end", "reviewed", F.array_join("notes", "; ").alias("notes"),
        F.array_join("advisories", "; ").alias("advisory"),
    )


@query("B6_unused_overrides", "select external_id from term_overrides where external_id not in (select external_id from terms_built)")
def b6_unused(t: Tables) -> DataFrame:
    return T.unused_overrides(built(t), overrides(t))


def curated(t: Tables) -> DataFrame:
    """Official terms: one per current office of a large customer, some of them twins of a statement."""
    first = t.orders.filter("o_orderstatus <> 'O'").groupBy("o_custkey").agg(
        F.max(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")).alias("o")
    )
    rows = first.join(t.customer.filter("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey"))
    office = F.create_map(*[F.lit(x) for pair in _OFFICES.items() for x in pair])[F.col("c_mktsegment")]
    return rows.select(
        F.concat(F.lit("nation-"), F.lower(B.letter(F.col("c_nationkey")))).alias("place"), office.alias("office_type"),
        F.concat(F.lit("Q"), F.substring("o.o_orderpriority", 1, 1)).alias("person"), F.lit("Curated Person").alias("person_name"),
        F.date_add(F.to_date("o.o_orderdate"), 10).alias("start"), F.lit(None).cast("date").alias("end"), F.lit("C").alias("party"),
        F.lit("Party C").alias("party_label"), F.lit("https://example.org/gazette").alias("source_url"),
        (F.col("c_nationkey") > 20).alias("additional_charge"),
    ).distinct()


view("curated_rows", """
  select distinct 'nation-' || lower(chr(65 + c_nationkey)) as place, case c_mktsegment """ + " ".join(
    f"when '{k}' then '{v}'" for k, v in _OFFICES.items()
) + """ end as office_type, 'Q' || pr[1] as person, day + 10 as "start", c_nationkey > 20 as extra
  from (select o_custkey, o_orderpriority as pr, o_orderdate::date as day from orders where o_orderstatus <> 'O'
        qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
  join customer on o_custkey = c_custkey where c_acctbal > 5000
""")
view("curated_sql", """
  select 'curated:' || place || ':' || office_type || ':' || person || ':' || strftime("start", '%Y-%m-%d') as external_id, place, office_type, person,
         "start", case when office_type = 'chief_minister' then 'C' end as party, case when extra then 'additional charge' else '' end as advisory
  from curated_rows
""")


@query("B7_curated_terms", """
  select external_id, place, office_type, person, strftime("start", '%Y-%m-%d') as "start", party, advisory from curated_sql
""")
def b7(t: Tables) -> DataFrame:
    rows = T.curated_terms(curated(t), positions(t))
    return rows.select("external_id", "place", "office_type", "person", "start", "party", F.array_join("advisories", "; ").alias("advisory"))


view("terms_merged", """
  select external_id, place, office_type, person, person_name, "start", "end", party, reviewed, notes, advisory, 'statement' as source_type
  from terms_decided d where not exists (select 1 from curated_sql c where c.place = d.place and c.office_type = d.office_type
    and c.person = d.person and abs(c."start" - d."start") <= 15)
  union all select external_id, place, office_type, person, 'Curated Person', "start", null, party, true, [], advisory, 'curated' from curated_sql
""")


def merged(t: Tables) -> DataFrame:
    decided = T.apply_overrides(built(t).select(*_KEEP), overrides(t))
    return T.merge_curated(decided, T.curated_terms(curated(t), positions(t)).select(*_KEEP))


@query("B8_merge_curated", "select external_id, source_type from terms_merged")
def b8(t: Tables) -> DataFrame:
    return merged(t).select("external_id", "source_type")


def incumbents(t: Tables) -> DataFrame:
    """A second list: who holds each nation's offices, one clerk per segment."""
    office = F.create_map(*[F.lit(x) for pair in _OFFICES.items() for x in pair])[F.col("c_mktsegment")]
    person = F.when(F.col("c_nationkey") < 12, "Q2").otherwise("Q9")
    return t.customer.select(
        F.concat(F.lit("nation-"), F.lower(B.letter(F.col("c_nationkey")))).alias("place"), office.alias("office_type"),
        person.alias("person"), F.concat(F.lit("Listed "), person).alias("person_name"),
    ).distinct()


view("incumbent_rows", """
  select distinct 'nation-' || lower(chr(65 + c_nationkey)) as place, case c_mktsegment """ + " ".join(
    f"when '{k}' then '{v}'" for k, v in _OFFICES.items()
) + """ end as office_type, case when c_nationkey < 12 then 'Q2' else 'Q9' end as person from customer
""")
view("terms_checked", f"""
  select m.* exclude (notes, advisory),
    case when ok then list_filter(notes, lambda n: not (n like '%possibly out of date')) else notes end as notes,
    case when not ok then advisory when advisory = '' then 'confirmed current on {B.TODAY}' else advisory || '; confirmed current on {B.TODAY}' end as advisory,
    case when "end" is null and listed is not null and not office_ok then ['the second list names Listed ' || listed || ' (' || listed || ') as current'] else [] end as conflicts
  from (select m.*, i.person as listed, coalesce(m."end" is null and i.person = m.person, false) as ok,
      coalesce(bool_or(m."end" is null and i.person = m.person) over (partition by m.place, m.office_type), false) as office_ok
    from terms_merged m left join incumbent_rows i using (place, office_type)) m
""")


@query("B9_cross_check", """
  select external_id, array_to_string(notes, '; ') as notes, array_to_string(conflicts, '; ') as conflicts, advisory from terms_checked
""")
def b9(t: Tables) -> DataFrame:
    rows = T.cross_check(materialize(merged(t), "merged"), incumbents(t), B.TODAY)
    return rows.select(
        "external_id", F.array_join("notes", "; ").alias("notes"), F.array_join("conflicts", "; ").alias("conflicts"),
        F.array_join("advisories", "; ").alias("advisory"),
    )


@query("B9_refused_list", """
  select 'the second list has ' || count(*) || ' rows, at least 30 are needed: not used' as problem, count(*) as listed from region having count(*) < 30
""")
def b9_refused(t: Tables) -> DataFrame:
    """Regions as a second list: too few for it to be used."""
    listed = t.region.select(F.col("r_name").alias("place"), F.lit("governor").alias("office_type"), F.lit("Q2").alias("person"))
    return T.refused_list(listed)


view("terms_flagged", f"""
  select * exclude (notes), notes
    || case when n_start < coalesce("end", date '{B.TODAY}') - 2 then ['overlaps with ' || n_name || ' (from ' || strftime(n_start, '%Y-%m-%d') || ')'] else [] end
    || case when "start" < coalesce(p_end, date '{B.TODAY}') - 2 and p_start is not null
        then ['overlaps with ' || p_name || ' (until ' || coalesce(strftime(p_end, '%Y-%m-%d'), 'now') || ')'] else [] end as notes
  from (select *, lead("start") over w as n_start, lead(person_name) over w as n_name, lag("start") over w as p_start,
          lag("end") over w as p_end, lag(person_name) over w as p_name
        from terms_checked window w as (partition by place, office_type order by "start", external_id))
""")


def synced(t: Tables) -> DataFrame:
    return T.sync_terms(
        T.group_statements(statements(t)), members(t), positions(t), B.places(t), overrides(t), curated(t), incumbents(t),
        B.TODAY, EARLIEST,
    )


@query("N20_flag_overlaps", "select external_id, array_to_string(notes, '; ') as notes from terms_flagged")
def n20(t: Tables) -> DataFrame:
    checked = materialize(T.cross_check(materialize(merged(t), "merged"), incumbents(t), B.TODAY), "terms")
    return T.flag_overlaps(checked, B.TODAY).select("external_id", F.array_join("notes", "; ").alias("notes"))


@query("B11_B15_sync_terms", """
  select external_id, place, office_type, person, strftime("start", '%Y-%m-%d') as "start", strftime("end", '%Y-%m-%d') as "end", party,
         len(conflicts) > 0 or (len(notes) > 0 and not reviewed) as needs_review,
         nullif(array_to_string(conflicts || notes || case when advisory = '' then [] else [advisory] end, '; '), '') as review_note
  from terms_flagged
""")
def b15(t: Tables) -> DataFrame:
    rows = synced(t)
    return rows.select("external_id", "place", "office_type", "person", "start", "end", "party", "needs_review", "review_note")


view("terms_final", """
  select external_id, person, "start"::date as "start", "end"::date as "end", party, len(conflicts) > 0 or (len(notes) > 0 and not reviewed) as needs_review
  from terms_flagged
""")


@query("B15_terms_fingerprint", fingerprint_sql("terms_final", ["external_id", "person", '"start"', '"end"', "party", "needs_review"]))
def b15_fingerprint(t: Tables) -> DataFrame:
    return T.terms_fingerprint(synced(t))


@query("J17_holders_during", """
  select b.place, office_type, cast(y as varchar) as period_label, count(*) as holders, min(external_id) as first_id
  from terms_built b, (select unnest(range(1995, 2002)) as y)
  where "start" <= make_date(y::int, 12, 31) and coalesce("end", date '9999-12-31') >= make_date(y::int, 1, 1) group by 1, 2, 3
""")
def j17(t: Tables) -> DataFrame:
    raw = T.group_statements(statements(t))
    terms = T.build_terms(raw, positions(t), B.places(t), B.TODAY, EARLIEST)
    years = B.places(t).filter("type = 'state'").select(F.col("slug").alias("place"), F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("y"))
    found = T.holders_during(terms, years.select("place", *calendar_year(F.col("y")).columns()))
    return found.groupBy("place", "office_type", "period_label").agg(
        F.count(F.lit(1)).alias("holders"), F.min("external_id").alias("first_id")
    )


@query("B10_follow_redirects", """
  select 'Customer ' || c_custkey as title, c_nationkey in (13, 14) as circular, case when c_nationkey < 3 then 'thing-' || c_nationkey
    when c_nationkey < 8 then 'item-' || c_nationkey when c_nationkey = 12 then 'step-20' when c_nationkey in (13, 14) then null
    when c_nationkey < 16 then 'Nation ' || c_nationkey else 'Customer ' || c_custkey end as final from customer
""")
def b10(t: Tables) -> DataFrame:
    """Customers redirect to their nation (below 16), nations below 8 to an item, items below 3 once more, nation 12
    through twenty more titles, nations 13 and 14 to each other."""
    n = F.col("c_nationkey").cast("string")
    titles = t.customer.select(F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("title"))
    first = t.customer.filter("c_nationkey < 16").select(
        F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("source"), F.concat(F.lit("Nation "), n).alias("target")
    )
    nations = t.nation.selectExpr("n_nationkey as k", "concat('Nation ', n_nationkey) as nation")
    further = [
        nations.filter("k < 8").selectExpr("nation as source", "concat('item-', k) as target"),
        nations.filter("k < 3").selectExpr("concat('item-', k) as source", "concat('thing-', k) as target"),
        nations.filter("k = 12").selectExpr("nation as source", "'step-0' as target"),
        nations.filter("k = 12").selectExpr("explode(sequence(0, 19)) as i").selectExpr("concat('step-', i) as source", "concat('step-', i + 1) as target"),
        nations.filter("k in (13, 14)").selectExpr("nation as source", "concat('Nation ', 27 - k) as target"),
    ]
    hops = first
    for more in further:
        hops = hops.unionByName(more)
    return T.follow_redirects(titles, hops)


@query("B12_office_categories", """
  with o as (select distinct place, office_type from term_offices),
  h as (select distinct place from o where office_type = 'chief_minister')
  select place, office_type, c as category from (
    select place, office_type, unnest(case when office_type = 'chief_minister' or (office_type in ('lieutenant_governor', 'administrator')
      and place not in (select place from h)) then ['crime', 'economy', 'health']
      when office_type = 'lieutenant_governor' and place = 'nation-d' then ['governance', 'crime'] else ['governance'] end) as c from o)
""")
def b12(t: Tables) -> DataFrame:
    offices = positions(t).select("place", "office_type").distinct()
    return T.office_categories(offices, ["crime", "economy", "health"], ["nation-d"])


@query("B13_load_terms", """
  select external_id, case when person in ('Q1', 'Q2') then 'new' else 'old' end as version from terms_built where not (person = 'Q3')
""")
def b13(t: Tables) -> DataFrame:
    """Stored terms of all clerks; a delivery of Q1 and Q2; Q3 vanished, the others are not managed."""
    raw = T.group_statements(statements(t))
    terms = T.build_terms(raw, positions(t), B.places(t), B.TODAY, EARLIEST).select("external_id", "person")
    managed = F.when(F.col("person").isin("Q1", "Q2", "Q3"), "statement").otherwise("observed")
    current = terms.withColumn("source_type", managed).withColumn("version", F.lit("old"))
    incoming = current.filter("person in ('Q1', 'Q2')").withColumn("version", F.lit("new"))
    return T.load_terms(current, incoming, ["statement"]).select("external_id", "version")


@query("B14_observe", """
  with cur as (select c_custkey, c_nationkey, c_mktsegment, c_acctbal from customer where c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE')),
  lst as (select c_custkey, c_nationkey, c_mktsegment, c_acctbal from customer where c_mktsegment in ('MACHINERY', 'FURNITURE', 'HOUSEHOLD')),
  offices as (select distinct c_nationkey from lst)
  select coalesce(c.c_custkey, l.c_custkey) as id, case when c.c_custkey is null then 'opened'
      when l.c_custkey is not null and c.c_acctbal >= 3000 then 'unchanged' when l.c_custkey is not null then 'reopened'
      when c.c_acctbal >= 3000 and o.c_nationkey is not null then 'closed' else 'kept' end as action,
    case when c.c_custkey is null then '2001-08-01' else '1999-01-01' end as "start",
    case when l.c_custkey is null then case when c.c_acctbal >= 3000 and o.c_nationkey is not null then '2001-07-31'
      when c.c_acctbal < 3000 then '2000-01-01' end end as "end"
  from cur c full join lst l using (c_custkey) left join offices o on o.c_nationkey = c.c_nationkey
""")
def b14(t: Tables) -> DataFrame:
    """Customers as office-holders of their nation; names spelled in letters, as ids keep no digits."""
    name = F.concat(F.lit("clerk "), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    rows = t.customer.select(
        F.col("c_nationkey").cast("string").alias("place"), F.lit("dgp").alias("office_type"), name.alias("person_name"), "c_mktsegment", "c_acctbal"
    )
    stored = rows.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE"))
    current = stored.select(
        T.observed_id(F.col("place"), F.col("office_type"), F.col("person_name")).alias("external_id"), "place", "office_type", "person_name",
        F.lit(date(1999, 1, 1)).alias("start"), F.when(F.col("c_acctbal") < 3000, F.lit(date(2000, 1, 1))).alias("end"),
        F.lit(date(1999, 1, 1)).alias("verified"), F.lit(None).cast("string").alias("note"),
    )
    listed = rows.filter(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE", "HOUSEHOLD")).select(
        "place", "office_type", "person_name", F.lit("listed").alias("note")
    )
    T.assert_enough(listed, 10)
    out = T.observe(current, listed, B.TODAY)
    number = F.translate(F.substring_index("external_id", "-", -1), "abcdefghij", "0123456789").cast("bigint")
    return out.select(number.alias("id"), "action", "start", "end")


# How a cell writes a person, by order key: each form needs a rule of its own. The name, then acting, then additional charge.
_CELLS = [
    ("[[%]] (acting)<ref>page 1</ref>", "%", True, False), ("[[page|%]], IAS (additional charge)", "%", False, True),
    ('%<br />, IPS<ref name="x" />', "%", False, False), ("\'\'\'Shri %\'\'\', Indian Police Service", "%", False, False),
    ("align=center|% (in-charge)", "%", True, False), ("{{sort|x}}Dr. %, IAS.", "%", False, False),
    ("% (born 1960)", "% (born 1960)", False, False), ("\'\'Smt %\'\' (In charge), Indian Administrative Service", "%", True, False),
    ("%, IAS and others", "% and others", False, False), ("<small>%</small>,", "%", False, False),
]


@query("X16_clean_names", f"""
  select o_orderkey, replace(case (o_orderkey % {len(_CELLS)})::int {" ".join(f"when {i} then '{c[1]}'" for i, c in enumerate(_CELLS))} end, '%',
      'Clerk ' || chr(65 + (o_custkey % 26)::int)) as name,
    (o_orderkey % {len(_CELLS)}) in ({", ".join(str(i) for i, c in enumerate(_CELLS) if c[2])}) as acting,
    (o_orderkey % {len(_CELLS)}) in ({", ".join(str(i) for i, c in enumerate(_CELLS) if c[3])}) as additional
  from orders
""")
def x16(t: Tables) -> DataFrame:
    who = F.concat(F.lit("Clerk "), F.char((F.pmod("o_custkey", F.lit(26)) + 65).cast("bigint")))
    form = F.get(F.array(*[F.lit(c[0]) for c in _CELLS]), F.pmod("o_orderkey", F.lit(len(_CELLS))).cast("int"))
    name, acting, additional = clean_person(F.replace(form, F.lit("%"), who))
    return t.orders.select("o_orderkey", name.alias("name"), acting.alias("acting"), additional.alias("additional"))


# --- Runs and health ---------------------------------------------------------------------------

_STATUS = {"click": "loaded", "view": "unchanged", "error": "failed", "purchase": "rejected", "signup": "running"}


def runs(t: Tables) -> DataFrame:
    status = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])[F.col("event_type")]
    return t.events.select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("dataset_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("bigint").alias("rows_loaded"),
        F.when(F.col("event_type").isin("error", "purchase"), F.concat(F.lit("code "), F.get_json_object("props", "$.k"))).alias("error"),
    )


def datasets(t: Tables) -> DataFrame:
    """Datasets with a cadence by number range; one that never ran, and a paused range."""
    ids = t.events.groupBy(F.col("user_id").alias("dataset_id")).agg(
        F.max(F.when(F.col("event_type") == "click", F.col("ts").cast("timestamp"))).alias("last_changed_at")
    )
    n = F.col("dataset_id")
    cadence = (
        F.when(n < 30, "hourly").when(n < 60, "daily").when(n < 90, "weekly").when(n < 120, "monthly").otherwise("irregular")
    )
    never = t.events.agg((F.max("user_id") + 1).alias("dataset_id"))
    return ids.unionByName(never, allowMissingColumns=True).select(
        "dataset_id", F.concat(F.lit("Dataset "), n.cast("string")).alias("title"), cadence.alias("cadence"),
        F.when(n.between(50, 55), "paused").otherwise("active").alias("status"), "last_changed_at",
    )


view("run_rows", """
  select event_id as run_id, user_id as dataset_id, ts as started_at, case event_type when 'click' then 'loaded' when 'view' then 'unchanged'
    when 'error' then 'failed' when 'purchase' then 'rejected' else 'running' end as status,
    case when event_type in ('error', 'purchase') then 'code ' || json_extract_string(props, '$.k') end as error from events
""")
view("dataset_rows", """
  select dataset_id, 'Dataset ' || dataset_id as title, case when dataset_id < 30 then 'hourly' when dataset_id < 60 then 'daily' when dataset_id < 90 then 'weekly'
    when dataset_id < 120 then 'monthly' else 'irregular' end as cadence, case when dataset_id between 50 and 55 then 'paused' else 'active' end as status,
    changed from (select user_id as dataset_id, max(ts) filter (where event_type = 'click') as changed from events group by 1
                  union all select max(user_id) + 1, null from events)
""")
view("run_states", """
  select d.*, l.run_id, l.status as run_status, l.started_at as run_started, l.error as run_error,
    (select min(f.started_at) from run_rows f where f.dataset_id = d.dataset_id and f.status in ('failed', 'rejected', 'running')
      and f.run_id > coalesce((select max(k.run_id) from run_rows k where k.dataset_id = d.dataset_id and k.status in ('loaded', 'unchanged')), -1)) as failing_since
  from dataset_rows d left join (select * from run_rows qualify row_number() over (partition by dataset_id order by run_id desc) = 1) l using (dataset_id)
""")


@query("J20_run_state", """
  select dataset_id, run_id, run_status, strftime(run_started, '%Y-%m-%d %H:%M:%S') as run_started,
         strftime(failing_since, '%Y-%m-%d %H:%M:%S') as failing_since from run_states
""")
def j20(t: Tables) -> DataFrame:
    return H.run_state(datasets(t), runs(t)).select("dataset_id", "run_id", "run_status", "run_started", "failing_since")


view("health_rows", f"""
  with s as (select *, run_status in ('failed', 'rejected') or (run_status = 'running' and run_started < timestamp '{NOW}' - interval 2 hour) as failing,
      case cadence when 'hourly' then 1 when 'daily' then 2 when 'weekly' then 7 when 'monthly' then 30 end as days
    from run_states where status <> 'paused'),
  k as (select *, case when failing then 'failing' when run_status is null then 'unknown'
      when days is not null and (changed is null or changed < timestamp '{NOW}' - days * interval 36 hour) then 'stale' else 'ok' end as kind from s)
  select dataset_id, title, kind, case kind when 'failing' then strftime(coalesce(failing_since, run_started), '%Y-%m-%d')
      when 'stale' then strftime(changed, '%Y-%m-%d') end as since,
    case when kind = 'failing' and run_status = 'rejected' then 'Rejected by validation: ' || run_error
      when kind = 'failing' and run_status = 'running' then 'The run stopped without recording a result.' when kind = 'failing' then run_error
      when kind = 'stale' and changed is null then 'No data has been loaded from this source yet.'
      when kind = 'stale' then 'No new data since ' || strftime(changed, '%Y-%m-%d') || '; it usually releases ' || cadence end as detail
  from k
""")


@query("H5_health", "select * from health_rows")
def h5(t: Tables) -> DataFrame:
    return H.health(datasets(t), runs(t), NOW)


@query("S15_source_listing", """
  select d.dataset_id, cadence, coalesce(kind, 'ok') as state, since from dataset_rows d left join health_rows h using (dataset_id)
""")
def s15(t: Tables) -> DataFrame:
    rows = E.source_listing(datasets(t), H.health(datasets(t), runs(t), NOW))
    return rows.select("dataset_id", "cadence", "state", "since")


def open_alerts(t: Tables) -> DataFrame:
    """Every dataset below 40 has an open alert for failing; one alert is about something else."""
    rows = t.events.filter("user_id < 40").select(
        F.col("user_id").alias("number"), F.concat(F.lit("Data source failing: "), F.col("user_id").cast("string")).alias("title")
    ).distinct()
    other = t.events.agg(F.lit(-1).cast("bigint").alias("number"), F.concat(F.lit("Something else "), F.max("user_id").cast("string")).alias("title"))
    return rows.unionByName(other)


@query("H6_alert_diff", """
  with w as (select 'Data source ' || kind || ': ' || dataset_id as title, detail from health_rows where kind in ('failing', 'stale')),
  a as (select distinct user_id as number, 'Data source failing: ' || user_id as title from events where user_id < 40)
  select coalesce(w.title, a.title) as title, number, case when number is null then 'open' when w.title is not null then 'update' else 'close' end as action, detail
  from w full join a on w.title = a.title
""")
def h6(t: Tables) -> DataFrame:
    return H.alert_diff(H.health(datasets(t), runs(t), NOW), open_alerts(t), datasets(t))


@query("H1_start_run", f"""
  select run_id, dataset_id, case when dataset_id < 70 and status = 'running' and started_at < timestamp '{NOW}' - interval 2 hour then 'failed' else status end as status,
    case when dataset_id < 70 and status = 'running' and started_at < timestamp '{NOW}' - interval 2 hour then '{H.ABANDONED}' else error end as error
  from run_rows union all select distinct 1000000000 + dataset_id, dataset_id, 'running', null from run_rows where dataset_id < 70
""")
def h1(t: Tables) -> DataFrame:
    starting = runs(t).filter("dataset_id < 70").select((F.col("dataset_id") + 1_000_000_000).alias("run_id"), "dataset_id").distinct()
    return H.start_run(runs(t), starting, NOW).select("run_id", "dataset_id", "status", "error")


@query("H2_finish_run", f"""
  select run_id, case when status = 'running' then 'loaded' else status end as status, case when status = 'running' then run_id * 2 end as rows_loaded,
         case when status = 'running' then null else error end as error, case when status = 'running' then '{NOW:%Y-%m-%d %H:%M:%S}' end as finished_at
  from run_rows
""")
def h2(t: Tables) -> DataFrame:
    running = runs(t).filter("status = 'running'")
    results = running.select("run_id", F.lit("loaded").alias("status"), (F.col("run_id") * 2).alias("rows_loaded"), F.lit(None).cast("string").alias("error"))
    return H.finish_run(runs(t), results, NOW).select("run_id", "status", "rows_loaded", "error", "finished_at")


@query("H3_mark_checked", f"""
  select dataset_id, case when dataset_id < 100 then '{NOW:%Y-%m-%d %H:%M:%S}' end as last_checked_at, case when dataset_id < 100 then 'f' || dataset_id else 'old' end as last_fingerprint,
         case when dataset_id < 50 then '{NOW:%Y-%m-%d %H:%M:%S}' else strftime(changed, '%Y-%m-%d %H:%M:%S') end as last_changed_at from dataset_rows
""")
def h3(t: Tables) -> DataFrame:
    table = datasets(t).select(
        "dataset_id", F.lit(None).cast("timestamp").alias("last_checked_at"), F.lit("old").alias("last_fingerprint"), "last_changed_at"
    )
    checks = datasets(t).filter("dataset_id < 100").select(
        "dataset_id", F.concat(F.lit("f"), F.col("dataset_id").cast("string")).alias("fingerprint"), (F.col("dataset_id") < 50).alias("changed")
    )
    return H.mark_checked(table, checks, NOW)


@query("H4_load_decision", """
  select dataset_id, case when dataset_id < 20 then 'unchanged' when n_error > 40 then 'failed' when n_bad > 15 then 'rejected'
    when dataset_id < 60 then 'unchanged' else 'loaded' end as decision
  from (select user_id as dataset_id, count(*) filter (where event_type = 'error') as n_error, count(*) filter (where event_type = 'purchase') as n_bad
        from events group by 1)
""")
def h4(t: Tables) -> DataFrame:
    counts = t.events.groupBy(F.col("user_id").alias("dataset_id")).agg(
        F.count_if(F.col("event_type") == "error").alias("n_error"), F.count_if(F.col("event_type") == "purchase").alias("n_bad")
    )
    n = F.col("dataset_id")
    batches = counts.select(
        n, F.when(n < 20, "same").otherwise("moved").alias("probe"), F.when(n < 60, "same").otherwise("new").alias("fingerprint"),
        F.when(F.col("n_bad") > 15, F.col("n_bad")).otherwise(0).alias("hard_problems"), F.when(F.col("n_error") > 40, "boom").alias("error"),
    )
    table = counts.select("dataset_id", F.lit("same").alias("last_fingerprint"))
    return H.load_decision(batches, table).select("dataset_id", "decision")
