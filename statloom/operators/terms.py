"""Office-holder terms: interval data built, checked, merged and joined to data periods."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.operators.derive import first_wins
from statloom.operators.skew import neighbours
from statloom.operators.vintage import fingerprint
from statloom.session import materialize
from statloom.sources.exports import upsert

# Fixed values of the method.
STALE_DAYS = round(365.25 * 5.5)
OVERLAP_DAYS = 2
TWIN_DAYS = 15
MIN_INCUMBENTS = 30
MIN_OBSERVED = 50
POLITICAL = ("chief_minister", "deputy_chief_minister")
HEAD = ("chief_minister",)
NO_NAME = "no English name in the source"
STALE = "possibly out of date"
NOTES = "array<string>"


def _empty() -> Column:
    return F.array().cast(NOTES)


def _with(notes: Column, condition: Column, text: Column | str) -> Column:
    """The notes, and one more where the condition holds."""
    text = F.lit(text) if isinstance(text, str) else text
    return F.when(condition, F.concat(notes, F.array(text))).otherwise(notes)


def group_statements(rows: DataFrame) -> DataFrame:
    """One row per statement with the parties named on it (a statement has few qualifiers)."""
    party = F.when(F.col("party").isNotNull(), F.struct("party", F.coalesce("party_label", "party").alias("label")))
    first = [F.min(c).alias(c) for c in ("position", "person", "person_name", "start", "end")]
    return rows.groupBy("statement_id").agg(*first, F.array_sort(F.collect_set(party)).alias("parties"))


def memberships(rows: DataFrame) -> DataFrame:
    kept = rows.select("person", "party", F.coalesce("party_label", "party").alias("label"), "start", "end").distinct()
    return kept.orderBy("person", "party", F.col("start").asc_nulls_first())


def _dated(raw: DataFrame, earliest: date) -> DataFrame:
    """Statements without their duplicates and those that ended before the time covered."""
    unique = first_wins(raw, ["position", "person", "start", "end"], ["statement_id"])
    return unique.filter(F.col("end").isNull() | (F.col("end") >= F.lit(earliest)))


def undated_problems(raw: DataFrame, earliest: date) -> DataFrame:
    return _dated(raw, earliest).filter("start is null").select(
        F.concat("person_name", F.lit(" ("), "person", F.lit("): term has no start date; skipped")).alias("problem")
    )


def build_terms(raw: DataFrame, positions: DataFrame, places: DataFrame, today: date, earliest: date) -> DataFrame:
    """Terms clipped to the validity of every place that shares the position.

    `positions`: position, place, office_type, title. A term that lies fully outside a place's
    validity belongs to the other place of that position and is left out.
    """
    validity = places.select(F.col("slug").alias("place"), "valid_from", "valid_to")
    offices = positions.join(validity, "place")
    start, end = F.col("start"), F.col("end")
    since, until = F.col("valid_from"), F.col("valid_to")
    inside = F.coalesce(F.coalesce(end, F.lit(today)) >= since, F.lit(True)) & F.coalesce(start <= until, F.lit(True))
    joined = _dated(raw, earliest).filter("start is not null").join(offices, "position").filter(inside)
    clipped = F.when(until.isNotNull() & (end.isNull() | (end > until)), until).otherwise(end)
    return joined.select(
        F.concat_ws(":", "statement_id", "place").alias("external_id"), "place", "office_type", "title", "person",
        "person_name", start.alias("raw_start"), end.alias("raw_end"), F.greatest(start, since).alias("start"),
        clipped.alias("end"), "parties", F.lit("statement").alias("source_type"), F.lit(None).cast("string").alias("source_url"),
        F.lit(False).alias("reviewed"),
    )


def resolve_party(terms: DataFrame, members: DataFrame) -> DataFrame:
    """Adds `party` and an advisory: the statement's party and the membership at the term's start
    must agree on exactly one. Only political offices carry a party.

    Memberships are looked up once per distinct (person, start).
    """
    political = F.col("office_type").isin(*POLITICAL)
    asked = terms.filter(political).select("person", "raw_start").distinct()
    open_from = F.coalesce(F.col("m.start") <= F.col("raw_start"), F.lit(True))
    open_to = F.coalesce(F.col("m.end") >= F.col("raw_start"), F.lit(True))
    at_start = (
        asked.alias("a").join(members.alias("m"), (F.col("a.person") == F.col("m.person")) & open_from & open_to)
        .groupBy(F.col("a.person").alias("person"), "raw_start")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("m.party").alias("party"), F.col("m.label").alias("label")))).alias("_m"))
    )
    joined = terms.join(at_start, ["person", "raw_start"], "left")
    groups = F.coalesce(F.col("parties"), F.array().cast("array<struct<party:string,label:string>>"))
    known = F.coalesce(F.col("_m"), F.array().cast("array<struct<party:string,label:string>>"))
    agreed = F.filter(groups, lambda g: F.exists(known, lambda m: m["party"] == g["party"]))
    both = (F.size(groups) > 0) & (F.size(known) > 0)
    candidates = F.when(F.size(groups) > 0, groups).otherwise(known)
    pick = F.when(both, agreed).otherwise(candidates)
    one = F.size(pick) == 1
    reason = (
        F.when(one, None).when(both, "party sources disagree").when(F.size(candidates) == 0, "no party recorded")
        .otherwise(F.concat(F.lit("several possible parties: "), F.array_join(F.transform(candidates, lambda c: c["label"]), ", ")))
    )
    return joined.select(
        *terms.columns,
        F.when(political & one, pick[0]["party"]).alias("party"),
        F.when(political & one, pick[0]["label"]).alias("party_label"),
        F.when(political & reason.isNotNull(), F.array(reason)).otherwise(_empty()).alias("advisories"),
    )


def term_notes(terms: DataFrame, today: date) -> DataFrame:
    """Adds `notes` (bad dates, missing name, stale incumbent) and empty `conflicts`."""
    age = F.datediff(F.lit(today), F.col("start"))
    stale = F.concat(F.lit("in office since "), F.col("start").cast("string"), F.lit(f" with no end date; {STALE}"))
    notes = F.array_compact(
        F.array(
            F.when(F.col("raw_end") < F.col("raw_start"), "term ends before it starts"),
            F.when(F.col("person_name") == F.col("person"), NO_NAME),
            F.when(F.col("end").isNull() & (age > STALE_DAYS), stale),
        )
    )
    return terms.withColumn("notes", notes).withColumn("conflicts", _empty())


def unused_overrides(terms: DataFrame, overrides: DataFrame) -> DataFrame:
    return overrides.select("external_id").join(terms.select("external_id"), "external_id", "left_anti")


def apply_overrides(terms: DataFrame, overrides: DataFrame) -> DataFrame:
    """Maintainers' decisions by external id. Every override must name its source.

    `overrides`: external_id, party, party_label, person_name, start, end, source_url, reviewed, note.
    """
    if not overrides.filter("source_url is null").isEmpty():
        raise ValueError("every override needs a source_url")
    o = overrides.select("external_id", *[F.col(c).alias(f"_{c}") for c in overrides.columns if c != "external_id"])
    joined = terms.join(o, "external_id", "left").withColumn("_hit", F.col("_source_url").isNotNull())
    end = F.coalesce("_end", "end")
    notes = F.when(
        F.col("_person_name").isNotNull(), F.filter("notes", lambda n: n != NO_NAME)
    ).otherwise(F.col("notes"))
    notes = F.when(F.col("_hit") & end.isNotNull(), F.filter(notes, lambda n: ~n.endswith(STALE))).otherwise(notes)
    advisories = F.when(
        F.col("_party").isNotNull(), F.filter("advisories", lambda a: ~a.contains("part"))
    ).otherwise(F.col("advisories"))
    advisories = _with(advisories, F.col("_note").isNotNull(), F.concat(F.lit("maintainer: "), F.col("_note")))
    changed = {
        "party": F.coalesce("_party", "party"),
        "party_label": F.when(F.col("_party").isNotNull(), F.coalesce("_party_label", "party_label")).otherwise(F.col("party_label")),
        "person_name": F.coalesce("_person_name", "person_name"),
        "start": F.coalesce("_start", "start"), "end": end, "notes": notes, "advisories": advisories,
        "source_url": F.coalesce("_source_url", "source_url"),
        "reviewed": F.when(F.col("_hit"), F.coalesce("_reviewed", F.lit(False))).otherwise(F.col("reviewed")),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in terms.columns])


def curated_problems(entries: DataFrame, positions: DataFrame) -> DataFrame:
    """Curated entries of an unknown office or without a required field."""
    offices = positions.select("place", "office_type").distinct().withColumn("_known", F.lit(True))
    rule = F.when(F.col("_known").isNull(), "unknown office")
    for c in ("person_name", "person", "start", "source_url"):
        rule = rule.when(F.col(c).isNull(), f"missing {c}")
    return entries.join(offices, ["place", "office_type"], "left").withColumn("rule", rule).filter("rule is not null").select(
        "place", "office_type", "person", "rule"
    )


def curated_terms(entries: DataFrame, positions: DataFrame) -> DataFrame:
    """Officially sourced terms the statements lack; refuses the list when one entry is not sound."""
    if not curated_problems(entries, positions).isEmpty():
        raise ValueError("curated terms name unknown offices or lack required fields")
    titles = positions.groupBy("place", "office_type").agg(F.min("title").alias("title"))
    joined = entries.join(titles, ["place", "office_type"])
    political = F.col("office_type").isin(*POLITICAL)
    advisories = _with(_empty(), F.coalesce("additional_charge", F.lit(False)), "additional charge")
    return joined.select(
        F.concat_ws(":", F.lit("curated"), "place", "office_type", "person", F.col("start").cast("string")).alias("external_id"),
        "place", "office_type", "title", "person", "person_name", "start", "end",
        F.when(political, F.col("party")).alias("party"), F.when(political, F.col("party_label")).alias("party_label"),
        "source_url", F.lit("curated").alias("source_type"), F.lit(True).alias("reviewed"), advisories.alias("advisories"),
        _empty().alias("notes"), _empty().alias("conflicts"),
    )


def _twin(a: str, b: str) -> Column:
    same = [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in ("place", "office_type", "person")]
    near = F.abs(F.datediff(F.col(f"{a}.start"), F.col(f"{b}.start"))) <= TWIN_DAYS
    return same[0] & same[1] & same[2] & near


def merge_curated(terms: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated terms win over twins: same office and person, started within 15 days."""
    kept = terms.alias("t").join(curated.alias("c"), _twin("t", "c"), "left_anti")
    return kept.unionByName(curated, allowMissingColumns=True)


def retired_curated(terms: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated terms that the statements have caught up with."""
    return curated.alias("c").join(terms.alias("t"), _twin("t", "c"), "left_semi").select("external_id")


def refused_list(incumbents: DataFrame, minimum: int = MIN_INCUMBENTS) -> DataFrame:
    """One problem row where the second list is too short for cross_check to use; none otherwise."""
    size = incumbents.agg(F.count(F.lit(1)).alias("listed")).filter(F.col("listed") < minimum)
    text = F.concat(F.lit("the second list has "), F.col("listed").cast("string"), F.lit(f" rows, at least {minimum} are needed: not used"))
    return size.select(text.alias("problem"), "listed")


def cross_check(terms: DataFrame, incumbents: DataFrame, today: date, minimum: int = MIN_INCUMBENTS) -> DataFrame:
    """Confirms or contradicts the open terms with a second list of incumbents.

    `incumbents`: place, office_type, person, person_name. Agreement clears the stale note; where no
    open term is the listed person's, every open term of the office gets a conflict. A list of fewer
    than `minimum` rows is not used at all; refused_list says so. Reads `terms` twice.
    """
    office = ["place", "office_type"]
    current = terms.filter("end is null").select(*office, "person").distinct()
    size = incumbents.agg(F.count(F.lit(1))).scalar()
    seen = incumbents.filter(size >= minimum).alias("i").join(
        current.withColumn("_same", F.lit(True)).alias("t"), [*office, "person"], "left"
    ).select(*office, "person", "person_name", F.coalesce("_same", F.lit(False)).alias("_same"))
    confirmed = seen.filter("_same").select(*office, "person").distinct().withColumn("_ok", F.lit(True))
    message = F.concat(F.lit("the second list names "), "person_name", F.lit(" ("), "person", F.lit(") as current"))
    # An office has one incumbent, at most a few, in a list of incumbents.
    against = seen.filter("not _same").groupBy(*office).agg(F.array_sort(F.collect_set(message)).alias("_against"))
    joined = terms.join(confirmed, [*office, "person"], "left").join(against, office, "left")
    is_open = F.col("end").isNull()
    ok = is_open & F.coalesce("_ok", F.lit(False))
    changed = {
        "notes": F.when(ok, F.filter("notes", lambda n: ~n.endswith(STALE))).otherwise(F.col("notes")),
        "advisories": _with(F.col("advisories"), ok, f"confirmed current on {today}"),
        "conflicts": F.when(is_open & F.col("_against").isNotNull(), F.concat("conflicts", "_against")).otherwise(F.col("conflicts")),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in terms.columns])


def flag_overlaps(terms: DataFrame, today: date) -> DataFrame:
    """Notes on adjacent terms of an office that overlap by more than two days.

    An office may hold a third of all terms: neighbours are found within the month of the start,
    and across months through the first and last term of each month.
    """
    order = ["start", "external_id"]
    month = F.trunc("start", "month")
    payload = ["start", "end", "person_name"]
    rows = neighbours(terms, ["place", "office_type"], order, month, payload)
    now = F.lit(today)

    def clashes(earlier_end: Column, later_start: Column) -> Column:
        return F.coalesce(later_start < F.date_sub(F.coalesce(earlier_end, now), OVERLAP_DAYS), F.lit(False))

    after = F.concat(
        F.lit("overlaps with "), F.col("following.person_name"), F.lit(" (from "), F.col("following.start").cast("string"), F.lit(")")
    )
    before = F.concat(
        F.lit("overlaps with "), F.col("previous.person_name"), F.lit(" (until "),
        F.coalesce(F.col("previous.end").cast("string"), F.lit("now")), F.lit(")"),
    )
    notes = _with(F.col("notes"), F.col("following").isNotNull() & clashes(F.col("end"), F.col("following.start")), after)
    notes = _with(notes, F.col("previous").isNotNull() & clashes(F.col("previous.end"), F.col("start")), before)
    return rows.select(*[notes.alias("notes") if c == "notes" else F.col(c) for c in terms.columns])


def with_review(terms: DataFrame) -> DataFrame:
    """Adds needs_review (conflicts, or notes nobody reviewed) and the joined review note."""
    needs = (F.size("conflicts") > 0) | ((F.size("notes") > 0) & ~F.col("reviewed"))
    text = F.array_join(F.concat("conflicts", "notes", "advisories"), "; ")
    return terms.withColumn("needs_review", needs).withColumn("review_note", F.when(text != "", text))


def follow_redirects(titles: DataFrame, hops: DataFrame) -> DataFrame:
    """`final` title of each title, however many redirects lead there.

    Pointers double: each round replaces a source's target by its target's target, so a chain of n
    hops needs log2(n) rounds of one join on the hops that are still open. A title that runs into a cycle
    keeps `circular` and a null `final`. A source with two targets takes the smaller one.
    """
    one = hops.filter("source is not null and target is not null").groupBy("source").agg(F.min("target").alias("target"))
    ends = one.join(one.select(F.col("source").alias("target")), "target", "left_anti").select("source", "target")
    # What is not settled yet leads to another source.
    settled, open_ = materialize(ends, "ends"), materialize(one.join(ends, "source", "left_anti"), "open")
    left, before = open_.count(), 0
    # Each round settles the sources up to twice as far from their end; where none is settled, all that is left goes in circles.
    while left and left != before:
        done = settled.select(F.col("source").alias("target"), F.col("target").alias("_end"))
        further = open_.select(F.col("source").alias("target"), F.col("target").alias("_next"))
        step = open_.join(done, "target", "left").join(further, "target", "left")
        moved = materialize(step.select("source", F.coalesce("_end", "_next").alias("target"), F.col("_end").isNotNull().alias("_done")), "hops")
        settled = settled.unionByName(moved.filter("_done").select("source", "target"))
        open_ = moved.filter("not _done").select("source", "target")
        left, before = open_.count(), left
    answer = settled.withColumn("_circular", F.lit(False)).unionByName(open_.withColumn("_circular", F.lit(True)))
    found = titles.join(answer.withColumnRenamed("source", "title"), "title", "left")
    circular = F.coalesce("_circular", F.lit(False))
    return found.select(
        *titles.columns, F.when(~circular, F.coalesce("target", "title")).alias("final"), circular.alias("circular")
    )


def office_categories(offices: DataFrame, ranked: Sequence[str], police_places: Sequence[str] = ()) -> DataFrame:
    """Topics an office answers for. `offices`: place, office_type.

    A head of government answers for all; so does a governor or administrator of a place without
    one; the rest answer for governance (and crime, where the police is theirs).
    """
    heads = offices.filter(F.col("office_type").isin(*HEAD)).select("place").distinct().withColumn("_head", F.lit(True))
    kind = F.col("office_type")
    everything = kind.isin(*HEAD) | (kind.isin("lieutenant_governor", "administrator") & F.col("_head").isNull())
    police = (kind == "lieutenant_governor") & F.col("place").isin(list(police_places))
    topics = (
        F.when(everything, F.array(*[F.lit(r) for r in ranked]))
        .when(police, F.array(F.lit("governance"), F.lit("crime")))
        .otherwise(F.array(F.lit("governance")))
    )
    rows = offices.join(heads, "place", "left").withColumn("category", F.explode(topics))
    return rows.select("place", "office_type", "category")


def load_terms(current: DataFrame, incoming: DataFrame, managed: Sequence[str]) -> DataFrame:
    """Upsert by external id; terms of managed sources that are no longer delivered are deleted."""
    gone = current.filter(F.col("source_type").isin(list(managed))).join(incoming.select("external_id"), "external_id", "left_anti")
    kept = current.join(gone.select("external_id"), "external_id", "left_anti")
    return upsert(kept, incoming, ["external_id"])


def assert_enough(listed: DataFrame, minimum: int = MIN_OBSERVED) -> None:
    """Never close terms on the strength of a partial list."""
    if listed.limit(minimum).count() < minimum:
        raise ValueError(f"fewer than {minimum} office-holders observed; refusing to update terms")


def observed_id(place: Column, office_type: Column, name: Column) -> Column:
    slug = F.trim(F.regexp_replace(F.lower(name), "[^a-z]+", "-"), F.lit("-"))
    return F.concat_ws(":", F.lit("observed"), place, office_type, slug)


def observe(current: DataFrame, listed: DataFrame, today: date | Column) -> DataFrame:
    """Terms after a day's list of office-holders, each with what happened to it.

    New person: opened today; listed and open: refreshed; listed and closed: reopened; open, in a
    listed office, but not listed: closed yesterday. `current`: external_id, place, office_type,
    person_name, start, end, verified, note; `listed`: place, office_type, person_name, note.
    """
    day = today if isinstance(today, Column) else F.lit(today)
    keyed = listed.withColumn("external_id", observed_id(F.col("place"), F.col("office_type"), F.col("person_name")))
    keyed = first_wins(keyed.select("external_id", "place", "office_type", "person_name", "note"), ["external_id"], ["person_name"])
    offices = listed.select("place", "office_type").distinct().withColumn("_listed_office", F.lit(True))
    c = current.join(offices, ["place", "office_type"], "left").alias("c")
    joined = c.join(keyed.alias("l"), F.col("c.external_id") == F.col("l.external_id"), "full")
    old, new = F.col("c.external_id").isNotNull(), F.col("l.external_id").isNotNull()
    is_open = old & F.col("c.end").isNull()
    action = (
        F.when(new & ~old, "opened").when(new & is_open, "unchanged").when(new, "reopened")
        .when(is_open & F.coalesce("_listed_office", F.lit(False)), "closed").otherwise("kept")
    )
    rows = joined.withColumn("action", action)
    first_seen = F.concat(F.lit("start date not sourced: first observed in office on "), day.cast("string"))
    closing = F.concat(F.lit("change observed on "), day.cast("string"))
    act = F.col("action")
    return rows.select(
        F.coalesce("c.external_id", "l.external_id").alias("external_id"),
        F.coalesce("c.place", "l.place").alias("place"),
        F.coalesce("c.office_type", "l.office_type").alias("office_type"),
        F.coalesce("c.person_name", "l.person_name").alias("person_name"),
        F.when(act == "opened", day).otherwise(F.col("c.start")).alias("start"),
        F.when(act == "closed", F.date_sub(day, 1)).when(act == "kept", F.col("c.end")).alias("end"),
        F.when(new, day).otherwise(F.col("c.verified")).alias("verified"),
        F.when(act == "unchanged", F.col("l.note"))
        .when(act.isin("opened", "reopened"), F.concat_ws("; ", first_seen, F.col("l.note")))
        .when(act == "closed", F.concat_ws("; ", F.col("c.note"), closing))
        .otherwise(F.col("c.note")).alias("note"),
        "action",
    )


def refused_days(lists: DataFrame, minimum: int) -> DataFrame:
    """Days whose list is too short to close terms on: day, listed, minimum."""
    sizes = lists.groupBy("day").agg(F.count(F.lit(1)).alias("listed"))
    return sizes.filter(F.col("listed") < minimum).withColumn("minimum", F.lit(minimum))


def observe_days(current: DataFrame, lists: DataFrame, minimum: int) -> DataFrame:
    """Terms after the lists of many days, as if `observe` had read them one by one, in one pass.

    `lists`: as `listed` there, with `day`; days of fewer than `minimum` rows are left out (see
    refused_days). The last day a person is listed settles their term: the office's next listed day
    closes it, and it had stayed open if the person was also listed on the office's day before.
    """
    office = ["place", "office_type"]
    trusted = lists.groupBy("day").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= minimum).select("day")
    kept = lists.join(trusted, "day", "left_semi")
    # Both windows hold one row per day.
    by_office, by_person = Window.partitionBy(*office).orderBy("day"), Window.partitionBy("external_id").orderBy("day")
    days = kept.select(*office, "day").distinct().select(
        *office, "day", F.lag("day").over(by_office).alias("_before"), F.lead("day").over(by_office).alias("_next")
    )
    keyed = kept.withColumn("external_id", observed_id(F.col("place"), F.col("office_type"), F.col("person_name")))
    keyed = first_wins(keyed.select("external_id", *office, "person_name", "note", "day"), ["external_id", "day"], ["person_name"])
    marked = keyed.join(days, [*office, "day"]).withColumn("_again", F.lag("day").over(by_person) == F.col("_before"))
    people = marked.groupBy("external_id").agg(
        F.min(F.struct("day", *office, "person_name")).alias("first"),
        F.max(F.struct("day", "_before", "_next", "_again", "note")).alias("last"),
    ).alias("l")
    opening = days.filter("_before is null").select(*office, F.col("day").alias("_opening"))
    joined = current.join(opening, office, "left").alias("c").join(people, F.col("c.external_id") == F.col("l.external_id"), "full")
    old, seen = F.col("c.external_id").isNotNull(), F.col("l.external_id").isNotNull()
    is_open = old & F.col("c.end").isNull()
    stayed = F.when(F.col("last._before").isNull(), is_open).otherwise(F.coalesce(F.col("last._again"), F.lit(False)))
    missed = F.when(seen, F.col("last._next")).when(is_open, F.col("c._opening"))
    first_seen = F.concat(F.lit("start date not sourced: first observed in office on "), F.col("last.day").cast("string"))
    note = (
        F.when(seen & stayed, F.col("last.note")).when(seen, F.concat_ws("; ", first_seen, F.col("last.note"))).otherwise(F.col("c.note"))
    )
    closing = F.concat(F.lit("change observed on "), missed.cast("string"))
    return joined.select(
        F.coalesce("c.external_id", "l.external_id").alias("external_id"),
        F.coalesce("c.place", "first.place").alias("place"),
        F.coalesce("c.office_type", "first.office_type").alias("office_type"),
        F.coalesce("c.person_name", "first.person_name").alias("person_name"),
        F.when(old, F.col("c.start")).otherwise(F.col("first.day")).alias("start"),
        F.when(missed.isNotNull(), F.date_sub(missed, 1)).when(~seen, F.col("c.end")).alias("end"),
        F.when(seen, F.col("last.day")).otherwise(F.col("c.verified")).alias("verified"),
        F.when(missed.isNotNull(), F.concat_ws("; ", note, closing)).otherwise(note).alias("note"),
    )


def observe_counts(observed: DataFrame) -> DataFrame:
    act = F.col("action")
    return observed.agg(
        F.count_if(act.isin("opened", "reopened")).alias("opened"), F.count_if(act == "closed").alias("closed"),
        F.count_if(act == "unchanged").alias("unchanged"),
    )


def holders_during(terms: DataFrame, periods: DataFrame) -> DataFrame:
    """Terms that overlap each period (closed intervals, open end = still in office).

    Both sides are cut into calendar years, so a place with very many terms meets only the periods
    of the same year; a pair is kept in the first year the two share, hence once.
    `periods`: place, period_start, period_end, period_label. Terms under review are left out.
    """
    if "needs_review" in terms.columns:
        terms = terms.filter("not needs_review")
    # An open term reaches to the last period asked about; years before the first period meet none.
    # The two days are read first, one row, so that the plan holds them as values and scans the periods once.
    opening, horizon = (F.lit(day).cast("date") for day in periods.agg(F.min("period_start"), F.max("period_end")).first())
    alive = terms.filter((F.col("start") <= horizon) & (F.col("end").isNull() | (F.col("end") >= opening)))
    last = F.least(F.coalesce(F.col("end"), horizon), horizon)
    first = F.greatest(F.year("start"), F.year(opening))
    years = F.sequence(first, F.greatest(F.year(last), first))
    cut = alive.withColumn("_year", F.explode(years)).alias("t")
    p = periods.withColumn("_year", F.explode(F.sequence(F.year("period_start"), F.year("period_end")))).alias("p")
    overlap = (F.col("t.start") <= F.col("p.period_end")) & F.coalesce(F.col("t.end") >= F.col("p.period_start"), F.lit(True))
    first_shared = F.greatest(F.year("t.start"), F.year("p.period_start")) == F.col("t._year")
    joined = cut.join(
        p, (F.col("t.place") == F.col("p.place")) & (F.col("t._year") == F.col("p._year")) & overlap & first_shared
    )
    return joined.select(
        *[F.col(f"t.{c}").alias(c) for c in terms.columns], F.col("p.period_start"), F.col("p.period_end"), F.col("p.period_label")
    )


def sync_terms(
    raw: DataFrame, members: DataFrame, positions: DataFrame, places: DataFrame, overrides: DataFrame, curated: DataFrame,
    incumbents: DataFrame, today: date, earliest: date,
) -> DataFrame:
    """The whole flow: build, resolve parties, override, merge, cross-check, flag overlaps, review."""
    terms = term_notes(resolve_party(build_terms(raw, positions, places, today, earliest), members), today)
    keep = [
        "external_id", "place", "office_type", "title", "person", "person_name", "start", "end", "party", "party_label",
        "source_url", "source_type", "reviewed", "advisories", "notes", "conflicts",
    ]
    merged = merge_curated(apply_overrides(terms.select(*keep), overrides), curated_terms(curated, positions).select(*keep))
    # The check and the overlaps read their input twice.
    checked = materialize(cross_check(materialize(merged, "merged"), incumbents, today), "terms")
    return with_review(flag_overlaps(checked, today))


def terms_fingerprint(terms: DataFrame) -> DataFrame:
    """Digest that tells whether a sync changed anything."""
    return fingerprint(terms, ["external_id", "person", "start", "end", "party", "needs_review"])
