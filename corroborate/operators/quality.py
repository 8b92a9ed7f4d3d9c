"""What changed between two snapshots of a report, as typed events.

Records are compared by (report_id, id) in one full outer join, with their lists inside: a list entry makes an event if the
earlier list has no entry of its key.  ``record_changes`` reads events off a row with the structs ``before`` and ``after``,
so the same rule serves tables (``record_events``) and the pairs that a stream's keyed state gives out.

Snapshots have report_id, id, damage_name, section, part, location, and the lists overrides (field, original, current,
changed_at), history (at, action), enrichments (field, value, applied_at) and conflicts (field, main, resolved: value,
reason, decided_at).  Lists may be null.  Ids tell the rows of a snapshot apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The category of an edit by its field.
CATEGORY = {
    "section": "SECTION_ERROR", "damage_name": "DAMAGE_NAME_ERROR", "part": "PART_CLASSIFICATION_ERROR", "sub_part": "SUBPART_ERROR",
    "location": "LOCATION_ERROR", "repair_method": "REPAIR_METHOD_ERROR", "quantity": "QUANTITY_ERROR",
}
SNAPSHOT = ["damage_name", "section", "part", "location"]
LISTS = {
    "overrides": "array<struct<field:string,original:string,current:string,changed_at:string>>", "history": "array<struct<at:string,action:string>>",
    "enrichments": "array<struct<field:string,value:string,applied_at:string>>", "conflicts": "array<struct<field:string,main:string,resolved:struct<value:string,reason:string,decided_at:string>>>",
}
STATE = "struct<" + ",".join(f"{c}:string" for c in SNAPSHOT) + "," + ",".join(f"{c}:{k}" for c, k in LISTS.items()) + ">"
_EVENT = ["type", "at", "source", "field", "from", "to", "category", "classification", "reason", "snapshot"]


def _event(type_: str, at: Column, source: str = "manual", **more: Column) -> Column:
    made = {"type": F.lit(type_), "at": at.cast("string"), "source": F.lit(source)} | more
    kinds = {"snapshot": "struct<" + ",".join(f"{c}:string" for c in SNAPSHOT) + ">"}
    return F.struct(*[made.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in _EVENT])


def _category(field: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv]), field)


def record_changes(now: Column) -> Column:
    """Events of a row with ``before`` and ``after`` (``STATE``; null where there is no such record) and ``record_id``."""
    was = lambda c: F.coalesce(F.col(f"before.{c}"), F.array().cast(LISTS[c]))
    is_ = lambda c: F.coalesce(F.col(f"after.{c}"), F.array().cast(LISTS[c]))
    key = lambda field, at: F.concat_ws("|", F.coalesce(field, F.lit("")), F.coalesce(at, F.lit("")))
    shown = lambda side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in SNAPSHOT])
    unknown = F.lit("UNKNOWN")

    last = lambda o: F.try_element_at(F.filter(was("overrides"), lambda p: p["field"].eqNullSafe(o["field"])), F.lit(-1))
    fresh = F.filter(is_("overrides"), lambda o: last(o).isNull() | ~last(o)["changed_at"].eqNullSafe(o["changed_at"]))
    out_ = lambda o: (o["field"] == "status") & (o["current"] == "excluded")
    edits = F.transform(fresh, lambda o: F.when(F.coalesce(out_(o), F.lit(False)), _event("status_excluded", o["changed_at"], field=o["field"], **{"from": o["original"]}, to=o["current"], classification=unknown)).otherwise(
        _event("field_edited", o["changed_at"], field=o["field"], **{"from": o["original"]}, to=o["current"], category=_category(o["field"]), classification=unknown)))
    more = F.slice(is_("history"), F.size(was("history")) + 1, F.greatest(F.size(is_("history")) - F.size(was("history")), F.lit(0)))
    reviewed = F.transform(F.filter(more, lambda h: F.coalesce(h["action"] == "review_completed", F.lit(False))), lambda h: _event("bulk_reviewed", h["at"]))
    known = F.transform(was("enrichments"), lambda e: key(e["field"], e["applied_at"]))
    filled = F.transform(F.filter(is_("enrichments"), lambda e: ~F.array_contains(known, key(e["field"], e["applied_at"]))), lambda e: _event("cross_validation_enriched", e["applied_at"], "ai", field=e["field"], to=e["value"], category=_category(e["field"])))
    settled = F.transform(F.filter(was("conflicts"), lambda c: c["resolved"].isNotNull()), lambda c: key(c["field"], c["resolved"]["decided_at"]))
    decided = F.transform(F.filter(is_("conflicts"), lambda c: c["resolved"].isNotNull() & ~F.array_contains(settled, key(c["field"], c["resolved"]["decided_at"]))), lambda c: _event(
        "cross_validation_resolved", c["resolved"]["decided_at"], field=c["field"], **{"from": c["main"]}, to=c["resolved"]["value"], category=F.lit("CROSS_VALIDATION_ERROR"), classification=unknown, reason=c["resolved"]["reason"]))

    added = F.array(_event("damage_added", now, category=F.lit("MISSING_DAMAGE"), classification=unknown, snapshot=shown("after")))
    gone = F.array(_event("damage_deleted", now, snapshot=shown("before")))
    by_hand = F.col("record_id").startswith("NEW-")
    kept = F.concat(edits, reviewed, filled, decided)
    return F.when(F.col("before").isNull(), F.when(by_hand, added)).when(F.col("after").isNull(), gone).otherwise(kept)


def as_state(rows: DataFrame) -> Column:
    """A snapshot's row as ``STATE``; lists that it has not are null."""
    own = [(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in ({c: "string" for c in SNAPSHOT} | LISTS).items()]
    return F.struct(*own)


def changes(pairs: DataFrame, now: Column) -> DataFrame:
    """Events of pairs (report_id, record_id, before, after)."""
    return pairs.select("report_id", "record_id", F.explode(record_changes(now)).alias("e")).select("report_id", "record_id", "e.*")


def record_events(before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """Events of the records of two snapshots; ``now`` is the time of what carries none of its own."""
    keyed = lambda rows, name: rows.select("report_id", F.col("id").alias("record_id"), as_state(rows).alias(name))
    return changes(keyed(before, "before").join(keyed(after, "after"), ["report_id", "record_id"], "full_outer"), now)


def photo_events(before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """Links made and cut by hand: photos (report_id, photo_id, linked, match_source) of both snapshots that were last set by hand."""
    was, none = before.select("report_id", "photo_id", F.col("linked").alias("_was")), F.array().cast("array<string>")
    both = after.where(F.col("match_source") == "manual").join(was, ["report_id", "photo_id"])
    a, b = F.coalesce("_was", none), F.coalesce("linked", none)
    told = lambda ids, type_, side: F.transform(ids, lambda i: F.struct(i.alias("record_id"), _event(type_, now, field=F.lit("photoLink"), category=F.lit("PHOTO_LINK_ERROR"), **{side: F.col("photo_id")}).alias("e")))
    both = both.select("report_id", F.explode(F.concat(told(F.array_except(b, a), "photo_linked", "to"), told(F.array_except(a, b), "photo_unlinked", "from"))).alias("x"))
    return both.select("report_id", "x.record_id", "x.e.*")


def session_events(before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """Sessions (report_id, review_status, finalized_at) that became completed or finalised."""
    both = after.join(before.select("report_id", F.col("review_status").alias("_was")), "report_id")
    turned = lambda s: F.col("review_status").eqNullSafe(s) & ~F.col("_was").eqNullSafe(s)
    events = F.array_compact(F.array(F.when(turned("completed"), _event("review_completed", now)), F.when(turned("finalized"), _event("finalized", F.coalesce(F.col("finalized_at").cast("string"), now.cast("string"))))))
    return both.select("report_id", F.lit(None).cast("string").alias("record_id"), F.explode(events).alias("e")).select("report_id", "record_id", "e.*")


def reason_class(reason: Column) -> Column:
    """What a stated reason says of a change."""
    has = lambda *words: F.coalesce(F.greatest(*[F.contains(reason, F.lit(w)) for w in words]), F.lit(False))
    return F.when(has("AI", "오류", "오탐", "오분류"), "AI_ERROR_CANDIDATE").when(has("판단", "의견"), "USER_JUDGMENT_CHANGE").when(has("표현", "표준화", "해석"), "SOURCE_INTERPRETATION_DIFFERENCE").otherwise("UNKNOWN")
