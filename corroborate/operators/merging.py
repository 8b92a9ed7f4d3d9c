"""Two-stage merging of records: equal ones become one; ones that differ in place alone, on pages apart, become a conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import domain as D
from corroborate.functions import text as T

COLUMNS = ["report_id", "id", "group_no", "group_index", "section", "damage_name", "part", "sub_part", "location", "repair_method", "quantity", "quantity_group", "status", "pages", "refs", "notes"]
_COMBINED = ["repair_method", "group_no", "quantity_group", "quantity"]


def _keys() -> dict[str, Column]:
    return {"k_section": T.norm(F.col("section")), "k_name": T.norm(F.col("damage_name")), "k_part": F.col("part"), "k_sub": T.norm(F.col("sub_part"))}


def _merge(rows: DataFrame, keys: list[str], place: bool) -> DataFrame:
    """One row per key.  Blank values are no values; what is left is compared without white space, and the first kept as it was written."""
    order = F.struct("group_index", "id")
    aggs = [F.count("*").alias("n"), F.min_by(F.struct(*[c for c in COLUMNS if c not in keys]), order).alias("b")]
    for f in _COMBINED:
        filled = F.trim(F.coalesce(F.col(f), F.lit(""))) != ""
        aggs += [F.collect_set(F.when(filled, T.norm(F.col(f)))).alias(f"set_{f}"), F.min_by(F.when(filled, F.trim(f)), F.when(filled, order)).alias(f"first_{f}")]
    aggs += [
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("all_pages"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("group_index", "id", "refs"))), lambda x: x["refs"]))).alias("all_refs"),
        F.transform(F.array_sort(F.collect_list(F.struct("group_index", "id"))), lambda x: x["id"]).alias("ids"),
        F.array_distinct(F.transform(F.array_sort(F.collect_set(F.when(D.given(F.col("notes")), F.struct("group_index", "id", "notes")))), lambda x: x["notes"])).alias("all_notes"),
        F.array_sort(F.collect_set("location")).alias("locations"), F.bool_or(F.col("status") == "confirmed").alias("sure"),
    ]
    g = rows.groupBy(*keys).agg(*aggs)
    many, several = F.col("n") > 1, (lambda f: F.size(f"set_{f}") > 1)
    conflicts = F.array_compact(
        F.array(F.when(several("repair_method"), "repair_method"), F.when(several("group_no"), "group_no"), F.when(several("quantity_group") | several("quantity"), "quantity"), F.when(F.lit(place), "location"))
    )
    kept = lambda f: F.when(several(f), D.REVIEW).otherwise(F.coalesce(f"first_{f}", F.lit("")))
    or_base = lambda f, x: F.coalesce(F.nullif(x, F.lit("")), F.col(f"b.{f}"))
    made = {
        "group_no": or_base("group_no", F.col("first_group_no")), "location": F.lit(D.REVIEW) if place else F.col("b.location"),
        "repair_method": or_base("repair_method", kept("repair_method")), "quantity": or_base("quantity", kept("quantity")),
        "quantity_group": F.when(kept("quantity") != "", F.lit(None)).otherwise(or_base("quantity_group", kept("quantity_group"))),
        "pages": F.col("all_pages"), "refs": F.col("all_refs"), "notes": F.coalesce(F.nullif(F.array_join("all_notes", "; "), F.lit("")), F.col("b.notes")),
        "status": F.when(F.size(conflicts) > 0, "conflict").when(F.col("sure"), "confirmed").otherwise("review"),
    }
    out = [F.col(c) if c in keys else F.when(many, made[c]).otherwise(F.col(f"b.{c}")).alias(c) if c in made else F.col(f"b.{c}").alias(c) for c in COLUMNS]
    none = F.array().cast("array<string>")
    return g.select(*out, many.alias("merged"), F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(0))).alias("source_ids"), F.when(many, conflicts).otherwise(none).alias("conflicts"), F.when(F.lit(place), F.col("locations")).otherwise(none).alias("locations"))


def _stages(records: DataFrame) -> tuple[DataFrame, DataFrame, list[str], list[Column]]:
    """Rows of stage 1 with the keys of stage 2, the keys whose places lie apart, the keys' names and how the two meet."""
    strong = {**_keys(), "k_place": T.norm(F.col("location"))}
    first = _merge(records.select(*COLUMNS, *[c.alias(k) for k, c in strong.items()]), ["report_id", *strong], False)
    weak = {**_keys(), "k_group": T.norm(F.col("group_no"))}
    keyed = first.select("*", *[c.alias(k) for k, c in weak.items()])
    keys = ["report_id", *weak]
    facts = keyed.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(T.norm(F.col("location"))).alias("places"), F.sum(F.size(F.array_distinct("pages"))).alias("p"), F.size(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("d"))
    apart = facts.where("n > 1 and places > 1 and p = d").select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return keyed, apart, keys, on


def merge_records(records: DataFrame) -> DataFrame:
    """``COLUMNS`` with merged, source_ids, conflicts (fields) and locations (those in conflict).

    Stage 1 merges rows equal in section, name, part, sub part and place; stage 2 those equal but for the place, group
    number included, if the places differ and no page occurs in two of them.  Groups are reduced before the exchange to
    sets of their values; rows of stage 2 that stay as they are meet their group's facts by a join."""
    keyed, apart, keys, on = _stages(records)
    second = _merge(keyed.join(apart, on, "left_semi"), keys, True)
    return keyed.join(apart, on, "left_anti").select(*second.columns).unionByName(second)


def _disagreeing(rows: DataFrame, keys: list[str], place: bool) -> DataFrame:
    """Per merged row and field in conflict its values (value, page), the first of each kept as it was written, in the records' order.

    A group is reduced twice: to one entry per value before the exchange, and then to its fields, whose size is the
    number of different values, not of records."""
    order, page = F.struct("group_index", "id"), F.get("pages", F.lit(0))
    entry = lambda field, turn, k, v: F.struct(F.lit(field).alias("field"), F.lit(turn).alias("turn"), k.alias("k"), v.alias("value"))
    fields = [("repair_method", "repair_method", 0), ("group_no", "group_no", 0), ("quantity", "quantity_group", 0), ("quantity", "quantity", 1)]
    given = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", entry(field, turn, T.norm(F.col(c)), F.trim(c))) for field, c, turn in fields]
    # every record once more, for the id of the first; with places, which are all shown
    every = entry("location", 0, T.norm(F.col("location")), F.col("location")) if place else entry("", 0, F.lit(""), F.lit(None).cast("string"))
    told = rows.select(*keys, order.alias("o"), page.alias("page"), F.explode(F.array_compact(F.array(every, *given))).alias("e"))
    values = told.groupBy(*keys, "e.field", "e.turn", "e.k").agg(F.min_by(F.struct("o", "page", F.col("e.value").alias("value")), "o").alias("v"))
    per = values.groupBy(*keys, "field", "turn").agg(F.array_sort(F.collect_list(F.struct("v.o", "v.page", "v.value"))).alias("vs"))
    first = F.min(F.col("vs")[0]["o"]).alias("base")
    shown = F.when((F.col("field") != "") & (F.size("vs") > 1), F.struct("field", "turn", F.transform("vs", lambda v: F.struct(v["value"].alias("value"), v["page"].alias("page"))).alias("vs")))
    made = per.groupBy(*keys).agg(first, F.array_sort(F.collect_list(shown)).alias("fs")).select("report_id", F.col("base.id").alias("id"), F.explode("fs").alias("x"))
    return made.groupBy("report_id", "id", "x.field").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("x.turn", "x.vs"))), lambda x: x["vs"])).alias("values"))


def merge_conflicts(records: DataFrame) -> DataFrame:
    """report_id, id, field and ``values`` (value, page) of every conflict of ``merge_records``.

    A value is the first record's of those that are the same without white space, with the first page that record names;
    blank values are none.  Of quantities those of groups come first, each kind only if it disagrees in itself.  Places in
    conflict are those of stage 1's rows.  What stage 1 found in rows that stage 2 merges is theirs no more."""
    strong = [*_keys(), "k_place"]
    keyed, apart, keys, on = _stages(records)
    told = records.select(*COLUMNS, *[c.alias(k) for k, c in _keys().items()], T.norm(F.col("location")).alias("k_place"))
    gone = keyed.join(apart, on, "left_semi").select("report_id", "id")
    one = _disagreeing(told, ["report_id", *strong], False).join(gone, ["report_id", "id"], "left_anti")
    return one.unionByName(_disagreeing(keyed.join(apart, on, "left_semi"), keys, True))


def merge_members(records: DataFrame) -> DataFrame:
    """report_id, record_id, the ``id`` of the row of ``merge_records`` it went into, and ``turn``, its place there."""
    keyed, apart, keys, on = _stages(records)
    listed = lambda rows, at, member: rows.select("report_id", "id", F.posexplode(F.concat(F.array("id"), "source_ids")).alias(at, member))
    second = listed(_merge(keyed.join(apart, on, "left_semi"), keys, True), "_outer", "_first").withColumnRenamed("id", "_last")
    met = listed(keyed, "_inner", "record_id").withColumnRenamed("id", "_first").join(second, ["report_id", "_first"], "left")
    return met.select("report_id", "record_id", F.coalesce("_last", "_first").alias("id"), F.struct(F.coalesce("_outer", F.lit(0)).alias("outer"), F.col("_inner").alias("inner")).alias("turn"))


def merged_photos(records: DataFrame, photos: DataFrame) -> DataFrame:
    """report_id, id and ``photos`` of the rows of ``merge_records``: those of all their records in the records' order, each photo once.

    ``photos`` has report_id, record_id, seq, photo_id: a record's photos in order.  Of a photo that several records name
    the first stays.  Rows without photos have an empty list."""
    met = merge_members(records).join(photos.where("photo_id is not null"), ["report_id", "record_id"], "left")
    once = met.groupBy("report_id", "id", "photo_id").agg(F.min(F.struct("turn", "seq")).alias("at"))
    listed = F.array_sort(F.collect_list(F.when(F.col("photo_id").isNotNull(), F.struct("at", "photo_id"))))
    return once.groupBy("report_id", "id").agg(F.transform(listed, lambda x: x["photo_id"]).alias("photos"))
