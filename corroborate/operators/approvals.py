"""Candidates approved one after the other, each a record for the next.

Approving a candidate looks for the first record of its report with the same section, name, sub part and place (white
space and forms of a place aside) and the same part, any part if the candidate names none.  If there is one, the
candidate becomes one more of its references; else it becomes a record itself, which later candidates may meet.

That order needs no walk through the candidates.  Whatever becomes of a candidate, a record with its key and part stands
afterwards; so a candidate is new exactly if no record has its key and part and no earlier candidate either, and the
record that it meets otherwise is the first of these.  Candidates of one turn follow each other by id.  The first of each
key and of each key and part are reductions, so a key of very many candidates is no single task.  Two rules need care.  A candidate without a part is new only if it is
the first of its whole key, and then stands as the catch-all part.  One without a sub part is looked up without, but
stands under a dash: it meets what the first pass has settled, and what it adds is known to the second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import domain as D
from corroborate.functions import text as T

_KEY = ["report_id", "k_section", "k_name", "k_sub", "k_place"]


def _keys(sub_part: Column) -> dict[str, Column]:
    place = F.coalesce(T.normalize_location(F.col("location")), F.lit(""))
    return {"k_section": T.norm(F.col("section")), "k_name": T.norm(F.col("damage_name")), "k_sub": T.norm(sub_part), "k_place": place}


def _firsts(events: DataFrame, by: list[str], name: str) -> DataFrame:
    return events.groupBy(*by).agg(F.min(F.struct("turn", "ordinal", "id")).alias(name))


def _settled(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first of each key, and of each key and part; a candidate without a part counts for the second only where it is the first of all."""
    every = _firsts(events, _KEY, "any")
    told = events.join(every, _KEY).where(F.col("part").isNotNull() | (F.struct("turn", "ordinal", "id") == F.col("any")))
    return every, _firsts(told.withColumn("part", F.coalesce("part", F.lit(D.OTHER))), [*_KEY, "part"], "own")


def _met(candidates: DataFrame, every: DataFrame, own: DataFrame) -> DataFrame:
    """Candidates with ``first``, the earliest event that they may meet, if it is earlier than they are."""
    out = candidates.join(every, _KEY, "left").join(own, [*_KEY, "part"], "left")
    first = F.when(F.col("part").isNull(), F.col("any")).otherwise(F.col("own"))
    return out.withColumn("first", F.when(first < F.struct("turn", "ordinal", "id"), first)).drop("any", "own")


def outcomes(records: DataFrame, candidates: DataFrame, approved: DataFrame) -> DataFrame:
    """report_id, candidate_id, turn, outcome (new or duplicate) and target (the record met) of each approval that finds its candidate.

    records: report_id, ordinal, id and the fields compared; candidates: report_id, candidate_id and the fields; approved:
    report_id, candidate_id, turn (rising, then by candidate_id; of several of one candidate the first counts)."""
    turns = approved.groupBy("report_id", "candidate_id").agg(F.min("turn").cast("long").alias("turn"))
    asked = candidates.join(turns, ["report_id", "candidate_id"]).withColumns({"id": F.col("candidate_id"), "ordinal": F.lit(0).cast("long")})
    shown = [*_KEY, "part", "turn", "ordinal", "id"]
    stand = records.withColumns(_keys(F.col("sub_part"))).withColumns({"turn": F.lit(-(1 << 62)), "ordinal": F.col("ordinal").cast("long"), "part": F.coalesce("part", F.lit(""))}).select(*shown)
    keyed = asked.withColumns(_keys(F.col("sub_part")))
    plain, without = keyed.where("sub_part is not null").select(*shown), keyed.where("sub_part is null").select(*shown)
    events = stand.unionByName(plain)
    missing = _met(without, *_settled(events))
    added = missing.where("first is null").withColumns({"k_sub": F.lit(D.DASH), "part": F.coalesce("part", F.lit(D.OTHER))}).select(*shown)
    found = _met(plain, *_settled(events.unionByName(added))).unionByName(missing)
    return found.select("report_id", F.col("id").alias("candidate_id"), "turn", F.when(F.col("first").isNull(), "new").otherwise("duplicate").alias("outcome"), F.col("first.id").alias("target"))


def approve(records: DataFrame, candidates: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, candidates) after the approvals: new records at the end in turn, references added in turn, approved candidates gone.

    candidates also have source_type, file, page and quote; records also pages, refs (page, type, excerpt), status, notes,
    group_no and group_index, and keep their other columns, null in new rows."""
    told = outcomes(records, candidates, approved)
    made = candidates.join(told, ["report_id", "candidate_id"])
    page = F.coalesce("page", F.lit(0)).cast("int")
    ref = F.struct(page.alias("page"), F.col("source_type").alias("type"), F.col("quote").alias("excerpt"))
    more = made.where("outcome = 'duplicate'").groupBy("report_id", F.col("target").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "candidate_id", ref.alias("r")))), lambda x: x["r"]).alias("_more"))
    filled = lambda c, other: F.coalesce(c, F.lit(other)).alias(c)
    fresh = made.where("outcome = 'new'").select(
        "report_id", F.col("candidate_id").alias("id"), F.col("turn").alias("_turn"), F.lit(D.DASH).alias("group_no"), F.lit(1).alias("group_index"), filled("section", ""), filled("damage_name", ""), filled("part", D.OTHER),
        filled("sub_part", D.DASH), filled("location", ""), filled("repair_method", ""), "quantity", F.lit("review").alias("status"), F.when(page != 0, F.array(page)).otherwise(F.array().cast("array<int>")).alias("pages"),
        F.array(ref).alias("refs"), F.concat(F.lit("추가자료("), F.coalesce("file", F.lit("")), F.lit(")에서 발견되어 사용자가 승인한 손상")).alias("notes"),
    )
    last = records.groupBy("report_id").agg(F.max("ordinal").cast("long").alias("_last"))
    fresh = fresh.join(last, "report_id", "left").withColumn("ordinal", F.coalesce("_last", F.lit(0)) + 1 + F.col("_turn")).drop("_last", "_turn")
    kinds = {c: records.schema[c].dataType.simpleString() for c in records.columns}
    rows = records.unionByName(fresh.select(*[F.col(c).cast(kinds[c]).alias(c) for c in fresh.columns if c in kinds]), allowMissingColumns=True)
    none = F.array().cast(kinds["refs"])
    out = rows.join(more, ["report_id", "id"], "left")
    out = out.withColumn("refs", F.concat(F.coalesce("refs", none), F.coalesce(F.col("_more").cast(kinds["refs"]), none))).select(*records.columns)
    return out, candidates.join(told.select("report_id", "candidate_id"), ["report_id", "candidate_id"], "left_anti")
