"""Review state, quality metrics and change events, as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.operators import scan


def counts(rows: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """One row with a conditional count per predicate."""
    return rows.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(name) for name, p in predicates.items()])


def gate(counted: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """Whether nothing blocks, and the reasons that do."""
    why = F.array_compact(F.array(*[F.when(F.col(name) > 0, F.lit(text)) for name, text in reasons.items()]))
    return counted.withColumn("reasons", F.array_join(why, "; ")).withColumn("can_finalize", F.size(why) == 0)


def search(rows: DataFrame, fields: list[str], wanted: str) -> DataFrame:
    """Rows any of whose fields contains the words, in any case; a blank query keeps all."""
    wanted = wanted.strip().lower()
    return rows if not wanted else rows.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(wanted)))


def metric(matched: Column, total: Column, least: int = 5) -> list[Column]:
    """value (null when there is nothing), sample and whether the sample suffices."""
    return [F.try_divide(matched.cast("double"), total.cast("double")).alias("value"), total.cast("long").alias("sample"), (total >= least).alias("sufficient")]


def recent_trend(events: DataFrame, category: str, at: str, tie: str, window: int = 50) -> DataFrame:
    """Rate of each category in the last ``window`` events against the ``window`` before; nothing while there are fewer.

    Only the last 2 * window events are ranked: a bounded top-k, not a global sort."""
    last = events.orderBy(F.desc(at), F.desc(tie)).limit(2 * window)
    ranked = last.withColumn("k", F.row_number().over(Window.orderBy(F.desc(at), F.desc(tie))))
    enough = ranked.agg((F.count("*") == 2 * window).alias("enough"))
    per = ranked.groupBy(category).agg(F.count_if(F.col("k") <= window).alias("recent"), F.count_if(F.col("k") > window).alias("previous"))
    rates = per.crossJoin(F.broadcast(enough)).where("enough").drop("enough")
    direction = F.when(F.col("recent") < F.col("previous"), "improved").when(F.col("recent") > F.col("previous"), "worsened").otherwise("unchanged")
    return rates.withColumns({"recent_rate": F.col("recent") / window, "previous_rate": F.col("previous") / window, "direction": direction})


def last_change(rows: DataFrame, by: str, order: list[str], value: str, drop: float = -0.1) -> DataFrame:
    """Each group's last value against the one before; a fall of ``-drop`` or more is a warning."""
    w = Window.partitionBy(by).orderBy(*order)
    back = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    ranked = rows.withColumns({"previous": F.lag(value).over(w), "k": F.row_number().over(back)}).where("k = 1 and previous is not null")
    return ranked.select(by, F.col(value).alias("latest"), "previous", (F.col(value) - F.col("previous")).alias("delta"), (F.col(value) - F.col("previous") <= drop).alias("warning"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Events between two snapshots: added, removed and, per field, field_edited."""
    a = before.select(F.col(key), *[F.col(f).cast("string").alias(f"_{f}") for f in fields], F.lit(True).alias("_was"))
    b = after.select(F.col(key), *[F.col(f).cast("string").alias(f) for f in fields], F.lit(True).alias("_is"))
    both = a.join(b, key, "full_outer")
    none = F.lit(None).cast("string")
    made = F.when(F.col("_was").isNull(), F.array(F.struct(F.lit("added").alias("type"), none.alias("field"), none.alias("from"), none.alias("to"))))
    gone = F.when(F.col("_is").isNull(), F.array(F.struct(F.lit("removed").alias("type"), none.alias("field"), none.alias("from"), none.alias("to"))))
    edits = F.array_compact(F.array(*[F.when(~F.col(f"_{f}").eqNullSafe(F.col(f)), F.struct(F.lit("field_edited").alias("type"), F.lit(f).alias("field"), F.col(f"_{f}").alias("from"), F.col(f).alias("to"))) for f in fields]))
    return both.select(key, F.explode(F.coalesce(made, gone, edits)).alias("e")).select(key, "e.*")


def set_changes(rows: DataFrame, by: str, item: str, later: Column) -> DataFrame:
    """Items of each group that only the later or only the earlier part has: linked or unlinked."""
    seen = rows.groupBy(by, item).agg(F.max(later.cast("int")).alias("in_later"), F.min(later.cast("int")).alias("only_later"))
    change = F.when(F.col("only_later") == 1, "linked").when(F.col("in_later") == 0, "unlinked")
    return seen.select(by, item, change.alias("change")).where("change is not null")


def carry_forward(rows: DataFrame, by: str, order: str, label: Column, name: str) -> DataFrame:
    """The last label seen so far in the group, however large it is."""
    return scan.last_seen(rows, [by], [order], label, name)
