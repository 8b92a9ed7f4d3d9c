"""Changes of stored rows: edits, links, decisions, upserts and what they leave in the history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.operators import scan


def edit_history(records: DataFrame, edits: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Edits (key, field, to, order) that changed something, each with the value it replaced; edits of unknown rows are no edits."""
    now = records.unpivot([key], [F.col(f).cast("string").alias(f) for f in fields], "field", "_original")
    told = scan.lagged(edits.select(key, "field", "to", order), [key, "field"], [order, "to"], F.col("to"), "_before")
    seen = told.join(now, [key, "field"]).withColumn("from", F.when(F.col("_before").isNull(), F.col("_original")).otherwise(F.col("_before.v")))
    return seen.where(~F.col("from").eqNullSafe(F.col("to"))).select(key, "field", "from", "to", order, F.col("_original").alias("original"))


def apply_edits(records: DataFrame, history: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Records with the last value of each edited field, and how many fields are overridden."""
    by = history.groupBy(key).agg(
        *[F.max_by(F.struct("to"), F.when(F.col("field") == f, F.struct(order, "to"))).alias(f"_{f}") for f in fields],
        F.size(F.collect_set("field")).alias("_n"),
    )
    out = records.join(by, key, "left")
    edited = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.to")).otherwise(F.col(f).cast("string")) for f in fields}
    return out.withColumns(edited | {"n_overrides": F.coalesce("_n", F.lit(0))}).drop("_n", *[f"_{f}" for f in fields])


def upsert(current: DataFrame, puts: DataFrame, key: str, order: str) -> DataFrame:
    """The last row put under each key, of both tables; reduced before the shuffle.  Of rows of one order the one that is larger column by column (maps apart)."""
    both = current.unionByName(puts)
    rest = [c for c in both.columns if c != key]
    turn = F.struct(order, *[c for c in rest if "map<" not in both.schema[c].dataType.simpleString()])
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), turn).alias("_row")).select(key, "_row.*")


def migrate(rows: DataFrame, defaults: dict[str, Column], legacy: Column) -> DataFrame:
    """Rows of an older layout with every missing value or column filled, and a flag for rows of before."""
    filled = {c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()}
    return rows.withColumn("legacy", F.coalesce(legacy, F.lit(False))).withColumns(filled)


def bulk_set(rows: DataFrame, ids: DataFrame, key: str, column: str, value: str, untouched: list[str]) -> DataFrame:
    """``column`` set to ``value`` in the rows named by ``ids``, except rows whose state is in ``untouched``."""
    named = ids.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_named", F.lit(True))
    free = ~F.coalesce(F.col(column).isin(untouched), F.lit(False))
    return rows.join(named, key, "left").withColumn(column, F.when(F.col("_named") & free, F.lit(value)).otherwise(F.col(column))).drop("_named")


def relink(links: DataFrame, added: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Links after links were set and cut by hand: a set link is manual, a cut one is gone, the others stay automatic."""
    every = links.select(*keys, F.lit(0).alias("_m")).unionByName(added.select(*keys, F.lit(1).alias("_m"))).groupBy(*keys).agg(F.max("_m").alias("_m"))
    kept = every.join(removed.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*keys, F.when(F.col("_m") == 1, "manual").otherwise("auto").alias("match_source"))


def approve(candidates: DataFrame, records: DataFrame, keys: list[str], candidate_id: str, record_id: str) -> DataFrame:
    """Where each approved candidate goes: to the first record with its keys, or to a new record."""
    first = records.groupBy(*keys).agg(F.min(record_id).alias("target"))
    out = candidates.select(candidate_id, *keys).join(first, keys, "left")
    return out.select(candidate_id, "target", F.when(F.col("target").isNull(), "new").otherwise("duplicate").alias("outcome"))


def transitions(rows: DataFrame, by: str, order: list[str], status: Column, targets: list[str]) -> DataFrame:
    """Rows where the status turns into one of ``targets``."""
    told = scan.lagged(rows.withColumn("to", status), [by], order, F.col("to"), "_before").withColumn("from", F.col("_before.v")).drop("_before")
    return told.where(F.col("to").isin(targets) & F.col("from").isNotNull() & (F.col("from") != F.col("to")))


def numbered(rows: DataFrame, by: str, order: list[str], prefix: str, width: int) -> DataFrame:
    """Ids such as AD001, counted within each report."""
    told, place = scan.numbered(rows, [by], order, "_place"), F.col("_place")
    shown = F.when(place < 10**width, F.lpad(place.cast("string"), width, "0")).otherwise(place.cast("string"))
    return told.withColumn("id", F.concat(F.lit(prefix), shown)).drop("_place")


def first_of_group(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The first row of every group, as one reduction."""
    rest = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(by, "_row.*")


def error_entries(truth: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per field that differs, per row only the truth has (missed) and per row only the other has (extra)."""
    a = truth.select(F.col(key), F.lit(True).alias("_t"), *[F.col(f).cast("string").alias(f"_{f}") for f in fields])
    b = found.select(F.col(key), F.lit(True).alias("_f"), *[F.col(f).cast("string").alias(f) for f in fields])
    none = F.lit(None).cast("string")
    entry = lambda kind, field, want, got: F.struct(F.lit(kind).alias("category"), field.alias("field"), want.alias("expected"), got.alias("actual"))
    wrong = [F.when(F.col("_t") & F.col("_f") & ~F.col(f"_{f}").eqNullSafe(F.col(f)), entry("field", F.lit(f), F.col(f"_{f}"), F.col(f))) for f in fields]
    missed, extra = F.when(F.col("_f").isNull(), entry("missed", none, none, none)), F.when(F.col("_t").isNull(), entry("extra", none, none, none))
    return a.join(b, key, "full_outer").select(key, F.explode(F.array_compact(F.array(missed, extra, *wrong))).alias("e")).select(key, "e.*")


def grade(value: Column, good: float = 0.9, warning: float = 0.75) -> Column:
    return F.when(value >= good, "GOOD").when(value >= warning, "WARNING").otherwise("FAIL")


def table_candidates(rows: DataFrame, sheet: str, row_no: str, cells: str, hits: Column, within: int = 5, least: int = 2) -> DataFrame:
    """Cells below each sheet's header with their column's name; a sheet's header is the first of its ``within`` first rows with ``least`` keyword hits.

    Sheets without a header give their cells with a null name.  Only headers are grouped, so a large sheet is never gathered."""
    found = rows.where((F.col(row_no) <= within) & (hits >= least)).groupBy(sheet).agg(F.min(F.struct(F.col(row_no), F.col(cells))).alias("_h"))
    below = rows.join(found, sheet, "left").where(F.col("_h").isNull() | (F.col(row_no) > F.col(f"_h.{row_no}")))
    out = below.select(sheet, row_no, F.col(f"_h.{cells}").alias("_names"), F.posexplode(cells).alias("_p", "value"))
    return out.select(sheet, row_no, (F.col("_p") + 1).cast("long").alias("column_no"), F.try_element_at("_names", F.col("_p") + 1).alias("name"), "value")
