"""Running values within a key whose rows are many tasks: segmented prefix scans.

A window over a key gathers the key in one task.  Here the rows of every key are cut into segments by ranges of their
position, each segment is reduced to what it carries on (a count, its last value), the carries of a key are scanned, one
row per segment, and the segments are finished apart from each other.  The ranges come from quantiles of the position
over all rows, read before the plan is made, so that a row's segment depends on the row alone and a task that is run
again finds the same segments.

The position is the first of ``order``, a number, time or text; the others decide between rows of one position.  Rows of
one position stay in one segment, so it should tell most rows apart.  Null keys are a key of their own; null positions
come first, as in a window.  Results equal those of a window over the key, whatever the segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SEGMENTS = 64


def _place(rows: DataFrame, position: str) -> Column:
    """The position as a number that no row of a later position falls below; of texts the first seven bytes."""
    if isinstance(rows.schema[position].dataType, StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(position), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    kind = rows.schema[position].dataType.typeName()
    return F.unix_micros(F.col(position).cast("timestamp")) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(position)


def segmented(rows: DataFrame, position: str, segments: int = SEGMENTS) -> DataFrame:
    """Rows with ``_seg``, rising with the position."""
    place = _place(rows, position)
    cuts = rows.agg(F.percentile_approx(place, [k / segments for k in range(1, segments)], 100 * segments)).first()[0] or []
    edges = sorted({c for c in cuts if c is not None and c == c})
    kind = rows.select(place.alias("p")).schema["p"].dataType

    def segment(low: int, high: int) -> Column:
        """How many of the edges low..high are at most the place: a search by halves."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(place >= F.lit(edges[middle]).cast(kind), segment(middle + 1, high)).otherwise(segment(low, middle))

    return rows.withColumn("_seg", segment(0, len(edges)))


def _carried(rows: DataFrame, keys: list[str], carry: Column, scan: Column) -> DataFrame:
    """Per key and segment what the segments before it carry on: ``carry`` reduces a segment to ``_c``, ``scan`` runs over the segments as a window function of ``_c``."""
    per = rows.groupBy(*keys, "_seg").agg(carry.alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_seg").alias("_s"), scan.over(before).alias("_carry"))


def _meet(rows: DataFrame, keys: list[str], carried: DataFrame) -> DataFrame:
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_seg") == F.col("_s")]
    return rows.join(carried, on, "left").drop(*[f"_k{i}" for i in range(len(keys))], "_s")


def _order(order: list) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, segments: int = SEGMENTS) -> DataFrame:
    """``row_number`` within the keys by ``order``."""
    cut = segmented(rows, order[0], segments)
    met = _meet(cut, keys, _carried(cut, keys, F.count("*"), F.sum("_c")))
    own = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(*_order(order)))
    return met.withColumn(name, (own + F.coalesce("_carry", F.lit(0))).cast("long")).drop("_carry", "_seg")


def last_seen(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, segments: int = SEGMENTS) -> DataFrame:
    """The last value that is not null up to and with each row."""
    cut = segmented(rows.withColumn("_v", value), order[0], segments)
    held = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))
    met = _meet(cut, keys, _carried(cut, keys, held, F.last("_c", ignorenulls=True)))
    own = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys, "_seg").orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn(name, F.coalesce(own, "_carry")).drop("_carry", "_seg", "_v")


def lagged(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, segments: int = SEGMENTS) -> DataFrame:
    """A struct ``v`` of the value of the row before, null for the first row of a key."""
    cut = segmented(rows.withColumn("_v", F.struct(value.alias("v"))), order[0], segments)
    met = _meet(cut, keys, _carried(cut, keys, F.max_by("_v", F.struct(*order)), F.last("_c", ignorenulls=True)))
    own = F.lag("_v").over(Window.partitionBy(*keys, "_seg").orderBy(*_order(order)))
    return met.withColumn(name, F.coalesce(own, "_carry")).drop("_carry", "_seg", "_v")
