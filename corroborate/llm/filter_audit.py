"""What each filter removes in every order of application, by lattice-edge aggregation.

A document's filters fail or hold whatever the order, so a subset of filters already applied together with the next
filter, an edge of the subset lattice, says all that a step of any order can remove.  Documents are counted once per part
and set of failed filters; the counts go to the edges (80 for five filters), edges to the steps of all orders (600 for
five filters) as lattice paths.  No document is looked at twice, and what is joined with the steps has one row per part
and edge.

The filter ``REPEATS`` fails for a text that a smaller doc_id holds, wherever in the table.  Texts stand for themselves as
SHA-256 values; the smallest doc_id of each comes from a grouping with map-side sums, and a document is looked up by text
and doc_id together, so a text that a third of all rows hold is never one group of rows.

Defined results: a null text is the empty text; a null part is the empty part; rows repeated with one doc_id count once
each and never make each other fail; a null doc_id is larger than none, so such a row never fails ``REPEATS`` nor makes
another fail; a document's labels are those of any of its rows of ``labels``, and rows without labels lose nothing good or
toxic; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
REPEATS = "E"

#: Of a text and its words: whether the filter of that letter fails.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 65,
    "C": lambda text, words: F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 5,
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}


def failures(docs: DataFrame, part_col: str = "source", filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, repeats: str = REPEATS) -> DataFrame:
    """doc_id, part, fails (bit k: the k-th letter fails) and n, the number of such rows."""
    letters = sorted([*filters, repeats])
    bit = {f: 1 << k for k, f in enumerate(letters)}
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    seen = text.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    mask = sum((F.when(fails(F.col("text"), F.col("words")), bit[f]).otherwise(0) for f, fails in filters.items()), F.lit(0))
    rows = seen.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("same"), mask.alias("fails"))
    rows = rows.groupBy("doc_id", "part", "same", "fails").agg(F.count("*").alias("n"))
    first = rows.groupBy("same").agg(F.min("doc_id").alias("first")).withColumnRenamed("same", "of")
    found = rows.join(first, (F.col("same") == F.col("of")) & (F.col("doc_id") == F.col("first")), "left")
    again = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), bit[repeats]).otherwise(0)
    return found.select("doc_id", "part", F.col("fails").bitwiseOR(again).alias("fails"), "n")


def edges(failed: DataFrame, labels: DataFrame, letters: list[str]) -> DataFrame:
    """part, applied, filter and what applying the filter after the set ``applied`` keeps and removes, one row per edge."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    mark = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    counts = failed.join(marks, "doc_id", "left").groupBy("part", "fails", *mark).agg(F.sum("n").alias("n"))
    n = len(letters)
    lattice = [(applied, k) for applied in range(1 << n) for k in range(n) if not applied >> k & 1]
    weight = [math.factorial(s) * math.factorial(n - 1 - s) for s in range(n)]
    edge = F.explode(F.array(*[F.struct(F.lit(a).alias("applied"), F.lit(k).alias("filter"), F.lit(weight[a.bit_count()]).cast("long").alias("weight")) for a, k in lattice]))
    at = counts.select("part", "fails", "good", "toxic", "n", edge.alias("e")).select("*", "e.*")
    bit = F.expr("shiftleft(1, filter)")
    earlier, own = F.col("fails").bitwiseAND(F.col("applied")) != 0, F.col("fails").bitwiseAND(bit) != 0
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return at.groupBy("part", "applied", "filter", "weight").agg(
        total(~earlier & ~own).alias("kept"), total(~earlier & own).alias("removed"), total(earlier & own).alias("redundant"),
        total(F.col("fails") == bit).alias("unique_fails"), total(~earlier & own & F.col("good")).alias("good_lost"), total(~earlier & own & F.col("toxic")).alias("toxic_lost"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", filters: dict[str, Callable[[Column, Column], Column]] = FILTERS, repeats: str = REPEATS) -> DataFrame:
    """One row per part, order of the filters (as their letters) and step, with what the step keeps and removes."""
    letters = sorted([*filters, repeats])
    edge = edges(failures(docs, part_col, filters, repeats), labels, letters)
    edge = edge.withColumn("shapley", F.sum(F.col("removed") * F.col("weight")).over(Window.partitionBy("part", "filter")))
    steps = [
        ("".join(letters[k] for k in order), step + 1, sum(1 << k for k in order[:step]), order[step])
        for order in itertools.permutations(range(len(letters))) for step in range(len(letters))
    ]
    paths = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, filter int")
    return edge.join(F.broadcast(paths), ["applied", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN g USING (doc_id)
), c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
  SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order FROM l l1, l l2, l l3, l l4, l l5 WHERE len(list_distinct([l1.x, l2.x, l3.x, l4.x, l5.x])) = 5
), s AS (
  SELECT filter_order, step::INTEGER AS step, filter_order[step] AS own, CASE WHEN step = 1 THEN '' ELSE filter_order[1 : step - 1] END AS earlier FROM o, range(1, 6) r(step)
), x AS (
  SELECT part, filter_order, step, own, good, toxic, n, fails, contains(fails, own) AS hit, length(translate(fails, earlier, '')) < length(fails) AS gone FROM c, s
), y AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM y
"""
