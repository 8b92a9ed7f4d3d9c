"""Queries of image placement, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.operators import placement as P

from .registry import query

# Pages of drawing operators: a line is three operators of its order's page, with frames of halves and wholes.
_OPS = """SELECT l_orderkey AS page, l_linenumber * 3 + i AS seq, CASE i WHEN 0 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'restore' WHEN l_suppkey % 3 = 1 THEN 'save' ELSE 'setFont' END WHEN 1 THEN 'transform'
  ELSE CASE WHEN l_partkey % 4 = 0 THEN 'paintImageXObject' WHEN l_partkey % 4 = 1 THEN 'paintInlineImageXObject' WHEN l_partkey % 4 = 2 THEN 'save' ELSE 'paintImageMaskXObject' END END AS op,
  {a} AS a, {b} AS b, {c} AS c, CASE WHEN l_linenumber % 3 = 0 THEN -1.0 ELSE 0.5 END AS d, CAST(l_suppkey % 7 AS DOUBLE) AS e, CAST(l_partkey % 11 AS DOUBLE) - 5 AS f FROM {source}"""
_PARTS = {"a": "CASE WHEN l_linenumber % 2 = 0 THEN 2.0 ELSE 1.0 END", "b": "CASE WHEN l_suppkey % 5 = 0 THEN 0.5 ELSE 0.0 END", "c": "CASE WHEN l_partkey % 3 = 0 THEN -1.0 ELSE 0.0 END"}


@query(f"""WITH RECURSIVE o AS ({_OPS.format(source='(SELECT *, unnest([0, 1, 2]) AS i FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL))', **_PARTS)}),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY seq) AS k FROM o),
w AS (SELECT page, 0::BIGINT AS k, NULL::INTEGER AS seq, false AS drawn, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]::DOUBLE[] AS m, []::DOUBLE[][] AS s FROM o GROUP BY page
UNION ALL SELECT n.page, n.k, n.seq::INTEGER, n.op LIKE 'paint%',
  CASE n.op WHEN 'restore' THEN coalesce(w.s[-1], [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]::DOUBLE[])
    WHEN 'transform' THEN [a * m[1] + b * m[3], a * m[2] + b * m[4], c * m[1] + d * m[3], c * m[2] + d * m[4], e * m[1] + f * m[3] + m[5], e * m[2] + f * m[4] + m[6]]::DOUBLE[] ELSE m END,
  CASE n.op WHEN 'save' THEN list_append(s, m) WHEN 'restore' THEN s[:-2] ELSE s END FROM w JOIN n ON n.page = w.page AND n.k = w.k + 1)
SELECT page, seq::BIGINT AS seq, least(m[5], m[5] + m[1], m[5] + m[3], m[5] + m[1] + m[3]) AS x0, least(m[6], m[6] + m[2], m[6] + m[4], m[6] + m[2] + m[4]) AS y0,
  greatest(m[5], m[5] + m[1], m[5] + m[3], m[5] + m[1] + m[3]) AS x1, greatest(m[6], m[6] + m[2], m[6] + m[4], m[6] + m[2] + m[4]) AS y1 FROM w WHERE drawn""")
def image_boxes(t) -> DataFrame:
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    s, p, n = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")
    first = F.when(s % 3 == 0, "restore").when(s % 3 == 1, "save").otherwise("setFont")
    last = F.when(p % 4 == 0, P.PAINT[0]).when(p % 4 == 1, P.PAINT[2]).when(p % 4 == 2, "save").otherwise(P.PAINT[1])
    numbers = [F.when(n % 2 == 0, 2.0).otherwise(1.0), F.when(s % 5 == 0, 0.5).otherwise(0.0), F.when(p % 3 == 0, -1.0).otherwise(0.0), F.when(n % 3 == 0, -1.0).otherwise(0.5), (s % 7).cast("double"), (p % 11).cast("double") - 5]
    three = F.array(*[F.struct((n * 3 + i).alias("seq"), op.alias("op"), (F.array(*numbers) if i == 1 else F.lit(None).cast("array<double>")).alias("args")) for i, op in enumerate((first, F.lit("transform"), last))])
    ops = lines.select(F.col("l_orderkey").alias("page"), F.explode(three).alias("x")).select("page", "x.*")
    # segments of eight places: most pages are several
    return P.image_boxes(ops, ["page"], 8)
