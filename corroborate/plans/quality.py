"""Queries of typed change events between snapshots, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.operators import quality as Q

from . import frames as T
from .registry import query

_ID = "CASE WHEN o_orderkey % 13 = 0 THEN 'NEW-' ELSE 'R' END || CAST(o_orderkey AS STRING)"
_ROW = {"report_id": "o_custkey", "id": _ID, "k": "o_orderkey", "damage_name": T._NAME("o_orderkey * 7"), "section": T._case("o_orderkey * 3", "1구간", None), "part": T._case("o_orderkey", "사면", "기타"), "location": T._PLACE("o_orderkey * 13")}
_BEFORE, _AFTER = "o_orderkey % 11 > 0", "o_orderkey % 7 > 0"
#: Entries of the lists by condition on k: fields in the order of ``quality.LISTS``.
_OVERRIDES = {
    "before": [("k % 3 = 0", "location", "'a'", "'b'", "'t1'"), ("k % 10 = 0", "location", "'a'", "'bb'", "'t2'"), ("k % 17 = 0", "status", "'review'", "'excluded'", "'t3'")],
    "after": [("k % 3 < 2", "location", "'a'", "'c'", "CASE WHEN k % 2 = 0 THEN 't1' ELSE 't2' END"), ("k % 5 = 0", "status", "'review'", "'excluded'", "'t3'"), ("k % 6 = 0", "status", "'review'", "'confirmed'", "'t5'"), ("k % 13 < 2", "notes", "NULL", "'y'", "'t4'"), ("k % 19 = 0", "quantity", "'3m'", "NULL", "NULL")],
}
_ENRICHED = {"before": [("k % 2 = 0", "quantity", "'3m'", "'t1'")], "after": [("k % 8 < 6", "quantity", "'3m'", "'t1'"), ("k % 4 = 0", "quantity", "'5m'", "'t2'"), ("k % 9 = 0", "notes", "'n'", "'t1'")]}
_SETTLED = {
    "before": [("k % 2 = 0", "location", "'1m'", "CASE WHEN k % 4 = 0 THEN 't1' END")],
    "after": [("k % 3 > 0", "location", "'1m'", "CASE WHEN k % 5 < 2 THEN 't1' WHEN k % 5 = 2 THEN 't2' END"), ("k % 7 = 1", "part", "NULL", "'t1'")],
}


def _list(entries: list[Column], kind: str) -> Column:
    return F.array_compact(F.array(*entries)).cast(kind)


def _snapshot(t, side: str) -> DataFrame:
    rows = t("orders").where(_BEFORE if side == "before" else _AFTER).selectExpr(*[f"{e} AS {n}" for n, e in _ROW.items()])
    text = lambda x: F.expr(x).cast("string")
    over = [F.when(F.expr(c), F.struct(F.lit(f).alias("field"), text(o).alias("original"), text(n).alias("current"), text(at).alias("changed_at"))) for c, f, o, n, at in _OVERRIDES[side]]
    rich = [F.when(F.expr(c), F.struct(F.lit(f).alias("field"), text(v).alias("value"), text(at).alias("applied_at"))) for c, f, v, at in _ENRICHED[side]]
    decided = lambda at: F.when(text(at).isNotNull(), F.struct(F.lit("v").alias("value"), F.lit("의견").alias("reason"), text(at).alias("decided_at")))
    done = [F.when(F.expr(c), F.struct(F.lit(f).alias("field"), text(m).alias("main"), decided(at).alias("resolved"))) for c, f, m, at in _SETTLED[side]]
    n = F.expr("k % 3" if side == "before" else "k % 5").cast("int")
    step = lambda i: F.struct(F.concat(F.lit("h"), i.cast("string")).alias("at"), F.when((i + F.col("k")) % 2 == 0, "review_completed").otherwise("edited").alias("action"))
    history = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), step))
    return rows.withColumns({"overrides": _list(over, Q.LISTS["overrides"]), "history": history, "enrichments": F.when(F.col("k") % 23 > 0, _list(rich, Q.LISTS["enrichments"])), "conflicts": _list(done, Q.LISTS["conflicts"])})


def _sql_side(side: str) -> str:
    entry = lambda c, names, values: f"CASE WHEN {c} THEN {{{', '.join(f'{n!r}: {v}' for n, v in zip(names, values))}}} END"
    text = lambda *v: [f"CAST({x} AS VARCHAR)" for x in v]
    over = ", ".join(entry(c, ("field", "original", "current", "changed_at"), [f"'{f}'", *text(o, n, at)]) for c, f, o, n, at in _OVERRIDES[side])
    rich = ", ".join(entry(c, ("field", "value", "applied_at"), [f"'{f}'", *text(v, at)]) for c, f, v, at in _ENRICHED[side])
    done = ", ".join(entry(c, ("field", "main", "decided_at"), [f"'{f}'", *text(m, at)]) for c, f, m, at in _SETTLED[side])
    given = lambda x: f"list_filter([{x}], lambda e: e IS NOT NULL)"
    steps = f"list_transform(range(1, {'k % 3' if side == 'before' else 'k % 5'} + 1), lambda i: {{'n': i, 'at': 'h' || i, 'action': CASE WHEN (i + k) % 2 = 0 THEN 'review_completed' ELSE 'edited' END}})"
    return f"SELECT *, {given(over)} AS overrides, {steps} AS history, CASE WHEN k % 23 > 0 THEN {given(rich)} ELSE [] END AS enrichments, {given(done)} AS conflicts FROM ({T.select(_ROW)} WHERE {_BEFORE if side == 'before' else _AFTER})"


_CAT = lambda f: "CASE " + f + " " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in Q.CATEGORY.items()) + " END"
_PAIRED = "FROM b JOIN a ON a.report_id = b.report_id AND a.id = b.id"
_EVENTS = f"""b AS ({_sql_side('before')}), a AS ({_sql_side('after')}),
ov AS (SELECT a.id, b.overrides AS was, unnest(a.overrides) AS o {_PAIRED}), new_ov AS (SELECT id, o FROM (SELECT *, list_filter(was, lambda p: p.field = o.field)[-1] AS p FROM ov) WHERE p IS NULL OR p.changed_at IS DISTINCT FROM o.changed_at),
hs AS (SELECT a.id, len(b.history) AS n, unnest(a.history) AS h {_PAIRED}), en AS (SELECT a.id, b.enrichments AS was, unnest(a.enrichments) AS e {_PAIRED}), cf AS (SELECT a.id, b.conflicts AS was, unnest(a.conflicts) AS c {_PAIRED}),
ev AS (SELECT id, 'damage_added' AS type, 'now' AS "at", 'manual' AS source, NULL AS field, NULL AS "from", NULL AS "to", 'MISSING_DAMAGE' AS category, 'UNKNOWN' AS classification, NULL AS reason, concat_ws('/', damage_name, section, part, location) AS snapshot FROM a WHERE id LIKE 'NEW-%' AND id NOT IN (SELECT id FROM b)
UNION ALL SELECT id, 'damage_deleted', 'now', 'manual', NULL, NULL, NULL, NULL, NULL, NULL, concat_ws('/', damage_name, section, part, location) FROM b WHERE id NOT IN (SELECT id FROM a)
UNION ALL SELECT id, CASE WHEN o.field = 'status' AND o.current = 'excluded' THEN 'status_excluded' ELSE 'field_edited' END, o.changed_at, 'manual', o.field, o.original, o.current, CASE WHEN NOT (o.field = 'status' AND o.current IS NOT DISTINCT FROM 'excluded') THEN {_CAT('o.field')} END, 'UNKNOWN', NULL, NULL FROM new_ov
UNION ALL SELECT id, 'bulk_reviewed', h.at, 'manual', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM hs WHERE h.n > n AND h.action = 'review_completed'
UNION ALL SELECT id, 'cross_validation_enriched', e.applied_at, 'ai', e.field, NULL, e.value, {_CAT('e.field')}, NULL, NULL, NULL FROM en WHERE len(list_filter(was, lambda p: p.field = e.field AND p.applied_at = e.applied_at)) = 0
UNION ALL SELECT id, 'cross_validation_resolved', c.decided_at, 'manual', c.field, c.main, 'v', 'CROSS_VALIDATION_ERROR', 'UNKNOWN', '의견', NULL FROM cf WHERE c.decided_at IS NOT NULL AND len(list_filter(was, lambda p: p.field = c.field AND p.decided_at = c.decided_at)) = 0)"""


@query(f"WITH {_EVENTS} SELECT id AS record_id, * EXCLUDE (id) FROM ev")
def record_quality_events(t) -> DataFrame:
    out = Q.record_events(_snapshot(t, "before"), _snapshot(t, "after"), F.lit("now"))
    return out.drop("report_id").withColumn("snapshot", F.when(F.col("snapshot").isNotNull(), F.concat_ws("/", *[F.col(f"snapshot.{c}") for c in Q.SNAPSHOT])))


@query(f"WITH {_EVENTS} SELECT category, type, count(*) AS n FROM ev GROUP BY ALL")
def quality_events_by_category(t) -> DataFrame:
    return Q.record_events(_snapshot(t, "before"), _snapshot(t, "after"), F.lit("now")).groupBy("category", "type").agg(F.count("*").alias("n"))


_LINKS = {"before": "CASE WHEN l_linenumber % 3 > 0 THEN 'R' || CAST(l_partkey % 9 AS STRING) END", "after": "CASE WHEN l_linenumber % 4 > 0 THEN 'R' || CAST((l_partkey + l_linenumber % 2) % 9 AS STRING) END"}
_PHOTO_ID = "'P' || CAST(l_orderkey AS STRING)"


@query(f"""WITH x AS (SELECT l_orderkey % 100 AS report_id, {_PHOTO_ID} AS photo_id, {_LINKS['before']} AS was, {_LINKS['after']} AS now, l_orderkey % 3 AS k, l_orderkey % 5 AS j FROM lineitem),
y AS (SELECT report_id, photo_id, list_distinct(list(was)) AS a, list_distinct(list(now)) AS b FROM x WHERE k > 0 AND j > 0 AND k = 2 GROUP BY ALL),
z AS (SELECT report_id, photo_id, unnest(b) AS id, 'photo_linked' AS type, a AS other FROM y UNION ALL SELECT report_id, photo_id, unnest(a), 'photo_unlinked', b FROM y)
SELECT id AS record_id, type, CASE WHEN type = 'photo_unlinked' THEN photo_id END AS "from", CASE WHEN type = 'photo_linked' THEN photo_id END AS "to", 'PHOTO_LINK_ERROR' AS category FROM z WHERE id IS NOT NULL AND NOT list_contains(other, id)""")
def photo_quality_events(t) -> DataFrame:
    lines = t("lineitem").selectExpr("l_orderkey % 100 AS report_id", f"{_PHOTO_ID} AS photo_id", f"{_LINKS['before']} AS was", f"{_LINKS['after']} AS now", "l_orderkey % 3 AS k", "l_orderkey % 5 AS j")
    side = lambda kept, ids: lines.where(kept).groupBy("report_id", "photo_id", "k").agg(F.collect_list(ids).alias("linked"))
    after = side("j > 0", "now").withColumn("match_source", F.when(F.col("k") == 2, "manual").when(F.col("k") == 1, "auto"))
    return Q.photo_events(side("k > 0", "was"), after, F.lit("now")).select("record_id", "type", "from", "to", "category")


@query("""WITH s AS (SELECT user_id, CASE WHEN arg_min(coalesce(value, 0), event_id) >= 60 THEN 'completed' WHEN arg_min(coalesce(value, 0), event_id) >= 40 THEN 'finalized' ELSE 'in_progress' END AS was,
  CASE WHEN arg_max(coalesce(value, 0), event_id) >= 60 THEN 'completed' WHEN arg_max(coalesce(value, 0), event_id) >= 30 THEN 'finalized' ELSE 'in_progress' END AS now, CASE WHEN user_id % 2 = 0 THEN 'f' END AS f FROM events GROUP BY 1)
SELECT user_id AS report_id, CASE now WHEN 'completed' THEN 'review_completed' ELSE 'finalized' END AS type, CASE WHEN now = 'finalized' THEN coalesce(f, 'now') ELSE 'now' END AS "at" FROM s WHERE now <> was AND now <> 'in_progress'""")
def session_quality_events(t) -> DataFrame:
    value = F.coalesce("value", F.lit(0.0))
    by = t("events").groupBy(F.col("user_id").alias("report_id")).agg(F.min_by(value, "event_id").alias("a"), F.max_by(value, "event_id").alias("b"))
    status = lambda v, least: F.when(F.col(v) >= 60, "completed").when(F.col(v) >= least, "finalized").otherwise("in_progress").alias("review_status")
    after = by.select("report_id", status("b", 30), F.when(F.col("report_id") % 2 == 0, "f").alias("finalized_at"))
    return Q.session_events(by.select("report_id", status("a", 40)), after, F.lit("now")).select("report_id", "type", "at")


@query("""SELECT doc_id, CASE WHEN contains(text, 'AI') OR contains(text, '오류') THEN 'AI_ERROR_CANDIDATE' WHEN contains(text, '판단') THEN 'USER_JUDGMENT_CHANGE' WHEN contains(text, '표현') THEN 'SOURCE_INTERPRETATION_DIFFERENCE' ELSE 'UNKNOWN' END AS class
FROM (SELECT doc_id, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN '판단 오류' WHEN 1 THEN '표현 판단' WHEN 2 THEN '표현' ELSE '' END AS text FROM documents)""")
def change_reasons(t) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(k % 4 == 0, "판단 오류").when(k % 4 == 1, "표현 판단").when(k % 4 == 2, "표현").otherwise(""))
    return t("documents").select("doc_id", Q.reason_class(text).alias("class"))
