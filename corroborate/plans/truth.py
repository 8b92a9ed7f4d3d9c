"""Queries of ground-truth pairs and their metrics, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions import domain as D
from corroborate.operators import truth as G

from . import frames as T
from .registry import query

_K = "o_orderkey"
_NO = T._case(f"{_K} * 7", None, f"='P' || CAST({_K} % 50 AS STRING)", f"=' P ' || CAST({_K} % 50 AS STRING)", "")


def _side(letter: str, shift: int) -> dict[str, str]:
    k = f"({_K} + {shift} * ({_K} % 2))"
    return {
        "case_id": "o_custkey % 40", "ordinal": _K, "id": f"'{letter}' || CAST({_K} AS STRING)", "section": T._case(f"{_K} * 3", "1구간", " 1 구간", "2구간", None),
        "damage_name": T._case(f"{_K} * 5", "균열", "크랙", " Crack", "박락", "박리 ", "누수", "침출수", "", None), "part": T._case(k, "사면", "배수시설", None), "sub_part": T._SUB(f"{_K} * 11"), "location": T._PLACE(f"{_K} * 13"),
        "quantity": T._case(f"{k} * 19", "3m", None, "", "3 m", "5m"), "quantity_group": T._case(f"{k} * 23", "9m", None, "3m"), "repair_method": T._REPAIR(f"{k} * 17"),
        "g1": T._case(f"{_K} * 29", f"=CAST({_K} % 9 AS INT)", None), "g2": T._case(f"{_K} * 31", None, f"=CAST({_K} % 4 AS INT)", None),
    }


TRUTH = _side("T", 0) | {"n1": _NO, "n2": T._case(_K, None, "='P7'"), "expected": T._case(f"{_K} * 3", "matched", "conflict", None, "")}
FOUND = _side("F", 1) | {"n1": T._case(f"{_K} * 3", None, f"='Q' || CAST({_K} AS STRING)"), "n2": T._case(f"{_K} * 5", f"='Q' || CAST({_K} % 100 AS STRING)", None, "P7"), "cv_result": T._case(f"{_K} * 7", "matched", "conflict", "unsupported", None)}
TRUTH_PHOTOS = {"case_id": "o_custkey % 40", "ordinal": _K, "id": f"'X' || CAST({_K} AS STRING)", "photo_no": _NO, "page": f"CAST({_K} % 9 AS INT)", "n1": f"'T' || CAST({_K} AS STRING)", "n2": T._case(_K, None, f"='T' || CAST({_K} + 32 AS STRING)")}
FOUND_PHOTOS = {"case_id": "o_custkey % 40", "ordinal": _K, "id": f"'Q' || CAST({_K} AS STRING)", "photo_no": T._case(f"{_K} * 3", None, f"='P' || CAST({_K} % 50 AS STRING)", "", f"='P ' || CAST({_K} % 50 AS STRING)"), "page": f"CAST({_K} % 9 AS INT)"}
_KEPT = {"truth": f"{_K} % 5 > 0", "found": f"{_K} % 7 > 0", "tp": f"{_K} % 3 < 2", "fp": f"{_K} % 4 < 3"}


def _tables(t) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    orders = t("orders")
    show = lambda exprs, kept: orders.where(_KEPT[kept]).selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])
    pages = F.array_compact(F.array("g1", "g2"))
    truth = show(TRUTH, "truth").withColumns({"pages": pages, "photo_nos": T._texts("n1", "n2")})
    found = show(FOUND, "found").withColumns({"pages": pages, "photo_ids": T._texts("n1", "n2")})
    return truth, found, show(TRUTH_PHOTOS, "tp").withColumn("linked", T._texts("n1", "n2")), show(FOUND_PHOTOS, "fp")


def _name(x: str) -> str:
    y = f"lower({T.nrm(x)})"
    return f"CASE WHEN {y} IN ('균열', '크랙', 'crack') THEN '균열' WHEN {y} IN ('박리', '박락') THEN '박리' WHEN {y} IN ('누수', '침출수') THEN '누수' WHEN {y} IN ('파손', '손상') THEN '파손' WHEN {y} IN ('세굴', '세굴현상') THEN '세굴' ELSE {y} END"


_LISTS = "list_filter([n1, n2], lambda x: x IS NOT NULL) AS nos, list_filter([g1, g2], lambda x: x IS NOT NULL) AS pages"
_DAMAGE_KEY = f"{T.nrm('section')} AS k1, {_name('damage_name')} AS k2, {T.nrm('sub_part')} AS k3, coalesce({T.loc('location')}, '') AS k4"
_PHOTO_KEY = f"CASE WHEN {T.given('photo_no')} THEN 'n' || {T.nrm('photo_no')} ELSE 'p' || page END AS k"
_NTH = "row_number() OVER (PARTITION BY case_id, {k} ORDER BY ordinal) AS nth"
_SIDES = f"""t AS (SELECT *, {_NTH.format(k='k1, k2, k3, k4')} FROM (SELECT *, {_LISTS}, {_DAMAGE_KEY} FROM ({T.select(TRUTH)} WHERE {_KEPT['truth']}))),
f AS (SELECT *, {_NTH.format(k='k1, k2, k3, k4')} FROM (SELECT *, {_LISTS}, {_DAMAGE_KEY} FROM ({T.select(FOUND)} WHERE {_KEPT['found']}))),
tp AS (SELECT *, {_NTH.format(k='k')} FROM (SELECT *, list_filter([n1, n2], lambda x: x IS NOT NULL) AS linked, {_PHOTO_KEY} FROM ({T.select(TRUTH_PHOTOS)} WHERE {_KEPT['tp']}))),
fp AS (SELECT *, {_NTH.format(k='k')} FROM (SELECT *, {_PHOTO_KEY} FROM ({T.select(FOUND_PHOTOS)} WHERE {_KEPT['fp']})))"""
_JOIN = "coalesce(t.case_id, f.case_id) AS case_id, CASE WHEN f.id IS NULL THEN 'missed' WHEN t.id IS NULL THEN 'extra' ELSE 'matched' END AS side, t, f"
_TRUTH_SQL = f"""{_SIDES}, m AS (SELECT {_JOIN} FROM t FULL JOIN f ON t.case_id = f.case_id AND t.k1 = f.k1 AND t.k2 = f.k2 AND t.k3 = f.k3 AND t.k4 = f.k4 AND t.nth = f.nth),
pm AS (SELECT {_JOIN} FROM tp t FULL JOIN fp f ON t.case_id = f.case_id AND t.k = f.k AND t.nth = f.nth)"""


@query(f"WITH {_TRUTH_SQL} SELECT case_id, side, t.id AS truth_id, f.id AS found_id FROM m")
def ground_truth_pairs(t) -> DataFrame:
    truth, found, *_ = _tables(t)
    return G.damage_pairs(truth, found).select("case_id", "side", F.col("t.id").alias("truth_id"), F.col("f.id").alias("found_id"))


@query(f"WITH {_TRUTH_SQL} SELECT case_id, side, t.id AS truth_id, f.id AS found_id FROM pm")
def ground_truth_photo_pairs(t) -> DataFrame:
    pairs = G.photo_pairs(*_tables(t)[2:])
    return pairs.select("case_id", "side", F.col("t.id").alias("truth_id"), F.col("f.id").alias("found_id"))


_AMOUNT = lambda x: f"coalesce({x}.quantity, {x}.quantity_group)"
_AGREE = {
    "damage_name": f"({_name('t.damage_name')}) = ({_name('f.damage_name')})", "part": "t.part IS NOT DISTINCT FROM f.part", "sub_part": f"{T.nrm('t.sub_part')} = {T.nrm('f.sub_part')}",
    "location": f"coalesce({T.loc('t.location')}, '') = coalesce({T.loc('f.location')}, '')", "quantity": f"{T.nrm(_AMOUNT('t'))} = {T.nrm(_AMOUNT('f'))}", "repair_method": f"{T.nrm('t.repair_method')} = {T.nrm('f.repair_method')}",
}
_FIELDS_SQL = "fa AS (" + " UNION ALL ".join(f"SELECT case_id, '{n}' AS field, count_if({c}) AS matched, count(*) AS total, count_if({c}) / count(*) AS match_rate FROM m WHERE side = 'matched' GROUP BY 1" for n, c in _AGREE.items()) + ")"


@query(f"WITH {_TRUTH_SQL}, {_FIELDS_SQL} SELECT * FROM fa")
def ground_truth_field_accuracy(t) -> DataFrame:
    return G.field_accuracy(G.damage_pairs(*_tables(t)[:2]), ["case_id"])


def _prf(source: str) -> str:
    p, r = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"
    return f"SELECT case_id, tp, fp, fn, p AS precision, q AS recall, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f1 FROM (SELECT *, {p} AS p, {r} AS q FROM ({source}))"


_SETS = f"""ex AS (SELECT DISTINCT case_id, f.id AS own, no FROM (SELECT case_id, f, unnest(t.nos) AS no FROM m WHERE side = 'matched' UNION ALL
  SELECT m.case_id, f, tp.photo_no FROM m JOIN tp ON tp.case_id = m.case_id AND list_contains(tp.linked, t.id) WHERE side = 'matched'), LATERAL (SELECT {T.nrm('no')} AS no) n(no)),
ac AS (SELECT DISTINCT case_id, own, {T.nrm('coalesce(q.photo_no, pid)')} AS no FROM (SELECT case_id, f.id AS own, unnest(f.nos) AS pid FROM m WHERE side = 'matched') LEFT JOIN fp q USING (case_id) WHERE q.id = pid
  UNION SELECT case_id, own, {T.nrm('pid')} FROM (SELECT case_id, f.id AS own, unnest(f.nos) AS pid FROM m WHERE side = 'matched') x WHERE NOT EXISTS (SELECT 1 FROM fp WHERE fp.case_id = x.case_id AND fp.id = pid)),
pl AS ({_prf("SELECT c.case_id, count_if(ex.no IS NOT NULL AND ac.no IS NOT NULL) AS tp, count_if(ex.no IS NULL AND ac.no IS NOT NULL) AS fp, count_if(ac.no IS NULL AND ex.no IS NOT NULL) AS fn FROM (SELECT DISTINCT case_id FROM m WHERE side = 'matched') c LEFT JOIN (ex FULL JOIN ac USING (case_id, own, no)) USING (case_id) GROUP BY 1")})"""
_SETS = _SETS.replace("SELECT DISTINCT case_id, f.id AS own, no FROM (SELECT case_id, f, unnest", "SELECT DISTINCT x.case_id, x.f.id AS own, n.no FROM (SELECT case_id, f, unnest").replace("WHERE side = 'matched'), LATERAL (SELECT", "WHERE side = 'matched') x, LATERAL (SELECT").replace(T.nrm("no") + " AS no) n(no)", T.nrm("x.no") + ") n(no)")


@query(f"WITH {_TRUTH_SQL}, {_SETS} SELECT * FROM pl")
def ground_truth_photo_links(t) -> DataFrame:
    truth, found, truth_photos, found_photos = _tables(t)
    return G.photo_link_metrics(G.damage_pairs(truth, found), truth_photos, found_photos)


_COUNTS = "SELECT case_id, count_if(side = 'matched') AS tp, count_if(side = 'extra') AS fp, count_if(side = 'missed') AS fn FROM {m} GROUP BY 1"
_SHARES = ", ".join(f"count_if(f.cv_result = '{r}') AS \"{r}\"" for r in D.RESULT_LABEL)


@query(f"""WITH {_TRUTH_SQL}, {_FIELDS_SQL}, {_SETS}, da AS ({_prf(_COUNTS.format(m='m'))}), pa AS ({_prf(_COUNTS.format(m='pm'))}),
br AS (SELECT case_id, {_SHARES}, CASE WHEN count_if({T.given('t.expected')}) > 0 THEN count_if({T.given('t.expected')} AND t.expected IS NOT DISTINCT FROM f.cv_result) / count_if({T.given('t.expected')}) END AS accuracy FROM m WHERE side = 'matched' GROUP BY 1)
SELECT c.case_id, coalesce(da.f1, 0) AS damage_f1, coalesce(pa.f1, 0) AS photo_f1, coalesce(pl.f1, 0) AS link_f1, coalesce(pl.tp, 0) AS link_tp, coalesce(fa.match_rate, 0) AS quantity_rate, coalesce(br.matched, 0) AS matched, coalesce(br.conflict, 0) AS conflict, br.accuracy,
  CASE WHEN coalesce(da.f1, 0) >= 0.9 THEN 'GOOD' WHEN coalesce(da.f1, 0) >= 0.75 THEN 'WARNING' ELSE 'FAIL' END AS status
FROM (SELECT DISTINCT c_custkey % 45 AS case_id FROM customer) c LEFT JOIN da USING (case_id) LEFT JOIN pa USING (case_id) LEFT JOIN pl USING (case_id) LEFT JOIN (SELECT * FROM fa WHERE field = 'quantity') fa USING (case_id) LEFT JOIN br USING (case_id)""")
def ground_truth_bundle(t) -> DataFrame:
    out = G.validation_bundle(t("customer").select((F.col("c_custkey") % 45).alias("case_id")), *_tables(t))
    shown = [F.col(f"{c}.f1").alias(n) for c, n in (("detection", "damage_f1"), ("photo_extraction", "photo_f1"), ("photo_link", "link_f1"))]
    return out.select("case_id", *shown, F.col("photo_link.tp").alias("link_tp"), F.col("fields")["quantity"].alias("quantity_rate"), "matched", "conflict", "accuracy", "status")


_LABEL = lambda x: f"nullif(array_to_string(list_transform({x}.pages, lambda g: 'p.' || g), ', '), '')"
_SHOW = lambda x: f"coalesce({x}.damage_name, 'null') || ' / ' || coalesce({x}.sub_part, 'null') || ' / ' || coalesce({x}.location, 'null')"
_WRITTEN = lambda x, n: _AMOUNT(x) if n == "quantity" else f"{x}.{n}"
_ERRORS = " UNION ALL ".join(
    [f"SELECT case_id, 0 AS g, t.ordinal AS o, {k} AS i, '{kind[1]}' AS step, '{n}' AS field, '{kind[0]}' AS category, {_WRITTEN('t', n)} AS truth_value, {_WRITTEN('f', n)} AS found_value, {_LABEL('t')} AS truth_source, {_LABEL('f')} AS found_source, t.id AS damage_id FROM m WHERE side = 'matched' AND NOT ({_AGREE[n]})" for k, (n, kind) in enumerate(G.FIELDS.items())]
    + [f"SELECT case_id, 1, t.ordinal, 0, 'STEP 4', NULL, 'EXTRACTION_ERROR', {_SHOW('t')}, NULL, {_LABEL('t')}, NULL, t.id FROM m WHERE side = 'missed'", f"SELECT case_id, 2, f.ordinal, 0, 'STEP 4', NULL, 'EXTRACTION_ERROR', NULL, {_SHOW('f')}, NULL, {_LABEL('f')}, f.id FROM m WHERE side = 'extra'"]
    + ["SELECT case_id, 3, t.ordinal, 0, 'STEP 6', 'photo', 'PHOTO_EXTRACTION_ERROR', coalesce(t.photo_no, '-') || ' (p.' || t.page || ')', NULL, 'p.' || t.page, NULL, NULL FROM pm WHERE side = 'missed'", "SELECT case_id, 4, f.ordinal, 0, 'STEP 6', 'photo', 'PHOTO_EXTRACTION_ERROR', NULL, coalesce(f.photo_no, f.id) || ' (p.' || f.page || ')', NULL, 'p.' || f.page, NULL FROM pm WHERE side = 'extra'"]
)


@query(f"WITH {_TRUTH_SQL}, er AS ({_ERRORS}) SELECT * EXCLUDE (g, o, i), printf('ERR-%04d', row_number() OVER (PARTITION BY case_id ORDER BY g, o, i)) AS error_id FROM er")
def ground_truth_errors(t) -> DataFrame:
    truth, found, truth_photos, found_photos = _tables(t)
    return G.error_entries(G.damage_pairs(truth, found), G.photo_pairs(truth_photos, found_photos))


@query(f"WITH {_TRUTH_SQL}, er AS ({_ERRORS}) SELECT category, count(*) AS n FROM er GROUP BY 1")
def ground_truth_error_categories(t) -> DataFrame:
    truth, found, truth_photos, found_photos = _tables(t)
    return G.errors_by_category(G.error_entries(G.damage_pairs(truth, found), G.photo_pairs(truth_photos, found_photos)))
