"""Queries of linking, cross-checking and merging inspection records, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions import domain as D
from corroborate.operators import linkage as L
from corroborate.operators import matching as M
from corroborate.operators import merging as G

from . import frames as T
from .registry import query

_HOLDS = {
    "photo_no": T.numbered("p.photo_no"), "damage_name": T.same("p.damage_name", "r.damage_name"),
    "caption": f"({T.given('p.caption')} AND {T.given('r.damage_name')} AND (contains(p.caption, r.damage_name) OR (r.sub_part <> '-' AND contains(p.caption, r.sub_part))))",
    "part": "coalesce(p.part = r.part, false)", "sub_part": T.same("p.sub_part", "r.sub_part"), "location": "coalesce(p.nl = r.nl, false)",
    "in_range": f"(NOT coalesce(p.nl = r.nl, false) AND {T.within('p.nl', 'r.nl')})", "section": T.same("p.section", "r.section"),
    "ocr": f"(({T.given('r.location')} AND coalesce(contains(p.ocr_text, r.location), false)) OR (r.sub_part <> '-' AND coalesce(contains(p.ocr_text, r.sub_part), false)))",
    "context": "(r.sub_part <> '-' AND coalesce(contains(p.nearby_text, r.sub_part), false))", "vision": f"({T.given('p.vision_type')} AND contains(p.vision_type, r.damage_name))",
}
_SCORE = "least(105, " + " + ".join(f"CASE WHEN {c} THEN {M.PHOTO_WEIGHTS[n]} ELSE 0 END" for n, c in _HOLDS.items()) + ")"
_KNOWN = f"({T.given('p.sub_part')} AND r.sub_part <> '-')"
_LIKE = f"{T.nrm('p.sub_part')} = {T.nrm('r.sub_part')}"
_CONFLICT = f"((({T.numbered('p.photo_no')} OR ({_KNOWN} AND {_LIKE})) AND coalesce(p.nl <> r.nl, false) AND NOT {T.within('p.nl', 'r.nl')}) OR ({T.numbered('p.photo_no')} AND {_KNOWN} AND NOT {_LIKE}))"
_PAIRS = f"""{T.R_SQL}, {T.P_SQL},
s AS (SELECT p.report_id, p.photo_id, r.id, {_SCORE} AS score, {T.names(_HOLDS)} AS reasons, {_CONFLICT} AS conflict FROM p JOIN r USING (report_id)),
x AS (SELECT *, score / 105 AS confidence, CASE WHEN score / 105 >= 0.9 AND NOT conflict THEN 'confirmed' WHEN score / 105 >= 0.7 OR conflict THEN 'review' ELSE 'unmatched' END AS status FROM s WHERE score > 0)"""
_RESULTS = f"""{_PAIRS}, b AS (SELECT report_id, photo_id, max(confidence) AS best, bool_or(status = 'confirmed') AS sure, bool_or(status = 'review') AS maybe, list(id ORDER BY id) FILTER (status = 'confirmed') AS ids FROM x GROUP BY ALL),
q AS (SELECT p.report_id, p.photo_id, p.manual, p.photo_no, p.page, CASE WHEN manual THEN match_status WHEN sure THEN 'confirmed' WHEN maybe THEN 'review' ELSE 'unmatched' END AS match_status, CASE WHEN NOT manual THEN best END AS confidence,
  CASE WHEN manual THEN [l1] ELSE coalesce(ids, []) END AS linked, CASE WHEN manual THEN 'manual' ELSE 'auto' END AS match_source,
  CASE WHEN manual THEN status WHEN sure THEN 'confirmed' WHEN status = 'failed' THEN 'failed' ELSE 'review' END AS status FROM p LEFT JOIN b ON b.report_id = p.report_id AND b.photo_id = p.photo_id),
l AS (SELECT report_id, unnest(linked) AS id, photo_id FROM q)"""


def _pairs(t) -> DataFrame:
    return M.photo_pairs(T.photos(t), T.records(t))


@query(f"WITH {_PAIRS} SELECT photo_id, id, score::INT AS score, reasons, conflict, status FROM x")
def photo_record_scores(t) -> DataFrame:
    return _pairs(t).select("photo_id", "id", "score", F.array_join("reasons", ",").alias("reasons"), "conflict", "status")


@query(f"WITH {_PAIRS} SELECT photo_id, id, score::INT AS score, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY report_id, photo_id ORDER BY score DESC, id) AS k FROM x) WHERE k <= 5")
def photo_top_candidates(t) -> DataFrame:
    return L.top_k(_pairs(t), ["report_id", "photo_id"], [F.desc("score"), F.asc("id")], 5).select("photo_id", "id", "score", "rank")


@query(f"WITH {_RESULTS} SELECT photo_id, match_status, round(confidence, 9) AS confidence, array_to_string(linked, ',') AS linked, match_source, status FROM q")
def photo_match_results(t) -> DataFrame:
    out = M.photo_results(T.photos(t), _pairs(t))
    return out.select("photo_id", "match_status", F.round("confidence", 9).alias("confidence"), F.array_join("linked", ",").alias("linked"), "match_source", "status")


_STATUS = f"""{_RESULTS}, w AS (SELECT report_id, id, bool_or(conflict) AS bad FROM (SELECT x.report_id, x.id, x.conflict FROM x JOIN p USING (report_id, photo_id) WHERE NOT manual AND (x.status <> 'unmatched' OR conflict)
  UNION ALL SELECT report_id, c1, c_conflict FROM p WHERE manual AND c1 IS NOT NULL AND (c_score / 105 >= 0.7 OR c_conflict)) GROUP BY ALL),
g AS (SELECT report_id, id, string_agg(photo_id, ',' ORDER BY photo_id) AS ids, count(*) AS n FROM l GROUP BY ALL),
y AS (SELECT r.*, coalesce(ids, '') AS photo_ids, coalesce(g.n, 0) AS n_photos, CASE WHEN ids IS NOT NULL THEN 'confirmed' WHEN no_photo THEN 'noPhoto' WHEN bad THEN 'conflict' WHEN bad IS NOT NULL THEN 'review' ELSE 'noPhoto' END AS photo_status
  FROM r LEFT JOIN g ON g.report_id = r.report_id AND g.id = r.id LEFT JOIN w ON w.report_id = r.report_id AND w.id = r.id)"""


def linked_records(t) -> tuple[DataFrame, DataFrame]:
    pairs = _pairs(t)
    photos = M.photo_results(T.photos(t), pairs)
    return M.record_links(T.records(t), photos, pairs), photos


@query(f"WITH {_STATUS} SELECT id, photo_ids, photo_status FROM y")
def record_photo_status(t) -> DataFrame:
    return linked_records(t)[0].select("id", F.array_join("photo_ids", ",").alias("photo_ids"), "photo_status")


@query(f"""WITH {_RESULTS} SELECT id, photo_id, 'linked' AS kind, NULL::INT AS score FROM l JOIN r USING (report_id, id)
UNION ALL SELECT id, photo_id, 'candidate', score::INT FROM x WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.report_id = x.report_id AND l.id = x.id AND l.photo_id = x.photo_id)""")
def inspector_links(t) -> DataFrame:
    pairs = _pairs(t)
    keys = ["report_id", "id", "photo_id"]
    links = M.photo_results(T.photos(t), pairs).select("report_id", F.explode("linked").alias("id"), "photo_id")
    linked = links.join(T.records(t).select("report_id", "id"), ["report_id", "id"], "left_semi").select("id", "photo_id", F.lit("linked").alias("kind"), F.lit(None).cast("int").alias("score"))
    return linked.unionByName(pairs.join(links, keys, "left_anti").select("id", "photo_id", F.lit("candidate").alias("kind"), "score"))


def _step(k: int) -> str:
    """One document of the fold in SQL."""
    at = "coalesce(c.nl = r.nl, false)"
    amount = f"({T.given('c.quantity')} AND ({T.same('c.quantity', 'r.quantity_group')} OR {T.same('c.quantity', 'r.quantity')}))"
    holds = {
        "damage_name": T.same("c.damage_name", "r.damage_name"), "sub_part": T.same("c.sub_part", "r.sub_part"), "location": at, "section": T.same("c.section", "r.section"),
        "part": "coalesce(c.part = r.part, false)", "repair_method": T.same("c.repair_method", "r.repair_method"), "quantity": amount, "photo_no": T.numbered("c.photo_no"),
    }
    score = " + ".join(f"CASE WHEN {c} THEN {M.EVIDENCE_WEIGHTS[n]} ELSE 0 END" for n, c in holds.items())
    differ = lambda f: f"({T.given(f'c.{f}')} AND {T.given(f'r.{f}')} AND {T.nrm(f'c.{f}')} <> {T.nrm(f'r.{f}')})"
    anchor = f"({holds['sub_part']} OR {holds['photo_no']})"
    apart = {"location": "coalesce(c.nl <> r.nl, false)"} | {f: differ(f) for f in ("damage_name", "repair_method", "quantity")}
    conflicts = f"CASE WHEN {anchor} THEN {T.names(apart)} ELSE '' END"
    text = {"location": ("r.location", "c.location"), "damage_name": ("r.damage_name", "c.damage_name"), "repair_method": ("r.repair_method", "c.repair_method"), "quantity": ("coalesce(r.quantity, r.quantity_group, '')", "c.quantity")}
    values = "concat_ws(';', " + ", ".join(f"CASE WHEN {anchor} AND {c} THEN '{f}=' || {text[f][0]} || '>' || {text[f][1]} || '@{k}:' || c.seq END" for f, c in apart.items()) + ")"
    matched = T.names({n: c for n, c in holds.items() if n != "photo_no"})
    scored = f"""SELECT r.*, coalesce({score}, 0) AS score, {conflicts} AS bad, {matched} AS hits, ({anchor} OR {at}) AS fills, {T.same('c.quantity', 'r.quantity_group')} AS sure,
      {values} AS vals_new, c.seq AS c_seq, c.damage_name AS c_damage_name, c.sub_part AS c_sub_part, c.quantity AS c_quantity, c.repair_method AS c_repair_method,
      row_number() OVER (PARTITION BY r.report_id, r.id ORDER BY coalesce({score}, 0) DESC, c.seq) AS rk FROM f{k} r LEFT JOIN e c ON c.report_id = r.report_id AND c.document_no = {k}"""
    good = "(score >= 60 AND bad = '')"
    blank = lambda x: f"coalesce(trim({x}), '') IN ('', '-')"
    fits = {f: f"({good} AND fills AND {blank(f)} AND NOT {blank('c_' + f)} AND o1 IS DISTINCT FROM '{f}'" + (f" AND NOT {T.given('quantity_group')})" if f == "quantity" else ")") for f in M.FILLABLE}
    new = ", ".join(f"CASE WHEN {c} THEN c_{f} ELSE {f} END AS {f}" for f, c in fits.items())
    return f"""f{k + 1} AS (SELECT * EXCLUDE (score, bad, vals_new, c_seq, hits, fills, sure, c_damage_name, c_sub_part, c_quantity, c_repair_method, rk) REPLACE ({new},
      CASE WHEN score > 0 THEN concat_ws(',', nullif(matched, ''), nullif(hits, '')) ELSE matched END AS matched, CASE WHEN score > 0 THEN concat_ws(',', nullif(conflicts, ''), nullif(bad, '')) ELSE conflicts END AS conflicts,
      concat_ws(',', nullif(filled, ''), nullif({T.names(fits)}, '')) AS filled, n_matched + {good}::INT AS n_matched, group_confirmed OR ({good} AND sure) AS group_confirmed,
      CASE WHEN score > 0 AND bad <> '' THEN concat_ws(';', nullif(vals, ''), vals_new) ELSE vals END AS vals, concat_ws(';', nullif(ev, ''), CASE WHEN score > 0 AND bad <> '' THEN '{k}:' || c_seq || ':conflict' WHEN {good} THEN '{k}:' || c_seq || ':matched' END) AS ev,
      concat_ws(';', nullif(enr, ''), {", ".join(f"CASE WHEN {c} THEN '{f}=' || c_{f} || '@{k}:' || c_seq END" for f, c in fits.items())}) AS enr) FROM ({scored}) WHERE rk = 1)"""


_FOLD = f"""{T.R_SQL}, {T.E_SQL}, f0 AS (SELECT *, '' AS matched, '' AS conflicts, '' AS filled, 0 AS n_matched, false AS group_confirmed, '' AS vals, '' AS ev, '' AS enr FROM r), {_step(0)}, {_step(1)}, {_step(2)},
c AS (SELECT *, CASE WHEN conflicts <> '' THEN 'conflict' WHEN n_matched > 0 THEN 'matched' WHEN report_id IN (SELECT report_id FROM e) THEN 'missingInAdditional' ELSE 'unsupported' END AS cv_result,
  array_to_string(list_sort(list_distinct(list_filter(string_split(matched, ','), lambda m: m <> ''))), ',') AS matched_fields FROM f3)"""


def checked_records(t) -> DataFrame:
    return M.cross_check(T.records(t), T.evidence(t))


@query(f"""WITH {_FOLD} SELECT id, damage_name, sub_part, quantity, repair_method, cv_result, n_matched::INT AS n_evidence, conflicts, filled, matched_fields, group_confirmed,
  round(CASE WHEN conflicts <> '' THEN 0.4 WHEN n_matched > 0 THEN least(0.98, 0.6 + 0.15 * n_matched + 0.02 * len(list_filter(string_split(filled, ','), lambda m: m <> ''))) ELSE 0 END::DOUBLE, 6) AS confidence FROM c""")
def crosscheck_fold(t) -> DataFrame:
    joined = {f: F.array_join(g, ",").alias(f) for f, g in (("conflicts", "cv_conflicts"), ("filled", "filled"), ("matched_fields", "matched_fields"))}
    return checked_records(t).select("id", *M.FILLABLE, "cv_result", "n_evidence", *joined.values(), "group_confirmed", F.round("cv_confidence", 6).alias("confidence"))


_STATES = M.CHECKED


@query(f"""WITH {_FOLD} SELECT * FROM (SELECT id, field, CASE WHEN list_contains(string_split(conflicts, ','), field) THEN 'conflict' WHEN list_contains(string_split(filled, ','), field) THEN 'enriched'
  WHEN list_contains(string_split(matched_fields, ','), field) OR (field = 'quantity' AND group_confirmed) THEN 'matched' END AS state FROM c, (SELECT unnest({_STATES}) AS field)) WHERE state IS NOT NULL""")
def crosscheck_field_states(t) -> DataFrame:
    return M.field_states(checked_records(t), _STATES).select("id", "field", "state")


@query(f"""WITH {_FOLD}, v AS (SELECT *, array_to_string(list_distinct(list_filter(string_split(conflicts, ','), lambda f: f NOT IN ('', 'location'))), ',') AS open FROM c)
SELECT id, CASE WHEN n % 2 = 0 THEN '77m' ELSE location END AS location, CASE WHEN n % 2 = 1 THEN cv_result WHEN open <> '' THEN 'conflict' ELSE 'matched' END AS cv_result FROM v""")
def crosscheck_resolved(t) -> DataFrame:
    decisions = T.records(t).where("n % 2 = 0").select("report_id", "id", F.lit("location").alias("field"), F.lit("77m").alias("value"))
    return M.resolve_conflict(checked_records(t), decisions).select("id", "location", "cv_result")


@query(f"WITH {_FOLD} SELECT id, ev AS evidence, vals AS conflicts, enr AS enrichments FROM c")
def crosscheck_evidence(t) -> DataFrame:
    place = lambda x: F.concat(x["document_no"].cast("string"), F.lit(":"), x["seq"].cast("string"))
    shown = {
        "evidence": F.transform("cv_evidence", lambda e: F.concat(place(e), F.lit(":"), e["result"])), "conflicts": F.transform("cv_values", lambda v: F.concat(v["field"], F.lit("="), v["main"], F.lit(">"), v["other"], F.lit("@"), place(v))),
        "enrichments": F.transform("cv_enrichments", lambda v: F.concat(v["field"], F.lit("="), v["value"], F.lit("@"), place(v))),
    }
    return checked_records(t).select("id", *[F.array_join(c, ";").alias(n) for n, c in shown.items()])


def _earlier(t) -> DataFrame:
    """What a run before left: decisions on places and names, an open conflict, a filled quantity."""
    done = lambda f, value: F.struct(F.lit(f).alias("field"), F.lit("a").alias("main"), F.lit("b").alias("other"), F.lit(0).alias("document_no"), F.lit(1).cast("long").alias("seq"), value.cast("struct<value:string,reason:string,decided_at:string>").alias("resolved"))
    yes, no = F.struct(F.lit("v"), F.lit("why"), F.lit("t")), F.lit(None)
    k = F.col("n") % 4
    conflicts = F.array_compact(F.array(F.when(k == 2, done("location", no)), F.when(k.isin(0, 2), done("location", yes)), F.when(k == 1, done("damage_name", yes))))
    filled = F.when(F.col("n") % 3 == 0, F.array(F.struct(F.lit("quantity").alias("field"), F.lit("3m").alias("value"), F.lit(0).alias("document_no"), F.lit(1).cast("long").alias("seq"))))
    return T.records(t).where("n % 5 > 0").select("report_id", "id", conflicts.alias("conflicts"), filled.alias("enrichments"), (F.col("n") % 7 == 0).alias("group_confirmed"))


_FIELD = "string_split(v, '=')[1]"
_MEMORY = f"""{_FOLD}, m AS (SELECT *, list_filter(string_split(conflicts, ','), lambda f: f <> '') AS cf, CASE WHEN n % 5 = 0 THEN '' WHEN n % 4 IN (0, 2) THEN 'location' WHEN n % 4 = 1 THEN 'damage_name' ELSE '' END AS done,
  n % 5 > 0 AND n % 3 = 0 AS had, group_confirmed OR (n % 5 > 0 AND n % 7 = 0) AS grp FROM c),
w AS (SELECT *, list_filter(cf, lambda f: f <> done) AS open, list_filter(string_split(filled, ','), lambda f: f <> '') || CASE WHEN had THEN ['quantity'] ELSE [] END AS rich FROM m)"""
_NEXT = "CASE WHEN len(open) > 0 THEN 'conflict' WHEN n_matched > 0 THEN 'matched' WHEN report_id IN (SELECT report_id FROM e) THEN 'missingInAdditional' ELSE 'unsupported' END"
_STATE_OF = "CASE WHEN list_contains({open}, field) THEN 'conflict' WHEN list_contains(rich, field) THEN 'enriched' WHEN list_contains(cf, field) OR list_contains(string_split(matched_fields, ','), field) OR (field = 'quantity' AND grp) THEN 'matched' END"


@query(f"""WITH {_MEMORY} SELECT id, {_NEXT} AS cv_result, len(rich) AS n_enrichments, len(open) AS n_open, (SELECT string_agg(field || ':' || s, ',' ORDER BY i) FROM (SELECT i, field, {_STATE_OF.format(open='open')} AS s FROM (SELECT unnest({M.CHECKED}) AS field, unnest(range(7)) AS i)) WHERE s IS NOT NULL) AS states,
  round(CASE WHEN len(open) > 0 THEN 0.4 WHEN n_matched > 0 THEN least(0.98, 0.6 + 0.15 * n_matched + 0.02 * (len(rich) - had::INT)) ELSE 0 END::DOUBLE, 6) AS confidence FROM w""")
def crosscheck_second_run(t) -> DataFrame:
    out = M.remember(checked_records(t), _earlier(t))
    states = F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{f}:"), F.try_element_at("field_states", F.lit(f))) for f in M.CHECKED])), ",")
    return out.select("id", "cv_result", F.size("enrichments").alias("n_enrichments"), F.size(M._open(F.col("conflicts"))).alias("n_open"), F.nullif(states, F.lit("")).alias("states"), F.round("cv_confidence", 6).alias("confidence"))


@query(f"""WITH {_MEMORY} SELECT id, CASE WHEN n % 2 = 0 THEN '77m' ELSE location END AS location, CASE WHEN n % 2 = 1 THEN {_NEXT} WHEN len(list_filter(open, lambda f: f <> 'location')) > 0 THEN 'conflict' ELSE 'matched' END AS cv_result,
  CASE WHEN n % 2 = 0 THEN 'matched' ELSE (SELECT {_STATE_OF.format(open='open')} FROM (SELECT 'location' AS field)) END AS location_state FROM w""")
def crosscheck_settled(t) -> DataFrame:
    kept = T.records(t).where("n % 2 = 0").select("report_id", "id", F.lit("location").alias("field"))
    decisions = kept.select("*", F.lit("1m").alias("value"), F.lit(None).cast("string").alias("reason"), F.lit("t1").alias("decided_at")).unionByName(kept.select("*", F.lit("77m").alias("value"), F.lit("r").alias("reason"), F.lit("t2").alias("decided_at")))
    out = M.settle(M.remember(checked_records(t), _earlier(t)), decisions)
    return out.select("id", "location", "cv_result", F.try_element_at("field_states", F.lit("location")).alias("location_state"))


@query(f"""WITH {T.R_SQL}, {T.E_SQL}, few AS (SELECT * FROM r WHERE n % 4 = 0), left_ AS (SELECT * FROM e WHERE ({T.given('damage_name')} OR {T.given('location')}) AND NOT EXISTS (SELECT 1 FROM few r WHERE r.report_id = e.report_id
  AND ({T.same('e.sub_part', 'r.sub_part')} OR coalesce(e.nl = r.nl, false) OR {T.numbered('e.photo_no')})))
SELECT report_id, source_type, seq, damage_name, location FROM (SELECT *, row_number() OVER (PARTITION BY report_id, source_type, {T.nrm('damage_name')}, {T.nrm('sub_part')}, coalesce(nl, '') ORDER BY document_no, seq) AS k FROM left_) WHERE k = 1""")
def new_damage_candidates(t) -> DataFrame:
    few = T.records(t).where("n % 4 = 0")
    return M.new_candidates(T.evidence(t), few).select("report_id", "source_type", "seq", "damage_name", "location")


def _merge_sql(source: str, keys: list[str], place: bool) -> str:
    """One stage of merging in SQL, over rows with the merge's columns."""
    by = ", ".join(keys)
    filled = lambda f: f"trim(coalesce({f}, '')) <> ''"
    facts = ", ".join(f"count(DISTINCT {T.nrm(f)}) FILTER ({filled(f)}) AS d_{f}, arg_min(trim({f}), (group_index, id)) FILTER ({filled(f)}) AS v_{f}, arg_min({f}, (group_index, id)) AS raw_{f}" for f in ("repair_method", "group_no", "quantity_group", "quantity"))
    base = ", ".join(f"arg_min({c}, (group_index, id)) AS b_{c}" for c in ("location", "status", "section", "damage_name", "part", "sub_part", "notes", "group_index"))
    kept = lambda f: f"CASE WHEN d_{f} > 1 THEN '검토필요' ELSE coalesce(v_{f}, '') END"
    bad = T.names({"repair_method": "d_repair_method > 1", "group_no": "d_group_no > 1", "quantity": "d_quantity_group > 1 OR d_quantity > 1"} | ({"location": "true"} if place else {}))
    one = lambda f, x: f"CASE WHEN cnt > 1 THEN {x} ELSE raw_{f} END AS {f}"
    return f"""SELECT report_id, first_id AS id, b_section AS section, b_damage_name AS damage_name, b_part AS part, b_sub_part AS sub_part, b_group_index AS group_index, b_notes AS notes,
      {"'검토필요'" if place else "b_location"} AS location, {one("group_no", "coalesce(v_group_no, raw_group_no)")}, {one("repair_method", f"coalesce(nullif({kept('repair_method')}, ''), raw_repair_method)")},
      {one("quantity", f"coalesce(nullif({kept('quantity')}, ''), raw_quantity)")}, {one("quantity_group", f"CASE WHEN {kept('quantity')} = '' THEN coalesce(nullif({kept('quantity_group')}, ''), raw_quantity_group) END")},
      list_sort(list_distinct(flatten(pages))) AS pages, CASE WHEN cnt = 1 THEN b_status WHEN {bad} <> '' THEN 'conflict' WHEN sure THEN 'confirmed' ELSE 'review' END AS status,
      cnt > 1 AS merged, CASE WHEN cnt > 1 THEN {bad} ELSE '' END AS conflicts, list_slice(ids, 2, cnt) AS source_ids
      FROM (SELECT {by}, count(*) AS cnt, {facts}, {base}, arg_min(id, (group_index, id)) AS first_id, list(pages) AS pages, bool_or(status = 'confirmed') AS sure, list(id ORDER BY group_index, id) AS ids FROM {source} GROUP BY ALL)"""


_KEYED = f"report_id, {T.nrm('section')} AS k1, {T.nrm('damage_name')} AS k2, part AS k3, {T.nrm('sub_part')} AS k4"


@query(f"""WITH {T.R_SQL}, a AS (SELECT * EXCLUDE (report_id), [p1, p2] AS pages, {_KEYED}, {T.nrm('location')} AS k5 FROM r),
m1 AS ({_merge_sql('a', ['report_id', 'k1', 'k2', 'k3', 'k4', 'k5'], False)}), b AS (SELECT * EXCLUDE (report_id), {_KEYED}, {T.nrm('group_no')} AS k5, {T.nrm('location')} AS place FROM m1),
g AS (SELECT report_id, k1, k2, k3, k4, k5 FROM b GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT place) > 1 AND sum(len(list_distinct(pages))) = len(list_distinct(flatten(list(pages))))),
h AS (SELECT b.* FROM b SEMI JOIN g USING (report_id, k1, k2, k3, k4, k5)), m2 AS ({_merge_sql('h', ['report_id', 'k1', 'k2', 'k3', 'k4', 'k5'], True)}),
u AS (SELECT id, location, group_no, repair_method, quantity, quantity_group, status, merged, conflicts, pages, source_ids FROM b ANTI JOIN g USING (report_id, k1, k2, k3, k4, k5)
  UNION ALL SELECT id, location, group_no, repair_method, quantity, quantity_group, status, merged, conflicts, pages, source_ids FROM m2)
SELECT * REPLACE (array_to_string(pages, ',') AS pages, array_to_string(source_ids, ',') AS source_ids) FROM u""")
def merged_records(t) -> DataFrame:
    out = G.merge_records(T.records(t))
    joined = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("conflicts", "pages", "source_ids")]
    return out.select("id", "location", "group_no", "repair_method", "quantity", "quantity_group", "status", "merged", *joined)


def _told_sql(source: str, keys: list[str], place: bool) -> str:
    """Values in conflict of one stage: every value's first record, then the fields with several."""
    by = ", ".join(keys)
    kinds = [("repair_method", "repair_method", 0), ("group_no", "group_no", 0), ("quantity", "quantity_group", 0), ("quantity", "quantity", 1)]
    one = [f"SELECT {by}, '{f}' AS field, {k} AS turn, {T.nrm(c)} AS k, trim({c}) AS value, group_index, id, pages[1] AS page FROM {source} WHERE trim(coalesce({c}, '')) <> ''" for f, c, k in kinds]
    one += [f"SELECT {by}, 'location', 0, {T.nrm('location')}, location, group_index, id, pages[1] FROM {source}"] * place
    firsts = f"SELECT * FROM ({' UNION ALL '.join(one)}) QUALIFY row_number() OVER (PARTITION BY {by}, field, turn, k ORDER BY group_index, id) = 1"
    several = f"SELECT * FROM ({firsts}) QUALIFY count(*) OVER (PARTITION BY {by}, field, turn) > 1"
    return f"""SELECT report_id, b.id, field, string_agg(coalesce(value, '') || '@' || coalesce(page::VARCHAR, ''), '; ' ORDER BY turn, x.group_index, x.id) AS "values"
      FROM ({several}) x JOIN (SELECT {by}, arg_min(id, (group_index, id)) AS id FROM {source} GROUP BY ALL) b USING ({by}) GROUP BY ALL"""


_STAGES = f"""{T.R_SQL}, a AS (SELECT * EXCLUDE (report_id), [p1, p2] AS pages, {_KEYED}, {T.nrm('location')} AS k5 FROM r),
m1 AS ({_merge_sql('a', ['report_id', 'k1', 'k2', 'k3', 'k4', 'k5'], False)}), b AS (SELECT * EXCLUDE (report_id), {_KEYED}, {T.nrm('group_no')} AS k5, {T.nrm('location')} AS place FROM m1),
g AS (SELECT report_id, k1, k2, k3, k4, k5 FROM b GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT place) > 1 AND sum(len(list_distinct(pages))) = len(list_distinct(flatten(list(pages))))),
h AS (SELECT b.* FROM b SEMI JOIN g USING (report_id, k1, k2, k3, k4, k5))"""
_MERGE_KEYS = ["report_id", "k1", "k2", "k3", "k4", "k5"]


@query(f"""WITH {_STAGES}, t1 AS ({_told_sql('a', _MERGE_KEYS, False)}), t2 AS ({_told_sql('h', _MERGE_KEYS, True)})
SELECT * FROM t1 WHERE (report_id, id) NOT IN (SELECT (report_id, id) FROM h) UNION ALL SELECT * FROM t2""")
def merge_conflict_values(t) -> DataFrame:
    shown = F.transform("values", lambda v: F.concat(F.coalesce(v["value"], F.lit("")), F.lit("@"), F.coalesce(v["page"].cast("string"), F.lit(""))))
    return G.merge_conflicts(T.records(t)).select("report_id", "id", "field", F.array_join(shown, "; ").alias("values"))


@query(f"""WITH {_STAGES}, i AS (SELECT a.report_id, a.id AS record_id, a.n, min_by(z.id, (z.group_index, z.id)) AS id1, (a.group_index, a.id) AS o FROM a JOIN a z USING (report_id, k1, k2, k3, k4, k5) GROUP BY ALL),
j AS (SELECT h.report_id, h.id AS id1, min_by(z.id, (z.group_index, z.id)) AS id2, (h.group_index, h.id) AS o2 FROM h JOIN h z USING (report_id, k1, k2, k3, k4, k5) GROUP BY ALL),
f AS (SELECT i.report_id, coalesce(id2, i.id1) AS id, o2, o, s, CASE s WHEN 0 THEN CASE WHEN n % 4 > 0 THEN 'P' || n % 3 END ELSE CASE WHEN n % 5 = 0 THEN 'Q' || n END END AS photo FROM (SELECT *, unnest([0, 1]) AS s FROM i) i LEFT JOIN j ON j.report_id = i.report_id AND j.id1 = i.id1),
u AS (SELECT *, row_number() OVER (PARTITION BY report_id, id, photo ORDER BY o2, o, s) AS k FROM f)
SELECT report_id, id, coalesce(string_agg(photo, ',' ORDER BY o2, o, s) FILTER (k = 1), '') AS photos FROM u GROUP BY ALL""")
def merged_record_photos(t) -> DataFrame:
    records, n = T.records(t), F.col("n")
    named = F.array(F.when(n % 4 > 0, F.concat(F.lit("P"), (n % 3).cast("string"))), F.when(n % 5 == 0, F.concat(F.lit("Q"), n.cast("string"))))
    photos = records.select("report_id", F.col("id").alias("record_id"), F.posexplode(named).alias("seq", "photo_id"))
    return G.merged_photos(records, photos).withColumn("photos", F.array_join("photos", ","))


@query("""
SELECT 'R' || o_orderkey AS id, i::INT AS place, l AS location, s AS sub_part FROM (
  SELECT o_orderkey, unnest([1, 2, 3, 4]) AS i, unnest([(o_orderkey % 90)::VARCHAR || 'm', '20~30m', '208m', '7m']) AS l, unnest(['기본', '기본', '도수로', '도수로']) AS s FROM orders)""")
def location_blocks(t) -> DataFrame:
    k = F.col("o_orderkey")
    block = F.concat((k % 90).cast("string"), F.lit(", 20~30m\n\n  도수로 208m\n7m\n"))
    rows = t("orders").select(F.concat(F.lit("R"), k.cast("string")).alias("id"), F.posexplode(D.location_block(block, F.lit("기본"))).alias("p", "x"))
    return rows.select("id", (F.col("p") + 1).cast("int").alias("place"), "x.location", "x.sub_part")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '균열' WHEN 1 THEN '누수' END AS damage_name, CASE WHEN o_orderkey % 2 = 0 THEN '도수로' END AS sub_part, CASE WHEN o_orderkey % 2 = 0 THEN '배수시설' END AS part,
  CASE WHEN o_orderkey % 5 = 0 THEN '12.5~14m' END AS location, CASE WHEN o_orderkey % 4 = 0 THEN '3구간' END AS section, CASE o_orderkey % 7 WHEN 0 THEN '사진 12' WHEN 1 THEN 'No. 4' WHEN 2 THEN 'P-01' WHEN 3 THEN '③-01' WHEN 4 THEN 'D003' END AS photo_no,
  CASE WHEN o_orderkey % 3 = 0 THEN '그라우팅' END AS repair_method FROM orders WHERE o_orderkey % 3 < 2 OR o_orderkey % 2 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 < 5""")
def text_to_candidates(t) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda n, *v: F.coalesce(F.element_at(F.array(*[F.lit(x) for x in v]), (k % n + 1).cast("int")), F.lit(""))
    text = F.concat_ws(
        " / ", pick(3, "균열 그라우팅", "누수", "양호"), pick(2, "도수로", ""), pick(5, "12.5~14 m", "", "", "", ""), pick(4, "3 구간", "", "", ""), pick(7, "사진 12", "No. 4", "P-01", "③-01", "D003", "", "")
    )
    rows = t("orders").select("o_orderkey", D.candidate(text, F.lit(None).cast("string")).alias("c")).where("c is not null")
    return rows.select("o_orderkey", *[F.col(f"c.{f}").alias(f) for f in ("damage_name", "sub_part", "part", "location", "section", "photo_no", "repair_method")])
