"""Queries of review state, report sets and evaluation over inspection records, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions import domain as D
from corroborate.functions import parse as P
from corroborate.functions import text as X
from corroborate.operators import evaluation as E
from corroborate.operators import matching as M
from corroborate.operators import report as R

from . import frames as T
from .inspection import _FOLD, _PAIRS, _RESULTS, _STATUS, checked_records, linked_records
from .registry import query


def _reviewed(t) -> DataFrame:
    """Linked records with what the review shows of them."""
    out = linked_records(t)[0]
    return out.withColumns({"merged": F.col("n") % 5 == 0, "conflicts": F.when(F.col("n") % 9 == 0, F.array(F.lit("location"))), "cv_result": _result(), "refs": F.when(F.col("n") % 8 > 0, F.col("refs")), "pages": F.when(F.col("n") % 16 > 0, F.col("pages"))})


def _result():
    return F.element_at(F.array(F.lit("matched"), F.lit("conflict"), F.lit("missingInAdditional"), F.lit(None)), (F.col("n") % 4 + 1).cast("int"))


_RESULT = "CASE n % 4 WHEN 0 THEN 'matched' WHEN 1 THEN 'conflict' WHEN 2 THEN 'missingInAdditional' END"
_SHOWN = f"{_STATUS}, v AS (SELECT *, {_RESULT} AS cv_result, o1 IS NOT NULL AS modified, trim(coalesce(location, '')) IN ('', '검토필요') AS no_place, NOT {T.given('quantity')} AND NOT {T.given('quantity_group')} AS no_scale FROM y)"
_FILTERS = {
    "all": "true", "confirmed": "status = 'confirmed'", "review": "status = 'review'", "conflict": "status = 'conflict' OR n % 9 = 0", "excluded": "status = 'excluded'", "merged": "n % 5 = 0",
    "sourceMissing": "n % 8 = 0", "photoReview": "photo_status IN ('review', 'conflict')", "noPhoto": "photo_status = 'noPhoto'", "cvConflict": "cv_result = 'conflict'", "cvMissing": "cv_result = 'missingInAdditional'",
    "positionProblem": "no_place", "photoProblem": "photo_status IN ('review', 'conflict')", "scaleProblem": "no_scale", "manualEntry": "id LIKE 'NEW-%'", "modified": "modified", "unmodified": "NOT modified",
}


@query(f"WITH {_SHOWN} " + " UNION ALL ".join(f"SELECT '{n}' AS filter, count_if({c}) AS n FROM v" for n, c in _FILTERS.items()))
def review_filters(t) -> DataFrame:
    filters = R.review_filters()
    return _reviewed(t).agg(*[F.count_if(c).alias(n) for n, c in filters.items()]).unpivot([], list(filters), "filter", "n")


@query(f"""WITH {_STATUS} SELECT id FROM r WHERE contains(lower(concat_ws(' ', id, section, damage_name, part, sub_part, location, repair_method, group_no)), 'new-1')
  OR EXISTS (SELECT 1 FROM l JOIN q USING (report_id, photo_id) WHERE l.report_id = r.report_id AND l.id = r.id AND contains(lower(concat_ws(' ', q.photo_no, q.page::VARCHAR)), 'new-1'))""")
def record_search(t) -> DataFrame:
    return R.search_records(T.records(t), linked_records(t)[1], "  NEW-1 ").select("id")


@query(f"""WITH {_SHOWN} SELECT id AS no, coalesce(quantity, quantity_group, '-') AS quantity, n_photos::INT AS photo_count,
  CASE cv_result WHEN 'matched' THEN '일치' WHEN 'conflict' THEN '불일치' WHEN 'missingInAdditional' THEN '추가자료 미확인' ELSE '-' END AS cross_check,
  CASE status WHEN 'confirmed' THEN '🟢 확인완료' WHEN 'review' THEN '🟡 검토필요' WHEN 'conflict' THEN '🔴 수정필요' END AS status FROM v WHERE status <> 'excluded' AND (n % 3 = 0 AND report_id % 2 = 0 OR report_id NOT IN (SELECT report_id FROM r WHERE n % 3 = 0 AND report_id % 2 = 0))""")
def final_damage_rows(t) -> DataFrame:
    chosen = T.records(t).where("n % 3 = 0 and report_id % 2 = 0").select("report_id", "id")
    return R.damage_rows(R.final_records(_reviewed(t), chosen)).select("no", "quantity", "photo_count", "cross_check", "status")


@query(f"WITH {T.P_SQL} SELECT report_id, count(*) AS total, count(*) FILTER (extraction_status = 'ok') AS ok, count_if(related IS DISTINCT FROM 'false') AS shown, count(*) FILTER (related IS DISTINCT FROM 'false' AND match_status = 'confirmed') AS confirmed, count_if(related IS DISTINCT FROM 'false' AND match_status IS NULL) AS unmatched FROM p GROUP BY 1")
def gallery_counters(t) -> DataFrame:
    photos = T.photos(t)
    related = F.coalesce(F.col("related") != "false", F.lit(True))
    return E.counters(photos, ["report_id"], {"ok": F.coalesce(F.col("extraction_status") == "ok", F.lit(False)), "shown": related, "confirmed": related & F.col("match_status").eqNullSafe("confirmed"), "unmatched": related & F.col("match_status").isNull()})


@query(f"WITH {T.P_SQL} SELECT photo_id, extraction_status = 'ok' AS final FROM p WHERE related IS DISTINCT FROM 'false' AND match_status IS NULL")
def gallery_photos(t) -> DataFrame:
    shown = R.gallery(T.photos(t), "unmatched")
    final = R.final_photos(T.photos(t)).select("photo_id", F.lit(True).alias("f"))
    return shown.join(final, "photo_id", "left").select("photo_id", F.when(F.col("extraction_status").isNotNull(), F.coalesce("f", F.lit(False))).alias("final"))


@query(f"WITH {_FOLD} SELECT id, cv_result, n_matched::INT AS n_evidence FROM c")
def final_checks(t) -> DataFrame:
    return R.final_checks(checked_records(t)).select("id", "cv_result", "n_evidence")


@query(f"""WITH {_STATUS} SELECT l.id AS damage_no, coalesce(q.photo_no, q.photo_id) AS photo_no, q.page, CASE WHEN match_source = 'manual' THEN '수동 연결' ELSE '자동 연결' END AS link, coalesce(round(confidence * 100)::INT || '%', '-') AS confidence
  FROM l JOIN r USING (report_id, id) JOIN q ON q.report_id = l.report_id AND q.photo_id = l.photo_id
UNION ALL SELECT '-', coalesce(photo_no, photo_id), page, '미연결', '-' FROM q WHERE NOT EXISTS (SELECT 1 FROM l JOIN r USING (report_id, id) WHERE l.report_id = q.report_id AND l.photo_id = q.photo_id)""")
def photo_report_rows(t) -> DataFrame:
    return R.photo_rows(*linked_records(t)).drop("report_id")


_BROKEN = f"{_STATUS}, k AS (SELECT y.report_id, y.id, y.n, y.status, unnest(string_split(photo_ids, ',')) AS photo_id FROM y WHERE photo_ids <> ''), z AS (SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.report_id = k.report_id AND p.photo_id = k.photo_id AND p.extraction_status = 'ok'))"


@query(f"WITH {_BROKEN} SELECT id, photo_id FROM z")
def broken_photo_links(t) -> DataFrame:
    return R.broken_links(linked_records(t)[0], R.final_photos(T.photos(t))).select("id", "photo_id")


@query(f"""WITH {_BROKEN}, v AS (SELECT *, {_RESULT} AS cv FROM y),
bk AS (SELECT report_id, count(DISTINCT id) AS broken FROM z WHERE status <> 'excluded' GROUP BY 1), u AS (SELECT o_custkey AS report_id, count(*) AS undecided FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 = 0 GROUP BY 1),
c AS (SELECT report_id, count_if(status = 'conflict' OR coalesce(cv = 'conflict', false)) AS conflicts, count_if(coalesce(damage_name, '') = '' OR coalesce(section, '') = '' OR coalesce(part, '') = '') AS incomplete, count_if(photo_status = 'conflict') AS photo_conflicts,
  count_if(status <> 'excluded' AND n % 16 = 0) AS without_source, count_if(status <> 'excluded' AND coalesce(damage_name, '') = '') AS malformed FROM v GROUP BY 1),
j AS (SELECT c_custkey AS report_id, coalesce(conflicts, 0) AS conflicts, coalesce(undecided, 0) AS undecided, coalesce(incomplete, 0) AS incomplete, coalesce(photo_conflicts, 0) AS photo_conflicts, coalesce(without_source, 0) AS without_source, coalesce(broken, 0) AS broken, coalesce(malformed, 0) AS malformed, c_custkey % 2 AS unfinished
  FROM customer LEFT JOIN c ON c.report_id = c_custkey LEFT JOIN bk ON bk.report_id = c_custkey LEFT JOIN u ON u.report_id = c_custkey)
SELECT *, reasons = '' AS ok FROM (SELECT * EXCLUDE (unfinished), concat_ws(',', CASE WHEN unfinished > 0 THEN 'unfinished' END, CASE WHEN conflicts > 0 THEN 'conflicts' END, CASE WHEN undecided > 0 THEN 'undecided' END, CASE WHEN incomplete > 0 THEN 'incomplete' END,
  CASE WHEN photo_conflicts > 0 THEN 'photo_conflicts' END, CASE WHEN without_source > 0 THEN 'without_source' END, CASE WHEN broken > 0 THEN 'broken' END, CASE WHEN malformed > 0 THEN 'malformed' END) AS reasons FROM j)""")
def export_validation(t) -> DataFrame:
    sessions = t("customer").select(F.col("c_custkey").alias("report_id"), F.when(F.col("c_custkey") % 2 == 1, "in_progress").otherwise("completed").alias("review_status"))
    k = F.col("o_orderkey")
    candidates = t("orders").where(k % 7 == 0).select(F.col("o_custkey").alias("report_id"), F.when(k % 3 > 0, "excluded").alias("decision"))
    out = R.export_checks(_reviewed(t), R.final_photos(T.photos(t)), candidates, sessions)
    return out.withColumn("reasons", F.array_join("reasons", ","))


_LINES = "SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, l_returnflag, l_shipdate FROM lineitem"


def _checks(t) -> tuple[DataFrame, DataFrame]:
    """Confirming documents and conflicts of records, from the order lines."""
    lines = t("lineitem").select((F.col("l_orderkey") % 50).alias("report_id"), F.col("l_orderkey").cast("string").alias("id"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file"), "l_returnflag", "l_linenumber", "l_quantity", "l_shipdate", "l_partkey")
    evidence = lines.where("l_returnflag <> 'A'").select("report_id", "id", "file", F.lit("table").alias("type"), F.col("l_linenumber").alias("page"), F.lit(None).cast("string").alias("quote"), F.when(F.col("l_returnflag") == "R", "matched").otherwise("none").alias("result"))
    conflicts = lines.where("l_returnflag = 'A'").select("report_id", "id", "file", F.lit("location").alias("field"), F.col("l_quantity").cast("int").cast("string").alias("main"), F.col("l_partkey").cast("string").alias("other"), F.when(F.col("l_linenumber") < 3, F.col("l_partkey").cast("string")).alias("resolved"), F.when(F.col("l_linenumber") == 1, "seen").alias("reason"), F.col("l_shipdate").alias("at"))
    return evidence, conflicts


@query(f"""WITH x AS ({_LINES}) SELECT l_orderkey::VARCHAR AS damage_no, 'f' || l_suppkey AS file, '확인' AS item, '-' AS main, '-' AS other, CASE WHEN l_returnflag = 'R' THEN '일치' ELSE '미확인' END AS result, '-' AS decision FROM x WHERE l_returnflag <> 'A'
UNION ALL SELECT l_orderkey::VARCHAR, 'f' || l_suppkey, 'location', l_quantity::INT::VARCHAR, l_partkey::VARCHAR, '불일치', CASE WHEN l_linenumber < 3 THEN l_partkey || ' 확정 (' || CASE WHEN l_linenumber = 1 THEN 'seen' ELSE '수동' END || ')' ELSE '미해결' END FROM x WHERE l_returnflag = 'A'""")
def check_report_rows(t) -> DataFrame:
    return R.check_rows(*_checks(t)).drop("report_id")


@query(f"""WITH x AS ({_LINES}), {T.R_SQL} SELECT id AS damage_no, '기본 보고서' AS field, 'table' AS type, '주 보고서' AS file, p1::VARCHAR AS page, damage_name AS excerpt FROM r
UNION ALL SELECT l_orderkey::VARCHAR, '교차검증', 'table', 'f' || l_suppkey, l_linenumber::VARCHAR, '-' FROM x WHERE l_returnflag <> 'A'""")
def source_report_rows(t) -> DataFrame:
    return R.source_rows(T.records(t).withColumn("report_id", F.col("n") % 50), _checks(t)[0]).drop("report_id")


@query(f"""WITH x AS ({_LINES}), {T.R_SQL}, h AS (SELECT n % 50 AS report_id, id AS damage_no, o1 AS field, location AS was, 'new' AS now, '사용자 수정' AS kind, "at" FROM r WHERE o1 IS NOT NULL
UNION ALL SELECT l_orderkey % 50, l_orderkey::VARCHAR, 'location', l_quantity::INT::VARCHAR, l_partkey::VARCHAR, '충돌 해결', l_shipdate FROM x WHERE l_returnflag = 'A' AND l_linenumber < 3)
SELECT report_id, damage_no, kind, row_number() OVER (PARTITION BY report_id ORDER BY "at", damage_no, field)::INT AS turn FROM h""")
def history_report_rows(t) -> DataFrame:
    edits = T.records(t).where("o1 is not null").select((F.col("n") % 50).alias("report_id"), "id", F.col("o1").alias("field"), F.col("location").alias("original"), F.lit("new").alias("to"), "at")
    return R.history_rows(edits, _checks(t)[1]).select("report_id", "damage_no", "kind", "turn")


@query("""WITH d AS (SELECT user_id, max(CASE WHEN value >= 50 THEN 'finalized' ELSE 'completed' END) AS a FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT c_custkey AS report_id, coalesce(a, 'in_progress') AS review_status, 1 + coalesce((a = 'finalized')::INT, 0) AS review_version, CASE WHEN a = 'finalized' THEN 'me' END AS finalized_by FROM customer LEFT JOIN d ON user_id = c_custkey""")
def closed_reviews(t) -> DataFrame:
    sessions = t("customer").select(F.col("c_custkey").alias("report_id"), F.lit("in_progress").alias("review_status"), F.lit(1).alias("review_version"))
    done = t("events").where("event_id % 3 = 0").select(F.col("user_id").alias("report_id"), F.when(F.col("value") >= 50, "finalized").otherwise("completed").alias("action"))
    return R.close_review(sessions, done, "me", F.lit("2024-01-01").cast("timestamp")).drop("finalized_at")


@query(f"""WITH {T.R_SQL} SELECT id, part, status FROM r WHERE n % 6 <> 0 UNION ALL SELECT 'NEW-' || c_custkey, '기타', 'review' FROM customer WHERE c_custkey % 6 <> 0""")
def records_added_and_deleted(t) -> DataFrame:
    blanks = t("customer").select(F.col("c_custkey").alias("report_id"), F.col("c_custkey").alias("number"))
    gone = T.records(t).where("n % 6 = 0").select("report_id", "id").unionByName(blanks.where("number % 6 = 0").select("report_id", F.concat(F.lit("NEW-"), "number").alias("id")))
    # an id of the stand-in records may begin like a blank one: keep the two apart by report
    return R.add_and_delete(T.records(t), blanks.withColumn("report_id", -F.col("report_id")), gone.where("id not like 'NEW-%' or report_id > 0").unionByName(gone.where("id like 'NEW-%'").select((-F.col("report_id")).alias("report_id"), "id"))).select("id", "part", "status")


@query("""SELECT user_id AS case_id, arg_max(coalesce(value >= 50, false), (ts, coalesce(value >= 50, false))) AS locked, count(*)::INT AS n_revisions FROM events WHERE user_id % 2 = 0 GROUP BY 1
UNION ALL SELECT DISTINCT user_id, true, 0 FROM events WHERE user_id % 2 = 1""")
def truth_locks(t) -> DataFrame:
    events = t("events")
    truths = events.select(F.col("user_id").alias("case_id")).distinct().withColumn("locked", F.lit(True))
    changes = events.where("user_id % 2 = 0").select(F.col("user_id").alias("case_id"), F.coalesce(F.col("value") >= 50, F.lit(False)).alias("locked"), F.col("ts").alias("at"))
    return R.set_locks(truths, changes).select("case_id", "locked", F.size("revisions").alias("n_revisions"))


@query(f"""WITH {T.R_SQL}, d AS (SELECT l_orderkey, arg_max(l_returnflag = 'R', (l_linenumber * 1000000 + l_partkey, l_returnflag = 'R')) AS o FROM lineitem GROUP BY 1)
SELECT id, coalesce(o, no_photo) AS no_photo FROM r LEFT JOIN d ON l_orderkey = n""")
def no_photo_overrides(t) -> DataFrame:
    lines = t("lineitem").select(F.col("l_orderkey").alias("n"), (F.col("l_returnflag") == "R").alias("on"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("at"))
    changes = lines.join(T.records(t).select("n", "report_id", "id"), "n")
    return R.override_no_photo(T.records(t), changes).select("id", "no_photo")


@query("""SELECT o_orderkey AS candidate_id, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'excluded' ELSE 'deferred' END END AS decision FROM orders""")
def decided_candidates(t) -> DataFrame:
    k = F.col("o_orderkey")
    decisions = t("orders").where(k % 3 == 0).select(k.alias("candidate_id"), F.when(k % 2 == 0, "excluded").otherwise("deferred").alias("decision"), F.col("o_orderdate").alias("at"))
    return R.decide_candidates(t("orders").select(k.alias("candidate_id"), F.lit(None).cast("string").alias("decision")), decisions)


@query("""SELECT o_orderkey, printf('EXP-%03d', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey::VARCHAR)) AS export_id, trim(regexp_replace('a/b: ' || o_custkey, '[\\\\/:*?"<>|]', '', 'g')) || '_list_' || strftime(o_orderdate, '%Y%m%d') || '.xlsx' AS name FROM orders""")
def export_log(t) -> DataFrame:
    rows = t("orders").select(F.col("o_custkey").alias("report_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").cast("string").alias("file"), "o_orderkey")
    name = X.safe_file_name(F.concat(F.lit("a/b: "), F.col("report_id").cast("string")), "list", "xlsx", F.col("at"))
    return R.export_history(rows).select("o_orderkey", "export_id", name.alias("name"))


@query("""WITH b AS (SELECT l_orderkey % 500 AS page_id, l_linenumber + l_orderkey * 10 AS box_id, l_quantity * 20 AS x0, l_discount * 5000 AS y0, l_quantity * 20 + 80 AS x1, l_discount * 5000 + 50 AS y1 FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber = 1 AND l_partkey % 3 = 0),
i AS (SELECT o_orderkey % 500 AS page_id, (o_orderkey * 37 % 1000)::DOUBLE AS x, (o_orderkey * 53 % 600)::DOUBLE AS y, o_orderkey::VARCHAR AS text FROM orders)
SELECT page_id, box_id, md5(coalesce(near, '')) AS near FROM (SELECT DISTINCT page_id, box_id, x0, y0, x1, y1 FROM b) LEFT JOIN (SELECT page_id, box_id, x0, y0, x1, y1, string_agg(text, ' ' ORDER BY y, x, text) AS near FROM (SELECT DISTINCT * FROM b) JOIN i USING (page_id)
  WHERE x BETWEEN x0 - 60 AND x1 + 60 AND y BETWEEN y0 - 60 AND y1 + 60 GROUP BY ALL) USING (page_id, box_id, x0, y0, x1, y1)""")
def nearby_text(t) -> DataFrame:
    q, d, k = F.col("l_quantity"), F.col("l_discount"), F.col("o_orderkey")
    lines = t("lineitem").where("l_orderkey % 7 = 0 and l_linenumber = 1 and l_partkey % 3 = 0")
    boxes = lines.select((F.col("l_orderkey") % 500).alias("page_id"), (F.col("l_linenumber") + F.col("l_orderkey") * 10).alias("own"), (q * 20).alias("x0"), (d * 5000).alias("y0"), (q * 20 + 80).alias("x1"), (d * 5000 + 50).alias("y1")).distinct()
    boxes = boxes.withColumn("box_id", F.concat_ws("|", "own", "x0", "y0"))
    items = t("orders").select((k % 500).alias("page_id"), (k * 37 % 1000).cast("double").alias("x"), (k * 53 % 600).cast("double").alias("y"), k.cast("string").alias("text"))
    found = R.nearby_text(boxes, items)
    return found.select("page_id", F.split("box_id", r"\|")[0].cast("long").alias("box_id"), F.md5(F.col("near").cast("binary")).alias("near"))


@query("""WITH x AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'if (page === ' || o_orderkey || ') go' WHEN 1 THEN '  damageName == "균열"' WHEN 2 THEN 'subPart === "기타"' WHEN 3 THEN 'facilityName === ''A'' || pageNo == 3' WHEN 4 THEN 'section = "1구간"' ELSE 'ok' END AS code,
  CASE WHEN o_orderkey % 5 = 0 THEN 'a/validation/b.ts' WHEN o_orderkey % 7 = 0 THEN 'a.test.ts' ELSE 'a.ts' END AS path FROM orders)
SELECT k AS line, unnest(CASE k % 6 WHEN 0 THEN ['page number'] WHEN 1 THEN ['damage, place or section'] WHEN 3 THEN ['page number', 'report, company or facility'] ELSE [] END) AS reason, trim(code) AS snippet FROM x WHERE path = 'a.ts'""")
def literal_scan(t) -> DataFrame:
    k = F.col("o_orderkey")
    codes = [F.concat(F.lit("if (page === "), k.cast("string"), F.lit(") go")), F.lit('  damageName == "균열"'), F.lit('subPart === "기타"'), F.lit("facilityName === 'A' || pageNo == 3"), F.lit('section = "1구간"'), F.lit("ok")]
    path = F.when(k % 5 == 0, "a/validation/b.ts").when(k % 7 == 0, "a.test.ts").otherwise("a.ts")
    lines = t("orders").select(path.alias("path"), k.alias("line"), F.element_at(F.array(*codes), (k % 6 + 1).cast("int")).alias("code"))
    return R.scan_literals(lines, R.LITERAL_PATTERNS, R.ALLOWED_LITERALS, R.EXCLUDED_PATHS).select("line", "reason", "snippet")


@query("SELECT conv_id, md5(string_agg('--- 페이지 ' || turn || ' ---' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS prompt FROM conversations GROUP BY 1")
def joined_pages(t) -> DataFrame:
    return R.joined_pages(t("conversations"), "conv_id", "turn", "text").select("conv_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@query(f"""WITH g AS (SELECT o_orderkey AS k, 'G' || o_orderkey AS no, CASE o_orderkey % 3 WHEN 0 THEN ' 사면 ' WHEN 1 THEN '옹벽' END AS part, CASE WHEN o_orderkey % 4 = 0 THEN '9m' END AS total, 1 + o_orderkey % 3 AS n FROM orders), x AS (SELECT *, unnest(range(1, n + 1)) AS i FROM g)
SELECT CASE WHEN n = 1 THEN no ELSE printf('%s-%02d', no, i) END AS id, i::INT AS group_index, CASE WHEN k % 3 = 0 THEN '사면' ELSE '기타' END AS part, CASE WHEN i = 2 THEN '도수로' ELSE '-' END AS sub_part, CASE WHEN i = 3 THEN '1m' END AS quantity,
  CASE WHEN i = 3 THEN NULL WHEN total IS NOT NULL THEN '그룹 합계 9m에 포함' WHEN n > 1 THEN '그룹 합계에 포함' END AS quantity_group FROM x""")
def groups_to_records(t) -> DataFrame:
    k = F.col("o_orderkey")
    place = lambda i, sub, own: F.struct(F.lit(sub).alias("sub_part"), F.lit(f"{i}m").alias("location"), F.lit(own).cast("string").alias("quantity"))
    every = F.array(place(1, "", None), place(2, "도수로", ""), place(3, "-", "1m"))
    groups = t("orders").select(F.col("o_custkey").alias("report_id"), F.concat(F.lit("G"), k.cast("string")).alias("group_no"), F.lit("1구간").alias("section"), F.lit("균열").alias("damage_name"), F.when(k % 3 == 0, " 사면 ").when(k % 3 == 1, "옹벽").alias("part"), F.lit("").alias("repair_method"), F.when(k % 4 == 0, "9m").alias("total"), F.slice(every, 1, (k % 3 + 1).cast("int")).alias("locations"))
    return R.group_records(groups).select("id", "group_index", "part", "sub_part", "quantity", "quantity_group")


@query("""WITH g AS (SELECT o_custkey AS report_id, o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'G' || o_orderkey WHEN o_orderkey % 4 = 1 THEN '' END AS no, CASE o_orderkey % 3 WHEN 0 THEN '비탈면' WHEN 1 THEN '' END AS part, o_orderkey % 3 AS n FROM orders),
m AS (SELECT k, row_number() OVER (PARTITION BY report_id ORDER BY k) AS tmp FROM g WHERE n = 1 AND coalesce(no, '') = ''), x AS (SELECT *, unnest(range(1, n + 1)) AS i FROM g)
SELECT report_id, k AS damage_name, CASE WHEN tmp IS NOT NULL THEN 'TMP-' || tmp WHEN n = 1 THEN no ELSE printf('%s-%02d', coalesce(no, ''), i) END AS id, CASE WHEN part <> '' THEN '원문 부위값 "' || part || '"을(를) 표준 분류로 확정하지 못해 "기타"로 지정함' END AS notes FROM x LEFT JOIN m USING (k)""")
def groups_without_numbers(t) -> DataFrame:
    k = F.col("o_orderkey")
    place = F.struct(F.lit("").alias("sub_part"), F.lit("1m").alias("location"), F.lit(None).cast("string").alias("quantity"))
    groups = t("orders").select(F.col("o_custkey").alias("report_id"), F.when(k % 4 == 0, F.concat(F.lit("G"), k.cast("string"))).when(k % 4 == 1, "").alias("group_no"), F.lit("s").alias("section"), k.alias("damage_name"), F.when(k % 3 == 0, "비탈면").when(k % 3 == 1, "").alias("part"), F.lit("").alias("repair_method"), F.lit(None).cast("string").alias("total"), F.array_repeat(place, (k % 3).cast("int")).alias("locations"))
    return R.group_records(groups, "damage_name").select("report_id", "damage_name", "id", "notes")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN p_name END AS damage_type, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 2 = 0 THEN p_brand END AS facility, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 3 = 0 THEN p_size / 100 WHEN p_partkey % 7 > 0 THEN 0 END AS confidence FROM part""")
def vision_answers(t) -> DataFrame:
    k, size = F.col("p_partkey"), (F.col("p_size") / 100).cast("string")
    sure = F.when(k % 3 == 0, size).when(k % 3 == 1, F.concat(F.lit('"'), size, F.lit('"'))).otherwise("null")
    brand = F.when(k % 2 == 0, F.concat(F.lit(', "facility": '), F.concat(F.lit('"'), "p_brand", F.lit('"')))).otherwise("")
    answer = F.when(k % 7 > 0, F.concat(F.lit('I see:\n{"damageType": "'), "p_name", F.lit('"'), brand, F.lit(', "confidence": '), sure, F.lit("}\nDone"))).otherwise("nothing")
    return t("part").select("p_partkey", P.vision_answer(answer).alias("a")).select("p_partkey", "a.*")


@query("""WITH e AS (SELECT o_custkey AS report_id, o_orderkey AS k, o_orderdate AS d, o_orderkey::VARCHAR AS file, CASE WHEN o_orderkey % 5 = 0 THEN 'disk full' WHEN o_orderkey % 5 = 1 THEN '' END AS error FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY d, file) AS n FROM e WHERE k % 3 = 0), w AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY d, file) AS n FROM e WHERE k % 3 > 0),
c AS (SELECT report_id, max(n) AS last FROM o GROUP BY 1)
SELECT k, printf('EXP-%03d', n) AS export_id, 'success' AS status FROM o UNION ALL SELECT k, printf('EXP-%03d', n + coalesce(last, 0)), CASE WHEN coalesce(error, '') <> '' THEN 'failed' ELSE 'success' END FROM w LEFT JOIN c USING (report_id)""")
def export_log_appended(t) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t("orders").select(F.col("o_custkey").alias("report_id"), k.alias("k"), F.col("o_orderdate").alias("at"), k.cast("string").alias("file"), F.when(k % 5 == 0, "disk full").when(k % 5 == 1, "").alias("error"))
    log = R.export_history(rows.where("k % 3 = 0").drop("error")).withColumn("status", F.lit("success"))
    return R.append_exports(log, rows.where("k % 3 > 0")).select("k", "export_id", "status")


_PHOTO_SIDES = """tp AS (SELECT o_custkey % 40 AS case_id, CASE WHEN o_orderkey % 5 > 0 THEN 'N:' || (o_orderkey % 30) ELSE 'P:' || (o_orderkey % 9) END AS k FROM orders WHERE o_orderstatus <> 'O'),
fp AS (SELECT o_custkey % 40 AS case_id, CASE WHEN o_orderkey % 5 > 0 THEN 'N:' || (o_orderkey % 30) ELSE 'P:' || (o_orderkey % 9) END AS k FROM orders WHERE o_orderstatus <> 'F'),
pm AS (SELECT case_id, k, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT case_id, k, count(*) AS a FROM tp GROUP BY ALL) FULL JOIN (SELECT case_id, k, count(*) AS b FROM fp GROUP BY ALL) USING (case_id, k))"""
_PRF = "CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"


def _metrics_sql(source: str) -> str:
    return f"SELECT case_id, tp, fp, fn, p AS precision, q AS recall, {_PRF.format(p='p', r='q')} AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM (SELECT case_id, sum(least(a, b))::BIGINT AS tp, sum(b - least(a, b))::BIGINT AS fp, sum(a - least(a, b))::BIGINT AS fn FROM {source} GROUP BY 1))"


def _photo_sides(t) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    number = F.when(k % 5 > 0, F.concat(F.lit(" "), (k % 30).cast("string"))).otherwise(F.lit(""))
    rows = t("orders").select((F.col("o_custkey") % 40).alias("case_id"), number.alias("photo_no"), (k % 9).alias("page"), "o_orderstatus")
    return rows.where("o_orderstatus <> 'O'"), rows.where("o_orderstatus <> 'F'")


@query(f"WITH {_PHOTO_SIDES} {_metrics_sql('pm')}")
def photo_extraction_metrics(t) -> DataFrame:
    return E.case_metrics(E.match_photos(*_photo_sides(t)))


_RECORD_SIDES = """ra AS (SELECT l_orderkey % 40 AS case_id, l_partkey % 20 AS k1, l_linenumber AS k2, count_if(l_returnflag <> 'N') AS a, count_if(l_returnflag <> 'R') AS b FROM lineitem GROUP BY ALL)"""


def _runs(t) -> DataFrame:
    lines = t("lineitem").select((F.col("l_orderkey") % 40).alias("case_id"), (F.col("l_partkey") % 20).cast("string").alias("k1"), F.concat(F.col("l_linenumber").cast("string"), F.lit(" ")).alias("k2"), "l_returnflag")
    cases = t("customer").where("c_custkey < 50").select(F.col("c_custkey").alias("case_id"), (F.col("c_custkey") % 10 > 0).alias("has_truth"), (F.col("c_custkey") % 3).alias("n_runs"))
    return E.run_cases(cases, lines.where("l_returnflag <> 'N'"), lines.where("l_returnflag <> 'R'"), *_photo_sides(t), ["k1", "k2"])


_RUN_SQL = f"""{_PHOTO_SIDES}, {_RECORD_SIDES}, rm AS ({_metrics_sql('ra')}), ph AS ({_metrics_sql('pm')}),
run AS (SELECT c_custkey AS case_id, c_custkey % 3 + 1 AS run_number, c_custkey % 10 > 0 AS ok, coalesce(rm.precision, 0) AS p, coalesce(rm.recall, 0) AS r, coalesce(rm.f1, 0) AS f, coalesce(ph.f1, 0) AS pf FROM customer LEFT JOIN rm ON rm.case_id = c_custkey LEFT JOIN ph ON ph.case_id = c_custkey WHERE c_custkey < 50)"""


@query(f"""WITH {_RUN_SQL} SELECT case_id, run_number, CASE WHEN ok THEN round(p, 9) END AS precision, CASE WHEN ok THEN round(r, 9) END AS recall, CASE WHEN ok THEN round(f, 9) END AS f1, CASE WHEN ok THEN round(pf, 9) END AS photo_f1,
  CASE WHEN ok THEN CASE WHEN f >= 0.9 THEN 'GOOD' WHEN f >= 0.75 THEN 'WARNING' ELSE 'FAIL' END END AS status, CASE WHEN NOT ok THEN 'no ground truth' END AS error FROM run""")
def validation_runs(t) -> DataFrame:
    rounded = [F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "photo_f1")]
    return _runs(t).select("case_id", "run_number", *rounded, "status", "error")


@query(f"""WITH {_RUN_SQL} SELECT case_id, CASE WHEN ok THEN printf('%.1f%%', round(p * 100, 1)) ELSE 'N/A' END AS precision, CASE WHEN ok THEN CASE WHEN f >= 0.9 THEN 'GOOD' WHEN f >= 0.75 THEN 'WARNING' ELSE 'FAIL' END ELSE 'N/A' END AS status FROM run""")
def validation_sheet(t) -> DataFrame:
    return E.summary_sheet(_runs(t)).select("case_id", "precision", "status")


_LATEST = "SELECT user_id, arg_max(value, (r, -event_id)) AS f1 FROM (SELECT *, event_id % 5 AS r FROM events WHERE value IS NOT NULL AND {w}) GROUP BY 1"


@query(f"WITH a AS ({_LATEST.format(w='value < 60')}), b AS ({_LATEST.format(w='value >= 20')}) SELECT user_id AS case_id, a.f1 AS previous, b.f1 AS latest, b.f1 - a.f1 AS delta, b.f1 - a.f1 <= -0.1 AS warning FROM a JOIN b USING (user_id)")
def run_set_comparison(t) -> DataFrame:
    runs = t("events").where("value is not null").select(F.col("user_id").alias("case_id"), (F.col("event_id") % 5).alias("run_number"), F.col("event_id").alias("ordinal"), F.col("value").alias("f1"))
    return E.compare_run_sets(runs.where("f1 < 60"), runs.where("f1 >= 20"))


@query(f"WITH {_FOLD}, x AS (SELECT cv_result AS r, CASE n % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'conflict' END AS e FROM c) SELECT count_if(r = 'matched') AS matched, count_if(r = 'conflict') AS conflict, count_if(r = 'missingInAdditional') AS \"missingInAdditional\", count_if(r = 'candidate') AS candidate, count_if(r = 'unsupported') AS unsupported, count_if(e = r) / count(e) AS accuracy FROM x")
def crosscheck_breakdown(t) -> DataFrame:
    expected = F.when(F.col("n") % 3 == 0, "matched").when(F.col("n") % 3 == 1, "conflict")
    return E.cross_check_breakdown(checked_records(t).select(F.col("cv_result").alias("result"), expected.alias("expected")))


_REVIEWED = "(o1 IS NOT NULL OR status <> 'review')"


@query(f"WITH {T.R_SQL} SELECT count(DISTINCT report_id) AS reports, count(*) AS damages, count_if({_REVIEWED}) AS reviewed, count_if(NOT {_REVIEWED}) AS unreviewed, count_if(o1 IS NOT NULL) AS modified, count_if(id LIKE 'NEW-%') AS added, count_if(status = 'excluded') AS excluded FROM r")
def work_summary(t) -> DataFrame:
    return E.work_summary(T.records(t))


def _retention_sql(source: str, by: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {by}'{f}' AS field, count_if(o1 IS DISTINCT FROM '{f}') AS retained, count(*) FILTER (o1 = '{f}') AS modified, count_if(o1 IS DISTINCT FROM '{f}') / count(*) AS value, count(*) AS sample, count(*) >= 5 AS sufficient FROM {source} WHERE {_REVIEWED}" + (" GROUP BY version" if by else "")
        for f in E.TRACKED
    )


@query(f"WITH {T.R_SQL} {_retention_sql('r', '')}")
def reviewed_field_retention(t) -> DataFrame:
    return E.field_retention(T.records(t), [])


@query(f"""WITH {T.R_SQL}, i AS (SELECT user_id AS report_id, concat_ws('|', event_type, 'm', 'p', (event_id % 2)::VARCHAR) AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE value >= 50),
v AS (SELECT r.*, version FROM r JOIN i USING (report_id) WHERE k = 1) {_retention_sql('v', 'version, ')}""")
def version_field_retention(t) -> DataFrame:
    kind = F.when(F.col("value") >= 50, "initial").otherwise("again")
    runs = t("events").select(F.col("user_id").alias("report_id"), kind.alias("kind"), F.col("event_id").alias("run_number"), F.col("event_type").alias("provider"), F.lit("m").alias("model"), F.lit("p").alias("prompt"), (F.col("event_id") % 2).cast("string").alias("engine"))
    return E.version_retention(T.records(t), runs)


@query(f"""WITH {T.P_SQL} SELECT 'extraction' AS metric, count_if(extraction_status = 'ok') / count(*) AS value, count(*) AS sample, count(*) >= 5 AS sufficient FROM p
UNION ALL SELECT 'links', count_if(match_status = 'confirmed' AND match_source = 'auto') / count_if(match_source = 'manual' OR match_status = 'confirmed' AND match_source = 'auto'), count_if(match_source = 'manual' OR match_status = 'confirmed' AND match_source = 'auto'), count_if(match_source = 'manual' OR match_status = 'confirmed' AND match_source = 'auto') >= 5 FROM p
UNION ALL SELECT 'changes', count_if(user_id % 3 <> event_id % 3) / count(*), count(*), count(*) >= 5 FROM events WHERE event_type = 'click'""")
def quality_shares(t) -> DataFrame:
    events = t("events").select(F.when(F.col("event_type") == "click", "cross_validation_resolved").otherwise("other").alias("type"), (F.col("user_id") % 3).alias("from"), (F.col("event_id") % 3).alias("to"))
    named = lambda name, df: df.select(F.lit(name).alias("metric"), "*")
    return named("extraction", E.extraction_quality(T.photos(t))).unionByName(named("links", E.link_retention(T.photos(t)))).unionByName(named("changes", E.change_rate(events)))


@query(f"WITH {T.R_SQL} SELECT report_id, count(*) AS total, count_if(status = 'conflict') AS conflict, count_if({_RESULT} = 'matched') AS matched, count_if({_RESULT} IS NULL) AS unchecked FROM r GROUP BY 1")
def panel_counters(t) -> DataFrame:
    records = T.records(t).withColumn("cv_result", _result())
    return E.counters(records, ["report_id"], {"conflict": F.col("status") == "conflict", "matched": F.col("cv_result") == "matched", "unchecked": F.col("cv_result").isNull()})


@query("SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(event_id))::INT AS place FROM events GROUP BY 1")
def most_frequent_events(t) -> DataFrame:
    return E.most_frequent(t("events"), "event_type", "event_id")


@query(f"WITH {_PAIRS} SELECT status, count(*) AS n, min(score)::INT AS lowest FROM x GROUP BY 1")
def link_tiers(t) -> DataFrame:
    return M.photo_pairs(T.photos(t), T.records(t)).groupBy("status").agg(F.count("*").alias("n"), F.min("score").alias("lowest"))


@query(f"WITH {_STATUS}, {_FOLD.replace(T.R_SQL + ', ', '')} SELECT c.id, cv_result, photo_status FROM c JOIN y ON y.report_id = c.report_id AND y.id = c.id")
def reanalysed_records(t) -> DataFrame:
    return M.reanalyse(T.records(t), T.photos(t), T.evidence(t))[0].select("id", "cv_result", "photo_status")


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red widget') THEN 'whole' WHEN contains(p_name, 'widget') THEN 'thing' WHEN contains(p_name, 'red') THEN 'colour' END AS field FROM part")
def header_fields(t) -> DataFrame:
    return t("part").select("p_partkey", P.header_field(F.col("p_name"), {"red": "colour", "widget": "thing", "red widget": "whole"}).alias("field"))
