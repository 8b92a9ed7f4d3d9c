"""Queries of review state, evaluation and parsing operators, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions import parse as P
from corroborate.operators import linkage as L
from corroborate.operators import review as R
from corroborate.operators import state as S

from .registry import query

_EDITS = """
e AS (SELECT user_id AS c_custkey, CASE WHEN value >= 50 THEN 'segment' ELSE 'status' END AS field, event_type AS new, event_id FROM events),
o AS (SELECT c_custkey, 'segment' AS field, c_mktsegment AS old FROM customer UNION ALL SELECT c_custkey, 'status', NULL FROM customer),
s AS (SELECT c_custkey, field, new, event_id, old, row_number() OVER w AS k, lag(new) OVER w AS p FROM e JOIN o USING (c_custkey, field) WINDOW w AS (PARTITION BY c_custkey, field ORDER BY event_id)),
h AS (SELECT c_custkey, field, CASE WHEN k = 1 THEN old ELSE p END AS was, new, event_id, old FROM s WHERE CASE WHEN k = 1 THEN old ELSE p END IS DISTINCT FROM new)"""


def _edited(t) -> tuple[DataFrame, DataFrame]:
    records = t("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit(None).cast("string").alias("status"))
    field = F.when(F.col("value") >= 50, "segment").otherwise("status")
    edits = t("events").select(F.col("user_id").alias("c_custkey"), field.alias("field"), F.col("event_type").alias("to"), "event_id")
    return records, S.edit_history(records, edits, "c_custkey", ["segment", "status"], "event_id")


@query(f"""WITH {_EDITS} SELECT c_custkey, field, was AS "from", new AS "to", event_id, old AS original FROM h""")
def field_edit_history(t) -> DataFrame:
    return _edited(t)[1]


@query(f"""
WITH {_EDITS}, l AS (SELECT c_custkey, max_by(new, CASE WHEN field = 'segment' THEN event_id END) AS g, max_by(new, CASE WHEN field = 'status' THEN event_id END) AS s, count(DISTINCT field) AS n FROM h GROUP BY 1)
SELECT c.c_custkey, coalesce(g, c_mktsegment) AS segment, s AS status, coalesce(n, 0)::INT AS n_overrides FROM customer c LEFT JOIN l ON l.c_custkey = c.c_custkey
""")
def field_edits_applied(t) -> DataFrame:
    records, history = _edited(t)
    return S.apply_edits(records, history, "c_custkey", ["segment", "status"], "event_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_put_by_id(t) -> DataFrame:
    e = t("events").select("user_id", "event_type", "event_id")
    return S.upsert(e.where("value < 50"), e.where("value >= 50 or value is null"), "user_id", "event_id")


@query("SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'none') AS source, 0 AS version, lang IS NULL AS legacy FROM documents")
def legacy_migration(t) -> DataFrame:
    rows = t("documents").select("doc_id", "lang", "source")
    return S.migrate(rows, {"lang": F.lit("unknown"), "source": F.lit("none"), "version": F.lit(0)}, F.col("lang").isNull())


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) THEN 'C' ELSE o_orderstatus END AS o_orderstatus FROM orders
""")
def bulk_confirm(t) -> DataFrame:
    ids = t("lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.bulk_set(t("orders").select("o_orderkey", "o_orderstatus"), ids, "o_orderkey", "o_orderstatus", "C", ["F"])


@query("""
WITH l AS (SELECT l_partkey, l_suppkey, max((l_returnflag = 'A')::INT) AS m FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY ALL)
SELECT l_partkey, l_suppkey, CASE WHEN m = 1 THEN 'manual' ELSE 'auto' END AS match_source FROM l
WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'N' AND x.l_partkey = l.l_partkey AND x.l_suppkey = l.l_suppkey)
""")
def manual_relink(t) -> DataFrame:
    x = t("lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    parts = [x.where(F.col("l_returnflag") == f) for f in "RAN"]
    return S.relink(*parts, ["l_partkey", "l_suppkey"])


@query("""
WITH r AS (SELECT s_nationkey, min(s_suppkey) AS target FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT c_custkey, target, CASE WHEN target IS NULL THEN 'new' ELSE 'duplicate' END AS outcome FROM customer LEFT JOIN r ON c_nationkey = s_nationkey
""")
def candidate_approval(t) -> DataFrame:
    candidates = t("customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    records = t("supplier").where("s_acctbal > 0").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return S.approve(candidates, records, ["nation"], "c_custkey", "s_suppkey")


@query("""
WITH s AS (SELECT event_id, CASE WHEN value >= 50 THEN 'completed' ELSE 'open' END AS now, lag(CASE WHEN value >= 50 THEN 'completed' ELSE 'open' END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT event_id, was AS "from", now AS "to" FROM s WHERE now = 'completed' AND was <> now
""")
def status_transitions(t) -> DataFrame:
    status = F.when(F.col("value") >= 50, "completed").otherwise("open")
    return S.transitions(t("events"), "user_id", ["ts", "event_id"], status, ["completed"]).select("event_id", "from", "to")


@query("SELECT s_suppkey, printf('AD%03d', row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)) AS id FROM supplier")
def sequential_ids(t) -> DataFrame:
    return S.numbered(t("supplier"), "s_nationkey", ["s_suppkey"], "AD", 3).select("s_suppkey", "id")


@query("SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_linenumber)) AS l_suppkey, min((l_orderkey, l_linenumber))[1] AS l_orderkey, arg_min(l_linenumber, (l_orderkey, l_linenumber)) AS l_linenumber FROM lineitem GROUP BY 1")
def first_row_per_group(t) -> DataFrame:
    return S.first_of_group(t("lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"), "l_partkey", ["l_orderkey", "l_linenumber"])


@query("""
WITH a AS (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderpriority <> '1-URGENT'),
b AS (SELECT l_orderkey AS o_orderkey, min(l_linestatus) AS s FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missed' WHEN a.o_orderkey IS NULL THEN 'extra' ELSE 'field' END AS category,
  CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL THEN 'status' END AS field,
  CASE WHEN b.o_orderkey IS NOT NULL THEN a.s END AS expected, CASE WHEN a.o_orderkey IS NOT NULL THEN b.s END AS actual
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.s IS DISTINCT FROM b.s OR a.o_orderkey IS NULL OR b.o_orderkey IS NULL
""")
def error_entries(t) -> DataFrame:
    truth = t("orders").where("o_orderpriority <> '1-URGENT'").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    found = t("lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("status"))
    return S.error_entries(truth, found, "o_orderkey", ["status"])


@query("""
WITH r AS (SELECT user_id, count_if(value >= 10) / count(*) AS f1 FROM events GROUP BY 1),
s AS (SELECT f1, CASE WHEN f1 >= 0.9 THEN 'GOOD' WHEN f1 >= 0.75 THEN 'WARNING' ELSE 'FAIL' END AS status FROM r)
SELECT count(*) AS n_cases, count_if(status = 'GOOD') AS good, count_if(status = 'WARNING') AS warning, count_if(status = 'FAIL') AS fail, coalesce(round(avg(f1), 9), 0) AS mean_f1 FROM s
""")
def overall_summary(t) -> DataFrame:
    by = t("events").groupBy("user_id").agg((F.count_if(F.col("value") >= 10) / F.count("*")).alias("f1")).withColumn("status", S.grade(F.col("f1")))
    counted = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("GOOD", "WARNING", "FAIL")]
    return by.agg(F.count("*").alias("n_cases"), *counted, F.coalesce(F.round(F.avg("f1"), 9), F.lit(0.0)).alias("mean_f1"))


@query("""
WITH c AS (SELECT count(*) AS pairs, count(DISTINCT nullif(source, '')) AS formats, count(DISTINCT nullif(lang, '')) AS facilities FROM documents)
SELECT pairs, formats, facilities, concat_ws('; ', CASE WHEN pairs < 10 THEN 'fewer than 10 pairs' END, CASE WHEN formats < 2 THEN 'one format' END, CASE WHEN facilities < 2 THEN 'one facility' END) AS reasons,
  pairs >= 10 AND formats >= 2 AND facilities >= 2 AS met FROM c
""")
def universality_criteria(t) -> DataFrame:
    c = t("documents").agg(F.count("*").alias("pairs"), *[F.count_distinct(F.nullif(F.col(x), F.lit(""))).alias(n) for x, n in (("source", "formats"), ("lang", "facilities"))])
    short = c.withColumns({"few": (F.col("pairs") < 10).cast("int"), "mono": (F.col("formats") < 2).cast("int"), "one": (F.col("facilities") < 2).cast("int")})
    gated = R.gate(short, {"few": "fewer than 10 pairs", "mono": "one format", "one": "one facility"})
    return gated.select("pairs", "formats", "facilities", "reasons", F.col("can_finalize").alias("met"))


@query("SELECT event_type, CASE WHEN count_if(value >= 50) > 0 THEN round(sum(CASE WHEN value >= 50 THEN value ELSE 0 END), 4) END AS tokens FROM events GROUP BY 1")
def usage_sums(t) -> DataFrame:
    used = F.when(F.col("value") >= 50, F.col("value"))
    return t("events").groupBy("event_type").agg(F.when(F.count(used) > 0, F.round(F.sum(F.coalesce(used, F.lit(0.0))), 4)).alias("tokens"))


@query("""
WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'),
c AS (SELECT count_if(a.l_partkey IS NOT NULL AND b.l_partkey IS NOT NULL) AS tp, count_if(a.l_partkey IS NULL) AS fp, count_if(b.l_partkey IS NULL) AS fn
  FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey),
r AS (SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM c)
SELECT tp, fp, fn, p AS precision, q AS recall, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f1 FROM r
""")
def link_set_metrics(t) -> DataFrame:
    sides = t("lineitem").where("l_returnflag in ('R', 'A')").groupBy("l_partkey", "l_suppkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("x"), F.bool_or(F.col("l_returnflag") == "A").alias("y"))
    return L.precision_recall_f1(R.counts(sides, {"tp": F.col("x") & F.col("y"), "fp": ~F.col("x"), "fn": ~F.col("y")}))


@query("""
SELECT unnest(['all', 'finished', 'no_source', 'no_language', 'short', 'modified']) AS filter,
  unnest([count(*), count_if(source = 'src0'), count_if(trim(coalesce(source, '')) = ''), count_if(trim(coalesce(lang, '')) = ''), count_if(n_chars < 200), count_if(length(text) IS DISTINCT FROM n_chars)]) AS n FROM documents
""")
def review_filter_counts(t) -> DataFrame:
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    filters = {"all": F.lit(True), "finished": F.col("source") == "src0", "no_source": blank("source"), "no_language": blank("lang"), "short": F.col("n_chars") < 200, "modified": ~F.length("text").eqNullSafe(F.col("n_chars"))}
    return R.counts(t("documents"), filters).unpivot([], list(filters), "filter", "n")


_KEYS = ["the", "how", "what", "please"]


@query("""
WITH r AS (SELECT conv_id, turn + 1 AS row_no, string_split(text, ' ') AS cells FROM conversations),
h AS (SELECT conv_id, min(row_no) AS top FROM r WHERE row_no <= 5 AND len(list_filter(cells, lambda c: contains(c, 'the') OR contains(c, 'how') OR contains(c, 'what') OR contains(c, 'please'))) >= 2 GROUP BY 1),
n AS (SELECT conv_id, top, min(cells) AS names FROM h JOIN r USING (conv_id) WHERE row_no = top GROUP BY ALL),
b AS (SELECT r.conv_id, row_no, cells, names, unnest(range(1, len(cells) + 1)) AS column_no FROM r LEFT JOIN n ON n.conv_id = r.conv_id WHERE top IS NULL OR row_no > top)
SELECT conv_id, row_no, column_no, names[column_no] AS name, cells[column_no] AS value FROM b
""")
def table_candidates(t) -> DataFrame:
    rows = t("conversations").select("conv_id", (F.col("turn") + 1).alias("row_no"), F.split("text", " ").alias("cells"))
    return S.table_candidates(rows, "conv_id", "row_no", "cells", P.keyword_hits(F.col("cells"), _KEYS))


@query("""
WITH p AS (SELECT doc_id, text, string_split_regex(text, '[0-9]+') AS gap, regexp_extract_all(text, '[0-9]+') AS hits FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, text, gap, hits, unnest(range(1, len(hits) + 1)) AS i FROM p),
s AS (SELECT doc_id, text, hits[i] AS hit, 1 + list_sum(list_transform(gap[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS pos, i FROM k),
w AS (SELECT doc_id, text, hit, pos, coalesce(lag(pos + length(hit)) OVER (PARTITION BY doc_id ORDER BY i), 1) AS last FROM s)
SELECT doc_id, pos AS start, hit, md5(substring(text, greatest(last, pos - 60), pos + length(hit) + 30 - greatest(last, pos - 60))) AS window_md5 FROM w
""")
def text_windows(t) -> DataFrame:
    found = t("documents").select("doc_id", F.explode(P.text_windows("[0-9]+")("text")).alias("w"))
    return found.select("doc_id", "w.start", "w.hit", F.md5(F.col("w.window").cast("binary")).alias("window_md5"))


@query("SELECT p_partkey, unnest([1, 2]) AS place, unnest([p_name, p_brand]) AS damage, unnest([p_size, NULL]) AS quantity FROM part")
def json_answers(t) -> DataFrame:
    item = lambda name, size: F.struct(F.col(name).alias("damage"), size.cast("int").alias("quantity"))
    answer = F.concat(F.lit("Result:\n"), F.to_json(F.array(item("p_name", F.col("p_size")), item("p_brand", F.lit(None)))), F.lit("\nDone."))
    rows = t("part").select("p_partkey", F.posexplode(P.json_rows(answer, "struct<damage:string,quantity:int>")).alias("p", "r"))
    return rows.select("p_partkey", (F.col("p") + 1).alias("place"), "r.damage", "r.quantity")


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '1-URGENT' ELSE o_orderpriority END AS priority,
  coalesce(o_orderstatus, '') || '||' || coalesce(o_orderpriority, '') AS key, CASE WHEN contains(o_orderpriority, 'URGENT') OR contains(o_orderpriority, 'HIGH') THEN 'fast' WHEN contains(o_orderpriority, 'LOW') THEN 'slow' ELSE 'normal' END AS label FROM orders
""")
def synonyms_and_keys(t) -> DataFrame:
    p = F.col("o_orderpriority")
    label = P.rule_label(p, [(["URGENT", "HIGH"], "fast"), (["LOW"], "slow")], "normal")
    return t("orders").select("o_orderkey", P.synonym(p, {"1-URGENT": ["1-URGENT", "2-HIGH"]}).alias("priority"), P.composite_key(F.col("o_orderstatus"), p).alias("key"), label.alias("label"))


@query(r"""
SELECT page_id, 'text/html' AS media_type, md5(coalesce(html, '')) AS data_md5, md5('--- 페이지 ' || page_id || ' ---' || chr(10) || coalesce(html, '')) AS prompt_md5 FROM pages
""")
def page_payloads(t) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    url = P.data_url(F.concat(F.lit("data:text/html;base64,"), F.base64(html.cast("binary"))))
    pages = t("pages").select("page_id", url.alias("u"), P.page_prompt(F.col("page_id"), F.col("html")).alias("prompt"))
    return pages.select("page_id", "u.media_type", F.md5("u.data").alias("data_md5"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))
