"""Segmented scans, pairs of the one-to-one match and approvals on hand-made rows: ties, nulls, repeats, hot keys, empty tables."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from corroborate.operators import approvals as A
from corroborate.operators import evaluation as E
from corroborate.operators import linkage as L
from corroborate.operators import merging as G
from corroborate.operators import report as R
from corroborate.operators import scan
from corroborate.operators import truth as K


def test_scans_equal_windows_on_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(60)]), k, rng.choice([None, "x", "y", f"v{k}"])) for k in range(900)]
    frame = spark.createDataFrame(rows, "key string, at int, id int, v string").repartition(5)
    w = Window.partitionBy("key").orderBy("at", "id")
    want = {r["id"]: (r["n"], r["l"], r["p"]) for r in frame.select("id", F.row_number().over(w).alias("n"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("l"), F.lag(F.struct("v")).over(w).alias("p")).collect()}
    for position in ("at", "shown", "when"):
        own = frame.withColumns({"shown": F.lpad(F.col("at").cast("string"), 3, "0"), "when": F.timestamp_seconds("at")})
        order = [position, "id"]
        a = {r["id"]: r["n"] for r in scan.numbered(own, ["key"], order, "n", 16).collect()}
        b = {r["id"]: r["l"] for r in scan.last_seen(own, ["key"], order, F.col("v"), "l", 16).collect()}
        c = {r["id"]: r["p"] for r in scan.lagged(own, ["key"], order, F.col("v"), "p", 16).collect()}
        assert len(a) == len(rows) and {i: (a[i], b[i], c[i]) for i in a} == want
    per = scan.segmented(frame, "at", 16).where("key = 'hot'").groupBy("_seg").count().collect()
    assert len(per) > 8 and max(r["count"] for r in per) < 150
    assert scan.numbered(frame.limit(0), ["key"], ["at"], "n").count() == 0


TRUTH = "case_id int, ordinal int, id string, section string, damage_name string, part string, sub_part string, location string, quantity string, quantity_group string, repair_method string, pages array<int>, photo_nos array<string>, expected string"
FOUND = TRUTH.replace("photo_nos", "photo_ids").replace("expected", "cv_result")
PHOTO = "case_id int, ordinal int, id string, photo_no string, page int"


def damage(ordinal, id_, name="균열", place="10m", part="사면", amount=None, pages=(), listed=(), result=None, case=1, sub="도수로", group=None, repair="x"):
    return (case, ordinal, id_, "1구간", name, part, sub, place, amount, group, repair, list(pages), list(listed), result)


def test_pairs_errors_and_photo_links(spark):
    truth = spark.createDataFrame([
        damage(1, "T1", pages=(3, 4), listed=["P1"], amount="3m", result="matched"),
        damage(2, "T2", place="STA.10.0 m"), damage(3, "T3", name="크랙", place=None), damage(4, "T4", name="누수", sub=None, listed=["P9", " P9 "]), damage(1, "U1", case=2),
    ], TRUTH)
    found = spark.createDataFrame([damage(5, "F1", name=" Crack", amount=" 3 m", part="기타", listed=["Q1", "none"], result="matched"), damage(9, "F3", name="침출수", sub="", listed=[]), damage(6, "F2", place="11m", pages=(7,))], FOUND)
    pairs = K.damage_pairs(truth, found)
    shown = {(r["side"], r["t"] and r["t"]["id"], r["f"] and r["f"]["id"]) for r in pairs.collect()}
    assert shown == {("matched", "T1", "F1"), ("missed", "T2", None), ("missed", "T3", None), ("matched", "T4", "F3"), ("extra", None, "F2"), ("missed", "U1", None)}
    assert {r["field"]: (r["matched"], r["total"]) for r in K.field_accuracy(pairs).collect()} == {"damage_name": (2, 2), "part": (1, 2), "sub_part": (2, 2), "location": (2, 2), "quantity": (2, 2), "repair_method": (2, 2)}
    truth_photos = spark.createDataFrame([(1, 1, "X1", "P 1", 1, ["T1"]), (1, 2, "X2", None, 2, ["T1"]), (1, 3, "X3", None, 5, None)], PHOTO + ", linked array<string>")
    found_photos = spark.createDataFrame([(1, 1, "Q1", "P1", 1), (1, 2, "Q2", "", 2), (1, 3, "Q3", "P7", 5), (2, 1, "Q4", None, None)], PHOTO)
    links = {r["case_id"]: (r["tp"], r["fp"], r["fn"]) for r in K.photo_link_metrics(pairs, truth_photos, found_photos).collect()}
    assert links == {1: (1, 1, 2)}  # P1; none; the photo without a number and P9
    photos = K.photo_pairs(truth_photos, found_photos)
    assert sorted(r["side"] for r in photos.collect()) == ["extra", "extra", "matched", "matched", "missed"]
    errors = [tuple(r) for r in K.error_entries(pairs, photos).orderBy("case_id", "error_id").collect()]
    assert [e[:5] + (e[-1],) for e in errors] == [
        (1, "ERR-0001", "STEP 4", "part", "PART_CLASSIFICATION_ERROR", "T1"), (1, "ERR-0002", "STEP 4", None, "EXTRACTION_ERROR", "T2"), (1, "ERR-0003", "STEP 4", None, "EXTRACTION_ERROR", "T3"),
        (1, "ERR-0004", "STEP 4", None, "EXTRACTION_ERROR", "F2"), (1, "ERR-0005", "STEP 6", "photo", "PHOTO_EXTRACTION_ERROR", None), (1, "ERR-0006", "STEP 6", "photo", "PHOTO_EXTRACTION_ERROR", None),
        (2, "ERR-0001", "STEP 4", None, "EXTRACTION_ERROR", "U1"), (2, "ERR-0002", "STEP 6", "photo", "PHOTO_EXTRACTION_ERROR", None),
    ]
    assert errors[0][5:9] == ("사면", "기타", "p.3, p.4", None) and errors[3][5:9] == (None, "균열 / 도수로 / 11m", None, "p.7") and errors[4][5] == "- (p.5)"
    bundle = {r["case_id"]: r for r in K.validation_bundle(spark.createDataFrame([(1,), (2,), (3,)], "case_id int"), truth, found, truth_photos, found_photos).collect()}
    assert bundle[1]["matched"] == 1 and bundle[1]["accuracy"] == 1.0 and bundle[3]["status"] == "FAIL" and bundle[3]["fields"]["part"] == 0.0
    assert K.damage_pairs(truth.limit(0), found.limit(0)).count() == 0


def test_equal_keys_meet_in_turn(spark):
    truth = spark.createDataFrame([damage(k, f"T{k:03}") for k in range(300)], TRUTH).repartition(4)
    found = spark.createDataFrame([damage(1000 - k, f"F{1000 - k:04}") for k in range(200)], FOUND).repartition(4)
    got = {(r["t"]["id"], r["f"] and r["f"]["id"]) for r in K.damage_pairs(truth, found).collect()}
    assert got == {(f"T{k:03}", f"F{801 + k:04}" if k < 200 else None) for k in range(300)}


RECORD = "report_id int, ordinal long, id string, section string, damage_name string, part string, sub_part string, location string, repair_method string, quantity string, group_no string, group_index int, status string, pages array<int>, refs array<struct<page:int,type:string,excerpt:string>>, notes string, extra string"
CANDIDATE = "report_id int, candidate_id string, section string, damage_name string, part string, sub_part string, location string, repair_method string, quantity string, source_type string, file string, page int, quote string"


def walked(records, candidates, approved):
    """One approval after the other."""
    import re

    norm = lambda x: re.sub(r"\s", "", x or "")
    place = lambda x: re.sub(r"^STA\.?", "", norm(x))
    stand = {r[0]: [] for r in [*records, *candidates]}
    for r in sorted(records, key=lambda r: r[1]):
        stand[r[0]].append((norm(r[3]), norm(r[4]), r[5], norm(r[6]), place(r[7]), r[2]))
    by, out = {(c[0], c[1]): c for c in candidates}, {}
    for report, i, _ in sorted(approved, key=lambda a: a[2]):
        c = by.get((report, i))
        if c is None or (report, i) in out:
            continue
        hit = next((s for s in stand[report] if s[:2] == (norm(c[2]), norm(c[3])) and s[2] == (s[2] if c[4] is None else c[4]) and s[3] == norm(c[5]) and s[4] == place(c[6])), None)
        out[report, i] = hit and hit[5]
        if hit is None:
            stand[report].append((norm(c[2]), norm(c[3]), "기타" if c[4] is None else c[4], norm("-" if c[5] is None else c[5]), place(c[6]), i))
    return out


def test_approvals_are_records_for_the_next(spark):
    rng = random.Random(8)
    pick = lambda *x: rng.choice(x)
    records = [(r, k, f"R{r}-{k}", pick("s", " s", None), pick("균열", ""), pick("사면", "기타"), pick("도수로", "-", ""), pick("10m", ""), "", None, "G", 1, "review", [1], [(1, "t", None)], None, "e") for r in (1, 2) for k in range(3)]
    candidates = [(r, f"C{k:03}", pick("s", None), pick("균열", None), pick("사면", None, "기타", "배수시설"), pick("도수로", None, "-", ""), pick("10m", "STA. 10m", None), None, None, "map", "f", pick(None, 4), f"q{k}") for r in (1, 2, 3) for k in range(120)]
    approved = [(r, f"C{k:03}", rng.randrange(10**6)) for r in (1, 2, 3) for k in range(0, 120) if k % 7] + [(1, "C001", 5), (1, "C001", 6), (2, "none", 1), (9, "C001", 1)]
    frames = spark.createDataFrame(records, RECORD), spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(approved, "report_id int, candidate_id string, turn int")
    got = {(r["report_id"], r["candidate_id"]): r["target"] for r in A.outcomes(*frames).collect()}
    assert got == walked(records, candidates, approved)
    now, left = A.approve(*frames)
    assert now.columns == frames[0].columns and now.count() == len(records) + sum(t is None for t in got.values()) and left.count() == len(candidates) - len(got)
    refs = {(r["report_id"], r["id"]): len(r["refs"]) for r in now.collect()}
    assert sum(refs.values()) == len(records) + len(got)
    empty = [f.limit(0) for f in frames]
    assert A.outcomes(*empty).count() == 0 and A.approve(*empty)[0].count() == 0


def test_approvals_of_one_turn_follow_each_other(spark):
    rng = random.Random(4)
    pick = lambda *x: rng.choice(x)
    records = [(1, 0, "R1", "s", "균열", "사면", "-", "", "", None, "G", 1, "review", [1], [(1, "t", None)], None, "e")]
    candidates = [(r, f"C{k:02}", "s", pick("균열", "누수"), pick("사면", None), pick("도수로", "-", None), "", None, None, "map", "f", 1, f"q{k}") for r in (1, 2) for k in range(60)]
    approved = [(r, f"C{k:02}", k // 20) for r in (1, 2) for k in range(60)]
    frames = spark.createDataFrame(records, RECORD), spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(approved, "report_id int, candidate_id string, turn int")
    got = {(r["report_id"], r["candidate_id"]): r["target"] for r in A.outcomes(*frames).collect()}
    assert got == walked(records, candidates, sorted(approved))


def test_the_last_change_is_decided_among_equals(spark):
    records = spark.createDataFrame([(1, "a", False), (1, "b", True)], "report_id int, id string, no_photo boolean")
    changes = spark.createDataFrame([(1, "a", k % 2 == 0, 5) for k in range(40)] + [(1, "b", True, 1), (1, "b", False, 2)], "report_id int, id string, on boolean, at int").repartition(7)
    assert {(r["id"], r["no_photo"]) for r in R.override_no_photo(records, changes).collect()} == {("a", True), ("b", False)}


def test_a_page_named_twice_is_one_page(spark):
    from tests.test_inspection import RECORD as ROW
    from tests.test_inspection import record

    rows = [record("1", "10m", (3, 3)), record("2", "99m", (4,)), record("3", "7m", (5, 5), section="t"), record("4", "8m", (5,), section="t")]
    assert {r["id"] for r in G.merge_records(spark.createDataFrame(rows, ROW)).collect()} == {"1", "3", "4"}


def test_conflicts_name_their_values_and_pages(spark):
    from tests.test_inspection import RECORD as ROW
    from tests.test_inspection import record

    rows = [record("1", repair_method="a b", quantity="3m", quantity_group="x", pages=(4, 2)), record("2", repair_method="c", quantity=" ", pages=(1,), group_index=0), record("3", repair_method=" ab", quantity="5m", quantity_group=None, pages=(9,), group_index=2),
            record("4", "20m", (7,), section="t", group_index=3), record("5", "20m", (8,), section="t", group_no=" G"), record("6", "30m", (5,), section="t"), record("7", "1m", (6,), section="u")]
    frame = spark.createDataFrame(rows, ROW)
    got = {(r["id"], r["field"]): [tuple(v) for v in r["values"]] for r in G.merge_conflicts(frame).collect()}
    assert got == {("2", "repair_method"): [("c", 1), ("a b", 4)], ("2", "quantity"): [("3m", 4), ("5m", 9)], ("5", "location"): [("20m", 7), ("30m", 5)]}
    merged = {r["id"]: r for r in G.merge_records(frame).collect()}
    assert {(i, f) for i, f in got} == {(i, f) for i, r in merged.items() for f in r["conflicts"]}
    photos = spark.createDataFrame([(1, "4", 0, "b"), (1, "5", 1, "a"), (1, "5", 0, "c"), (1, "6", 0, "a"), (1, "6", 1, "d"), (1, "3", 0, None), (1, "no", 0, "z")], "report_id int, record_id string, seq int, photo_id string")
    listed = {r["id"]: r["photos"] for r in G.merged_photos(frame, photos).collect()}
    assert set(listed) == set(merged) and listed["2"] == listed["7"] == [] and listed["5"] == ["c", "a", "b", "d"]
    empty = frame.limit(0)
    assert G.merge_conflicts(empty).count() == 0 and G.merged_photos(empty, photos).count() == 0


def test_a_choice_narrows_only_its_reports(spark):
    rows = spark.createDataFrame([(1, "a", "review"), (1, "b", "review"), (2, "a", "review"), (2, "b", "excluded")], "report_id int, id string, status string")
    shown = lambda chosen: {(r["report_id"], r["id"]) for r in R.final_records(rows, chosen).collect()}
    one = spark.createDataFrame([(1, "a"), (1, None)], "report_id int, id string")
    assert shown(one) == {(1, "a"), (2, "a")} and shown(one.limit(0)) == shown(None) == {(1, "a"), (1, "b"), (2, "a")}


def test_a_second_check_keeps_decisions_and_history(spark):
    from corroborate.operators import matching as M
    from tests.test_inspection import EVIDENCE
    from tests.test_inspection import RECORD as ROW
    from tests.test_inspection import record

    records = spark.createDataFrame([record("1", repair_method=""), record("2", "77m", sub_part="소단측구")], ROW)
    same = ("s", "균열", "사면", "도수로")
    rows = [(1, 1, 1, "t", *same, "10m", "표면처리", None, "1"), (1, 2, 1, "t", *same, "12m", "그라우팅", None, "1"), (1, 2, 2, "t", None, None, None, None, None, None, None, None)]
    first = M.remember(M.cross_check(records, spark.createDataFrame(rows, EVIDENCE)))
    one = {r["id"]: r for r in first.collect()}
    assert [(c["field"], c["main"], c["other"], c["document_no"]) for c in one["1"]["conflicts"]] == [("location", "10m", "12m", 2), ("repair_method", "표면처리", "그라우팅", 2)]
    assert one["1"]["cv_result"] == "conflict" and one["1"]["review_required"] and one["1"]["field_states"]["repair_method"] == "conflict" and one["2"]["cv_result"] == "missingInAdditional"
    assert [(e["field"], e["value"], e["document_no"]) for e in one["1"]["enrichments"]] == [("repair_method", "표면처리", 1)]
    decisions = [(1, "1", "location", "11m", None, "t1"), (1, "1", "location", "12m", "seen", "t2"), (1, "1", "repair_method", "절취", None, "t3")]
    settled = M.settle(first, spark.createDataFrame(decisions, "report_id int, id string, field string, value string, reason string, decided_at string"))
    two = {r["id"]: r for r in settled.collect()}
    assert (two["1"]["location"], two["1"]["repair_method"], two["1"]["cv_result"], two["1"]["field_states"]["repair_method"]) == ("12m", "절취", "matched", "matched") and two["2"]["cv_result"] == "missingInAdditional"
    again = M.remember(M.cross_check(records, spark.createDataFrame(rows[:2], EVIDENCE)), settled.select("report_id", "id", "conflicts", "enrichments", "group_confirmed"))
    three = {r["id"]: r for r in again.collect()}
    assert three["1"]["cv_result"] == "matched" and [c["resolved"]["value"] for c in three["1"]["conflicts"]] == ["12m", "절취"] and len(three["1"]["enrichments"]) == 2
    documents = spark.createDataFrame([(1, d, s, f"f{d}", "map", 4, "q") for d in (1, 2) for s in (1, 2)], "report_id int, document_no int, seq int, file string, type string, page int, quote string")
    shown = R.check_rows(M.evidence_rows(again, documents), M.conflict_rows(again, documents)).collect()
    assert {(r["file"], r["item"], r["result"], r["decision"]) for r in shown} == {("f1", "확인", "일치", "-"), ("f2", "location", "불일치", "12m 확정 (seen)"), ("f2", "repair_method", "불일치", "절취 확정 (수동)")}
    assert R.source_rows(again, M.evidence_rows(again, documents)).where("field = '교차검증'").count() == 2
    assert R.history_rows(spark.createDataFrame([], "report_id int, id string, field string, original string, to string, at string"), M.conflict_rows(again, documents)).count() == 2


def test_counters_are_null_where_nothing_is_known(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, None), (3, "b")], "report_id int, result string")
    got = {r["report_id"]: (r["total"], r["a"], r["none"]) for r in E.counters(rows, ["report_id"], {"a": F.col("result") == "a", "none": F.col("result").isNull()}).collect()}
    assert got == {1: (2, None, 2), 2: (2, 1, 1), 3: (1, 0, 0)}


def test_references_of_one_turn_stand_by_candidate(spark):
    records = [(1, 0, "R1", "s", "균열", "사면", "-", "", "", None, "G", 1, "review", [1], [(1, "t", None)], None, "e")]
    candidates = [(1, f"C{k}", "s", "균열", "사면", "-", "", None, None, "map", "f", 9 - k, f"q{k}") for k in range(4)]
    frames = spark.createDataFrame(records, RECORD), spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame([(1, f"C{k}", 7) for k in range(4)], "report_id int, candidate_id string, turn int")
    assert [r["excerpt"] for r in A.approve(*frames)[0].first()["refs"]] == [None, "q0", "q1", "q2", "q3"]


def _linked(spark, rng, n, m):
    """Rows with keys, values that tie, nulls and no partner, and what ``link`` takes."""
    pick = lambda k: rng.choice([None, *range(k)])
    a = spark.createDataFrame([(k, k % 40, rng.randrange(3), pick(3), float(rng.randrange(60))) for k in range(n)], "a int, a_no int, a_on int, a_kind int, a_x double")
    b = spark.createDataFrame([(k, k % 40, rng.randrange(3), pick(3), float(rng.randrange(60))) for k in range(m)], "b int, b_no int, b_on int, b_kind int, b_x double")
    near, kind, no = F.abs(F.col("a_x") - F.col("b_x")) <= 5, F.col("a_kind") == F.col("b_kind"), F.col("a_no") == F.col("b_no")
    return a, b, F.col("a_on") == F.col("b_on"), {"no": (no, 30), "near": (near, 20), "kind": (kind, 15), "band": (F.col("a_no") % 5 == F.col("b_no") % 5, 10)}, no & ~near, 75


def test_the_best_links_need_not_all_pairs(spark):
    steps = [[("no", "kind")], [("no",)], [("no",), ("kind", "band")]]
    for n, m in ((50, 600), (50, 60), (20, 3), (0, 5), (5, 0)):
        linked = _linked(spark, random.Random(n + m), n, m)
        order = [F.desc("score"), F.asc("b")]
        want = sorted(map(tuple, L.top_k(L.link(*linked), ["a"], order, 5).select("a", "b", "score", "rank").collect()))
        assert sorted(map(tuple, L.top_linked(*linked, ["a"], order[1:], 5, steps).select("a", "b", "score", "rank").collect())) == want, (n, m)


def test_near_and_far_are_told_without_pairs(spark):
    rng, reach, nan = random.Random(5), 0.1, float("nan")
    number = lambda: rng.choice([None, nan, float("inf"), 0.0, 1e300, *[rng.randrange(40) / 10 + d for d in (0, 1e-16, 0.05)] * 3])
    left, right = ([(k, rng.choice([None, 1, 2, 3, 4]), number()) for k in range(n)] for n in (300, 60))
    got = {r["i"]: (r["near"], r["far"]) for r in L.near_and_far(*[spark.createDataFrame(x, "i int, k int, v double") for x in (left, right)], ["k"], "v", reach).collect()}
    for i, k, v in left:
        holds = [abs(v - x) <= reach for _, q, x in right if k is not None and q == k and v is not None and x is not None]
        assert got[i] == (any(holds), not all(holds)), (i, k, v)


def test_linked_rows_are_dealt_to_all_tasks(spark):
    rows = spark.range(0, 1000, 1, 1)
    pairs = L.link(rows.select(F.col("id").alias("a")), rows.select(F.col("id").alias("b")), F.col("a") % 5 == F.col("b") % 5, {"x": (F.col("a") == F.col("b"), 10)}, F.lit(False), 10)
    assert pairs.count() == 1000 and pairs.rdd.getNumPartitions() > 1
