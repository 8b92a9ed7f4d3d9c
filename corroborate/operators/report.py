"""What a report shows and whether it may leave the house: review predicates, row sets, integrity checks, row edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import domain as D
from corroborate.functions import text as T


def _size(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def position_problem() -> Column:
    place = F.trim(F.coalesce("location", F.lit("")))
    return place.isin("", D.REVIEW)


def photo_problem() -> Column:
    return F.coalesce(F.col("photo_status").isin("review", "conflict"), F.lit(False))


def scale_problem() -> Column:
    return ~D.given(F.col("quantity")) & ~D.given(F.col("quantity_group"))


def manual_entry() -> Column:
    return F.col("id").startswith("NEW-")


def is_reviewed() -> Column:
    return (_size("overrides") > 0) | ~F.col("status").eqNullSafe("review") | (_size("history") > 0)


def review_filters() -> dict[str, Column]:
    """The 17 filters of the review table by name."""
    status, is_ = F.col("status"), (lambda c, v: F.col(c).eqNullSafe(v))
    return {
        "all": F.lit(True), "confirmed": is_("status", "confirmed"), "review": is_("status", "review"), "conflict": status.eqNullSafe("conflict") | (_size("conflicts") > 0),
        "excluded": is_("status", "excluded"), "merged": F.coalesce("merged", F.lit(False)), "sourceMissing": (_size("pages") == 0) | (_size("refs") == 0),
        "photoReview": photo_problem(), "noPhoto": F.coalesce(F.col("photo_status") == "noPhoto", F.lit(True)), "cvConflict": is_("cv_result", "conflict"),
        "cvMissing": is_("cv_result", "missingInAdditional"), "positionProblem": position_problem(), "photoProblem": photo_problem(), "scaleProblem": scale_problem(),
        "manualEntry": manual_entry(), "modified": _size("overrides") > 0, "unmodified": _size("overrides") == 0,
    }


def search_records(records: DataFrame, photos: DataFrame, text: str) -> DataFrame:
    """Records whose eight fields, or whose linked photos' numbers and pages, contain the text, case aside; a blank text finds all."""
    wanted = text.strip().lower()
    if not wanted:
        return records
    shown = F.concat_ws(" ", "photo_no", F.col("page").cast("string"))
    linked = photos.select("report_id", F.explode("linked").alias("id"), shown.alias("x")).where(F.contains(F.lower("x"), F.lit(wanted))).select("report_id", "id").distinct().withColumn("_hit", F.lit(True))
    own = F.lower(F.concat_ws(" ", "id", "section", "damage_name", "part", "sub_part", "location", "repair_method", "group_no"))
    return records.join(linked, ["report_id", "id"], "left").where(F.contains(own, F.lit(wanted)) | F.col("_hit")).drop("_hit")


def final_records(records: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """All but excluded records; of reports in ``chosen`` (report_id, id) only those named there, of the others all."""
    kept = records.where(~F.col("status").eqNullSafe("excluded"))
    if chosen is None:
        return kept
    named = chosen.select("report_id", "id").where("id is not null").distinct()
    whole = kept.join(named.select("report_id").distinct(), "report_id", "left_anti")
    return kept.join(named, ["report_id", "id"], "left_semi").unionByName(whole)


def final_photos(photos: DataFrame) -> DataFrame:
    return photos.where(F.col("extraction_status") == "ok")


def final_checks(records: DataFrame) -> DataFrame:
    return records.where("cv_result is not null").select("report_id", "id", "cv_result", "cv_confidence", "n_evidence")


def gallery(photos: DataFrame, match_status: str | None = None) -> DataFrame:
    """Photos not known to be unrelated, of one match status (null: unmatched) if given."""
    shown = photos.where(F.coalesce(F.col("related") != "false", F.lit(True)))
    return shown if match_status is None else shown.where(F.coalesce("match_status", F.lit("unmatched")) == match_status)


def quantity_shown() -> Column:
    return F.coalesce("quantity", "quantity_group", F.lit(D.DASH))


def damage_rows(records: DataFrame) -> DataFrame:
    return records.select(
        "report_id", F.col("id").alias("no"), "section", "damage_name", "part", "sub_part", "location", "repair_method", quantity_shown().alias("quantity"),
        _size("photo_ids").alias("photo_count"), D.labelled(F.col("cv_result"), D.RESULT_LABEL).alias("cross_check"), D.labelled(F.col("status"), D.STATUS_LABEL).alias("status"),
    )


def photo_rows(records: DataFrame, photos: DataFrame, unlinked: bool = True) -> DataFrame:
    """A row per linked photo and, if wanted, per photo that no record shows."""
    links = records.select("report_id", F.col("id").alias("damage_no"), F.explode("photo_ids").alias("photo_id"))
    number = F.coalesce("photo_no", "photo_id").alias("photo_no")
    sure = F.coalesce(F.concat(F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")), F.lit(D.DASH))
    rows = links.join(photos, ["report_id", "photo_id"]).select("report_id", "damage_no", number, "page", F.when(F.col("match_source") == "manual", "수동 연결").otherwise("자동 연결").alias("link"), sure.alias("confidence"))
    if not unlinked:
        return rows
    rest = photos.join(links, ["report_id", "photo_id"], "left_anti")
    return rows.unionByName(rest.select("report_id", F.lit(D.DASH).alias("damage_no"), number, "page", F.lit("미연결").alias("link"), F.lit(D.DASH).alias("confidence")))


def broken_links(records: DataFrame, photos: DataFrame) -> DataFrame:
    """report_id, id, photo_id of links to photos that do not exist."""
    return records.select("report_id", "id", F.explode("photo_ids").alias("photo_id")).join(photos.select("report_id", "photo_id"), ["report_id", "photo_id"], "left_anti")


def export_checks(records: DataFrame, photos: DataFrame, candidates: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session whether its report may be exported: finished, ok and the reasons against, with their counts."""
    active = ~F.col("status").eqNullSafe("excluded")
    broken = broken_links(records.where(active), photos).select("report_id", "id").distinct().groupBy("report_id").agg(F.count("*").alias("broken"))
    missing = lambda *fields: ~F.array_min(F.array(*[D.given(F.col(f)) for f in fields]))
    wrong = {
        "conflicts": (F.col("status") == "conflict") | F.col("cv_result").eqNullSafe("conflict"), "incomplete": missing("damage_name", "section", "part"), "photo_conflicts": F.col("photo_status").eqNullSafe("conflict"),
        "without_source": active & (_size("pages") == 0) & (_size("refs") == 0), "malformed": active & missing("id", "damage_name"),
    }
    by = records.groupBy("report_id").agg(*[F.count_if(c).alias(n) for n, c in wrong.items()])
    undecided = candidates.where("decision is null").groupBy("report_id").agg(F.count("*").alias("undecided"))
    out = sessions.join(by, "report_id", "left").join(broken, "report_id", "left").join(undecided, "report_id", "left")
    names = ["conflicts", "undecided", "incomplete", "photo_conflicts", "without_source", "broken", "malformed"]
    out = out.fillna(0, names).withColumn("unfinished", (F.col("review_status") == "in_progress").cast("long"))
    reasons = F.array_compact(F.array(*[F.when(F.col(n) > 0, n) for n in ["unfinished", *names]]))
    return out.select("report_id", *names, reasons.alias("reasons"), (F.size(reasons) == 0).alias("ok"))


def source_rows(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """Where each record comes from: its own references and the documents that confirm or contradict it."""
    own = records.select("report_id", F.col("id").alias("damage_no"), F.explode("refs").alias("x")).select("report_id", "damage_no", F.lit("기본 보고서").alias("field"), "x.type", F.lit("주 보고서").alias("file"), F.col("x.page").cast("string").alias("page"), F.coalesce("x.excerpt", F.lit(D.DASH)).alias("excerpt"))
    other = evidence.select("report_id", F.col("id").alias("damage_no"), F.lit("교차검증").alias("field"), "type", "file", F.coalesce(F.col("page").cast("string"), F.lit(D.DASH)).alias("page"), F.coalesce("quote", F.lit(D.DASH)).alias("excerpt"))
    return own.unionByName(other)


def check_rows(evidence: DataFrame, conflicts: DataFrame) -> DataFrame:
    """A row per confirming document and one per conflict with its decision."""
    agreed = evidence.where("result <> 'conflict'").select("report_id", F.col("id").alias("damage_no"), "file", F.lit("확인").alias("item"), F.lit(D.DASH).alias("main"), F.lit(D.DASH).alias("other"), F.when(F.col("result") == "matched", "일치").otherwise("미확인").alias("result"), F.lit(D.DASH).alias("decision"))
    decided = F.when(F.col("resolved").isNotNull(), F.concat("resolved", F.lit(" 확정 ("), F.coalesce("reason", F.lit("수동")), F.lit(")"))).otherwise("미해결")
    return agreed.unionByName(conflicts.select("report_id", F.col("id").alias("damage_no"), "file", F.col("field").alias("item"), "main", "other", F.lit("불일치").alias("result"), decided.alias("decision")))


def history_rows(edits: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Edits and settled conflicts with turn, their place in each report's history."""
    a = edits.select("report_id", F.col("id").alias("damage_no"), "field", F.col("original").alias("was"), F.col("to").alias("now"), F.lit("사용자 수정").alias("kind"), "at")
    b = conflicts.where("resolved is not null").select("report_id", F.col("id").alias("damage_no"), "field", F.col("main").alias("was"), F.col("resolved").alias("now"), F.lit("충돌 해결").alias("kind"), "at")
    return in_turn(a.unionByName(b), ["report_id"], [F.col("at"), F.col("damage_no"), F.col("field")], "turn")


def in_turn(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def close_review(sessions: DataFrame, done: DataFrame, by: str, at: Column) -> DataFrame:
    """Sessions named in ``done`` (report_id, action) completed or finalised; finalising raises the version."""
    out = sessions.join(done.groupBy("report_id").agg(F.max("action").alias("_action")), "report_id", "left")
    final = F.col("_action") == "finalized"
    made = {"review_status": F.coalesce("_action", "review_status"), "review_version": F.col("review_version") + F.coalesce(final.cast("int"), F.lit(0))}
    return out.withColumns(made | {"finalized_by": F.when(final, by), "finalized_at": F.when(final, at)}).drop("_action")


def add_and_delete(records: DataFrame, blanks: DataFrame, deleted: DataFrame) -> DataFrame:
    """Blank records ``NEW-<number>`` (report_id, number) added under review, then the named ones deleted."""
    made = blanks.select("report_id", F.concat(F.lit("NEW-"), F.col("number").cast("string")).alias("id"), F.lit(D.OTHER).alias("part"), F.lit(D.DASH).alias("sub_part"), F.lit("review").alias("status"))
    return records.unionByName(made, allowMissingColumns=True).join(deleted.select("report_id", "id").distinct(), ["report_id", "id"], "left_anti")


def set_locks(truths: DataFrame, changes: DataFrame) -> DataFrame:
    """Ground truths with lock changes (case_id, locked, at) applied: the last one holds, of one time the lock; all are kept as revisions in turn."""
    by = changes.groupBy("case_id").agg(F.max_by("locked", F.struct("at", "locked")).alias("_now"), F.array_sort(F.collect_list(F.struct("at", "locked"))).alias("_new"))
    out = truths.join(by, "case_id", "left")
    none = F.array().cast("array<struct<at:timestamp,locked:boolean>>")
    return out.withColumns({"locked": F.coalesce("_now", "locked"), "revisions": F.coalesce("_new", none)}).drop("_now", "_new")


def override_no_photo(records: DataFrame, changes: DataFrame) -> DataFrame:
    """``no_photo`` set or cleared by the last change (report_id, id, on, at) of a record; of changes at one time, setting it holds."""
    by = changes.groupBy("report_id", "id").agg(F.max_by("on", F.struct("at", "on")).alias("_on"))
    return records.join(by, ["report_id", "id"], "left").withColumn("no_photo", F.coalesce("_on", "no_photo")).drop("_on")


def decide_candidates(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates with the last decision (excluded or deferred) on each, of one time the later in the alphabet; none is removed."""
    by = decisions.groupBy("candidate_id").agg(F.max_by("decision", F.struct("at", "decision")).alias("_d"))
    return candidates.join(by, "candidate_id", "left").withColumn("decision", F.coalesce("_d", "decision")).drop("_d")


def export_history(exports: DataFrame) -> DataFrame:
    """Exports with ids EXP-001 and on, in turn within a report."""
    return in_turn(exports, ["report_id"], [F.col("at"), F.col("file")], "n").withColumn("export_id", F.format_string("EXP-%03d", "n")).drop("n")


def append_exports(log: DataFrame, exports: DataFrame) -> DataFrame:
    """``log`` with new exports (report_id, at, file, error and what else the log holds) behind it: ids go on after each report's
    last, and an export with an error has failed.  Rows of the log stay as they are; those without an id count for nothing."""
    last = log.groupBy("report_id").agg(F.max(F.regexp_extract("export_id", r"^EXP-(\d+)$", 1).try_cast("int")).alias("_last"))
    new = in_turn(exports, ["report_id"], [F.col("at"), F.col("file")], "_n").join(last, "report_id", "left")
    made = {"export_id": F.format_string("EXP-%03d", F.col("_n") + F.coalesce("_last", F.lit(0))), "status": F.when(D.given(F.col("error")), "failed").otherwise("success")}
    return log.unionByName(new.withColumns(made).drop("_n", "_last"), allowMissingColumns=True)


def nearby_text(boxes: DataFrame, items: DataFrame, margin: float = 60.0) -> DataFrame:
    """Text of the items within ``margin`` of each box on its page, by y and then x.

    boxes: page_id, box_id, x0, y0, x1, y1; items: page_id, x, y, text.  Pages are cut into cells of the margin's size times
    four, so that a page of many items is no one task's, and a box is sent to the cells its margin reaches."""
    side = 4 * margin
    cell = lambda v: F.floor(v / F.lit(side)).cast("int")
    reach = lambda lo, hi: F.sequence(cell(F.col(lo) - margin), cell(F.col(hi) + margin))
    dealt = boxes.withColumn("cx", F.explode(reach("x0", "x1"))).withColumn("cy", F.explode(reach("y0", "y1")))
    placed = items.withColumns({"cx": cell(F.col("x")), "cy": cell(F.col("y"))})
    near = dealt.join(placed, ["page_id", "cx", "cy"]).where(F.col("x").between(F.col("x0") - margin, F.col("x1") + margin) & F.col("y").between(F.col("y0") - margin, F.col("y1") + margin))
    found = near.groupBy("page_id", "box_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda i: i["text"]), " ").alias("near"))
    return boxes.select("page_id", "box_id").join(found, ["page_id", "box_id"], "left").withColumn("near", F.coalesce("near", F.lit("")))


def scan_literals(lines: DataFrame, patterns: list[tuple[str, str, int]], allowed: list[str], excluded: list[str]) -> DataFrame:
    """Findings (path, line, reason, snippet) of the patterns (pattern, reason, group of the literal or 0) in code lines.

    A literal in ``allowed`` is none; paths that match a pattern of ``excluded`` are left out."""
    kept = lines.where(~F.coalesce(F.array_max(F.array(*[F.col("path").rlike(p) for p in excluded])), F.lit(False))) if excluded else lines
    def hit(pattern: str, reason: str, group: int) -> Column:
        bad = F.col("code").rlike(pattern)
        return F.when(bad & ~F.regexp_extract("code", pattern, group).isin(allowed) if group else bad, F.lit(reason))

    found = kept.withColumn("reason", F.explode(F.array_compact(F.array(*[hit(*p) for p in patterns]))))
    return found.select("path", "line", "reason", F.trim("code").alias("snippet"))


#: Comparisons with literals that a general analysis should not contain, allowed literals, and paths not looked at.
LITERAL_PATTERNS = [
    (r"(?i)\b(page|pageNum|pageNo|pageIndex)\s*===?\s*\d+", "page number", 0),
    (r"""\b(reportName|facilityName|companyName|vendorName|vendorType)\s*===?\s*["']([^"']+)["']""", "report, company or facility", 2),
    (r"""\b(damageName|subPart|location|section)\s*===?\s*["']([^"']{2,})["']""", "damage, place or section", 2),
]
ALLOWED_LITERALS = ["검토필요", "그룹 합계에 포함", "기타", "-", ""]
EXCLUDED_PATHS = [r"\.test\.ts$", r"sampleData\.ts$", r"photoSampleData\.ts$", "/validation/"]


def joined_pages(pages: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """Each document's pages as one prompt, in the order of their numbers."""
    from corroborate.functions import parse

    piece = F.struct(F.col(number).alias("n"), parse.page_prompt(F.col(number), F.col(text)).alias("x"))
    return pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["x"]), "\n\n").alias("prompt"))


def group_records(groups: DataFrame, order: str | None = None) -> DataFrame:
    """Groups (report_id, group_no, section, damage_name, part, repair_method, total, locations) to one record per location.

    One location takes the group's number as its id, several get -01, -02; a location without a quantity of its own is part
    of the group's.  A single location of a group without a number is TMP-1 and on within its report, in the order of the
    column ``order`` (without one, of the groups' own values).  A part that is no standard one is noted as it was written."""
    part, n = D.standard_part(F.col("part")), F.size("locations")
    label = F.when(D.given(F.col("total")), F.concat(F.lit("그룹 합계 "), F.col("total"), F.lit("에 포함"))).when(n > 1, "그룹 합계에 포함")
    note = F.when(~part["matched"] & D.given(F.col("part")), F.concat(F.lit('원문 부위값 "'), F.col("part"), F.lit('"을(를) 표준 분류로 확정하지 못해 "기타"로 지정함')))
    nameless = (n == 1) & ~D.given(F.col("group_no"))
    by = [F.col(order)] if order else [F.col("section"), F.col("damage_name"), F.col("part"), F.col("repair_method"), F.to_json("locations"), F.col("total")]
    # only groups without a number are numbered, and so ordered within their report
    rows = groups.withColumn("_n", F.lit(None).cast("int")).where(~nameless).unionByName(in_turn(groups.where(nameless), ["report_id"], by, "_n"))
    out = rows.select("report_id", "group_no", "section", "damage_name", "repair_method", part["part"].alias("part"), label.alias("_label"), note.alias("notes"), "_n", n.alias("_of"), F.posexplode("locations").alias("_p", "_l"))
    own, number = D.given(F.col("_l.quantity")), F.coalesce("group_no", F.lit(""))
    id_ = F.when(F.col("_n").isNotNull(), F.concat(F.lit("TMP-"), F.col("_n").cast("string"))).when(F.col("_of") == 1, number).otherwise(F.format_string("%s-%02d", number, F.col("_p") + 1))
    return out.select(
        "report_id", id_.alias("id"), "group_no", (F.col("_p") + 1).alias("group_index"),
        "section", "damage_name", "part", F.coalesce(F.nullif(F.col("_l.sub_part"), F.lit("")), F.lit(D.DASH)).alias("sub_part"), F.col("_l.location").alias("location"), "repair_method",
        F.when(own, F.col("_l.quantity")).alias("quantity"), F.when(~own, F.col("_label")).alias("quantity_group"), "notes",
    )
