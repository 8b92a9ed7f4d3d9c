"""Photos against records: the scored link, what it says of either side, and cross-checking records against documents.

Every table has ``report_id``, the unit within which rows are compared; it is the join's equality, so a report of
unusual size is what adaptive execution splits.  ``photos``: photo_id, photo_no, damage_name, caption, part, sub_part,
location, section, ocr_text, nearby_text, vision_type, manual.  ``records``: id, group_no, damage_name, part, sub_part,
location, section, repair_method, quantity, quantity_group.  ``evidence``: document_no (the documents' order), seq,
and the fields of a candidate.  Null and empty values match nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import domain as D
from corroborate.functions import text as T

#: Weights of the photo signals, the score of a full match, and the weights of document evidence.
PHOTO_WEIGHTS = {"photo_no": 30, "damage_name": 20, "caption": 10, "part": 5, "sub_part": 15, "location": 20, "in_range": 5, "section": 5, "ocr": 10, "context": 5, "vision": 5}
PHOTO_BEST, CONFIRM, MAYBE = 105, 0.9, 0.7
EVIDENCE_WEIGHTS = {"damage_name": 20, "sub_part": 15, "location": 20, "section": 10, "part": 5, "repair_method": 10, "quantity": 10, "photo_no": 10}
EVIDENCE_BEST, EVIDENCE_ENOUGH = 100, 0.6


def _holds(text: Column, part: Column) -> Column:
    return F.coalesce(F.contains(text, part), F.lit(False))


def prepared(rows: DataFrame) -> DataFrame:
    """Rows with what pairs compare, computed once a row: n_<field> without white space, place, and the place as a point or range."""
    place, pattern = T.normalize_location(F.col("location")), rf"^({T.NUMBER})(?:~({T.NUMBER}))?(m|km|㎡|㎥)$"
    part = lambda k: F.regexp_extract("place", pattern, k)
    fields = [f for f in ("id", "group_no", "photo_no", "damage_name", "sub_part", "section") if f in rows.columns]
    out = rows.withColumns({f"n_{f}": F.nullif(T.norm(F.col(f)), F.lit("")) for f in fields} | {"place": place})
    out = out.withColumns({"place_from": part(1).try_cast("double"), "place_to": part(2).try_cast("double"), "place_unit": part(3)})
    return out.withColumn("plain_sub", (F.col("sub_part") != D.DASH) & D.given(F.col("sub_part")))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _in_range(p, r) -> Column:
    return _true(p("place_to").isNull() & (p("place_unit") == r("place_unit")) & p("place_from").between(r("place_from"), r("place_to")))


def photo_signals(p, r) -> dict[str, Column]:
    """Which signals hold between a prepared photo ``p`` and record ``r`` (functions from a field to its column)."""
    at_place = _true(p("place") == r("place"))
    return {
        "photo_no": _true((p("n_photo_no") == r("n_id")) | (p("n_photo_no") == r("n_group_no"))),
        "damage_name": _true(p("n_damage_name") == r("n_damage_name")),
        "caption": D.given(p("caption")) & D.given(r("damage_name")) & (_holds(p("caption"), r("damage_name")) | (F.coalesce(r("sub_part") != D.DASH, F.lit(True)) & _holds(p("caption"), r("sub_part")))),
        "part": D.given(p("part")) & _true(p("part") == r("part")),
        "sub_part": _true(p("n_sub_part") == r("n_sub_part")),
        "location": at_place,
        "in_range": ~at_place & _in_range(p, r),
        "section": _true(p("n_section") == r("n_section")),
        "ocr": (D.given(r("location")) & _holds(p("ocr_text"), r("location"))) | (r("plain_sub") & _holds(p("ocr_text"), r("sub_part"))),
        "context": r("plain_sub") & _holds(p("nearby_text"), r("sub_part")),
        "vision": D.given(p("vision_type")) & _holds(p("vision_type"), F.coalesce(r("damage_name"), F.lit(""))),
    }


def hard_conflict(p, r) -> Column:
    """The same thing by number or sub part, at another place or in another sub part."""
    number = _true((p("n_photo_no") == r("n_id")) | (p("n_photo_no") == r("n_group_no")))
    known = p("n_sub_part").isNotNull() & F.coalesce(r("sub_part") != D.DASH, F.lit(True))
    like = p("n_sub_part").eqNullSafe(r("n_sub_part"))
    elsewhere = _true(p("place") != r("place")) & ~_in_range(p, r)
    return (number | (known & like)) & elsewhere | (number & known & ~like)


def photo_pairs(photos: DataFrame, records: DataFrame) -> DataFrame:
    """report_id, photo_id, id, score, reasons, conflict, confidence and status of every pair with a signal."""
    p, r = (lambda f: F.col(f"p.{f}")), (lambda f: F.col(f"r.{f}"))
    holds = photo_signals(p, r)
    # sorted and merged, never broadcast: a report's pairs are many more than its rows, and a large report can be split
    pairs = prepared(photos).alias("p").join(prepared(records).hint("merge").alias("r"), F.col("p.report_id") == F.col("r.report_id"))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(holds.values())), F.lit(0))
    # an array of one keeps the filter above the join, so that the signals are looked at once a pair
    told = F.inline(F.array(F.struct(bits.alias("bits"), hard_conflict(p, r).alias("conflict"))))
    pairs = pairs.select(F.col("p.report_id").alias("report_id"), "p.photo_id", "r.id", told).where("bits > 0")
    has = lambda k: F.col("bits").bitwiseAND(1 << k) != 0
    total = sum((F.when(has(k), PHOTO_WEIGHTS[n]).otherwise(0) for k, n in enumerate(holds)), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(has(k), n) for k, n in enumerate(holds)]))
    scored = pairs.select("report_id", "photo_id", "id", F.least(total, F.lit(PHOTO_BEST)).alias("score"), reasons.alias("reasons"), "conflict")
    scored = scored.withColumn("confidence", F.col("score") / PHOTO_BEST)
    sure = (F.col("confidence") >= CONFIRM) & ~F.col("conflict")
    return scored.withColumn("status", F.when(sure, "confirmed").when((F.col("confidence") >= MAYBE) | F.col("conflict"), "review").otherwise("unmatched"))


def photo_results(photos: DataFrame, pairs: DataFrame) -> DataFrame:
    """Photos with match_status, confidence (of the best pair, a conflicting one too), linked ids and reasons; photos set by hand keep theirs."""
    by = pairs.groupBy("report_id", "photo_id").agg(
        F.max("confidence").alias("_best"), F.bool_or(F.col("status") == "confirmed").alias("_sure"), F.bool_or(F.col("status") == "review").alias("_maybe"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "confirmed", F.col("id")))).alias("_linked"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("status") == "confirmed", F.col("reasons")))))).alias("_why"),
    )
    out = photos.join(by, ["report_id", "photo_id"], "left")
    hand, none = F.coalesce(F.col("manual"), F.lit(False)), F.array().cast("array<string>")
    auto = F.when(F.col("_sure"), "confirmed").when(F.col("_maybe"), "review").otherwise("unmatched")
    made = {
        "match_status": F.when(hand, F.col("match_status")).otherwise(auto), "confidence": F.when(hand, F.col("confidence")).otherwise(F.col("_best")),
        "linked": F.when(hand, F.col("linked")).otherwise(F.coalesce("_linked", none)), "match_reasons": F.when(hand, none).otherwise(F.coalesce("_why", none)),
        "match_source": F.when(hand, "manual").otherwise("auto"),
    }
    if "status" in photos.columns:  # of the photo itself: what failed stays so unless it is confirmed
        made["status"] = F.when(hand, F.col("status")).when(F.col("_sure"), "confirmed").when(F.col("status") == "failed", "failed").otherwise("review")
    return out.withColumns(made).drop("_best", "_sure", "_maybe", "_linked", "_why")


def record_links(records: DataFrame, photos: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records with photo_ids and photo_status, told by the photos' links; ``no_photo`` set by hand holds unless a photo is linked.

    Of photos set by hand the candidates of earlier runs count (``candidates``: id, score, conflict), if there is such a column."""
    links = photos.select("report_id", F.explode("linked").alias("id"), "photo_id").groupBy("report_id", "id").agg(F.array_sort(F.collect_set("photo_id")).alias("photo_ids"))
    held = photos.where(~F.coalesce("manual", F.lit(False))).select("report_id", "photo_id")
    weak = pairs.where("status <> 'unmatched' or conflict").join(held, ["report_id", "photo_id"], "left_semi").select("report_id", "id", "conflict")
    if "candidates" in photos.columns:
        earlier = photos.where("manual").select("report_id", F.explode("candidates").alias("c")).where((F.col("c.score") / PHOTO_BEST >= MAYBE) | F.col("c.conflict"))
        weak = weak.unionByName(earlier.select("report_id", "c.id", F.coalesce("c.conflict", F.lit(False)).alias("conflict")))
    weak = weak.groupBy("report_id", "id").agg(F.bool_or("conflict").alias("_conflict"))
    out = records.join(links, ["report_id", "id"], "left").join(weak, ["report_id", "id"], "left")
    status = F.when(F.col("photo_ids").isNotNull(), "confirmed").when(F.col("no_photo"), "noPhoto").when(F.col("_conflict"), "conflict").when(F.col("_conflict").isNotNull(), "review").otherwise("noPhoto")
    return out.withColumns({"photo_status": status, "photo_ids": F.coalesce("photo_ids", F.array().cast("array<string>"))}).drop("_conflict")


FILLABLE = ["damage_name", "sub_part", "quantity", "repair_method"]
_FIELDS = ["section", "damage_name", "part", "sub_part", "location", "repair_method", "quantity", "photo_no"]
#: What of a candidate travels with a record, and what each document comes to in the fold.
_TOLD = [*FILLABLE, "location"]
_STEP = "struct<document_no:int,seq:bigint,bits:int,fits:int,result:int,main:struct<damage_name:string,quantity:string,repair_method:string>,other:struct<" + ",".join(f"{f}:string" for f in _TOLD) + ">>"
_STATE = "struct<" + ",".join(f"{f}:string" for f in FILLABLE) + f",mask:int,steps:array<{_STEP}>>"
#: Bits of a pair: the signals, an amount that is the group's, and where the two differ.
_APART = ["location", "damage_name", "repair_method", "quantity"]
_BIT = {n: 1 << k for k, n in enumerate([*EVIDENCE_WEIGHTS, "group", *[f"apart {f}" for f in _APART]])}
_LITTLE, _GOOD, _BAD = 1, 2, 3


_COMPARED = ["id", "group_no", "section", "damage_name", "part", "sub_part", "location", "repair_method", "quantity", "quantity_group"]


def _key(prefix: str = "") -> dict[str, Column]:
    """128 bits of all of a record that a candidate is held against, as texts; equal records are one."""
    own = [F.col(prefix + c) for c in _COMPARED]
    nulls = sum((F.when(c.isNull(), 1 << k).otherwise(0) for k, c in enumerate(own)), F.lit(0))
    return {"_k1": F.xxhash64(nulls, *own), "_k2": F.xxhash64(*own, nulls, F.lit(1))}


def _once(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
    """Rows with more columns, told once a row by an operator of their own: one projection of everything is too much code to be compiled."""
    return rows.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def _on(bits: Column, *names: str) -> Column:
    return bits.bitwiseAND(sum(_BIT[n] for n in names)) != 0


def _mask(of: dict[str, Column]) -> Column:
    return sum((F.when(c, _BIT[n]).otherwise(0) for n, c in of.items()), F.lit(0))


def _points(bits: Column) -> Column:
    return sum((F.when(_on(bits, n), w).otherwise(0) for n, w in EVIDENCE_WEIGHTS.items()), F.lit(0))


def _winners(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """report_id, _k1, _k2 and _documents: by document the candidates that may be the best of a record while its blanks are filled.

    A blank that is filled can give a candidate the field's weight or take it away.  So each has a highest and a lowest
    score; one whose highest is below another's lowest, or equal and behind it in the document, is never the best.  A
    record of a report without candidates has a row without documents, one that no candidate touches has none.  Rows of
    either side are dealt by report once; their pairs are sorted once, and all else goes over them in that order."""
    norm, given = (lambda c: T.norm(F.col(c))), (lambda c: D.given(F.col(c)))
    names = ["section", "damage_name", "sub_part", "repair_method"]
    amounts = {f"r_{c}": F.when(given(c), norm(c)) for c in ("quantity", "quantity_group")}
    own = _once(records, {f"t_{c}": F.col(c).cast("string") for c in _COMPARED}).select("report_id", *[F.col(f"t_{c}").alias(c) for c in _COMPARED])
    own = _once(_once(own, _key()), {f"r_{c}": norm(c) for c in ("id", "group_no", *names)} | amounts)
    own = _once(own, {"r_place": T.normalize_location(F.col("location")), "r_part": F.col("part")})
    own = own.withColumns({f"b_{c}": D.blank(F.col(c)) for c in FILLABLE} | {f"g_{c}": given(c) for c in ("damage_name", "repair_method")})
    r = own.select("report_id", "_k1", "_k2", *[c for c in own.columns if c[:2] in ("r_", "b_", "g_")])
    theirs = _once(evidence, {f"t_{c}": F.col(c) for c in _FIELDS}).select("report_id", "document_no", "seq", *[F.col(f"t_{c}").alias(c) for c in _FIELDS])
    theirs = _once(theirs, {f"c_{c}": F.when(given(c), norm(c)) for c in (*names, "quantity", "photo_no")})
    theirs = theirs.withColumns({"c_place": T.normalize_location(F.col("location")), "c_part": F.when(given("part"), F.col("part"))})
    theirs = theirs.select("report_id", "document_no", "seq", F.struct(*_TOLD).alias("c"), *[c for c in theirs.columns if c.startswith("c_")])
    same = lambda c, other: F.coalesce(F.col(c) == F.col(other), F.lit(False))
    differ = lambda c, other: F.coalesce(F.col(c) != F.col(other), F.lit(False))
    holds = {f: same(f"c_{f}", f"r_{f}") for f in names} | {"location": same("c_place", "r_place"), "part": same("c_part", "r_part")}
    holds |= {"quantity": same("c_quantity", "r_quantity_group") | same("c_quantity", "r_quantity"), "photo_no": same("c_photo_no", "r_id") | same("c_photo_no", "r_group_no")}
    holds |= {"group": same("c_quantity", "r_quantity_group"), "apart location": differ("c_place", "r_place"), "apart quantity": differ("c_quantity", "r_quantity")}
    holds |= {f"apart {f}": F.col(f"g_{f}") & differ(f"c_{f}", f"r_{f}") for f in ("damage_name", "repair_method")}
    # never broadcast, for a report's pairs are many more than its rows; arrays of one keep what follows above the join
    pairs = r.join(theirs.hint("merge"), "report_id", "left").select("report_id", "_k1", "_k2", "document_no", "seq", "c", *[f"b_{f}" for f in FILLABLE], *[F.col(f"c_{f}").isNotNull().alias(f"h_{f}") for f in FILLABLE], F.inline(F.array(F.struct(_mask(holds).alias("bits")))))
    points = lambda of: sum((F.when(c, EVIDENCE_WEIGHTS[n]).otherwise(0) for n, c in of.items()), F.lit(0))
    more = points({f: F.col(f"b_{f}") & ~_on(F.col("bits"), f) & F.col(f"h_{f}") for f in FILLABLE})
    less = points({f: F.col(f"b_{f}") & _on(F.col("bits"), f) for f in FILLABLE})
    bounds = F.inline(F.array(F.struct((_points(F.col("bits")) - less).alias("low"), (_points(F.col("bits")) + more).alias("high"))))
    # texts travel only where they may fill a blank or be told as the other value of a conflict
    anchor = F.col("b_sub_part") | _on(F.col("bits"), "sub_part", "photo_no")
    used = {f: (F.col(f"b_{f}") if f in FILLABLE else F.lit(False)) | ((anchor & _on(F.col("bits"), f"apart {f}")) if f in _APART else F.lit(False)) for f in _TOLD}
    texts = F.when(F.col("c").isNotNull(), F.struct(*[F.when(v, F.col(f"c.{f}")).alias(f) for f, v in used.items()])).alias("c")
    pairs = pairs.select("report_id", "_k1", "_k2", "document_no", "seq", "bits", texts, bounds).where("high > 0 or c is null")
    keys = ["report_id", "_k1", "_k2"]
    each = Window.partitionBy(*keys, "document_no").orderBy("seq", "bits", "c")
    whole = each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = F.struct("seq", "bits", *[F.col(f"c.{f}").alias(f) for f in _TOLD])
    best = F.max(F.struct(F.col("low").alias("s"), (-F.col("seq")).alias("t"))).over(whole)
    # a row that repeats, of a record or a candidate, counts once
    again = (F.lag("seq").over(each).eqNullSafe(F.col("seq")) & F.lag("c").over(each).eqNullSafe(F.col("c")) & (F.lag("bits").over(each) == F.col("bits"))) & (F.row_number().over(each) > 1)
    kept = pairs.withColumns({"_best": best, "_again": again}).where((F.col("c").isNull() | (F.struct(F.col("high").alias("s"), (-F.col("seq")).alias("t")) >= F.col("_best"))) & ~F.coalesce("_again", F.lit(False)))
    listed = kept.select(*keys, "document_no", "seq", "bits", "c", F.collect_list(F.when(F.col("c").isNotNull(), of)).over(whole).alias("_of"), F.row_number().over(each).alias("_n")).where("_n = 1")
    turn = Window.partitionBy(*keys).orderBy("document_no")
    listed = listed.select(*keys, F.collect_list(F.when(F.size("_of") > 0, F.struct("document_no", F.col("_of").alias("c")))).over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_documents"), F.row_number().over(turn).alias("_n"))
    return listed.where("_n = 1").drop("_n")


def cross_check(records: DataFrame, evidence: DataFrame, locked: str = "locked") -> DataFrame:
    """Records checked against each document of their report in turn; a blank that one document fills is seen by the next.

    Of a document the candidate with the highest score counts, the first of equals.  It conflicts if it names the same
    thing with another value; else, with at least 60 of 100 points, it confirms, and fills blanks that are not ``locked``
    by an edit.  Adds cv_result, cv_confidence, n_evidence, cv_conflicts, filled, matched_fields and group_confirmed, and cv_evidence (what each
    document says), cv_values (both values of each conflict) and cv_enrichments (what was filled from where); filled fields hold their new value.
    Candidates are scored against the records in one join.  Of a document only those travel with a record that may still
    be its best, whatever blanks earlier documents fill (``_winners``), with what holds between the two as bits; the fold
    looks at texts anew only where a blank has been filled, and what is told of its steps is made after it."""
    near = _winners(records, evidence)
    rows = _once(_once(records, {f"t_{c}": F.col(c).cast("string") for c in _COMPARED}), _key("t_")).drop(*[f"t_{c}" for c in _COMPARED]).join(near, ["report_id", "_k1", "_k2"], "left").drop("_k1", "_k2")
    # no row at all: candidates are there, but none touches the record
    rows = rows.withColumn("_told", F.col("report_id").isNotNull() & F.coalesce(F.size("_documents") > 0, F.lit(True)))
    empty = F.array().cast("array<string>")
    start = F.struct(*[F.col(f) for f in FILLABLE], F.lit(0).alias("mask"), F.array().alias("steps")).cast(_STATE)
    shut = F.coalesce(F.col(locked), empty)

    def check(state: Column, document: Column) -> Column:
        def now(c: Column) -> Column:
            """The bits of a candidate, with what was filled."""
            bits = c["bits"]
            for k, f in enumerate(FILLABLE):
                like, full = T.norm(c[f]) == T.norm(state[f]), D.given(c[f])
                anew = _mask({f: full & like} | ({f"apart {f}": full & ~like} if f != "sub_part" else {}))
                old = bits.bitwiseAND(~(_BIT[f] | _BIT.get(f"apart {f}", 0)))
                bits = F.when(state["mask"].bitwiseAND(1 << k) != 0, old.bitwiseOR(anew).bitwiseOR(F.when(_on(c["bits"], "group"), _BIT["quantity"]).otherwise(0) if f == "quantity" else F.lit(0))).otherwise(bits)
            return F.when(state["mask"] == 0, c["bits"]).otherwise(bits)

        scored = F.transform(document["c"], lambda c: D.let(now(c), lambda bits: F.struct(_points(bits).alias("score"), (-c["seq"]).alias("turn"), bits.alias("bits"), c.alias("c"))))

        def judge(b: Column) -> Column:
            anchor = _on(b["bits"], "sub_part", "photo_no")
            bad = anchor & _on(b["bits"], *[f"apart {f}" for f in _APART])
            return F.when(b["score"] <= 0, 0).when(bad, _BAD).when(b["score"] / EVIDENCE_BEST >= EVIDENCE_ENOUGH, _GOOD).otherwise(_LITTLE)

        def fits(b: Column, result: Column) -> Column:
            free = lambda f: D.blank(state[f]) & ~D.blank(b["c"][f]) & ~F.array_contains(shut, f)
            may = {f: free(f) & ~D.given(F.col("quantity_group")) if f == "quantity" else free(f) for f in FILLABLE}
            filled = sum((F.when(may[f], 1 << k).otherwise(0) for k, f in enumerate(FILLABLE)), F.lit(0))
            return F.when((result == _GOOD) & _on(b["bits"], "sub_part", "photo_no", "location"), filled).otherwise(0)

        def apply(b: Column, result: Column, fit: Column) -> Column:
            c = b["c"]
            step = F.struct(
                document["document_no"].cast("int").alias("document_no"), c["seq"].cast("long").alias("seq"), b["bits"].alias("bits"), fit.alias("fits"), result.alias("result"),
                F.struct(*[state[f].alias(f) for f in ("damage_name", "quantity", "repair_method")]).alias("main"), F.struct(*[c[f].alias(f) for f in _TOLD]).alias("other"),
            )
            filled = [F.when(fit.bitwiseAND(1 << k) != 0, c[f]).otherwise(state[f]).alias(f) for k, f in enumerate(FILLABLE)]
            return F.struct(*filled, state["mask"].bitwiseOR(fit).alias("mask"), F.concat(state["steps"], F.array(step.cast(_STEP))).alias("steps")).cast(_STATE)

        return D.let(F.array_max(scored), lambda b: D.let(judge(b), lambda result: D.let(fits(b, result), lambda fit: apply(b, result, fit))))

    folded = rows.withColumn("_s", F.aggregate(F.coalesce("_documents", F.array().cast(rows.schema["_documents"].dataType)), start, check))
    s, steps = F.col("_s"), F.col("_s")["steps"]
    having = lambda *results: F.filter(steps, lambda x: x["result"].isin(*results))
    filling = lambda x: {f: x["fits"].bitwiseAND(1 << k) != 0 for k, f in enumerate(FILLABLE)}
    listed = lambda which: F.array_compact(F.array(*[F.when(c, v) for c, v in which]))
    at = lambda x: [x["document_no"].alias("document_no"), x["seq"].alias("seq")]
    n_matched = F.size(having(_GOOD))
    seen = F.aggregate(steps, F.lit(0), lambda all_, x: all_.bitwiseOR(F.when(x["result"] > 0, x["bits"]).otherwise(0)))
    conflicts = F.flatten(F.transform(having(_BAD), lambda x: listed([(_on(x["bits"], f"apart {f}"), F.lit(f)) for f in _APART])))
    filled = F.flatten(F.transform(steps, lambda x: listed([(c, F.lit(f)) for f, c in filling(x).items()])))
    main = lambda x: {"location": F.col("location"), "quantity": F.coalesce(x["main"]["quantity"], F.col("quantity_group"), F.lit(""))} | {f: x["main"][f] for f in ("damage_name", "repair_method")}
    values = F.flatten(F.transform(having(_BAD), lambda x: listed([(_on(x["bits"], f"apart {f}"), F.struct(F.lit(f).alias("field"), main(x)[f].alias("main"), x["other"][f].alias("other"), *at(x))) for f in _APART])))
    gains = F.flatten(F.transform(steps, lambda x: listed([(c, F.struct(F.lit(f).alias("field"), x["other"][f].alias("value"), *at(x))) for f, c in filling(x).items()])))
    folded = folded.withColumns({"cv_conflicts": conflicts, "filled": filled, "n_evidence": n_matched, "_seen": seen})
    bad, good = F.size("cv_conflicts") > 0, F.col("n_evidence") > 0
    sure = F.least(F.lit(0.98), F.lit(0.6) + 0.15 * F.col("n_evidence") + 0.02 * F.size("filled"))
    made = {f: s[f] for f in FILLABLE} | {
        "cv_result": F.when(bad, "conflict").when(good, "matched").when(F.col("_told"), "missingInAdditional").otherwise("unsupported"),
        "cv_confidence": F.when(bad, 0.4).when(good, sure).otherwise(0.0),
        "matched_fields": listed([(_on(F.col("_seen"), f), F.lit(f)) for f in sorted(EVIDENCE_WEIGHTS) if f != "photo_no"]), "group_confirmed": F.exists(steps, lambda x: (x["result"] == _GOOD) & _on(x["bits"], "group")),
        "cv_evidence": F.transform(having(_GOOD, _BAD), lambda x: F.struct(*at(x), F.when(x["result"] == _BAD, "conflict").otherwise("matched").alias("result"))), "cv_values": values, "cv_enrichments": gains,
    }
    return folded.withColumns(made).drop("_s", "_documents", "_told", "_seen")


CHECKED = ["damage_name", "part", "sub_part", "location", "quantity", "repair_method", "section"]
MEMORY = {
    "conflicts": "array<struct<field:string,main:string,other:string,document_no:int,seq:bigint,resolved:struct<value:string,reason:string,decided_at:string>>>",
    "enrichments": "array<struct<field:string,value:string,document_no:int,seq:bigint>>", "settled": "array<string>",
}


def _open(conflicts: Column) -> Column:
    return F.filter(conflicts, lambda c: c["resolved"].isNull())


def _judged(rows: DataFrame) -> DataFrame:
    """Result, confidence and state of each field, from what is remembered and what the last check found."""
    open_, good = F.size(_open(F.col("conflicts"))) > 0, F.col("n_evidence") > 0
    sure = F.least(F.lit(0.98), F.lit(0.6) + 0.15 * F.col("n_evidence") + 0.02 * F.size("cv_enrichments"))
    rest = F.when(F.col("cv_result").isin("missingInAdditional", "unsupported"), F.col("cv_result")).otherwise("missingInAdditional")
    named = lambda which: F.transform(which, lambda c: c["field"])
    state = lambda f: F.when(F.array_contains("settled", f), "matched").when(F.array_contains(named(_open(F.col("conflicts"))), f), "conflict").when(F.array_contains(named(F.col("enrichments")), f), "enriched").when(
        F.array_contains(named(F.col("conflicts")), f) | F.array_contains("matched_fields", f) | (F.lit(f == "quantity") & F.col("group_confirmed")), "matched")
    states = F.map_from_entries(F.array_compact(F.array(*[F.when(state(f).isNotNull(), F.struct(F.lit(f).alias("field"), state(f).alias("state"))) for f in CHECKED])))
    return rows.withColumns({"review_required": open_, "field_states": states}).withColumns({"cv_result": F.when(open_, "conflict").when(good, "matched").otherwise(rest), "cv_confidence": F.when(open_, 0.4).when(good, sure).otherwise(0.0)})


def remember(checked: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Checked records with ``MEMORY``, review_required and field_states (a map), and result and confidence judged by them.

    earlier: report_id, id, conflicts, enrichments and group_confirmed of the run before, one row per record.  A field
    that was settled then stays so: its new conflicts take the first decision on it.  What earlier runs filled stays in
    the history.  A record that was not there before starts anew."""
    none = {c: F.array().cast(k) for c, k in MEMORY.items()}
    if earlier is None:
        rows = checked.withColumns({"_c": none["conflicts"], "_e": none["enrichments"], "_g": F.lit(False)})
    else:
        old = earlier.select("report_id", "id", F.col("conflicts").cast(MEMORY["conflicts"]).alias("_c"), F.col("enrichments").cast(MEMORY["enrichments"]).alias("_e"), F.col("group_confirmed").alias("_g"))
        rows = checked.join(old, ["report_id", "id"], "left")
    decided = F.filter(F.coalesce("_c", none["conflicts"]), lambda c: c["resolved"].isNotNull())
    first = lambda f: F.try_element_at(F.filter(decided, lambda c: c["field"] == f), F.lit(1))["resolved"]
    kept = F.transform("cv_values", lambda v: F.struct(v["field"].alias("field"), v["main"].alias("main"), v["other"].alias("other"), v["document_no"].alias("document_no"), v["seq"].alias("seq"), first(v["field"]).alias("resolved"))).cast(MEMORY["conflicts"])
    made = {"conflicts": kept, "enrichments": F.concat(F.coalesce("_e", none["enrichments"]), "cv_enrichments"), "settled": none["settled"], "group_confirmed": F.col("group_confirmed") | F.coalesce("_g", F.lit(False))}
    return _judged(rows.withColumns(made).drop("_c", "_e", "_g"))


def settle(remembered: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (report_id, id, field, value, reason, decided_at) on remembered records, of several on a field the last.

    All conflicts of the field are resolved, the field takes the value and counts as matched from then on; the result is
    matched once no conflict is open, as it is for a record that had none."""
    kind = "struct<value:string,reason:string,decided_at:string>"
    last = decisions.groupBy("report_id", "id", "field").agg(F.max(F.struct(F.col("decided_at").cast("string").alias("at"), "value", "reason")).alias("d"))
    by = last.groupBy("report_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct(F.col("d.value").alias("value"), F.col("d.reason").alias("reason"), F.col("d.at").alias("decided_at")).cast(kind).alias("v")))).alias("_d"))
    rows = remembered.join(by, ["report_id", "id"], "left").withColumn("_t", F.col("_d").isNotNull())
    mine = lambda f: F.try_element_at(F.col("_d"), f)
    rows = rows.withColumn("conflicts", F.transform("conflicts", lambda c: c.withField("resolved", F.coalesce(mine(c["field"]), c["resolved"]))))
    settled = F.array_union("settled", F.coalesce(F.map_keys("_d"), F.array().cast("array<string>")))
    values = {f: F.when(mine(F.lit(f)).isNotNull(), mine(F.lit(f))["value"]).otherwise(F.col(f)) for f in CHECKED if f in rows.columns}
    was = {c: F.col(c).alias(f"_{c}") for c in ("cv_result", "cv_confidence")}
    out = _judged(rows.withColumns(values | {"settled": settled}).select("*", *was.values()))
    open_ = F.col("review_required")
    result = F.when(F.col("_t"), F.when(open_, "conflict").otherwise("matched")).otherwise(F.col("_cv_result"))
    return out.withColumns({"cv_result": result, "cv_confidence": F.col("_cv_confidence")}).drop("_cv_result", "_cv_confidence", "_d", "_t")


def evidence_rows(checked: DataFrame, documents: DataFrame) -> DataFrame:
    """report_id, id, file, type, page, quote and result of what each document says of each record, for the report's source and check rows; documents: report_id, document_no, seq, file, type, page, quote."""
    each = checked.select("report_id", "id", F.explode("cv_evidence").alias("e")).select("report_id", "id", "e.*")
    return each.join(documents.select("report_id", "document_no", "seq", "file", "type", "page", "quote"), ["report_id", "document_no", "seq"]).drop("document_no", "seq")


def conflict_rows(remembered: DataFrame, documents: DataFrame) -> DataFrame:
    """report_id, id, file, field, main, other, resolved, reason and at of each conflict, for the report's check and history rows."""
    each = remembered.select("report_id", "id", F.explode("conflicts").alias("c")).select("report_id", "id", "c.*")
    out = each.join(documents.select("report_id", "document_no", "seq", "file"), ["report_id", "document_no", "seq"])
    return out.select("report_id", "id", "file", "field", "main", "other", F.col("resolved.value").alias("resolved"), F.col("resolved.reason").alias("reason"), F.col("resolved.decided_at").alias("at"))


def field_states(checked: DataFrame, fields: list[str]) -> DataFrame:
    """report_id, id, field, state: conflict before enriched before matched; other fields have no row."""
    state = lambda f: F.when(F.array_contains("cv_conflicts", f), "conflict").when(F.array_contains("filled", f), "enriched").when(F.array_contains("matched_fields", f) | (F.lit(f == "quantity") & F.col("group_confirmed")), "matched")
    return checked.select("report_id", "id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), state(f).alias("state")) for f in fields])).alias("x")).select("report_id", "id", "x.*").where("state is not null")


def resolve_conflict(checked: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (report_id, id, field, value; one per field) settle all conflicts of a field, write its value and leave the result matched once none is open."""
    by = decisions.groupBy("report_id", "id").agg(F.map_from_entries(F.collect_set(F.struct("field", "value"))).alias("_d"))
    out = checked.join(by, ["report_id", "id"], "left")
    named = F.coalesce(F.map_keys("_d"), F.array().cast("array<string>"))
    left = F.array_except("cv_conflicts", named)
    touched = F.col("_d").isNotNull()
    fields = [f for f in _FIELDS if f in checked.columns]
    made = {f: F.when(F.array_contains(named, f), F.element_at("_d", f)).otherwise(F.col(f)) for f in fields}
    result = F.when(touched, F.when(F.size(left) > 0, "conflict").otherwise("matched")).otherwise(F.col("cv_result"))
    return out.withColumns(made | {"cv_result": result, "cv_conflicts": F.when(touched, left).otherwise(F.col("cv_conflicts"))}).drop("_d")


def new_candidates(evidence: DataFrame, records: DataFrame) -> DataFrame:
    """Evidence with a name or place that no record of its report may be, by sub part, place or number: one row per source type, name, sub part and place, the first.

    Three anti joins on one key each; a key without value meets nothing."""
    named = evidence.where(D.given(F.col("damage_name")) | D.given(F.col("location")))
    filled = lambda c: F.nullif(c, F.lit(""))
    sides = [
        (filled(T.norm(F.col("sub_part"))), [filled(T.norm(F.col("sub_part")))]), (T.normalize_location(F.col("location")), [T.normalize_location(F.col("location"))]),
        (filled(T.norm(F.col("photo_no"))), [filled(T.norm(F.col("id"))), filled(T.norm(F.col("group_no")))]),
    ]
    for own, theirs in sides:
        keys = records.select(F.col("report_id").alias("_r"), F.explode(F.array(*theirs)).alias("_k")).where("_k is not null").distinct()
        named = named.withColumn("_own", own).join(keys, (F.col("report_id") == F.col("_r")) & (F.col("_own") == F.col("_k")), "left_anti").drop("_own")
    keyed = named.withColumns({"k1": T.norm(F.col("damage_name")), "k2": T.norm(F.col("sub_part")), "k3": F.coalesce(T.normalize_location(F.col("location")), F.lit(""))})
    rest = ["document_no", "seq", *_FIELDS]
    first = keyed.groupBy("report_id", "source_type", "k1", "k2", "k3").agg(F.min_by(F.struct(*rest), F.struct("document_no", "seq")).alias("x"))
    return first.select("report_id", "source_type", "x.*")


def reanalyse(records: DataFrame, photos: DataFrame, evidence: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Photos matched and, with documents, records checked anew: (records, photos).  New candidates are not proposed again."""
    pairs = photo_pairs(photos, records)
    matched = photo_results(photos, pairs)
    linked = record_links(records, matched, pairs)
    return (linked if evidence is None else cross_check(linked, evidence)), matched
