"""Results held against ground truth row by row: pairs of the one-to-one match and what follows from them.

``truth``: case_id, ordinal, id, section, damage_name, part, sub_part, location, quantity, quantity_group, repair_method,
photo_nos, pages, expected.  ``found``: the same but photo_ids for photo_nos and cv_result for expected.  ``truth_photos``:
case_id, ordinal, id, photo_no, page, linked (ids of truth rows); ``found_photos``: case_id, ordinal, id, photo_no, page.
``ordinal`` is a row's place in its case and tells its rows apart.

A truth row takes the first free found row of its key, so the n-th of a key meets the n-th: both sides are numbered within
the key and joined on key and number, and a key that a third of all rows hold is many groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import domain as D
from corroborate.functions import parse as P
from corroborate.functions import text as T
from corroborate.operators import linkage as L
from corroborate.operators import scan
from corroborate.operators import state as S

#: Names of damages that mean the same, the compared fields with their error category and step, and the other categories.
SYNONYMS = {"균열": ["균열", "크랙", "crack"], "박리": ["박리", "박락"], "누수": ["누수", "침출수"], "파손": ["파손", "손상"], "세굴": ["세굴", "세굴현상"]}
FIELDS = {
    "damage_name": ("DAMAGE_NAME_ERROR", "STEP 4"), "part": ("PART_CLASSIFICATION_ERROR", "STEP 4"), "sub_part": ("SUBPART_ERROR", "STEP 4"),
    "location": ("LOCATION_ERROR", "STEP 4"), "quantity": ("QUANTITY_ERROR", "STEP 5"), "repair_method": ("REPAIR_METHOD_ERROR", "STEP 4"),
}
LOST, LOST_PHOTO = ("EXTRACTION_ERROR", "STEP 4"), ("PHOTO_EXTRACTION_ERROR", "STEP 6")
_SIDE = ["ordinal", "id", *FIELDS, "quantity_group", "pages"]


def damage_name(c: Column) -> Column:
    """Without white space, in lower case, as the first of its synonyms."""
    return P.synonym(F.lower(T.norm(c)), SYNONYMS)


def place(c: Column) -> Column:
    """The normal form of a location; of one without any, the empty text."""
    return F.coalesce(T.normalize_location(c), F.lit(""))


def _keyed(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    return scan.numbered(rows.withColumns(keys), ["case_id", *keys], ["ordinal"], "_n")


def pair_up(truth: DataFrame, found: DataFrame, keys: dict[str, Column], columns: tuple[list[str], list[str]]) -> DataFrame:
    """case_id, side (matched, missed or extra) and the rows ``t`` and ``f`` with the named columns of either side."""
    sides = []
    for rows, name, kept in ((truth, "t", columns[0]), (found, "f", columns[1])):
        sides.append(_keyed(rows, keys).select("case_id", *keys, "_n", F.struct(*kept).alias(name)))
    both = sides[0].join(sides[1], ["case_id", *keys, "_n"], "full_outer")
    side = F.when(F.col("f").isNull(), "missed").when(F.col("t").isNull(), "extra").otherwise("matched")
    return both.select("case_id", side.alias("side"), "t", "f")


def damage_pairs(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs by section, name (synonyms are equal), sub part and place; the part is measured, not matched."""
    keys = {"k_section": T.norm(F.col("section")), "k_name": damage_name(F.col("damage_name")), "k_sub": T.norm(F.col("sub_part")), "k_place": place(F.col("location"))}
    return pair_up(truth, found, keys, ([*_SIDE, "photo_nos", "expected"], [*_SIDE, "photo_ids", "cv_result"]))


def photo_pairs(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs by number, those without one by page."""
    keys = {"k_no": F.when(D.given(F.col("photo_no")), T.norm(F.col("photo_no"))).otherwise(""), "k_page": F.when(D.given(F.col("photo_no")), F.lit(-1)).otherwise(F.coalesce("page", F.lit(-2)))}
    kept = ["ordinal", "id", "photo_no", "page"]
    return pair_up(truth, found, keys, (kept, kept))


def _amount(row: str) -> Column:
    return F.coalesce(F.col(f"{row}.quantity"), F.col(f"{row}.quantity_group"))


def _values(row: str) -> dict[str, Column]:
    """The compared fields as they are written."""
    return {f: _amount(row) if f == "quantity" else F.col(f"{row}.{f}") for f in FIELDS}


def field_agrees() -> dict[str, Column]:
    """Whether a pair agrees in each field, by the field's own comparison."""
    t, f = _values("t"), _values("f")
    by = {"damage_name": damage_name, "part": lambda c: c, "location": place}
    return {n: by.get(n, T.norm)(t[n]).eqNullSafe(by.get(n, T.norm)(f[n])) for n in FIELDS}


def field_accuracy(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per field of matched pairs how many agree: matched, total, match_rate (0 without pairs)."""
    by = by or []
    wide = pairs.where("side = 'matched'").groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in field_agrees().items()])
    long = wide.unpivot([*by, "total"], list(FIELDS), "field", "matched")
    return long.select(*by, "field", "matched", "total", L.ratio(F.col("matched"), F.col("total")).alias("match_rate"))


def detection_metrics(pairs: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 per case."""
    counts = {"tp": "matched", "fp": "extra", "fn": "missed"}
    return L.precision_recall_f1(pairs.groupBy("case_id").agg(*[F.count_if(F.col("side") == s).alias(n) for n, s in counts.items()]))


def photo_link_metrics(pairs: DataFrame, truth_photos: DataFrame, found_photos: DataFrame) -> DataFrame:
    """Per case with matched pairs how well their sets of photo numbers agree.

    Expected: the numbers of photos that name the truth row, and those it lists.  Actual: the numbers of the found row's
    photos, their ids where a photo has no number or does not exist.  Each set is joined number by number."""
    matched = pairs.where("side = 'matched'").select("case_id", F.col("t.id").alias("t_id"), F.col("t.photo_nos").alias("nos"), F.col("f.ordinal").alias("f_at"), F.col("f.photo_ids").alias("ids"))
    named = truth_photos.select("case_id", F.explode("linked").alias("t_id"), T.norm(F.col("photo_no")).alias("no"))
    listed = matched.select("case_id", "t_id", "f_at", F.explode("nos").alias("no")).withColumn("no", T.norm(F.col("no")))
    expected = listed.unionByName(matched.select("case_id", "t_id", "f_at").join(named, ["case_id", "t_id"])).select("case_id", "f_at", "no").distinct()
    numbers = found_photos.groupBy("case_id", F.col("id").alias("photo_id")).agg(F.max_by("photo_no", "ordinal").alias("own"))  # of equal ids the last
    linked = matched.select("case_id", "f_at", F.explode("ids").alias("photo_id")).join(numbers, ["case_id", "photo_id"], "left")
    actual = linked.select("case_id", "f_at", T.norm(F.coalesce("own", "photo_id")).alias("no")).distinct()
    both = expected.withColumn("x", F.lit(True)).join(actual.withColumn("y", F.lit(True)), ["case_id", "f_at", "no"], "full_outer")
    counts = both.groupBy("case_id").agg(F.count_if(F.col("x") & F.col("y")).alias("tp"), F.count_if(F.col("x").isNull()).alias("fp"), F.count_if(F.col("y").isNull()).alias("fn"))
    every = matched.select("case_id").distinct().join(counts, "case_id", "left").fillna(0, ["tp", "fp", "fn"])
    return L.precision_recall_f1(every)


def cross_check_breakdown(pairs: DataFrame) -> DataFrame:
    """Per case matched pairs by result of the cross-check, and the share as expected, null where nothing was."""
    known, result = D.given(F.col("t.expected")), F.col("f.cv_result")
    counts = [F.count_if(result == r).alias(r) for r in D.RESULT_LABEL]
    accuracy = F.try_divide(F.count_if(known & F.col("t.expected").eqNullSafe(result)), F.count_if(known)).alias("accuracy")
    return pairs.where("side = 'matched'").groupBy("case_id").agg(*counts, accuracy)


def validation_bundle(cases: DataFrame, truth: DataFrame, found: DataFrame, truth_photos: DataFrame, found_photos: DataFrame, good: float = 0.9, warning: float = 0.75) -> DataFrame:
    """All metrics of each case in one row: detection, photos and links as structs, fields as a map, the breakdown, overall_f1 and its grade.

    A case without any row on a side has zeros there and fails."""
    pairs = damage_pairs(truth, found)
    kinds = {"detection": detection_metrics(pairs), "photo_extraction": detection_metrics(photo_pairs(truth_photos, found_photos)), "photo_link": photo_link_metrics(pairs, truth_photos, found_photos)}
    names = ["tp", "fp", "fn", "precision", "recall", "f1"]
    out = cases.select("case_id").distinct()
    for kind, measured in kinds.items():
        zeros = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in names[:3]], *[F.lit(0.0).alias(n) for n in names[3:]])
        out = out.join(measured.select("case_id", F.struct(*names).alias(kind)), "case_id", "left").withColumn(kind, F.coalesce(kind, zeros))
    fields = field_accuracy(pairs, ["case_id"]).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "match_rate"))).alias("fields"))
    none = F.map_from_arrays(F.array(*[F.lit(f) for f in FIELDS]), F.array(*[F.lit(0.0)] * len(FIELDS)))
    breakdown = cross_check_breakdown(pairs)
    out = out.join(fields, "case_id", "left").withColumn("fields", F.coalesce("fields", none)).join(breakdown, "case_id", "left").fillna(0, list(D.RESULT_LABEL))
    overall = F.col("detection.f1")
    return out.withColumn("overall_f1", overall).withColumn("status", S.grade(overall, good, warning))


def error_entries(pairs: DataFrame, photos: DataFrame) -> DataFrame:
    """One row per field in which a pair differs, per missed and extra row, and per missed and extra photo, with ids ERR-0001 and on within each case.

    The order is that of the report: pairs by the truth's place and field, missed, extra, missed photos, extra photos."""
    none = F.lit(None).cast("string")
    t, f, agrees = _values("t"), _values("f"), field_agrees()
    sources = [T.source_label(F.col(f"{x}.pages")) for x in ("t", "f")]

    def entry(turn: Column, kind: tuple[str, str], field: str | None, values: tuple[Column, Column], where: tuple[Column, Column], owner: Column) -> Column:
        made = {"turn": turn, "step": F.lit(kind[1]), "field": F.lit(field).cast("string"), "category": F.lit(kind[0]), "truth_value": values[0], "found_value": values[1],
                "truth_source": where[0], "found_source": where[1], "damage_id": owner}
        return F.struct(*[c.alias(n) for n, c in made.items()])

    at = lambda group, ordinal, k=0: F.lit(group * (1 << 58)) + F.col(ordinal).cast("long") * 8 + k
    shown = lambda x: F.concat_ws(" / ", *[F.coalesce(F.col(f"{x}.{c}"), F.lit("null")) for c in ("damage_name", "sub_part", "location")])
    wrong = [F.when((F.col("side") == "matched") & ~agrees[n], entry(at(0, "t.ordinal", k), kind, n, (t[n], f[n]), tuple(sources), F.col("t.id"))) for k, (n, kind) in enumerate(FIELDS.items())]
    missed = F.when(F.col("side") == "missed", entry(at(1, "t.ordinal"), LOST, None, (shown("t"), none), (sources[0], none), F.col("t.id")))
    extra = F.when(F.col("side") == "extra", entry(at(2, "f.ordinal"), LOST, None, (none, shown("f")), (none, sources[1]), F.col("f.id")))
    page = lambda x: F.concat(F.lit("p."), F.coalesce(F.col(f"{x}.page").cast("string"), F.lit("null")))
    number = lambda x, other: F.concat(F.coalesce(F.col(f"{x}.photo_no"), other), F.lit(" ("), page(x), F.lit(")"))
    lost = F.when(F.col("side") == "missed", entry(at(3, "t.ordinal"), LOST_PHOTO, "photo", (number("t", F.lit(D.DASH)), none), (page("t"), none), none))
    more = F.when(F.col("side") == "extra", entry(at(4, "f.ordinal"), LOST_PHOTO, "photo", (none, number("f", F.col("f.id"))), (none, page("f")), none))
    rows = [p.select("case_id", F.explode(F.array_compact(F.array(*e))).alias("e")).select("case_id", "e.*") for p, e in ((pairs, [*wrong, missed, extra]), (photos, [lost, more]))]
    out = scan.numbered(rows[0].unionByName(rows[1]), ["case_id"], ["turn"], "n")
    digits = F.col("n").cast("string")
    return out.select("case_id", F.concat(F.lit("ERR-"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)).alias("error_id"), *[c for c in rows[0].columns if c not in ("case_id", "turn")])


def errors_by_category(errors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How often each category occurs, over all or by case."""
    return errors.groupBy(*(by or []), "category").agg(F.count("*").alias("n"))
