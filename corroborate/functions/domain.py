"""Rules of inspection records: their fixed vocabulary, and what is read from free text with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Vocabulary, labels and patterns of the inspection domain.
PARTS = ["상부자연사면", "사면", "사면하부", "보강시설", "보수시설", "배수시설", "전면부", "배면부", "지반 및 기초부", "기타"]
SUB_PARTS = {"소단측구": "배수시설", "산마루측구": "배수시설", "도수로": "배수시설", "배수로": "배수시설"}
DAMAGES = ["균열", "붕괴", "식생불량", "단차", "박리", "파손", "누수", "침하", "탈락", "마모", "동공", "백태", "철근노출", "낙석", "세굴"]
REPAIRS = ["주입보수", "표면처리", "배수로 정비", "주의관찰", "실런트 주입", "앵커보강", "그라우팅", "단면복구", "방수처리", "구조보강", "절취", "옹벽 신설"]
STATUS_LABEL = {"confirmed": "🟢 확인완료", "review": "🟡 검토필요", "conflict": "🔴 수정필요", "excluded": "⚫ 제외됨"}
RESULT_LABEL = {"matched": "일치", "conflict": "불일치", "missingInAdditional": "추가자료 미확인", "candidate": "후보", "unsupported": "검증 불가"}
REVIEW, OTHER, DASH = "검토필요", "기타", "-"
PHOTO_NUMBERS = [r"사진\s*번호\s*[:：]?\s*[①-⑳0-9A-Za-z\-.]+", r"[①-⑳][-–]\s?\d+", r"사진\s?\d+", r"(?i)No\.?\s?\d+", r"[A-Z]-\d+", r"\b[A-Z]\d{3,}\b"]
LOCATION = r"\d+(?:\.\d+)?(?:~\d+(?:\.\d+)?)?\s?(?:m|km|㎡|㎥)"
SECTION = r"\d+\s?구간"
LABELLED = r"^([가-힣][가-힣0-9\s]*?)\s+([0-9].*)$"


def given(c: Column) -> Column:
    """Not null and not empty."""
    return F.coalesce(c != "", F.lit(False))


def blank(c: Column) -> Column:
    """Null, white space or a lone dash."""
    return F.coalesce(F.trim(c).isin("", DASH), F.lit(True))


def same(a: Column, b: Column) -> Column:
    """``a`` is given and equals ``b`` but for white space."""
    return given(a) & (T.norm(a) == T.norm(b))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def photo_number(c: Column) -> Column:
    return F.trim(T.first_pattern(c, PHOTO_NUMBERS))


def location_in(c: Column) -> Column:
    return F.regexp_replace(F.regexp_substr(c, F.lit(LOCATION)), r"\s+", "")


def section_in(c: Column) -> Column:
    return F.regexp_replace(F.regexp_substr(c, F.lit(SECTION)), r"\s+", "")


def sub_part_in(c: Column) -> Column:
    return T.first_keyword(c, list(SUB_PARTS))


def part_of(sub_part: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SUB_PARTS.items() for x in kv]), sub_part)


def standard_part(c: Column) -> Column:
    """struct(part, matched): the standard part of this name, else the catch-all."""
    name = F.trim(F.coalesce(c, F.lit("")))
    hit = name.isin(PARTS)
    return F.struct(F.when(hit, name).otherwise(F.lit(OTHER)).alias("part"), hit.alias("matched"))


def candidate(chunk: Column, location: Column) -> Column:
    """A candidate read from a stretch of text, null without any hold in it; the quantity is never guessed."""
    name, sub, number = T.first_keyword(chunk, DAMAGES), sub_part_in(chunk), photo_number(chunk)
    place = F.coalesce(location, location_in(chunk))
    out = F.struct(
        section_in(chunk).alias("section"), name.alias("damage_name"), part_of(sub).alias("part"), sub.alias("sub_part"), place.alias("location"),
        T.first_keyword(chunk, REPAIRS).alias("repair_method"), F.lit(None).cast("string").alias("quantity"), number.alias("photo_no"),
        F.substring(F.trim(chunk), 1, 200).alias("quote"),
    )
    return F.when(F.coalesce(name, place, sub, number).isNotNull(), out)


def location_block(c: Column, default: Column) -> Column:
    """array<struct<sub_part, location>> of a block of lines; a label before a line's first digit holds until the next one."""
    lines = F.filter(F.transform(F.split(c, r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    kind = "struct<sub_part:string,found:array<struct<sub_part:string,location:string>>>"
    start = F.struct(default.alias("sub_part"), F.array().cast("array<struct<sub_part:string,location:string>>").alias("found")).cast(kind)

    def step(acc: Column, line: Column) -> Column:
        label = F.when(line.rlike(LABELLED), F.trim(F.regexp_extract(line, LABELLED, 1)))
        rest = F.when(line.rlike(LABELLED), F.regexp_extract(line, LABELLED, 2)).otherwise(line)
        now = F.coalesce(label, acc["sub_part"])
        places = F.transform(T.split_list(rest), lambda p: F.struct(now.alias("sub_part"), p.alias("location")))
        return F.struct(now.alias("sub_part"), F.concat(acc["found"], places).alias("found")).cast(kind)

    return F.aggregate(lines, start, step, lambda acc: acc["found"])


def labelled(c: Column, labels: dict[str, str]) -> Column:
    """The label of a code; a code without one as it is, null as a dash."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), c), c, F.lit(DASH))
