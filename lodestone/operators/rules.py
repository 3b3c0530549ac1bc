"""Rule engines as column expressions: programme eligibility, duties with threshold tables, checklists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of industries and the codes they stand for, target units that are persons, support forms and ways.
INDUSTRY_NAMES = {
    "농업": ["A01"], "어업": ["A03"], "조선": ["C31"], "수리조선": ["C31"], "자동차": ["C30"], "화학": ["C20"], "인쇄업": ["C18"], "주얼리": ["C33"],
    "창고": ["H52"], "항만물류": ["H52"], "항만사업장": ["H52"], "해양수산업": ["A03", "H50"], "시설관리 및 사업지원서비스업": ["N"],
    "도소매 및 소비자용품수리업": ["G", "S95"], "운수·창고·통신업": ["H", "J61"], "위생 및 유사서비스업": ["E", "S96"], "하수도업": ["E37"],
}
PERSONAL_UNITS = ("근로자", "산재근로자", "특고·필수노동자", "이동노동자", "농업인", "어업인", "건설근로자", "현장실습생")
WAYS = {"보조금·비용지원": ["보조금", "비용지원"], "융자": ["융자"], "무료 서비스": ["무상서비스"], "보험료·세금 혜택": ["보험료지원", "보험료감면", "세제", "인정제도"]}
NOTED = {"condition": "기타대상조건", "excluded_targets": "제외대상", "no_double": "중복지원 제한", "contractor": "원청부담"}
VERDICTS = ("해당", "조건부", "확인필요", "개인대상", "지역사업", "타지역", "제외")
STATUSES = ("부족", "확인 필요", "충족", "해당 없음")
SYNONYMS = [
    ["보호구", "안전장비", "안전용품", "안전모", "안전대"], ["에어컨", "냉방", "냉방기"], ["더위", "폭염", "온열", "열사병"], ["환기", "국소배기", "환기장치", "배기"],
    ["추락", "떨어짐"], ["협착", "끼임"], ["충돌", "부딪힘"], ["건강검진", "건강진단", "검진"], ["심리", "상담", "트라우마"], ["대출", "융자"],
    ["세금", "세액공제", "세제"], ["보험", "보험료"], ["화학", "화학물질"], ["질식", "밀폐공간"], ["컨설팅", "기술지도"], ["휴게", "휴게시설", "쉼터"], ["배달", "이륜차"],
]


@dataclass(frozen=True)
class Applicant:
    """Who asks: industry a code ("전체" for any), region ("전국" for any), size one of 소, 중, 대, 모름, hazard Y, N or 모름."""

    who: str = "사업주"
    workers: int = 1
    industry: str = "전체"
    region: str = "전국"
    size: str = "모름"
    hazard: str = "모름"


def starts_either_way(a: Column, b: Column) -> Column:
    return F.startswith(a, b) | F.startswith(b, a)


def industry_matches(target: Column, code: Column) -> Column:
    """A target of one or more names or codes, separated by semicolons, against an industry code."""
    named = F.create_map(*[x for name, codes in INDUSTRY_NAMES.items() for x in (F.lit(name), F.array(*map(F.lit, codes)))])
    section = F.substring(code, 1, 1)

    def one(t: Column) -> Column:
        t = F.trim(t)
        by_name = F.coalesce(F.exists(F.try_element_at(named, t), lambda k: starts_either_way(k, code)), F.lit(False))
        by_rule = F.when(t.isin("제조업", "제조업 등"), section == "C").when(t == "건설업", section == "F").when(t == "임업", F.startswith(code, F.lit("A02"))).when(t == "광업", section == "B").when(t == "서비스 및 기타업종", ~section.isin("C", "F")).otherwise(False)
        return by_rule | by_name | (t.rlike(r"^[A-Z]\d*$") & starts_either_way(t, code))

    return (target == "전체") | F.exists(F.split(target, ";"), one)


def applicant_kind(unit: Column) -> Column:
    return F.when(unit.isin(*PERSONAL_UNITS), "근로자").when(unit == "사업장 또는 근로자", "둘다").otherwise("사업주")


def way_of(form: Column) -> Column:
    out = F.lit("")
    for way, forms in reversed(WAYS.items()):
        out = F.when(form.isin(*forms), way).otherwise(out)
    return out


def eligibility(a: Applicant) -> tuple[Column, Column]:
    """Verdict and reasons (joined by " | ") of programmes for an applicant; the order of the checks decides.

    Columns: region, unit, low, high (workers), cap (of a construction), combined, industries, excluded, needs_hazard,
    hazard_kind, verified, year, insured, no_arrears, condition, excluded_targets, no_double, contractor, original, basis. All
    are text, '' if there is nothing.
    """
    c = F.col
    region = F.trim(F.split_part(c("region"), F.lit("("), F.lit(1)))
    first = lambda x: F.split_part(x, F.lit(" "), F.lit(1))
    regional = region != "전국"
    near = F.when(regional & F.contains(region, F.lit(" ")) & (region != a.region), F.concat(region, F.lit(" 사업 — 그 기초지자체 사업장만 해당하는지 확인")))
    low, high = c("low").try_cast("int"), c("high").try_cast("int")
    builds = a.industry == "전체" or a.industry[0] == "F"
    cap_out = (c("cap") != "") & (c("low") == "") & (c("high") == "") & F.lit(not builds)
    small, middle = {"소": ("Y", "Y"), "중": ("N", "Y"), "대": ("N", "N"), "모름": ("모름", "모름")}[a.size]
    basis = F.when(c("combined") == "또는_소기업", small).when(c("combined") == "또는_중소기업", middle)
    word = F.split_part(c("combined"), F.lit("_"), F.lit(2))
    over = high.isNotNull() & (F.lit(a.workers) >= high)
    too_large = over & (basis.isNull() | (basis == "N"))
    if a.industry == "전체":
        other_industry = excluded = F.lit(False)
        exclusion_check = F.lit(None).cast("string")
    else:
        other_industry = ~industry_matches(c("industries"), F.lit(a.industry))
        excluded = F.lit(a.industry[0] == "F") & c("excluded").rlike("^(건설업|건설현장)")
        exclusion_check = F.when(F.lit(a.industry[0] == "F") & F.contains(c("excluded"), F.lit("건설")), F.concat(F.lit("제외업종 확인: "), c("excluded")))
    hazard = c("needs_hazard") == "Y"
    checks = F.array_compact(
        F.array(
            near,
            F.when(c("cap") != "", F.concat(F.lit("공사금액 "), c("cap"), F.lit("억원 미만 현장만 해당"))),
            F.when(over & (basis == "모름"), F.concat(c("high"), F.lit("인 이상이지만 "), word, F.lit(" 규모 기준 이하면 가능"))),
            exclusion_check,
            F.when(hazard & F.lit(a.hazard == "모름"), F.concat(F.lit("유해인자 보유 필요: "), c("hazard_kind"))),
            F.when(c("verified") == "미확인", F.lit("요건 미확인(공고문 확인 필요)")),
        )
    )
    notes = F.array_compact(
        F.array(
            F.when(over & (basis == "Y"), F.concat(c("high"), F.lit("인 이상이지만 "), word, F.lit("라서 해당"))),
            F.when(F.lit(a.industry == "전체") & (c("industries") != "전체"), F.concat(F.lit("대상업종: "), c("industries"))),
            F.when(F.lit(a.industry == "전체") & (c("excluded") != ""), F.concat(F.lit("제외업종: "), c("excluded"))),
            F.when(c("year") < "2026", F.concat(c("year"), F.lit("년 자료"))),
            F.when(c("insured") == "Y", F.concat(F.lit("산재보험 가입"), F.when(c("no_arrears") == "Y", " · 보험료 체납 없음").otherwise(""))),
            *[F.when(c(name) != "", F.concat(F.lit(f"{label}: "), c(name))) for name, label in NOTED.items()],
        )
    )
    conditional = F.startswith(c("basis"), F.lit("해당없음")) | F.startswith(c("condition"), F.lit("다음 중 하나"))
    personal = c("unit").isin(*PERSONAL_UNITS)
    steps: list[tuple[Column, str, Column]] = [
        (regional & F.lit(a.region == "전국"), "지역사업", region),
        (regional & (first(F.lit(a.region)) != first(region)), "타지역", region),
        (personal, "개인대상", F.concat_ws(" | ", F.coalesce(F.nullif(c("condition"), F.lit("")), c("original")), near)),
        (cap_out, "제외", F.lit("건설현장 대상")),
        (low.isNotNull() & (F.lit(a.workers) < low), "제외", F.concat(c("low"), F.lit("인 이상만"))),
        (too_large, "제외", F.concat(c("high"), F.lit("인 미만만"), F.when(basis.isNotNull(), F.concat(F.lit("("), word, F.lit(" 아님)"))).otherwise(""))),
        (other_industry, "제외", F.concat(F.lit("대상업종 "), c("industries"))),
        (excluded, "제외", F.concat(F.lit("제외업종 "), c("excluded"))),
        (hazard & F.lit(a.hazard == "N"), "제외", F.concat(F.lit("유해인자 보유 필요: "), c("hazard_kind"))),
        (F.size(checks) > 0, "확인필요", F.array_join(F.concat(checks, notes), " | ")),
    ]
    verdict, why = F.when(conditional, "조건부").otherwise("해당"), F.array_join(notes, " | ")
    for met, name, reason in reversed(steps):
        verdict, why = F.when(met, name).otherwise(verdict), F.when(met, reason).otherwise(why)
    return verdict, why


def in_scope(who: str, unit: Column) -> Column:
    kind = applicant_kind(unit)
    return ~((kind == "근로자") & F.lit(who == "사업주")) & ~((kind == "사업주") & F.lit(who == "근로자"))


def tiles(verdict: Column, worker: bool = False) -> list[Column]:
    """Counts by verdict that no pick changes; workers have no personal tile."""
    out = verdict.isin("제외", "타지역")
    personal = F.lit(0).cast("bigint") if worker else F.count_if(verdict == "개인대상")
    return [F.count_if(~out).alias("eligible"), personal.alias("personal"), F.count_if(verdict == "지역사업").alias("regional"), F.count_if(out).alias("excluded")]


def duty_applies(subjects: DataFrame, thresholds: DataFrame, ambiguous: DataFrame, construction: str | None, default: int | None) -> DataFrame:
    """``subjects`` (id, industry, workers; null: not known) with applies: true, false, or null where it can't be told.

    ``thresholds`` has row, industry (a code), minimum and below (null: no bound); ``ambiguous`` has codes whose divisions differ.
    A section (one letter) is met by the rows of its divisions; where several rows meet it, it is ambiguous.
    """
    rows = thresholds.select("row", F.col("industry").alias("code"), "minimum", "below")
    meets = rows.select("row", "minimum", "below", F.explode(F.array_distinct(F.array("code", F.substring("code", 1, 1)))).alias("industry")).groupBy("industry").agg(F.countDistinct("row").alias("n_rows"), F.min_by("minimum", "row").alias("minimum"), F.min_by("below", "row").alias("below"))
    unclear = ambiguous.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("code")), lambda n: F.substring("code", F.lit(1), n))).alias("industry")).distinct().withColumn("unclear", F.lit(True))
    least = thresholds.agg(F.min("minimum")).first()[0]
    joined = subjects.join(meets, "industry", "left").join(unclear, "industry", "left")
    workers = F.col("workers")
    lowest = F.lit(min((x for x in (least, default) if x is not None), default=None)).cast("int")
    vague = F.coalesce("unclear", F.lit(False)) | ((F.length("industry") == 1) & (F.coalesce("n_rows", F.lit(0)) > 1))
    minimum = F.when(F.col("n_rows").isNotNull(), F.col("minimum")).otherwise(F.lit(default))
    building = F.lit(None).cast("boolean") if construction else F.lit(False) if default is None else workers >= default
    applies = (
        F.when(F.coalesce("industry", F.lit("")).isin("", "모름", "전체"), F.lit(None).cast("boolean"))
        .when(F.startswith("industry", F.lit("F")), building)
        .when(vague, F.when(workers < lowest, F.lit(False)))
        .when(minimum.isNull(), F.lit(False))
        .otherwise((workers >= minimum) & F.coalesce(workers < F.col("below"), F.lit(True)))
    )
    return joined.select(*subjects.columns, applies.alias("applies"))


def checklist_status(kind: Column, value: Column, points: Column, condition: Column, applies: Column) -> tuple[Column, Column]:
    """Status and points of a checklist item: kind 감점, 가점 or 의무; condition is 예, 아니오, 모름 or null (the item has none)."""
    known = F.coalesce(value, F.lit("")) != ""
    known = known & (value != "모름")
    scored = F.floor(F.coalesce(points, F.lit(0.0)) * 10 + 0.5) / 10
    conditioned = condition.isNotNull() & (F.coalesce(points, F.lit(0.0)) != 0) & (condition != "예")
    status = (
        F.when(
            kind.isin("감점", "가점"),
            F.when(~known, "확인 필요")
            .when(conditioned, F.when(condition == "아니오", "부족").otherwise("확인 필요"))
            .when(kind == "감점", F.when(scored < 0, "부족").otherwise("충족"))
            .otherwise(F.when(scored > 0, "충족").otherwise("부족")),
        )
        .when(applies == F.lit(False), "해당 없음")
        .when(value == "예", "충족")
        .when(applies.isNull(), "확인 필요")
        .when(value == "아니오", "부족")
        .otherwise("확인 필요")
    )
    given = F.when(kind.isin("감점", "가점") & known, F.when(conditioned, F.when(condition == "아니오", F.lit(0.0))).when((kind == "가점") & (scored <= 0), F.lit(0.0)).otherwise(scored))
    return status, given
