"""Verdict tables of the programme and duty rules."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import rules
from lodestone.operators.rules import Applicant

BASE = Applicant(who="전체", workers=30, industry="C25")
BLANK = dict.fromkeys(("low", "high", "cap", "excluded", "needs_hazard", "hazard_kind", "insured", "no_arrears", "condition", "excluded_targets", "no_double", "contractor", "original"), "")
PROGRAMME = BLANK | {"region": "전국", "unit": "사업주", "combined": "단독", "industries": "전체", "verified": "공식", "year": "2026", "basis": "상시근로자"}


def judge(spark, applicant, **over):
    verdict, why = rules.eligibility(applicant)
    row = spark.createDataFrame([PROGRAMME | over]).select(verdict.alias("v"), why.alias("w")).first()
    return row["v"], row["w"]


SMALL = {"high": "50", "combined": "또는_소기업"}
SITE = {"cap": "50", "basis": "해당없음(공사금액 기준)", "industries": "건설업"}


@pytest.mark.parametrize(
    ("over", "changes", "verdict"),
    [
        ({}, {}, "해당"),
        (SMALL, {"workers": 49}, "해당"),
        (SMALL, {"workers": 80}, "확인필요"),
        (SMALL, {"workers": 80, "size": "소"}, "해당"),
        (SMALL, {"workers": 80, "size": "중"}, "제외"),
        ({"low": "5"}, {"workers": 4}, "제외"),
        (SITE, {}, "제외"),
        (SITE, {"industry": "F41"}, "확인필요"),
        ({"region": "울산 북구"}, {}, "지역사업"),
        ({"region": "울산 북구"}, {"region": "부산"}, "타지역"),
        ({"region": "울산 북구"}, {"region": "울산"}, "확인필요"),
        ({"unit": "근로자"}, {}, "개인대상"),
        ({"needs_hazard": "Y", "hazard_kind": "소음"}, {"hazard": "N"}, "제외"),
        ({"needs_hazard": "Y", "hazard_kind": "소음"}, {"hazard": "Y"}, "해당"),
        ({"needs_hazard": "Y", "hazard_kind": "소음"}, {}, "확인필요"),
        ({"condition": "다음 중 하나"}, {}, "조건부"),
    ],
)
def test_verdicts(spark, over, changes, verdict):
    assert judge(spark, replace(BASE, **changes), **over)[0] == verdict


def test_reasons(spark):
    assert judge(spark, replace(BASE, workers=80, size="중"), **SMALL) == ("제외", "50인 미만만(소기업 아님)")
    assert judge(spark, BASE, **SITE) == ("제외", "건설현장 대상")
    assert judge(spark, BASE, insured="Y", no_arrears="Y", year="2025", no_double="불가") == ("해당", "2025년 자료 | 산재보험 가입 · 보험료 체납 없음 | 중복지원 제한: 불가")


@pytest.mark.parametrize(("target", "code", "matches"), [("제조업", "C25", True), ("C31", "C", True), ("조선", "C31", True), ("건설업", "C25", False), ("서비스 및 기타업종", "F41", False), ("C2;F41", "C25", True)])
def test_industries(spark, target, code, matches):
    row = spark.range(1).select(rules.industry_matches(F.lit(target), F.lit(code)).alias("m")).first()
    assert row["m"] is matches


def test_duties(spark):
    rows = spark.createDataFrame([(0, "C25", 50, None), (0, "C29", 50, None), (1, "K64", 300, None), (1, "C26", 300, None)], "row int, industry string, minimum int, below int")
    ambiguous = spark.createDataFrame([("J58",)], "code string")
    expected = [("C25", 60, True), ("C25", 40, False), ("K64", 120, False), ("G47", 120, True), ("J58", 120, None), ("J58", 10, False), ("F41", 500, None), ("C", 120, None), ("모름", 120, None), ("C25", None, None)]
    subjects = spark.createDataFrame([(i, c, w) for i, (c, w, _) in enumerate(expected)], "id int, industry string, workers int")
    found = {r["id"]: r["applies"] for r in rules.duty_applies(subjects, rows, ambiguous, "공사금액 20억원 이상 현장", 100).collect()}
    assert [found[i] for i in range(len(expected))] == [a for *_, a in expected]
    none = rules.duty_applies(spark.createDataFrame([(0, "G47", 900)], "id int, industry string, workers int"), rows, ambiguous, "현장", None)
    assert none.first()["applies"] is False


@pytest.mark.parametrize(
    ("kind", "value", "points", "condition", "applies", "status", "given"),
    [
        ("감점", "있음", -3.0, None, None, "부족", -3.0),
        ("감점", "없음", 0.0, None, None, "충족", 0.0),
        ("감점", "모름", None, None, None, "확인 필요", None),
        ("가점", "B", 0.8, "예", None, "충족", 0.8),
        ("가점", "A", 1.0, "아니오", None, "부족", 0.0),
        ("가점", "A", 1.0, "모름", None, "확인 필요", None),
        ("가점", "없음", 0.0, None, None, "부족", 0.0),
        ("의무", "아니오", None, None, True, "부족", None),
        ("의무", "예", None, None, True, "충족", None),
        ("의무", "예", None, None, None, "충족", None),
        ("의무", "아니오", None, None, False, "해당 없음", None),
        ("의무", "아니오", None, None, None, "확인 필요", None),
    ],
)
def test_checklist(spark, kind, value, points, condition, applies, status, given):
    row = spark.createDataFrame([(kind, value, points, condition, applies)], "kind string, value string, points double, condition string, applies boolean")
    columns = rules.checklist_status(*(F.col(c) for c in row.columns))
    assert tuple(row.select(*columns).first()) == (status, given)


def test_search_scores(spark):
    key = T.search_key(F.lit("DEMO 안전장비 구입 · 끼임 방지"))
    score = lambda query: spark.range(1).select(T.synonym_score(key, query, rules.SYNONYMS).cast("int").alias("s")).first()["s"]
    assert [score("보호구"), score("협착"), score("끼임 안전장비"), score("융자"), score("  ")] == [1, 1, 2, 0, 0]
    assert score("안전 장비") > 0
