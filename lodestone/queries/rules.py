"""Rule engines: eligibility, duties, checklists."""

from pyspark.sql import functions as F

from ..operators import aggregates, rules
from ..schemas import table
from .registry import query

ASKED = rules.Applicant(who="사업주", workers=30, industry="C25", region="서울", size="중", hazard="모름")


def _programmes(spark, d):
    """Parts as programmes: their columns follow from key and size."""
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    return table(spark, d, "part").select(
        "p_partkey",
        F.when(size < 10, "울산 북구").when(size < 20, "서울").otherwise("전국").alias("region"),
        F.when(size % 7 == 0, "근로자").otherwise("사업주").alias("unit"),
        F.when(size % 5 == 0, "35").otherwise("").alias("low"),
        F.when(size % 3 == 0, "20").otherwise("").alias("high"),
        F.when(size % 11 == 0, "50").otherwise("").alias("cap"),
        pick("단독", "또는_소기업", "또는_중소기업").alias("combined"),
        pick("전체", "제조업", "건설업", "C2;F41", "조선").alias("industries"),
        F.lit("").alias("excluded"),
        F.when(size % 13 == 0, "Y").otherwise("").alias("needs_hazard"),
        F.lit("소음").alias("hazard_kind"),
        F.when(size == 50, "미확인").otherwise("공식").alias("verified"),
        F.lit("2026").alias("year"),
        *[F.lit("").alias(c) for c in ("insured", "no_arrears", "excluded_targets", "no_double", "contractor", "original")],
        F.when(size % 17 == 0, "다음 중 하나 이상").otherwise("").alias("condition"),
        F.lit("상시근로자").alias("basis"),
        F.col("p_type"),
    )


VERDICT = """CASE WHEN p_size < 10 THEN '타지역' WHEN p_size % 7 = 0 THEN '개인대상' WHEN p_size % 11 = 0 AND p_size % 5 <> 0 AND p_size % 3 <> 0 THEN '제외' WHEN p_size % 5 = 0 THEN '제외'
             WHEN p_size % 3 = 0 AND p_partkey % 3 <> 2 THEN '제외' WHEN p_partkey % 5 IN (2, 4) THEN '제외'
             WHEN p_size % 11 = 0 OR p_size % 13 = 0 OR p_size = 50 THEN '확인필요' WHEN p_size % 17 = 0 THEN '조건부' ELSE '해당' END"""


@query(f"SELECT p_partkey, {VERDICT} AS verdict FROM part")
def e1_eligibility_verdict(spark, d):
    return _programmes(spark, d).select("p_partkey", rules.eligibility(ASKED)[0].alias("verdict"))


@query(f"""SELECT count(*) FILTER (WHERE v NOT IN ('제외', '타지역')) AS eligible, count(*) FILTER (WHERE v = '개인대상') AS personal, count(*) FILTER (WHERE v = '지역사업') AS regional,
           count(*) FILTER (WHERE v IN ('제외', '타지역')) AS excluded FROM (SELECT {VERDICT} AS v FROM part)""")
def a15_verdict_tiles(spark, d):
    return _programmes(spark, d).select(rules.eligibility(ASKED)[0].alias("v")).agg(*rules.tiles(F.col("v")))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS matches FROM part""")
def e3_industry_match(spark, d):
    return _programmes(spark, d).select("p_partkey", rules.industry_matches(F.col("industries"), F.lit("C25")).alias("matches"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '근로자' ELSE '사업주' END AS kind, CASE p_type WHEN 'PROMO' THEN '융자' WHEN 'SMALL' THEN '보험료·세금 혜택' WHEN 'LARGE' THEN '무료 서비스' ELSE '보조금·비용지원' END AS way FROM part""")
def e5_kinds_and_ways(spark, d):
    form = F.when(F.col("p_type") == "PROMO", "융자").when(F.col("p_type") == "SMALL", "보험료감면").when(F.col("p_type") == "LARGE", "무상서비스").otherwise("비용지원")
    return _programmes(spark, d).select("p_partkey", rules.applicant_kind(F.col("unit")).alias("kind"), rules.way_of(form).alias("way"))


def _thresholds(spark):
    rows = spark.createDataFrame([(0, "C25", 50, None), (0, "C29", 50, None), (1, "K64", 300, 1000), (1, "C26", 300, 1000)], "row int, industry string, minimum int, below int")
    return rows, spark.createDataFrame([("J58",)], "code string")


def _subjects(spark, d):
    codes = ("C25", "K64", "J58", "F41", "C", "G47", "모름")
    code = F.element_at(F.array(*map(F.lit, codes)), (F.col("c_custkey") % 7 + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), code.alias("industry"), F.when(F.col("c_custkey") % 11 > 0, (F.col("c_custkey") * 37 % 1200).cast("int")).alias("workers"))


APPLIES = """CASE c_custkey % 7 WHEN 0 THEN w >= 50 WHEN 1 THEN w >= 300 AND w < 1000 WHEN 2 THEN CASE WHEN w < 50 THEN false END WHEN 4 THEN CASE WHEN w < 50 THEN false END WHEN 5 THEN w >= 100 END"""
SUBJECTS = "s AS (SELECT c_custkey, CASE WHEN c_custkey % 11 > 0 THEN c_custkey * 37 % 1200 END AS w FROM customer)"


@query(f"WITH {SUBJECTS} SELECT c_custkey AS id, {APPLIES} AS applies FROM s")
def e6_duty_applies(spark, d):
    """True, false or null where it can't be told; construction goes by site."""
    return rules.duty_applies(_subjects(spark, d), *_thresholds(spark), "공사금액 20억원 이상 현장", 100).select("id", "applies")


@query(f"""WITH {SUBJECTS}, a AS (SELECT c_custkey, {APPLIES} AS applies, CASE c_custkey % 3 WHEN 0 THEN '예' WHEN 1 THEN '아니오' ELSE '' END AS v FROM s),
          j AS (SELECT CASE WHEN applies = false THEN '해당 없음' WHEN v = '예' THEN '충족' WHEN applies IS NULL THEN '확인 필요' WHEN v = '아니오' THEN '부족' ELSE '확인 필요' END AS status FROM a)
          SELECT ord, x.status, count(j.status) AS n FROM (VALUES (0, '부족'), (1, '확인 필요'), (2, '충족'), (3, '해당 없음')) x(ord, status) LEFT JOIN j ON j.status = x.status GROUP BY ord, x.status""")
def e7_checklist_counts(spark, d):
    judged = rules.duty_applies(_subjects(spark, d), *_thresholds(spark), "공사금액 20억원 이상 현장", 100)
    value = F.when(F.col("id") % 3 == 0, "예").when(F.col("id") % 3 == 1, "아니오").otherwise("")
    status, _ = rules.checklist_status(F.lit("의무"), value, F.lit(None).cast("double"), F.lit(None).cast("string"), F.col("applies"))
    return aggregates.zero_filled(judged.select(status.alias("status")), "status", rules.STATUSES).withColumn("ord", F.col("ord").cast("int"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '확인 필요' WHEN p_size % 4 = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN '충족' WHEN p_partkey % 3 = 1 THEN '부족' ELSE '확인 필요' END WHEN p_size % 4 = 2 THEN '부족' ELSE '부족' END AS status,
          CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 0.8 WHEN p_partkey % 3 = 1 THEN 0.0 END WHEN p_size % 4 = 2 THEN 0.0 ELSE -3.0 END::DOUBLE AS points FROM part""")
def e7_scores(spark, d):
    """Bonuses with a condition, bonuses without points, penalties, unknown ones."""
    k, size = F.col("p_partkey"), F.col("p_size") % 4
    kind = F.when(size == 3, "감점").otherwise("가점")
    value = F.when(size == 0, "모름").otherwise("있음")
    points = F.when(size == 1, 0.8).when(size == 3, -3.0).otherwise(0.0)
    condition = F.when((size == 1) & (k % 3 == 0), "예").when((size == 1) & (k % 3 == 1), "아니오").when(size == 1, "모름")
    status, given = rules.checklist_status(kind, value, points, condition, F.lit(None).cast("boolean"))
    return table(spark, d, "part").select("p_partkey", status.alias("status"), given.alias("points"))


@query(f"""SELECT n AS place, p_partkey, {VERDICT} AS verdict FROM (VALUES (0, 7), (1, 3), (2, 12)) x(n, id) JOIN part ON p_partkey = id""")
def e13_given_list(spark, d):
    """A given list of programmes in its order; unknown ids are left out."""
    ids = spark.createDataFrame([(i, k) for i, k in enumerate((7, 3, 12, -1))], "place int, p_partkey long")
    judged = _programmes(spark, d).join(F.broadcast(ids), "p_partkey")  # a list that someone typed
    return judged.select("place", "p_partkey", rules.eligibility(ASKED)[0].alias("verdict"))


@query(f"""WITH j AS (SELECT p_partkey, {VERDICT} AS verdict, CASE p_type WHEN 'PROMO' THEN '융자' WHEN 'SMALL' THEN '보험료·세금 혜택' WHEN 'LARGE' THEN '무료 서비스' ELSE '보조금·비용지원' END AS way,
                  CAST(contains(p_name, 'red') OR contains(p_name, 'blue') AS BIGINT) AS score FROM part WHERE p_size % 7 <> 0)
          SELECT p_partkey, verdict, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, list_position(['해당', '조건부', '확인필요', '개인대상', '지역사업', '타지역', '제외'], verdict), p_partkey) AS rank
          FROM j WHERE verdict NOT IN ('제외', '타지역') AND way IN ('융자', '무료 서비스')) WHERE rank <= 40""")
def r17_programme_finder(spark, d):
    """Scope, verdict, match score, picked ways, then matches first and verdicts in their order."""
    from ..functions import text as T
    from ..operators.filters import ranked

    form = F.when(F.col("p_type") == "PROMO", "융자").when(F.col("p_type") == "SMALL", "보험료감면").when(F.col("p_type") == "LARGE", "무상서비스").otherwise("비용지원")
    named = table(spark, d, "part").select("p_partkey", T.search_key(F.col("p_name")).alias("key"))
    score = T.synonym_score(F.col("key"), "red", [["red", "blue"]]).cast("bigint")
    programmes = _programmes(spark, d).filter(rules.in_scope(ASKED.who, F.col("unit"))).join(named, "p_partkey")
    judged = programmes.select("p_partkey", rules.eligibility(ASKED)[0].alias("verdict"), rules.way_of(form).alias("way"), score.alias("score"))
    picked = judged.filter(~F.col("verdict").isin("제외", "타지역") & F.col("way").isin("융자", "무료 서비스"))
    place = F.array_position(F.array(*map(F.lit, rules.VERDICTS)), F.col("verdict"))
    return ranked(picked, [F.desc("score"), place, F.col("p_partkey")], 40).select("p_partkey", "verdict", "score", "rank")


@query("""SELECT 0 AS row, unnest(['C25', 'C29']) AS industry, 50 AS minimum, 'table' AS kind UNION ALL SELECT 1, unnest(['K64', 'C26']), 300, 'table' UNION ALL SELECT -1, 'J58', NULL, 'unclear' UNION ALL SELECT -1, '', 100, 'default'""")
def e9_threshold_rows(spark, d):
    """A nested threshold table as long rows, its unclear codes and its default included."""
    nested = spark.createDataFrame([([(["C25", "C29"], 50), (["K64", "C26"], 300)], ["J58"], 100)], "rows array<struct<industries array<string>, minimum int>>, unclear array<string>, otherwise int")
    opened = nested.select(F.posexplode("rows").alias("row", "r")).select("row", F.explode("r.industries").alias("industry"), "r.minimum", F.lit("table").alias("kind"))
    unclear = nested.select(F.lit(-1).alias("row"), F.explode("unclear").alias("industry"), F.lit(None).cast("int").alias("minimum"), F.lit("unclear").alias("kind"))
    return opened.unionAll(unclear).unionAll(nested.select(F.lit(-1), F.lit(""), "otherwise", F.lit("default")))


@query("""SELECT p_partkey, CASE WHEN p_type IN ('LARGE', 'SMALL') AND contains(p_name, 'red') THEN p_type ELSE '' END AS form,
          CASE WHEN p_type IN ('LARGE', 'SMALL') AND contains(p_name, 'red') THEN '' ELSE 'form' END || CASE WHEN p_size <= 25 THEN '' ELSE ' size' END AS dropped FROM part""")
def e11_proposal_check(spark, d):
    """Proposed values count if they are in their list and their evidence is in the text; the others are named."""
    good_form = F.col("p_type").isin("LARGE", "SMALL") & F.contains("p_name", F.lit("red"))
    good_size = F.col("p_size") <= 25
    dropped = F.concat(F.when(good_form, "").otherwise("form"), F.when(good_size, "").otherwise(" size"))
    return table(spark, d, "part").select("p_partkey", F.when(good_form, F.col("p_type")).otherwise("").alias("form"), dropped.alias("dropped"))
