import hashlib
import re

import pytest
from cases import awkward, documents, words
from pyspark.sql import functions as F

from lodestone.llm import fill_in_middle as M
from lodestone.llm import queries


def brute(i, text, units, seed=1, plain=10, spm=20):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    parts = re.findall(units, text)
    assert "".join(parts) == text
    n = len(parts)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    before, between, after = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if h[3] % 100 < spm:
        return i, n, "spm", len(before), len(between), f"<S>{after}<P>{before}<M>{between}"
    return i, n, "psm", len(before), len(between), f"<P>{before}<S>{after}<M>{between}"


def texts():
    rows = [(100 + i, t) for i, t in enumerate(["\x01", "\x02", "\x02d\x01\x02e\x02\x02\x01", "a<P>b", "<S>", "x<M", "><S", "<<P", "line\nline\r\n\n", "𝒳\U0001f600é́", "$0\\1", " lead and tail \t"])]
    return awkward() + rows + [(1000 + i, words(i % 7, i) + "\x02\x01"[: i % 3]) for i in range(150)]


@pytest.mark.parametrize(("unit", "pattern"), [("points", "(?s)."), ("words", "[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*|[ \t\n\x0b\f\r]+"), ("lines", "[^\n]*\n|[^\n]+")])
def test_brute_force(spark, unit, pattern):
    rows = texts()
    made = M.fill_in_middle(documents(spark, rows, whole="clash", units="clash", digest="clash", low="clash"), unit, plain=10, spm=40)
    out = made.withColumn("back", M.restored(F.col("form"), F.col("output"))).collect()
    found = sorted([(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out], key=str)
    assert found == sorted([brute(i, t, pattern, spm=40) for i, t in rows], key=str)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert all(r["back"] == (r["text"] or "") and r["whole"] == "clash" for r in out)


def test_columns_of_any_name_stay(spark):
    df = documents(spark, [(1, "some text"), (2, None)]).withColumns({n: F.lit(n) for n in ("n", "form", "OUTPUT", "a.b", "before")})
    out = M.fill_in_middle(df)
    assert out.columns == [*df.columns, "n_", "form_", "prefix_chars", "middle_chars", "output_"]
    assert all(r["n"] == "n" and r["a.b"] == "a.b" and r["before"] == "before" for r in out.collect())
    assert M.fill_in_middle(documents(spark, [])).count() == 0


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("id6", "abcdef")], "doc_id string, text string")
    row = M.fill_in_middle(df).first()
    assert ("id6", row["n"], row["form"], row["prefix_chars"], row["middle_chars"], row["output"]) == brute("id6", "abcdef", "(?s).")


def test_very_long_text(spark):
    text = words(300_000, 3)
    row = M.digest(M.fill_in_middle(documents(spark, [(4, text)]))).first()
    assert row["n"] == len(text) and row["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_no_shuffle_and_no_python(spark):
    plan = M.digest(M.fill_in_middle(documents(spark, texts())))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|PythonUDF|Pandas|Arrow", plan)


def test_sql(spark, small):
    from compare import difference

    assert difference(spark, queries.QUERIES["op11_fill_in_middle"], queries.SQL["op11_fill_in_middle"], small) == ""
