import re
from collections import defaultdict

import pytest
from cases import awkward, documents, words
from pyspark.sql import functions as F

from lodestone.llm import queries
from lodestone.llm.line_dedup import line_dedup

BLANKS = " \t\x0b\x0c\r"


def template(line):
    tokens = [t for t in re.split(f"[{BLANKS}]+", line.strip(BLANKS)) if t]
    return (len(tokens), tuple("<*>" if re.search("[0-9]", t) else t for t in tokens[:8])) if tokens else None


def brute(rows, min_docs):
    texts = defaultdict(set)
    for _, t in rows:
        for line in (t or "").split("\n"):
            if template(line):
                texts[template(line)].add(t or "")
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        drop = [template(x) is not None and len(texts[template(x)]) >= min_docs for x in lines]
        out.append((i, "\n".join(x for x, d in zip(lines, drop, strict=True) if not d), len(lines), sum(drop)))
    return sorted(out, key=str)


def found(df, min_docs):
    return sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup(df, min_docs).collect()], key=str)


def logs():
    rows = []
    for i in range(60):
        rows.append((i, f"{words(9, i)}\nRequest {i} took {i * 3} ms on host\n{words(12, 900 + i)}\n  Page {i} of 10\t\n\nUnique {words(3, i)} end"))
    return rows + [(100, "Request 1 took 2 ms on host"), (101, "all\nRequest 7 took 2 ms on host\n"), (102, rows[0][1]), (102, rows[0][1])]


@pytest.mark.parametrize(("rows", "min_docs"), [(logs(), 10), (logs(), 60), (logs(), 63), (awkward(), 2), ([], 2)])
def test_brute_force(spark, rows, min_docs):
    assert found(documents(spark, rows, key="clash", template="clash", size="clash", numbers="clash", _drop="clash"), min_docs) == brute(rows, min_docs)


def test_sql(spark, small):
    from compare import difference

    assert difference(spark, queries.QUERIES["op9_line_dedup"], queries.SQL["op9_line_dedup"], small) == ""


def test_no_python_in_the_plan(spark):
    plan = line_dedup(documents(spark, logs()), 10)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_columns_of_any_name_stay(spark):
    names = ["key", "KEY_", "size", "numbers", "line_no", "chars", "n_lines", "n_dropped", "_key", "_size", "_drop", "_chars", "template", "a.b"]
    df = documents(spark, logs()).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    out = line_dedup(df, 10)
    assert out.columns == [*df.columns, "n_lines_", "n_dropped_"]
    rows = out.collect()
    assert len(rows) == len(logs()) and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names) and any(r["n_dropped_"] for r in rows)


def test_very_many_lines_in_one_text(spark):
    """Work is linear in a text's lines."""
    common = [f"Request {k} took {k} ms on host" for k in range(100_000)]
    own = [f"{'x' * (k % 50)} {k % 7 * 'y '}own line that stays here for good" for k in range(100_000)]
    text = "\n".join(line for pair in zip(common, own, strict=True) for line in pair)
    rows = [(1, text), *[(10 + k, f"Request 1 took {k} ms on host\n{words(5, k)}") for k in range(12)]]
    out = {r["doc_id"]: r for r in line_dedup(documents(spark, rows), 10).collect()}
    assert out[1]["n_lines"] == 200_000 and out[1]["n_dropped"] == 100_000 and out[1]["text"] == "\n".join(own)


def plain(n, seed, vocabulary):
    """Words without digits: each line has a template of its own."""
    return words(n, seed, vocabulary).translate(str.maketrans("0123456789", "abcdefghij"))


def test_copies_are_spared(spark):
    """A family of near copies stays whole; short pages that share more than half of themselves are cleaned."""
    story = [plain(14, 300 + k, 5000) for k in range(12)]
    family = [(i, "\n".join([*story[: i % 12], f"{plain(12, 400 + i, 5000)} edit", *story[i % 12 + 1 :]])) for i in range(24)]
    common = [plain(10, 500 + k, 5000) for k in range(6)]
    pages = [(100 + i, "\n".join([*common, *[plain(9, 600 + 10 * i + k, 5000) for k in range(4)]])) for i in range(20)]
    rows = family + pages + [(200, None), (201, "")]
    left = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_dedup(documents(spark, rows), 10, spare_copies=True).collect()}
    assert all(left[i] == (t, 0) for i, t in family)
    assert all(left[i] == ("\n".join(t.split("\n")[6:]), 6) for i, t in pages)
    assert left[200] == ("", 0) and left[201] == ("", 0)
    assert line_dedup(documents(spark, []), 10, spare_copies=True).count() == 0
