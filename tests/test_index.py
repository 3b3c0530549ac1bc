"""The search index: batches that outlive a broken build, refusals, and answers equal to those from the raw table."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans import index as I
from lodestone.plans import retrieval as R
from lodestone.sources import store


@pytest.fixture
def source(spark, small, tmp_path):
    """The documents in six files."""
    path = str(tmp_path / "documents")
    spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").repartition(6, "doc_id").write.parquet(path)
    return path


SPEC = I.Spec("1", "doc_id", "text", ("lang",), "tokens", files_per_batch=1)


def rows(index, *names):
    return {name: sorted(map(str, index.table(name).collect())) for name in names or I.TABLES}


def test_a_broken_build_is_taken_up(spark, source, tmp_path, monkeypatch):
    whole = I.ensure_index(spark, source, str(tmp_path / "whole"), SPEC)
    path, commit, calls = str(tmp_path / "broken"), I.commit_once, []

    def breaks(df, at, *a, **kw):
        calls.append(at)
        if len(calls) == 6:
            raise RuntimeError("an executor too many was lost")
        return commit(df, at, *a, **kw)

    monkeypatch.setattr(I, "commit_once", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        I.build_index(spark, source, path, SPEC)
    monkeypatch.setattr(I, "commit_once", commit)
    with pytest.raises(I.StaleIndex, match="no whole index"):
        I.open_index(spark, source, path, SPEC)
    left = tmp_path / "broken" / "batches" / "postings" / "000002"  # what a job that never committed leaves
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_bytes(b"torn")
    made = I.build_index(spark, source, path, SPEC)
    assert set(made) == {"documents", "terms", "postings", "postings/000002", *(f"{n}/{k:06}" for n in ("documents", "postings") for k in (3, 4, 5))}
    again = I.open_index(spark, source, path, SPEC)
    assert rows(again) == rows(whole) and (again.n, again.average) == (whole.n, whole.average)
    assert I.build_index(spark, source, path, SPEC) == []


def test_another_specification_or_source_is_refused(spark, source, small, tmp_path):
    path = str(tmp_path / "index")
    I.build_index(spark, source, path, SPEC)
    other = I.Spec("1", "doc_id", "text", ("lang",), "analyzer", 1)
    with pytest.raises(ValueError, match="changed .recipe.; use a new folder"):
        I.build_index(spark, source, path, other)
    with pytest.raises(I.StaleIndex, match="another recipe"):
        I.open_index(spark, source, path, other)
    with pytest.raises(ValueError, match="no recipe"):
        I.ensure_index(spark, source, path, I.Spec("1", "doc_id", "text", (), "none"))
    spark.createDataFrame([(10**6, "one more", "en")], "doc_id long, text string, lang string").write.mode("append").parquet(source)
    with pytest.raises(I.StaleIndex, match="another source"):
        I.open_index(spark, source, path, SPEC)


def test_files_that_are_not_the_manifests_are_refused(spark, source, tmp_path):
    path = tmp_path / "index"
    I.build_index(spark, source, str(path), SPEC)
    next((path / "postings").glob("part-*")).unlink()
    with pytest.raises(I.StaleIndex, match="postings"):
        I.open_index(spark, source, str(path), SPEC)


def test_the_manifest_is_put_once(spark, tmp_path):
    path = str(tmp_path / "folder" / "one.json")
    assert store.read_text(spark, path) is None
    assert store.put_new(spark, path, "first 가") and not store.put_new(spark, path, "second")
    assert store.read_text(spark, path) == "first 가"
    assert [f.path.rpartition("/")[2] for f in store.data_files(spark, str(tmp_path / "folder"))] == ["one.json"]


@pytest.mark.parametrize("particles", [False, True])
@pytest.mark.parametrize("weighted", [[("license", 1.0), ("license", 1.0), ("und", 0.6)], [("the", 1.0)], [("nowhere", 1.0)], []])
def test_scores_equal_those_of_the_raw_table(spark, source, tmp_path, weighted, particles):
    index = I.ensure_index(spark, source, str(tmp_path / "index"), SPEC)
    docs = spark.read.parquet(source)
    raw = R.bm25(*R.bm25_index(docs, "doc_id", T.tokens(F.col("text"))), weighted, particles=particles) if weighted else None
    found = {r["row"]: round(r["score"], 9) for r in index.bm25(index.weighted_terms(weighted, particles)).collect()}
    assert found == ({r["row"]: round(r["score"], 9) for r in raw.collect()} if raw else {})


@pytest.mark.parametrize("runs", [False, True])
def test_all_longer_terms_count(spark, tmp_path, runs):
    """Also those behind the first 24 in order, one document each; the bare word, a neighbour and what is longer by three are told apart."""
    words = [f"ab{c}" for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    texts = [*words, "ab", "abzz", "abzzz", "xab", "a", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.repartition(3, "doc_id").write.parquet(str(tmp_path / "documents"))
    index = I.ensure_index(spark, str(tmp_path / "documents"), str(tmp_path / "index"), I.Spec("1", "doc_id", "text", (), "tokens", 1, runs=runs))
    share = I._idf(index.n, 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 / index.average))
    found = {texts[r["row"]]: round(r["score"] / share, 9) for r in index.bm25_of_all([("ab", 1.0), ("ab", 1.0), ("abz", 0.6), ("a", 0.5)]).collect()}
    assert found == {**{w: 1.0 for w in words}, "ab": 2.0, "abz": 1.6, "abzz": 1.3, "abzzz": 0.3, "a": 0.5}
    assert index.bm25_of_all([]).count() == 0
    plan = index.bm25_of_all([("ab", 1.0)])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,ab)" in plan


def test_questions_read_the_row_groups_of_their_terms(spark, source, tmp_path):
    index = I.ensure_index(spark, source, str(tmp_path / "index"), SPEC)
    plan = index.bm25([("license", 3, 1.0), ("und", 5, 1.0)])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[In\(term, \[license,und\]\)\]", plan) and "text" not in plan
    assert index.postings(["license"]).count() == index.table("terms").filter("term = 'license'").first()["df"]
    in_order = index.table("postings").select(F.input_file_name().alias("f"), "term").groupBy("f").agg(F.min("term").alias("a"), F.max("term").alias("z")).orderBy("a", "z").collect()
    assert all(x["z"] <= y["a"] for x, y in zip(in_order, in_order[1:], strict=False))


def test_nulls_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "few")
    spark.createDataFrame([(1, None), (2, ""), (3, "one two two")], "doc_id long, text string").coalesce(1).write.parquet(path)
    index = I.ensure_index(spark, path, str(tmp_path / "index"), I.Spec("1", "doc_id", "text"))
    assert index.n == 3 and index.average == 1.0 and index.postings(["two"]).first()["tf"] == 2
    none = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(none)
    empty = I.ensure_index(spark, none, str(tmp_path / "index"), I.Spec("1", "doc_id", "text"))
    assert empty.n == 0 and empty.bm25(empty.weighted_terms([("two", 1.0)])).count() == 0


def test_pages_of_a_search(spark):
    scores = spark.createDataFrame([(i, float(100 - i)) for i in range(30)] + [(99, 0.0)], "row long, score double")
    dense = spark.createDataFrame([(40, 0.9), (0, 0.5), (41, 0.34), (42, 0.35)], "row long, score double")
    pages = [R.search_page(scores, dense, p).orderBy("rank").collect() for p in (1, 4, 5)]
    assert [len(p) for p in pages] == [10, 2, 0] and pages[0][0]["row"] == 0 and pages[0][0]["via"] == "words+meaning"
    assert {(r["total"], r["pages"]) for p in pages for r in p} == {(32, 4)}
    only = {r["row"]: (r["score"], r["similarity"]) for p in pages for r in p if r["via"] == "meaning"}
    assert only == {40: (0.0, 0.9), 42: (0.0, 0.35)}
    lone = R.search_page(scores, None, 1).collect()
    assert len(lone) == 10 and lone[0]["similarity"] is None and lone[0]["total"] == 30
    with pytest.raises(ValueError, match="pages"):
        R.search_page(scores, dense, 6)


def test_substrings_are_found_by_their_trigrams(spark, tmp_path):
    """Words of any length, at any place, overlapping themselves, against a scan."""
    import random

    rng = random.Random(6)
    texts = [(i, "".join(rng.choice("ab가 \n") for _ in range(rng.randrange(40)))) for i in range(120)] + [(900, "AAAAaaa"), (901, None), (902, ""), (903, "x"), (904, "The LICENSE\U0001f600license")]
    path = str(tmp_path / "texts")
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(path)
    index = I.ensure_index(spark, path, str(tmp_path / "index"), I.Spec("1", "doc_id", "text", (), "trigrams", places=True))
    for words in (["a"], ["ab"], ["가"], ["aa"], ["aba"], ["a b가"], ["ab", "b a"], ["license"], ["\U0001f600l"], ["aaaa"], ["b\n"], ["zzz"], ["ab", "zz"]):
        held = {i: sum((t or "").lower().count(w) for w in words) for i, t in texts if all(w in (t or "").lower() for w in words)}
        assert {r["row"]: r["hits"] for r in index.occurrences(words).collect()} == held, words
    with pytest.raises(ValueError, match="characters"):
        index.starts("")
    plan = index.starts("license")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[In\(term, \[cen,lic,nse\]\)\]", plan) or "In(term" in plan
    tokens = I.ensure_index(spark, path, str(tmp_path / "index"), I.Spec("1", "doc_id", "text"))
    with pytest.raises(ValueError, match="no places"):
        tokens.starts("license")


def test_pruned_vectors_equal_the_full_product(spark, monkeypatch):
    """Clusters, a zero vector, vectors of any length, equal ones, more rows asked for than there are; and with clusters most products are left out."""
    import numpy as np

    from lodestone.plans import vectors as V

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 3
    rows = np.concatenate([centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)) * 0.05, rng.normal(size=(60, 8)), np.zeros((1, 8)), np.ones((3, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, v array<double>")
    scores = np.round(rows[::20] @ rows.T, 6)
    made, products = [], V._products
    monkeypatch.setattr(V, "_products", lambda asked, held, *a: made.append(asked) or products(asked, held, *a))
    for most in (7, 2000):
        found = {(r["query"], r["rank"]): (r["row"], r["score"]) for r in V.nearest_pruned(df.filter("id % 20 = 0"), df, "id", "v", most, block=50).collect()}
        want = {}
        for q, s in enumerate(scores):
            for rank, row in enumerate(np.lexsort((np.arange(len(s)), -s))[:most], 1):
                want[q * 20, rank] = (int(row), float(s[row]))
        assert found.keys() == want.keys() and all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 2e-6 for k in want)
        if most == 7:
            sizes = {r["cell"]: r["n"] for r in V.in_cells(df, "id", "v", V.centroids(df, "id", "v")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
            met = sum(sizes[r["cell"]] for asked in made for r in asked.select("cell").collect())
            assert met < 0.6 * scores.size
    assert V.nearest_pruned(df.filter("id < 0"), df.filter("id < 0"), "id", "v", 3).count() == 0


def test_places_are_written_once_and_not_shuffled(spark, tmp_path, monkeypatch):
    """Postings with places are the batches' own, counted in pieces of whole texts; a text that is longer than a piece is one."""
    monkeypatch.setattr(I, "PIECE", 40)
    path = str(tmp_path / "texts")
    spark.createDataFrame([(i, "the other " * (i % 9)) for i in range(60)], "doc_id long, text string").coalesce(1).write.parquet(path)
    spec = I.Spec("1", "doc_id", "text", (), "trigrams", places=True)
    assert "Exchange" not in I._of_batch(spark.read.parquet(path), spec)[1]._jdf.queryExecution().executedPlan().toString()
    index = I.ensure_index(spark, path, str(tmp_path / "index"), spec)
    assert not list((tmp_path / "index").glob("*/postings"))
    assert {r["row"]: (r["starts"], r["hits"]) for r in index.starts("the").join(index.occurrences(["the"]), "row").collect()} == {i: ([p + 10 * k for k in range(i % 9) for p in (0, 5)], 2 * (i % 9)) for i in range(60) if i % 9}
    assert {r["row"]: r["dl"] for r in index.table("documents").collect()} == {i: 10 * (i % 9) for i in range(60)}


@pytest.mark.parametrize("recipe", ["tokens", "analyzer"])
def test_runs_are_written_once_and_answer_the_same(spark, source, tmp_path, monkeypatch, recipe):
    """Postings stay where they were written, with the documents' rows; no terms are written, and a build that broke is taken up."""
    monkeypatch.setattr(I, "PIECE", 500)
    specs = [I.Spec("1", "doc_id", "text", ("lang",), recipe, 2, runs=runs) for runs in (False, True)]
    ranges = I.ensure_index(spark, source, str(tmp_path / "ranges"), specs[0])
    path, commit, calls = tmp_path / "runs", I.commit_once, []
    monkeypatch.setattr(I, "commit_once", lambda *a, **kw: calls.append(a) or (commit(*a, **kw) if len(calls) < 3 else 1 / 0))
    with pytest.raises(ZeroDivisionError):
        I.build_index(spark, source, str(path), specs[1])
    monkeypatch.setattr(I, "commit_once", commit)
    assert I.build_index(spark, source, str(path), specs[1]) == ["postings/000002", "documents"]
    assert sorted(x.name for x in path.iterdir() if x.is_dir()) == ["batches", "documents"] and [x.name for x in (path / "batches").iterdir()] == ["postings"]
    runs = I.open_index(spark, source, str(path), specs[1])
    assert rows(runs) == rows(ranges) and (runs.n, runs.average) == (ranges.n, ranges.average)
    for weighted in ([("license", 1.0), ("license", 1.0), ("und", 0.6)], [("th", 1.0), ("the mit", 1.0), ("no", 0.5)]):
        terms = runs.weighted_terms(weighted, particles=True)
        assert terms == ranges.weighted_terms(weighted, particles=True) and len(terms) > 1
        assert sorted((r["row"], round(r["score"], 9)) for r in runs.bm25(terms).collect()) == sorted((r["row"], round(r["score"], 9)) for r in ranges.bm25(terms).collect())
    plan = runs.table("terms").filter(F.startswith("term", F.lit("lic")))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,lic)" in plan


def test_neighbours_are_put_together_where_they_are_counted(spark):
    """The lists that go to Python have words only; postings and their places are those of the whole lists of terms."""
    import pyarrow as pa

    some = ["a1", "a1-b", "a1.c", "b", "9", "가나", "ab/c", "a"]
    texts = [[some[(i * k + i // 3) % 8] for i in range(k)] for k in (0, 1, 2, 5, 30, 0, 7)]
    whole = [t + [f"{a} {b}" for a, b in zip(t, t[1:], strict=False)] for t in texts]
    for part in (slice(None), slice(0, 1), slice(1, 2)):
        made = [I._postings(pa.array(range(len(x[part])), pa.int64()), pa.array(x[part], pa.list_(pa.string())), ["term", "row", "dl", "tf", "places"], True, pairs) for x, pairs in ((texts, True), (whole, False))]
        assert made[0].equals(made[1])
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert "concat_ws" not in I._of_batch(docs, I.Spec("1", "doc_id", "text", (), "analyzer", runs=True))[1]._jdf.queryExecution().executedPlan().toString()
