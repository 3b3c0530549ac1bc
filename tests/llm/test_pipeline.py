import re

import pytest
from cases import awkward, documents, words
from test_line_dedup import brute as lines_brute
from test_line_dedup import plain
from test_suffix_dedup import brute as spans_brute

import corpus_pipeline as P


def write(spark, folder, rows, labels):
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, tmp_path):
    """Each stage on a small corpus: what it has to catch goes, clean documents stay, columns stay."""
    shared, line = plain(120, 1, 400), "Visit us at page 7 for more"
    rows = [(i, f"{plain(60, 10 + i, 400)}\n{line}\n{plain(50, 300 + i, 400)}") for i in range(30)]
    rows += [(40, rows[0][1] + " end"), (41, plain(90, 2_000, 400) + "\n" + shared), (42, plain(70, 2_001, 400) + "\n" + shared), (43, None), (44, "")]
    folder = write(spark, tmp_path / "d", rows, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = [f for _, f in P.STAGES]
    kept = {}
    for f in stages[:4]:
        docs = P.cut(f(spark, docs, folder))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[f.__name__] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept["quality"]) == {i for i, _ in rows}  # without labels nothing is rejected
    assert [(i, t) for i, t, _, _ in lines_brute(rows, 10)] == sorted(kept["lines"].items(), key=lambda x: str((x[0], x[1])))
    assert set(kept["lines"]) - set(kept["near_duplicates"]) == {40, 44}
    left = sorted(kept["near_duplicates"].items())
    removed = {i: n for i, _, n, _, _ in spans_brute(left)}
    assert {i for i, n in removed.items() if n} == {41, 42}
    for i, t in left:
        assert len(kept["repeats"][i].encode()) <= len((t or "").encode()) - removed[i]
    bins = stages[4](spark, docs, folder).collect()
    sizes = {i: len(re.findall("[^\x20\x09-\x0d]+", t)) for i, t in kept["repeats"].items()}
    packed = {}
    for b in bins:
        for i, n in zip(b["doc_ids"], b["lengths"], strict=True):
            packed[i] = packed.get(i, 0) + n
    assert packed == {i: n for i, n in sizes.items() if n}


@pytest.mark.parametrize("rows", [awkward(), []])
def test_run_on_awkward_tables(spark, tmp_path, rows):
    folder = write(spark, tmp_path / "d", rows, [(1, 1, 0), (99, None, None)])
    bins = P.run(spark, folder)
    assert bins.columns == ["bin_id", "capacity", "used", "doc_ids", "starts", "lengths"]
    found = bins.collect()
    assert bool(found) == bool(rows)
    assert {i for b in found for i in b["doc_ids"]} == ({4, 5, 7, 9, None} if rows else set())  # 10 is one passage that repeats itself


def test_classifier_rejects(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    kept = P.quality(spark, docs, small).join(labels, "doc_id")
    before = docs.join(labels, "doc_id")
    share = lambda df, q: df.filter(f"quality = {q}").count()
    assert share(kept, 1) >= 0.9 * share(before, 1) and share(kept, 0) <= 0.5 * share(before, 0)
