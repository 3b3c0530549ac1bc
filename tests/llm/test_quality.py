import zlib

import numpy as np
import pytest
from cases import awkward, documents
from pyspark.sql import functions as F

from lodestone.llm import quality as Q


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    """Learnt from the other rows, held-out labels are met in nine of ten cases, and good documents are kept."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = Q.score_quality(docs, labels)
    rows = scored.join(labels, "doc_id").filter("held_out").select("predicted", "quality", "score").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    assert len(rows) > 60 and np.mean(right) >= 0.85 and np.mean(good) >= 0.85
    assert scored.count() == docs.count() and scored.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_held_out_labels_are_not_used(spark):
    """Turning the held-out labels round changes no score."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r["doc_id"]: (r["score"], r["held_out"]) for r in Q.score_quality(docs, x).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]
    assert all(held == is_held_out(i) for i, (_, held) in scores[0].items())


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(5, 0, 0), (6, 1, None), (6, 0, None), (None, 1, 1), (7, None, 0), (99, 1, 0)]])
def test_awkward_rows(spark, labels):
    rows = awkward()
    found = Q.score_quality(documents(spark, rows, score="clash", words="clash"), labelled(spark, labels)).collect()
    assert sorted((str(r["doc_id"]), r["held_out"]) for r in found) == sorted((str(i), is_held_out(i)) for i, _ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    by_text = {}
    for r in found:
        by_text.setdefault(dict(rows)[r["doc_id"]] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())


def test_keep_good_keeps_columns(spark):
    df = documents(spark, awkward(), words="clash", row="clash", log_bytes="clash")
    kept = Q.keep_good(df, labelled(spark, []))
    assert kept.columns == df.columns and kept.count() == df.count()
    assert kept.filter("words <> 'clash' OR log_bytes <> 'clash'").count() == 0
    assert Q.keep_good(documents(spark, []), labelled(spark, [])).count() == 0


def test_rules_and_lasso():
    """Labels made by a conjunction are found, with few rules; the compiled rules say what arrays say."""
    rng = np.random.default_rng(0)
    x = rng.random((2_000, len(Q.STATISTICS)))
    y = ((x[:, 3] > 0.4) & (x[:, 7] <= 0.6)).astype(float)
    rules, intercept = Q.fit(x, y)
    score = intercept + sum(w * Q.holds(r, x) for r, w in rules)
    assert ((score > 0) == y).mean() > 0.97
    assert len(rules) < len(Q.extract_rules(x, y))
    assert {s for s, *_ in max(rules, key=lambda r: abs(r[1]))[0]} & {3, 7}


def test_compiled_score(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, len(Q.STATISTICS)))
    model = Q.fit(x, (x[:, 0] > 0.5).astype(float))
    frame = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["i", *Q.STATISTICS])
    got = [r["s"] for r in frame.select("i", Q.compile_score(model).alias("s")).orderBy("i").collect()]
    plain = model[1] + sum(w * Q.holds(r, x) for r, w in model[0])
    assert np.allclose(got, 1 / (1 + np.exp(-plain)))
