"""Releases are seen whole; decisions on a few literal rows."""

import csv
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from lodestone.operators import decisions
from lodestone.sources import release, store


def table(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string")
    return df.withColumn("text", F.col("text").alias("text", metadata={"comment": "what it says"}))


ROWS = [(1, 'a "b", c'), (2, "two\nlines\r\nand more"), (3, None), (4, " blank ends "), (5, "한글")]


def test_a_release_has_its_dictionary_and_inventory(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(ValueError, match="no release"):
        release.read_release(spark, path, "notes")
    folder = release.publish({"notes": table(spark, ROWS).repartition(2)}, path, "1")
    assert {(int(r["id"]), r["text"]) for r in release.read_release(spark, path, "notes").collect()} == {(i, t or "") for i, t in ROWS}
    words = {tuple(r) for r in release.read_release(spark, path, "data_dictionary").select("column", "description", "type").collect()}
    assert words == {("id", "", "bigint"), ("text", "what it says", "string")}
    listed = {r["path"]: r for r in release.read_release(spark, path, "inventory").collect()}
    files = store.data_files(spark, f"{folder}/notes") + store.data_files(spark, f"{folder}/data_dictionary")
    assert len(listed) == len(files) and sum(int(r["rows"]) for p, r in listed.items() if p.startswith("notes/")) == 5
    for file in files:
        content = open(file.path.removeprefix("file:"), "rb").read()
        (row,) = [r for p, r in listed.items() if p.endswith(file.path.rpartition("/")[2])]
        assert content.startswith(b"\xef\xbb\xbf\"") and content.endswith(b"\r\n") and (int(row["bytes"]), row["sha256"]) == (len(content), hashlib.sha256(content).hexdigest())
        assert len(list(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")))) == int(row["rows"]) + 1


def test_readers_see_the_old_or_the_new_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    release.publish({"notes": table(spark, ROWS[:1])}, path, "1")
    monkeypatch.setattr(release, "inventory", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        release.publish({"notes": table(spark, ROWS)}, path, "2")
    assert release.read_release(spark, path, "notes").count() == 1 and release.current(spark, path)["version"] == "1"
    monkeypatch.undo()
    folder = release.publish({"notes": table(spark, ROWS)}, path, "2")
    assert release.read_release(spark, path, "notes").count() == 5
    with pytest.raises(ValueError, match="version 1 is out"):
        release.publish({"notes": table(spark, ROWS)}, path, "1")
    torn = next(f for f in store.data_files(spark, f"{folder}/notes"))
    with open(torn.path.removeprefix("file:"), "ab") as f:
        f.write(b"more")
    with pytest.raises(ValueError, match="aren't those"):
        release.read_release(spark, path, "notes")


def test_decisions(spark):
    """A shape stands; an unknown one takes the nearest hook, else the worker's state; lines of workers without a detection are added."""
    line = lambda x, y: [[x, y], [x + 5.0, y], [x + 10.0, y]]
    detections = spark.createDataFrame([("i", 1, line(1.0, 1.0), "good"), ("i", 2, line(2.0, 2.0), "unknown"), ("i", 3, line(30.0, 1.0), "unknown"), ("i", 4, line(90.0, 90.0), "unknown")], "image string, line_id int, line array<array<double>>, shape string")
    workers = spark.createDataFrame([("i", 0, [0.0, 0.0, 20.0, 20.0], "clipped"), ("i", 1, [25.0, 0.0, 40.0, 20.0], "clipped"), ("i", 2, [60.0, 60.0, 61.0, 61.0], "unknown")], "image string, worker int, box array<double>, label string")
    lines = spark.createDataFrame([("i", 0, 10, line(2.0, 4.0), "body", "unknown"), ("i", 0, 11, line(2.0, 9.0), "structure", "unknown"), ("i", 1, 12, line(100.0, 4.0), "body", "unknown"), ("i", 2, 13, line(60.0, 60.0), "not_visible", "unknown"), ("i", 2, 14, line(60.0, 60.0), "structure", "bad"), ("i", 9, 15, line(0.0, 0.0), "body", "bad")], "image string, worker int, number int, points array<array<double>>, hook string, shape string")
    found = {(r["origin"], r["line"]): (r["worker"], r["hook"], r["label"], r["source"]) for r in decisions.combine(detections, workers, lines).collect()}
    assert found == {
        ("detected", 1): (0, "body", "good", "shape"),
        ("detected", 2): (0, "body", "not_structure", "answer"),
        ("detected", 3): (1, None, "structure", "answer"),
        ("detected", 4): (None, None, "unknown", "none"),
        ("answered", 13): (2, "not_visible", "unknown", "none"),
        ("answered", 14): (2, "structure", "bad", "shape"),
    }
    texts = spark.createDataFrame([('x {"a": {"b": 1}} y',), ("none",), (None,), ("{\n}",)], "t string")
    assert [r[0] for r in texts.select(decisions.first_object(F.col("t"))).collect()] == ['{"a": {"b": 1}}', None, None, "{\n}"]
