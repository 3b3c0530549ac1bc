"""The event log as a stream, and files in and out."""

import datetime
import json
import time

from pyspark.sql import functions as F

from lodestone.schemas import CASES, EVENT_BATCHES
from lodestone.sources import files
from lodestone.streaming import events as E


def batch(session, seq, received="2026-01-01T20:00:00", **over):
    return {"version": 1, "session": session, "seq": seq, "received": received, "conditions": {}, "events": [{"t": 5, "action": "view", "item": "p1"}]} | over


def drop_in(folder, name, *batches):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in batches) + "\n")


def test_intake_is_once_only_over_restarts(spark, tmp_path):
    """Copies of a batch, in the same file, another file or after a restart, are stored once; bad batches are kept aside; folders go by local day."""
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        good = E.read_batches(spark, str(source), EVENT_BATCHES)
        for check in E.valid_batch():
            good = good.filter(F.coalesce(check, F.lit(False)))
        E.write_days(E.once_only(good.drop("_corrupt_record")), out, state).awaitTermination()
        return sorted((r["session"], r["seq"], str(r["day"])) for r in spark.read.parquet(out).collect())

    drop_in(source / "d1", "a.json", batch("session-1", 0), batch("session-1", 0), batch("session-1", 1, "2026-01-01T10:00:00"), "not json", batch("x", 0), batch("session-2", -1), batch("session-3", 0, events=[{"t": 1, "action": "nonsense"}]))
    first = [("session-1", 0, "2026-01-02"), ("session-1", 1, "2026-01-01")]
    assert run() == first
    drop_in(source / "d2", "b.json", batch("session-1", 0), batch("session-9", 0))
    assert run() == sorted([*first, ("session-9", 0, "2026-01-02")])
    assert run() == sorted([*first, ("session-9", 0, "2026-01-02")])


def test_pending_batches_come_once_and_are_removed(spark, tmp_path):
    """What waited is stored once, on the day it was received, also where it had come through; its files go after they are committed."""
    source, pending, out, state = tmp_path / "in", tmp_path / "pending", str(tmp_path / "out"), str(tmp_path / "state")
    pending.mkdir()

    def run():
        both = E.read_batches(spark, str(source), EVENT_BATCHES).drop("_corrupt_record").unionByName(E.read_pending(spark, str(pending), EVENT_BATCHES))
        E.write_days(E.once_only(both), out, state).awaitTermination()
        return sorted((r["session"], r["seq"], str(r["day"])) for r in spark.read.parquet(out).collect())

    drop_in(source / "d1", "a.json", batch("session-1", 0))
    first = [("session-1", 0, "2026-01-02")]
    assert run() == first
    drop_in(pending / "late", "b.json", batch("session-1", 0), batch("session-1", 1, "2025-12-30T10:00:00"))
    drop_in(source / "d2", "c.json", batch("session-2", 0))
    second = sorted([*first, ("session-1", 1, "2025-12-30"), ("session-2", 0, "2026-01-02")])
    assert run() == second
    drop_in(source / "d3", "d.json", batch("session-2", 0))
    assert run() == second
    deadline = time.monotonic() + 20
    while list(pending.rglob("*.json")) and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not list(pending.rglob("*.json")) and len(list(source.rglob("*.json"))) == 3


def test_days_before_today_are_closed(spark, tmp_path):
    for name in ("day=2026-01-01", "day=2026-01-02", "day=2026-01-03", "other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.parquet").write_text("x")
    writable = lambda: sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.stat().st_mode & 0o222)
    assert E.close_days(spark, str(tmp_path), "2026-01-03") == ["2026-01-01", "2026-01-02"]
    assert writable() == ["day=2026-01-03", "day=2026-01-03/part.parquet", "other", "other/part.parquet"]
    assert E.close_days(spark, str(tmp_path), "2026-01-03") == []
    assert E.close_days(spark, str(tmp_path), "2026-01-04") == ["2026-01-03"]


def test_windows_in_a_stream(spark, tmp_path):
    """The operator that counts tables by window does so in a stream, rows that are later than the watermark left out."""
    schema = "ts timestamp, kind string"
    hour = lambda h, m=0: datetime.datetime(2026, 1, 1, h, m).isoformat()
    drop_in(tmp_path / "in", "a.json", {"ts": hour(1), "kind": "v"}, {"ts": hour(1, 30), "kind": "v"}, {"ts": hour(9), "kind": "v"})
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    counts = E.windowed_counts(stream, "ts", "kind", late="2 hours")
    go = lambda: counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    go()
    drop_in(tmp_path / "in", "b.json", {"ts": hour(2), "kind": "v"}, {"ts": hour(20), "kind": "v"})
    go()
    found = {(r["start"].hour, r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(1, 2), (9, 1)}


def test_csv(spark, tmp_path):
    text = '﻿accnum,summary\r\nA,"x, ""y""\nz"\r\nB,\r\n,\r\n'
    (tmp_path / "cases.csv").write_text(text, newline="")
    from pyspark.sql.types import StructType

    schema = StructType([f for f in CASES if f.name in ("accnum", "summary")])
    rows = files.read_csv(spark, str(tmp_path / "cases.csv"), schema).collect()
    assert {(r["accnum"], r["summary"]) for r in rows} == {("A", 'x, "y"\nz'), ("B", "")}
    files.write_csv(spark.createDataFrame([("a", None), ('q"', "n")], "x string, y string").coalesce(1), str(tmp_path / "out"), ["y", "x", "z"])
    written = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert written == b'y,x,z\r\n,a,\r\nn,"q""",\r\n'
    line = spark.range(1).select(files.csv_line(F.lit('a,"b"'), F.lit(None).cast("string"), F.lit(3)).alias("l")).first()["l"]
    assert line == '"a,""b""","","3"'


def test_json_and_inventory(spark, tmp_path):
    store = {"nodes": {"1": {"key": "k1", "law": "L", "kind": "조문", "article": "1", "text": "t"}, "2": {"key": "k1", "law": "L", "kind": None, "article": "2", "text": "u"}, "3": {"key": "k3", "law": "L", "kind": "별표", "article": "3", "text": "v"}}}
    (tmp_path / "store.json").write_text(json.dumps(store, indent=1))
    document = files.read_json_document(spark, str(tmp_path / "store.json"), "nodes map<string, struct<key string, law string, kind string, article string, text string>>")
    assert [(r["key"], r["article"]) for r in files.docstore_articles(document).collect()] == [("k1", "1")]
    (tmp_path / "lines.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_json_lines(spark, str(tmp_path / "lines.jsonl"), "a int").collect()) == [1, 2]
    import hashlib

    (tmp_path / "files" / "sub").mkdir(parents=True)
    (tmp_path / "files" / "sub" / "x.bin").write_bytes(b"abc")
    assert [tuple(r) for r in files.inventory(spark, str(tmp_path / "files")).collect()] == [("x.bin", 3, hashlib.sha256(b"abc").hexdigest())]


def test_session_logic(spark):
    rows = [(1, t, k, e) for t, k, e in [(0, "a", 0), (100, "a", 1), (1200, "b", 2), (1300, "b", 3), (2300, "a", 4)]]
    df = spark.createDataFrame(rows, "user int, t long, kind string, id int")
    assert sorted(r["id"] for r in E.changes(df, "user", ["t"], F.col("kind")).collect()) == [0, 2, 4]
    assert sorted(r["id"] for r in E.debounced(df, "user", F.col("t"), ["t"], 900).collect()) == [1, 3, 4]
    chunks = spark.createDataFrame([("u", 0, "ab"), ("u", 1, "c"), ("u", 1, "c"), ("v", 0, "a"), ("v", 2, "b")], "upload string, seq int, body string")
    assert {tuple(r) for r in E.reassembled(chunks, "upload", "seq", F.length("body")).collect()} == {("u", 2, 3, True), ("v", 2, 2, False)}


def test_new_files_are_put_by_many_tasks_and_never_touched(spark, tmp_path):
    """Names of any characters, none and null; a batch that is run again, or comes by another ledger, changes nothing. The driver's writers are not used: no job of theirs commits."""
    names = [f"{i}-{i % 3}" for i in range(200)] + ["a/b", "..", ".x", "_y", "가 %2F", "", None]
    rows = [(day, n, f"{day} {n}\nend", i) for i, n in enumerate(names) for day in ("202401", "2024/02")]
    batch = spark.createDataFrame(rows + [(d, n, "later", i + 1000) for d, n, _, i in rows], "day string, name string, content string, at long")
    path = str(tmp_path / "files")
    assert E.read_new_files(spark, path).count() == 0
    assert E.put_new_files(batch, 0, path, str(tmp_path / "first"), ["at"])
    held = lambda: sorted(map(tuple, E.read_new_files(spark, path).collect()), key=str)
    assert held() == sorted([(d, n, c) for d, n, c, _ in rows], key=str)
    assert not E.put_new_files(batch, 0, path, str(tmp_path / "first"), ["at"])
    left = next((tmp_path / "files").glob("day=202401/*/7-1.txt"))  # as a batch that failed half-way leaves it
    left.unlink()
    again = batch.withColumn("content", F.concat(F.lit("again "), "content")).withColumn("at", F.col("at") + 1)
    assert E.put_new_files(again, 0, path, str(tmp_path / "second"), ["at"])
    assert left.read_text() == "again 202401 7-1\nend"
    assert [x for x in held() if x[1] != "7-1"] == sorted([(d, n, c) for d, n, c, _ in rows if n != "7-1"], key=str)
    assert not list((tmp_path / "files").rglob("part-*")) and not list((tmp_path / "files" / "_aside").iterdir())
