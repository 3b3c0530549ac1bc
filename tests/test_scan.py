"""Running values over ranges of groups, against windows; streams that admit and that only add files."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import joins, ranking
from lodestone.operators.scan import running
from lodestone.streaming import events as E


def table(spark, groups, n=3000, parts=7):
    rng = random.Random(3)
    rows = [(rng.choice(groups), i, rng.randrange(50), rng.choice([None, "a", "b"])) for i in range(n)]
    return spark.createDataFrame(rows, "g string, i long, v long, s string").repartition(parts)


@pytest.mark.parametrize("groups", [["hot"] * 9 + ["x", None], ["only"], [f"g{i}" for i in range(900)]], ids=["hot", "one", "many"])
@pytest.mark.parametrize("before", [False, True])
def test_running_equals_windows(spark, groups, before):
    df = table(spark, groups)
    found = running(df, ["g"], ["i"], {"total": F.col("v"), "n": F.lit(1)}, {"low": F.col("s")}, {"high": F.col("s")}, before)
    w = Window.partitionBy("g").orderBy("i")
    up = w.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    plain = df.select("*", F.coalesce(F.sum("v").over(up), F.lit(0)).alias("total"), F.count(F.lit(1)).over(up).alias("n"), F.last("s", True).over(up).alias("low"), F.first("s", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("high"))
    assert found.columns == plain.columns and sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_a_hot_group_is_many_tasks(spark):
    small = "spark.sql.adaptive.coalescePartitions.enabled"  # else ranges as small as these are put together
    spark.conf.set(small, "false")
    try:
        found = running(table(spark, ["hot"], 20_000), ["g"], ["i"], {"n": F.lit(1)}).withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in found.groupBy("task").count().collect()]
    finally:
        spark.conf.unset(small)
    assert len(sizes) >= 3 and max(sizes) < 0.6 * sum(sizes)
    assert running(table(spark, ["x"]).filter("false"), ["g"], ["i"], {"n": F.lit(1)}).count() == 0


def test_users_of_running(spark):
    df = table(spark, ["hot"] * 5 + ["x"])
    w = Window.partitionBy("g").orderBy("i")
    budget = df.withColumn("total", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("total <= 9000")
    assert sorted(map(str, ranking.within_budget(df, ["g"], ["i"], "v", 9000).collect())) == sorted(map(str, budget.collect()))
    changed = {r["i"] for r in df.withColumn("p", F.lag("s").over(w)).withColumn("k", F.row_number().over(w)).filter("k = 1 OR NOT s <=> p").collect()}
    assert {r["i"] for r in E.changes(df, "g", ["i"], F.col("s")).collect()} == changed
    rng = random.Random(4)
    a = [("g", i, rng.uniform(0, 9)) for i in range(300)] + [("none", 900, 1.0)]
    b = [("g", i, float(rng.randrange(9))) for i in range(12)]
    near = joins.nearest_value(spark.createDataFrame(a, "g string, p long, v double"), spark.createDataFrame(b, "g string, q long, u double"), "g", "p", "v", "q", "u").collect()
    best = {p: min((abs(v - u), q) for _, q, u in b) for g, p, v in a if g == "g"}
    assert {r["p"]: (r["distance"], r["q"]) for r in near} == {p: (d, q) for p, (d, q) in best.items()} | {900: (None, None)}


def arrive(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"id": i, "ts": ts, "who": who}) for i, ts, who in rows))


def test_admission_survives_a_restart_and_a_failed_batch(spark, tmp_path, monkeypatch):
    """Three a day: a batch that fails between its rows and its counts is run again, a new day begins at none, a restart goes on."""
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run(cap=3, by=()):
        stream = spark.readStream.schema("id long, ts timestamp, who string").option("maxFilesPerTrigger", 1).json(str(source))
        E.admit_stream(stream, out, state, "ts", ["id"], cap, by).awaitTermination()
        return sorted(r["id"] for r in E.read_admitted(spark, out).collect())

    arrive(source, "a.json", [(1, "2026-01-01T01:00:00", "x"), (2, "2026-01-01T02:00:00", "x")])
    assert run() == [1, 2]
    arrive(source, "b.json", [(4, "2026-01-01T14:59:59", "x"), (3, "2026-01-01T03:00:00", "y"), (5, "2026-01-01T15:00:00", "x")])
    read = type(spark.read).parquet

    def breaks(self, *paths, **kw):
        if any("/rows/batch=1" in p for p in paths):
            raise OSError("the driver was lost")
        return read(self, *paths, **kw)

    monkeypatch.setattr(type(spark.read), "parquet", breaks)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(type(spark.read), "parquet", read)
    assert run() == [1, 2, 3, 5]
    arrive(source, "c.json", [(6, "2026-01-01T16:00:00", "x"), (7, "2026-01-01T17:00:00", "x"), (8, "2026-01-01T18:00:00", "x"), (9, "2026-01-01T04:00:00", "x")])
    assert run() == [1, 2, 3, 5, 6, 7]
    assert run() == [1, 2, 3, 5, 6, 7]


def test_files_are_only_added(spark, tmp_path):
    """The same batch twice, and a failure between the files and the ledger, leave one copy of each file, the first."""
    path, ledger = str(tmp_path / "files"), str(tmp_path / "ledger")
    batch = lambda rows: spark.createDataFrame(rows, "day string, name string, content string, n int")
    held = lambda: sorted((r["day"], r["name"], r["value"]) for r in spark.read.schema("value string, day string, name string").text(path).collect())
    first = batch([("20260101", "s-1", "b", 2), ("20260101", "s-1", "a", 1), ("20260101", "s/2=x", "c", 1)])
    assert E.put_new_files(first, 0, path, ledger, ["n"])
    want = [("20260101", "s-1", "a"), ("20260101", "s/2=x", "c")]
    assert held() == want and not E.put_new_files(first, 0, path, ledger, ["n"]) and held() == want
    (tmp_path / "ledger" / f"{0:010}").unlink()  # as if it failed before the ledger
    files = sorted((tmp_path / "files").rglob("part-*.txt"))
    stamps = [f.stat().st_mtime_ns for f in files]
    assert E.put_new_files(batch([("20260101", "s-1", "other", 0), ("20260102", "s-1", "d", 0)]), 0, path, ledger, ["n"])
    assert held() == [want[0], want[1], ("20260102", "s-1", "d")] and [f.stat().st_mtime_ns for f in files] == stamps
