"""The event log as a stream: once-only intake, daily folders, and session logic; and the same logic for tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.scan import running
from ..sources import store

ZONE = "Asia/Seoul"
ACTIONS = ("view", "click", "search", "exposure", "link")
DAILY_CAP, MOST_EVENTS, QUIET_MS = 20_000, 60, 900


def local_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Batches from files below day folders, as they come; what doesn't parse is kept aside in _corrupt_record."""
    kept = [x for x in schema if x.name != "_corrupt_record"]
    return spark.readStream.schema(StructType([*kept, StructField("_corrupt_record", StringType())])).option("recursiveFileLookup", "true").json(path)


def read_pending(spark: SparkSession, path: str, schema: StructType, kind: str = "json") -> DataFrame:
    """What was set aside while the log couldn't be reached, as a stream to be united with the others before ``once_only``.

    A file is deleted only after the batch that holds it was committed to the log (the last one of a run in the next run), so that
    a run that fails delivers it again, and ``once_only`` lets it through once. Rows keep the day they were received on.
    """
    return spark.readStream.schema(schema).format(kind).option("recursiveFileLookup", "true").option("cleanSource", "delete").load(path)


def valid_batch() -> list[Column]:
    """Checks of a whole batch; one bad event rejects it."""
    return [
        F.col("_corrupt_record").isNull(),
        F.col("session").rlike("^[0-9A-Za-z-]{8,64}$"),
        F.col("seq") >= 0,
        F.size("events").between(1, MOST_EVENTS),
        F.forall("events", lambda e: e["action"].isin(*ACTIONS) & (e["t"] >= 0)),
    ]


def once_only(batches: DataFrame, delay: str | None = None) -> DataFrame:
    """The first copy of each (session, seq). Without a delay for ever, as the log has it; with one, state is dropped after it and later copies would pass."""
    if delay:
        return batches.withWatermark("received", delay).dropDuplicatesWithinWatermark(["session", "seq"])
    return batches.dropDuplicates(["session", "seq"])


def write_days(batches: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to folders by local receive day, exactly once, and stop when all input there is has been read."""
    days = batches.withColumn("day", local_day(F.col("received")))
    return days.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def close_days(spark: SparkSession, path: str, today: str) -> list[str]:
    """Makes the folders of days before ``today`` read-only, with all their files, and returns those closed now.

    A change of permissions, made by the driver for each file of a day once; the folder comes last, so that a call cut short is
    taken up by the next. Pending rows must be delivered first. Names without a day and days closed before are left alone.
    """
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mode = lambda status: status.getPermission().toShort()
    closed = []
    for folder in sorted(fs.listStatus(root), key=lambda x: x.getPath().getName()):
        day = re.fullmatch(r"day=(\d{4}-\d\d-\d\d)", folder.getPath().getName())
        if not (folder.isDirectory() and day and day[1] < today and mode(folder) & 0o222):
            continue
        files = fs.listFiles(folder.getPath(), True)
        while files.hasNext():
            one = files.next()
            fs.setPermission(one.getPath(), jvm.permission.FsPermission(format(mode(one) & 0o555, "o")))
        fs.setPermission(folder.getPath(), jvm.permission.FsPermission(format(mode(folder) & 0o555, "o")))
        closed.append(day[1])
    return closed


def windowed_counts(events: DataFrame, ts: str, by: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by event-time window; rows later than ``late`` are no longer waited for. (The log itself has no such operator.)"""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def admitted(events: DataFrame, ts: str, order: Sequence[str], cap: int = DAILY_CAP) -> DataFrame:
    """The first ``cap`` rows of each day by time; a day may have any number of rows."""
    timed = events.withColumn("_day", F.to_date(ts))
    return running(timed, ["_day"], [ts, *order], sums={"_count": F.lit(1)}).filter(F.col("_count") <= cap).drop("_day", "_count")


def admit_stream(events: DataFrame, path: str, checkpoint: str, ts: str, order: Sequence[str], cap: int = DAILY_CAP, by: Sequence[str] = ()) -> StreamingQuery:
    """The first ``cap`` events of each local day (and each value of ``by``) to arrive, while they arrive, until all there is has been read.

    A micro-batch ranks its own events and adds what the batches before it admitted. Both the events and the counts of a batch are
    written to folders of its number, so that a batch that is run again after a failure replaces its own part and counts
    nothing twice; a restart goes on from the counts. A new day has no counts. One day is many tasks (:func:`~lodestone.operators.scan.running`), no state
    is held in memory. Events of one micro-batch come in the order of ``ts`` and ``order``. :func:`read_admitted` reads the result.
    """
    group = ["_day", *by]

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        numbered = running(batch.withColumn("_day", local_day(F.col(ts))), group, [ts, *order], sums={"_count": F.lit(1)})
        if store.exists(spark, f"{path}/counts"):
            counts = spark.read.parquet(f"{path}/counts").filter(F.col("batch") < number)
            earlier = counts.groupBy(*group).agg(F.sum("n").alias("_earlier"))
            same = [numbered[c].eqNullSafe(earlier[c]) for c in group]
            numbered = numbered.join(earlier, same, "left").select(*[numbered[c] for c in numbered.columns], "_earlier")
        else:
            numbered = numbered.withColumn("_earlier", F.lit(0))
        rows = f"{path}/rows/batch={number}"
        numbered.filter(F.col("_count") + F.coalesce("_earlier", F.lit(0)) <= cap).drop("_count", "_earlier").write.mode("overwrite").parquet(rows)
        spark.read.parquet(rows).groupBy(*group).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_admitted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("batch", "_day")


#: A day or name that is null, as Spark's own writers call it.
NULL = "__HIVE_DEFAULT_PARTITION__"


def _file_name(value: str | None) -> str:
    return NULL if value is None else quote(value, safe="")


def _value(name: str) -> str | None:
    return None if name == NULL else unquote(name)


def _file_path(root: str, day: str | None, name: str | None) -> str:
    return f"{root}/day={_file_name(day)}/name={_file_name(name)}/{_file_name(name)}.txt"


def put_new_files(batch: DataFrame, number: int, path: str, ledger: str, order: Sequence[str]) -> bool:
    """Files that aren't there yet: one for each (day, name), ``day=.../name=<name>/<name>.txt``, with the text of ``content``; the first in ``order`` of a name. False if the batch was done.

    A file that is there is never touched. Tasks look for their own names, write aside and rename, so a file is there whole or not at
    all; a batch that failed half-way is run again and adds what is missing; one whose number is in the stream's ledger is skipped. One
    stream writes to a path at a time. Nothing is listed, and the driver renames nothing: the cost is that of the batch's own files.
    The store must be one that pyarrow knows (local or mounted, HDFS, S3, GCS, ABFS).
    """
    spark = batch.sparkSession
    done = f"{ledger}/{number:010}"
    if store.exists(spark, done):
        return False
    at = store.qualified(spark, path)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(at)
        made: set[str] = set()
        for some in batches:
            paths = [_file_path(root, day, name) for day, name in zip(some.column("day").to_pylist(), some.column("name").to_pylist(), strict=True)]
            new = [info.type == FileType.NotFound for info in fs.get_file_info(paths)]
            for target, content, absent in zip(paths, some.column("content").to_pylist(), new, strict=True):
                if not absent:
                    continue
                folder = target.rpartition("/")[0]
                for above in {folder.rpartition("/")[0], f"{root}/_aside"} - made:
                    fs.create_dir(above, recursive=True)
                    made.add(above)
                fs.create_dir(folder, recursive=False)
                aside = f"{root}/_aside/{uuid.uuid4().hex}"
                with fs.open_output_stream(aside) as out:
                    out.write((content or "").encode())
                fs.move(aside, target)
            yield pa.RecordBatch.from_arrays([pa.array([sum(new)], pa.int64())], ["made"])

    first = batch.groupBy("day", "name").agg(F.min_by("content", F.struct(*order)).alias("content"))
    # a small row costs as much as its file: rows are dealt to a given number of tasks; by a key of its own, as Spark would take the aggregate's few otherwise
    dealt = first.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("name", "day"))
    dealt.mapInArrow(put, "made long").agg(F.sum("made")).collect()
    store.put_new(spark, done, "")
    return True


def read_new_files(spark: SparkSession, path: str) -> DataFrame:
    """day, name and content of all files of :func:`put_new_files`; the names of a day are listed by a task, and dealt out to be read."""
    at = store.qualified(spark, path)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(at)
        for some in batches:
            for day in some.column("day").to_pylist():
                names = [info.base_name for info in fs.get_file_info(FileSelector(f"{root}/{day}", allow_not_found=True)) if info.base_name.startswith("name=")]
                for k in range(0, len(names), 10_000):
                    part = names[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([day] * len(part), pa.string()), pa.array(part, pa.string())], ["day", "name"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(at)
        for some in batches:
            days, names = ([x.partition("=")[2] for x in some.column(c).to_pylist()] for c in ("day", "name"))
            for k in range(0, len(names), 1000):
                found = []
                for day, name in zip(days[k : k + 1000], names[k : k + 1000], strict=True):
                    try:
                        with fs.open_input_stream(f"{root}/day={day}/name={name}/{name}.txt") as held:
                            found.append((_value(day), _value(name), held.read().decode()))
                    except FileNotFoundError:  # a batch that failed may leave a folder without a file
                        pass
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.string()) for c in range(3)], ["day", "name", "content"])

    days = spark.createDataFrame([(d,) for d in store.folders(spark, path) if d.startswith("day=")], "day string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = days.repartition(tasks, "day").mapInArrow(listed, "day string, name string")
    return names.repartition(tasks, F.xxhash64("name", "day")).mapInArrow(read, "day string, name string, content string")


def write_new_files(batches: DataFrame, path: str, checkpoint: str, order: Sequence[str]) -> StreamingQuery:
    """A stream (day, name, content and what orders them) into files that are only ever added, until all there is has been read."""
    return batches.writeStream.foreachBatch(lambda df, number: put_new_files(df, number, path, f"{checkpoint}/ledger", order) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(events: DataFrame, by: str, order: Sequence[str], key: Column) -> DataFrame:
    """Rows whose key differs from that of the row before (the first row too)."""
    found = running(events.withColumn("_key", key), [by], order, lasts={"_before": F.struct("_key")}, before=True)
    return found.filter(F.col("_before").isNull() | ~F.col("_key").eqNullSafe(F.col("_before._key"))).drop("_key", "_before")


def debounced(events: DataFrame, by: str, time: Column, order: Sequence[str], quiet: float) -> DataFrame:
    """Rows that no other row of the group follows within ``quiet``."""
    found = running(events.withColumn("_t", time), [by], order, nexts={"_next": F.col("_t")})
    return found.filter(F.col("_next").isNull() | (F.col("_next") - F.col("_t") >= quiet)).drop("_t", "_next")


def reassembled(chunks: DataFrame, by: str, seq: str, size: Column) -> DataFrame:
    """by, chunks, bytes, complete: copies of a chunk count once, a missing one makes the upload incomplete."""
    once = chunks.groupBy(by, seq).agg(F.first(size).alias("_size"))
    return once.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.sum("_size").alias("bytes"), ((F.min(seq) == 0) & (F.max(seq) == F.count(F.lit(1)) - 1)).alias("complete"))


def after_cursor(events: DataFrame, key: str, cursor: int, most: int = 20) -> DataFrame:
    """The next rows of an append-only list."""
    return events.filter(F.col(key) > cursor).orderBy(key).limit(most)
