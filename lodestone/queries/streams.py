"""The event log: once-only intake, admission, sessions, ledgers; as a stream and as tables."""

from pyspark.sql import functions as F

from ..operators import aggregates, ranking
from ..schemas import table
from ..sources.files import shared_folder
from ..streaming import events as E
from .registry import query


@query("""SELECT user_id, seq, event_id, event_type FROM (SELECT user_id, event_id % 20 AS seq, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_id % 20 ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def l3_dedup_first_wins(spark, d):
    events = table(spark, d, "events").select("user_id", (F.col("event_id") % 20).alias("seq"), "ts", "event_id", "event_type")
    return ranking.first_wins(events, ["user_id", "seq"], ["ts", "event_id"]).select("user_id", "seq", "event_id", "event_type")


@query("""SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, ts, event_type FROM events) GROUP BY ALL""")
def l4_stream_intake(spark, d):
    """Events read as a stream, each key once, written to folders by local day and read back."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(d)
    batches = stream.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("ts").alias("received"), "event_type")
    out = shared_folder(spark, "stream")
    E.write_days(E.once_only(batches), f"{out}/days", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/days").groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def _intake(spark, d, delivered, pending):
    """A folder of days: events that meet ``delivered`` from the table, then those of ``pending`` from a folder where they waited."""
    events = table(spark, d, "events")
    waiting, out = shared_folder(spark, "pending"), shared_folder(spark, "stream")
    events.filter(pending).write.parquet(waiting)
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(d)
    both = stream.filter(delivered).unionByName(E.read_pending(spark, waiting, events.schema, "parquet"))
    batches = both.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("ts").alias("received"), "event_type")
    E.write_days(E.once_only(batches), f"{out}/days", f"{out}/checkpoint").awaitTermination()
    return f"{out}/days"


@query("""SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, ts, event_type FROM events) GROUP BY ALL""")
def l6_pending_delivery(spark, d):
    """A fifth of the events waited in a folder, and half of those had come through as well: all are there once, on their own day."""
    days = _intake(spark, d, "event_id % 5 <> 0 OR event_id % 10 = 0", "event_id % 5 = 0")
    return spark.read.parquet(days).groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT DISTINCT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day FROM events)
          SELECT day, count(*) AS n, day < (SELECT max(day) FROM e) AS closed FROM e GROUP BY day""")
def l7_day_finalisation(spark, d):
    """Rows of each day of the log, and whether its folder was closed; the last day counts as today."""
    days = _intake(spark, d, "true", "false")
    counts = spark.read.parquet(days).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    closed = E.close_days(spark, days, counts.agg(F.max("day")).first()[0] or "")
    return counts.withColumn("closed", F.col("day").isin(closed) if closed else F.lit(False))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def l_windowed_counts(spark, d):
    """Event-time windows, which the log itself doesn't have: the same operator works on a stream with a watermark."""
    return E.windowed_counts(table(spark, d, "events"), "ts", "event_type")


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events) WHERE n <= 100""")
def l5_daily_admission(spark, d):
    return E.admitted(table(spark, d, "events"), "ts", ["event_id"], 100).select("event_id")


def _admitted(spark, d, cap, by=()):
    """Event ids that a stream lets in, over two runs of which the second begins where the first was stopped."""
    waiting, out = shared_folder(spark, "arriving"), shared_folder(spark, "stream")
    events = table(spark, d, "events").select("event_id", "ts", "user_id")
    for part in (F.col("ts") < "2024-01-12 20:00:00", F.col("ts") >= "2024-01-12 20:00:00"):
        events.filter(part).coalesce(2).write.mode("append").parquet(waiting)
        E.admit_stream(spark.readStream.schema(events.schema).parquet(waiting), f"{out}/days", f"{out}/checkpoint", "ts", ["event_id"], cap, by).awaitTermination()
    return E.read_admitted(spark, f"{out}/days").select("event_id")


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY CAST(ts + INTERVAL 9 HOUR AS DATE) ORDER BY ts, event_id) AS n FROM events) WHERE n <= 100""")
def l5_stream_admission(spark, d):
    """A hundred events of each local day, counted while they arrive and over a restart in the middle of a day."""
    return _admitted(spark, d, 100)


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts + INTERVAL 9 HOUR AS DATE) ORDER BY ts, event_id) AS n FROM events) WHERE n <= 2""")
def l9_stream_quota(spark, d):
    """Two events of each client and local day."""
    return _admitted(spark, d, 2, ["user_id"])


@query("""WITH e AS (SELECT strftime(ts + INTERVAL 9 HOUR, '%Y%m') AS day, user_id || '-' || event_id % 3 AS name, ts, event_id, event_type FROM events),
          f AS (SELECT day, name, arg_min(event_type || ' ' || event_id, struct_pack(ts, event_id)) AS content FROM e GROUP BY day, name)
          SELECT day, name, content, 1::BIGINT AS files FROM f""")
def s24_create_if_absent(spark, d):
    """A file for each session and number, made by the first event; all events are delivered twice, by two streams with ledgers of their own."""
    out = shared_folder(spark, "files")
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(d)
    named = stream.select(F.date_format(F.from_utc_timestamp("ts", E.ZONE), "yyyyMM").alias("day"), F.concat_ws("-", "user_id", F.col("event_id") % 3).alias("name"), F.concat_ws(" ", "event_type", "event_id").alias("content"), "ts", "event_id")
    E.write_new_files(named, f"{out}/files", f"{out}/first", ["ts", "event_id"]).awaitTermination()
    later = named.withColumn("content", F.concat(F.lit("again "), "content"))
    E.write_new_files(later, f"{out}/files", f"{out}/second", ["ts", "event_id"]).awaitTermination()
    return E.read_new_files(spark, f"{out}/files").groupBy("day", "name").agg(F.first("content").alias("content"), F.count(F.lit(1)).alias("files"))


@query("""SELECT day, user_id, n FROM (SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 4""")
def l9_daily_quota(spark, d):
    """Clients over their quota of a local day."""
    daily = table(spark, d, "events").groupBy(E.local_day(F.col("ts")).cast("string").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return daily.filter("n > 4")


@query("""SELECT conv_id, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes, min(turn) = 0 AND max(turn) = count(*) - 1 AS complete FROM (SELECT conv_id, turn, min(length(text)) AS size FROM conversations WHERE turn % 3 <> 2 OR conv_id % 2 = 0 GROUP BY 1, 2) GROUP BY conv_id""")
def l11_reassembly_gap_check(spark, d):
    chunks = table(spark, d, "conversations").filter("turn % 3 <> 2 OR conv_id % 2 = 0")
    return E.reassembled(chunks, "conv_id", "turn", F.length("text"))


@query("""WITH e AS (SELECT o_orderkey AS id, CAST(o_custkey % 900 + 100 AS BIGINT) AS reserved, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_custkey % 700 + 200 AS BIGINT) END AS paid FROM orders)
          SELECT id, reserved, coalesce(paid, reserved) AS amount, coalesce(paid > reserved, false) AS over FROM e""")
def l12_reserve_settle(spark, d):
    """The first settlement of a charge counts, however often it is sent."""
    orders = table(spark, d, "orders")
    event = lambda df, kind, amount, ord_: df.select(F.col("o_orderkey").alias("id"), F.lit(kind).alias("kind"), amount.cast("bigint").alias("amount"), F.lit(ord_).alias("ord"))
    done = orders.filter("o_orderstatus <> 'O'")
    log = event(orders, "reserve", F.col("o_custkey") % 900 + 100, 0).unionAll(event(done, "settle", F.col("o_custkey") % 700 + 200, 1)).unionAll(event(done, "settle", F.lit(1), 2))
    return aggregates.settled(log)


@query("""SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def l13_change_detection(spark, d):
    return E.changes(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type")).select("event_id")


@query("""SELECT event_id FROM (SELECT event_id, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NULL OR next - t >= 3600000000""")
def l14_debounce(spark, d):
    return E.debounced(table(spark, d, "events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"], 3_600_000_000).select("event_id")


@query("SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 20")
def l15_cursor_read(spark, d):
    return E.after_cursor(table(spark, d, "events"), "event_id", 500).select("event_id", "event_type")


@query("""SELECT user_id AS session, string_agg(event_type, ',' ORDER BY ts, event_id) AS actions FROM events GROUP BY user_id""")
def l8_session_order(spark, d):
    """A session's events in order."""
    events = table(spark, d, "events")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return events.groupBy(F.col("user_id").alias("session")).agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), ",").alias("actions"))
