"""Structured Streaming: windowed counts of events, sessions, and idempotent evidence intake.

These are an extension: the batch operators above are the reference semantics. Late rows are classified against the watermark by Spark; evidence is
never dropped for being late, as its intake carries no watermark but an anti-join with what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import oracle as O
from lattica.plans.evidence import intake, submissions
from lattica.session import shared_dir, table

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and type."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def run_once(spark, stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregating stream over what is there now into a table in the shared folder, and read that: each micro-batch writes the groups whole as they then stand, and the last one's are the result. Windows
    that no watermark has closed yet are among them."""
    import uuid

    out = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    last = {}

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{number}")
        last["at"] = f"{out}/{number}"

    stream.writeStream.foreachBatch(batch).outputMode("complete").option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(last["at"]) if last else spark.createDataFrame([], stream.schema)


def exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def accept(spark, stream: DataFrame, store: str) -> None:
    """Evidence intake: each micro-batch adds the payloads that the store doesn't have; replays of a batch add nothing. A store that is there but can't be read
    fails the stream. The store is kept in folders by the first two digits of the digest, of which a batch reads those it needs."""

    def batch(new: DataFrame, _: int) -> None:
        rows = submissions(new).persist()
        try:
            known = None
            if exists(spark, store + "/_SUCCESS"):
                folds = [r.fold for r in rows.select(F.substring("digest", 1, 2).alias("fold")).distinct().collect()]
                known = spark.read.parquet(store).filter(F.col("fold").isin(folds)).select(F.substring("evidence_id", 10, 64).alias("digest"))
            intake(rows, known).withColumn("fold", F.substring("evidence_id", 10, 2)).write.mode("append").partitionBy("fold").parquet(store)
        finally:
            rows.unpersist()

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", store + "-state").trigger(availableNow=True).start().awaitTermination()


def event_windows(spark, d):
    """The batch form of windowed()."""
    return windowed(table(spark, d, "events")).withColumn("start", F.col("start").cast("string"))


def stream_event_windows(spark, d):
    """The same through a stream."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        events = reader.parquet(f"{d}/events.parquet")
    else:  # a stream watches folders
        events = reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return run_once(spark, windowed(events), "windows").withColumn("start", F.col("start").cast("string"))


def event_sessions(spark, d):
    """Sessions of each user: runs of events no more than an hour apart."""
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {"event_windows": event_windows, "event_sessions": event_sessions, "stream_event_windows": stream_event_windows}
SQL = {
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": O.with_("g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new, ts, event_id FROM events)", "k AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)", "c AS (SELECT user_id, s, count(*) AS n FROM k GROUP BY ALL)")
    + "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
}
SQL["stream_event_windows"] = SQL["event_windows"]
