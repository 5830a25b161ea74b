"""Queries that run as streams over the tables' files, and the recovery of JSON."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.functions.salvage import predictions
from boxtrail.plans import bridge as b
from boxtrail.plans.catalog import query
from boxtrail.streaming import live


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="boxtrail-"))
    return f"{sc.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All rows that a stream gives for the files that are there now, written to the shared folder."""
    root = shared_folder(spark)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/log").option("path", f"{root}/out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def stream_of(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """A stream over a table written to the shared folder."""
    path = f"{shared_folder(spark)}/in"
    frame.write.parquet(path)
    return spark.readStream.schema(frame.schema).parquet(path)


@query("stream_dedup_watermark", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_watermark(spark, d):
    rows = b.table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return drained(spark, live.distinct_stream(stream_of(spark, rows), ["user_id", "event_type"], "ts", "60 days")).select("user_id", "event_type")


@query("json_salvage", "SELECT event_id, event_id AS track_id, 'a}b' AS label, 'unknown' AS fine_label, 0.5::DOUBLE AS confidence, 'red' AS color FROM events WHERE event_id % 5 <> 0")
def json_salvage(spark, d):
    n = F.col("event_id").cast("string")
    good = F.concat(F.lit('Sure: {"note": 1} {"answer": {"p": [{"id": '), n, F.lit(', "l": "a}b", "q": 0.5, "c": " Red"}, {"l": "no track"}]}} {broken'))
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('no prediction {"x": '), n, F.lit("} {"))).otherwise(good)
    rows = b.table(spark, d, "events").select("event_id", F.explode(predictions(text)).alias("r"))
    return rows.select("event_id", "r.track_id", "r.label", "r.fine_label", "r.confidence", "r.color")
