"""Views that present the driver's tables as tracks, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CANVAS = (200.0, 120.0)
FPS = 25.0
KEY = ["sequence", "track_id"]

OBS = """obs AS (
  SELECT 's' || (user_id % 4) AS sequence, user_id + 1 AS track_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 + 1 AS frame, event_type AS class, value / 500 AS conf,
    ((event_id * 37) % 160)::DOUBLE AS x, ((event_id * 53) % 90)::DOUBLE AS y, (20 + (event_id * 7) % 40)::DOUBLE AS w, (20 + (event_id * 11) % 30)::DOUBLE AS h, event_id
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id, frame ORDER BY event_id) = 1)"""
PRED = """pred AS (
  SELECT sequence, track_id * 10 + frame // 200 AS track_id, frame, class, conf, x + (event_id % 5 - 2) AS x, y, w, h, event_id FROM obs WHERE event_id % 7 <> 0)"""
SEGMENTS = """blocks AS (SELECT sequence, track_id, (frame // 200)::BIGINT AS segment, min(frame) AS start_frame, max(frame) AS last FROM obs GROUP BY sequence, track_id, frame // 200),
segments AS (
  SELECT sequence, track_id, segment, start_frame, CASE WHEN segment = max(segment) OVER (PARTITION BY sequence, track_id) THEN NULL ELSE last END AS end_frame,
    CASE WHEN (track_id + segment) % 5 = 0 THEN 'rejected' WHEN (track_id + segment) % 3 = 0 THEN 'probation' ELSE 'confirmed' END AS status FROM blocks)"""
EVIDENCE = """evidence AS (
  SELECT sequence, track_id, frame, class AS label, conf, CASE WHEN event_id % 3 = 0 THEN 'locateanything' ELSE 'qwen' END AS source, event_id FROM obs)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box for each user and hour; the lowest event of the hour is kept."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    hour = F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000
    rows = e.select(
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("sequence"),
        (F.col("user_id") + 1).alias("track_id"),
        (F.floor(hour / 3600000000) + 1).alias("frame"),
        F.col("event_type").alias("class"),
        (F.col("value") / 500).alias("conf"),
        ((n * 37) % 160).cast("double").alias("x"),
        ((n * 53) % 90).cast("double").alias("y"),
        (20 + (n * 7) % 40).cast("double").alias("w"),
        (20 + (n * 11) % 30).cast("double").alias("h"),
        "event_id",
    )
    names = [c for c in rows.columns if c not in ("sequence", "track_id", "frame")]
    first = F.min_by(F.struct(*names), "event_id").alias("r")  # a partial aggregation, where a window would sort all rows
    return rows.groupBy("sequence", "track_id", "frame").agg(first).select("sequence", "track_id", "frame", "r.*")


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs with some boxes lost, the others moved, and a new identity every 200 frames."""
    o = obs(spark, sf_dir).where(F.col("event_id") % 7 != 0)
    return o.withColumns({"track_id": F.col("track_id") * 10 + F.floor(F.col("frame") / 200), "x": F.col("x") + (F.col("event_id") % 5 - 2)})


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment for each track and 200 frames; a track's last has no end."""
    block = F.floor(F.col("frame") / 200)
    s = obs(spark, sf_dir).groupBy(*KEY, block.alias("segment")).agg(F.min("frame").alias("start_frame"), F.max("frame").alias("last"))
    end = F.when(F.col("segment") != F.max("segment").over(W.partitionBy(*KEY)), F.col("last"))
    kind = F.col("track_id") + F.col("segment")
    status = F.when(kind % 5 == 0, "rejected").when(kind % 3 == 0, "probation").otherwise("confirmed")
    return s.select(*KEY, "segment", "start_frame", end.alias("end_frame"), status.alias("status"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs as votes for labels by two sources."""
    source = F.when(F.col("event_id") % 3 == 0, "locateanything").otherwise("qwen")
    return obs(spark, sf_dir).select("sequence", "track_id", "frame", F.col("class").alias("label"), "conf", source.alias("source"), "event_id")
