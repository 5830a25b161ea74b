"""Queries that write tables in a file format, read them again and show the rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.plans import bridge as b
from boxtrail.plans.catalog import query
from boxtrail.plans.stream_queries import shared_folder
from boxtrail.plans.track_queries import rounded, sql
from boxtrail.sources import mot


def path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def boxes(spark, d):
    return b.obs(spark, d).withColumn("line_number", F.col("event_id"))


TEXT = sql(b.OBS, body="SELECT sequence, frame, track_id, x, y, w, h, round(conf, 6) AS conf FROM obs")
COLUMNS = ["sequence", "frame", "track_id", "x", "y", "w", "h", "conf"]


@query("mot_round_trip", TEXT)
def mot_round_trip(spark, d):
    at, parts = path(spark, "mot"), []
    text = mot.mot_text(boxes(spark, d))
    for name in ("s0", "s1", "s2", "s3"):  # the bridge's sequences; a folder of files for each
        text.where(F.col("sequence") == name).select("value").write.text(f"{at}/{name}")
        parts.append(mot.read_mot(spark, f"{at}/{name}").withColumn("sequence", F.lit(name)).select(*COLUMNS))
    return rounded(reduce(DataFrame.unionByName, parts), "x", "y", "w", "h", "conf")


@query("cache_round_trip", sql(b.OBS, body="SELECT sequence, frame, x, y, w, h, round(conf, 6) AS conf, class_id, class AS class_name FROM (SELECT *, (track_id % 3)::INT AS class_id FROM obs) WHERE conf >= 0.3"))
def cache_round_trip(spark, d):
    at = path(spark, "cache")
    rows = b.obs(spark, d).select("sequence", "frame", "x", "y", "w", "h", "conf", (F.col("track_id") % 3).cast("int").alias("class_id"), F.col("class").alias("class_name"))
    mot.write_cache(rows, at)
    return rounded(mot.cache_rows(mot.read_cache(spark, at), 0.3).select("sequence", "frame", "x", "y", "w", "h", "conf", "class_id", "class_name"), "x", "y", "w", "h", "conf")


@query("yolo_files", sql(b.OBS, """i AS (SELECT DISTINCT sequence || '_' || frame AS image FROM obs UNION SELECT 'empty'), l AS (SELECT sequence || '_' || frame AS image, printf('%d %.6f %.6f %.6f %.6f', track_id % 3, (x + w / 2) / 200, (y + h / 2) / 120, w / 200, h / 120) AS t FROM obs)""", body="SELECT image, coalesce(string_agg(t, chr(10) ORDER BY t), '') AS value FROM i LEFT JOIN l USING (image) GROUP BY ALL"))
def yolo_files(spark, d):
    rows = b.obs(spark, d).select(F.concat_ws("_", "sequence", F.col("frame").cast("string")).alias("image"), (F.col("track_id") % 3).alias("class_id"), "x", "y", "w", "h")
    images = rows.select("image").distinct().union(rows.select(F.lit("empty")).limit(1)).select("image", F.lit(200.0).alias("width"), F.lit(120.0).alias("height"))
    return mot.yolo_labels(rows, images)


@query("event_log_round_trip", sql(b.OBS, body="SELECT event_id::VARCHAR AS event_id, sequence, track_id, class AS type, CASE WHEN conf < 0.5 THEN 'low' END AS severity, frame AS start, frame + 3 AS \"end\", frame AS trigger FROM obs"))
def event_log_round_trip(spark, d):
    at = path(spark, "events")
    frame = F.col("frame")
    mot.write_events(b.obs(spark, d).select(F.col("event_id").cast("string").alias("event_id"), "sequence", "track_id", F.col("class").alias("type"), F.when(F.col("conf") < 0.5, "low").alias("severity"), frame.alias("start"), (frame + 3).alias("end"), frame.alias("trigger")), at)
    return mot.read_events(spark, at)


@query("cached_values", "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'v' || user_id END AS value FROM (SELECT DISTINCT user_id FROM events)")
def cached_values(spark, d):
    users = b.table(spark, d, "events").select("user_id").distinct()
    known = users.where("user_id % 2 = 0").select(F.sha2(F.to_json(F.struct("user_id")), 256).alias("key"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("value"))
    return mot.cached(users, known, ["user_id"], "value").select("user_id", "value")
