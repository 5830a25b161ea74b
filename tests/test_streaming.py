import random

from pyspark.sql import functions as F

from boxtrail.operators import tracker
from boxtrail.streaming import live

OBS = "sequence string, track_id long, frame long, class string, conf double"


def drain(spark, frame, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stabilized_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [("s", t, f, rng.choice("aab"), rng.random()) for t in (1, 2) for f in range(60)]
    for i in range(3):
        spark.createDataFrame([r for r in rows if r[2] // 20 == i], OBS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = drain(spark, live.stabilized_stream(stream), "stable_votes").collect()
    want = tracker.stabilize(spark.createDataFrame(rows, OBS)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_distinct_and_windows(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 50).alias("id"), F.timestamp_seconds(1704067200 + F.col("id") * 120).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"), F.lit(1.0).alias("w"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert drain(spark, live.distinct_stream(stream, ["id"], "ts"), "distinct_ids").count() == 50
    closed = drain(spark, live.windowed_votes(stream, "ts", "label", "w"), "votes")
    assert closed.groupBy("start").agg(F.sum("n").alias("n")).where("n <> 30").count() == 0 and closed.count() > 0


def test_queue_keeps_one_better_job_per_track(spark, tmp_path):
    schema = "sequence string, track_id long, frame long, priority double, quality double"
    first = spark.createDataFrame([("s", 1, 1, 2.0, 0.5), ("s", 2, 1, 3.0, 0.5), ("s", 3, 1, 1.0, 0.9)], schema)
    then = spark.createDataFrame([("s", 1, 9, 2.0, 0.55), ("s", 2, 9, 3.0, 0.7)], schema)
    put = live.upsert_queue(str(tmp_path / "q"), 2)
    put(first, 0)
    put(then, 1)
    put(then, 1)  # a batch that is run again
    assert [(r.track_id, r.frame) for r in spark.read.parquet(str(tmp_path / "q/v=1")).orderBy(F.desc("priority")).collect()] == [(2, 9), (1, 1)]


def test_latest_only(spark):
    r = live.latest_only(spark.createDataFrame([("c", 1, "x"), ("c", 4, "y")], "cam string, seq long, img string"), "cam", "seq", "img").first()
    assert (r.img, r.seq, r.dropped) == ("y", 4, 2)
