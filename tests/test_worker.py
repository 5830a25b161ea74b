"""The queue worker, killed after any step, and the timed fold against the batch fold."""

import random

import pytest
from pyspark.sql import functions as F

from boxtrail.operators import tracker
from boxtrail.streaming import timed, worker


def queue(spark, n=12):
    rows = [(i, "ab"[i % 3 == 0], i % 4, i, float(i % 5), 0.0 if i % 6 else 5000.0, "pending", None, None, None) for i in range(n)] + [(99, "", 1, 1, 9.0, 0.0, "pending", None, None, None)]
    return spark.createDataFrame(rows, worker.JOB)


def model(df):
    label = F.when(F.col("event_id") % 5 == 4, F.lit("{")).otherwise(F.to_json(F.struct(F.concat(F.lit("l"), (F.col("event_id") % 2).cast("string")).alias("label"), (F.col("frame") / 10).alias("confidence"))))
    return df.select("event_id", label.alias("answer"))


class Killed(Exception):
    pass


class Dying(worker.Versions):
    """A table whose writer is lost at its n-th write, before or after it takes effect."""

    def __init__(self, spark, path, n, after):
        super().__init__(spark, path)
        self.left, self.after = n, after

    def commit(self, rows, version):
        self.left -= 1
        if self.left == 0 and not self.after:
            raise Killed
        super().commit(rows, version)
        if self.left == 0:
            raise Killed


def drain(table, now=10.0):
    for _ in range(20):
        if not worker.work(table, now, 3, model, lease=5.0):
            return
        now += 6.0
    raise AssertionError("the queue was not drained")


def outcome(table):
    jobs = table.read()
    return sorted((r.event_id, r.status, r.answer, r.reason) for r in jobs.collect()), sorted(tuple(r) for r in worker.cache(jobs).collect())


@pytest.fixture(scope="module")
def undisturbed(spark, tmp_path_factory):
    table = worker.Versions(spark, str(tmp_path_factory.mktemp("q") / "t"))
    table.commit(queue(spark), 0)
    drain(table)
    return outcome(table)


@pytest.mark.parametrize("n,after", [(1, False), (1, True), (2, False), (2, True), (4, False)])
def test_a_worker_lost_at_any_write_changes_nothing(spark, tmp_path, undisturbed, n, after):
    path = str(tmp_path / "t")
    worker.Versions(spark, path).commit(queue(spark), 0)
    with pytest.raises(Killed):
        drain(Dying(spark, path, n, after))
    drain(worker.Versions(spark, path), now=30.0)
    assert outcome(worker.Versions(spark, path)) == undisturbed
    assert {s for _, s, _, _ in undisturbed[0]} == {"processed", "failed", "pending"}


def test_claims_are_of_one_context_and_versions_are_written_once(spark, tmp_path):
    table = worker.Versions(spark, str(tmp_path / "t"))
    assert table.latest() == -1 and table.read().count() == 0
    table.commit(queue(spark), 0)
    mine = worker.claim(table.read(), 10.0, 3).where("status = 'processing'").collect()
    assert len({r.context for r in mine}) == 1 and sorted(r.event_id for r in mine) == [2, 4, 8]  # priorities 2, 4, 3 of context a
    with pytest.raises(worker.Conflict):
        table.commit(queue(spark), 0)
    assert table.latest() == 0
    assert worker.standing(table.read(), 10.0).first().standing == "ready"
    assert worker.standing(queue(spark).where("event_id = 0"), 10.0).first().next_ready == 4990.0
    assert worker.standing(queue(spark).limit(0), 10.0).first().standing == "idle"


def test_late_answers_are_left_out(spark):
    jobs = worker.recover(worker.claim(queue(spark), 10.0, 3, 5.0), 20.0)
    assert worker.finish(jobs, model(jobs)).where("status = 'processed'").count() == 0


def test_timed_fold_equals_batch_fold_and_tracks_leave(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(6)
    rows = [("s", t, f, rng.choice("ab"), rng.random()) for t in (1, 2) for f in range(40) if t == 1 or f < 15]
    files = [rows[i::3] for i in range(3)]  # out of order, within the delay
    at = lambda rs: spark.createDataFrame(rs, "sequence string, track_id long, frame long, class string, conf double").withColumn("ts", F.timestamp_seconds(F.col("frame") + 1000))
    rest = [[("s", 9, 100, "a", 0.5)], [("s", 9, 120, "a", 0.5)], [("s", 1, 30, "b", 0.9), ("s", 9, 200, "a", 0.5)], [("s", 9, 400, "a", 0.5)]]  # the second row of frame 30 is late
    for i, part in enumerate(files + rest):
        at(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    stream = spark.readStream.schema(at(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    out = timed.held_in_order(stream, "60 seconds", 100_000)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(timed.TIMED).parquet(str(tmp_path / "out"))
    held = {(r.track_id, r.frame): r.stable for r in got.where("NOT gone AND track_id < 9").collect()}
    want = {(r.track_id, r.frame): r.stable for r in tracker.stabilize(at(rows).drop("ts")).collect()}
    assert held == want
    assert {r.track_id for r in got.where("gone").collect()} == {1, 2}
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in map(dict, q.recentProgress) if p["stateOperators"])
    assert dropped + sum(r.late for r in got.where("gone").collect()) == 1
    state = [p.stateOperators[0].numRowsTotal if hasattr(p, "stateOperators") else p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert state[-1] < max(state)  # the state of tracks that left is gone
