"""Structured Streaming: the folds of the batch operators as keyed state, deduplication, sliding votes, the queue of semantic jobs."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boxtrail.operators.tracker import STABLE, DecayVote


def stabilized_stream(obs: DataFrame, kind: type = DecayVote, **options) -> DataFrame:
    """operators.tracker.stabilize() over a stream: the fold of each track is its state. Rows of one batch are taken in order of frame; rows that come later than
    a frame already folded are folded where they come."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = kind(**options)
        if state.exists:
            vars(fold).update(pickle.loads(state.get[0]))
        pdf = pd.concat(list(batches)).sort_values(["frame", "class"])
        stable = [fold.step(f, c, v) for f, c, v in zip(pdf.frame, pdf["class"], pdf.conf, strict=True)]
        state.update((pickle.dumps(vars(fold)),))
        yield pdf.assign(stable=stable)[["sequence", "track_id", "frame", "class", "stable"]]

    slim = obs.select("sequence", "track_id", "frame", "class", "conf")
    return slim.groupBy("sequence", "track_id").applyInPandasWithState(run, STABLE, "fold binary", "append", GroupStateTimeout.NoTimeout)


def distinct_stream(rows: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Rows of new keys; keys are forgotten when the watermark has passed them."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed_votes(rows: DataFrame, ts: str, label: str, weight: str, size: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Sums of weights by label in tumbling windows, emitted when the watermark closes them."""
    return rows.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), F.col(label).alias("label")).agg(F.sum(weight).alias("score"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "label", "score", "n")


def latest_only(rows: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Of each key the newest payload of a batch, and how many sequence numbers were passed over."""
    return rows.groupBy(key).agg(F.max_by(payload, order).alias(payload), F.max(order).alias(order), (F.max(order) - F.min(order) + 1 - F.count("*")).alias("dropped"))


def enqueue(pending: DataFrame, jobs: DataFrame, capacity: int, better: float = 0.08, least_quality: float = 0.0) -> DataFrame:
    """The queue after a batch of jobs: one pending job per track, replaced only by one of a quality greater by `better`; the first `capacity` by priority and frame.

    Both: sequence, track_id, frame, priority, quality. Used from foreachBatch.
    """
    new = jobs.where(F.col("quality") >= least_quality).groupBy("sequence", "track_id").agg(F.max_by(F.struct("frame", "priority", "quality"), F.struct("quality", -F.col("frame"))).alias("n"))
    old = pending.select("sequence", "track_id", F.struct("frame", "priority", "quality").alias("o"))
    j = old.join(new, ["sequence", "track_id"], "full")
    replace = F.col("o").isNull() | (F.col("n.quality") >= F.col("o.quality") + better)
    kept = j.select("sequence", "track_id", F.when(F.coalesce(replace, F.lit(False)), F.col("n")).otherwise(F.col("o")).alias("k"))
    return kept.select("sequence", "track_id", "k.*").orderBy(F.desc("priority"), "frame", "sequence", "track_id").limit(capacity)


def upsert_queue(path: str, capacity: int):
    """A foreachBatch function that keeps the queue as versions v=<batch> of a table; a batch that is run again gives the same version."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        columns = ["sequence", "track_id", "frame", "priority", "quality"]
        before = spark.createDataFrame([], batch.select(*columns).schema) if epoch == 0 else spark.read.parquet(f"{path}/v={epoch - 1}")
        enqueue(before.select(*columns), batch.select(*columns), capacity).write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return run
