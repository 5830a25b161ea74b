"""A queue of jobs as a table of versions: claims, results, recovery of what a lost worker held, and the cache that results make.

Each step is a function of the whole table, and takes effect when its version appears under its number, at once and only if nobody else has
written that number. So a worker that is lost at any point leaves the table as it was before or after a step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

JOB = "event_id long, context string, track_id long, frame long, priority double, ready_after double, status string, lease double, answer string, reason string"
ANSWER = "label string, confidence double"


class Conflict(RuntimeError):
    """Another worker wrote the version first; read the table again."""


class Versions:
    """Versions v=0, v=1, ... of a table in one folder. A version is written aside and renamed, which fails if its number is taken."""

    def __init__(self, spark: SparkSession, path: str, schema: str = JOB):
        self.spark, self.path, self.schema = spark, path, schema
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def latest(self) -> int:
        """The greatest number there is, -1 for none."""
        root = self._path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return max((int(n[2:]) for n in names if n.startswith("v=")), default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.latest() if version is None else version
        return self.spark.createDataFrame([], self.schema) if version < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def commit(self, rows: DataFrame, version: int) -> None:
        aside = f"{self.path}/_{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        try:
            self._context.rename(self._path(aside), self._path(f"{self.path}/v={version}"), self._plain)
        except Exception as e:
            self._fs.delete(self._path(aside), True)
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {version} is there") from e
            raise


def ordered() -> list:
    return [F.desc("priority"), F.col("frame"), F.col("event_id")]


def claim(jobs: DataFrame, now: float, most: int, lease: float = 600.0) -> DataFrame:
    """jobs with up to `most` pending and ready ones in processing until now + lease: the first by priority and frame, and those that follow of the same context. Jobs without a
    context are never claimed."""
    ready = (F.col("status") == "pending") & (F.col("ready_after") <= now) & (F.coalesce("context", F.lit("")) != "")
    first = jobs.where(ready).orderBy(*ordered()).limit(1).select(F.col("context").alias("_context"))
    taken = jobs.where(ready).join(F.broadcast(first), F.col("context") == F.col("_context")).orderBy(*ordered()).limit(most).select("event_id", F.lit(True).alias("_mine"))  # both are top-k
    mine = F.coalesce("_mine", F.lit(False))
    return jobs.join(taken, "event_id", "left").withColumns({"status": F.when(mine, "processing").otherwise(F.col("status")), "lease": F.when(mine, now + lease).otherwise(F.col("lease"))}).drop("_mine")


def finish(jobs: DataFrame, answers: DataFrame) -> DataFrame:
    """jobs with the answers (event_id, answer) of those in processing: processed, or failed where an answer says nothing of a label. Answers to jobs that are not in processing, as
    their lease had run out, are left out."""
    said = answers.groupBy("event_id").agg(F.min("answer").alias("_answer"))
    told = F.from_json("_answer", ANSWER)
    here = (F.col("status") == "processing") & F.col("_answer").isNotNull()
    good = F.coalesce(told["label"] != "", F.lit(False))
    j = jobs.join(said, "event_id", "left")
    return j.withColumns({"status": F.when(here & good, "processed").when(here, "failed").otherwise(F.col("status")), "reason": F.when(here & ~good, "invalid_model_output").otherwise(F.col("reason")), "answer": F.when(here, F.col("_answer")).otherwise(F.col("answer")), "lease": F.when(here, None).otherwise(F.col("lease"))}).drop("_answer")


def recover(jobs: DataFrame, now: float) -> DataFrame:
    """jobs with those pending again whose lease has run out: their worker is lost, or found no answer."""
    lost = (F.col("status") == "processing") & (F.col("lease") <= now)
    return jobs.withColumns({"status": F.when(lost, "pending").otherwise(F.col("status")), "lease": F.when(lost, None).otherwise(F.col("lease"))})


def standing(jobs: DataFrame, now: float) -> DataFrame:
    """One row: status (working, ready, waiting_for_evidence or idle), the jobs of each kind, and the seconds until the next one is ready."""
    is_ = lambda s: F.col("status") == s
    n = lambda s: F.count_if(is_(s)).alias(s)
    wait = F.min(F.when(is_("pending"), F.greatest(F.lit(0.0), F.col("ready_after") - now)))
    status = F.when(F.count_if(is_("processing")) > 0, "working").when(wait == 0, "ready").when(wait > 0, "waiting_for_evidence").otherwise("idle")
    return jobs.agg(status.alias("standing"), *[n(s) for s in ("pending", "processing", "processed", "failed")], F.coalesce(wait, F.lit(0.0)).alias("next_ready"))


def cache(jobs: DataFrame) -> DataFrame:
    """(context, track_id, label, score, answers): the label of each track by the confidences of all processed jobs. It follows from the table alone, so that
    replaying stored answers makes the same."""
    votes = jobs.where("status = 'processed'").select("context", "track_id", F.from_json("answer", ANSWER).alias("a"))
    votes = votes.groupBy("context", "track_id", F.col("a.label").alias("label")).agg(F.sum(F.coalesce("a.confidence", F.lit(0.0))).alias("score"), F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("context", "track_id").orderBy(F.desc(F.round("score", 9)), "label"))
    return votes.withColumns({"place": place, "answers": F.sum("n").over(W.partitionBy("context", "track_id"))}).where("place = 1").select("context", "track_id", "label", "score", "answers")


def work(table: Versions, now: float, most: int, model: Callable[[DataFrame], DataFrame], lease: float = 600.0) -> int:
    """One turn of a worker: what others lost is pending again, jobs are claimed, the model answers them, the answers are stored. Returns how many
    were claimed. Only the number of jobs comes to the driver."""
    at = table.latest()
    jobs = recover(table.read(at), now)
    table.commit(claim(jobs, now, most, lease), at + 1)
    mine = table.read(at + 1).where((F.col("status") == "processing") & (F.col("lease") == now + lease))
    count = mine.count()
    if count:
        table.commit(finish(table.read(at + 1), model(mine)), at + 2)
    return count
