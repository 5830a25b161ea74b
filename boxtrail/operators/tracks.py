"""Track analytics: summaries, gaps, runs, continuity, votes, distributions, dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.functions import geometry as g
from boxtrail.functions.scalars import exclusive_quantile, nearest_rank, ratio_or_zero

KEY = ["sequence", "track_id"]


def track_summary(obs: DataFrame) -> DataFrame:
    """Per track: length, span, coverage, gap frames, first and last centre, displacement, mean confidence without nulls."""
    x, y = g.centre(g.corners("x", "y", "w", "h"))
    at = F.struct(x.alias("x"), y.alias("y"))
    s = obs.groupBy(*KEY).agg(F.countDistinct("frame").alias("length"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min_by(at, "frame").alias("a"), F.max_by(at, "frame").alias("b"), F.avg("conf").alias("mean_conf"))
    span = F.col("last_frame") - F.col("first_frame") + 1
    return s.select(*KEY, "length", "first_frame", "last_frame", span.alias("span"), (F.col("length") / span).alias("coverage"), (span - F.col("length")).alias("gap_frames"), F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")).alias("displacement"), "mean_conf")


def track_gaps(obs: DataFrame) -> DataFrame:
    """Internal absences: one row for each gap of a track."""
    frames = obs.select(*KEY, "frame").distinct().withColumn("next", F.lead("frame").over(W.partitionBy(*KEY).orderBy("frame")))
    return frames.where("next - frame > 1").select(*KEY, (F.col("frame") + 1).alias("gap_start"), (F.col("next") - 1).alias("gap_end"), (F.col("next") - F.col("frame") - 1).alias("gap_frames"))


def runs(frames: DataFrame, keys: list[str], column: str = "frame") -> DataFrame:
    """Consecutive values of each key as (run_start, run_end, run_length)."""
    numbered = frames.select(*keys, column).distinct()
    island = F.col(column) - F.row_number().over(W.partitionBy(*keys).orderBy(column))
    return numbered.withColumn("island", island).groupBy(*keys, "island").agg(F.min(column).alias("run_start"), F.max(column).alias("run_end"), F.count("*").alias("run_length")).drop("island")


def stability(obs: DataFrame, fps: float) -> DataFrame:
    """Per sequence: tracks, mean length, share of tracks shorter than a second, continuity, tracks with a gap."""
    s = track_summary(obs)
    return s.groupBy("sequence").agg(
        F.count("*").alias("tracks"),
        F.avg("length").alias("mean_length"),
        F.avg((F.col("length") < round(fps)).cast("int")).alias("short_ratio"),
        F.avg("coverage").alias("continuity"),
        F.count_if(F.col("gap_frames") > 0).alias("gap_tracks"),
    )


def lifecycle(obs: DataFrame) -> DataFrame:
    """Per sequence: mean and median rows of a track, how many are short, and missing frames within spans."""
    t = obs.groupBy(*KEY).agg(F.count("*").alias("n"), (F.max("frame") - F.min("frame") + 1).alias("span"))
    short = {f"under_{k}": F.count_if(F.col("n") < k) for k in (3, 10, 30, 60)}
    return t.groupBy("sequence").agg(F.count("*").alias("tracks"), F.avg("n").alias("mean_length"), F.median("n").alias("median_length"), *[c.alias(k) for k, c in short.items()], F.sum(F.greatest(F.col("span") - F.col("n"), F.lit(0))).alias("gap_frames"))


def length_quartiles(obs: DataFrame) -> DataFrame:
    """Exclusive quartiles of rows per track, by sequence. Tracks of a sequence are gathered as numbers."""
    t = obs.groupBy(*KEY).agg(F.count("*").alias("n")).groupBy("sequence").agg(F.sort_array(F.collect_list(F.col("n").cast("double"))).alias("v"))
    return t.select("sequence", *[exclusive_quantile(F.col("v"), q).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)])


def ranked_percentiles(rows: DataFrame, value: str, by: list[str], quantiles=(0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles with positions rounded half to even. Exact: ranks come from a window over each group."""
    w = W.partitionBy(*by)
    n = F.count("*").over(w)
    ranked = rows.where(F.col(value).isNotNull()).select(*by, value, (F.row_number().over(w.orderBy(value)) - 1).alias("at"), n.alias("n"))
    want = lambda q: F.least(F.bround(F.lit(q) * (F.col("n") - 1)).cast("long"), F.col("n") - 1)
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("at") == want(q), F.col(value))).alias(f"p{int(100 * q)}") for q in quantiles])


def steady_state(rows: DataFrame, by: list[str], order: str, warmup: int = 5) -> DataFrame:
    """Without the first min(warmup, n - 1) rows of each group."""
    w = W.partitionBy(*by)
    return rows.withColumns({"_at": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)}).where(F.col("_at") > F.least(F.lit(warmup), F.col("_n") - 1)).drop("_at", "_n")


def class_votes(obs: DataFrame) -> DataFrame:
    """Winning class of each track: the greatest sum of confidences, at least 0.05 each and 0.5 where null; ties go to the greater name."""
    votes = obs.groupBy(*KEY, "class").agg(F.sum(F.greatest(F.coalesce("conf", F.lit(0.5)), F.lit(0.05))).alias("score"), F.count("*").alias("n"))
    total = votes.groupBy(*KEY).agg(F.max_by(F.struct("class", "score"), F.struct(F.round("score", 9), "class")).alias("best"), F.sum("score").alias("all"), F.count("*").alias("classes"))
    return total.select(*KEY, F.col("best.class").alias("class"), F.col("best.score").alias("score"), ratio_or_zero(F.col("best.score"), F.col("all")).alias("consensus"), "classes")


def decayed_votes(obs: DataFrame, history: int = 30, decay: float = 0.97) -> DataFrame:
    """At each row of a track, the class with the greatest decayed sum over the last history frames; ties go to the greater name."""
    now, past = obs.select(*KEY, "frame"), obs.select(*KEY, F.col("frame").alias("at"), "class", F.greatest(F.coalesce("conf", F.lit(0.5)), F.lit(0.05)).alias("v"))
    bucket = lambda c: F.floor(F.col(c) / history)
    # a row's history lies in its own bucket of frames or the one before, so both sides meet by equality
    spread = past.select("*", F.explode(F.array(bucket("at"), bucket("at") + 1)).alias("bucket"))
    pairs = now.withColumn("bucket", bucket("frame")).join(spread, [*KEY, "bucket"]).where((F.col("at") <= F.col("frame")) & (F.col("at") > F.col("frame") - history))
    votes = pairs.groupBy(*KEY, "frame", "class").agg(F.sum(F.col("v") * F.pow(F.lit(decay), F.col("frame") - F.col("at"))).alias("score"))
    return votes.groupBy(*KEY, "frame").agg(F.max_by(F.struct("class", "score"), F.struct(F.round("score", 9), "class")).alias("b")).select(*KEY, "frame", F.col("b.class").alias("class"), F.col("b.score").alias("score"))


def dataset_status(boxes: DataFrame, width: float, height: float, ignored: Column | None = None, order: str = "event_id") -> DataFrame:
    """Adds status: ignored, then duplicate (not the first of its frame and track), then invalid after clipping, else kept."""
    b = g.clip(g.corners("x", "y", "w", "h"), width, height)
    at = F.row_number().over(W.partitionBy(*KEY, "frame").orderBy(order))
    status = F.when(F.lit(False) if ignored is None else ignored, "ignored").when(at > 1, "duplicate").when(~g.is_valid(b), "invalid").otherwise("kept")
    return boxes.withColumns({"status": status, "area_ratio": g.area(b) / (width * height)})


def dataset_statistics(status: DataFrame, spine: DataFrame | None = None) -> DataFrame:
    """Counts by (), (sequence) in one pass: boxes of each status, tracks, frames and size bins of kept boxes. spine: all (sequence, frame), for frames without boxes."""
    frames = status.select("sequence", "frame", "track_id", "status", "area_ratio")
    if spine is not None:
        frames = spine.join(frames, ["sequence", "frame"], "left")
    kept = F.col("status") == "kept"
    size = g.size_bin(F.col("area_ratio"))
    return frames.groupingSets([[], ["sequence"]], "sequence").agg(
        F.coalesce("sequence", F.lit("all")).alias("scope"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("kept", "ignored", "duplicate", "invalid")],
        F.countDistinct(F.when(kept, F.struct("sequence", "track_id"))).alias("tracks"),
        F.countDistinct("sequence", "frame").alias("frames"),
        *[F.count_if(kept & (size == s)).alias(s) for s in ("small", "medium", "large")],
    ).drop("sequence")


def numeric_summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Least, mean, exact median and greatest value; null with a reason where there is none."""
    v = F.col(value)
    s = rows.groupBy(*by).agg(F.min(v).alias("least"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.max(v).alias("most"), F.count(v).alias("n"))
    return s.withColumn("reason", F.when(F.col("n") == 0, F.lit("no values")))


def trajectory_tail(obs: DataFrame, n: int = 30) -> DataFrame:
    """At each row the centres of the track's last n rows."""
    x, y = g.centre(g.corners("x", "y", "w", "h"))
    w = W.partitionBy(*KEY).orderBy("frame").rowsBetween(1 - n, 0)
    return obs.select(*KEY, "frame", F.collect_list(F.struct(x.alias("x"), y.alias("y"))).over(w).alias("tail"))


def latency_of(rows: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """One nearest-rank percentile of small groups, gathered as an array."""
    return rows.groupBy(*by).agg(nearest_rank(F.sort_array(F.collect_list(value)), q).alias("value"))
