"""Filters over detections and tracks, sampling and selection of rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.functions import geometry as g
from boxtrail.operators import scenes

KEY = ["sequence", "track_id"]


def detections(rows: DataFrame, classes: list[str], threshold: float, width: float, height: float) -> DataFrame:
    """Finite boxes of the classes with enough confidence, clipped and valid, in order of frame, falling confidence and box."""
    b = g.clip(g.corners("x", "y", "w", "h"), width, height)
    kept = rows.where(g.finite(F.col("x"), F.col("y"), F.col("w"), F.col("h")) & F.col("class").isin(classes) & (F.col("conf") >= threshold)).where(g.is_valid(b))
    x, y, w, h = g.size_form(b)
    return kept.withColumns({"x": x, "y": y, "w": w, "h": h})


def split_tracked(rows: DataFrame, tracked: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Rows to track and rows to detect only, by class; None tracks all."""
    inside = F.lit(True) if tracked is None else F.col("class").isin(tracked)
    return rows.where(inside), rows.where(~inside)


def minimum_age(obs: DataFrame, least: int) -> DataFrame:
    """Rows from a track's frame number `least` on, counted from its first."""
    first = F.min("frame").over(W.partitionBy(*KEY))
    return obs.withColumn("_first", first).where(F.col("frame") - F.col("_first") + 1 >= least).drop("_first")


def emitted(state: Column, since_update: Column, confirmed_only: bool = True, most: int = 0) -> Column:
    return (state != "deleted") & ((state == "confirmed") if confirmed_only else F.lit(True)) & (since_update <= most)


def spatial_gate(iou: Column, centre_inside: Column, coverage: Column, least_iou: float, least_cover: float) -> tuple[Column, Column]:
    """(passed, reason): IoU, or a centre inside with enough coverage; else the first failing reason."""
    passed = (iou >= least_iou) | (centre_inside & (coverage >= least_cover))
    return passed, F.when(passed, None).when(~centre_inside, "centre_outside").otherwise("low_coverage")


def top_tracks(obs: DataFrame, n: int) -> DataFrame:
    return obs.groupBy(*KEY).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), *KEY).limit(n)


def best_of_segments(rows: DataFrame, score: str, k: int) -> DataFrame:
    """Of each track the best row of k parts of equal rank range (bounds i * n // k); ties go to the earlier frame."""
    w = W.partitionBy(*KEY)
    r = rows.withColumns({"_i": F.row_number().over(w.orderBy("frame")) - 1, "_n": F.count("*").over(w)})
    # part p holds ranks p * n // k to (p + 1) * n // k - 1
    part = F.floor(((F.col("_i") + 1) * k - 1) / F.col("_n"))
    return r.withColumn("part", part).groupBy(*KEY, "part").agg(F.max_by(F.struct("frame", score), F.struct(score, -F.col("frame"))).alias("b")).select(*KEY, "part", "b.frame", f"b.{score}")


def uniform_positions(n: Column, k: int) -> Column:
    """k positions of 0..n-1 at even steps rounded half to even, distinct, ends included."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(max(k - 1, 1))), lambda i: F.bround(i * (n - 1) / F.lit(float(max(k - 1, 1)))).cast("int"))
    return F.array_distinct(steps)


def spaced(frames: list[int], quality: list[float], k: int, gap: int) -> list[int]:
    """Up to k frames by falling quality, none within `gap` of one taken; what is left is filled by quality."""
    order = sorted(range(len(frames)), key=lambda i: (-quality[i], frames[i]))
    taken: list[int] = []
    for i in order:
        if len(taken) < k and all(abs(frames[i] - frames[j]) >= gap for j in taken):
            taken.append(i)
    for i in order:
        if len(taken) < k and frames[i] not in {frames[j] for j in taken}:
            taken.append(i)
    return taken


def spaced_top(rows: DataFrame, quality: str, k: int, gap: int) -> DataFrame:
    """spaced() for each track; a track's rows are one group."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        taken = spaced(pdf.frame.tolist(), pdf[quality].tolist(), k, gap)
        return pdf.iloc[taken].assign(place=range(1, len(taken) + 1))

    return rows.select(*KEY, "frame", quality).groupBy(*KEY).applyInPandas(pick, f"sequence string, track_id long, frame long, {quality} double, place long")


def shots(rows: DataFrame, score: str, threshold: float, gap: int) -> DataFrame:
    """Adds shot (from 1) to the frames of each sequence (one row each): a shot starts with the first frame and with each whose score is enough, at least `gap` after the start before."""
    first = rows.groupBy("sequence").agg(F.min("frame").alias("frame"))
    starts = scenes.spaced(first.unionByName(rows.where(F.col(score) >= threshold).select("sequence", "frame")), gap)
    both = rows.select("sequence", "frame", score, F.lit(0).alias("start")).unionByName(starts.withColumn("start", F.lit(1)), allowMissingColumns=True)
    marked = both.groupBy("sequence", "frame").agg(F.max(score).alias(score), F.max("start").alias("start"))
    return marked.select("sequence", "frame", score, F.sum("start").over(W.partitionBy("sequence").orderBy("frame")).alias("shot"))


def next_fit(sizes: list[int], most_items: int, capacity: int) -> list[int | None]:
    """Batch of each item in the given order; a new batch where the item or its size would be too much; no batch for empty items."""
    out, batch, items, used = [], 0, 0, 0
    for s in sizes:
        if s <= 0:
            out.append(None)
            continue
        if items and (items >= most_items or used + s > capacity):
            batch, items, used = batch + 1, 0, 0
        items, used = items + 1, used + s
        out.append(batch)
    return out


def pack(rows: DataFrame, size: str, most_items: int, capacity: int) -> DataFrame:
    """next_fit() over the tracks of each sequence, in order of track."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("track_id")
        return pdf.assign(batch=pd.array(next_fit(pdf[size].tolist(), most_items, capacity), dtype="Int64"))

    return rows.select(*KEY, size).groupBy("sequence").applyInPandas(fold, f"sequence string, track_id long, {size} long, batch long")
