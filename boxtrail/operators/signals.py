"""Uncertainty signals of tracks, their merging into events, and the plan of what to look at again."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.functions import geometry as g
from boxtrail.functions.scalars import severity_rank
from boxtrail.operators.tracks import KEY, runs, track_gaps


def absences(obs: DataFrame, warn: int = 5, critical: int = 20) -> DataFrame:
    """Runs of frames without the track within its sequence's frames, before its first and after its last one too, from `warn` frames on."""
    whole = obs.groupBy("sequence").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    inner = track_gaps(obs).select(*KEY, F.col("gap_start").alias("run_start"), F.col("gap_end").alias("run_end"))
    ends = obs.groupBy(*KEY).agg(F.min("frame").alias("a"), F.max("frame").alias("b")).join(whole, "sequence")
    before = ends.where("a > lo").select(*KEY, F.col("lo").alias("run_start"), (F.col("a") - 1).alias("run_end"))
    after = ends.where("b < hi").select(*KEY, (F.col("b") + 1).alias("run_start"), F.col("hi").alias("run_end"))
    n = F.col("run_end") - F.col("run_start") + 1
    found = inner.unionByName(before).unionByName(after).withColumn("frames", n).where(F.col("frames") >= warn)
    return found.withColumn("severity", F.when(F.col("frames") >= critical, "critical").otherwise("warning"))


def low_confidence_runs(obs: DataFrame, threshold: float = 0.25, least: int = 3) -> DataFrame:
    """Runs of consecutive frames under the threshold; high where the least value is under half of it."""
    low = obs.where(F.col("conf") < threshold)
    r = runs(low, KEY).where(F.col("run_length") >= least)
    worst = low.join(r, KEY).where(F.col("frame").between(F.col("run_start"), F.col("run_end"))).groupBy(*KEY, "run_start", "run_end", "run_length").agg(F.min("conf").alias("lowest"))
    return worst.withColumn("severity", F.when(F.col("lowest") < threshold / 2, "high").otherwise("warning"))


def motion_jumps(obs: DataFrame, diagonal: float, window: int = 10, jump: float = 0.08, ratio: float = 4.0) -> DataFrame:
    """Steps between consecutive rows of a track that are long themselves or by the median of up to `window` steps before."""
    x, y = g.centre(g.corners("x", "y", "w", "h"))
    order = W.partitionBy(*KEY).orderBy("frame")
    p = obs.select(*KEY, "frame", x.alias("cx"), y.alias("cy"))
    step = F.hypot(F.col("cx") - F.lag("cx").over(order), F.col("cy") - F.lag("cy").over(order)) / diagonal
    s = p.select(*KEY, "frame", F.lag("frame").over(order).alias("previous"), step.alias("step")).where("previous is not null")
    s = s.withColumn("baseline", F.sort_array(F.collect_list("step").over(order.rowsBetween(-window, -1))))
    n = F.size("baseline")
    middle = (F.get("baseline", F.floor((n - 1) / 2).cast("int")) + F.get("baseline", F.floor(n / 2).cast("int"))) / 2
    s = s.withColumn("baseline", F.when(n > 0, middle)).withColumn("ratio", F.when(F.col("baseline") > 0, F.col("step") / F.col("baseline")))
    hit = s.where((F.col("step") >= jump) | (F.coalesce(F.col("ratio") >= ratio, F.lit(False)) & (F.col("step") > 0)))
    return hit.withColumn("severity", F.when(F.col("step") >= 2 * jump, "high").otherwise("warning"))


def staleness(obs: DataFrame, grounded: str, least: int = 120) -> DataFrame:
    """Tracks whose last row that meets the condition lies `least` frames or more before their end, or never was."""
    t = obs.groupBy(*KEY).agg(F.max("frame").alias("end"), F.max(F.when(F.expr(grounded), F.col("frame"))).alias("last"), F.min("frame").alias("start"))
    return t.withColumn("stale", F.col("end") - F.coalesce("last", F.col("start") - 1)).where(F.col("stale") >= least).select(*KEY, "last", "end", "stale")


def merge_events(events: DataFrame) -> DataFrame:
    """Events of a track and type joined while each overlaps the one before it (not the furthest end so far). events: sequence, track_id, type, start, end, severity."""
    w = W.partitionBy(*KEY, "type").orderBy("start", "end", "severity")
    new = F.coalesce((F.col("start") > F.lag("end").over(w)).cast("int"), F.lit(1))
    g_ = events.withColumn("new", new).withColumn("bucket", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return g_.groupBy(*KEY, "type", "bucket").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.max_by("severity", severity_rank(F.col("severity"))).alias("severity")).drop("bucket")


def uncertainty(signals: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Per track the weighted mean of severity / 3 of its signals (columns type, severity)."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("type")], F.lit(1.0))
    level = (severity_rank(F.col("severity")) - 1) / 3
    return signals.groupBy(*KEY).agg((F.sum(w * level) / F.sum(w)).alias("uncertainty"), F.count("*").alias("signals"))


def cooldown(triggers: list[tuple[int, bool]], frames: int) -> list[bool]:
    """Which triggers (frame, critical), in order of priority, are accepted: none within `frames` of an accepted one, but critical ones always."""
    taken, out = [], []  # the different accepted frames in order: only the neighbours of a trigger can be too near
    for at, critical in triggers:
        i = bisect.bisect_left(taken, at)
        ok = critical or all(abs(at - t) >= frames for t in taken[max(i - 1, 0) : i + 1])
        out.append(ok)
        if ok and taken[i : i + 1] != [at]:
            taken.insert(i, at)
    return out


def schedule(events: DataFrame, types: list[str], least: str = "warning", frames: int = 50, budget: int = 20) -> DataFrame:
    """The requests of each sequence: events of enough severity by severity, order of type, start and id; then the cooldown, then the budget. events also have
    event_id and trigger. A sequence's events are one group, as each decision depends on those before."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in types]), F.col("type")), F.lit(0)), F.lit(len(types) + 1))
    level = severity_rank(F.col("severity"))
    wanted = events.where(level >= severity_rank(F.lit(least))).select("sequence", "event_id", "type", "severity", "start", "trigger", level.alias("level"), order.alias("type_order"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["level", "type_order", "start", "event_id"], ascending=[False, True, True, True])
        ok = cooldown(list(zip(pdf.trigger, pdf.severity == "critical", strict=True)), frames)
        place = pd.Series(ok, index=pdf.index).cumsum()
        pdf["status"] = ["cooldown" if not o else "accepted" if p <= budget else "budget" for o, p in zip(ok, place, strict=True)]
        return pdf[["sequence", "event_id", "type", "severity", "trigger", "status"]]

    return wanted.groupBy("sequence").applyInPandas(plan, "sequence string, event_id string, type string, severity string, trigger long, status string")


def event_frames(start: str, trigger: str, end: str, budget: int):
    """Frames to look at: the trigger alone, start and end, or start, middle and end, by budget."""
    s, t, e = F.col(start), F.col(trigger), F.col(end)
    picked = F.array(t) if budget <= 1 else F.array(s, e) if budget == 2 else F.array(s, F.floor((s + e) / 2), e)
    return F.array_sort(F.array_distinct(picked))
