"""Identity of a target over time: transitions that open and close segments, and reacquisition by a chain of decisions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.operators.rounds import cut
from boxtrail.operators.segments import EDGES

TARGET = ["sequence", "target"]


class Identity:
    """The state of one target and its segments [raw, start, end, status, confidence]. An event that the state machine has no edge for changes nothing."""

    EDGES = frozenset(EDGES)

    def __init__(self, raw: int, frame: int, state: str = "ACTIVE"):
        self.state, self.raw, self.confirmed = state, raw, frame
        self.segments: list[list] = [[raw, frame, None, "confirmed", 1.0]]

    def active(self) -> list | None:
        return next((s for s in reversed(self.segments) if s[3] in ("confirmed", "probation") and s[2] is None), None)

    def step(self, kind: str, frame: int, raw: int | None = None, before: int | None = None, confidence: float | None = None) -> tuple[str, str, bool]:
        """The state before, the one asked for, and whether that was legal. before: the last frame of the segment that a provisional one ends."""
        old = self.state
        if kind == "reacquiring":  # on to REACQUIRING as far as the state allows; no edge is asked for in other states
            self.state = "REACQUIRING" if old in ("ACTIVE", "UNCERTAIN", "LOST") else old
            return old, self.state, True
        new = {"lost": "UNCERTAIN" if old == "ACTIVE" else "LOST", "resumed": "ACTIVE", "provisional": "PROBATION", "confirmed": "ACTIVE", "rejected": "REJECTED", "ended": "TERMINATED"}[kind]
        active = self.active()
        if (old, new) not in self.EDGES or kind == "confirmed" and (active is None or active[3] != "probation"):
            return old, new, False
        self.state = new
        if kind == "provisional":
            if active is not None:
                active[2:4] = [before, "closed"]
            self.segments.append([raw, frame, None, "probation", confidence])
            self.raw = raw
        elif kind == "confirmed":
            active[3] = "confirmed"
            self.raw, self.confirmed = active[0], frame
        return old, new, True


STEPS = "sequence string, target long, event long, kind string, old string, new string, legal boolean, raw long"
SEGMENTS = "sequence string, target long, segment long, raw long, start_frame long, end_frame long, status string, confidence double"


def transitions(events: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each event: sequence, target, event, kind, old, new (the state asked for), legal, raw (the track held afterwards).

    events: sequence, target, event (their order), kind, frame, raw, before, confidence. targets: sequence, target, raw, frame, one row each. A target's events are one
    fold, as each depends on the state that those before it left.
    """
    return _folded(events, targets, False)


def segments_of(events: DataFrame, targets: DataFrame) -> DataFrame:
    """The segments that a target's events leave: sequence, target, segment (from 0), raw, start_frame, end_frame, status, confidence. A target without events has its first."""
    return _folded(events, targets, True)


def _folded(events: DataFrame, targets: DataFrame, want_segments: bool) -> DataFrame:
    start = targets.select(*TARGET, F.col("raw").alias("first_raw"), F.col("frame").alias("first_frame"))
    rows = start.join(events.select(*TARGET, "event", "kind", "frame", "raw", "before", "confidence"), TARGET, "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = (pdf.sequence.iloc[0], pdf.target.iloc[0])
        it, out = Identity(int(pdf.first_raw.iloc[0]), int(pdf.first_frame.iloc[0])), []
        whole = lambda v: None if pd.isna(v) else int(v)
        for e in pdf[pdf.kind.notna()].sort_values("event").itertuples():
            out.append((*head, int(e.event), e.kind, *it.step(e.kind, whole(e.frame), whole(e.raw), whole(e.before), e.confidence), it.raw))
        if want_segments:
            out = [(*head, i, *s) for i, s in enumerate(it.segments)]
        names = [c.split()[0] for c in (SEGMENTS if want_segments else STEPS).split(", ")]
        return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("raw", "start_frame", "end_frame") if c in names})

    return rows.groupBy(*TARGET).applyInPandas(run, SEGMENTS if want_segments else STEPS)


@dataclass(frozen=True)
class Policy:
    """The defaults of windows, gates, weights and thresholds."""

    before: int = 20
    after: int = 50
    least_rows: int = 2
    overlap: int = 2
    farthest: float = 0.20
    least_score: float = 0.45
    margin: float = 0.08
    probation: int = 20
    probation_rows: int = 3
    motion: float = 0.20
    temporal: float = 0.15
    history: float = 0.10


#: Frames of one group of places, and what stands for no frame before or after a row.
BLOCK = 16
NEVER = 1 << 60
WINDOW = ["sequence", "lo", "hi", "at", "wx", "wy"]
BEST = "sequence string, lo long, hi long, at long, wx double, wy double, candidates long, passed long, minus double, first long, track_id long, kept boolean"


def _places(rows: DataFrame, policy: Policy, reach: int) -> DataFrame:
    """What decides on a track that is first seen in a window at a row, with the number of tracks that have it in common and the three lowest of these: the frame before (prev), the frame by which it
    has enough rows, whether it would pass its probation from here, and its frames up to `reach` on."""
    w = W.partitionBy("sequence", "track_id").orderBy("frame")
    enough = F.coalesce(F.lead("frame", policy.least_rows - 1).over(w), F.lit(NEVER)) if policy.least_rows > 1 else F.col("frame")
    found = rows.withColumns({
        "prev": F.coalesce(F.lag("frame").over(w), F.lit(-NEVER)),
        "enough": enough,
        "kept": F.count("*").over(w.rangeBetween(0, policy.probation)) >= policy.probation_rows,
        "ahead": F.collect_list("frame").over(w.rangeBetween(0, reach)),
    })
    found = found.groupBy("sequence", "frame", "cx", "cy", "prev", "enough", "kept", "ahead").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("track_id")), 1, 3).alias("tracks"))
    return found.withColumn("block", F.floor(F.col("frame") / BLOCK))


def _best(policy: Policy):
    """Of one block of frames, for each window and place of a held track: how many tracks are first seen here, how many of them pass, and the three best of these."""
    p, known = policy, policy.temporal + policy.history

    def run(asked: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        out, names = [], [c.split()[0] for c in BEST.split(", ")]
        places = places.sort_values("prev")
        frame, prev, enough, n, kept = (places[c].to_numpy() for c in ("frame", "prev", "enough", "n", "kept"))
        cx, cy, tracks = places.cx.to_numpy(float), places.cy.to_numpy(float), places.tracks.tolist()
        lost = (places.cx.isna() | places.cy.isna()).to_numpy()
        ahead, owner = (np.concatenate(places.ahead.tolist()), np.repeat(np.arange(len(places)), [len(x) for x in places.ahead])) if len(places) else (frame, frame)
        for (seq, lo, hi, at), group in asked.groupby(["sequence", "lo", "hi", "at"]):
            known_before = np.searchsorted(prev, lo)
            here = np.flatnonzero((frame[:known_before] >= lo) & (frame[:known_before] <= hi))
            if not len(here):
                continue
            near, upto = max(1, at - p.overlap), min(at, hi)
            beside = prev >= near
            if lo <= at:
                beside[owner[(ahead >= near) & (ahead <= upto)]] = True
            good = here[(enough[here] <= hi) & ~beside[here]]
            temporal = np.maximum(0.0, 1 - np.maximum(0, frame[good] - at) / max(1, hi - at))
            for x, y, placed, scale in zip(group.wx, group.wy, group.placed, group.scale, strict=True):
                dx, dy = cx[good] - x, cy[good] - y
                gap, none = np.sqrt(dx * dx + dy * dy) / scale, lost[good] | (not placed)
                score = np.where(none, (p.temporal * temporal + p.history) / known, (p.motion * np.maximum(0.0, 1 - gap / p.farthest) + p.temporal * temporal + p.history) / (known + p.motion))
                ok = np.flatnonzero(none | (gap <= p.farthest))
                minus, rows = -np.round(score[ok], 12), good[ok]
                top = np.flatnonzero(minus <= np.partition(minus, 2)[2]) if len(ok) > 3 else np.arange(len(ok))
                best = sorted((float(minus[i]), int(frame[rows[i]]), int(t), bool(kept[rows[i]])) for i in top for t in tracks[rows[i]])[:3]
                head = (seq, lo, hi, at, x if placed else None, y if placed else None)
                out.append((*head, int(n[here].sum()), int(n[rows].sum()), *[None] * 4))
                out += [(*head, 0, 0, *b) for b in best]
        return pd.DataFrame(out, columns=names).astype({"first": "Int64", "track_id": "Int64", "kept": "boolean"})

    return run


def reacquire(events: DataFrame, targets: DataFrame, obs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """A decision for each event of each target, where what an event commits decides on the window, the candidates and the gates of the next.

    One row for each event: sequence, target, n, event, raw (held before), status (same_raw_id_resumed, provisional, ambiguous, rejected or not_found), selected,
    start_frame, score, margin, candidates, passed, confirmed (whether the new track passed its probation).
    events: sequence, target, n (1, 2, ... within the target), event, start, stop, trigger. targets: sequence, target, raw, frame (last confirmed). obs: sequence, track_id, frame, x, y, w, h.

    The n-th events of all targets are decided at once, so that there are as many rounds as the longest chain has events. Candidates are the tracks seen in the
    window; the held track itself resumes if it has enough rows after the event. Gates: enough rows, not seen beside the target before it was lost, near enough to
    where it was. A target's one open segment is that of the held track, so no segment of its own overlaps another candidate.

    A track is a candidate where its first row in the window lies. Windows meet rows by blocks of frames and give the best of each block, so no pairs of events and tracks
    are made; equal windows, and tracks with equal rows, are looked at once.
    """
    p = policy
    boxes = obs.select("sequence", "track_id", "frame", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    boxes = cut(boxes)
    scale = F.broadcast(cut(boxes.groupBy("sequence").agg(F.greatest(F.lit(1.0), F.sqrt(F.pow(F.max("x2"), 2) + F.pow(F.max("y2"), 2))).alias("scale"), F.min("frame").alias("low"), F.max("frame").alias("top")).coalesce(1)))
    rows = boxes.where("track_id is not null and frame is not null").select("sequence", "track_id", F.col("frame").cast("long").alias("frame"), "cx", "cy")
    end = F.greatest("stop", "trigger") + p.after
    ordered = events.join(targets.select(*TARGET, F.col("frame").alias("_first")), TARGET, "left")
    latest = F.greatest("_first", F.max(end + p.probation).over(W.partitionBy(*TARGET).orderBy("n").rowsBetween(W.unboundedPreceding, -1)))  # no frame is confirmed later than that
    events = cut(ordered.select(*TARGET, "n", "event", "start", "stop", "trigger", (latest - F.col("start")).alias("late")))
    most, late = events.agg(F.max("n"), F.max("late")).first()
    places = cut(_places(rows, p, p.before + max(0, late or 0))) if most else None
    state = targets.select(*TARGET, F.col("raw").alias("raw"), F.col("frame").cast("long").alias("last"))
    decided = None
    for n in range(1, (most or 0) + 1):
        e = events.where(F.col("n") == n).drop("late").join(state, TARGET)
        lo = F.greatest(F.lit(1), F.least(F.col("last") + 1, F.col("start") - p.before)).cast("long")
        e = e.withColumns({"lo": lo, "hi": end.cast("long"), "at": F.coalesce("last", F.lit(NEVER))})
        inside = (F.col("frame") >= F.col("lo")) & (F.col("frame") <= F.col("hi"))
        after, place = inside & (F.col("frame") > F.col("stop")), F.struct("cx", "cy")
        held = e.select(*TARGET, "raw", "last", "lo", "hi", "at", "stop").join(rows.withColumnRenamed("track_id", "raw"), ["sequence", "raw"]).groupBy(*TARGET).agg(
            F.max_by(place, F.when(F.col("frame") <= F.col("last"), F.col("frame"))).alias("was"),
            F.min_by(place, F.when(inside, F.col("frame"))).alias("own_at"),
            F.count_if(inside).alias("own_rows"),
            F.count_if(F.col("frame").between(F.greatest(F.lit(1), F.col("at") - p.overlap), F.least("at", "hi"))).alias("own_beside"),
            F.count_if(after).alias("after_rows"),
            F.min(F.when(after, F.col("frame"))).alias("after_first"),
        )
        placed = F.col("was.cx").isNotNull() & F.col("was.cy").isNotNull()
        e = cut(e.join(held, TARGET, "left").join(scale, "sequence", "left").withColumns({"placed": placed, "wx": F.when(placed, F.col("was.cx")), "wy": F.when(placed, F.col("was.cy"))}).drop("was"))
        span = F.sequence(F.floor(F.greatest("lo", "low") / BLOCK), F.floor(F.least("hi", "top") / BLOCK))
        asked = e.where("greatest(lo, low) <= least(hi, top)").select(*WINDOW, "placed", "scale", "low", "top").distinct().withColumn("block", F.explode(span)).drop("low", "top")
        best = asked.groupBy("sequence", "block").cogroup(places.groupBy("sequence", "block")).applyInPandas(_best(p), BEST)
        top = F.sort_array(F.collect_list(F.when(F.col("track_id").isNotNull(), F.struct("minus", "first", "track_id", "kept"))))
        best = best.groupBy(*WINDOW).agg(F.sum("candidates").alias("candidates"), F.sum("passed").alias("passed"), F.slice(top, 1, 3).alias("best")).toDF(*[f"_{c}" for c in WINDOW], "candidates", "passed", "best")
        same = [F.col(c) == F.col(f"_{c}") for c in WINDOW[:4]] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in WINDOW[4:]]
        d = e.join(best, same, "left").drop(*[f"_{c}" for c in WINDOW])
        dx, dy = F.col("own_at.cx") - F.col("wx"), F.col("own_at.cy") - F.col("wy")
        own = F.coalesce(F.col("own_rows") > 0, F.lit(False))
        own_passed = own & (F.col("own_rows") >= p.least_rows) & (F.col("own_beside") == 0) & F.coalesce(F.sqrt(dx * dx + dy * dy) / F.col("scale") <= p.farthest, F.lit(True))
        others = lambda c, mine: F.when(F.col("raw").isNull(), 0).otherwise(F.coalesce(c, F.lit(0)) - mine.cast("long")).cast("long").alias(c)
        resumed = F.when(F.col("after_rows") >= p.least_rows, F.col("after_first"))
        two = F.filter("best", lambda b: b["track_id"] != F.col("raw"))
        d = d.withColumns({"candidates": others("candidates", own), "passed": others("passed", own_passed), "resumed": resumed, "one": F.try_element_at(two, F.lit(1)), "two": F.try_element_at(two, F.lit(2))})
        value, margin = -F.col("one.minus"), F.col("two.minus") - F.col("one.minus")
        status = F.when(F.col("resumed").isNotNull(), "same_raw_id_resumed").when(F.col("one").isNull(), "not_found").when(value < p.least_score, "rejected").when(margin < p.margin, "ambiguous").otherwise("provisional")
        d = d.withColumns({"status": status, "score": F.when(F.col("resumed").isNotNull(), 1.0).otherwise(value), "margin": F.when(F.col("resumed").isNull() & (value >= p.least_score), margin)})
        new = F.col("status") == "provisional"
        selected = F.when(F.col("resumed").isNotNull(), F.col("raw")).when(new, F.col("one.track_id"))
        start = F.when(F.col("resumed").isNotNull(), F.col("resumed")).when(new, F.col("one.first"))
        d = d.select(*TARGET, "n", "event", "raw", "last", "status", selected.alias("selected"), start.alias("start_frame"), "score", "margin", "candidates", "passed", F.when(new, F.col("one.kept")).alias("confirmed"))
        d = cut(d)
        out = d.drop("last")
        decided = out if decided is None else decided.unionByName(out)
        moved = d.select(*TARGET, F.when(new, F.col("selected")).otherwise(F.col("raw")).alias("raw"), F.when(F.col("confirmed"), F.col("start_frame") + p.probation).otherwise(F.col("last")).alias("last"))
        state = moved if n == most else cut(moved.unionByName(state.join(moved.select(*TARGET), TARGET, "left_anti")))
    if decided is None:
        kinds = "sequence string, target long, n long, event string, raw long, status string, selected long, start_frame long, score double, margin double, candidates long, passed long, confirmed boolean"
        return obs.sparkSession.createDataFrame([], kinds)
    return decided
