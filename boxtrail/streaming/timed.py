"""The folds of the batch operators over a stream in event time: rows wait for the watermark, idle tracks leave, late rows are counted."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from boxtrail.operators.tracker import DecayVote

TIMED = "sequence string, track_id long, frame long, label string, stable string, late long, gone boolean"


class HeldInOrder(StatefulProcessor):
    """State of a track: its fold, the rows that the watermark hasn't passed yet, the time of its last row, the late rows. A row at or before a time that is folded is counted and
    dropped. When nothing has come for idle_ms the track leaves: one row with gone tells its late rows, and its state is cleared."""

    def __init__(self, kind: type, idle_ms: int, options: dict):
        self.kind, self.idle_ms, self.options = kind, idle_ms, options

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("track", "held binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else {"fold": vars(self.kind(**self.options)), "wait": [], "done": None, "late": 0}
        for pdf in rows:
            for ts, frame, name, conf in zip(pdf.ts, pdf.frame, pdf.label, pdf.conf, strict=True):
                ms = ts.value // 1_000_000
                if held["done"] is not None and ms <= held["done"]:
                    held["late"] += 1
                else:
                    held["wait"].append((ms, int(frame), name, None if pd.isna(conf) else float(conf)))
        if held["wait"]:
            self.handle.registerTimer(min(held["wait"])[0])
        self.state.update((pickle.dumps(held),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        held, now = pickle.loads(self.state.get()[0]), timerValues.getCurrentWatermarkInMs()
        ready = sorted((r for r in held["wait"] if r[0] <= now), key=lambda r: r[:3])
        held["wait"] = [r for r in held["wait"] if r[0] > now]
        fold = self.kind(**self.options)
        vars(fold).update(held["fold"])
        out = [(*key, f, c, fold.step(f, c, v), None, False) for _, f, c, v in ready]
        held["fold"] = vars(fold)
        if ready:
            held["done"] = ready[-1][0]
        if not held["wait"] and held["done"] is not None and held["done"] + self.idle_ms <= now:
            out.append((*key, None, None, None, held["late"], True))
            self.state.clear()
        else:
            self.state.update((pickle.dumps(held),))
            self.handle.registerTimer(min(held["wait"])[0] if held["wait"] else held["done"] + self.idle_ms)
        if out:
            names = [c.split()[0] for c in TIMED.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({"frame": "Int64", "late": "Int64"})

    def close(self) -> None:
        pass


def held_in_order(rows: DataFrame, delay: str, idle_ms: int, kind: type = DecayVote, **options) -> DataFrame:
    """operators.tracker.stabilize() over a stream of sequence, track_id, frame, class, conf and ts, in order of ts. Rows may come up to `delay` out of order; for these the
    rows are those of the batch fold. Adds late and gone: the row with which a track leaves.

    A track's state is its fold and the rows of one delay, and goes idle_ms after its last row. Needs the RocksDB state store.
    """
    slim = rows.withWatermark("ts", delay).select("sequence", "track_id", "frame", F.col("class").alias("label"), "conf", "ts")
    return slim.groupBy("sequence", "track_id").transformWithStateInPandas(HeldInOrder(kind, idle_ms, options), TIMED, "append", "eventTime")
