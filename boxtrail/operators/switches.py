"""Identity switches: detection by windows over matched rows, classification into five types, rollups, reviewers' agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TYPES = ("fragmentation", "identity_swap", "re_identification_failure", "association_error", "appearance_confusion")


def id_switches(matches: DataFrame) -> DataFrame:
    """Rows where a gt track is matched by another id than when last matched. matches: sequence, frame, gt_track_id, pred_track_id."""
    w = W.partitionBy("sequence", "gt_track_id").orderBy("frame")
    before = matches.withColumns({"old_id": F.lag("pred_track_id").over(w), "last": F.lag("frame").over(w)})
    return before.where("old_id <> pred_track_id").select("sequence", "frame", "gt_track_id", "old_id", F.col("pred_track_id").alias("new_id"), (F.col("frame") - F.col("last") - 1).alias("gap"))


def classify(matches: DataFrame, nearby: DataFrame, reid_gap: int = 10, swap_window: int = 5) -> DataFrame:
    """id_switches with type. A swap: another gt owned the new id within swap_window frames, or owns the old one now; then by the length of the gap, then by crowding.

    nearby: sequence, frame, track_id, nearby. Ids are unique in a frame, as one-to-one matching makes them.
    """
    owner = W.partitionBy("sequence", "pred_track_id").orderBy("frame")
    seen = matches.withColumns({"owner": F.lag("gt_track_id").over(owner), "owned": F.lag("frame").over(owner)}).select("sequence", "frame", "gt_track_id", "owner", "owned")
    now = matches.select("sequence", "frame", F.col("pred_track_id").alias("old_id"), F.col("gt_track_id").alias("old_owner"))
    crowd = nearby.select("sequence", "frame", F.col("track_id").alias("gt_track_id"), "nearby")
    s = id_switches(matches).join(seen, ["sequence", "frame", "gt_track_id"]).join(now, ["sequence", "frame", "old_id"], "left").join(crowd, ["sequence", "frame", "gt_track_id"], "left")
    swap = ((F.col("owner") != F.col("gt_track_id")) & (F.col("frame") - F.col("owned") <= swap_window)) | (F.col("old_owner") != F.col("gt_track_id"))
    kind = F.when(F.coalesce(swap, F.lit(False)), "identity_swap").when(F.col("gap") >= reid_gap, "re_identification_failure").when(F.col("gap") > 0, "fragmentation").when(F.col("nearby") > 0, "appearance_confusion").otherwise("association_error")
    return s.select("sequence", "frame", "gt_track_id", "old_id", "new_id", "gap", kind.alias("type"))


def taxonomy_rollup(events: DataFrame) -> DataFrame:
    """Counts and percentages (3 digits, 0 without events) of each type, for each sequence and for all (null)."""
    total = F.count("*")
    counts = [F.count_if(F.col("type") == t) for t in TYPES]
    share = [F.round(F.coalesce(F.try_divide(100.0 * c, total), F.lit(0.0)), 3) for c in counts]
    return events.rollup("sequence").agg(total.alias("total"), *[c.alias(t) for c, t in zip(counts, TYPES, strict=True)], *[s.alias(f"{t}_pct") for s, t in zip(share, TYPES, strict=True)])


def per_thousand_frames(switches: DataFrame, frames: DataFrame) -> DataFrame:
    n = frames.groupBy("sequence").agg(F.countDistinct("frame").alias("frames")).join(switches.groupBy("sequence").agg(F.count("*").alias("switches")), "sequence", "left")
    return n.select("sequence", "frames", F.coalesce("switches", F.lit(0)).alias("switches"), F.round(1000 * F.coalesce("switches", F.lit(0)) / F.col("frames"), 6).alias("per_1000"))


def kappa(first: DataFrame, second: DataFrame, keys: list[str], label: str) -> DataFrame:
    """One row: n, agreement (percent) and Cohen's kappa (1 where chance agreement is sure). Both must review the same events, else it raises."""
    both = first.select(*keys, F.col(label).alias("a")).join(second.select(*keys, F.col(label).alias("b")), keys, "full")
    pairs = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(W.partitionBy())
    # as many rows as there are pairs of labels
    pairs = pairs.withColumns({"whole": whole, "na": F.sum("n").over(W.partitionBy("a")), "nb": F.sum("n").over(W.partitionBy("b"))})
    fit = F.when(F.bool_or(F.col("a").isNull() | F.col("b").isNull()), F.raise_error(F.lit("the reviewers' events differ")).cast("double"))
    same = F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)) / F.max("whole")
    marginals = pairs.select("a", F.col("na")).distinct().join(pairs.select(F.col("b").alias("a"), "nb").distinct(), "a").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("chance"))
    s = pairs.agg(F.max("whole").alias("n"), same.alias("observed"), fit.alias("fit")).join(F.broadcast(marginals))  # one row each
    expected = F.col("chance") / (F.col("n") * F.col("n"))
    return s.select("n", F.round(100 * F.coalesce("fit", "observed"), 6).alias("agreement"), F.round(F.when(expected == 1, 1.0).otherwise((F.col("observed") - expected) / (1 - expected)), 6).alias("kappa"))
