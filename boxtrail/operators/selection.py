"""Choosing few rows of many: spread-out evidence of a track, keyframes of a sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.operators.rounds import cut

KEY = ["sequence", "track_id"]


def spread_evidence(rows: DataFrame, most: int, weight: float = 0.25) -> DataFrame:
    """Of each track `most` rows: the best first, then each time that of the greatest quality + weight * distance to the nearest one chosen,
    as a share of the track's frames. Ties go to quality, then to the earlier frame.

    rows: sequence, track_id, frame (one row each), quality (null: 0) and others, which are kept; adds chosen, the turn from 1. All turns are
    windows over the same partitioning, so that rows are shuffled once.
    """
    track = W.partitionBy(*KEY)
    q, frame = F.coalesce("quality", F.lit(0.0)), F.col("frame")
    out = rows.withColumns({"_span": F.greatest(F.max("frame").over(track) - F.min("frame").over(track), F.lit(1)), "chosen": F.lit(None).cast("int"), "_near": F.lit(None).cast("long")})
    for turn in range(1, most + 1):
        score = q + F.coalesce(weight * (F.col("_near") / F.col("_span")), F.lit(0.0))
        best = F.max(F.when(F.col("chosen").isNull(), F.struct(score.alias("s"), q.alias("q"), (-frame).alias("f")))).over(track)
        out = out.withColumn("_pick", -best["f"])
        out = out.withColumns({"chosen": F.when(F.col("chosen").isNull() & (frame == F.col("_pick")), turn).otherwise(F.col("chosen")), "_near": F.least("_near", F.abs(frame - F.col("_pick")))})
    return out.where("chosen IS NOT NULL").drop("_span", "_near", "_pick")


def keyframes(candidates: DataFrame, most: int) -> DataFrame:
    """(sequence, frame, shot, why) of each sequence's keyframes. The best frame of each shot (of equal ones the earliest) represents it. Where there are too many shots,
    evenly spaced ones of these are kept; where slots are left, each goes to the frame that lies farthest from all kept, then to the better, then to the earlier.

    candidates: sequence, frame (one row each), shot, quality. A slot is one aggregation over all sequences at once.
    """
    c = cut(candidates.select("sequence", "frame", "shot", "quality"))
    best = F.max_by("frame", F.struct("quality", -F.col("frame"))).alias("frame")
    reps = c.groupBy("sequence", "shot").agg(best)
    sizes = c.groupBy("sequence").agg(F.least(F.count("*"), F.lit(most)).alias("slots"), F.countDistinct("shot").alias("shots"), F.greatest(F.max("frame") - 1, F.lit(1)).alias("scale"), F.max("quality").alias("top"))
    ranked = reps.withColumn("place", F.row_number().over(W.partitionBy("sequence").orderBy("frame")) - 1).join(sizes, "sequence")
    slot = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot")
    many = sizes.where("shots >= slots").select("sequence", "slots", "shots", slot)
    even = F.when(F.col("slot") == 0, F.lit(0)).when(F.col("slot") == F.col("slots") - 1, F.col("shots") - 1).otherwise(F.floor(F.col("slot") * ((F.col("shots") - 1) / (F.col("slots") - 1))))
    evenly = ranked.where("shots >= slots").join(many.select("sequence", even.alias("place")).distinct(), ["sequence", "place"]).select("sequence", "frame", "shot", F.lit("even").alias("why"))
    few = ranked.where("shots < slots").select("sequence", "frame", "shot", F.lit("shot").alias("why"))
    order = W.partitionBy("sequence").orderBy("frame")
    kept = F.when(F.col("why").isNotNull(), F.col("frame"))
    open_ = c.join(sizes.where("shots < slots"), "sequence").join(few.select("sequence", "frame", "why"), ["sequence", "frame"], "left")
    open_ = open_.withColumns({"_a": F.last(kept, True).over(order), "_b": F.first(kept, True).over(order.rowsBetween(0, W.unboundedFollowing))})
    open_ = cut(open_.withColumn("near", F.least(F.col("frame") - F.col("_a"), F.col("_b") - F.col("frame"))).drop("_a", "_b"))
    for turn in range(1, most):
        score = F.struct((F.col("near") / F.col("scale")).alias("d"), (F.col("quality") / F.when(F.col("top") == 0, 1.0).otherwise(F.col("top"))).alias("q"), (-F.col("frame")).alias("f"))
        pick = open_.where(F.col("why").isNull() & (F.col("shots") + turn <= F.col("slots"))).groupBy("sequence").agg((-F.max(score)["f"]).alias("_pick"))
        if (pick := cut(pick)).isEmpty():
            break
        open_ = open_.join(pick, "sequence", "left")  # one row for each sequence
        is_it = F.col("frame") == F.col("_pick")
        open_ = cut(open_.withColumns({"why": F.when(is_it, "far").otherwise(F.col("why")), "near": F.least("near", F.abs(F.col("frame") - F.col("_pick")))}).drop("_pick"))
    return evenly.unionByName(open_.where("why IS NOT NULL").select("sequence", "frame", "shot", "why"))
