"""Fusion of repeated label evidence: decayed votes, coarse and fine labels, attributes, bounded and aggregated memories, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

KEY = ["sequence", "track_id"]
#: Weight of each source of evidence (1 for others), and what a fine label of each type needs (0.92 for others).
SOURCE_WEIGHTS = {"qwen": 1.0, "locateanything": 0.9}
FINE_THRESHOLDS = {
    "role": 0.82,
    "subtype": 0.85,
    "species": 0.97,
    "breed": 0.97,
    "make": 0.95,
    "model": 0.97,
    "make_model": 0.97,
    "medical": 0.99,
    "diagnosis": 0.99,
    "identity": 0.99,
}
OTHER_FINE_THRESHOLD = 0.92


def lookup(table: dict, key: Column, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[key], F.lit(default))


def weighted(evidence: DataFrame, half_life: float = 900.0) -> DataFrame:
    """Adds source_weight and weight, which halves every half_life frames before the track's latest."""
    latest = F.max("frame").over(W.partitionBy(*KEY))
    source = lookup(SOURCE_WEIGHTS, F.col("source"), 1.0)
    return evidence.withColumn("source_weight", source).withColumn("weight", F.col("source_weight") * F.pow(F.lit(0.5), (latest - F.col("frame")) / F.lit(half_life)))


def ranked_labels(votes: DataFrame, label: str) -> DataFrame:
    """One row per track from votes (label, score, weight): the best two labels (ties to the lower name), consensus, absolute and fused confidence, margin."""
    order = W.partitionBy(*KEY).orderBy(F.desc(F.round("score", 12)), label)
    r = votes.withColumn("rank", F.row_number().over(order))
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    s = r.groupBy(*KEY).agg(first(label).alias("label"), first("score").alias("score"), first("weight").alias("weight"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"), F.sum("score").alias("total"), F.sum("n").alias("n"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    consensus, absolute = share(F.col("score"), F.col("total")), share(F.col("score"), F.col("weight"))
    return s.select(*KEY, "label", "n", consensus.alias("consensus"), absolute.alias("absolute"), (consensus * absolute).alias("confidence"), share(F.col("score") - F.col("second"), F.col("total")).alias("margin"))


def _votes(evidence: DataFrame, label: str, conf: str) -> DataFrame:
    return evidence.groupBy(*KEY, label).agg(F.sum(F.col(conf) * F.col("weight")).alias("score"), F.sum("weight").alias("weight"), F.sum(F.col(conf) * F.col("source_weight")).alias("steady"), F.count("*").alias("n"))


def label_transitions(evidence: DataFrame) -> DataFrame:
    """Per track the changes between the winning labels of consecutive frames."""
    frame = evidence.groupBy(*KEY, "frame", "label").agg(F.sum(F.col("conf") * F.col("source_weight")).alias("v"))
    win = frame.groupBy(*KEY, "frame").agg(F.min_by("label", F.struct(-F.round("v", 12), "label")).alias("label"))
    before = F.lag("label").over(W.partitionBy(*KEY).orderBy("frame"))
    return win.withColumn("before", before).groupBy(*KEY).agg(F.count("*").alias("frames"), F.count_if(F.col("before") != F.col("label")).alias("transitions"))


def fuse_labels(evidence: DataFrame, least: float = 0.45, margin: float = 0.10, stability: float = 0.60, half_life: float = 900.0) -> DataFrame:
    """The label of each track, `unknown` unless confidence, margin and stability over frames are enough. evidence: sequence, track_id, frame, label, conf, source."""
    w = weighted(evidence, half_life)
    votes = _votes(w, "label", "conf")
    steady = votes.groupBy(*KEY).agg(F.sum("steady").alias("all")).join(votes.select(*KEY, "label", "steady"), KEY)
    best = ranked_labels(votes, "label").join(steady, [*KEY, "label"]).join(label_transitions(w), KEY)
    held = F.col("steady") / F.greatest(F.col("all"), F.lit(1e-9))
    accepted = (F.col("label") != "unknown") & (F.col("confidence") >= least) & (F.col("margin") >= margin) & ((F.col("frames") < 2) | (held >= stability))
    rounded = [F.round(c, 6).alias(c) for c in ("confidence", "absolute", "consensus", "margin")]
    return best.select(*KEY, F.col("label").alias("best_label"), F.when(accepted, F.col("label")).otherwise("unknown").alias("label"), *rounded, F.round(held, 6).alias("temporal_stability"), "frames", "transitions", F.col("n").alias("evidence"), accepted.alias("accepted"))


def fuse_fine_labels(evidence: DataFrame, fused: DataFrame, least: float = 0.85, margin: float = 0.15, stability: float = 0.67, half_life: float = 900.0) -> DataFrame:
    """The fine label of each track with an accepted label. evidence also has fine_label, fine_conf and fine_type; at least two frames must support any fine label."""
    w = weighted(evidence, half_life).join(fused.where("accepted").select(*KEY, "label"), [*KEY, "label"])
    w = w.where((F.col("fine_conf") > 0) & ~F.coalesce(F.col("fine_label"), F.lit("")).isin("", "unknown") & (F.col("fine_label") != F.col("label")))
    votes = _votes(w, "fine_label", "fine_conf")
    steady = votes.groupBy(*KEY).agg(F.sum("steady").alias("all")).join(votes.select(*KEY, F.col("fine_label"), "steady"), KEY)
    frames = w.groupBy(*KEY).agg(F.countDistinct("frame").alias("frames"))
    typed = w.where("fine_type not in ('', 'unknown')").groupBy(*KEY, "fine_label", "fine_type").agg(F.sum("fine_conf").alias("v"))
    typed = typed.groupBy(*KEY, "fine_label").agg(F.min_by("fine_type", F.struct(-F.round("v", 12), "fine_type")).alias("fine_type"))
    best = ranked_labels(votes, "fine_label").withColumnRenamed("label", "fine_label").join(steady, [*KEY, "fine_label"]).join(frames, KEY).join(typed, [*KEY, "fine_label"], "left")
    kind = F.coalesce("fine_type", F.lit("subtype"))
    needed = F.greatest(F.lit(least), lookup(FINE_THRESHOLDS, kind, OTHER_FINE_THRESHOLD))
    held = F.col("steady") / F.greatest(F.col("all"), F.lit(1e-9))
    accepted = (F.col("confidence") >= needed) & (F.col("margin") >= margin) & (held >= stability) & (F.col("frames") >= 2)
    return best.select(*KEY, "fine_label", kind.alias("fine_type"), F.round("confidence", 6).alias("confidence"), needed.alias("needed"), F.round("margin", 6).alias("margin"), F.round(held, 6).alias("temporal_stability"), "frames", accepted.alias("accepted"))


def fuse_attributes(evidence: DataFrame) -> DataFrame:
    """Winning value of each attribute of each track, by sums of confidence; ties go to the value seen first. evidence has attributes (map) and event_id."""
    e = evidence.select(*KEY, "event_id", "conf", F.explode("attributes").alias("key", "value"))
    v = e.groupBy(*KEY, "key", "value").agg(F.sum("conf").alias("score"), F.min("event_id").alias("first"))
    return v.groupBy(*KEY, "key").agg(F.max_by(F.struct("value", "score"), F.struct(F.round("score", 9), -F.col("first"))).alias("b")).select(*KEY, "key", "b.value", "b.score")


def bounded_memory(evidence: DataFrame, n: int = 32) -> DataFrame:
    """Distinct evidence, the last n rows of each track by frame, source and label."""
    rows = evidence.select(*KEY, "frame", "label", "conf", "source").distinct()
    last = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("frame"), F.desc("source"), F.desc("label"), F.desc("conf")))
    return rows.withColumn("age_rank", last).where(F.col("age_rank") <= n)


def semantic_memory(evidence: DataFrame, usable_frames: int, top: int = 3, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Score and rank of each track of a sequence: share of usable frames, mean of the best `top` confidences, and consistency (support by matched frames)."""
    m = evidence.groupBy(*KEY).agg(F.countDistinct(F.when(F.col("conf") >= 0.5, F.col("frame"))).alias("support"), F.countDistinct("frame").alias("matched"))
    order = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("conf"), "frame"))
    best = evidence.withColumn("r", order).where(F.col("r") <= top).groupBy(*KEY).agg(F.avg("conf").alias("quality"))
    j = m.join(best, KEY)
    j = j.withColumns({"coverage": F.least(F.lit(1.0), F.col("support") / F.lit(float(usable_frames))), "consistency": F.coalesce(F.try_divide(F.col("support"), F.col("matched")), F.lit(0.0))})
    score = F.round(weights[0] * F.col("coverage") + weights[1] * F.col("quality") + weights[2] * F.col("consistency"), 9)
    j = j.withColumn("score", score)
    return j.withColumn("rank", F.row_number().over(W.partitionBy("sequence").orderBy(F.desc("score"), F.desc("support"), "track_id")))


def winner(ranked: DataFrame, least: float = 0.45, margin: float = 0.05) -> DataFrame:
    """Decision of each sequence: not_found under `least`, ambiguous within `margin` of the second (null when alone), else resolved."""
    top = ranked.where("rank <= 2").groupBy("sequence").agg(F.max(F.when(F.col("rank") == 1, F.struct("score", "track_id"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    gap = F.col("a.score") - F.col("second")
    status = F.when(F.col("a.score") < least, "not_found").when(gap < margin, "ambiguous").otherwise("resolved")
    return top.select("sequence", F.col("a.track_id").alias("track_id"), F.col("a.score").alias("score"), F.round(gap, 9).alias("margin"), status.alias("status"))


def score_with_missing(scores: dict[str, float], missing: str = "ignore") -> Column:
    """Weighted mean of columns. Of missing values the weight is left out (ignore) or kept with 0 (zero); null without any value."""
    got = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in scores.items()), F.lit(0.0))
    total = got if missing == "ignore" else F.when(got > 0, sum(scores.values()))
    return F.try_divide(sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in scores.items()), F.lit(0.0)), total)


def best_batch_prediction(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """The most confident prediction of each expected track (the first of equal ones), `unknown` for the others. rows outside their batch's expected tracks are dropped."""
    inside = rows.join(expected, ["batch", "track_id"], "left_semi")
    best = inside.groupBy("batch", "track_id").agg(F.max_by(F.struct("label", "conf"), F.struct("conf", -F.col("position"))).alias("b"))
    return expected.join(best, ["batch", "track_id"], "left").select("batch", "track_id", F.coalesce("b.label", F.lit("unknown")).alias("label"), F.coalesce("b.conf", F.lit(0.0)).alias("conf"))
