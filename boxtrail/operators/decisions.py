"""Decisions and reports over tracks: colours, fused scores, gates, failure ladders, coverage, costs, set comparisons, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.functions import geometry as g
from boxtrail.functions.scalars import ratio_or_null, ratio_or_zero

#: Hue, saturation and value bounds of colours, 8-bit scales with hue to 180; nothing below a value of 25 has a colour. The last match wins.
COLOURS = (
    ("black", "s < 48 and v < 68"),
    ("gray", "s < 48 and v >= 68 and v < 132"),
    ("silver", "s < 48 and v >= 132 and v < 205"),
    ("white", "s < 48 and v >= 205"),
    ("red", "s >= 48 and (h < 10 or h >= 170)"),
    ("orange", "s >= 48 and h >= 10 and h < 22 and v >= 145"),
    ("brown", "s >= 48 and h >= 10 and h < 25 and v < 145"),
    ("yellow", "s >= 48 and h >= 22 and h < 38"),
    ("green", "s >= 48 and h >= 38 and h < 85"),
    ("blue", "s >= 48 and h >= 85 and h < 140"),
)
#: Failure categories in order, with severity and condition.
FAILURES = (
    ("initial_selection_error", "high", "initial_correct = false"),
    ("low_precision", "medium", "precision < 0.5"),
    ("low_recall", "medium", "recall < 0.5"),
    ("semantic_target_switch", "high", "switches > 0"),
    ("reacquisition_failed", "medium", "chances > 0 and recovered = 0"),
)


def colour() -> Column:
    """Colour name of columns h, s, v; null where too dark or between the bounds."""
    found = [F.when(F.expr(f"v >= 25 and {test}"), name) for name, test in COLOURS]
    return F.coalesce(*reversed(found))


def dominant_colour(pixels: DataFrame, by: list[str], least: int = 80, share: float = 0.40) -> DataFrame:
    """The most frequent colour of each group of pixels, null under `least` coloured pixels or a smaller share; ties go to the lower name."""
    n = pixels.withColumn("colour", colour()).where("colour is not null").groupBy(*by, "colour").agg(F.count("*").alias("n"))
    top = n.groupBy(*by).agg(F.min_by(F.struct("colour", "n"), F.struct(-F.col("n"), "colour")).alias("b"), F.sum("n").alias("all"))
    good = (F.col("all") >= least) & (F.col("b.n") / F.col("all") >= share)
    return top.select(*by, F.when(good, F.col("b.colour")).alias("colour"), F.round(F.col("b.n") / F.col("all"), 6).alias("confidence"), F.col("all").alias("pixels"))


def colour_features(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Circular mean of the hue and medians of saturation and value."""
    angle = F.col("h") * (2 * 3.141592653589793 / 180)
    return pixels.groupBy(*by).agg(F.avg(F.cos(angle)).alias("hue_cos"), F.avg(F.sin(angle)).alias("hue_sin"), F.median("s").alias("s"), F.median("v").alias("v"))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms, 0 for equal shapes and 1 for disjoint ones."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - common / F.sqrt(total(a) * total(b))))


def fuse_scores(semantic: DataFrame, appearance: DataFrame, weight: float = 0.6, missing: str = "keep", penalty: float = 0.1) -> DataFrame:
    """Weighted semantic and appearance scores within 0 and 1, ranked; without an appearance the semantic score is kept or penalized."""
    alone = F.col("semantic") if missing == "keep" else F.greatest(F.lit(0.0), F.col("semantic") - penalty)
    fused = F.coalesce(weight * F.col("semantic") + (1 - weight) * F.col("appearance"), alone)
    j = semantic.join(appearance, ["sequence", "track_id"], "left").withColumn("fused", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fused)), 9))
    return j.withColumn("rank", F.row_number().over(W.partitionBy("sequence").orderBy(F.desc("fused"), F.desc("semantic"), "track_id")))


def identity_scoped(pairs: DataFrame, expected: Column, least: float = 0.35, margin: float = 0.05) -> DataFrame:
    """For each box its best expected track against the best other one: accepted with enough score and lead, else the first reason.

    pairs: sequence, frame, box, track, score.
    """
    best = lambda test: F.max(F.when(test, F.struct("score", -F.col("track"))))
    s = pairs.groupBy("sequence", "frame", "box").agg(best(expected).alias("t"), best(~expected).alias("o"))
    return scoped(s.select("sequence", "frame", "box", F.col("t.score").alias("score"), F.col("o.score").alias("other")), least, margin)


def scoped(s: DataFrame, least: float = 0.35, margin: float = 0.05) -> DataFrame:
    """identity_scoped from each box's best expected score and the best other, as in matching.scoped_scores."""
    score, lead = F.col("score"), F.col("score") - F.coalesce(F.col("other"), F.lit(0.0))
    reason = F.when(score.isNull(), "not_identity_scoped").when(score < least, "insufficient_target_overlap").when(lead < margin, "insufficient_identity_margin")
    return s.select("sequence", "frame", "box", score.alias("score"), lead.alias("lead"), reason.alias("reason"))


def session_margin(ranked: DataFrame, target: Column) -> DataFrame:
    """Score of the target less that of the best other candidate (negative where another leads), by sequence."""
    s = ranked.groupBy("sequence").agg(F.max(F.when(target, F.col("score"))).alias("score"), F.max(F.when(~target, F.col("score"))).alias("other"))
    return s.withColumn("margin", F.col("score") - F.col("other"))


def failure(status: str = "status") -> Column:
    """Category of a query's failure: by status if not resolved, else the first of the ladder; null without one."""
    out = F.when(F.coalesce(F.col(status), F.lit("missing_prediction")) != "resolved", F.concat(F.lit("query_"), F.coalesce(F.col(status), F.lit("missing_prediction"))))
    for name, _, test in FAILURES:
        out = out.when(F.coalesce(F.expr(test), F.lit(False)), name)
    return out


def failure_counts(queries: DataFrame) -> DataFrame:
    return queries.withColumn("category", failure()).where("category is not null").groupBy("category").agg(F.count("*").alias("n"))


def label_coverage(boxes: DataFrame, labels: DataFrame) -> DataFrame:
    """Shares of tracks and boxes with an accepted label, and with any (labels: sequence, track_id, accepted, fallback); 0 when empty."""
    j = boxes.groupBy("sequence", "track_id").agg(F.count("*").alias("boxes")).join(labels, ["sequence", "track_id"], "left").na.fill(False, ["accepted", "fallback"])
    any_ = F.col("accepted") | F.col("fallback")
    boxes_of = lambda test: F.coalesce(F.sum(F.when(test, F.col("boxes"))), F.lit(0))
    n, m = F.count("*"), F.sum("boxes")
    return j.groupBy("sequence").agg(
        n.alias("tracks"),
        m.alias("boxes"),
        F.round(ratio_or_zero(F.count_if(F.col("accepted")), n), 6).alias("track_coverage"),
        F.round(ratio_or_zero(boxes_of(F.col("accepted")), m), 6).alias("box_coverage"),
        F.round(ratio_or_zero(F.count_if(any_), n), 6).alias("label_track_coverage"),
        F.round(ratio_or_zero(boxes_of(any_), m), 6).alias("label_box_coverage"),
    )


def cost_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Events, seconds, seconds per track and tracks per minute (null on empty denominators)."""
    s, t = F.sum("seconds"), F.sum("tracks")
    return runs.groupBy(*by).agg(F.count("*").alias("events"), F.round(s, 6).alias("seconds"), F.round(ratio_or_null(s, t), 6).alias("seconds_per_track"), F.round(ratio_or_null(60 * t, s), 6).alias("tracks_per_minute"))


def delta_to_baseline(rows: DataFrame, by: list[str], baseline: Column, value: str) -> DataFrame:
    """Percent by which each row's value lies below that of the baseline of its group."""
    base = F.max(F.when(baseline, F.col(value))).over(W.partitionBy(*by))
    return rows.withColumn("reduction", F.round(100 * F.try_divide(base - F.col(value), base), 6))


def in_all(rows: DataFrame, member: str, groups: str) -> DataFrame:
    """Members that occur in every group."""
    n = rows.select(groups).distinct().count()  # one number
    return rows.groupBy(member).agg(F.countDistinct(groups).alias("n")).where(F.col("n") == n).select(member)


def set_match(rows: DataFrame, want: str, got: str) -> DataFrame:
    """Adds exact (equal sets, never for empty ones), hit (any in common), tp, fp and fn of two array columns."""
    a, b = F.array_sort(F.array_distinct(want)), F.array_sort(F.array_distinct(got))
    return rows.withColumns({"exact": (a == b) & (F.size(a) > 0), "hit": F.arrays_overlap(a, b), "tp": F.size(F.array_intersect(a, b)), "fp": F.size(F.array_except(b, a)), "fn": F.size(F.array_except(a, b))})


def merged(first: DataFrame, second: DataFrame, keys: list[str], columns: list[str], override: bool = False) -> DataFrame:
    """Both tables by key; the second fills what is missing in the first, or with override replaces it."""
    j = first.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns]).join(second.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns]), keys, "full")
    pick = lambda c: F.coalesce(*[F.col(x) for x in ((f"_b_{c}", f"_a_{c}") if override else (f"_a_{c}", f"_b_{c}"))])
    return j.select(*keys, *[pick(c).alias(c) for c in columns])


def routed(rows: DataFrame, routes: DataFrame, default: str) -> DataFrame:
    """Adds route by class (routes: class, route; a small table)."""
    return rows.join(F.broadcast(routes), "class", "left").withColumn("route", F.coalesce("route", F.lit(default)))


def global_ids(rows: DataFrame) -> DataFrame:
    """Adds global_id: (route, track_id) numbered from 1 in order of first frame, route and track, within a sequence."""
    first = rows.groupBy("sequence", "route", "track_id").agg(F.min("frame").alias("first"))
    n = first.withColumn("global_id", F.row_number().over(W.partitionBy("sequence").orderBy("first", "route", "track_id")))
    return rows.join(n.drop("first"), ["sequence", "route", "track_id"])


def detector_route() -> Column:
    """Detector by rules on domain (text) and objects (array), in order: none, microscopy, football, general."""
    has = lambda *w: F.arrays_overlap(F.col("objects"), F.array(*[F.lit(x) for x in w]))
    return F.when(F.size("objects") == 0, "fallback").when(F.lower("domain").rlike("microscop|cell") | has("cell"), "microscopy").when(F.lower("domain").rlike("football|soccer") & has("player", "ball", "referee"), "football").otherwise("general")


def with_majority(rows: DataFrame, by: list[str], label: str, n: int) -> DataFrame:
    """The most frequent label of groups of at least n rows, else unknown; ties go to the lower label."""
    c = rows.groupBy(*by, label).agg(F.count("*").alias("n"))
    t = c.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("n"), label)).alias("best"), F.sum("n").alias("rows"))
    return t.select(*by, F.when(F.col("rows") >= n, F.col("best")).otherwise("unknown").alias("label"), "rows")


def class_aware_pairs(gt: DataFrame, pred: DataFrame, least: float) -> DataFrame:
    """Pairs of boxes of a frame and class with an IoU of at least `least`: a class gate as an equality of the join."""
    a, b = g.corners("g.x", "g.y", "g.w", "g.h"), g.corners("p.x", "p.y", "p.w", "p.h")
    same = (F.col("g.sequence") == F.col("p.sequence")) & (F.col("g.frame") == F.col("p.frame")) & (F.col("g.class") == F.col("p.class"))
    v = g.iou(a, b)
    return gt.alias("g").join(pred.alias("p"), same).where(v >= least).select("g.sequence", "g.frame", "g.class", F.col("g.track_id").alias("gt_track_id"), F.col("p.track_id").alias("pred_track_id"), v.alias("iou"))
