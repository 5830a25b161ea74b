"""Joins of predictions to truth, label completion, splits, run and benchmark reports."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.functions.scalars import ratio_or_null

MISSING = "missing_prediction"


def with_predictions(truth: DataFrame, predictions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """truth with the columns of its prediction; of several with the same keys the last by order counts. status is MISSING where there is none."""
    names = [c for c in predictions.columns if c not in keys and c != order]
    last = predictions.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("p")).select(*keys, "p.*")
    return truth.join(last, keys, "left").withColumn("status", F.coalesce("status", F.lit(MISSING)))


def with_first_evidence(candidates: DataFrame, evidence: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """candidates with the first evidence of their keys by order; available says whether there is any."""
    first = evidence.groupBy(*keys).agg(F.min_by(value, order).alias(value), F.lit(True).alias("available"))
    return candidates.join(first, keys, "left").withColumn("available", F.coalesce("available", F.lit(False)))


def metric_of(rows: DataFrame, key: str, wanted: DataFrame, value: str) -> DataFrame:
    """wanted (key) with the value of the one row of that key; none or several raise."""
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.first(value).alias(value))
    one = F.when(F.coalesce("n", F.lit(0)) == 1, F.col(value)).otherwise(F.raise_error(F.concat(F.lit("not one row for "), F.col(key).cast("string"))).cast("double"))
    return wanted.join(found, key, "left").select(key, one.alias(value))


def scored_partition(tracks: DataFrame, matched: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """tracks with label and scored: those without a match are unknown truth (policy keep) or left out of the score (exclude)."""
    if policy not in ("keep", "exclude"):
        raise ValueError(f"unknown policy {policy}")
    j = tracks.join(matched, keys, "left")
    return j.withColumns({"scored": F.col("label").isNotNull() | F.lit(policy == "keep"), "label": F.coalesce("label", F.lit("unknown"))})


def manifest_record(boxes: DataFrame) -> DataFrame:
    """Counts of each sequence as the files have them: repeated and invalid boxes count."""
    return boxes.groupBy("sequence").agg(F.count("*").alias("boxes"), F.countDistinct("frame").alias("frames"), F.countDistinct("track_id").alias("tracks"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


def split_counts(total: int, ratios: tuple[float, float, float]) -> tuple[int, int, int]:
    """Sizes of train, val and test. From three rows on, and with all ratios above 0, each gets one at least, and what is too much is taken from the largest
    split (of equal ones the first) that has one to spare; otherwise test gets what is left."""
    train, val = round(total * ratios[0]), round(total * ratios[1])
    if total < 3 or min(ratios) <= 0:
        return max(0, train), max(0, val), max(0, total - train - val)
    sizes = [max(1, train), max(1, val)]
    sizes.append(max(1, total - sum(sizes)))
    while sum(sizes) > total:
        sizes[max((0, 1, 2), key=lambda i: (sizes[i] > 1, sizes[i], -i))] -= 1
    return tuple(sizes)


def ratio_split(names: DataFrame, name: str, ratios: tuple[float, float, float], seed: int = 42) -> DataFrame:
    """(name, split): names in the order of a seeded MD5, cut by split_counts. The order is the hash's, not a random generator's.
    One row for each sequence reaches the window; their number alone goes to the driver."""
    w = W.partitionBy().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(name))), name)
    r = names.select(name).distinct()
    train, val, _ = split_counts(r.count(), ratios)
    i = F.row_number().over(w)
    return r.select(name, F.when(i <= train, "train").when(i <= train + val, "val").otherwise("test").alias("split"))


def calls_per_1000(calls: Column, frames: Column) -> Column:
    return ratio_or_null(1000.0 * calls, frames)


def track_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates of a team benchmark over track rows (team, predicted, role, predicted_role, status); null without a row that counts."""
    share = lambda test, of=None: F.avg((test if of is None else F.when(of, test)).cast("double"))
    right = F.coalesce(F.col("team") == F.col("predicted"), F.lit(False))
    role = F.col("role").isNotNull()
    return rows.groupBy(*by).agg(
        F.count("*").alias("tracks"),
        share(right).alias("team_accuracy"),
        share(F.col("status") != MISSING).alias("coverage"),
        share(F.col("status").isin("unknown", "not_found", MISSING)).alias("unknown_rate"),
        share((F.col("status") == "resolved") & ~right).alias("wrong_team_rate"),
        share(F.coalesce(F.col("role") == F.col("predicted_role"), F.lit(False)), role).alias("role_accuracy"),
    )


def query_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rates of a team benchmark over query rows (track, selected, team_correct, status, support, calls, seconds); null without a row that counts."""
    share = lambda test: F.avg(F.coalesce(test, F.lit(False)).cast("double"))
    hit = F.col("track") == F.col("selected")
    return rows.groupBy(*by).agg(
        F.count("*").alias("queries"),
        share(F.col("status") == "resolved").alias("resolved_rate"),
        share(F.col("status") == "ambiguous").alias("ambiguous_rate"),
        share(F.col("status").isin("not_found", "unknown", MISSING)).alias("not_found_rate"),
        share(hit).alias("track_accuracy"),
        share(hit & F.col("team_correct")).alias("track_and_team_rate"),
        F.avg("support").alias("support"),
        F.avg("calls").alias("calls"),
        F.avg("seconds").alias("seconds"),
    )


def run_summary(sequences: DataFrame) -> DataFrame:
    """One row for a run from rows (frames, detections, tracks, seconds): sums, and frames a second, null without time."""
    total = [F.sum(c).alias(c) for c in ("frames", "detections", "tracks", "seconds")]
    return sequences.agg(F.count("*").alias("sequences"), *total).withColumn("fps", ratio_or_null(F.col("frames"), F.col("seconds")))


def pipeline_costs(runs: DataFrame) -> DataFrame:
    """runs (frames, tracking_fps, load, inference, peak_a, peak_b) with cold_fps, over the time of tracking and of the models with their loading, and the greatest peak of a component."""
    cold = F.coalesce("load", F.lit(0.0)) + F.coalesce("inference", F.lit(0.0))
    tracking = F.when((F.col("frames") > 0) & (F.col("tracking_fps") > 0), F.col("frames") / F.col("tracking_fps"))
    fps = F.when(tracking.isNotNull() & (cold > 0), F.col("frames") / (tracking + cold)).otherwise(F.col("tracking_fps"))
    return runs.withColumns({"cold_seconds": cold, "cold_fps": fps, "peak": F.greatest("peak_a", "peak_b")})


def complete_labels(tracks: DataFrame, reviewed: DataFrame, nearest: DataFrame, keys: list[str], least: int = 6) -> DataFrame:
    """Labels of all tracks (keys, n): a reviewed one is sure; with fewer than `least` rows, or without a nearest prototype, unknown; else that of the nearest prototype
    (keys, near, closeness). reason says which."""
    j = tracks.join(reviewed.select(*keys, F.col("label").alias("own")), keys, "left").join(nearest.select(*keys, "near", "closeness"), keys, "left")
    reason = F.when(F.col("own").isNotNull(), "reviewed").when(F.col("n") < least, "too_few_rows").when(F.col("near").isNull(), "no_feature").otherwise("prototype")
    label = F.when(reason == "reviewed", F.col("own")).when(reason == "prototype", F.col("near")).otherwise("unknown")
    confidence = F.when(reason == "reviewed", 1.0).when(reason == "prototype", F.col("closeness")).otherwise(0.0)
    return j.select(*keys, label.alias("label"), confidence.alias("confidence"), reason.alias("reason"))


def margin_signal(rows: DataFrame, keys: list[str], order: str, margin: str, threshold: float) -> DataFrame:
    """The first margin that is not null of each group: whether it is below the threshold, and high below half of it; info without any."""
    first = rows.groupBy(*keys).agg(F.min_by(margin, F.when(F.col(margin).isNotNull(), F.col(order))).alias("score"))
    severity = F.when(F.col("score").isNull(), "info").when(F.col("score") < threshold * 0.5, "high").otherwise("warning")
    return first.select(*keys, "score", F.coalesce(F.col("score") < threshold, F.lit(False)).alias("triggered"), severity.alias("severity"))


def shot_representatives(rows: DataFrame, keys: list[str], order: str, starts: Column, quality: str) -> DataFrame:
    """shot (a count of starts so far) of each group with its best row, the earlier of equal ones, and how many rows it has."""
    shot = F.sum(starts.cast("int")).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    r = rows.withColumn("shot", shot)
    return r.groupBy(*keys, "shot").agg(F.max_by(order, F.struct(quality, -F.col(order))).alias("representative"), F.max(quality).alias("quality"), F.count("*").alias("rows"))


def winner_delta(rows: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """The winner of each group, the first other in order of value, and the difference; ties go to the lower name."""
    order = W.partitionBy(*by).orderBy(F.desc(value), name)
    r = rows.withColumn("_i", F.row_number().over(order)).where("_i <= 2")
    at = lambda i, c: F.max(F.when(F.col("_i") == i, F.col(c)))
    return r.groupBy(*by).agg(at(1, name).alias("winner"), at(2, name).alias("reference"), (at(1, value) - at(2, value)).alias("delta"))


def best_association(rows: DataFrame, request: str, order: str) -> DataFrame:
    """rows with accepted held to one for each request: the greatest confidence, margin and score, the first of equals. reason is set where it is taken away."""
    best = rows.where("accepted").groupBy(request).agg(F.max_by(order, F.struct("confidence", "margin", "score", -F.col(order))).alias("_best"))
    j = rows.join(best, request, "left")
    lost = F.col("accepted") & (F.col(order) != F.col("_best"))
    return j.withColumns({"reason": F.when(lost, "lower_ranked_grounding_candidate"), "accepted": F.col("accepted") & ~F.coalesce(lost, F.lit(False))}).drop("_best")


def parameter_grid(baseline: dict, grid: dict[str, list], most: int) -> list[dict]:
    """The baseline, then all combinations of the grid in sorted order of keys that differ from it, `most` in all. Plain values of a configuration."""
    keys = sorted(grid)
    runs = [baseline] + [run for run in (baseline | dict(zip(keys, v, strict=True)) for v in product(*[grid[k] for k in keys])) if run != baseline]
    return runs[:most]


def tagged_union(streams: dict[str, DataFrame], tag: str = "stream") -> DataFrame:
    """Rows of several streams with the name of theirs; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in streams.items()])
