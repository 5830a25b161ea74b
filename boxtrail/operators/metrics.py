"""Evaluation: precision and recall, confusion, language metrics over frames, reacquisition, CLEAR and identity metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.functions.scalars import f1, ratio_or_null, ratio_or_zero
from boxtrail.operators.hota import identity_matches, identity_true_positives
from boxtrail.operators.rounds import cut
from boxtrail.operators.tracks import runs

BUCKET = 64  # frames by which chances and rows meet


def label_prf(rows: DataFrame, gt: str, pred: str) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 (0 on empty denominators, 6 digits) of every label on either side. One shuffle: each row is exploded into its labels."""
    e = rows.select(F.explode(F.array_distinct(F.array(gt, pred))).alias("label"), gt, pred).where("label is not null")
    is_ = lambda c: F.coalesce(F.col(c) == F.col("label"), F.lit(False))
    c = e.groupBy("label").agg(F.count_if(is_(gt) & is_(pred)).alias("tp"), F.count_if(~is_(gt) & is_(pred)).alias("fp"), F.count_if(is_(gt) & ~is_(pred)).alias("fn"))
    p, r = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp")), ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("label", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def macro_f1(prf: DataFrame) -> DataFrame:
    """Mean of the rounded F1 of labels that occur in the ground truth, but unknown."""
    return prf.where("tp + fn > 0 and label <> 'unknown'").agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.count("*").alias("labels"))


def confusion(rows: DataFrame, gt: str, pred: str, labels: list[str]) -> DataFrame:
    """Counts by gt label, a column for each predicted label and `__missing__`."""
    filled = rows.select(F.col(gt).alias("gt"), F.coalesce(F.col(pred), F.lit("__missing__")).alias("pred"))
    return filled.groupBy("gt").pivot("pred", [*labels, "__missing__"]).count().na.fill(0)


def semantic_rates(rows: DataFrame) -> DataFrame:
    """accuracy, coverage, selective accuracy and hallucination from gt, label and accepted; unknown F1 is null without unknowns."""
    used = F.coalesce(F.col("accepted") & (F.col("label") != "unknown"), F.lit(False))
    right = used & (F.col("label") == F.col("gt"))
    unknown = F.col("gt") == "unknown"
    n, tp, fp, fn = F.count("*"), F.count_if(unknown & ~used), F.count_if(~unknown & ~used), F.count_if(unknown & used)
    return rows.agg(
        n.alias("n"),
        ratio_or_zero(F.count_if(right | (unknown & ~used)), n).alias("accuracy"),
        ratio_or_zero(F.count_if(used), n).alias("coverage"),
        ratio_or_zero(F.count_if(right), F.count_if(used)).alias("selective_accuracy"),
        ratio_or_zero(F.count_if(used & ~right), F.count_if(used)).alias("hallucination"),
        F.when(F.count_if(unknown) > 0, ratio_or_zero(2 * tp, 2 * tp + fp + fn)).alias("unknown_f1"),
    )


def language_frames(spine: DataFrame, gt: DataFrame, pred: DataFrame, correct: DataFrame) -> DataFrame:
    """Per query: frames, gt, predicted and correct counts, precision, recall and F1 (null on empty denominators), first frame with a prediction.

    spine: query, frame; gt, pred and correct: query, frame, n.
    """
    j = spine
    for name, df in (("gt", gt), ("pred", pred), ("correct", correct)):
        j = j.join(df.select("query", "frame", F.col("n").alias(name)), ["query", "frame"], "left")
    j = j.na.fill(0, ["gt", "pred", "correct"])
    s = j.groupBy("query").agg(F.count("*").alias("frames"), *[F.sum(c).alias(c) for c in ("gt", "pred", "correct")], F.min(F.when(F.col("pred") > 0, F.col("frame"))).alias("first_predicted"), F.min_by(F.col("correct") > 0, F.when(F.col("pred") > 0, F.col("frame"))).alias("initial_correct"))
    p, r = ratio_or_null(F.col("correct"), F.col("pred")), ratio_or_null(F.col("correct"), F.col("gt"))
    return s.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p.isNotNull() & r.isNotNull(), f1(p, r)), 6).alias("f1"))


def micro_macro(queries: DataFrame, by: list[str]) -> DataFrame:
    """Micro and macro precision and recall, over all and by each of the columns (in one pass over grouping sets)."""
    p, r = ratio_or_null(F.sum("correct"), F.sum("pred")), ratio_or_null(F.sum("correct"), F.sum("gt"))
    return queries.groupingSets([[], *[[c] for c in by]], *by).agg(F.count("*").alias("queries"), F.round(p, 6).alias("micro_precision"), F.round(r, 6).alias("micro_recall"), F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"))


def longest_run(frames: DataFrame, keys: list[str]) -> DataFrame:
    return runs(frames, keys).groupBy(*keys).agg(F.max("run_length").alias("longest"))


def target_switches(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of two or more wrong predictions after the first right one. frames: keys, frame, predicted, correct (booleans); rows without a prediction neither end nor extend a run."""
    first = frames.where("correct").groupBy(*keys).agg(F.min("frame").alias("first"))
    seen = frames.where("predicted").join(first, keys).where("frame > first")
    w = W.partitionBy(*keys).orderBy("frame")
    grouped = seen.withColumn("group", F.sum(F.col("correct").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    wrong = grouped.where("not correct").groupBy(*keys, "group").agg(F.count("*").alias("n")).where("n >= 2")
    return frames.select(*keys).distinct().join(wrong.groupBy(*keys).agg(F.count("*").alias("switches")), keys, "left").na.fill(0, ["switches"])


def reacquisition(chances: DataFrame, correct: DataFrame) -> DataFrame:
    """Success and delay of each chance (event, sequence, reappear, last) by the correct frames (sequence, frame) in its window."""
    spread = chances.where(F.col("reappear") <= F.col("last")).select("event", "sequence", "reappear", "last", F.explode(F.sequence(F.floor(F.col("reappear") / BUCKET), F.floor(F.col("last") / BUCKET))).alias("bucket"))
    near = spread.join(correct.select("sequence", "frame", F.floor(F.col("frame") / BUCKET).alias("bucket")), ["sequence", "bucket"])
    hit = near.where(F.col("frame").between(F.col("reappear"), F.col("last"))).groupBy("event").agg(F.min("frame").alias("start"))
    return chances.join(hit, "event", "left").select("event", F.col("start").isNotNull().alias("success"), F.greatest(F.lit(0), F.col("start") - F.col("reappear")).alias("delay"))


def clear_mot(matches: DataFrame, gt: DataFrame, pred: DataFrame, switches: DataFrame) -> DataFrame:
    """MOTA, MOTP, precision and recall of each sequence, from one-to-one matches (Bernardin and Stiefelhagen 2008)."""
    n = lambda df, name: df.groupBy("sequence").agg(F.count("*").alias(name))
    m = matches.groupBy("sequence").agg(F.count("*").alias("tp"), F.avg("iou").alias("motp"))
    j = n(gt, "gt").join(n(pred, "pred"), "sequence", "full").join(m, "sequence", "left").join(n(switches, "idsw"), "sequence", "left").na.fill(0, ["gt", "pred", "tp", "idsw"])
    fn, fp = F.col("gt") - F.col("tp"), F.col("pred") - F.col("tp")
    return j.select("sequence", "gt", "pred", "tp", fn.alias("fn"), fp.alias("fp"), "idsw", F.round(1 - ratio_or_null(fn + fp + F.col("idsw"), F.col("gt")), 6).alias("mota"), F.round("motp", 6).alias("motp"), F.round(ratio_or_null(F.col("tp"), F.col("pred")), 6).alias("precision"), F.round(ratio_or_null(F.col("tp"), F.col("gt")), 6).alias("recall"))


def identity_metrics(pairs: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """IDF1, IDP and IDR of each sequence (Ristani et al. 2016): tracks are assigned one to one for the most frames in common.

    pairs: sequence, gt_track_id, pred_track_id of boxes that overlap enough.
    """
    return _identity(identity_true_positives(pairs), gt, pred)


def identity_of_boxes(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """identity_metrics from boxes that overlap by an IoU of at least `least`."""
    gt, pred = (cut(df.select("sequence", "frame", "track_id", "x", "y", "w", "h")) for df in (gt, pred))
    return _identity(identity_matches(gt, pred, least), gt, pred)


def _identity(idtp: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    n = lambda df, name: df.groupBy("sequence").agg(F.count("*").alias(name))
    j = n(gt, "gt").join(n(pred, "pred"), "sequence", "full").join(idtp, "sequence", "left").na.fill(0, ["gt", "pred", "idtp"])
    r = lambda a, b: F.round(ratio_or_null(a, b), 6)
    return j.select("sequence", "idtp", r(2 * F.col("idtp"), F.col("gt") + F.col("pred")).alias("idf1"), r(F.col("idtp"), F.col("pred")).alias("idp"), r(F.col("idtp"), F.col("gt")).alias("idr"))


def profile(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and population deviation (0 for one row)."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"))


def review_progress(rows: DataFrame, reviewer: str) -> DataFrame:
    done = F.col("status") == "reviewed"
    return rows.groupBy(reviewer).agg(F.count("*").alias("n"), F.count_if(done).alias("reviewed"), F.round(100 * ratio_or_zero(F.count_if(done), F.count("*")), 6).alias("coverage"), F.round(100 * ratio_or_zero(F.count_if(done & (F.col("label") == F.col("suggested"))), F.count_if(done)), 6).alias("agreement"))


def rank_trackers(rows: DataFrame, zero_is_missing: bool = False) -> DataFrame:
    """Trackers by HOTA, IDF1, AssA (falling), IDSW, Frag (rising), MOTA, fps (falling), missing values last; with zero_is_missing by the five keys hota, idf1, mota, idsw, fps where 0 counts as missing."""
    if zero_is_missing:
        v = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(d))
        order = [v("hota", -1.0).desc(), v("idf1", -1.0).desc(), v("mota", -1.0).desc(), v("idsw", 1e12).asc(), v("fps", -1.0).desc(), F.col("tracker")]
    else:
        order = [F.desc_nulls_last("hota"), F.desc_nulls_last("idf1"), F.desc_nulls_last("assa"), F.asc_nulls_last("idsw"), F.asc_nulls_last("frag"), F.desc_nulls_last("mota"), F.desc_nulls_last("fps"), F.col("tracker")]
    return rows.withColumn("place", F.row_number().over(W.partitionBy().orderBy(*order)))  # a row for each tracker
