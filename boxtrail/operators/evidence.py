"""Evidence of targets: what supports a candidate, what is known of a target in each frame, what should be looked at again, and which label is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.functions import geometry as g
from boxtrail.functions.labels import display_label

KEY = ["sequence", "track_id"]
FRAME = ["sequence", "frame"]
#: Frames of one row while the frames of a sequence are laid out.
BLOCK = 4096


def grounding_evidence(candidates: DataFrame, found: DataFrame, obs: DataFrame, width: float, height: float) -> DataFrame:
    """(sequence, track_id, score, frames, reason) of each candidate: how well grounded boxes fit its own.

    A pair of boxes of one frame scores .55 IoU + .30 share of the track's box that is covered + .15 closeness of centres; the best of each frame counts, and the mean
    over the frames that have both. Without such a frame the score is 0; in a sequence without any result it is null.

    candidates: sequence, track_id (one row each). found: one row for each box of a result, sequence, frame, x, y, w, h; a result without a box is a row without
    coordinates, one whose frame isn't known a row without a frame. obs: one row for each track and frame.
    """
    mine = obs.join(candidates.select(*KEY), KEY, "left_semi").select(*KEY, "frame", *[F.col(c).alias(f"t{c}") for c in "xywh"])
    pairs = mine.join(found.where("x IS NOT NULL").select(*FRAME, "x", "y", "w", "h"), FRAME)
    box, track = g.corners("x", "y", "w", "h"), g.corners("tx", "ty", "tw", "th")
    near = F.greatest(F.lit(0.0), 1 - g.centre_distance(box, track) / (width * width + height * height) ** 0.5)
    score = 0.55 * g.iou(box, track) + 0.30 * g.coverage(track, box) + 0.15 * near
    best = pairs.groupBy(*KEY, "frame").agg(F.max(score).alias("score"))
    means = best.groupBy(*KEY).agg(F.avg("score").alias("mean"), F.count("*").alias("frames"))
    some = found.select("sequence").distinct().withColumn("some", F.lit(True))
    out = candidates.select(*KEY).join(means, KEY, "left").join(some, "sequence", "left")
    reason = F.when(F.col("some").isNull(), "no_grounding_results_available").when(F.col("frames").isNull(), "no_grounding_box_matched_candidate").otherwise("grounding_track_compatibility")
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("mean", F.lit(0.0))))
    return out.select(*KEY, F.when(F.col("some").isNotNull(), held).alias("score"), F.coalesce("frames", F.lit(0)).cast("long").alias("frames"), reason.alias("reason"))


def grounding_gate(evidence: DataFrame, least: float, required: bool) -> DataFrame:
    """Adds passed and gate, its reason. Without a score the gate passes unless grounding is required."""
    score = F.col("score")
    gate = F.when(score.isNull(), "grounding_unavailable").when(score >= least, "grounding_supported").otherwise("below_minimum_grounding_score")
    return evidence.withColumns({"passed": F.when(score.isNull(), F.lit(not required)).otherwise(score >= least), "gate": gate})


def current_tracks(memory: DataFrame, selected: DataFrame | None = None, explicit: DataFrame | None = None) -> DataFrame:
    """(sequence, track_id): the track named explicitly, else the one a fusion selected, else the first of the memory: by rank where all of the sequence have one, else by
    score, then support, then the lower id.

    memory: sequence, track_id, score, support, rank (may be null). selected, explicit: sequence, track_id.
    """
    top = F.when(F.count("rank") == F.count("*"), F.min_by("track_id", F.struct("rank", "track_id"))).otherwise(F.max_by("track_id", F.struct("score", "support", -F.col("track_id"))))
    out = memory.groupBy("sequence").agg(top.alias("track_id"))
    for better in (selected, explicit):
        if better is not None:
            b = better.where("track_id IS NOT NULL").select("sequence", F.col("track_id").alias("_b"))
            out = out.join(b, "sequence", "full").select("sequence", F.coalesce("_b", "track_id").alias("track_id"))
    return out


def frames_between(ranges: DataFrame) -> DataFrame:
    """(sequence, frame) for each frame of ranges (sequence, start, stop); a range that starts below 1 or is empty raises. Laid out in blocks, so that no row holds
    all frames of a sequence."""
    wrong = (F.col("start") < 1) | (F.col("stop") < F.col("start"))
    start = F.when(wrong, F.raise_error(F.lit("wrong range of frames")).cast("long")).otherwise(F.col("start"))
    blocks = ranges.select("sequence", "stop", F.explode(F.sequence(start, F.col("stop"), F.lit(BLOCK).cast("long"))).alias("b"))
    return blocks.select("sequence", F.explode(F.sequence("b", F.least("stop", F.col("b") + (BLOCK - 1)))).alias("frame"))


def target_timeline(obs: DataFrame, targets: DataFrame, memory: DataFrame, sampled: DataFrame, appearance: DataFrame | None = None, fusion: DataFrame | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """One row for each frame of a sequence: where its target is, its scores, and for each value whence it comes or why it isn't there.

    The semantic score stands only in frames in which the target was sampled; scores of appearance and of fusion hold for the whole session and are repeated. runner_up
    is the best fused score of another track, candidates the number of fused ones.

    obs: sequence, track_id, frame, x, y, w, h, conf. targets: sequence, track_id. memory: sequence, track_id, score. sampled: sequence, track_id, frame. appearance:
    sequence, track_id, appearance, status. fusion: sequence, track_id, fused (null: not fused). ranges: sequence, start, stop (null: as far as the sequence's boxes go).
    Sequences without a box or a target have no rows. A track has one row in each table of scores.
    """
    null, t = F.lit(None), targets.select(*KEY)
    target = t.join(memory.select(*KEY, F.col("score").alias("semantic"), F.lit(True).alias("remembered")), KEY, "left")
    if appearance is None:
        target = target.withColumns({"appearance": null.cast("double"), "appearance_from": F.lit("missing_appearance_artifact")})
    else:
        known = appearance.select("sequence").distinct().withColumn("_any", F.lit(True))
        target = target.join(appearance.select(*KEY, "appearance", F.col("status").alias("appearance_from"), F.lit(True).alias("_has")), KEY, "left").join(known, "sequence", "left")
        target = target.withColumn("appearance_from", F.when(F.col("_has"), F.col("appearance_from")).when(F.col("_any"), "track_not_in_appearance_artifact").otherwise("missing_appearance_artifact")).drop("_has", "_any")
    if fusion is None:
        target = target.withColumns({"fused": null.cast("double"), "runner_up": null.cast("double"), "candidates": null.cast("long"), "fused_from": F.lit("missing_fusion_artifact")})
    else:
        f = fusion.select(*KEY, "fused").join(t.withColumnRenamed("track_id", "_target"), "sequence")
        own = F.col("track_id") == F.col("_target")
        f = f.groupBy("sequence").agg(F.max(F.when(own, F.col("fused"))).alias("fused"), F.max(F.when(~own, F.col("fused"))).alias("runner_up"), F.count("fused").alias("candidates"))
        source = F.when(F.col("candidates").isNull(), "missing_fusion_artifact").when(F.col("fused").isNull(), "track_not_in_fusion_artifact").otherwise("session_level")
        target = target.join(f, "sequence", "left").withColumns({"runner_up": F.when(F.col("fused").isNotNull(), F.col("runner_up")), "fused_from": source})
    target = target.withColumn("margin", F.col("fused") - F.col("runner_up")).withColumnRenamed("track_id", "_target")

    spans = obs.groupBy("sequence").agg(F.min("frame").cast("long").alias("start"), F.max("frame").cast("long").alias("stop"))
    if ranges is not None:
        wished = ranges.select("sequence", F.col("start").alias("_start"), F.col("stop").alias("_stop"))
        spans = spans.join(wished, "sequence", "left").select("sequence", F.coalesce("_start", "start").cast("long").alias("start"), F.coalesce("_stop", "stop").cast("long").alias("stop"))
    boxes = obs.join(t, KEY, "left_semi").select(*FRAME, "x", "y", "w", "h", "conf", F.lit(True).alias("_box"))
    seen = sampled.join(t, KEY, "left_semi").select(*FRAME).distinct().withColumn("_seen", F.lit(True))
    rows = frames_between(spans.join(t.select("sequence"), "sequence", "left_semi")).join(boxes, FRAME, "left").join(seen, FRAME, "left").join(target, "sequence")
    present, in_sample = F.col("_box").isNotNull(), F.col("_seen").isNotNull() & F.col("remembered").isNotNull()
    cx, cy = g.centre(g.corners("x", "y", "w", "h"))
    return rows.select(
        *FRAME, F.col("_target").alias("target"), present.alias("present"), F.when(present, F.col("_target")).alias("track_id"), "x", "y", "w", "h", cx.alias("cx"), cy.alias("cy"), "conf",
        F.when(in_sample, F.col("semantic")).alias("semantic"), "appearance", "fused", "runner_up", "margin", "candidates",
        F.when(present, "present").otherwise("absent").alias("tracking_from"),
        F.when(present & F.col("conf").isNotNull(), "mot_confidence").otherwise("unavailable").alias("conf_from"),
        F.when(in_sample, "sampled_frame").when(F.col("remembered"), "session_level_only").otherwise("unavailable").alias("semantic_from"),
        "appearance_from", "fused_from",
    )


def _named(label: Column, display: Column, trigger: str | Column, stage: int, a: Column, b: Column, track: Column | None = None) -> list[Column]:
    trigger = F.lit(trigger) if isinstance(trigger, str) else trigger
    numbers = [F.lit(stage).alias("stage"), a.cast("long").alias("a"), b.cast("long").alias("b"), (F.lit(None) if track is None else track).cast("long").alias("track_id")]
    return [F.col("sequence"), label.alias("class"), display.alias("display"), trigger.alias("trigger"), *numbers]


def verification_plan(objects: DataFrame, answers: DataFrame, gaps: DataFrame, keyframes: DataFrame, crops: DataFrame, overview: DataFrame, named: DataFrame | None = None, named_trigger: str = "post_tracking_spatial_verification",
                      sure: float = 0.65, most_classes: int = 4, most_frames: int = 2, most_tracks: int = 3, least_gap: int = 15, most_returns: int = 3) -> DataFrame:
    """The requests with which unsure classes and tracks are looked at again: request, class, query, frame, path, trigger, expected (a track or null), target.

    Classes come up in this order: objects of the discovery that are open or unsure; labels of unsure answers; labels of the tracks that were gone for `least_gap` frames (the lowest ids; all tracked objects
    where no answer names one); all tracked objects for tracks answered as unknown. The first place of a class counts, and what names it there, except that of
    several objects of the discovery the last one names it. The first `most_classes` stay, with the lowest `most_tracks` (0: all) of their tracks; a class without
    tracks is looked for in frames of the overview. A track's frames are keyframes that show it, else crops of it, else the overview.

    With `named` (sequence, position, track_id, class) these tracks are verified, all of them, in place of all but the unsure answers.

    objects: sequence, position, class, display, confidence, open, action (track, detect or others). answers: sequence, position, track_id, label, confidence. gaps:
    sequence, track_id, gap. keyframes, crops: sequence, position, frame, path, track_id (a keyframe once for each visible track). overview: sequence, position, frame, path. A missing confidence
    is 0.
    """
    col, place = F.col, F.col("position")
    tracked = objects.where("action = 'track'")
    unsure = answers.where((col("label") != "unknown") & (F.coalesce("confidence", F.lit(0.0)) < sure))
    found = unsure.select(*_named(col("label"), col("label"), "low_qwen_semantic_confidence", 1, place, F.lit(0), col("track_id")))
    if named is not None:
        most_classes = most_tracks = 0
        found = found.unionByName(named.where("track_id > 0 AND trim(class) <> ''").select(*_named(F.trim("class"), F.trim("class"), named_trigger, 0, place, F.lit(0), col("track_id"))))
    else:
        first = objects.where(col("action").isin("track", "detect") & (F.coalesce("open", F.lit(False)) | (F.coalesce("confidence", F.lit(0.0)) < sure)))
        found = found.unionByName(first.select(*_named(col("class"), col("display"), F.when(col("open"), "open_vocabulary_class").otherwise("low_discovery_confidence"), 0, place, F.lit(0))))
        # of each sequence no more tracks than can be chosen, before they meet the objects
        low = F.row_number().over(W.partitionBy("sequence").orderBy("track_id"))
        back = gaps.where((col("track_id") > 0) & (col("gap") >= least_gap)).select(*KEY).distinct().withColumn("_n", low).where(col("_n") <= most_returns).drop("_n")
        known = answers.where("label <> 'unknown'").groupBy(*KEY).agg(F.max_by("label", "position").alias("label"))
        back = back.join(known, KEY, "left")
        found = found.unionByName(back.where("label IS NOT NULL").select(*_named(col("label"), col("label"), "identity_reacquisition", 2, col("track_id"), F.lit(0), col("track_id"))))
        every = tracked.select("sequence", "position", "class", "display")
        found = found.unionByName(back.where("label IS NULL").drop("label").join(every, "sequence").select(*_named(col("class"), col("class"), "identity_reacquisition", 2, col("track_id"), place, col("track_id"))))
        unknown = answers.where("label = 'unknown'").select(*KEY).distinct()
        if most_tracks:
            unknown = unknown.withColumn("_n", low).where(col("_n") <= most_tracks).drop("_n")
        found = found.unionByName(unknown.join(every, "sequence").select(*_named(col("class"), col("display"), "qwen_unknown_track", 3, place, col("track_id"), col("track_id"))))

    order, names = F.struct("stage", "a", "b"), F.struct("display", "trigger")
    at_first = F.when((F.min("stage") == 0) & F.lit(named is None), F.max_by(names, F.when(col("stage") == 0, col("a")))).otherwise(F.min_by(names, order))
    classes = found.groupBy("sequence", "class").agg(F.min(order).alias("order"), at_first.alias("n"), F.count("track_id").alias("tracks"))
    classes = classes.withColumn("_index", F.row_number().over(W.partitionBy("sequence").orderBy("order")) - 1)
    if most_classes:
        classes = classes.where(col("_index") < most_classes)
    classes = classes.select("sequence", "class", "n.display", "n.trigger", "tracks", "_index")
    expected = found.where("track_id IS NOT NULL").select("sequence", "class", "track_id").distinct()
    if most_tracks:
        expected = expected.withColumn("_n", F.row_number().over(W.partitionBy("sequence", "class").orderBy("track_id"))).where(col("_n") <= most_tracks).drop("_n")
    expected = classes.where("tracks > 0").join(expected, ["sequence", "class"])

    shots = keyframes.select(*KEY, "position", "frame", "path", F.lit(0).alias("_kind")).unionByName(crops.select(*KEY, "position", "frame", "path", F.lit(1).alias("_kind")))
    shots = shots.join(expected.select(*KEY).distinct(), KEY, "left_semi")
    nth = F.row_number().over(W.partitionBy(*KEY).orderBy("_kind", "position")) - 1
    shots = shots.withColumns({"_nth": nth, "_best": F.min("_kind").over(W.partitionBy(*KEY))}).where((col("_nth") < most_frames) & (col("_kind") == col("_best"))).select(*KEY, "frame", "path", "_nth")
    views = overview.withColumn("_nth", F.row_number().over(W.partitionBy("sequence").orderBy("position")) - 1).where(col("_nth") < most_frames).select("sequence", "frame", "path", "_nth")
    seen = shots.select(*KEY).distinct()
    requests = expected.join(shots, [*KEY]).withColumn("target", col("track_id"))
    blind = expected.join(seen, KEY, "left_anti").join(views, "sequence").withColumn("target", F.lit(None).cast("long"))
    general = classes.where("tracks = 0").join(views, "sequence").withColumns({"track_id": F.lit(None).cast("long"), "target": F.lit(None).cast("long")})
    out = requests.unionByName(blind).unionByName(general)
    name = F.when(col("trigger") == "explicit_track_benchmark", col("class")).otherwise(col("display"))
    request = F.when(col("track_id").isNull(), F.format_string("%02d_%02d", "_index", "_nth")).otherwise(F.format_string("%02d_t%04d_%02d", "_index", "track_id", "_nth"))
    inside = F.when(col("target").isNotNull(), F.concat(F.lit(" inside the tracking box labeled ID "), col("target").cast("string"))).otherwise("")
    return out.select("sequence", request.alias("request"), "class", F.concat(F.lit("the "), name, inside).alias("query"), F.concat(F.lit("the "), name).alias("localized"), "frame", "path", "trigger", col("track_id").alias("expected"), "target")


def label_source(rows: DataFrame, cache: DataFrame, pending: DataFrame, enabled: bool) -> DataFrame:
    """rows with the label that is shown, the detector's, the semantic status and, where accepted, what the cache says.

    status: accepted; unknown for a track whose cached label isn't; pending for one whose job waits; else waiting, or base where no semantics run. rows may be a stream: all
    joins are from its side to tables, and the cache is that of the version which the caller reads for each batch.

    rows: sequence, track_id, class, fast, colour and others, which are kept. cache: sequence, track_id (one row each), accepted, detector (null: the row's
    class), label, fine, fine_accepted, confidence, colour. pending: sequence, track_id.
    """
    c = cache.select(*KEY, F.struct("accepted", "detector", "label", "fine", "fine_accepted", "confidence", "colour").alias("_c"))
    p = pending.select(*KEY).distinct().withColumn("_p", F.lit(True))
    out = rows.join(c, KEY, "left").join(p, KEY, "left")
    ok, kind = F.coalesce(F.col("_c.accepted"), F.lit(False)), F.col("class")
    base = F.coalesce("_c.detector", "class")
    colour = F.coalesce(F.nullif(F.trim("_c.colour"), F.lit("")), F.col("colour"))
    deep = display_label(base, F.col("_c.label"), F.col("_c.fine"), F.col("_c.fine_accepted"), F.col("fast"), colour)
    shown = F.when(F.lower(deep) == F.lower(base), base).otherwise(F.concat(base, F.lit(" | "), deep))
    status = F.when(ok, "accepted").when(F.col("_c").isNotNull(), "unknown").when(F.col("_p"), "pending").otherwise("waiting" if enabled else "base")
    plain = F.when((status == "unknown") & F.lit(enabled), F.concat(kind, F.lit(" | unknown"))).otherwise(kind)
    out = out.withColumns({"status": status, "shown": F.when(ok, shown).otherwise(plain), "deep": F.when(ok, deep), "confidence": F.when(ok, F.col("_c.confidence"))})
    return out.drop("_c", "_p")
