"""Grounding evidence, timelines, plans of verification and shown labels: by hand, and the plan against plain Python."""

import random

import pytest
from pyspark.errors import PySparkException

from boxtrail.operators import evidence

BOX = "sequence string, track_id long, frame long, x double, y double, w double, h double"


def grounded(spark, found):
    obs = spark.createDataFrame([("a", 1, 1, 0.0, 0.0, 10.0, 10.0), ("a", 1, 2, 0.0, 0.0, 10.0, 10.0), ("a", 2, 5, 0.0, 0.0, 10.0, 10.0), ("b", 1, 1, 0.0, 0.0, 10.0, 10.0)], BOX)
    rows = spark.createDataFrame(found, "sequence string, frame long, x double, y double, w double, h double")
    got = evidence.grounding_evidence(obs.select("sequence", "track_id").distinct(), rows, obs, 30.0, 40.0)
    return {(r.sequence, r.track_id): r for r in evidence.grounding_gate(got, 0.6, required=True).collect()}


def test_grounding_takes_the_best_of_each_frame_and_the_mean_of_frames(spark):
    # frame 1: the same box (1) and one far away; frame 2: half of it is covered, centres 2.5 apart on a diagonal of 50
    got = grounded(spark, [("a", 1, 0.0, 0.0, 10.0, 10.0), ("a", 1, 20.0, 20.0, 5.0, 5.0), ("a", 2, 0.0, 0.0, 5.0, 10.0)])
    assert got["a", 1].score == pytest.approx((1 + 0.55 * 0.5 + 0.30 * 0.5 + 0.15 * (1 - 2.5 / 50)) / 2)
    assert (got["a", 1].frames, got["a", 1].gate, got["a", 1].passed) == (2, "grounding_supported", True)
    # no frame in common: zero; a sequence without results: nothing to go by
    assert (got["a", 2].score, got["a", 2].reason, got["a", 2].passed) == (0.0, "no_grounding_box_matched_candidate", False)
    assert (got["b", 1].score, got["b", 1].reason, got["b", 1].gate, got["b", 1].passed) == (None, "no_grounding_results_available", "grounding_unavailable", False)


def test_results_without_boxes_or_frames_are_results(spark):
    got = grounded(spark, [("a", 1, None, None, None, None), ("b", None, 0.0, 0.0, 10.0, 10.0)])
    assert {r.score for r in got.values()} == {0.0} and {r.reason for r in got.values()} == {"no_grounding_box_matched_candidate"}


def test_current_track_by_precedence(spark):
    m = spark.createDataFrame([("a", 1, 0.5, 3, 2), ("a", 2, 0.4, 3, 1), ("b", 1, 0.5, 3, None), ("b", 2, 0.5, 4, 1), ("c", 7, 0.1, 1, 1), ("d", 7, 0.1, 1, 1)], "sequence string, track_id long, score double, support long, rank long")
    pick = lambda *rows: spark.createDataFrame(rows, "sequence string, track_id long")
    got = evidence.current_tracks(m, pick(("c", 8), ("d", 8), ("b", None)), pick(("d", 9), ("e", 4))).collect()
    assert {tuple(r) for r in got} == {("a", 2), ("b", 2), ("c", 8), ("d", 9), ("e", 4)}


TIMED = BOX + ", conf double"


def test_timeline_says_why_a_value_is_missing(spark):
    obs = spark.createDataFrame([("a", 1, 2, 0.0, 0.0, 10.0, 10.0, 0.5), ("a", 1, 4, 0.0, 0.0, 10.0, 20.0, None), ("a", 9, 5, 0.0, 0.0, 1.0, 1.0, 0.5), ("b", 1, 1, 0.0, 0.0, 1.0, 1.0, 0.5)], TIMED)
    pairs = lambda rows, names: spark.createDataFrame(rows, f"sequence string, track_id long, {names}")
    memory, sampled = pairs([("a", 1, 0.7)], "score double"), pairs([("a", 1, 3), ("a", 1, 4), ("a", 9, 2)], "frame long")
    appearance, fusion = pairs([("a", 9, 0.3, "ok")], "appearance double, status string"), pairs([("a", 1, 0.6), ("a", 9, 0.8), ("a", 5, None)], "fused double")
    targets = spark.createDataFrame([("a", 1), ("b", 3), ("z", 1)], "sequence string, track_id long")
    got = {(r.sequence, r.frame): r for r in evidence.target_timeline(obs, targets, memory, sampled, appearance, fusion).collect()}
    assert sorted(got) == [("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 1)]
    assert [got["a", f].present for f in range(2, 6)] == [True, False, True, False] and (got["a", 4].cx, got["a", 4].cy, got["a", 3].cx) == (5, 10, None)
    assert [got["a", f].semantic for f in range(2, 6)] == [None, 0.7, 0.7, None]
    assert [got["a", f].semantic_from for f in (2, 3)] == ["session_level_only", "sampled_frame"] and got["b", 1].semantic_from == "unavailable"
    assert [got["a", f].conf_from for f in (2, 3, 4)] == ["mot_confidence", "unavailable", "unavailable"]
    one = got["a", 5]
    assert (one.fused, one.runner_up, one.candidates, one.fused_from, one.appearance_from) == (0.6, 0.8, 2, "session_level", "track_not_in_appearance_artifact") and one.margin == pytest.approx(-0.2)
    assert (got["b", 1].fused_from, got["b", 1].appearance_from, got["b", 1].candidates, got["b", 1].track_id, got["b", 1].target) == ("missing_fusion_artifact", "missing_appearance_artifact", None, None, 3)


def test_timeline_of_a_given_range_over_several_blocks(spark):
    obs = spark.createDataFrame([("a", 1, 5, 0.0, 0.0, 1.0, 1.0, 0.5)], TIMED)
    targets, empty = spark.createDataFrame([("a", 1)], "sequence string, track_id long"), spark.createDataFrame([], "sequence string, track_id long, score double")
    sampled = spark.createDataFrame([], "sequence string, track_id long, frame long")
    ranges = lambda start, stop: spark.createDataFrame([("a", start, stop)], "sequence string, start long, stop long")
    frames = [r.frame for r in evidence.target_timeline(obs, targets, empty, sampled, ranges=ranges(3, 2 * evidence.BLOCK + 3)).collect()]
    assert sorted(frames) == list(range(3, 2 * evidence.BLOCK + 4))
    assert evidence.target_timeline(obs, targets, empty, sampled, ranges=ranges(None, 7)).count() == 3
    for wrong in (ranges(0, 4), ranges(4, 3)):
        with pytest.raises(PySparkException, match="wrong range"):
            evidence.target_timeline(obs, targets, empty, sampled, ranges=wrong).collect()


def plan_by_hand(objects, answers, gaps, keyframes, crops, overview, named=None):
    """Sequential: classes come up one after the other in an ordered dict. All rows of one sequence."""
    plan = {}

    def add(name, display, trigger, *ids):
        plan.setdefault(name, [display, trigger, set()])[2].update(ids)

    tracked = [o for o in objects if o["action"] == "track"]
    if named is None:
        for o in objects:
            if o["action"] in ("track", "detect") and (o["open"] or o["confidence"] < 0.65):
                plan[o["class"]] = [o["display"], "open_vocabulary_class" if o["open"] else "low_discovery_confidence", set()]
    for _, track, name in named or []:
        if track > 0 and name.strip():
            add(name.strip(), name.strip(), "post_tracking_spatial_verification", track)
    label_of, unknown = {}, set()
    for a in answers:
        if a["label"] == "unknown":
            unknown.add(a["track_id"])
            continue
        label_of[a["track_id"]] = a["label"]
        if a["confidence"] < 0.65:
            add(a["label"], a["label"], "low_qwen_semantic_confidence", a["track_id"])
    if named is None:
        for track in sorted({t for t, gap in gaps if t > 0 and gap >= 15})[:3]:
            for name in [label_of[track]] if track in label_of else [o["class"] for o in tracked]:
                add(name, name, "identity_reacquisition", track)
        for o in tracked if unknown else []:
            add(o["class"], o["display"], "qwen_unknown_track", *unknown)
    most = None if named is not None else 3
    out = set()
    for i, (name, (display, trigger, ids)) in enumerate(list(plan.items())[: 4 if named is None else None]):
        for track in sorted(ids)[:most] or [None]:
            visible, cut = [k for k in keyframes if k[2] == track], [k for k in crops if k[2] == track]
            own = track is not None and bool(visible or cut)
            for n, k in enumerate(((visible or cut) if own else overview)[:2]):
                request = f"{i:02d}_{n:02d}" if track is None else f"{i:02d}_t{track:04d}_{n:02d}"
                out.add(("a", request, name, f"the {display}" + (f" inside the tracking box labeled ID {track}" if own else ""), f"the {display}", k[0], k[1], trigger, track, track if own else None))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_plain_python(spark, seed):
    rng = random.Random(seed)
    names = ["car", "bus", "dog", "red bus", "cat"]
    objects = [{"class": rng.choice(names), "display": f"d{i}", "confidence": rng.choice([0.3, 0.65, 0.9]), "open": rng.random() < 0.3, "action": rng.choice(["track", "track", "detect", "ignore"])} for i in range(rng.randrange(5))]
    answers = [{"track_id": rng.randrange(1, 9), "label": rng.choice([*names, "unknown"]), "confidence": rng.choice([0.2, 0.65, 0.9])} for _ in range(rng.randrange(7))]
    gaps = [(rng.randrange(0, 12), rng.choice([3, 15, 40])) for _ in range(6)]
    frames = lambda: [(f, f"p{f}", rng.randrange(1, 12)) for f in sorted(rng.sample(range(1, 60), 12))]
    keyframes, crops, overview = frames(), frames(), [(f, f"o{f}") for f in (1, 20, 40)]
    named = [(i, rng.randrange(0, 9), rng.choice([*names, " "])) for i in range(5)] if seed % 3 == 2 else None
    make = spark.createDataFrame
    shots = lambda rows: make([("a", i, *r) for i, r in enumerate(rows)], "sequence string, position long, frame long, path string, track_id long")
    got = evidence.verification_plan(
        make([("a", i, *o.values()) for i, o in enumerate(objects)], "sequence string, position long, class string, display string, confidence double, open boolean, action string"),
        make([("a", i, *a.values()) for i, a in enumerate(answers)], "sequence string, position long, track_id long, label string, confidence double"),
        make([("a", *g) for g in gaps], "sequence string, track_id long, gap long"), shots(keyframes), shots(crops),
        make([("a", i, *o) for i, o in enumerate(overview)], "sequence string, position long, frame long, path string"),
        named=None if named is None else make([("a", *n) for n in named], "sequence string, position long, track_id long, class string"),
    ).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert {tuple(r) for r in got} == plan_by_hand(objects, answers, gaps, keyframes, crops, overview, named)


def test_label_source_of_each_status(spark):
    rows = spark.createDataFrame([("a", t, "Car", None, "blue") for t in range(1, 6)], "sequence string, track_id long, class string, fast string, colour string")
    cache = spark.createDataFrame([("a", 1, True, None, "car", "unknown", None, 0.9, ""), ("a", 2, True, "van", "van", "taxi", True, 0.8, "Red"), ("a", 3, None, None, "x", None, None, 0.1, None)],
                                  "sequence string, track_id long, accepted boolean, detector string, label string, fine string, fine_accepted boolean, confidence double, colour string")
    pending = spark.createDataFrame([("a", 3), ("a", 4), ("a", 4)], "sequence string, track_id long")
    shown = lambda enabled: {r.track_id: (r.status, r.shown) for r in evidence.label_source(rows, cache, pending, enabled).collect()}
    assert shown(True) == {1: ("accepted", "Car | blue Car"), 2: ("accepted", "van | red taxi"), 3: ("unknown", "Car | unknown"), 4: ("pending", "Car"), 5: ("waiting", "Car")}
    off = shown(False)
    assert (off[3], off[4], off[5]) == (("unknown", "Car"), ("pending", "Car"), ("base", "Car"))


def test_label_source_of_a_stream(spark, tmp_path):
    schema = "sequence string, track_id long, class string, fast string, colour string"
    cache = "sequence string, track_id long, accepted boolean, detector string, label string, fine string, fine_accepted boolean, confidence double, colour string"
    spark.createDataFrame([("a", 1, "car", None, None), ("a", 2, "car", None, None)], schema).write.parquet(str(tmp_path / "in"))
    labels = spark.createDataFrame([("a", 1, True, None, "bus", None, None, 0.9, None)], cache)
    rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = evidence.label_source(rows, labels, labels.limit(0).select("sequence", "track_id"), True)
    q = out.writeStream.format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.track_id, r.shown) for r in spark.table("shown").collect()} == {(1, "car | bus"), (2, "car")}
