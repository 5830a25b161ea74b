import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxtrail.functions import salvage
from boxtrail.operators import appearance, decisions, filters, fusion, matching, metrics, reports, segments, signals, switches, tracker, tracks, validate

BOX = "sequence string, frame long, track_id long, x double, y double, w double, h double, conf double, class string"


def boxes(spark, rows):
    return spark.createDataFrame([(s, f, t, float(x), float(y), float(w), float(h), c, "a") for s, f, t, x, y, w, h, c in rows], BOX)


def test_hungarian_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        cost = rng.random((n, m)).round(2)
        pairs = matching.hungarian(cost)
        small, big = min(n, m), max(n, m)
        best = min(sum(cost[(i, p[i]) if n <= m else (p[i], i)] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert len(pairs) == small and abs(sum(cost[a, b] for a, b in pairs) - best) < 1e-9


def test_greedy_ties():
    rows = [(0.8, 0, 0), (0.8, 0, 1), (0.8, 1, 0), (0.5, 1, 1)]
    assert [rows[i][1:] for i in matching.greedy(rows)] == [(0, 0), (1, 1)]
    assert [rows[i][1:] for i in matching.greedy(rows, last_first=True)] == [(1, 0), (0, 1)]


def test_matchers_differ_where_greedy_is_short_sighted(spark):
    gt = boxes(spark, [("s", 1, 1, 0, 0, 10, 10, 1.0), ("s", 1, 2, 4, 0, 10, 10, 1.0)])
    pred = boxes(spark, [("s", 1, 7, 2, 0, 10, 10, 0.9), ("s", 1, 8, 7, 0, 10, 10, 0.8)])
    pairs = lambda df: {(r.gt_track_id, r.pred_track_id) for r in df.collect()}
    assert pairs(matching.hungarian_match(gt, pred, 0.3)) == {(1, 7), (2, 8)}
    assert pairs(matching.greedy_match(gt, pred, 0.3)) == {(1, 7), (2, 8)}


def test_three_detections_against_two_objects(spark):
    gt = boxes(spark, [("s", 1, 1, 0, 0, 10, 10, 1.0), ("s", 1, 2, 50, 50, 10, 10, 1.0)])
    det = boxes(spark, [("s", 1, 1, 0, 0, 10, 10, 0.9), ("s", 1, 2, 55, 50, 10, 10, 0.8), ("s", 1, 3, 90, 90, 5, 5, 0.7)])
    e = matching.error_analysis(gt, det)
    assert sorted(r.kind for r in e.collect()) == ["false_positive", "localization", "true_positive"]
    assert matching.missed(gt, e).count() == 1


def test_one_switch(spark):
    m = spark.createDataFrame([("s", f, 1, p) for f, p in ((1, 10), (2, 10), (3, 11))], "sequence string, frame long, gt_track_id long, pred_track_id long")
    crowd = spark.createDataFrame([("s", 3, 1, 0)], "sequence string, frame long, track_id long, nearby long")
    (r,) = switches.classify(m, crowd).collect()
    assert (r.frame, r.old_id, r.new_id, r.gap, r.type) == (3, 10, 11, 0, "association_error")


def sequential_switches(rows, nearby, reid=10, window=5):
    last, owner, out = {}, {}, []
    for frame, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        group = list(group)
        now = {p: g for _, g, p in group}
        before = dict(owner)
        for _, g, p in group:
            if g in last and last[g][1] != p:
                gap, old, o = frame - last[g][0] - 1, last[g][1], before.get(p)
                if (o and o[0] != g and frame - o[1] <= window) or now.get(old, g) != g:
                    kind = "identity_swap"
                elif gap >= reid:
                    kind = "re_identification_failure"
                elif gap > 0:
                    kind = "fragmentation"
                else:
                    kind = "appearance_confusion" if nearby[frame, g] else "association_error"
                out.append((frame, g, kind))
            last[g] = (frame, p)
            owner[p] = (g, frame)
    return sorted(out)


def test_switches_equal_a_sequential_model(spark):
    rng = random.Random(3)
    rows = [(f, g, p) for f in range(1, 200) for g, p in zip((g for g in range(1, 6) if rng.random() < 0.7), rng.sample(range(50, 58), 5), strict=False)]
    nearby = {(f, g): rng.randrange(2) for f, g, _ in rows}
    m = spark.createDataFrame([("s", *r) for r in rows], "sequence string, frame long, gt_track_id long, pred_track_id long")
    n = spark.createDataFrame([("s", f, g, v) for (f, g), v in nearby.items()], "sequence string, frame long, track_id long, nearby long")
    got = switches.classify(m, n).collect()
    assert sorted((r.frame, r.gt_track_id, r.type) for r in got) == sequential_switches(rows, nearby)


def test_rollup_percentages(spark):
    e = spark.createDataFrame([("a", "identity_swap"), ("a", "fragmentation"), ("b", "fragmentation")], "sequence string, type string")
    r = {x.sequence: x for x in switches.taxonomy_rollup(e).collect()}
    assert r[None].total == 3 and r[None].fragmentation_pct == 66.667 and r["a"].identity_swap_pct == 50.0


def test_equal_reviewers_agree(spark):
    a = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(9)], "k long, label string")
    r = switches.kappa(a, a, ["k"], "label").first()
    assert (r.n, r.agreement, r.kappa) == (9, 100.0, 1.0)
    same = a.withColumn("label", F.lit("x"))
    assert switches.kappa(same, same, ["k"], "label").first().kappa == 1.0


def test_semantic_rates_with_one_rejected(spark):
    r = metrics.semantic_rates(spark.createDataFrame([("car", "car", True), ("bus", "unknown", False)], "gt string, label string, accepted boolean")).first()
    assert (r.accuracy, r.coverage, r.selective_accuracy, r.unknown_f1) == (0.5, 0.5, 1.0, None)


def test_profile_of_three(spark):
    r = metrics.profile(spark.createDataFrame([(20.0,), (22.0,), (24.0,)], "v double").withColumn("k", F.lit(1)), "v", ["k"]).first()
    assert r["mean"] == 22.0 and abs(r["std"] - (8 / 3) ** 0.5) < 1e-12


def test_gaps_runs_and_absences(spark):
    o = boxes(spark, [("s", f, 1, 0, 0, 1, 1, 0.1 if f < 6 else 0.9) for f in (1, 2, 3, 4, 5, 12, 13)] + [("s", 40, 2, 0, 0, 1, 1, 0.5)])
    assert [(r.gap_start, r.gap_end, r.gap_frames) for r in tracks.track_gaps(o).collect()] == [(6, 11, 6)]
    got = {(r.track_id, r.run_start, r.run_end, r.severity) for r in signals.absences(o).collect()}
    assert got == {(1, 6, 11, "warning"), (1, 14, 40, "critical"), (2, 1, 39, "critical")}
    (low,) = signals.low_confidence_runs(o).collect()
    assert (low.run_start, low.run_end, low.severity) == (1, 5, "high")


def test_events_merge_with_the_one_before_only(spark):
    rows = [("s", 1, "A", 1, 100, "info"), ("s", 1, "A", 5, 10, "high"), ("s", 1, "A", 20, 30, "warning"), ("s", 1, "A", 25, 40, "info")]
    e = spark.createDataFrame(rows, "sequence string, track_id long, type string, start long, `end` long, severity string")
    assert sorted((r.start, r.end, r.n, r.severity) for r in signals.merge_events(e).collect()) == [(1, 100, 2, "high"), (20, 40, 2, "warning")]


def test_cooldown_and_budget(spark):
    assert signals.cooldown([(100, False), (120, False), (130, True), (181, False)], 50) == [True, False, True, True]
    rows = [("s", f"e{i}", "A", "critical" if i == 2 else "warning", 10 * i, 10 * i) for i in range(5)]
    e = spark.createDataFrame(rows, "sequence string, event_id string, type string, severity string, start long, trigger long")
    got = {r.event_id: r.status for r in signals.schedule(e, ["A"], frames=20, budget=2).collect()}
    assert got == {"e2": "accepted", "e0": "accepted", "e4": "budget", "e1": "cooldown", "e3": "cooldown"}


def test_fusion_accepts_and_rejects(spark):
    rows = [("s", 1, f, "car", 0.9, "qwen") for f in (1, 2, 3)] + [("s", 2, 1, "car", 0.6, "qwen"), ("s", 2, 2, "bus", 0.6, "qwen")]
    got = {r.track_id: r for r in fusion.fuse_labels(spark.createDataFrame(rows, "sequence string, track_id long, frame long, label string, conf double, source string")).collect()}
    assert got[1].label == "car" and got[1].accepted and got[1].confidence == 0.9
    assert got[2].label == "unknown" and got[2].transitions == 1


def test_asof_and_segments(spark):
    left = spark.createDataFrame([("s", 1, f) for f in (1, 5, 9)], "sequence string, track_id long, frame long")
    right = spark.createDataFrame([("s", 1, 4, 0.4), ("s", 1, 5, 0.5)], "sequence string, track_id long, frame long, conf double")
    got = {r.frame: (r.before_frame, r.before_conf) for r in segments.asof_before(left, right, ["sequence", "track_id"], "conf").collect()}
    assert got == {1: (None, None), 5: (5, 0.5), 9: (5, 0.5)}
    s = spark.createDataFrame([("s", 1, 0, 1, 5, "confirmed"), ("s", 1, 1, 5, None, "probation"), ("s", 1, 2, 1, 9, "rejected")], "sequence string, track_id long, segment long, start_frame long, end_frame long, status string")
    assert sorted((r.frame, r.segment) for r in segments.rows_in_segments(left, s).collect()) == [(1, 0), (5, 0), (5, 1), (9, 1)]


def test_state_machine_edges(spark):
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate(["UNRESOLVED", "ACTIVE", "ACTIVE", "UNRESOLVED", "LOST"])], "k long, i long, state string")
    assert sorted((r.i, r.old) for r in segments.invalid_transitions(s, segments.edges(spark), "k", "i").collect()) == [(3, "ACTIVE"), (4, "UNRESOLVED")]


def test_leave_one_out_equals_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, rng.normal(size=5).tolist()) for i in range(12)] + [(99, 7, [1.0, 0.0, 0.0, 0.0, 0.0])]
    got = {r.label: r.consistency for r in appearance.leave_one_out(spark.createDataFrame(rows, "id long, label long, embedding array<double>"), "label").collect()}
    for k in range(3):
        v = np.array([r[2] for r in rows if r[1] == k])
        c = [(np.dot(x, v.sum(0) - x) / np.linalg.norm(x) / np.linalg.norm(v.sum(0) - x) + 1) / 2 for x in v]
        assert abs(np.mean(c) - got[k]) < 1e-9
    assert got[7] is None


def test_validation_codes(spark):
    rows = [("s", 1, 1, 0.0, 0.0, 1.0, 1.0, 0.5, 1), ("s", 1, 1, 0.0, 0.0, 0.0, 1.0, 1.5, 2), ("s", 0, 2, 0.0, float("nan"), 1.0, 1.0, None, 3)]
    got = {(r.line_number, r.code) for r in validate.mot_issues(spark.createDataFrame(rows, "sequence string, frame long, track_id long, x double, y double, w double, h double, conf double, line_number long")).collect()}
    assert got == {(2, "bad_box"), (2, "bad_confidence"), (2, "duplicate"), (3, "bad_frame"), (3, "not_finite"), (3, "unordered")}


def test_salvage_of_predictions():
    text = 'x {"p": [{"id": 3, "class": "car", "conf": "bad", "observations": [{"q": 0.7}, {"q": 2}]}, {"id": 4, "accepted_for_fusion": false}]} {"'
    assert [(r["track_id"], r["label"], r["confidence"]) for r in salvage.prediction_rows(text)] == [(3, "car", 0.7), (3, "car", 1.0)]
    assert salvage.prediction_rows(None) == salvage.prediction_rows('{"q": 1} {') == []


def test_sampling_folds():
    assert filters.next_fit([3, 3, 0, 5, 1], 2, 6) == [0, 0, None, 1, 1]
    assert filters.spaced([1, 2, 50], [0.9, 0.8, 0.1], 2, 10) == [0, 2]
    assert filters.spaced([1, 2, 3], [0.9, 0.8, 0.1], 2, 10) == [0, 1]


def test_sort_follows_and_ends_tracks(spark):
    rows = [("s", f, 0, 10 + 2 * f, 10, 20, 20, 0.9) for f in range(1, 11)] + [("s", f, 0, 100, 50 + f, 20, 20, 0.8) for f in range(1, 6)]
    got = tracker.sort_tracks(boxes(spark, rows)).collect()
    assert {r.track_id for r in got} == {1, 2} and min(r.frame for r in got) == 3 and max(r.frame for r in got if r.conf == 0.8) == 5
    far = [r for r in got if r.frame == 10][0]
    assert abs(far.x - 30) < 1


def test_stabilizers_resist_single_changes():
    votes = [("a", 0.9)] * 6 + [("b", 0.9)] + [("a", 0.9)] * 3 + [("b", 0.9)] * 20
    for kind in (tracker.DecayVote, tracker.RecursiveVote):
        fold = kind()
        held = [fold.step(i, c, v) for i, (c, v) in enumerate(votes)]
        assert held[6] == "a" and held[-1] == "b"
    fold = tracker.ProposalStore()
    assert [fold.step(i, c, 1.0) for i, c in enumerate("aab")] == [None, "a", "a"]


def test_identity_metrics(spark):
    p = spark.createDataFrame([("s", 1, 10)] * 6 + [("s", 1, 11)] * 4, "sequence string, gt_track_id long, pred_track_id long")
    r = metrics.identity_metrics(p, p, p).first()
    assert (r.idtp, r.idf1) == (6, 0.6)


def test_target_switches_need_two_wrong_in_a_row(spark):
    flags = [(1, True, True), (2, True, False), (3, False, False), (4, True, False), (5, True, True), (6, True, False), (7, True, True)]
    f = spark.createDataFrame([("q", *x) for x in flags], "q string, frame long, predicted boolean, correct boolean")
    assert metrics.target_switches(f, ["q"]).first().switches == 1


def test_parameter_grid_has_the_baseline_first_and_once():
    runs = reports.parameter_grid({"a": 1, "b": 2}, {"b": [2, 3], "a": [1, 4]}, 10)
    assert runs == [{"a": 1, "b": 2}, {"a": 1, "b": 3}, {"a": 4, "b": 2}, {"a": 4, "b": 3}] and reports.parameter_grid({"a": 1}, {}, 3) == [{"a": 1}]
    assert len(reports.parameter_grid({"a": 1, "b": 2}, {"b": [2, 3], "a": [1, 4]}, 2)) == 2


def test_metric_of_wants_one_row(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 4.0)], "k int, v double")
    want = lambda k: spark.createDataFrame([(k,)], "k int")
    assert reports.metric_of(rows, "k", want(1), "v").first().v == 2.0
    for k in (2, 3):
        with pytest.raises(Exception, match="not one row"):
            reports.metric_of(rows, "k", want(k), "v").collect()


def test_colours_at_their_bounds(spark):
    cases = [(23, 100, 100, "yellow"), (21, 100, 100, "brown"), (21, 100, 145, "orange"), (24, 100, 200, "yellow"), (9, 48, 25, "red"), (170, 48, 25, "red"), (150, 200, 200, None), (0, 47, 24, None), (0, 47, 67, "black"), (0, 47, 68, "gray"), (0, 47, 132, "silver"), (0, 47, 205, "white"), (84, 48, 99, "green"), (139, 48, 99, "blue")]
    rows = spark.createDataFrame([c[:3] for c in cases], "h int, s int, v int").withColumn("c", decisions.colour())
    assert {(r.h, r.s, r.v, r.c) for r in rows.collect()} == set(cases)


def test_many_prototypes_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.randrange(9), [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    e = spark.createDataFrame(rows, "id long, label long, embedding array<double>")
    results = lambda: (
        sorted(appearance.cosine_topk(e.select(F.col("id").alias("query"), "embedding"), appearance.prototypes(e, "label"), 2).collect()),
        sorted(appearance.nearest_prototype(e, appearance.mean_vectors(e, "label"), "id").collect()),
        sorted(appearance.nearest_prototype(e.withColumnRenamed("label", "own"), appearance.mean_vectors(e, "label"), "id", own="own").collect()),
    )
    sent = results()
    monkeypatch.setattr(appearance, "SENT", 0)
    monkeypatch.setattr(appearance, "BLOCK", 4)
    assert results() == sent and len(sent[0]) == 120 and len(sent[1]) == len(sent[2]) == 60
    plan = appearance.against(e.select("id"), "id", appearance.mean_vectors(e, "label"), "mean")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def copied(spark, seed, n, first):
    """Boxes with few different places, so that a frame holds many copies."""
    r = np.random.default_rng(seed)
    rows = [("s", int(f), first + i, "ab"[i % 2], float(i % 7) / 7, float(10 * r.integers(0, 4)), float(8 * r.integers(0, 3)), float(20 + 10 * r.integers(0, 2)), 25.0) for f in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "sequence string, frame long, track_id long, class string, conf double, x double, y double, w double, h double"), rows


def overlap(a, b):
    w = min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5])
    h = min(a[6] + a[8], b[6] + b[8]) - max(a[6], b[6])
    i = max(0.0, w) * max(0.0, h)
    return i / (a[7] * a[8] + b[7] * b[8] - i)


def test_copies_of_a_box_are_compared_once(spark):
    (gt, g), (pred, p) = copied(spark, 1, 60, 0), copied(spark, 2, 50, 100)
    assert matching.distinct_boxes(gt, "gt").count() == len({(r[1], *r[5:]) for r in g}) <= 3 * 24
    want = {(a[1], a[2], b[2]): overlap(a, b) for a in g for b in p if a[1] == b[1] and overlap(a, b) >= 0.3}
    got = {(r.frame, r.gt_track_id, r.pred_track_id): r.iou for r in matching.iou_pairs(gt, pred, 0.3).collect()}
    assert got == want
    best = {(r.frame, r.pred_track_id): (r.gt_track_id, r.iou) for r in matching.error_analysis(gt, pred).collect()}
    for b in p:
        iou, track = min((-overlap(a, b), a[2]) for a in g if a[1] == b[1])
        assert best[b[1], b[2]] == (track, -iou)


def test_groups_of_copies_are_matched_as_their_rows(spark):
    (gt, g), (pred, p) = copied(spark, 3, 40, 0), copied(spark, 4, 35, 100)
    for last_first in (False, True):
        want = set()
        for f in range(3):
            rows = [(overlap(a, b), a[2], b[2]) for a in g for b in p if a[1] == b[1] == f and overlap(a, b) >= 0.4]
            want |= {(f, rows[i][1], rows[i][2]) for i in matching.greedy(rows, last_first)}
        assert {(r.frame, r.gt_track_id, r.pred_track_id) for r in matching.greedy_match(gt, pred, 0.4, last_first).collect()} == want
    links = [(1.0, 0, 0), (1.0, 0, 1), (1.0, 1, 0), (0.5, 1, 1)]  # three and one of a place meet two places of two
    assert [(i, a[0], b[0]) for i, a, b in matching.greedy_groups(links, {0: [(1,), (3,), (5,)], 1: [(2,)]}, {0: [(7,), (8,)], 1: [(6,), (9,)]})] == [(1.0, 1, 6), (1.0, 2, 7), (1.0, 3, 8), (1.0, 5, 9)]


def test_proposals_of_equal_boxes_keep_their_labels(spark):
    (gt, g), (pred, p) = copied(spark, 5, 30, 0), copied(spark, 6, 30, 100)
    proposals = pred.select("sequence", "frame", "track_id", F.concat("class", F.col("track_id").cast("string")).alias("label"), "conf", F.when(F.col("track_id") % 3 > 0, F.array("class")).alias("compatible"), "x", "y", "w", "h")
    by = {(b[1], b[2]): b for b in p}
    rows = matching.proposal_matches(gt, proposals).collect()
    assert rows
    for r in rows:
        b = by[r.frame, r.pred_track_id]
        assert (r.label, r.conf) == (f"{b[3]}{b[2]}", b[4]) and (b[2] % 3 == 0 or "ab"[r.gt_track_id % 2] == b[3])


def test_counts_and_summaries_of_copies(spark):
    (gt, g), (pred, p) = copied(spark, 7, 30, 0), copied(spark, 8, 30, 100)
    centre = lambda a: (a[5] + a[7] / 2, a[6] + a[8] / 2)
    near = {(a[1], a[2]): sum(b[2] != a[2] and b[1] == a[1] and np.hypot(centre(a)[0] - centre(b)[0], centre(a)[1] - centre(b)[1]) <= max(a[7], a[8]) for b in g) for a in g}
    assert {(r.frame, r.track_id): r.nearby for r in matching.nearby_count(gt, 1.0).collect()} == near
    pairs = matching.grounding_candidates(gt, pred)
    want = matching.resolve(pairs)
    key = lambda df: sorted((r.frame, r.box, r.track, r.score, r.margin, r.status) for r in df.collect())
    assert repr(key(matching.settled(matching.grounding_summary(gt, pred)))) == repr(key(want))
    for modulus in (7, 40):
        owner = lambda c: F.floor(F.col(c) % modulus)  # noqa: E731, B023
        whole = decisions.identity_scoped(pairs, owner("track") == F.col("box"))
        assert sorted(map(repr, decisions.scoped(matching.scoped_scores(gt, pred, owner("track_id"))).collect())) == sorted(map(repr, whole.collect()))


def test_cooldown_looks_at_the_nearest_only():
    r = random.Random(5)
    for _ in range(50):
        rows, frames, taken, want = [(r.randrange(60), r.random() < 0.2) for _ in range(40)], r.randrange(12), [], []
        for at, critical in rows:
            want.append(critical or all(abs(at - t) >= frames for t in taken))
            taken += [at] * want[-1]
        assert signals.cooldown(rows, frames) == want

    class Frame(int):
        seen = 0

        def __sub__(self, other):
            Frame.seen += 1
            return int(self) - other

    signals.cooldown([(Frame(10 * i), True) for i in range(300)] + [(Frame(10 * i + 5), False) for i in range(300)], 3)
    assert Frame.seen <= 2 * 600


def test_optimal_match_of_copies_shuffles_no_pairs(spark):
    from boxtrail.operators.assignment import transport

    rng = np.random.default_rng(2)
    for _ in range(40):
        n, m = rng.integers(1, 6, 2)
        weight, first, second = np.round(rng.random((n, m)) * 4), rng.integers(1, 4, n), rng.integers(1, 4, m)
        rows = np.repeat(np.repeat(weight, first, 0), second, 1)
        assert sum(weight[a, b] * k for a, b, k in transport(weight, first, second)) == sum(rows[a, b] for a, b in matching.hungarian(rows.max() - rows))
    schema = "sequence string, frame long, track_id long, x double, y double, w double, h double"
    gt = spark.createDataFrame([("s", 1, t, 5.0 * (t % 2), 0.0, 10.0, 10.0) for t in range(60)], schema)
    pred = spark.createDataFrame([("s", 1, 100 + t, 5.0 * (t % 2) + 1, 0.0, 10.0, 10.0) for t in range(50)], schema)
    found = matching.hungarian_match(gt, pred, 0.5)
    rows = found.collect()
    assert len({r.gt_track_id for r in rows}) == len({r.pred_track_id for r in rows}) == len(rows) == 50
    assert all(r.iou == pytest.approx(9 / 11) and r.gt_track_id % 2 == r.pred_track_id % 2 for r in rows)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_sort_assigns_equal_boxes_as_one(monkeypatch):
    from boxtrail.operators.assignment import transport

    shapes = []
    monkeypatch.setattr(tracker, "transport", lambda table, n, m: shapes.append((table.shape, m.tolist())) or transport(table, n, m))
    fold, boxes = tracker.Sort(0.2, 3, 1), np.array([[0.0, 0, 10, 10], [50, 0, 60, 10], [0, 0, 10, 10]])
    assert [(t, r) for t, r, _ in fold.step(boxes)] == [(1, 0), (2, 1), (3, 2)]
    assert {(t, r) for t, r, _ in fold.step(boxes[[1, 0, 2]])} in ({(1, 1), (2, 0), (3, 2)}, {(1, 2), (2, 0), (3, 1)})
    assert shapes == [((3, 2), [2, 1])]
    rng = np.random.default_rng(3)
    for _ in range(40):  # rows that bid one by one for places with room for several
        n, m = rng.integers(1, 9), rng.integers(2, 5)
        weight, room = np.round(rng.random((n, m)) * 5), rng.integers(1, 4, m)
        rows = np.repeat(weight, room, 1)
        assert sum(weight[a, b] for a, b, _ in transport(weight, np.ones(n, int), room)) == sum(rows[a, b] for a, b in matching.hungarian(rows.max() - rows))


def test_proposals_meet_in_tasks_without_a_join(spark):
    (gt, g), (pred, p) = copied(spark, 9, 30, 0), copied(spark, 10, 30, 100)
    proposals = pred.select("sequence", "frame", "track_id", F.col("class").alias("label"), "conf", F.when(F.col("track_id") % 3 > 0, F.array("class")).alias("compatible"), "x", "y", "w", "h")
    found = matching.proposal_matches(gt, proposals, 0.4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan  # neither pairs nor groups are shuffled

    def overlap(a, b):
        wide, high = (min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i]) for i in (5, 6))
        if min(wide, high, a[7], a[8], b[7], b[8]) <= 0:
            return 0.0
        common, one, other = wide * high, a[7] * a[8], b[7] * b[8]
        return min(1.0, max(common / (one + other - common), common / min(one, other)))

    want = set()
    for f in {a[1] for a in g}:
        rows = [(overlap(a, b), a[2], b[2]) for a in g for b in p if a[1] == b[1] == f and (b[2] % 3 == 0 or a[3] == b[3]) and overlap(a, b) >= 0.4]
        want |= {(f, *rows[i]) for i in matching.greedy(rows, True)}
    got = {(r.frame, r.iou, r.gt_track_id, r.pred_track_id) for r in found.collect()}
    assert {(f, a, b) for f, _, a, b in got} == {(f, a, b) for f, _, a, b in want} and len(got) == len(want)
    assert matching.proposal_matches(gt, proposals.limit(0), 0.4).count() == 0
