"""HOTA, identity assignment, components, selection and identities against brute force and values worked out by hand."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxtrail.functions import labels
from boxtrail.operators import hota, identity, matching, metrics, reports, segments, selection
from boxtrail.operators.rounds import connected

BOX = "sequence string, track_id long, frame long, x double, y double, w double, h double"


def boxes(spark, rows):
    return spark.createDataFrame([("s", t, f, float(x), 0.0, 10.0, 10.0) for t, f, x in rows], BOX)


def test_hota_of_a_perfect_and_of_a_split_track(spark):
    gt = boxes(spark, [(1, f, 0) for f in range(10)])
    whole = hota.hota(hota.hota_by_alpha(gt, gt)).collect()
    assert {r.sequence for r in whole} == {"s", None} and all(r[m] == pytest.approx(1) for r in whole for m in hota.MEANS)
    split = boxes(spark, [(1 + f // 5, f, 0) for f in range(10)])
    row = hota.hota(hota.hota_by_alpha(gt, split)).where("sequence = 's'").first()
    # each half has 5 of 10 frames in common: an association of 1/2 at all thresholds
    assert (row.deta, row.assa, row.hota, row.assre, row.asspr) == pytest.approx((1, 0.5, 0.5**0.5, 0.5, 1))


def test_hota_with_one_empty_side(spark):
    gt = boxes(spark, [(1, f, 0) for f in range(4)])
    rows = hota.hota_by_alpha(gt, gt.limit(0)).collect()
    assert len(rows) == 19 and all((r.tp, r.fn, r.fp, r.hota, r.loca) == (0, 4, 0, 0, 1) for r in rows)


def test_alignment_prefers_the_track_that_stays(spark):
    # in frame 9 a stray box overlaps more than that of the track matched in all other frames
    gt = boxes(spark, [(1, f, 0) for f in range(10)])
    pred = boxes(spark, [(5, f, 2) for f in range(10)] + [(6, 9, 1)])
    assert {r.pred_track_id for r in hota.aligned_matches(gt, pred).collect()} == {5}


def most_in_common(edges):
    a, best = sorted({x for x, _, _ in edges}), 0
    weight = {(x, y): n for x, y, n in edges}
    targets = sorted({y for _, y, _ in edges}) + [None] * len(a)
    for chosen in set(itertools.permutations(targets, len(a))):
        best = max(best, sum(weight.get(p, 0) for p in zip(a, chosen, strict=True)))
    return best


def test_best_assignment_equals_all_assignments():
    rng = random.Random(2)
    for _ in range(150):
        edges = [(x, y, rng.randrange(1, 9)) for x in range(rng.randrange(1, 5)) for y in range(4) if rng.random() < 0.7]
        if edges:
            assert hota.best_assignment(edges) == most_in_common(edges)


def test_identity_true_positives_equal_all_assignments(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for s in range(12):
        edges = [(x, y, rng.randrange(1, 7)) for x in range(4) for y in range(4) if rng.random() < 0.5] or [(0, 0, 1)]
        want[f"s{s}"] = most_in_common(edges)
        rows += [(f"s{s}", x, y) for x, y, n in edges for _ in range(n)]
    got = hota.identity_true_positives(spark.createDataFrame(rows, "sequence string, gt_track_id long, pred_track_id long")).collect()
    assert {r.sequence: r.idtp for r in got} == want


def most_frames(weight):
    return int(sum(weight[i, j] for i, j in matching.hungarian(-weight.astype(float))))


@pytest.mark.parametrize("high", [2, 12])
def test_identity_assignment_solves_few_of_the_pairs_of_one_component(spark, high):
    # all tracks are linked, and many weights are equal; rivals for the same tracks need pairs that were not proposed at first
    weight = np.random.default_rng(high).integers(0, high, (70, 300))
    weight[:20, :5] += 20
    weight[20:50] = weight[20]
    common = spark.createDataFrame([("s", i, 1000 + j, int(n)) for (i, j), n in np.ndenumerate(weight) if n], hota.EDGES)
    proposed, propose = [], hota._counted(common)

    def counted(*prices):
        proposed.append(propose(*prices).count())
        return propose(*prices)

    assert hota._assigned(counted).first().idtp == most_frames(weight)
    assert len(proposed) > 2 and sum(proposed) < common.count() / 2


def test_identity_of_boxes_by_cells_equals_that_of_all_pairs(spark, monkeypatch):
    rng, rows = np.random.default_rng(5), {"gt": [], "pred": []}
    for side, tracks in (("gt", 14), ("pred", 18)):
        rows[side] = [(s, t, int(f), *map(float, (rng.integers(0, 4) * 4, rng.integers(0, 3) * 4, rng.choice([8, 10]), 10))) for s in "uv" for t in range(tracks) for f in rng.choice(30, 20, replace=False)]
    rows["gt"] += [("u", 3, 4, 0.0, 0.0, 0.0, 10.0), ("u", 3, 5, None, 0.0, 10.0, 10.0), ("only", 1, 1, 0.0, 0.0, 10.0, 10.0), *rows["gt"][:6]]  # no area, no place, no other side, rows given twice
    gt, pred = (spark.createDataFrame(rows[side], BOX) for side in ("gt", "pred"))
    pairs = matching.iou_pairs(gt, pred, 0.5).groupBy("sequence", "gt_track_id", "pred_track_id").count().collect()
    want = {}
    for s in "uv":
        weight = np.zeros((14, 18), int)
        for r in pairs:
            if r.sequence == s:
                weight[r.gt_track_id, r.pred_track_id] = r["count"]
        want[s] = most_frames(weight)
    for cell in (hota.CELL, 90):  # one cell, and four by four
        monkeypatch.setattr(hota, "CELL", cell)
        assert {r.sequence: r.idtp for r in hota.identity_matches(gt, pred, 0.5).collect()} == want
    shown = {r.sequence: r for r in metrics.identity_of_boxes(gt, pred, 0.5).collect()}
    assert shown == {r.sequence: r for r in metrics.identity_metrics(matching.iou_pairs(gt, pred, 0.5), gt, pred).collect()} and shown["only"].idtp == 0
    assert metrics.identity_of_boxes(gt, pred.limit(0)).where("idtp > 0").isEmpty()


def test_connected_chains_and_stars(spark):
    edges = [("a", i, i + 1) for i in range(40)] + [("a", 100, i) for i in range(101, 130)] + [("b", 3, 2), ("b", 2, 9)]
    got = {(r.s, r.node): r.root for r in connected(spark.createDataFrame(edges, "s string, a long, b long"), ["s"]).collect()}
    assert got == {**{("a", i): 0 for i in range(41)}, **{("a", i): 100 for i in range(100, 130)}, **{("b", i): 2 for i in (2, 3, 9)}}


def test_spread_evidence_takes_all_of_a_short_track_and_null_as_no_quality(spark):
    rows = spark.createDataFrame([("s", 1, 5, None), ("s", 1, 9, 0.2), ("s", 2, 1, 0.9), ("s", 2, 2, 0.89), ("s", 2, 50, 0.7)], "sequence string, track_id long, frame long, quality double")
    got = {(r.track_id, r.chosen): r.frame for r in selection.spread_evidence(rows, 2).collect()}
    assert got == {(1, 1): 9, (1, 2): 5, (2, 1): 1, (2, 2): 50}


def test_keyframes_without_candidates(spark):
    assert selection.keyframes(spark.createDataFrame([], "sequence string, frame long, shot long, quality double"), 3).count() == 0


def step(events, first=(7, 1)):
    it, out = identity.Identity(*first), []
    for e in events:
        out.append(it.step(*e))
    return it, out


def test_identity_provisional_closes_and_confirmation_needs_probation():
    it, out = step([("lost", 5), ("confirmed", 6), ("reacquiring", 6), ("provisional", 9, 3, 4, 0.8), ("provisional", 10, 4, 9, 0.1), ("confirmed", 20)])
    assert [legal for _, _, legal in out] == [True, False, True, True, False, True]
    assert it.segments == [[7, 1, 4, "closed", 1.0], [3, 9, None, "confirmed", 0.8]] and (it.state, it.raw, it.confirmed) == ("ACTIVE", 3, 20)


def test_identity_segments_of_a_target_without_events(spark):
    targets = spark.createDataFrame([("s", 1, 7, 2)], "sequence string, target long, raw long, frame long")
    events = spark.createDataFrame([], "sequence string, target long, event long, kind string, frame long, raw long, before long, confidence double")
    assert [tuple(r) for r in identity.segments_of(events, targets).collect()] == [("s", 1, 0, 7, 2, None, "confirmed", 1.0)]
    assert identity.transitions(events, targets).count() == 0


def test_reacquisition_follows_what_was_committed(spark):
    """Track 2 follows 1 and is confirmed; the second loss is then judged from 2, so that its own resumption counts and 3 is not looked at."""
    rows = [(1, f, 0) for f in range(1, 21)] + [(2, f, 1) for f in range(25, 41)] + [(2, f, 1) for f in range(50, 60)] + [(3, f, 2) for f in range(50, 60)]
    events = spark.createDataFrame([("s", 1, 1, "a", 21, 22, 21), ("s", 1, 2, "b", 45, 46, 45)], "sequence string, target long, n long, event string, start long, stop long, trigger long")
    targets = spark.createDataFrame([("s", 1, 1, 20)], "sequence string, target long, raw long, frame long")
    got = [(r.event, r.raw, r.status, r.selected, r.start_frame, r.confirmed) for r in identity.reacquire(events, targets, boxes(spark, rows), identity.Policy(after=10)).orderBy("n").collect()]
    assert got == [("a", 1, "provisional", 2, 25, True), ("b", 2, "same_raw_id_resumed", 2, 50, None)]
    assert identity.reacquire(events.limit(0), targets, boxes(spark, rows)).count() == 0


def test_reacquisition_scores_without_motion_when_the_held_track_was_not_seen_before(spark):
    rows = [(2, f, 1) for f in range(25, 31)]
    events = spark.createDataFrame([("s", 1, 1, "a", 21, 22, 21)], "sequence string, target long, n long, event string, start long, stop long, trigger long")
    targets = spark.createDataFrame([("s", 1, 9, 20)], "sequence string, target long, raw long, frame long")
    got = identity.reacquire(events, targets, boxes(spark, rows), identity.Policy(after=10)).first()
    assert (got.status, got.selected) == ("provisional", 2) and got.score == pytest.approx((0.15 * (1 - 5 / 12) + 0.1) / 0.25)


def test_equal_tracks_and_windows_are_looked_at_once_by_reacquisition(spark):
    rows = [(t, f, 0) for t in range(1, 301) for f in (1, 2)] + [(t, f, 1) for t in range(301, 601) for f in (40, 41, 60)]
    obs = boxes(spark, rows)
    placed = obs.select("sequence", "track_id", F.col("frame").cast("long").alias("frame"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    places = identity._places(placed, identity.Policy(), 20)
    assert sorted((r.frame, r.n, len(r.tracks)) for r in places.collect()) == [(1, 300, 3), (2, 300, 3), (40, 300, 3), (41, 300, 3), (60, 300, 3)]
    events = spark.createDataFrame([("s", t, 1, str(t), 3, 4, 3) for t in range(1, 301)], "sequence string, target long, n long, event string, start long, stop long, trigger long")
    targets = spark.createDataFrame([("s", t, t, 2) for t in range(1, 301)], "sequence string, target long, raw long, frame long")
    got = identity.reacquire(events, targets, obs, identity.Policy(after=60)).select("status", "candidates", "passed", "margin").distinct().collect()
    assert [tuple(r) for r in got] == [("ambiguous", 599, 300, 0.0)]  # the 299 others that were seen beside a lost one do not pass


def test_candidates_are_aggregated_where_windows_meet_rows(spark):
    obs = boxes(spark, [(1, 1, 0), (1, 200, 0), (2, 90, 0), (2, 150, 0), (3, 300, 0)])
    kinds = "sequence string, event string, track_id long, last long, start long, end long, trigger long"
    events = spark.createDataFrame([("s", e, t, 1, 2, 199, 2) for e, t in (("a", 1), ("b", 9))], kinds)  # two events of one window
    df = segments.candidates_in_window(events, obs)
    assert sorted(tuple(r) for r in df.collect()) == sorted(("s", e, t, k, *x, k == t) for e, t in (("a", 1), ("b", 9)) for k, x in ((1, (1, 200, 2)), (2, (90, 150, 2))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(sequence#" in plan and ", event#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


@pytest.mark.parametrize("total,ratios,sizes", [(6, (0.45, 0.45, 0.1), (2, 3, 1)), (4, (0.8, 0.2, 0.0), (3, 1, 0)), (3, (0.9, 0.05, 0.05), (1, 1, 1)), (2, (0.5, 0.25, 0.25), (1, 0, 1)), (0, (0.7, 0.2, 0.1), (0, 0, 0)), (25, (0.7, 0.15, 0.15), (18, 4, 3))])
def test_split_counts(total, ratios, sizes):
    assert reports.split_counts(total, ratios) == sizes


def test_sanitized_answers(spark):
    rows = [("1.7", "Breed ", "Make-Model", "-1", ["3", "1", "3", "x", "0"], None), (None, None, None, None, [], [1]), ("nan", "a", "planet", "0.4", ["2", "1"], [2])]
    df = spark.createDataFrame(rows, "c string, l string, k string, fc string, f array<string>, a array<bigint>")
    made = labels.sanitized(*[F.col(c) for c in ("c", "l", "k", "fc", "f", "a")])
    got = [tuple(r) for r in df.select(*made.values()).collect()]
    both = ["invalid_confidence_bounded:confidence", "invalid_confidence_bounded:fine_confidence"]
    assert got == [(1.0, "Breed", "make_model", 0.0, [1, 3], both), (0.0, "unknown", "unknown", 0.0, [], []), (0.0, "unknown", "unknown", 0.0, [2], [both[0], "unsupported_fine_label_type", "unsupported_evidence_frames_removed"])]


def test_pairs_that_no_box_proposes_first_are_still_matched(spark, monkeypatch):
    from boxtrail.operators.matching import hungarian, iou_table

    monkeypatch.setattr(hota, "BEST", 1)
    monkeypatch.setattr(hota, "MORE", 1)
    rng = np.random.default_rng(5)
    make = lambda n: [("s", 1, i, *map(float, rng.integers(0, 12, 2)), 20.0, 20.0) for i in range(n)]
    g, p = make(9), make(8)
    schema = "sequence string, frame long, track_id long, x double, y double, w double, h double"
    got = hota.aligned_matches(spark.createDataFrame(g, schema), spark.createDataFrame(p, schema)).collect()
    iou = iou_table(np.array([r[3:] for r in g]), np.array([r[3:] for r in p]))
    share = iou / (iou.sum(1)[:, None] + iou.sum(0) - iou)
    weight = iou * share / (2 - share)
    best = sum(weight[a, b] for a, b in hungarian(weight.max() - weight))
    assert len({r.gt_track_id for r in got}) == len({r.pred_track_id for r in got}) == len(got) == 8
    assert sum(weight[r.gt_track_id, r.pred_track_id] for r in got) == pytest.approx(best)


def test_equal_tracks_are_weighed_as_one_and_matched_one_by_one(spark):
    rng, schema = np.random.default_rng(8), "sequence string, frame long, track_id long, x double, y double, w double, h double"
    g = [("s", f, 10 * k + c, *map(float, rng.integers(0, 9, 2)), 12.0, 12.0) for k in range(4) for f in range(1, 7) for c in range(3)]
    first = {(f, t // 10): (x, y) for _, f, t, x, y, *_ in g}
    g = [("s", f, t, *first[f, t // 10], w, h) for _, f, t, _, _, w, h in g]  # three tracks of each kind
    p = [("s", f, 100 + t, x + 1, y, w, h) for _, f, t, x, y, w, h in g if (f + t) % 5]
    gt, pred = spark.createDataFrame(g, schema), spark.createDataFrame(p, schema)
    kinds = {r.track_id: (r.n, r.copies, r.members) for r in hota._kinds(gt, "gt").collect()}
    assert kinds == {10 * k: (6, 3, [10 * k, 10 * k + 1, 10 * k + 2]) for k in range(4)}
    matches = hota.aligned_matches(gt, pred).collect()
    for side in ("gt_track_id", "pred_track_id"):
        assert len({(r.frame, r[side]) for r in matches}) == len(matches) == len(p)
    apart = lambda rows: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", pos long")
    alone = hota.aligned_matches(apart(g), apart(p)).collect()  # places of their own: no track equals another
    boxes = [{(f, t): r for _, f, t, *r in rows} for rows in (g, p)]
    share = {}
    for f in range(1, 7):
        a, b = ([t for _, at, t, *_ in rows if at == f] for rows in (g, p))
        iou = iou_of([boxes[0][f, t] for t in a], [boxes[1][f, t] for t in b])
        part = iou / (iou.sum(1)[:, None] + iou.sum(0) - iou)
        share |= {(f, s, t): (iou[i, j], part[i, j]) for i, s in enumerate(a) for j, t in enumerate(b)}
    common = {}
    for (_, s, t), (_, part) in share.items():
        common[s, t] = common.get((s, t), 0) + part
    size = {t: sum(t == r[2] for r in p) for t in {r[2] for r in p}}
    weight = lambda rows: sum(share[r.frame, r.gt_track_id, r.pred_track_id][0] * common[r.gt_track_id, r.pred_track_id] / (6 + size[r.pred_track_id] - common[r.gt_track_id, r.pred_track_id]) for r in rows)
    assert weight(matches) == pytest.approx(weight(alone))
    by_alpha = {round(r.alpha, 2): r for r in hota.hota_by_alpha(gt, pred).collect()}
    again = {round(r.alpha, 2): r for r in hota.hota_by_alpha(gt, pred, spark.createDataFrame(matches)).collect()}
    assert all(by_alpha[a][m] == pytest.approx(again[a][m]) for a in by_alpha for m in (*hota.MEANS, "tp"))


def iou_of(a, b):
    from boxtrail.operators.matching import iou_table

    return iou_table(np.array(a), np.array(b))
