"""Queries over labels as shown, joins of predictions, reports, gates, and functions of crops and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtrail.functions import geometry as g
from boxtrail.functions import labels, scalars
from boxtrail.operators import filters, fusion, reports, segments, signals, tracks, validate, vocabulary
from boxtrail.plans import bridge as b
from boxtrail.plans.catalog import query
from boxtrail.plans.track_queries import rounded, sql

TEXTS = ["walking on the road", "red car", "talking, holding a cup", "running_dog", "Standing in", "unknown", "", "sitting at the"]


def number():
    return F.col("event_id")


def pick(values, column):
    """A value of a list by a number, as a Column."""
    return F.get(F.array(*[F.lit(v) for v in values]), (column % len(values)).cast("int"))


@query("action_or_noun", """SELECT text, action, count(*) AS n FROM events JOIN (VALUES (0, 'walking on the road', false), (1, 'red car', false), (2, 'talking, holding a cup', true), (3, 'running_dog', false),
  (4, 'Standing in', true), (5, 'unknown', false), (6, '', false), (7, 'sitting at the', true)) v(k, text, action) ON event_id % 8 = k GROUP BY ALL""")
def action_or_noun(spark, d):
    t = b.table(spark, d, "events").select(pick(TEXTS, number()).alias("text"))
    return t.select("text", labels.is_action(F.col("text")).alias("action")).groupBy("text", "action").agg(F.count("*").alias("n"))


@query("display_labels", sql(b.OBS, """v AS (SELECT event_id, class AS base, CASE event_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL WHEN 2 THEN upper(class) ELSE class || ' one' END AS label, CASE event_id % 3 WHEN 0 THEN 'Big ' || class WHEN 1 THEN class END AS fine,
  event_id % 2 = 0 AS ok, CASE WHEN event_id % 7 = 0 THEN 'red thing' END AS fast, [' RED ', 'teal', 'blue', NULL][(event_id % 4)::INT + 1] AS colour FROM obs),
p AS (SELECT *, CASE WHEN ok AND event_id % 3 = 0 THEN fine WHEN event_id % 5 > 2 THEN label WHEN event_id % 7 = 0 THEN fast ELSE base END AS detail FROM v)""", body="""
SELECT event_id, CASE WHEN event_id % 4 = 0 AND detail <> 'red thing' THEN 'red ' || detail WHEN event_id % 4 = 2 THEN 'blue ' || detail ELSE detail END AS shown FROM p"""))
def display_labels(spark, d):
    c = F.col("class")
    label = F.when(number() % 5 == 0, "unknown").when(number() % 5 == 2, F.upper(c)).when(number() % 5 > 2, F.concat(c, F.lit(" one")))
    fine = F.when(number() % 3 == 0, F.concat(F.lit("Big "), c)).when(number() % 3 == 1, c)
    shown = labels.display_label(c, label, fine, number() % 2 == 0, F.when(number() % 7 == 0, "red thing"), pick([" RED ", "teal", "blue", None], number()))
    return b.obs(spark, d).select("event_id", shown.alias("shown"))


@query("semantic_hints", sql(b.OBS, body="""SELECT event_id, CASE WHEN event_id % 4 <> 0 AND conf >= 0.65 THEN class END AS label, CASE WHEN conf >= 0.55 THEN 'red' END AS colour, event_id % 4 <> 0 AND conf > 0 AND conf < 0.65 AS focus FROM obs"""))
def semantic_hints(spark, d):
    label = F.when(number() % 4 == 0, "unknown").otherwise(F.col("class"))
    return b.obs(spark, d).select("event_id", labels.hint(label, F.col("conf"), 0.65).alias("label"), labels.hint(F.lit("red"), F.col("conf"), 0.55).alias("colour"), labels.needs_focus(label, F.col("conf")).alias("focus"))


SAID = (["abc", "1.7", "-0.2", "0.5", "inf", None, " 0.25 "], ["role", "Make-Model", " Sub type", "odd", "MEDICAL", None], ["0.75", "1.2", "nan", None], [["2", "9", "1"], ["2", "2"], ["7", "x", "-1", "2"], []], [" Keeper ", "", None])


@query("sanitize_output", f"""WITH said AS (SELECT event_id, {SAID[0]}[(event_id % 7)::INT + 1] AS c, {SAID[1]}[(event_id % 6)::INT + 1] AS kind, {SAID[2]}[(event_id % 4)::INT + 1] AS fc, {SAID[3]}[(event_id % 4)::INT + 1] AS f, {SAID[4]}[(event_id % 3)::INT + 1] AS l FROM events),
num AS (SELECT *, coalesce(TRY_CAST(trim(c) AS DOUBLE), 'nan'::DOUBLE) AS x, coalesce(TRY_CAST(trim(fc) AS DOUBLE), 'nan'::DOUBLE) AS y, replace(replace(lower(trim(coalesce(kind, 'unknown'))), '-', '_'), ' ', '_') AS k, list_sort(list_distinct(list_filter(list_transform(f, lambda v: TRY_CAST(v AS BIGINT)), lambda v: v > 0))) AS n FROM said),
held AS (SELECT *, CASE WHEN isfinite(x) THEN greatest(0, least(1, x)) ELSE 0 END::DOUBLE AS cx, CASE WHEN isfinite(y) THEN greatest(0, least(1, y)) ELSE 0 END::DOUBLE AS cy, list_contains({list(labels.FINE_TYPES)}, k) AS known, list_filter(n, lambda v: v IN (1, 2) OR event_id % 5 = 0) AS kept FROM num)
SELECT event_id, cx AS confidence, CASE WHEN known AND trim(coalesce(l, 'unknown')) <> '' THEN trim(coalesce(l, 'unknown')) ELSE 'unknown' END AS fine_label, CASE WHEN known THEN k ELSE 'unknown' END AS fine_type, CASE WHEN known THEN cy ELSE 0.0 END::DOUBLE AS fine_confidence, array_to_string(kept, ',') AS frames,
  concat_ws(',', CASE WHEN c IS NOT NULL AND cx IS DISTINCT FROM x THEN 'invalid_confidence_bounded:confidence' END, CASE WHEN fc IS NOT NULL AND cy IS DISTINCT FROM y THEN 'invalid_confidence_bounded:fine_confidence' END, CASE WHEN NOT known THEN 'unsupported_fine_label_type' END, CASE WHEN len(kept) < len(n) THEN 'unsupported_evidence_frames_removed' END) AS warnings FROM held""".replace("None", "NULL"))
def sanitize_output(spark, d):
    text = lambda i: pick(SAID[i], number())
    frames = F.get(F.array(*[F.array(*[F.lit(v) for v in f]).cast("array<string>") for f in SAID[3]]), (number() % 4).cast("int"))
    allowed = F.when(number() % 5 != 0, F.array(F.lit(1), F.lit(2)))
    made = labels.sanitized(text(0), text(4), text(1), text(2), frames, allowed)
    out = b.table(spark, d, "events").select("event_id", *[c.alias(k) for k, c in made.items()])
    return out.withColumns({"frames": F.array_join(F.col("frames").cast("array<string>"), ","), "warnings": F.array_join("warnings", ",")})


@query("contrast_gate", "SELECT event_id, event_id % 3 = 0 OR (event_id % 3 = 1 AND event_id % 100 < 70) AS wanted FROM events")
def contrast_gate(spark, d):
    return b.table(spark, d, "events").select("event_id", labels.wants_contrast(pick(["clahe", "auto", "off"], number()), (number() % 100).cast("double")).alias("wanted"))


TRACKS = "tracks AS (SELECT sequence, track_id, count(*) AS n, min(class) AS label FROM obs GROUP BY ALL)"


def track_rows(spark, d):
    return b.obs(spark, d).groupBy("sequence", "track_id").agg(F.count("*").alias("n"), F.min("class").alias("label"))


INDEXED = """p AS (SELECT sequence, track_id, arg_max(class, event_id) AS predicted, arg_max(CASE WHEN event_id % 2 = 0 THEN 'resolved' WHEN event_id % 5 = 0 THEN 'not_found' ELSE 'ambiguous' END, event_id) AS status FROM obs WHERE event_id % 11 = 0 AND track_id % 4 <> 1 GROUP BY ALL),
ix AS (SELECT t.sequence, t.track_id, t.label, n, predicted, coalesce(status, 'missing_prediction') AS status FROM tracks t LEFT JOIN p USING (sequence, track_id))"""


def indexed(spark, d):
    status = F.when(number() % 2 == 0, "resolved").when(number() % 5 == 0, "not_found").otherwise("ambiguous")
    p = b.obs(spark, d).where("event_id % 11 = 0 and track_id % 4 <> 1").select("sequence", "track_id", F.col("class").alias("predicted"), status.alias("status"), "event_id")
    return reports.with_predictions(track_rows(spark, d), p, ["sequence", "track_id"], "event_id")


@query("prediction_index", sql(b.OBS, TRACKS, INDEXED, body="SELECT sequence, track_id, label, predicted, status FROM ix"))
def prediction_index(spark, d):
    return indexed(spark, d).select("sequence", "track_id", "label", "predicted", "status")


@query("first_evidence", sql(b.OBS, TRACKS, body="SELECT t.sequence, t.track_id, e.class, e.class IS NOT NULL AS available FROM tracks t LEFT JOIN (SELECT sequence, track_id, arg_min(class, event_id) AS class FROM obs WHERE track_id % 3 <> 0 GROUP BY ALL) e USING (sequence, track_id)"))
def first_evidence(spark, d):
    return reports.with_first_evidence(track_rows(spark, d).select("sequence", "track_id"), b.obs(spark, d).where("track_id % 3 <> 0"), ["sequence", "track_id"], "event_id", "class")


@query("metric_rows", "SELECT n_nationkey, count(c_custkey)::DOUBLE AS metric FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def metric_rows(spark, d):
    counted = b.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").cast("double").alias("metric"))
    return reports.metric_of(counted, "n_nationkey", counted.select("n_nationkey"), "metric")


@query("scored_partition", sql(b.OBS, TRACKS, body="SELECT sequence, track_id, CASE WHEN track_id % 5 = 0 THEN 'unknown' ELSE label END AS label, policy = 'keep' OR track_id % 5 <> 0 AS scored, policy FROM tracks CROSS JOIN (VALUES ('keep'), ('exclude')) v(policy)"))
def scored_partition(spark, d):
    t = track_rows(spark, d)
    keys = ["sequence", "track_id"]
    of = lambda policy: reports.scored_partition(t.select(*keys), t.where("track_id % 5 <> 0").select(*keys, "label"), keys, policy).select(*keys, "label", "scored")
    return reports.tagged_union({"keep": of("keep"), "exclude": of("exclude")}, "policy")


@query("manifest_record", """SELECT 's' || (user_id % 4) AS sequence, count(*) AS boxes, count(DISTINCT event_id // 3) AS frames, count(DISTINCT user_id) AS tracks, min(event_id // 3) AS first_frame, max(event_id // 3) AS last_frame FROM events GROUP BY ALL""")
def manifest_record(spark, d):
    e = b.table(spark, d, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("sequence"), F.floor(number() / 3).alias("frame"), F.col("user_id").alias("track_id"))
    return reports.manifest_record(e)


@query("ratio_split", "WITH r AS (SELECT n_name, row_number() OVER (ORDER BY md5('42:' || n_name), n_name) AS i, count(*) OVER () AS n FROM nation) SELECT n_name, CASE WHEN i <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN i <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM r")
def ratio_split(spark, d):
    return reports.ratio_split(b.table(spark, d, "nation"), "n_name", (0.7, 0.15, 0.15))


@query("efficiency_per_1000", sql(b.OBS, body="SELECT sequence, round(1000.0 * count(*) FILTER (event_id % 3 = 0) / count(DISTINCT frame), 6) AS calls FROM obs GROUP BY ALL"))
def efficiency_per_1000(spark, d):
    t = b.obs(spark, d).groupBy("sequence").agg(F.count_if(number() % 3 == 0).alias("c"), F.countDistinct("frame").alias("f"))
    return rounded(t.select("sequence", reports.calls_per_1000(F.col("c"), F.col("f")).alias("calls")), "calls")


@query("team_track_rates", sql(b.OBS, TRACKS, INDEXED, body="""SELECT sequence, count(*) AS tracks, round(avg((coalesce(label = predicted, false))::INT), 6) AS team_accuracy, round(avg((status <> 'missing_prediction')::INT), 6) AS coverage,
  round(avg((status IN ('not_found', 'missing_prediction'))::INT), 6) AS unknown_rate, round(avg((status = 'resolved' AND NOT coalesce(label = predicted, false))::INT), 6) AS wrong_team_rate,
  round(avg(CASE WHEN track_id % 2 = 0 THEN (track_id % 6 = 0)::INT END), 6) AS role_accuracy FROM ix GROUP BY ALL"""))
def team_track_rates(spark, d):
    rows = indexed(spark, d).withColumn("team", F.col("label")).withColumns({"role": F.when(F.col("track_id") % 2 == 0, "player"), "predicted_role": F.when(F.col("track_id") % 3 == 0, "player")})
    return rounded(reports.track_rates(rows, ["sequence"]), "team_accuracy", "coverage", "unknown_rate", "wrong_team_rate", "role_accuracy")


@query("team_query_rates", sql(b.OBS, body="""SELECT class, count(*) AS queries, round(avg((event_id % 4 = 0)::INT), 6) AS resolved_rate, round(avg((event_id % 4 = 1)::INT), 6) AS ambiguous_rate, round(avg((event_id % 4 > 1)::INT), 6) AS not_found_rate, round(avg((event_id % 3 = 0)::INT), 6) AS track_accuracy,
  round(avg((event_id % 6 = 0)::INT), 6) AS track_and_team_rate, round(avg(CASE WHEN event_id % 5 <> 0 THEN conf END), 6) AS support, round(avg(event_id % 7), 6) AS calls, round(avg(w), 6) AS seconds FROM obs GROUP BY ALL"""))
def team_query_rates(spark, d):
    status = pick(["resolved", "ambiguous", "not_found", "missing_prediction"], number())
    q = b.obs(spark, d).select("class", F.col("track_id").alias("track"), (F.col("track_id") + number() % 3).alias("selected"), (number() % 2 == 0).alias("team_correct"), status.alias("status"), F.when(number() % 5 != 0, F.col("conf")).alias("support"), (number() % 7).alias("calls"), F.col("w").alias("seconds"))
    return rounded(reports.query_rates(q, ["class"]), "resolved_rate", "ambiguous_rate", "not_found_rate", "track_accuracy", "track_and_team_rate", "support", "calls", "seconds")


@query("run_summary", sql(b.OBS, body="SELECT count(DISTINCT sequence) AS sequences, sum(f)::BIGINT AS frames, sum(n)::BIGINT AS detections, sum(t)::BIGINT AS tracks, sum(n) / 10.0 AS seconds, round(sum(f) / (sum(n) / 10.0), 6) AS fps FROM (SELECT sequence, count(DISTINCT frame) AS f, count(*) AS n, count(DISTINCT track_id) AS t FROM obs GROUP BY ALL)"))
def run_summary(spark, d):
    t = b.obs(spark, d).groupBy("sequence").agg(F.countDistinct("frame").alias("frames"), F.count("*").alias("detections"), F.countDistinct("track_id").alias("tracks"), (F.count("*") / 10.0).alias("seconds"))
    return rounded(reports.run_summary(t), "seconds", "fps")


@query("pipeline_costs", sql(b.OBS, TRACKS, """r AS (SELECT sequence, track_id, n AS frames, CASE WHEN track_id % 4 <> 0 THEN 25.0 END AS fps, CASE WHEN track_id % 3 = 0 THEN 2.5 END AS load, CASE WHEN track_id % 2 = 0 THEN 4.0 END AS inference, track_id % 7 AS pa, CASE WHEN track_id % 5 <> 0 THEN 3 END AS pb FROM tracks)""", body="""
SELECT sequence, track_id, round((coalesce(load, 0) + coalesce(inference, 0))::DOUBLE, 6) AS cold_seconds, round((CASE WHEN fps IS NULL OR coalesce(load, 0) + coalesce(inference, 0) = 0 THEN fps ELSE frames / (frames / fps + coalesce(load, 0) + coalesce(inference, 0)) END)::DOUBLE, 6) AS cold_fps, greatest(pa, coalesce(pb, pa))::BIGINT AS peak FROM r"""))
def pipeline_costs(spark, d):
    t = F.col("track_id")
    r = track_rows(spark, d).select("sequence", "track_id", F.col("n").alias("frames"), F.when(t % 4 != 0, 25.0).alias("tracking_fps"), F.when(t % 3 == 0, 2.5).alias("load"), F.when(t % 2 == 0, 4.0).alias("inference"), (t % 7).alias("peak_a"), F.when(t % 5 != 0, 3).alias("peak_b"))
    return rounded(reports.pipeline_costs(r).select("sequence", "track_id", "cold_seconds", "cold_fps", F.col("peak").cast("long").alias("peak")), "cold_seconds", "cold_fps")


@query("complete_labels", sql(b.OBS, TRACKS, body="""SELECT sequence, track_id, CASE WHEN track_id % 6 = 0 THEN label WHEN n % 50 < 6 OR track_id % 4 = 1 THEN 'unknown' ELSE 'near' END AS label, CASE WHEN track_id % 6 = 0 THEN 1.0 WHEN n % 50 < 6 OR track_id % 4 = 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence,
  CASE WHEN track_id % 6 = 0 THEN 'reviewed' WHEN n % 50 < 6 THEN 'too_few_rows' WHEN track_id % 4 = 1 THEN 'no_feature' ELSE 'prototype' END AS reason FROM tracks"""))
def complete_labels(spark, d):
    t = track_rows(spark, d)
    near = t.where("track_id % 4 <> 1").select("sequence", "track_id", F.lit("near").alias("near"), F.lit(0.5).alias("closeness"))
    return reports.complete_labels(t.select("sequence", "track_id", (F.col("n") % 50).alias("n")), t.where("track_id % 6 = 0"), near, ["sequence", "track_id"])


@query("semantic_margin_signal", sql(b.OBS, "m AS (SELECT sequence, track_id, arg_min(conf, frame) FILTER (event_id % 3 = 0 AND track_id % 5 <> 0) AS score FROM obs GROUP BY ALL)", body="SELECT sequence, track_id, round(score, 6) AS score, coalesce(score < 0.3, false) AS triggered, CASE WHEN score IS NULL THEN 'info' WHEN score < 0.15 THEN 'high' ELSE 'warning' END AS severity FROM m"))
def semantic_margin_signal(spark, d):
    o = b.obs(spark, d).withColumn("margin", F.when((number() % 3 == 0) & (F.col("track_id") % 5 != 0), F.col("conf")))
    return rounded(reports.margin_signal(o, ["sequence", "track_id"], "frame", "margin", 0.3), "score")


@query("shot_representatives", sql(b.OBS, "s AS (SELECT *, sum((event_id % 9 = 0)::INT) OVER (PARTITION BY sequence, track_id ORDER BY frame) AS shot FROM obs)", body="SELECT sequence, track_id, shot::BIGINT AS shot, arg_max(frame, (w, -frame)) AS representative, max(w) AS quality, count(*) AS rows FROM s GROUP BY ALL"))
def shot_representatives(spark, d):
    return reports.shot_representatives(b.obs(spark, d), ["sequence", "track_id"], "frame", number() % 9 == 0, "w")


@query("winner_delta", sql(b.OBS, "m AS (SELECT sequence, class, count(*) AS n FROM obs GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY n DESC, class) AS i FROM m)", body="SELECT sequence, max(CASE WHEN i = 1 THEN class END) AS winner, max(CASE WHEN i = 2 THEN class END) AS reference, max(CASE WHEN i = 1 THEN n END) - max(CASE WHEN i = 2 THEN n END) AS delta FROM c GROUP BY ALL"))
def winner_delta(spark, d):
    return reports.winner_delta(b.obs(spark, d).groupBy("sequence", "class").agg(F.count("*").alias("n")), ["sequence"], "class", "n")


@query("best_association", sql(b.OBS, "a AS (SELECT sequence || frame AS request, event_id, event_id % 4 <> 0 AS accepted, w, h, x FROM obs), k AS (SELECT *, row_number() OVER (PARTITION BY request, accepted ORDER BY w DESC, h DESC, x DESC, event_id) AS i FROM a)", body="SELECT request, event_id, accepted AND i = 1 AS accepted, CASE WHEN accepted AND i > 1 THEN 'lower_ranked_grounding_candidate' END AS reason FROM k"))
def best_association(spark, d):
    a = b.obs(spark, d).select(F.concat("sequence", F.col("frame").cast("string")).alias("request"), "event_id", (number() % 4 != 0).alias("accepted"), F.col("w").alias("confidence"), F.col("h").alias("margin"), F.col("x").alias("score"))
    return reports.best_association(a, "request", "event_id").select("request", "event_id", "accepted", "reason")


@query("tagged_union", sql(b.OBS, body="SELECT 'wide' AS stream, event_id, w, NULL::DOUBLE AS h FROM obs WHERE w > 50 UNION ALL SELECT 'high', event_id, NULL, h FROM obs WHERE h > 45"))
def tagged_union(spark, d):
    o = b.obs(spark, d)
    return reports.tagged_union({"wide": o.where("w > 50").select("event_id", "w"), "high": o.where("h > 45").select("event_id", "h")}).select("stream", "event_id", "w", "h")


@query("ordered_union", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'b,a,c' WHEN 1 THEN 'b,a' ELSE 'b,a,z' END AS names FROM events")
def ordered_union(spark, d):
    more = F.when(number() % 3 == 0, F.array(F.lit("a"), F.lit("c"))).when(number() % 3 == 1, F.array(F.lit("b"))).otherwise(F.array(F.lit("z"), F.lit("z")))
    return b.table(spark, d, "events").select("event_id", F.array_join(labels.ordered_union(F.array(F.lit("b"), F.lit("a")), more), ",").alias("names"))


@query("crop_gates", sql(b.OBS, """c AS (SELECT event_id, w, h, w * h AS area, (event_id % 10) / 10.0 AS visible, (event_id % 60)::DOUBLE AS sharp FROM obs),
r AS (SELECT *, concat_ws(',', CASE WHEN w < 30 THEN 'narrow' END, CASE WHEN h < 25 THEN 'short' END, CASE WHEN area < 800 THEN 'small' END, CASE WHEN visible < 0.5 THEN 'clipped' END, CASE WHEN sharp < 20 THEN 'blurry' END) AS reasons, visible * least(1.0, area / 3200) AS s FROM c)""", body="SELECT event_id, reasons, round((CASE WHEN reasons <> '' THEN least(s, 0.25) ELSE s END)::DOUBLE, 6) AS quality FROM r"))
def crop_gates(spark, d):
    visible, area = (number() % 10) / 10.0, F.col("w") * F.col("h")
    reasons = scalars.crop_reasons(F.col("w"), F.col("h"), area, visible, (number() % 60).cast("double"), {"width": 30, "height": 25, "area": 800, "visible": 0.5, "sharpness": 20})
    return rounded(b.obs(spark, d).select("event_id", F.array_join(reasons, ",").alias("reasons"), scalars.crop_quality(area, visible, reasons, 800).alias("quality")), "quality")


@query("queue_quality", sql(b.OBS, body="SELECT event_id, round(0.3 * (event_id % 10) / 10 + 0.2 * (event_id % 7) / 7 + 0.2 * w / 60 + 0.2 * conf + 0.1 * h / 50, 6) AS quality FROM obs"))
def queue_quality(spark, d):
    return rounded(b.obs(spark, d).select("event_id", scalars.queue_quality(number() % 10 / 10, number() % 7 / 7, F.col("w") / 60, F.col("conf"), F.col("h") / 50).alias("quality")), "quality")


@query("crop_to_source", sql(b.OBS, body="SELECT event_id, x / 2 + 10 AS x1, y / 4 + 5 AS y1, (x + w) / 2 + 10 AS x2, (y + h) / 4 + 5 AS y2 FROM obs"))
def crop_to_source(spark, d):
    box = g.crop_to_source(g.corners("x", "y", "w", "h"), F.lit(10.0), F.lit(5.0), F.lit(2.0), F.lit(4.0))
    return b.obs(spark, d).select("event_id", *[c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)])


@query("box_scales", sql(b.OBS, body="SELECT event_id, round(x, 6) AS x1, round(y + h, 6) AS y2, round_even(x / 1000 * 640, 0) AS grid_x, w * 2 AS scaled_w FROM obs"))
def box_scales(spark, d):
    w, h = b.CANVAS
    x, y = F.col("x"), F.col("y")
    yolo = g.yolo_denormalize((x + F.col("w") / 2) / w, (y + F.col("h") / 2) / h, F.col("w") / w, F.col("h") / h, w, h)
    twice = g.scaled(g.corners("x", "y", "w", "h"), 2.0, 3.0)
    return rounded(b.obs(spark, d).select("event_id", yolo.x1.alias("x1"), yolo.y2.alias("y2"), g.grid_to_pixels(x, 640.0).alias("grid_x"), (twice.x2 - twice.x1).alias("scaled_w")), "x1", "y2")


@query("event_priorities", sql(b.OBS, body="""SELECT event_id, round([3.0, 2.5, 1.0, 2.0][(event_id % 4)::INT + 1] + h / 100 + 0.25 * CASE WHEN event_id % 5 = 0 THEN 0 ELSE conf END, 6) AS priority, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 2 = 0 THEN 20 ELSE 4 END AS refresh FROM obs"""))
def event_priorities(spark, d):
    p = scalars.event_priority(pick(["new_track", "low_confidence", "periodic_refresh", "other"], number()), F.col("h") / 100, F.when(number() % 5 != 0, F.col("conf")))
    return b.obs(spark, d).select("event_id", p.alias("priority"), scalars.refresh_multiplier(F.when(number() % 3 != 0, F.col("class")), number() % 2 == 0).alias("refresh"))


@query("stable_ids", """SELECT user_id, event_type, 'ev_' || substr(sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 16) AS id FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def stable_ids(spark, d):
    return b.table(spark, d, "events").select("user_id", "event_type").distinct().withColumn("id", scalars.stable_id("ev", "user_id", "event_type"))


@query("merge_objects", sql(b.OBS, """o AS (SELECT sequence || '/' || frame AS scene, class AS canonical, conf, (event_id % 3)::INT AS level, 'a' || (event_id % 4) AS attribute FROM obs WHERE conf >= 0.15),
m AS (SELECT scene, canonical, max(conf) AS conf, max(level) AS level, string_agg(DISTINCT attribute, ',' ORDER BY attribute) AS attributes FROM o GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY level DESC, conf DESC, canonical) AS rank FROM m)""", body="SELECT scene, canonical, round(conf, 6) AS conf, ['ignore', 'detect_only', 'track'][level + 1] AS action, attributes, rank::INT AS rank FROM k WHERE rank <= 2"))
def merge_objects(spark, d):
    o = b.obs(spark, d).select(F.concat_ws("/", "sequence", F.col("frame").cast("string")).alias("scene"), F.col("class").alias("canonical"), "conf", pick(vocabulary.ACTIONS, number()).alias("action"), F.array(F.concat(F.lit("a"), (number() % 4).cast("string"))).alias("attributes"))
    return rounded(vocabulary.merge_objects(o, most=2).withColumn("attributes", F.array_join("attributes", ",")), "conf")


@query("closed_taxonomy", sql(b.OBS, body="""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'vehicle' WHEN 1 THEN 'vehicle' WHEN 2 THEN 'person' ELSE 'unknown' END AS label, round(CASE WHEN event_id % 4 = 3 THEN 1 - conf ELSE conf END, 6) AS confidence, CASE event_id % 4 WHEN 3 THEN 'other' WHEN 2 THEN 'people' ELSE 'cars' END AS family FROM obs"""))
def closed_taxonomy(spark, d):
    name = pick(["sports car", "vehicle", "player", "cloud"], number())
    label, confidence = vocabulary.closed_taxonomy(name, F.col("conf"), ["vehicle", "person"], {"sports car": "vehicle", "player": "person", "cloud": "sky"})
    return rounded(b.obs(spark, d).select("event_id", label.alias("label"), confidence.alias("confidence"), vocabulary.family(name, {"cars": ["car", "vehicle"], "people": ["player"]}).alias("family")), "confidence")


@query("track_or_detect", sql(b.OBS, body="SELECT class, CASE WHEN class IN ('click', 'view') THEN 'track' ELSE 'detect' END AS side, count(*) AS n FROM obs GROUP BY ALL"))
def track_or_detect(spark, d):
    inside, outside = filters.split_tracked(b.obs(spark, d), ["click", "view"])
    return reports.tagged_union({"track": inside, "detect": outside}, "side").groupBy("class", "side").agg(F.count("*").alias("n"))


@query("emission_policy", "SELECT event_id, event_id % 3 = 0 AND event_id % 4 = 0 AS strict, event_id % 3 <> 2 AND event_id % 4 <= 2 AS lenient FROM events")
def emission_policy(spark, d):
    state = pick(["confirmed", "tentative", "deleted"], number())
    return b.table(spark, d, "events").select("event_id", filters.emitted(state, number() % 4).alias("strict"), filters.emitted(state, number() % 4, False, 2).alias("lenient"))


@query("spatial_gate", sql(b.OBS, body="""SELECT event_id, conf >= 0.5 OR (event_id % 2 = 0 AND w / 60 >= 0.6) AS passed, CASE WHEN conf >= 0.5 OR (event_id % 2 = 0 AND w / 60 >= 0.6) THEN NULL WHEN event_id % 2 <> 0 THEN 'centre_outside' ELSE 'low_coverage' END AS reason FROM obs"""))
def spatial_gate(spark, d):
    passed, reason = filters.spatial_gate(F.col("conf"), number() % 2 == 0, F.col("w") / 60, 0.5, 0.6)
    return b.obs(spark, d).select("event_id", passed.alias("passed"), reason.alias("reason"))


@query("gate_list", sql(b.OBS, body="SELECT event_id, concat_ws(',', CASE WHEN NOT w > 30 THEN 'wide' END, CASE WHEN NOT conf > 0.4 THEN 'sure' END, CASE WHEN frame <= 5 OR event_id % 4 = 0 THEN 'old' END) AS failed FROM obs"))
def gate_list(spark, d):
    o = b.obs(spark, d).withColumn("age", F.when(number() % 4 != 0, F.col("frame")))
    return segments.gated(o, {"wide": "w > 30", "sure": "conf > 0.4", "old": "age > 5"}).select("event_id", F.array_join("failed", ",").alias("failed"))


@query("best_batch_prediction", sql(b.OBS, "p AS (SELECT 'b' || (frame % 5) AS batch, track_id, class, w, event_id FROM obs), e AS (SELECT DISTINCT batch, track_id FROM p WHERE track_id % 2 = 0 UNION SELECT DISTINCT batch, -1 FROM p)", body="SELECT e.batch, e.track_id, coalesce(arg_max(class, (w, -event_id)), 'unknown') AS label, coalesce(max(w), 0)::DOUBLE AS conf FROM e LEFT JOIN p USING (batch, track_id) GROUP BY ALL"))
def best_batch_prediction(spark, d):
    p = b.obs(spark, d).select(F.concat(F.lit("b"), (F.col("frame") % 5).cast("string")).alias("batch"), "track_id", F.col("class").alias("label"), F.col("w").alias("conf"), number().alias("position"))
    expected = p.where("track_id % 2 = 0").select("batch", "track_id").union(p.select("batch", F.lit(-1).cast("long"))).distinct()
    return fusion.best_batch_prediction(p, expected)


HALVES = "s AS (SELECT *, CASE WHEN frame <= 300 THEN 'old' ELSE 'new' END AS side FROM obs)"


@query("motion_evidence", sql(b.OBS, HALVES, """a AS (SELECT track_id AS event, arg_max(struct_pack(f := frame, x := x + w / 2, y := y + h / 2), frame) AS a FROM s WHERE side = 'old' GROUP BY ALL), z AS (SELECT track_id AS event, arg_min(struct_pack(f := frame, x := x + w / 2, y := y + h / 2), frame) AS z FROM s WHERE side = 'new' GROUP BY ALL),
m AS (SELECT event, z.f - a.f AS gap, sqrt(pow(z.x - a.x, 2) + pow(z.y - a.y, 2)) AS distance FROM a JOIN z USING (event))""", body="SELECT event, gap, round(distance, 6) AS distance, round(greatest(0, 1 - gap / 40), 6)::DOUBLE AS temporal, round(greatest(0, 1 - distance / 120), 6)::DOUBLE AS motion FROM m"))
def motion_evidence(spark, d):
    o = b.obs(spark, d).withColumn("event", F.col("track_id"))
    return rounded(segments.motion_evidence(o.where("frame <= 300"), o.where("frame > 300"), 120.0, 40), "distance", "temporal", "motion")


@query("probation", sql(b.OBS, "n AS (SELECT track_id AS event, frame FROM obs WHERE frame > 300), f AS (SELECT event, min(frame) AS first FROM n GROUP BY ALL)", body="SELECT event, count(*) FILTER (frame <= first + 20) >= 3 AS passed FROM n JOIN f USING (event) GROUP BY ALL"))
def probation(spark, d):
    return segments.probation_passed(b.obs(spark, d).where("frame > 300").select(F.col("track_id").alias("event"), "frame"))


@query("event_frames", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id + 4)::VARCHAR WHEN 1 THEN event_id || ',' || (event_id + 9) ELSE event_id || ',' || (event_id + 4) || ',' || (event_id + 9) END AS frames FROM events""")
def event_frames(spark, d):
    e = b.table(spark, d, "events").select("event_id", number().alias("s"), (number() + 4).alias("t"), (number() + 9).alias("e"))
    frames = [signals.event_frames("s", "t", "e", k) for k in (1, 2, 3)]
    chosen = F.when(number() % 3 == 0, frames[0]).when(number() % 3 == 1, frames[1]).otherwise(frames[2])
    return e.select("event_id", F.array_join(chosen.cast("array<string>"), ",").alias("frames"))


@query("manifest_faults", """WITH q AS (SELECT c_nationkey AS sequence, c_custkey AS query, c_custkey % 50 AS s, c_custkey % 70 AS e FROM customer UNION ALL SELECT c_nationkey, c_custkey, 1, 2 FROM customer WHERE c_custkey % 40 = 0)
SELECT subject, code FROM (
  SELECT sequence || '/' || query AS subject, 'unknown_sequence' AS code FROM q WHERE sequence >= 20
  UNION ALL SELECT sequence || '/' || query, 'bad_range' FROM q WHERE sequence < 20 AND (e < s OR s < 1 OR e > 60)
  UNION ALL SELECT c_nationkey || '/' || c_custkey, 'duplicate_query' FROM customer WHERE c_custkey % 40 = 0
  UNION ALL SELECT c_nationkey || '/' || (c_custkey + 1000000), 'segment_without_query' FROM customer WHERE c_custkey % 30 = 0)""")
def manifest_faults(spark, d):
    c, key = b.table(spark, d, "customer"), F.col("c_custkey")
    q = c.select(F.col("c_nationkey").alias("sequence"), key.alias("query"), (key % 50).alias("eval_start"), (key % 70).alias("eval_end"))
    q = q.union(c.where(key % 40 == 0).select("c_nationkey", "c_custkey", F.lit(1).cast("long"), F.lit(2).cast("long")))
    sequences = b.table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("sequence"), F.lit(60).alias("frame_count"))
    segments_ = c.select(F.col("c_nationkey").alias("sequence"), F.when(key % 30 == 0, key + 1000000).otherwise(key).alias("query"))
    return validate.manifest_issues(segments_, q, sequences)


CHECKS = """x AS (SELECT n_name AS name, n_nationkey::DOUBLE AS expected FROM nation WHERE n_nationkey <> 3), y AS (SELECT n_name AS name, n_nationkey + (n_nationkey % 4 = 1)::INT::DOUBLE AS found FROM nation WHERE n_nationkey <> 7),
k AS (SELECT name, expected, found, CASE WHEN found IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra' WHEN found <> expected THEN 'different' END AS code FROM x FULL JOIN y USING (name))"""


def checked(spark, d):
    n, key = b.table(spark, d, "nation"), F.col("n_nationkey")
    expected = n.where(key != 3).select(F.col("n_name").alias("name"), key.cast("double").alias("value"))
    actual = n.where(key != 7).select(F.col("n_name").alias("name"), (key + (key % 4 == 1).cast("int")).cast("double").alias("value"))
    return validate.cross_checks(actual, expected)


@query("cross_checks", sql(CHECKS, body="SELECT name, expected, found, code FROM k WHERE code IS NOT NULL"))
def cross_checks(spark, d):
    return checked(spark, d).select("name", "expected", "found", "code")


@query("release_gate", sql(CHECKS, body="SELECT count(code) = 0 AS ready, string_agg(name, ',' ORDER BY name) FILTER (code IS NOT NULL) AS failed FROM k"))
def release_gate(spark, d):
    ready = validate.release_gate(checked(spark, d).select("name", F.lit(False).alias("ok")))
    return ready.withColumn("failed", F.array_join("failed", ","))


@query("steady_state", sql(b.OBS, "k AS (SELECT *, row_number() OVER (PARTITION BY sequence, track_id ORDER BY frame) AS i, count(*) OVER (PARTITION BY sequence, track_id) AS n FROM obs)", body="SELECT sequence, track_id, count(*) AS rows, min(frame) AS first_frame FROM k WHERE i > least(5, n - 1) GROUP BY ALL"))
def steady_state(spark, d):
    return tracks.steady_state(b.obs(spark, d), ["sequence", "track_id"], "frame").groupBy("sequence", "track_id").agg(F.count("*").alias("rows"), F.min("frame").alias("first_frame"))
