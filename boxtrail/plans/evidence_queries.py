"""Queries of evidence: grounded boxes for candidates, timelines of targets, plans of verification, the source of shown labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.operators import evidence, fusion, tracks
from boxtrail.plans import bridge as b
from boxtrail.plans.catalog import query
from boxtrail.plans.label_queries import MEMORY
from boxtrail.plans.track_queries import DIAGONAL_SQL, rounded, sql

#: Three of four moved boxes are grounded; one sequence has no results.
GROUNDED = f"""cand AS (SELECT DISTINCT sequence, track_id FROM obs WHERE track_id % 2 = 0),
found AS (SELECT * FROM pred WHERE sequence <> 's3' AND event_id % 4 <> 0),
fit AS (SELECT o.sequence, o.track_id, o.frame, max(0.55 * inter / (o.w * o.h + fw * fh - inter) + 0.30 * inter / (o.w * o.h) + 0.15 * greatest(0, 1 - sqrt(pow(o.x + o.w / 2 - fx - fw / 2, 2) + pow(o.y + o.h / 2 - fy - fh / 2, 2)) / {DIAGONAL_SQL})) AS score
  FROM (SELECT o.*, f.x AS fx, f.y AS fy, f.w AS fw, f.h AS fh, greatest(0, least(o.x + o.w, f.x + f.w) - greatest(o.x, f.x)) * greatest(0, least(o.y + o.h, f.y + f.h) - greatest(o.y, f.y)) AS inter FROM obs o JOIN cand USING (sequence, track_id) JOIN found f USING (sequence, frame)) o GROUP BY o.sequence, o.track_id, o.frame),
ev AS (SELECT sequence, track_id, CASE WHEN sequence IN (SELECT sequence FROM found) THEN coalesce(mean, 0) END AS score, coalesce(n, 0) AS frames FROM cand LEFT JOIN (SELECT sequence, track_id, avg(score) AS mean, count(*) AS n FROM fit GROUP BY sequence, track_id) USING (sequence, track_id))"""


@query("grounding_evidence", sql(b.OBS, b.PRED, GROUNDED, body="""SELECT sequence, track_id, round(score, 6) AS score, frames, CASE WHEN score IS NULL THEN 'no_grounding_results_available' WHEN frames = 0 THEN 'no_grounding_box_matched_candidate' ELSE 'grounding_track_compatibility' END AS reason,
  score IS NULL OR score >= 0.5 AS passed, CASE WHEN score IS NULL THEN 'grounding_unavailable' WHEN score >= 0.5 THEN 'grounding_supported' ELSE 'below_minimum_grounding_score' END AS gate FROM ev"""))
def grounding_evidence(spark, d):
    o = b.obs(spark, d)
    found = b.pred(spark, d).where("sequence <> 's3' AND event_id % 4 <> 0")
    e = evidence.grounding_evidence(o.where("track_id % 2 = 0").select(*b.KEY).distinct(), found, o, *b.CANVAS)
    return rounded(evidence.grounding_gate(e, 0.5, required=False), "score")


#: Fusion selects the second of two sequences, and the third of one of these is asked for; one sequence each lacks appearance and fusion.
TIMELINE = """target AS (SELECT sequence, track_id, score FROM rk WHERE rank = CASE sequence WHEN 's1' THEN 2 WHEN 's2' THEN 3 ELSE 1 END),
app AS (SELECT sequence, track_id, coverage FROM rk WHERE track_id % 3 <> 0 AND sequence <> 's0'),
fu AS (SELECT sequence, track_id, CASE WHEN track_id % 5 <> 0 THEN score / 2 + quality / 2 END AS fused FROM rk WHERE sequence <> 's3'),
fs AS (SELECT t.sequence, max(fused) FILTER (f.track_id = t.track_id) AS fused, max(fused) FILTER (f.track_id <> t.track_id) AS other, count(fused) AS candidates FROM target t JOIN fu f USING (sequence) GROUP BY ALL),
spine AS (SELECT sequence, unnest(range(min(frame), max(frame) + 1)) AS frame FROM obs GROUP BY sequence)"""


@query("target_timeline", sql(b.OBS, b.EVIDENCE, MEMORY, TIMELINE, body="""SELECT s.sequence, s.frame, t.track_id AS target, o.track_id IS NOT NULL AS present, o.track_id, o.x, o.y, o.w, o.h, o.x + o.w / 2 AS cx, o.y + o.h / 2 AS cy, o.conf,
  CASE WHEN e.frame IS NOT NULL THEN round(t.score, 6) END AS semantic, round(a.coverage, 6)::DOUBLE AS appearance, round(f.fused, 6) AS fused, CASE WHEN f.fused IS NOT NULL THEN round(other, 6) END AS runner_up, round(f.fused - other, 6) + 0.0 AS margin, candidates,
  CASE WHEN o.track_id IS NULL THEN 'absent' ELSE 'present' END AS tracking_from, CASE WHEN o.conf IS NULL THEN 'unavailable' ELSE 'mot_confidence' END AS conf_from, CASE WHEN e.frame IS NULL THEN 'session_level_only' ELSE 'sampled_frame' END AS semantic_from,
  CASE WHEN s.sequence = 's0' THEN 'missing_appearance_artifact' WHEN a.track_id IS NULL THEN 'track_not_in_appearance_artifact' ELSE 'scored' END AS appearance_from, CASE WHEN s.sequence = 's3' THEN 'missing_fusion_artifact' WHEN f.fused IS NULL THEN 'track_not_in_fusion_artifact' ELSE 'session_level' END AS fused_from
FROM spine s JOIN target t USING (sequence) LEFT JOIN obs o ON o.sequence = s.sequence AND o.frame = s.frame AND o.track_id = t.track_id LEFT JOIN (SELECT DISTINCT sequence, track_id, frame FROM evidence WHERE event_id % 3 = 0) e ON e.sequence = s.sequence AND e.frame = s.frame AND e.track_id = t.track_id
LEFT JOIN app a ON a.sequence = s.sequence AND a.track_id = t.track_id LEFT JOIN fs f ON f.sequence = s.sequence"""))
def target_timeline(spark, d):
    e = b.evidence(spark, d)
    m = fusion.semantic_memory(e, 40)
    targets = evidence.current_tracks(m, m.where("rank = 2 AND sequence IN ('s1', 's2')"), m.where("rank = 3 AND sequence = 's2'"))
    appearance = m.where("track_id % 3 <> 0 AND sequence <> 's0'").select(*b.KEY, F.col("coverage").alias("appearance"), F.lit("scored").alias("status"))
    fused = m.where("sequence <> 's3'").select(*b.KEY, F.when(F.col("track_id") % 5 != 0, F.col("score") / 2 + F.col("quality") / 2).alias("fused"))
    rows = evidence.target_timeline(b.obs(spark, d), targets, m, e.where("event_id % 3 = 0"), appearance, fused)
    return rounded(rows, "semantic", "appearance", "fused", "runner_up", "margin")


#: A class is found twice by event_id's parity; two answers for a track, of which a fifth are unknown; frames by event_id modulo 4.
PLAN = """objects AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY f) AS position, class || '-' || odd AS display, (f % 10) / 10 AS confidence, f % 3 = 0 AS open, CASE f % 4 WHEN 0 THEN 'ignore' WHEN 1 THEN 'detect' ELSE 'track' END AS action FROM (SELECT sequence, class, event_id % 2 AS odd, min(event_id) AS f FROM obs GROUP BY ALL)),
answers AS (SELECT sequence, track_id, min(event_id) AS position, arg_min(CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE class || '-' || track_id % 3 END, event_id) AS label, arg_min(conf, event_id) AS confidence FROM obs GROUP BY sequence, track_id, event_id % 2),
gone AS (SELECT DISTINCT sequence, track_id FROM (SELECT *, lead(frame) OVER (PARTITION BY sequence, track_id ORDER BY frame) - frame - 1 AS gap FROM obs) WHERE gap >= 60),
back AS (SELECT g.sequence, g.track_id, k.label FROM (SELECT * FROM gone QUALIFY row_number() OVER (PARTITION BY sequence ORDER BY track_id) <= 3) g LEFT JOIN (SELECT sequence, track_id, arg_max(label, position) AS label FROM answers WHERE label <> 'unknown' GROUP BY ALL) k USING (sequence, track_id)),
found AS MATERIALIZED (
  SELECT sequence, class, display, CASE WHEN open THEN 'open_vocabulary_class' ELSE 'low_discovery_confidence' END AS trigger, 0 AS stage, position AS a, 0 AS b, NULL::BIGINT AS track_id FROM objects WHERE action <> 'ignore' AND (open OR confidence < 0.65)
  UNION ALL SELECT sequence, label, label, 'low_qwen_semantic_confidence', 1, position, 0, track_id FROM answers WHERE label <> 'unknown' AND confidence < 0.65
  UNION ALL SELECT sequence, label, label, 'identity_reacquisition', 2, track_id, 0, track_id FROM back WHERE label IS NOT NULL
  UNION ALL SELECT sequence, o.class, o.class, 'identity_reacquisition', 2, track_id, position, track_id FROM back JOIN objects o USING (sequence) WHERE label IS NULL AND action = 'track'
  UNION ALL SELECT sequence, o.class, o.display, 'qwen_unknown_track', 3, o.position, track_id, track_id FROM (SELECT DISTINCT sequence, track_id FROM answers WHERE label = 'unknown') JOIN objects o USING (sequence) WHERE action = 'track'),
first AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY stage, a, b) - 1 AS i FROM (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY sequence, class ORDER BY stage, a, b) = 1)),
classes AS (SELECT f.sequence, f.class, f.i, coalesce(l.display, f.display) AS display, coalesce(l.trigger, f.trigger) AS trigger FROM first f LEFT JOIN (SELECT * FROM found WHERE stage = 0 QUALIFY row_number() OVER (PARTITION BY sequence, class ORDER BY a DESC) = 1) l USING (sequence, class) WHERE i < 6),
wanted AS (SELECT c.*, x.track_id FROM classes c LEFT JOIN (SELECT DISTINCT sequence, class, track_id FROM found WHERE track_id IS NOT NULL QUALIFY dense_rank() OVER (PARTITION BY sequence, class ORDER BY track_id) <= 3) x USING (sequence, class)),
shots AS (SELECT *, row_number() OVER (PARTITION BY sequence, track_id ORDER BY frame) - 1 AS n FROM (SELECT sequence, track_id, frame, event_id % 4 AS kind, 'f/' || frame AS path FROM obs WHERE event_id % 4 IN (1, 2) QUALIFY rank() OVER (PARTITION BY sequence, track_id ORDER BY event_id % 4) = 1)),
views AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY frame) - 1 AS n FROM (SELECT DISTINCT sequence, frame, 'f/' || frame AS path FROM obs WHERE frame % 50 = 0))"""


@query("verification_plan", sql(b.OBS, PLAN, body="""SELECT w.sequence, CASE WHEN w.track_id IS NULL THEN printf('%02d_%02d', w.i, coalesce(s.n, v.n)) ELSE printf('%02d_t%04d_%02d', w.i, w.track_id, coalesce(s.n, v.n)) END AS request, w.class,
  'the ' || w.display || CASE WHEN s.n IS NOT NULL THEN ' inside the tracking box labeled ID ' || w.track_id ELSE '' END AS query, 'the ' || w.display AS localized, coalesce(s.frame, v.frame) AS frame, coalesce(s.path, v.path) AS path, w.trigger, w.track_id AS expected, CASE WHEN s.n IS NOT NULL THEN w.track_id END AS target
FROM wanted w LEFT JOIN shots s ON s.sequence = w.sequence AND s.track_id = w.track_id AND s.n < 2 LEFT JOIN views v ON s.n IS NULL AND v.sequence = w.sequence AND v.n < 2 WHERE coalesce(s.n, v.n) IS NOT NULL"""))
def verification_plan(spark, d):
    o, n, f = b.obs(spark, d), F.col("event_id"), F.col("f")
    objects = o.groupBy("sequence", "class", (n % 2).alias("odd")).agg(F.min(n).alias("f"))
    objects = objects.withColumns({
        "position": F.row_number().over(W.partitionBy("sequence").orderBy("f")), "display": F.concat_ws("-", "class", F.col("odd").cast("string")), "confidence": (f % 10) / 10, "open": f % 3 == 0,
        "action": F.when(f % 4 == 0, "ignore").when(f % 4 == 1, "detect").otherwise("track"),
    })
    label = F.when(n % 5 == 0, "unknown").otherwise(F.concat_ws("-", "class", (F.col("track_id") % 3).cast("string")))
    answers = o.groupBy(*b.KEY, n % 2).agg(F.min(n).alias("position"), F.min_by(label, n).alias("label"), F.min_by("conf", n).alias("confidence"))
    gaps = tracks.track_gaps(o).groupBy(*b.KEY).agg(F.max("gap_frames").alias("gap"))
    path = F.concat(F.lit("f/"), F.col("frame").cast("string")).alias("path")
    shots = lambda kind: o.where(n % 4 == kind).select(*b.KEY, F.col("frame").alias("position"), "frame", path)
    overview = o.where("frame % 50 = 0").select("sequence", F.col("frame").alias("position"), "frame", path).distinct()
    return evidence.verification_plan(objects, answers, gaps, shots(1), shots(2), overview, most_classes=6, least_gap=60)


#: Of five tracks two are accepted, one is cached but not, one waits; hints for colours are unknown words at times.
SOURCE = """cache AS (SELECT sequence, track_id, track_id % 5 < 2 AS accepted, CASE WHEN track_id % 7 <> 0 THEN kind END AS detector, CASE WHEN track_id % 2 = 0 THEN kind ELSE 'big ' || kind END AS label, CASE track_id % 3 WHEN 0 THEN 'old ' || kind WHEN 1 THEN 'unknown' END AS fine, track_id % 4 <> 3 AS fine_accepted, top AS confidence, CASE track_id % 3 WHEN 0 THEN 'Red' WHEN 1 THEN '' END AS colour
  FROM (SELECT sequence, track_id, arg_min(class, frame) AS kind, max(conf) AS top FROM obs GROUP BY ALL) WHERE track_id % 5 < 3),
said AS (SELECT o.sequence, o.track_id, o.frame, o.class, c.track_id IS NOT NULL AS cached, coalesce(c.accepted, false) AS accepted, coalesce(c.detector, o.class) AS base, c.label, c.fine, c.fine_accepted, c.confidence, lower(coalesce(nullif(trim(c.colour), ''), CASE o.event_id % 3 WHEN 0 THEN 'blue' WHEN 1 THEN 'shiny' END)) AS colour, o.track_id % 5 = 3 AS waits FROM obs o LEFT JOIN cache c USING (sequence, track_id)),
detailed AS (SELECT *, CASE WHEN fine_accepted AND fine NOT IN ('unknown', base, label) THEN fine WHEN label <> base THEN label ELSE base END AS detail FROM said),
deeper AS (SELECT *, CASE WHEN colour IN ('red', 'blue') AND NOT list_contains(string_split(detail, ' '), colour) THEN colour || ' ' || detail ELSE detail END AS deep FROM detailed)"""


@query("label_source", sql(b.OBS, SOURCE, body="""SELECT sequence, track_id, frame, class, CASE WHEN accepted THEN 'accepted' WHEN cached THEN 'unknown' WHEN waits THEN 'pending' ELSE 'waiting' END AS status,
  CASE WHEN accepted THEN CASE WHEN deep = base THEN base ELSE base || ' | ' || deep END WHEN cached THEN class || ' | unknown' ELSE class END AS shown, CASE WHEN accepted THEN deep END AS deep, CASE WHEN accepted THEN confidence END AS confidence FROM deeper"""))
def label_source(spark, d):
    o, n, t = b.obs(spark, d), F.col("event_id"), F.col("track_id")
    rows = o.select(*b.KEY, "frame", "class", F.lit(None).cast("string").alias("fast"), F.when(n % 3 == 0, "blue").when(n % 3 == 1, "shiny").alias("colour"))
    c = o.groupBy(*b.KEY).agg(F.min_by("class", "frame").alias("kind"), F.max("conf").alias("confidence")).where(t % 5 < 3)
    cache = c.select(
        *b.KEY, (t % 5 < 2).alias("accepted"), F.when(t % 7 != 0, F.col("kind")).alias("detector"), F.when(t % 2 == 0, F.col("kind")).otherwise(F.concat(F.lit("big "), "kind")).alias("label"),
        F.when(t % 3 == 0, F.concat(F.lit("old "), "kind")).when(t % 3 == 1, "unknown").alias("fine"), (t % 4 != 3).alias("fine_accepted"), "confidence", F.when(t % 3 == 0, "Red").when(t % 3 == 1, "").alias("colour"),
    )
    return evidence.label_source(rows, cache, o.where(t % 5 == 3), enabled=True).drop("fast", "colour")
