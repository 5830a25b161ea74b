"""Queries over decisions, reports and set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtrail.operators import decisions, fusion, matching, segments, tracks
from boxtrail.plans import bridge as b
from boxtrail.plans.catalog import query
from boxtrail.plans.label_queries import LANGUAGE, MEMORY, language
from boxtrail.plans.track_queries import CANDIDATES, GT_PAIRS, MATCHED, rounded, sql

PIXELS = "px AS (SELECT user_id, (event_id * 7) % 180 AS h, (event_id * 13) % 256 AS s, (event_id * 29) % 256 AS v FROM events)"


def pixels(spark, d):
    n = F.col("event_id")
    return b.table(spark, d, "events").select("user_id", ((n * 7) % 180).alias("h"), ((n * 13) % 256).alias("s"), ((n * 29) % 256).alias("v"))


NAMED = PIXELS + """, nm AS (SELECT *, CASE WHEN v < 25 THEN NULL
  WHEN s < 48 THEN CASE WHEN v < 68 THEN 'black' WHEN v < 132 THEN 'gray' WHEN v < 205 THEN 'silver' ELSE 'white' END
  WHEN h >= 170 OR h < 10 THEN 'red' WHEN h >= 140 THEN NULL WHEN h >= 85 THEN 'blue' WHEN h >= 38 THEN 'green' WHEN h >= 22 THEN 'yellow'
  WHEN v < 145 THEN 'brown' ELSE 'orange' END AS colour FROM px)"""


@query("dominant_colour", sql(NAMED, "n AS (SELECT user_id, colour, count(*) AS n FROM nm WHERE colour IS NOT NULL GROUP BY ALL)", body="SELECT user_id, CASE WHEN sum(n) >= 20 AND max(n) / sum(n) >= 0.2 THEN arg_min(colour, (-n, colour)) END AS colour, round(max(n) / sum(n), 6) AS confidence, sum(n)::BIGINT AS pixels FROM n GROUP BY ALL"))
def dominant_colour(spark, d):
    return decisions.dominant_colour(pixels(spark, d), ["user_id"], 20, 0.2)


@query("colour_features", sql(PIXELS, body="SELECT user_id, round(avg(cos(h * 2 * pi() / 180)), 6) + 0.0 AS hue_cos, round(avg(sin(h * 2 * pi() / 180)), 6) + 0.0 AS hue_sin, median(s)::DOUBLE AS s, median(v)::DOUBLE AS v FROM px GROUP BY ALL"))
def colour_features(spark, d):
    return rounded(decisions.colour_features(pixels(spark, d), ["user_id"]), "hue_cos", "hue_sin", "s", "v")


@query("histogram_distance", """WITH h AS (SELECT user_id, list(n ORDER BY k) AS h FROM (SELECT u.user_id, k, count(e.event_id)::DOUBLE + 1 AS n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS k) ks LEFT JOIN events e ON e.user_id = u.user_id AND e.event_id % 8 = k GROUP BY ALL) GROUP BY ALL),
c AS (SELECT a.user_id, a.h AS x, b.h AS y FROM h a JOIN h b ON b.user_id = a.user_id + 1)
SELECT user_id, round(sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(x, y), lambda z: sqrt(z[1] * z[2]))) / sqrt(list_sum(x) * list_sum(y)))), 6) AS distance FROM c""")
def histogram_distance(spark, d):
    e = b.table(spark, d, "events")
    counts = [(F.count_if(F.col("event_id") % 8 == k) + 1).cast("double") for k in range(8)]
    h = e.groupBy("user_id").agg(F.array(*counts).alias("h"))
    after = h.select((F.col("user_id") - 1).alias("user_id"), F.col("h").alias("next"))
    return h.join(after, "user_id").select("user_id", F.round(decisions.bhattacharyya(F.col("h"), F.col("next")), 6).alias("distance"))


FUSED = "fu AS (SELECT sequence, track_id, score AS semantic, CASE WHEN track_id % 3 <> 0 THEN coverage END AS appearance FROM rk), fr AS (SELECT *, round(greatest(0, least(1, coalesce(0.6 * semantic + 0.4 * appearance, greatest(0, semantic - 0.1)))), 9) AS fused FROM fu)"


@query("fused_scores", sql(b.OBS, b.EVIDENCE, MEMORY, FUSED, body="SELECT sequence, track_id, round(fused, 6) AS fused, row_number() OVER (PARTITION BY sequence ORDER BY fused DESC, semantic DESC, track_id)::INT AS rank FROM fr"))
def fused_scores(spark, d):
    m = fusion.semantic_memory(b.evidence(spark, d), 40)
    semantic = m.select("sequence", "track_id", F.col("score").alias("semantic"))
    appearance = m.where("track_id % 3 <> 0").select("sequence", "track_id", F.col("coverage").alias("appearance"))
    return rounded(decisions.fuse_scores(semantic, appearance, missing="penalize").select("sequence", "track_id", "fused", "rank"), "fused")


@query("identity_scoped_match", sql(b.OBS, b.PRED, GT_PAIRS, CANDIDATES, "s AS (SELECT sequence, frame, box, max(CASE WHEN track // 10 = box THEN score END) AS score, coalesce(max(CASE WHEN track // 10 <> box THEN score END), 0) AS other FROM c GROUP BY ALL)", body="""
SELECT sequence, frame, box, round(score, 6) AS score, round(score - other, 6) + 0.0 AS lead, CASE WHEN score IS NULL THEN 'not_identity_scoped' WHEN score < 0.35 THEN 'insufficient_target_overlap' WHEN score - other < 0.05 THEN 'insufficient_identity_margin' END AS reason FROM s"""))
def identity_scoped_match(spark, d):
    s = matching.scoped_scores(b.obs(spark, d), b.pred(spark, d), F.floor(F.col("track_id") / 10))
    return rounded(decisions.scoped(s), "score", "lead")


@query("session_margin", sql(b.OBS, b.EVIDENCE, MEMORY, body="SELECT sequence, round(max(CASE WHEN rank = 2 THEN score END), 6) AS score, round(max(CASE WHEN rank <> 2 THEN score END), 6) AS other, round(max(CASE WHEN rank = 2 THEN score END) - max(CASE WHEN rank <> 2 THEN score END), 6) + 0.0 AS margin FROM rk GROUP BY ALL"))
def session_margin(spark, d):
    m = fusion.semantic_memory(b.evidence(spark, d), 40)
    return rounded(decisions.session_margin(m, F.col("rank") == 2), "score", "other", "margin")


@query("failure_categories", sql(b.OBS, b.PRED, GT_PAIRS, MATCHED, LANGUAGE, "q AS (SELECT *, CASE query WHEN 's0' THEN 'ambiguous' WHEN 's1' THEN NULL ELSE 'resolved' END AS status, CASE query WHEN 's2' THEN 0.4 ELSE recall END AS r FROM lm), k AS (SELECT CASE WHEN coalesce(status, 'missing_prediction') <> 'resolved' THEN 'query_' || coalesce(status, 'missing_prediction') WHEN initial_correct = false THEN 'initial_selection_error' WHEN precision < 0.5 THEN 'low_precision' WHEN r < 0.5 THEN 'low_recall' WHEN query = 's3' THEN 'semantic_target_switch' END AS category FROM q)", body="SELECT category, count(*) AS n FROM k WHERE category IS NOT NULL GROUP BY ALL"))
def failure_categories(spark, d):
    q = F.col("query")
    rows = language(spark, d).withColumns({"status": F.when(q == "s0", "ambiguous").when(q != "s1", "resolved"), "recall": F.when(q == "s2", 0.4).otherwise(F.col("recall")), "switches": F.when(q == "s3", 1).otherwise(0), "chances": F.lit(0), "recovered": F.lit(0)})
    return decisions.failure_counts(rows)


@query("label_coverage", sql(b.OBS, "t AS (SELECT sequence, track_id, count(*) AS boxes, track_id % 3 = 0 AS a, track_id % 5 = 0 AS f FROM obs GROUP BY ALL)", body="""
SELECT sequence, count(*) AS tracks, sum(boxes)::BIGINT AS boxes, round(count(*) FILTER (a) / count(*), 6) AS track_coverage, round(coalesce(sum(boxes) FILTER (a), 0) / sum(boxes), 6) AS box_coverage, round(count(*) FILTER (a OR f) / count(*), 6) AS label_track_coverage, round(coalesce(sum(boxes) FILTER (a OR f), 0) / sum(boxes), 6) AS label_box_coverage FROM t GROUP BY ALL"""))
def label_coverage(spark, d):
    o, n = b.obs(spark, d), F.col("track_id")
    labels = o.select("sequence", "track_id").distinct().where("track_id % 3 = 0 or track_id % 5 = 0").withColumns({"accepted": n % 3 == 0, "fallback": n % 5 == 0})
    return decisions.label_coverage(o, labels)


@query("cost_summary", "SELECT event_type, count(*) AS events, round(sum(value), 6) AS seconds, round(sum(value) / sum(1 + event_id % 3), 6) AS seconds_per_track, round(60 * sum(1 + event_id % 3) / sum(value), 6) AS tracks_per_minute FROM events GROUP BY ALL")
def cost_summary(spark, d):
    return decisions.cost_summary(b.table(spark, d, "events").select("event_type", F.col("value").alias("seconds"), (1 + F.col("event_id") % 3).alias("tracks")), ["event_type"])


@query("delta_to_baseline", "WITH r AS (SELECT user_id % 4 AS grp, event_type AS variant, round(sum(value), 2) AS v FROM events GROUP BY ALL) SELECT grp, variant, v, round(100 * (max(CASE WHEN variant = 'view' THEN v END) OVER (PARTITION BY grp) - v) / max(CASE WHEN variant = 'view' THEN v END) OVER (PARTITION BY grp), 6) + 0.0 AS reduction FROM r")
def delta_to_baseline(spark, d):
    r = b.table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("grp"), F.col("event_type").alias("variant")).agg(F.round(F.sum("value"), 2).alias("v"))
    return rounded(decisions.delta_to_baseline(r, ["grp"], F.col("variant") == "view", "v"), "reduction")


@query("in_all_sequences", sql(b.OBS, body="SELECT frame FROM obs GROUP BY frame HAVING count(DISTINCT sequence) = (SELECT count(DISTINCT sequence) FROM obs)"))
def in_all_sequences(spark, d):
    return decisions.in_all(b.obs(spark, d), "frame", "sequence")


@query("set_match", sql(b.OBS, "s AS (SELECT track_id, list_sort(list_distinct(list(class) FILTER (frame <= 350 AND conf > 0.5))) AS a, list_sort(list_distinct(list(class) FILTER (frame > 350 AND conf > 0.5))) AS b FROM obs GROUP BY ALL)", body="SELECT track_id, coalesce(a = b AND len(a) > 0, false) AS exact, coalesce(list_has_any(a, b), false) AS hit, coalesce(len(list_intersect(a, b)), 0)::INT AS tp, coalesce(len(list_filter(b, lambda x: NOT list_contains(coalesce(a, []), x))), 0)::INT AS fp, coalesce(len(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x))), 0)::INT AS fn FROM s"))
def set_match(spark, d):
    part = lambda test: F.collect_set(F.when(test & (F.col("conf") > 0.5), F.col("class")))
    r = b.obs(spark, d).groupBy("track_id").agg(part(F.col("frame") <= 350).alias("a"), part(F.col("frame") > 350).alias("b"))
    return decisions.set_match(r, "a", "b").select("track_id", "exact", "hit", "tp", "fp", "fn")


@query("label_merge_precedence", sql(b.OBS, VOTES := "v AS (SELECT sequence, track_id, min(class) AS label FROM obs WHERE track_id % 2 = 0 GROUP BY ALL), r AS (SELECT sequence, track_id, max(class) AS label FROM obs WHERE track_id % 3 = 0 GROUP BY ALL)", body="SELECT sequence, track_id, coalesce(v.label, r.label) AS filled, coalesce(r.label, v.label) AS overridden FROM v FULL JOIN r USING (sequence, track_id)"))
def label_merge_precedence(spark, d):
    o, key = b.obs(spark, d), ["sequence", "track_id"]
    first = o.where("track_id % 2 = 0").groupBy(*key).agg(F.min("class").alias("label"))
    second = o.where("track_id % 3 = 0").groupBy(*key).agg(F.max("class").alias("label"))
    filled = decisions.merged(first, second, key, ["label"]).withColumnRenamed("label", "filled")
    return filled.join(decisions.merged(first, second, key, ["label"], override=True).withColumnRenamed("label", "overridden"), key)


@query("routed_global_ids", sql(b.OBS, "r AS (SELECT *, CASE class WHEN 'click' THEN 'fast' WHEN 'view' THEN 'fast' ELSE 'slow' END AS route FROM obs), f AS (SELECT sequence, route, track_id, min(frame) AS first FROM r GROUP BY ALL)", body="SELECT sequence, route, track_id, row_number() OVER (PARTITION BY sequence ORDER BY first, route, track_id)::INT AS global_id FROM f"))
def routed_global_ids(spark, d):
    routes = spark.createDataFrame([("click", "fast"), ("view", "fast")], "class string, route string")
    return decisions.global_ids(decisions.routed(b.obs(spark, d), routes, "slow")).select("sequence", "route", "track_id", "global_id").distinct()


@query("detector_route", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'fallback' WHEN lang = 'de' THEN 'microscopy' WHEN lang = 'fr' AND doc_id % 2 = 0 THEN 'football' ELSE 'general' END AS route FROM documents")
def detector_route(spark, d):
    n, lang = F.col("doc_id"), F.col("lang")
    domain = F.when(lang == "de", "Microscopy").when(lang == "fr", "Football match").otherwise("street")
    objects = F.when(n % 7 == 0, F.array().cast("array<string>")).when(n % 2 == 0, F.array(F.lit("ball"))).otherwise(F.array(F.lit("car")))
    return b.table(spark, d, "documents").select("doc_id", domain.alias("domain"), objects.alias("objects")).select("doc_id", decisions.detector_route().alias("route"))


@query("majority_labels", sql(b.OBS, "c AS (SELECT sequence, track_id, class, count(*) AS n FROM obs GROUP BY ALL)", body="SELECT sequence, track_id, CASE WHEN sum(n) >= 65 THEN arg_min(class, (-n, class)) ELSE 'unknown' END AS label, sum(n)::BIGINT AS rows FROM c GROUP BY ALL"))
def majority_labels(spark, d):
    return decisions.with_majority(b.obs(spark, d), ["sequence", "track_id"], "class", 65)


@query("class_aware_pairs", sql(b.OBS, b.PRED, body="""SELECT sequence, frame, class, g.track_id AS gt_track_id, p.track_id AS pred_track_id, round(i / (g.w * g.h + p.w * p.h - i), 6) AS iou FROM obs g JOIN pred p USING (sequence, frame, class),
LATERAL (SELECT greatest(0, least(g.x + g.w, p.x + p.w) - greatest(g.x, p.x)) * greatest(0, least(g.y + g.h, p.y + p.h) - greatest(g.y, p.y)) AS i) WHERE i / (g.w * g.h + p.w * p.h - i) >= 0.5"""))
def class_aware_pairs(spark, d):
    return rounded(decisions.class_aware_pairs(b.obs(spark, d), b.pred(spark, d), 0.5), "iou")


@query("reacquisition_candidates", sql(b.OBS, """g AS (SELECT sequence, track_id AS lost_id, frame + 1 AS start, next - 1 AS stop, frame AS last FROM (SELECT *, lead(frame) OVER (PARTITION BY sequence, track_id ORDER BY frame) AS next FROM obs) WHERE next - frame > 60),
w AS (SELECT *, greatest(1, least(last + 1, start - 20)) AS lo, greatest(stop, start) + 50 AS hi FROM g)""", body="SELECT w.sequence, lost_id || '-' || start AS event, lost_id, o.track_id, min(o.frame) AS first_frame, max(o.frame) AS last_frame, count(*) AS rows, o.track_id = lost_id AS resumes FROM w JOIN obs o ON o.sequence = w.sequence AND o.frame BETWEEN lo AND hi GROUP BY ALL"))
def reacquisition_candidates(spark, d):
    o = b.obs(spark, d)
    g = tracks.track_gaps(o).where("gap_frames >= 60")
    e = g.select("sequence", F.concat_ws("-", F.col("track_id").cast("string"), F.col("gap_start").cast("string")).alias("event"), "track_id", (F.col("gap_start") - 1).alias("last"), F.col("gap_start").alias("start"), F.col("gap_end").alias("end"), F.col("gap_start").alias("trigger"))
    return segments.candidates_in_window(e, o)
