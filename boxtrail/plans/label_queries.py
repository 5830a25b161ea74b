"""Queries over labels, evaluation, embeddings, states, files and trackers."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtrail.functions.scalars import cosine01, l2_normalized, parse_boxes, phrase
from boxtrail.operators import appearance, filters, fusion, matching, metrics, segments, switches, tracker, validate, vocabulary
from boxtrail.plans import bridge as b
from boxtrail.plans.catalog import query
from boxtrail.plans.track_queries import GT_PAIRS, MATCHED, SWITCHES, owned_matches, rounded, sql

WEIGHTED = """w AS (SELECT *, CASE WHEN source = 'locateanything' THEN 0.9 ELSE 1.0 END::DOUBLE AS sw, CASE WHEN source = 'locateanything' THEN 0.9 ELSE 1.0 END * pow(0.5, (max(frame) OVER (PARTITION BY sequence, track_id) - frame) / 900.0) AS weight FROM evidence),
votes AS (SELECT sequence, track_id, label, sum(conf * weight) AS score, sum(weight) AS weight, sum(conf * sw) AS steady, count(*) AS n FROM w GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sequence, track_id ORDER BY round(score, 12) DESC, label) AS rank FROM votes),
best AS (SELECT sequence, track_id, max(CASE WHEN rank = 1 THEN label END) AS label, max(CASE WHEN rank = 1 THEN score END) AS score, max(CASE WHEN rank = 1 THEN weight END) AS weight, max(CASE WHEN rank = 1 THEN steady END) AS steady, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS second, sum(score) AS total, sum(steady) AS all_steady, sum(n) AS n FROM ranked GROUP BY ALL),
fw AS (SELECT sequence, track_id, frame, label, sum(conf * sw) AS v FROM w GROUP BY ALL), win AS (SELECT sequence, track_id, frame, arg_min(label, (-round(v, 12), label)) AS label FROM fw GROUP BY ALL),
lagged AS (SELECT *, lag(label) OVER (PARTITION BY sequence, track_id ORDER BY frame) AS before FROM win), tr AS (SELECT sequence, track_id, count(*) AS frames, count(*) FILTER (before <> label) AS transitions FROM lagged GROUP BY ALL),
f AS (SELECT b.*, frames, transitions, score / weight * (score / total) AS confidence, (score - second) / total AS margin, steady / greatest(all_steady, 1e-9) AS held FROM best b JOIN tr USING (sequence, track_id))"""
FUSE = dict(least=0.05, margin=0.02, stability=0.2)


@query("fuse_labels", sql(b.OBS, b.EVIDENCE, WEIGHTED, body="""SELECT sequence, track_id, label AS best_label, CASE WHEN label <> 'unknown' AND confidence >= 0.05 AND margin >= 0.02 AND (frames < 2 OR held >= 0.2) THEN label ELSE 'unknown' END AS label, round(confidence, 6) AS confidence, round(score / weight, 6) AS absolute,
  round(score / total, 6) AS consensus, round(margin, 6) AS margin, round(held, 6) AS temporal_stability, frames, transitions, n::BIGINT AS evidence, label <> 'unknown' AND confidence >= 0.05 AND margin >= 0.02 AND (frames < 2 OR held >= 0.2) AS accepted FROM f"""))
def fuse_labels(spark, d):
    return fusion.fuse_labels(b.evidence(spark, d), **FUSE)


@query("label_transitions", sql(b.OBS, b.EVIDENCE, WEIGHTED, body="SELECT * FROM tr"))
def label_transitions(spark, d):
    return fusion.label_transitions(fusion.weighted(b.evidence(spark, d)))


def fine_evidence(spark, d):
    e = b.evidence(spark, d)
    fine = F.when(F.col("event_id") % 4 == 0, F.concat("label", F.lit("_a"))).when(F.col("event_id") % 4 == 1, F.concat("label", F.lit("_b"))).when(F.col("event_id") % 4 == 2, F.lit("unknown")).otherwise(F.concat("label", F.lit("_a")))
    return e.withColumns({"fine_label": fine, "fine_conf": F.col("conf") / 2 + 0.5, "fine_type": F.when(F.col("event_id") % 5 == 0, "unknown").when(F.col("event_id") % 2 == 0, "role").otherwise("subtype")})


@query("fuse_fine_labels", sql(b.OBS, b.EVIDENCE, WEIGHTED, """acc AS (SELECT sequence, track_id, label FROM f WHERE label <> 'unknown' AND confidence >= 0.05 AND margin >= 0.02 AND (frames < 2 OR held >= 0.2)),
fe AS (SELECT w.*, CASE event_id % 4 WHEN 1 THEN w.label || '_b' WHEN 2 THEN 'unknown' ELSE w.label || '_a' END AS fine_label, conf / 2 + 0.5 AS fine_conf, CASE WHEN event_id % 5 = 0 THEN 'unknown' WHEN event_id % 2 = 0 THEN 'role' ELSE 'subtype' END AS fine_type FROM w JOIN acc USING (sequence, track_id, label)),
fk AS (SELECT * FROM fe WHERE fine_label <> 'unknown' AND fine_conf > 0),
fv AS (SELECT sequence, track_id, fine_label, sum(fine_conf * weight) AS score, sum(weight) AS weight, sum(fine_conf * sw) AS steady FROM fk GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY sequence, track_id ORDER BY round(score, 12) DESC, fine_label) AS rank FROM fv),
fb AS (SELECT sequence, track_id, max(CASE WHEN rank = 1 THEN fine_label END) AS fine_label, max(CASE WHEN rank = 1 THEN score END) AS score, max(CASE WHEN rank = 1 THEN weight END) AS weight, max(CASE WHEN rank = 1 THEN steady END) AS steady, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS second, sum(score) AS total, sum(steady) AS all_steady FROM fr GROUP BY ALL),
fn AS (SELECT sequence, track_id, count(DISTINCT frame) AS frames FROM fk GROUP BY ALL),
ft AS (SELECT sequence, track_id, fine_label, fine_type, sum(fine_conf) AS v FROM fk WHERE fine_type <> 'unknown' GROUP BY ALL), fty AS (SELECT sequence, track_id, fine_label, arg_min(fine_type, (-round(v, 12), fine_type)) AS fine_type FROM ft GROUP BY ALL),
fz AS (SELECT fb.*, fn.frames, coalesce(fine_type, 'subtype') AS fine_type, score / weight * (score / total) AS confidence, (score - second) / total AS margin, steady / greatest(all_steady, 1e-9) AS held, 0.85::DOUBLE AS needed FROM fb JOIN fn USING (sequence, track_id) LEFT JOIN fty USING (sequence, track_id, fine_label))""", body="""
SELECT sequence, track_id, fine_label, fine_type, round(confidence, 6) AS confidence, needed, round(margin, 6) AS margin, round(held, 6) AS temporal_stability, frames, confidence >= needed AND margin >= 0.15 AND held >= 0.67 AND frames >= 2 AS accepted FROM fz"""))
def fuse_fine_labels(spark, d):
    e = fine_evidence(spark, d)
    return fusion.fuse_fine_labels(e, fusion.fuse_labels(e, **FUSE))


@query("fuse_attributes", sql(b.OBS, b.EVIDENCE, """a AS (SELECT sequence, track_id, event_id, conf, 'colour' AS key, ['red', 'green', 'blue'][(event_id % 3)::INT + 1] AS value FROM evidence UNION ALL SELECT sequence, track_id, event_id, conf, 'size', CASE WHEN event_id % 2 = 0 THEN 'big' ELSE 'small' END FROM evidence),
v AS (SELECT sequence, track_id, key, value, sum(conf) AS score, min(event_id) AS first FROM a GROUP BY ALL)""", body="SELECT sequence, track_id, key, arg_max(value, (round(score, 9), -first)) AS value, round(max(score), 6) AS score FROM v GROUP BY ALL"))
def fuse_attributes(spark, d):
    colour = F.element_at(F.array(F.lit("red"), F.lit("green"), F.lit("blue")), (F.col("event_id") % 3).cast("int") + 1)
    size = F.when(F.col("event_id") % 2 == 0, "big").otherwise("small")
    return rounded(fusion.fuse_attributes(b.evidence(spark, d).withColumn("attributes", F.create_map(F.lit("colour"), colour, F.lit("size"), size))), "score")


@query("memory_bounded_n", sql(b.OBS, b.EVIDENCE, body="SELECT sequence, track_id, frame, label, conf, source, row_number() OVER (PARTITION BY sequence, track_id ORDER BY frame DESC, source DESC, label DESC, conf DESC)::INT AS age_rank FROM (SELECT DISTINCT sequence, track_id, frame, label, conf, source FROM evidence) QUALIFY age_rank <= 32"))
def memory_bounded_n(spark, d):
    return fusion.bounded_memory(b.evidence(spark, d))


MEMORY = """m AS (SELECT sequence, track_id, count(DISTINCT frame) FILTER (conf >= 0.5) AS support, count(DISTINCT frame) AS matched FROM evidence GROUP BY ALL),
q AS (SELECT sequence, track_id, avg(conf) AS quality FROM (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY sequence, track_id ORDER BY conf DESC, frame) <= 3) GROUP BY ALL),
sc AS (SELECT *, least(1.0, support / 40.0) AS coverage, support / matched AS consistency, round(0.5 * least(1.0, support / 40.0) + 0.3 * quality + 0.2 * (support / matched), 9) AS score FROM m JOIN q USING (sequence, track_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY score DESC, support DESC, track_id) AS rank FROM sc)"""


@query("semantic_memory_rank", sql(b.OBS, b.EVIDENCE, MEMORY, body="SELECT sequence, track_id, support, matched, round(quality, 6) AS quality, round(coverage, 6)::DOUBLE AS coverage, round(consistency, 6) AS consistency, round(score, 6) AS score, rank::INT AS rank FROM rk"))
def semantic_memory_rank(spark, d):
    return rounded(fusion.semantic_memory(b.evidence(spark, d), 40), "quality", "coverage", "consistency", "score")


@query("winner_margin", sql(b.OBS, b.EVIDENCE, MEMORY, body="""SELECT sequence, max(CASE WHEN rank = 1 THEN track_id END) AS track_id, round(max(CASE WHEN rank = 1 THEN score END), 6) AS score, round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 6) + 0.0 AS margin,
  CASE WHEN max(CASE WHEN rank = 1 THEN score END) < 0.45 THEN 'not_found' WHEN max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) < 0.05 THEN 'ambiguous' ELSE 'resolved' END AS status FROM rk GROUP BY ALL"""))
def winner_margin(spark, d):
    return rounded(fusion.winner(fusion.semantic_memory(b.evidence(spark, d), 40)), "score", "margin")


@query("missing_evidence_score", sql(b.OBS, "m AS (SELECT event_id, conf AS a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE w / 60 END AS b, CASE WHEN event_id % 5 = 0 THEN NULL ELSE h / 50 END AS c FROM obs)", body="""SELECT event_id, round((coalesce(a, 0) * 0.5 + coalesce(b, 0) * 0.3 + coalesce(c, 0) * 0.2) / ((a IS NOT NULL)::INT * 0.5 + (b IS NOT NULL)::INT * 0.3 + (c IS NOT NULL)::INT * 0.2) + 1e-9, 6)::DOUBLE AS renormalized,
  round(coalesce(a, 0) * 0.5 + coalesce(b, 0) * 0.3 + coalesce(c, 0) * 0.2 + 1e-9, 6)::DOUBLE AS kept FROM m"""))
def missing_evidence_score(spark, d):
    o, n = b.obs(spark, d), F.col("event_id")
    m = o.select("event_id", F.col("conf").alias("a"), F.when(n % 3 != 0, F.col("w") / 60).alias("b"), F.when(n % 5 != 0, F.col("h") / 50).alias("c"))
    w = {"a": 0.5, "b": 0.3, "c": 0.2}
    return m.select("event_id", F.round(fusion.score_with_missing(w) + 1e-9, 6).alias("renormalized"), F.round(fusion.score_with_missing(w, "zero") + 1e-9, 6).alias("kept"))


REVIEW = "review AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS a, CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS b FROM labels)"


def review(spark, d):
    label = b.table(spark, d, "labels")
    return label.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("a"), F.when(F.col("toxic") == 1, "bad").otherwise("good").alias("b"))


PRF = """e AS (SELECT unnest(['good', 'bad']) AS label), c AS (SELECT label, count(*) FILTER (a = label AND b = label) AS tp, count(*) FILTER (a <> label AND b = label) AS fp, count(*) FILTER (a = label AND b <> label) AS fn FROM review, e GROUP BY ALL),
prf AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c WHERE tp + fp + fn > 0), prf6 AS (SELECT label, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM prf)"""


@query("per_label_prf", sql(REVIEW, PRF, body="SELECT * FROM prf6"))
def per_label_prf(spark, d):
    return metrics.label_prf(review(spark, d), "a", "b")


@query("macro_f1", sql(REVIEW, PRF, body="SELECT round(avg(f1), 6) AS macro_f1, count(*) AS labels FROM prf6 WHERE tp + fn > 0"))
def macro_f1(spark, d):
    return metrics.macro_f1(metrics.label_prf(review(spark, d), "a", "b"))


@query("confusion_pivot", sql(REVIEW, body="SELECT a AS gt, count(*) FILTER (b = 'bad') AS bad, count(*) FILTER (b = 'good') AS good, 0::BIGINT AS __missing__ FROM review GROUP BY ALL"))
def confusion_pivot(spark, d):
    return metrics.confusion(review(spark, d), "a", "b", ["bad", "good"])


@query("cohens_kappa", sql(REVIEW, "s AS (SELECT count(*) AS n, count(*) FILTER (a = b) / count(*) AS o, (count(*) FILTER (a = 'good') * count(*) FILTER (b = 'good') + count(*) FILTER (a = 'bad') * count(*) FILTER (b = 'bad')) / (count(*) * count(*)) AS e FROM review)", body="SELECT n::BIGINT AS n, round(100 * o, 6) AS agreement, round((o - e) / (1 - e), 6) AS kappa FROM s"))
def cohens_kappa(spark, d):
    r = review(spark, d)
    return switches.kappa(r.select("doc_id", F.col("a").alias("label")), r.select("doc_id", F.col("b").alias("label")), ["doc_id"], "label")


@query("review_progress", sql(REVIEW, body="SELECT 'r' || (doc_id % 3) AS reviewer, count(*) AS n, count(*) FILTER (doc_id % 4 <> 0) AS reviewed, round(100.0 * count(*) FILTER (doc_id % 4 <> 0) / count(*), 6)::DOUBLE AS coverage, round(100.0 * count(*) FILTER (doc_id % 4 <> 0 AND a = b) / count(*) FILTER (doc_id % 4 <> 0), 6)::DOUBLE AS agreement FROM review GROUP BY ALL"))
def review_progress(spark, d):
    n = F.col("doc_id")
    r = review(spark, d).select(F.concat(F.lit("r"), (n % 3).cast("string")).alias("reviewer"), F.when(n % 4 != 0, "reviewed").otherwise("draft").alias("status"), F.col("a").alias("label"), F.col("b").alias("suggested"))
    return metrics.review_progress(r, "reviewer")


@query("semantic_rates", sql(REVIEW, "x AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE a END AS gt, b AS label, doc_id % 5 <> 0 AS used FROM review)", body="""SELECT count(*) AS n, round(count(*) FILTER ((used AND label = gt) OR (gt = 'unknown' AND NOT used)) / count(*), 6) AS accuracy, round(count(*) FILTER (used) / count(*), 6) AS coverage, round(count(*) FILTER (used AND label = gt) / count(*) FILTER (used), 6) AS selective_accuracy,
  round(count(*) FILTER (used AND label <> gt) / count(*) FILTER (used), 6) AS hallucination, round(2 * count(*) FILTER (gt = 'unknown' AND NOT used) / (2 * count(*) FILTER (gt = 'unknown' AND NOT used) + count(*) FILTER (gt <> 'unknown' AND NOT used) + count(*) FILTER (gt = 'unknown' AND used)), 6) AS unknown_f1 FROM x"""))
def semantic_rates(spark, d):
    r = review(spark, d).select(F.when(F.col("doc_id") % 7 == 0, "unknown").otherwise(F.col("a")).alias("gt"), F.col("b").alias("label"), (F.col("doc_id") % 5 != 0).alias("accepted"))
    return rounded(metrics.semantic_rates(r), "accuracy", "coverage", "selective_accuracy", "hallucination", "unknown_f1")


LANGUAGE = """spine AS (SELECT DISTINCT sequence AS query, frame FROM obs WHERE frame BETWEEN 50 AND 650), gn AS (SELECT sequence AS query, frame, count(*) AS n FROM obs GROUP BY ALL), pn AS (SELECT sequence AS query, frame, count(*) AS n FROM pred GROUP BY ALL), cn AS (SELECT sequence AS query, frame, count(*) AS n FROM owned GROUP BY ALL),
lf AS (SELECT s.query, s.frame, coalesce(gn.n, 0) AS gt, coalesce(pn.n, 0) AS pred, coalesce(cn.n, 0) AS correct FROM spine s LEFT JOIN gn USING (query, frame) LEFT JOIN pn USING (query, frame) LEFT JOIN cn USING (query, frame)),
lq AS (SELECT query, count(*) AS frames, sum(gt)::BIGINT AS gt, sum(pred)::BIGINT AS pred, sum(correct)::BIGINT AS correct, min(CASE WHEN pred > 0 THEN frame END) AS first_predicted, arg_min(correct > 0, CASE WHEN pred > 0 THEN frame END) AS initial_correct FROM lf GROUP BY ALL),
lm AS (SELECT *, round(correct / pred, 6) AS precision, round(correct / gt, 6) AS recall, round(2 * (correct / pred) * (correct / gt) / (correct / pred + correct / gt), 6) AS f1 FROM lq)"""


def language(spark, d):
    o = b.obs(spark, d)
    spine = o.where(F.col("frame").between(50, 650)).select(F.col("sequence").alias("query"), "frame").distinct()
    n = lambda df: df.groupBy(F.col("sequence").alias("query"), "frame").agg(F.count("*").alias("n"))
    return metrics.language_frames(spine, n(o), n(b.pred(spark, d)), n(owned_matches(spark, d)))


@query("language_frame_metrics", sql(b.OBS, b.PRED, GT_PAIRS, MATCHED, LANGUAGE, body="SELECT * FROM lm"))
def language_frame_metrics(spark, d):
    return language(spark, d)


@query("language_micro_macro", sql(b.OBS, b.PRED, GT_PAIRS, MATCHED, LANGUAGE, body="SELECT CASE WHEN query IN ('s0', 's1') THEN 'easy' ELSE 'hard' END AS difficulty, count(*) AS queries, round(sum(correct) / sum(pred), 6)::DOUBLE AS micro_precision, round(sum(correct) / sum(gt), 6)::DOUBLE AS micro_recall, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall FROM lm GROUP BY GROUPING SETS ((), (difficulty))"))
def language_micro_macro(spark, d):
    q = language(spark, d).withColumn("difficulty", F.when(F.col("query").isin("s0", "s1"), "easy").otherwise("hard"))
    return metrics.micro_macro(q, ["difficulty"])


RIGHT = "cor AS (SELECT gt_track_id, sequence, frame // 10 AS frame FROM owned GROUP BY ALL)"


@query("longest_run", sql(b.OBS, b.PRED, GT_PAIRS, MATCHED, RIGHT, "i AS (SELECT *, frame - row_number() OVER (PARTITION BY sequence, gt_track_id ORDER BY frame) AS island FROM cor), r AS (SELECT sequence, gt_track_id, count(*) AS n FROM i GROUP BY sequence, gt_track_id, island)", body="SELECT sequence, gt_track_id, max(n) AS longest FROM r GROUP BY ALL"))
def longest_run(spark, d):
    m = owned_matches(spark, d).select("sequence", "gt_track_id", F.floor(F.col("frame") / 10).alias("frame")).distinct()
    return metrics.longest_run(m, ["sequence", "gt_track_id"])


@query("target_switches", sql(b.OBS, "f AS (SELECT sequence, track_id, frame, conf >= 0.6 AS correct, conf >= 0.2 AS predicted FROM obs), a AS (SELECT sequence, track_id, min(frame) AS first FROM f WHERE correct GROUP BY ALL), p AS (SELECT f.*, sum(correct::INT) OVER (PARTITION BY sequence, track_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS g FROM f JOIN a USING (sequence, track_id) WHERE predicted AND frame > first), w AS (SELECT sequence, track_id, g FROM p WHERE NOT correct GROUP BY ALL HAVING count(*) >= 2)", body="SELECT sequence, track_id, coalesce(n, 0) AS switches FROM (SELECT DISTINCT sequence, track_id FROM obs) LEFT JOIN (SELECT sequence, track_id, count(*) AS n FROM w GROUP BY ALL) USING (sequence, track_id)"))
def target_switches(spark, d):
    f = b.obs(spark, d).select("sequence", "track_id", "frame", (F.col("conf") >= 0.6).alias("correct"), (F.col("conf") >= 0.2).alias("predicted"))
    return metrics.target_switches(f, ["sequence", "track_id"])


@query("reacquisition_success", sql(b.OBS, "gaps AS (SELECT sequence, track_id, next AS reappear, next + 20 AS last FROM (SELECT *, lead(frame) OVER (PARTITION BY sequence, track_id ORDER BY frame) AS next FROM obs) WHERE next - frame > 30), hit AS (SELECT g.sequence, g.track_id, g.reappear, min(o.frame) AS start FROM gaps g LEFT JOIN obs o ON o.sequence = g.sequence AND o.class = 'error' AND o.frame BETWEEN g.reappear AND g.last GROUP BY ALL)", body="SELECT track_id || '-' || reappear AS event, start IS NOT NULL AS success, greatest(0, start - reappear) AS delay FROM hit"))
def reacquisition_success(spark, d):
    from boxtrail.operators.tracks import track_gaps

    o = b.obs(spark, d)
    g = track_gaps(o).where("gap_frames >= 30").select("sequence", F.concat_ws("-", F.col("track_id").cast("string"), (F.col("gap_end") + 1).cast("string")).alias("event"), (F.col("gap_end") + 1).alias("reappear"), (F.col("gap_end") + 21).alias("last"))
    r = metrics.reacquisition(g, o.where("class = 'error'").select("sequence", "frame").distinct())
    return r.withColumn("delay", F.when(F.col("success"), F.col("delay")).otherwise(F.lit(0).cast("long")))


@query("clear_mot", sql(b.OBS, b.PRED, GT_PAIRS, MATCHED, SWITCHES, """g AS (SELECT sequence, count(*) AS gt FROM obs GROUP BY ALL), p AS (SELECT sequence, count(*) AS pred FROM pred GROUP BY ALL), m AS (SELECT sequence, count(*) AS tp, avg(iou) AS motp FROM owned GROUP BY ALL), s AS (SELECT sequence, count(*) AS idsw FROM sw GROUP BY ALL)""", body="""
SELECT sequence, gt, pred, tp, gt - tp AS fn, pred - tp AS fp, coalesce(idsw, 0) AS idsw, round(1 - (gt - tp + pred - tp + coalesce(idsw, 0)) / gt, 6) AS mota, round(motp, 6) AS motp, round(tp / pred, 6) AS precision, round(tp / gt, 6) AS recall FROM g JOIN p USING (sequence) LEFT JOIN m USING (sequence) LEFT JOIN s USING (sequence)"""))
def clear_mot(spark, d):
    m = owned_matches(spark, d)
    return metrics.clear_mot(m, b.obs(spark, d), b.pred(spark, d), switches.id_switches(m))


TRACKERS = "o5 AS (SELECT *, track_id % 5 AS tracker FROM obs), tr AS (SELECT tracker, round(avg(conf), 6) AS hota, round(avg(x) / 200, 6) AS idf1, round(avg(y) / 120, 6) AS assa, (count(*) FILTER (class = 'error'))::DOUBLE AS idsw, (count(*) % 7)::DOUBLE AS frag, round(avg(w) / 60, 6) AS mota, CASE WHEN tracker = 2 THEN NULL ELSE round(avg(h), 6) END AS fps FROM o5 GROUP BY tracker)"


def tracker_rows(spark, d):
    t = b.obs(spark, d).groupBy((F.col("track_id") % 5).alias("tracker"))
    r = lambda c: F.round(F.avg(c), 6)
    t = t.agg(r("conf").alias("hota"), r(F.col("x") / 200).alias("idf1"), r(F.col("y") / 120).alias("assa"), F.count_if(F.col("class") == "error").cast("double").alias("idsw"), (F.count("*") % 7).cast("double").alias("frag"), r(F.col("w") / 60).alias("mota"), r("h").alias("fps"))
    return t.withColumn("fps", F.when(F.col("tracker") != 2, F.col("fps")))


@query("tracker_rank_7key", sql(b.OBS, TRACKERS.replace("round(avg(x) / 200, 6)", "round(avg(x / 200), 6)").replace("round(avg(y) / 120, 6)", "round(avg(y / 120), 6)").replace("round(avg(w) / 60, 6)", "round(avg(w / 60), 6)"), body="SELECT tracker, row_number() OVER (ORDER BY hota DESC NULLS LAST, idf1 DESC NULLS LAST, assa DESC NULLS LAST, idsw ASC NULLS LAST, frag ASC NULLS LAST, mota DESC NULLS LAST, fps DESC NULLS LAST, tracker) AS place FROM tr"))
def tracker_rank_7key(spark, d):
    return metrics.rank_trackers(tracker_rows(spark, d)).select("tracker", F.col("place").cast("long").alias("place"))


@query("tracker_rank_5key", sql(b.OBS, TRACKERS, body="SELECT tracker, row_number() OVER (ORDER BY coalesce(nullif(hota, 0), -1) DESC, coalesce(nullif(idf1, 0), -1) DESC, coalesce(nullif(mota, 0), -1) DESC, coalesce(nullif(idsw, 0), 1e12), coalesce(nullif(fps, 0), -1) DESC, tracker) AS place FROM tr"))
def tracker_rank_5key(spark, d):
    return metrics.rank_trackers(tracker_rows(spark, d), True).select("tracker", F.col("place").cast("long").alias("place"))


@query("prototype_mean", "SELECT label, pos::INT AS pos, round(avg(v::DOUBLE), 6) + 0.0 AS mean FROM (SELECT label, unnest(embedding) AS v, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings) GROUP BY ALL")
def prototype_mean(spark, d):
    m = appearance.mean_vectors(b.table(spark, d, "embeddings"), "label")
    return rounded(m.select("label", F.posexplode("mean").alias("pos", "mean")), "mean")


PROTO = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT label, pos, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(v) AS x, unnest(generate_series(1, len(v))) AS pos FROM e) GROUP BY ALL), p AS (SELECT label, list(x ORDER BY pos) AS m, max(n) AS n FROM u GROUP BY ALL)"""
COS = "list_inner_product({0}, {1}) / (sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1})))"


@query("cosine_topk", sql(PROTO, f"c AS (SELECT e.vec_id AS query, p.label, round((greatest(-1, least(1, {COS.format('v', 'm')})) + 1) / 2, 9) AS score FROM e, p)", body="SELECT query, label, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, label) <= 3"))
def cosine_topk(spark, d):
    e = b.table(spark, d, "embeddings")
    top = appearance.cosine_topk(e.select(F.col("vec_id").alias("query"), "embedding"), appearance.prototypes(e, "label"), 3)
    return rounded(top.select("query", "label", "score"), "score")


@query("loo_consistency", sql(PROTO, f"o AS (SELECT e.label, e.v, list_transform(list_zip(p.m, e.v), lambda x: x[1] * p.n - x[2]) AS o, n FROM e JOIN p USING (label))", body=f"SELECT label, count(*) AS n, round(avg(CASE WHEN n > 1 THEN (greatest(-1, least(1, {COS.format('v', 'o')})) + 1) / 2 END), 6) AS consistency FROM o GROUP BY ALL"))
def loo_consistency(spark, d):
    return rounded(appearance.leave_one_out(b.table(spark, d, "embeddings"), "label"), "consistency")


@query("nearest_prototype", sql(PROTO, "c AS (SELECT e.vec_id, p.label, round(list_distance(v, m), 9) AS distance FROM e, p), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, label) AS k, lead(distance) OVER (PARTITION BY vec_id ORDER BY distance, label) - distance AS margin FROM c)", body="SELECT vec_id, label, round(distance, 6) AS distance, round(1 / (1 + exp(-6 * coalesce(margin, 0))), 6) AS confidence FROM r WHERE k = 1"))
def nearest_prototype(spark, d):
    e = b.table(spark, d, "embeddings")
    m = appearance.mean_vectors(e, "label")
    return rounded(appearance.nearest_prototype(e.select("vec_id", "embedding"), m, "vec_id"), "distance", "confidence")


@query("l2_norms", sql(PROTO, body="SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round((greatest(-1, least(1, v[1] / sqrt(list_inner_product(v, v)))) + 1) / 2, 6) AS first FROM e"))
def l2_norms(spark, d):
    from boxtrail.functions.scalars import norm

    e = b.table(spark, d, "embeddings")
    unit = l2_normalized(F.col("embedding"))
    axis = F.transform(F.col("embedding"), lambda v, i: F.when(i == 0, 1.0).otherwise(0.0))
    return e.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(cosine01(unit, axis), 6).alias("first"))


@query("class_map_policy", sql("m(source, target) AS (VALUES ('click', 'action'), ('view', 'action'), ('purchase', 'sale'))", body="SELECT event_id, CASE WHEN target IS NOT NULL THEN 'mapped' WHEN event_type = 'error' THEN 'ignored' ELSE 'unknown' END AS status, coalesce(target, CASE WHEN event_type <> 'error' THEN 'unknown' END) AS target, target IS NULL AS ignored FROM events LEFT JOIN m ON source = event_type"))
def class_map_policy(spark, d):
    m = spark.createDataFrame([("Click", "action"), ("view", "action"), ("purchase ", "sale")], "source string, target string")
    return vocabulary.class_policy(b.table(spark, d, "events"), "event_type", m, ["error"]).select("event_id", "status", "target", "ignored")


ALIASES = [("united", "union"), ("united states", "usa"), ("kingdom", "realm"), ("saudi arabia", "ksa"), ("arabia", "peninsula"), ("china", "prc")]


@query("alias_longest_match", sql("a(alias, canonical) AS (VALUES " + ", ".join(f"('{x}', '{y}')" for x, y in ALIASES) + "), n AS (SELECT DISTINCT n_nationkey AS id, ' ' || lower(n_name) || ' ' AS p FROM nation)", body="SELECT id, arg_min(canonical, (-length(alias), alias)) AS canonical, arg_min(alias, (-length(alias), alias)) AS alias FROM n LEFT JOIN a ON contains(p, ' ' || alias || ' ') GROUP BY ALL"))
def alias_longest_match(spark, d):
    a = spark.createDataFrame(ALIASES, "alias string, canonical string")
    n = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name").distinct()
    return vocabulary.longest_alias(n, F.col("n_name"), a).select("id", "canonical", "alias")


@query("parse_boxes", "SELECT event_id, 2::INT AS boxes, 1::INT AS bad, ((event_id * 37) % 160)::DOUBLE AS x1 FROM events")
def parse_boxes_query(spark, d):
    n = F.col("event_id")
    text = F.concat(F.lit("<ref>a</ref><box>"), ((n * 37) % 160).cast("string"), F.lit(", 1, 2, 3</box> and <box>(4,five,6,7)</box>"))
    p = parse_boxes(text)
    return b.table(spark, d, "events").select("event_id", F.size(p).alias("boxes"), (F.size(p) - F.size(F.array_compact(p))).alias("bad"), F.get(F.get(p, F.lit(0)), F.lit(0)).alias("x1"))


@query("split_by_group", """WITH c AS (SELECT 'c' || (c_custkey % 40) AS g, 'c' || (c_custkey % 40) || '_' || c_custkey AS name FROM customer), n AS (SELECT g, count(*) AS n FROM c GROUP BY ALL),
b AS (SELECT g, (sum(n) OVER (ORDER BY md5('42:' || g), g) - n) / sum(n) OVER () AS share FROM n) SELECT name, CASE WHEN share < 0.8 THEN 'train' WHEN share < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split FROM c JOIN b USING (g)""")
def split_by_group(spark, d):
    c = b.table(spark, d, "customer").select(F.concat(F.lit("c"), (F.col("c_custkey") % 40).cast("string"), F.lit("_"), F.col("c_custkey").cast("string")).alias("name"))
    return vocabulary.split_by_group(c, "name", F.regexp_extract("name", "^[^_]+", 0))


@query("split_leakage", sql("s AS (SELECT DISTINCT o_custkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'train' WHEN o_orderkey % 3 = 1 THEN 'val' ELSE 'test' END AS split FROM orders)", body="SELECT a.name, a.split, b.split AS other FROM s a JOIN s b ON a.name = b.name AND a.split < b.split"))
def split_leakage(spark, d):
    n = F.col("o_orderkey") % 3
    return validate.split_overlap(b.table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.when(n == 0, "train").when(n == 1, "val").otherwise("test").alias("split")))


@query("missing_frames", sql(b.OBS, "n AS (SELECT sequence, max(frame) AS n FROM obs GROUP BY ALL), sp AS (SELECT sequence, unnest(generate_series(1, n)) AS frame FROM n)", body="SELECT sequence, frame FROM sp ANTI JOIN obs USING (sequence, frame)"))
def missing_frames(spark, d):
    o = b.obs(spark, d)
    return validate.missing_frames(o, o.groupBy("sequence").agg(F.max("frame").alias("n")))


@query("missing_and_extra", "SELECT c_custkey AS name, 'missing' AS kind FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey % 2 = 0) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'extra' FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def missing_and_extra(spark, d):
    c = b.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("name"))
    return validate.set_difference(c, b.table(spark, d, "orders").select(F.col("o_custkey").alias("name")), "name")


@query("state_transitions_invalid", "WITH l AS (SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS old, role AS state FROM conversations) SELECT conv_id, turn, old, state FROM l WHERE old IS NOT NULL AND old <> state AND (old, state) NOT IN (('system', 'user'), ('user', 'assistant'))")
def state_transitions_invalid(spark, d):
    allowed = spark.createDataFrame([("system", "user"), ("user", "assistant")], "old string, state string")
    return segments.invalid_transitions(b.table(spark, d, "conversations").withColumnRenamed("role", "state"), allowed, "conv_id", "turn")


@query("validate_mot", sql(b.OBS, "bad AS (SELECT sequence, frame - CASE WHEN event_id % 31 = 0 THEN 10000 ELSE 0 END AS frame, track_id, x, y, CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE w END AS w, h, conf * 1.05 AS conf, event_id FROM obs), k AS (SELECT *, row_number() OVER (PARTITION BY sequence, frame, track_id ORDER BY event_id) > 1 AS dup, lag(frame) OVER s IS NOT NULL AND (lag(frame) OVER s, lag(track_id) OVER s) > (frame, track_id) AS back FROM bad WINDOW s AS (PARTITION BY sequence ORDER BY event_id))", body="""
SELECT code, severity, count(*) AS n FROM (SELECT 'bad_frame' AS code, 'error' AS severity FROM k WHERE frame < 1 UNION ALL SELECT 'bad_box', 'error' FROM k WHERE w = 0 UNION ALL SELECT 'bad_confidence', 'warning' FROM k WHERE conf NOT BETWEEN 0 AND 1 UNION ALL SELECT 'beyond_length', 'error' FROM k WHERE frame > 700 UNION ALL SELECT 'duplicate', 'error' FROM k WHERE dup UNION ALL SELECT 'unordered', 'warning' FROM k WHERE back) GROUP BY ALL"""))
def validate_mot(spark, d):
    n = F.col("event_id")
    bad = b.obs(spark, d).withColumns({"frame": F.col("frame") - F.when(n % 31 == 0, 10000).otherwise(0), "w": F.when(n % 17 == 0, 0.0).otherwise(F.col("w")), "conf": F.col("conf") * 1.05})
    return validate.mot_issues(bad, 700, "event_id").groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("validate_cache", sql(b.OBS, "f AS (SELECT sequence, count(*) AS n, count(DISTINCT frame) AS distinct_frames, max(frame) AS hi FROM obs GROUP BY ALL)", body="SELECT sequence, 'missing_frames' AS code, 'error' AS severity FROM f WHERE distinct_frames < 700 UNION ALL SELECT sequence, 'out_of_bounds', 'error' FROM f WHERE hi > 700 UNION ALL SELECT sequence, 'count_mismatch', 'error' FROM f WHERE n <> 2500 UNION ALL SELECT 's9', 'missing_cache', 'error' UNION ALL SELECT 's9', 'incomplete', 'error'"))
def validate_cache(spark, d):
    frames = b.obs(spark, d).groupBy("sequence", "frame").agg(F.count("*").alias("n"))
    meta = spark.createDataFrame([(f"s{i}", 700, 2500, 0.1, 0.2, True) for i in range(4)] + [("s9", 10, 10, 0.1, 0.2, False)], "sequence string, frame_count long, detections long, floor double, threshold double, complete boolean")
    return validate.cache_issues(frames, meta)


@query("top_tracks", sql(b.OBS, body="SELECT sequence, track_id, count(*) AS rows FROM obs GROUP BY ALL ORDER BY rows DESC, sequence, track_id LIMIT 20"))
def top_tracks(spark, d):
    return filters.top_tracks(b.obs(spark, d), 20)


@query("spaced_top_frames", sql(b.OBS, """k AS (SELECT sequence, track_id, frame, conf, row_number() OVER (PARTITION BY sequence, track_id ORDER BY conf DESC, frame) AS i FROM obs),
walk(sequence, track_id, i, taken) AS (
  SELECT sequence, track_id, i, [frame] FROM k WHERE i = 1
  UNION ALL
  SELECT w.sequence, w.track_id, k.i, CASE WHEN len(taken) < 5 AND len(list_filter(taken, lambda t: abs(t - k.frame) < 20)) = 0 THEN list_append(taken, k.frame) ELSE taken END
  FROM walk w JOIN k ON k.sequence = w.sequence AND k.track_id = w.track_id AND k.i = w.i + 1),
e AS (SELECT sequence, track_id, taken FROM walk QUALIFY row_number() OVER (PARTITION BY sequence, track_id ORDER BY i DESC) = 1),
p AS (SELECT k.*, list_position(taken, frame) AS place, len(taken) AS n FROM k JOIN e USING (sequence, track_id)),
f AS (SELECT * REPLACE (coalesce(place, n + row_number() OVER (PARTITION BY sequence, track_id, place IS NULL ORDER BY i)) AS place) FROM p)""", body="SELECT sequence, track_id, frame, conf, place::BIGINT AS place FROM f WHERE place <= 5"))
def spaced_top_frames(spark, d):
    return filters.spaced_top(b.obs(spark, d), "conf", 5, 20)


@query("shot_boundaries", sql(b.OBS, """k AS (SELECT sequence, frame, max(conf) AS score, row_number() OVER (PARTITION BY sequence ORDER BY frame) AS i FROM obs GROUP BY sequence, frame),
walk(sequence, i, frame, score, last, shot) AS (
  SELECT sequence, i, frame, score, frame, 1 FROM k WHERE i = 1
  UNION ALL
  SELECT k.sequence, k.i, k.frame, k.score, CASE WHEN k.score >= 0.65 AND k.frame - last >= 15 THEN k.frame ELSE last END, shot + (k.score >= 0.65 AND k.frame - last >= 15)::INT FROM walk w JOIN k ON k.sequence = w.sequence AND k.i = w.i + 1)""", body="SELECT sequence, frame, score, shot::BIGINT AS shot FROM walk"))
def shot_boundaries(spark, d):
    s = b.obs(spark, d).groupBy("sequence", "frame").agg(F.max("conf").alias("score"))
    return filters.shots(s, "score", 0.65, 15)


@query("batch_packing", sql(b.OBS, """n AS (SELECT sequence, track_id, count(*) AS images FROM obs GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY track_id) AS i FROM n),
walk(sequence, i, track_id, images, batch, items, used) AS (
  SELECT sequence, i, track_id, images, 0, 1, images FROM k WHERE i = 1
  UNION ALL
  SELECT sequence, i, track_id, images, CASE WHEN open THEN batch + 1 ELSE batch END, CASE WHEN open THEN 1 ELSE items + 1 END, CASE WHEN open THEN images ELSE used + images END
  FROM (SELECT k.*, batch, items, used, items >= 4 OR used + k.images > 250 AS open FROM walk w JOIN k ON k.sequence = w.sequence AND k.i = w.i + 1))""", body="SELECT sequence, track_id, images, batch::BIGINT AS batch FROM walk"))
def batch_packing(spark, d):
    n = b.obs(spark, d).groupBy("sequence", "track_id").agg(F.count("*").alias("images"))
    return filters.pack(n, "images", 4, 250)


@query("sort_tracker")
def sort_tracker(spark, d):
    return rounded(tracker.sort_tracks(b.obs(spark, d), least_iou=0.2, max_age=3, min_hits=2), "x", "y", "w", "h")


@query("phrase_counts", "SELECT trim(regexp_replace(regexp_replace(lower(r_name), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS phrase, count(*) AS n FROM region GROUP BY ALL")
def phrase_counts(spark, d):
    return b.table(spark, d, "region").groupBy(phrase(F.col("r_name"), False).alias("phrase")).agg(F.count("*").alias("n"))
