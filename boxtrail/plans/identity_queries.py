"""Queries of identities: transitions, segments, reacquisition."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.operators import identity, tracks
from boxtrail.plans import bridge as b
from boxtrail.plans.catalog import query
from boxtrail.plans.track_queries import rounded, sql

#: Events of targets from boxes: kinds by event_id, the new track by another modulus.
KINDS = ("lost", "reacquiring", "provisional", "confirmed", "resumed", "lost", "ended", "provisional", "rejected", "reacquiring", "confirmed")
STEP_EVENTS = f"""firsts AS (SELECT sequence, track_id AS target, min(frame) AS f0 FROM obs GROUP BY ALL),
ev AS MATERIALIZED (SELECT sequence, track_id AS target, row_number() OVER (PARTITION BY sequence, track_id ORDER BY frame) AS event, {list(KINDS)}[(CASE WHEN event_id % 13 = 6 THEN 6 WHEN event_id % 11 = 6 THEN 2 ELSE event_id % 11 END)::INT + 1] AS kind, frame, event_id % 40 AS raw, frame - 1 AS before, conf FROM obs),
edges AS (SELECT unnest({[f"{a}>{z}" for a, z in identity.EDGES]}) AS edge),
walk AS (
  SELECT sequence, target, 0::BIGINT AS event, NULL::VARCHAR AS kind, NULL::VARCHAR AS old, NULL::VARCHAR AS new, 'ACTIVE' AS state, target AS raw, true AS legal,
    [{{'raw': target, 's': f0, 'e': NULL::BIGINT, 'status': 'confirmed', 'confidence': 1.0::DOUBLE}}] AS segs FROM firsts
  UNION ALL
  SELECT sequence, target, event, kind, state, new, CASE WHEN legal THEN new ELSE state END, CASE WHEN legal AND kind = 'provisional' THEN new_raw WHEN legal AND kind = 'confirmed' THEN segs[open].raw ELSE raw END, legal,
    CASE WHEN legal AND kind = 'provisional' THEN list_append(list_transform(segs, lambda s, i: CASE WHEN i = open THEN struct_pack(raw := s.raw, s := s.s, e := before, status := 'closed', confidence := s.confidence) ELSE s END), struct_pack(raw := new_raw, s := frame, e := NULL::BIGINT, status := 'probation', confidence := conf))
      WHEN legal AND kind = 'confirmed' THEN list_transform(segs, lambda s, i: CASE WHEN i = open THEN struct_pack(raw := s.raw, s := s.s, e := s.e, status := 'confirmed', confidence := s.confidence) ELSE s END) ELSE segs END
  FROM (SELECT *, kind = 'reacquiring' OR EXISTS (SELECT 1 FROM edges WHERE edge = state || '>' || new) AND (kind <> 'confirmed' OR coalesce(segs[open].status = 'probation', false)) AS legal FROM (
    SELECT w.sequence, w.target, e.event, e.kind, e.frame, e.raw AS new_raw, e.before, e.conf, w.state, w.raw, w.segs,
      CASE e.kind WHEN 'lost' THEN CASE WHEN w.state = 'ACTIVE' THEN 'UNCERTAIN' ELSE 'LOST' END WHEN 'reacquiring' THEN CASE WHEN w.state IN ('ACTIVE', 'UNCERTAIN', 'LOST') THEN 'REACQUIRING' ELSE w.state END WHEN 'resumed' THEN 'ACTIVE' WHEN 'provisional' THEN 'PROBATION' WHEN 'confirmed' THEN 'ACTIVE' WHEN 'rejected' THEN 'REJECTED' ELSE 'TERMINATED' END AS new,
      list_max(list_transform(w.segs, lambda s, i: CASE WHEN s.status IN ('confirmed', 'probation') AND s.e IS NULL THEN i ELSE 0 END)) AS open
    FROM walk w JOIN ev e ON e.sequence = w.sequence AND e.target = w.target AND e.event = w.event + 1)))"""


def step_events(spark, d):
    o, n = b.obs(spark, d), F.col("event_id")
    i = F.when(n % 13 == 6, 6).when(n % 11 == 6, 2).otherwise(n % 11).cast("int")
    kind = F.element_at(F.lit(list(KINDS)), i + 1)
    events = o.select("sequence", F.col("track_id").alias("target"), F.row_number().over(W.partitionBy("sequence", "track_id").orderBy("frame")).cast("long").alias("event"), kind.alias("kind"), "frame", (n % 40).alias("raw"), (F.col("frame") - 1).alias("before"), F.col("conf").alias("confidence"))
    targets = o.groupBy("sequence", F.col("track_id").alias("target")).agg(F.min("frame").alias("frame")).withColumn("raw", F.col("target"))
    return events, targets


@query("identity_transitions", sql(b.OBS, STEP_EVENTS, body="SELECT sequence, target, event, kind, old, new, legal, raw FROM walk WHERE event > 0"))
def identity_transitions(spark, d):
    return identity.transitions(*step_events(spark, d))


@query("identity_segments", sql(b.OBS, STEP_EVENTS, body="SELECT sequence, target, (i - 1)::BIGINT AS segment, s.raw, s.s AS start_frame, s.e AS end_frame, s.status, round(s.confidence, 9) AS confidence FROM (SELECT sequence, target, unnest(segs) AS s, generate_subscripts(segs, 1) AS i FROM (SELECT sequence, target, arg_max(segs, event) AS segs FROM walk GROUP BY ALL))"))
def identity_segments(spark, d):
    return rounded(identity.segments_of(*step_events(spark, d)), "confidence", digits=9)


P = identity.Policy(before=10, after=8)  # short windows, so that a target is gone when the window ends
REACQUIRE = f"""gaps AS (SELECT sequence, track_id AS target, frame AS last, frame + 1 AS start, next - 1 AS stop FROM (SELECT *, lead(frame) OVER (PARTITION BY sequence, track_id ORDER BY frame) AS next FROM obs) WHERE next - frame > 30),
ev AS MATERIALIZED (SELECT sequence, target, row_number() OVER (PARTITION BY sequence, target ORDER BY start) AS n, target || '-' || start AS event, start, least(stop, start + 2) AS stop FROM gaps),
begun AS (SELECT sequence, target, min(last) AS frame FROM gaps GROUP BY ALL),
o AS MATERIALIZED (SELECT sequence, track_id, frame, x + w / 2 AS cx, y + h / 2 AS cy FROM obs),
scales AS MATERIALIZED (SELECT sequence, greatest(1, sqrt(pow(max(x + w), 2) + pow(max(y + h), 2))) AS scale FROM obs GROUP BY ALL),
walk AS (
  SELECT sequence, target, 0::BIGINT AS n, NULL::VARCHAR AS event, target AS raw_before, target AS raw, frame AS last, [{{'raw': target, 's': frame, 'e': NULL::BIGINT, 'status': 'confirmed'}}] AS segs,
    NULL::VARCHAR AS status, NULL::BIGINT AS selected, NULL::BIGINT AS start_frame, NULL::DOUBLE AS score, NULL::DOUBLE AS margin, 0::BIGINT AS candidates, 0::BIGINT AS passed, NULL::BOOLEAN AS confirmed FROM begun
  UNION ALL
  SELECT sequence, target, n, event, raw, CASE WHEN status = 'provisional' THEN selected ELSE raw END, CASE WHEN confirmed THEN start_frame + {P.probation} ELSE last END,
    CASE WHEN status = 'provisional' THEN list_append(list_transform(segs, lambda s: CASE WHEN s.status IN ('confirmed', 'probation') AND s.e IS NULL THEN struct_pack(raw := s.raw, s := s.s, e := greatest(1, start - 1), status := 'closed') ELSE s END),
      struct_pack(raw := selected, s := start_frame, e := NULL::BIGINT, status := CASE WHEN confirmed THEN 'confirmed' ELSE 'probation' END)) ELSE segs END,
    status, selected, start_frame, score, margin, candidates, passed, confirmed
  FROM (SELECT d.*, CASE WHEN status = 'provisional' THEN (SELECT count(*) FROM o WHERE o.sequence = d.sequence AND o.track_id = d.selected AND o.frame BETWEEN d.start_frame AND d.start_frame + {P.probation}) >= {P.probation_rows} END AS confirmed FROM (
    SELECT *, CASE WHEN resumed IS NOT NULL THEN raw WHEN status = 'provisional' THEN best[1].track END AS selected, CASE WHEN resumed IS NOT NULL THEN resumed WHEN status = 'provisional' THEN best[1].first END AS start_frame,
      CASE WHEN resumed IS NOT NULL THEN 1.0 ELSE -best[1].minus END AS score, CASE WHEN resumed IS NULL AND -best[1].minus >= {P.least_score} THEN best[2].minus - best[1].minus END AS margin
    FROM (SELECT *, CASE WHEN resumed IS NOT NULL THEN 'same_raw_id_resumed' WHEN best IS NULL THEN 'not_found' WHEN -best[1].minus < {P.least_score} THEN 'rejected' WHEN best[2].minus - best[1].minus < {P.margin} THEN 'ambiguous' ELSE 'provisional' END AS status
    FROM (SELECT sequence, target, n, event, raw, last, segs, start, min(after_first) FILTER (track_id = raw AND after_rows >= {P.least_rows}) AS resumed, count(*) FILTER (track_id <> raw) AS candidates, count(*) FILTER (track_id <> raw AND ok) AS passed,
        list({{'minus': -round(score, 12), 'first': first, 'track': track_id}} ORDER BY -round(score, 12), first, track_id) FILTER (track_id <> raw AND ok) AS best
    FROM (SELECT *, rows >= {P.least_rows} AND beside = 0 AND coalesce(gap <= {P.farthest}, true) AND NOT list_contains(list_transform(segs, lambda s: s.raw = track_id AND s.status IN ('confirmed', 'probation') AND s.s <= until AND first <= coalesce(s.e, 1000000000000)), true) AS ok,
        CASE WHEN gap IS NULL THEN ({P.temporal} * temporal + {P.history}) / ({P.temporal} + {P.history}) ELSE ({P.motion} * greatest(0, 1 - gap / {P.farthest}) + {P.temporal} * temporal + {P.history}) / ({P.temporal} + {P.history} + {P.motion}) END AS score
    FROM (SELECT c.*, sqrt(pow(cx - wx, 2) + pow(cy - wy, 2)) / scale AS gap, greatest(0, 1 - greatest(0, first - last) / greatest(1, hi - last)) AS temporal
    FROM (SELECT w.sequence, w.target, e.n, e.event, w.raw, w.last, w.segs, e.start, e.stop, e.stop + {P.after} AS hi, o.track_id, min(o.frame) AS first, max(o.frame) AS until, count(*) AS rows, arg_min(o.cx, o.frame) AS cx, arg_min(o.cy, o.frame) AS cy,
          count(*) FILTER (o.frame > e.stop) AS after_rows, min(o.frame) FILTER (o.frame > e.stop) AS after_first,
          (SELECT count(*) FROM o p WHERE p.sequence = w.sequence AND p.track_id = o.track_id AND p.frame BETWEEN greatest(1, w.last - {P.overlap}) AND w.last) AS beside,
          (SELECT arg_max(p.cx, p.frame) FROM o p WHERE p.sequence = w.sequence AND p.track_id = w.raw AND p.frame <= w.last) AS wx, (SELECT arg_max(p.cy, p.frame) FROM o p WHERE p.sequence = w.sequence AND p.track_id = w.raw AND p.frame <= w.last) AS wy
        FROM walk w JOIN ev e ON e.sequence = w.sequence AND e.target = w.target AND e.n = w.n + 1 LEFT JOIN o ON o.sequence = w.sequence AND o.frame BETWEEN greatest(1, least(w.last + 1, e.start - {P.before})) AND e.stop + {P.after} GROUP BY ALL) c JOIN scales USING (sequence)))
    GROUP BY ALL)) ) d))"""


@query("reacquisition_chain", sql(b.OBS, REACQUIRE, body="SELECT sequence, target, n, event, raw_before AS raw, status, selected, start_frame, round(score, 6) AS score, round(margin, 6) AS margin, candidates, passed, confirmed FROM walk WHERE n > 0"))
def reacquisition_chain(spark, d):
    o = b.obs(spark, d)
    g = tracks.track_gaps(o).where("gap_frames >= 30").withColumnRenamed("track_id", "target")
    order = F.row_number().over(W.partitionBy("sequence", "target").orderBy("gap_start")).cast("long")
    name = F.concat_ws("-", F.col("target").cast("string"), F.col("gap_start").cast("string"))
    events = g.select("sequence", "target", order.alias("n"), name.alias("event"), F.col("gap_start").alias("start"), F.least("gap_end", F.col("gap_start") + 2).alias("stop"), F.col("gap_start").alias("trigger"))
    targets = g.groupBy("sequence", "target").agg((F.min("gap_start") - 1).alias("frame")).withColumn("raw", F.col("target"))
    return rounded(identity.reacquire(events, targets, o, P), "score", "margin")
