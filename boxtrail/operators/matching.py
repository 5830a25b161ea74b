"""Joins of boxes within a frame, and one-to-one matching.

Candidates come from an equality join on (sequence, frame) with the overlap as a further condition; only the order-dependent
choice among them runs in Python, on small groups of frames. Equal boxes of a frame are compared once: what is joined are a frame's
different boxes with the rows that have them, so pairs grow with the square of the different boxes and not of the rows.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.functions import geometry as g
from boxtrail.operators.assignment import transport

FRAME = ["sequence", "frame"]
BOX = ["x", "y", "w", "h"]


def prefixed(boxes: DataFrame, p: str) -> DataFrame:
    return boxes.select(*FRAME, *[F.col(c).alias(f"{p}_{c}") for c in boxes.columns if c not in FRAME])


def box_of(p: str) -> g.Box:
    return g.corners(*[f"{p}_{c}" for c in BOX])


REST = "_rows"


def distinct_boxes(boxes: DataFrame, p: str, *aggregates: Column) -> DataFrame:
    """The different boxes of each frame that have an area, columns prefixed with p: the box, x2, y2, area, cx, cy and what the aggregates say of its rows (else _rows, what else they have).

    What one box alone decides is computed here, so that the condition of the join stays small enough to be compiled."""
    rest = [c for c in boxes.columns if c not in (*FRAME, *BOX)]
    found = boxes.groupBy(*FRAME, *BOX).agg(*(aggregates or [F.collect_list(F.struct(*rest)).alias(REST)]))
    b = g.corners(*BOX)
    return with_edges(prefixed(found.where((b.x2 > b.x1) & (b.y2 > b.y1)), p), p)


def with_edges(boxes: DataFrame, p: str) -> DataFrame:
    b = box_of(p)
    cx, cy = g.centre(b)
    return boxes.withColumns({f"{p}_x2": b.x2, f"{p}_y2": b.y2, f"{p}_area": b.width * b.height, f"{p}_cx": cx, f"{p}_cy": cy})


def meets() -> Column:
    """Whether two distinct_boxes have an area in common."""
    c = F.col
    return (c("gt_x") < c("pred_x2")) & (c("pred_x") < c("gt_x2")) & (c("gt_y") < c("pred_y2")) & (c("pred_y") < c("gt_y2"))


def common_area() -> Column:
    """That area, where they meet."""
    return (F.least("gt_x2", "pred_x2") - F.greatest("gt_x", "pred_x")) * (F.least("gt_y2", "pred_y2") - F.greatest("gt_y", "pred_y"))


def met_iou() -> Column:
    return common_area() / (F.col("gt_area") + F.col("pred_area") - common_area())


def met_distance() -> Column:
    return F.hypot(F.col("gt_cx") - F.col("pred_cx"), F.col("gt_cy") - F.col("pred_cy"))


def iou_pairs(gt: DataFrame, pred: DataFrame, least: float = 0.0, measures: dict[str, Column] | None = None) -> DataFrame:
    """All pairs of a frame with an IoU of at least `least` (over 0 where that is 0), columns prefixed gt_ and pred_. measures: more columns from the two boxes."""
    pairs = distinct_boxes(gt, "gt").join(distinct_boxes(pred, "pred"), FRAME).where(meets() & (met_iou() >= least) if least > 0 else meets())
    pairs = pairs.withColumns({"iou": met_iou(), **(measures or {})}).where("iou > 0" if least <= 0 else "true")
    rows = pairs.withColumn("_gt", F.explode(f"gt_{REST}")).withColumn("_pred", F.explode(f"pred_{REST}"))
    side = lambda df, p: [F.col(f"{p}_{c}") if c in BOX else F.col(f"_{p}.{c}").alias(f"{p}_{c}") for c in df.columns if c not in FRAME]
    return rows.select(*FRAME, *side(gt, "gt"), *side(pred, "pred"), "iou", *(measures or {}))


def with_boxes(rows: DataFrame, boxes: DataFrame, p: str, how: str = "left") -> DataFrame:
    """rows with what boxes (frame and p's box columns) say of their box."""
    key = [*FRAME, *[f"{p}_{c}" for c in BOX]]
    there = boxes.select(*[F.col(c).alias(f"_{c}") for c in key], *[c for c in boxes.columns if c not in key])
    same = [F.col(c) == F.col(f"_{c}") for c in FRAME] + [F.col(c).eqNullSafe(F.col(f"_{p}_{c}")) for c in BOX]
    return rows.join(there, same, how).drop(*[f"_{c}" for c in key])


def best_boxes(pred: DataFrame, gt: DataFrame, *keep: str) -> DataFrame:
    """For each different pred_ box that a gt box overlaps that of greatest IoU to 12 digits, of equal ones the lowest track: best (track_id, *keep, iou).

    The greatest IoU is found without a sort of the pairs; only pairs that reach it are ordered."""
    p, q = distinct_boxes(pred, "pred", F.count("*").alias("n")), distinct_boxes(gt, "gt", F.min_by(F.struct("track_id", *keep), "track_id").alias("first"))
    box = [f"pred_{c}" for c in BOX]
    top = p.join(q, FRAME).where(meets()).groupBy(*FRAME, *box).agg(F.max(met_iou()).alias("top"))
    near = with_edges(top, "pred").join(q, FRAME).where(meets() & (met_iou() >= F.col("top") - 1e-11)).withColumn("iou", met_iou())
    near = near.where(F.round("iou", 12) == F.round("top", 12))
    return near.groupBy(*FRAME, *box).agg(F.min_by(F.struct("gt_first.*", "iou"), "gt_first.track_id").alias("best"))


def best_match(pairs: DataFrame) -> DataFrame:
    """For each gt box its prediction of greatest IoU; ties go to the lower prediction id."""
    best = F.max_by(F.struct("pred_track_id", "iou"), F.struct(F.round("iou", 12), -F.col("pred_track_id")))
    return pairs.groupBy(*FRAME, "gt_track_id").agg(best.alias("b")).select(*FRAME, "gt_track_id", F.col("b.pred_track_id").alias("pred_track_id"), F.col("b.iou").alias("iou"))


def greedy(rows: list[tuple], last_first: bool = False) -> list[int]:
    """Indexes of pairs (iou, gt, pred) taken one to one by falling IoU; ties by rising positions, or falling with last_first."""
    sign = -1 if last_first else 1
    used_a, used_b, taken = set(), set(), []
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][0], sign * rows[i][1], sign * rows[i][2])):
        if rows[i][1] not in used_a and rows[i][2] not in used_b:
            used_a.add(rows[i][1])
            used_b.add(rows[i][2])
            taken.append(i)
    return taken


def greedy_groups(links: list[tuple], first: dict, second: dict) -> list[tuple]:
    """The choice of greedy for groups of equal boxes. links: (iou, a, b) of groups, first and second: the (place, ...) of each group. Pairs (iou, of first, of second)
    are taken by falling IoU, then by place in first, then in second."""
    queues = [{k: sorted(v, reverse=True) for k, v in side.items()} for side in (first, second)]
    used, taken = (set(), set()), []

    def head(side, group):
        q = queues[side][group]
        while q and q[-1][0] in used[side]:
            q.pop()
        return q[-1] if q else None

    for iou, level in itertools.groupby(sorted(links, key=lambda x: -x[0]), key=lambda x: x[0]):
        to = defaultdict(list)
        for _, a, b in level:
            to[a].append(b)
        heap = [(head(0, a)[0], a) for a in to if head(0, a)]
        heapq.heapify(heap)
        while heap:
            _, a = heapq.heappop(heap)
            one = head(0, a)
            if one is None:
                continue
            free = [h for h in (head(1, b) for b in to[a]) if h]
            if not free:  # nor is there one for the rest of the group
                continue
            other = min(free)
            used[0].add(one[0])
            used[1].add(other[0])
            taken.append((iou, one, other))
            if head(0, a):
                heapq.heappush(heap, (head(0, a)[0], a))
    return taken


GREEDY_BLOCK = 16  # frames of one call: their boxes and the links of their groups are in memory


def _greedy_by_groups(gt: DataFrame, pred: DataFrame, links, by: tuple[list, list], last_first: bool, extra: str = "") -> DataFrame:
    """One-to-one pairs of rows (pos, track_id, ...): links(groups, groups) joins a frame's groups of rows equal in the columns `by`; extra: columns of pred to add."""
    sign = -1 if last_first else 1
    names = [c.split()[0] for c in extra.split(", ") if c]

    def groups(df, p, keys, more):
        found = df.groupBy(*FRAME, *keys).agg(*[F.collect_list(c).alias(c) for c in ("pos", "track_id")], *[F.collect_list(F.struct(F.col(c))).alias(c) for c in more])
        found = found.withColumn("group", F.row_number().over(W.partitionBy(*FRAME).orderBy(*keys)))
        return found, prefixed(found.select(*FRAME, *keys, "group"), p)

    (a, ga), (b, gb) = groups(gt, "gt", by[0], []), groups(pred, "pred", by[1], names)
    block = F.floor(F.col("frame") / GREEDY_BLOCK).alias("block")
    members = a.select("sequence", block, "frame", F.lit(0).alias("side"), "group", "pos", "track_id", *[F.lit(None).cast(b.schema[c].dataType).alias(c) for c in names]).unionByName(b.select("sequence", block, "frame", F.lit(1).alias("side"), "group", "pos", "track_id", *names))
    linked = links(ga, gb).select("sequence", block, "frame", F.col("gt_group"), F.col("pred_group"), "iou")
    schema = f"{MATCH}, {extra}" if extra else MATCH

    def run(links: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out, of = [], {(f, s): x for (f, s), x in rows.groupby(["frame", "side"])}
        for frame, part in links.groupby("frame"):
            sides = []
            for side in (0, 1):
                x = of[frame, side]
                more = [x[c] for c in names] if side else []
                sides.append({g_: [(sign * p, t, i) for i, (p, t) in enumerate(zip(ps.tolist(), ts.tolist(), strict=True))] for g_, ps, ts in zip(x.group, x.pos, x.track_id, strict=True)})
                lists = {g_: m for g_, *m in zip(x.group, *more, strict=True)} if more else {}
            chosen = greedy_groups(list(zip(part.iou.tolist(), part.gt_group.tolist(), part.pred_group.tolist(), strict=True)), *sides)
            where = {id(m): g_ for g_, ms in sides[1].items() for m in ms} if names else {}
            head = (part.sequence.iloc[0], frame)
            out += [(*head, one[1], other[1], iou, *[lists[where[id(other)]][k][other[2]][c] for k, c in enumerate(names)]) for iou, one, other in chosen]
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    members = members.toDF(*members.columns)  # its columns are not those of linked
    return linked.groupBy("sequence", "block").cogroup(members.groupBy("sequence", "block")).applyInPandas(run, schema)


def iou_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of all boxes (rows of x, y, w, h) of a with all of b, 0 where one has no area or isn't known."""
    x1, y1, w1, h1 = (c[:, None] for c in a.T)
    x2, y2, w2, h2 = b.T
    with np.errstate(invalid="ignore", divide="ignore"):
        wide, high = np.minimum(x1 + w1, x2 + w2) - np.maximum(x1, x2), np.minimum(y1 + h1, y2 + h2) - np.maximum(y1, y2)
        common = wide * high
        return np.where((wide > 0) & (high > 0) & (w1 > 0) & (h1 > 0) & (w2 > 0) & (h2 > 0), common / (w1 * h1 + w2 * h2 - common), 0.0)


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of least total cost, by shortest augmenting paths."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            seen[j0] = True
            row = match[j0]
            open_ = ~seen[1:]
            now = c[row - 1] - u[row] - v[1:]
            better = open_ & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            j1 = 1 + int(np.where(open_, least[1:], np.inf).argmin())
            delta = least[j1]
            u[match[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flipped else (a, b) for a, b in pairs)


MATCH = "sequence string, frame long, gt_track_id long, pred_track_id long, iou double"
LABEL = "label string, conf double"  # of a proposal


def _with_positions(gt: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds pos, the place in the frame: that of the input where it is given, else by track."""
    place = lambda df: df if "pos" in df.columns else df.withColumn("pos", F.col("track_id"))
    keep = [*FRAME, "track_id", "pos", *BOX]
    return place(gt).select(*keep), place(pred).select(*keep)


def greedy_match(gt: DataFrame, pred: DataFrame, least: float = 0.5, last_first: bool = False) -> DataFrame:
    """One-to-one pairs by falling IoU. last_first: of equal IoUs the pair of the last positions comes first."""
    gt, pred = _with_positions(gt, pred)

    def links(a: DataFrame, b: DataFrame) -> DataFrame:
        sized = lambda df, p: with_edges(df.where((F.col(f"{p}_w") > 0) & (F.col(f"{p}_h") > 0)), p)
        pairs = sized(a, "gt").join(sized(b, "pred"), FRAME)
        return pairs.where(meets() & (met_iou() >= least) if least > 0 else meets()).withColumn("iou", met_iou())

    return _greedy_by_groups(gt, pred, links, (BOX, BOX), last_first)


def _proposals_in_tasks(tracks: DataFrame, proposals: DataFrame, least: float) -> DataFrame:
    """The pairs of proposal_matches with an overlap of at least `least` (over 0): the rows of both sides meet in tasks of a few frames, no pairs and no groups are shuffled. Rows of one box and
    class, or of one box and list of classes, are one group there."""

    def groups(f: pd.DataFrame, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, list]]:
        """The boxes and kinds of the groups, and the rows of each: (-place, track, row)."""
        unlike, of = np.unique(np.column_stack([f[BOX].to_numpy(float), kind]), axis=0, return_inverse=True)
        members: dict[int, list] = defaultdict(list)
        for i, (group, pos, track) in enumerate(zip(of.ravel().tolist(), f.pos.tolist(), f.track_id.tolist(), strict=True)):
            members[group].append((-pos, track, i))
        return unlike[:, :4], unlike[:, 4].astype(int), members

    def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (x1, y1, w1, h1), (x2, y2, w2, h2) = (c[:, None] for c in a.T), b.T
        r1, l1, r2, l2 = x1 + w1, y1 + h1, x2 + w2, y2 + h2
        with np.errstate(invalid="ignore", divide="ignore"):
            wide, high = np.minimum(r1, r2) - np.maximum(x1, x2), np.minimum(l1, l2) - np.maximum(y1, y2)
            common = wide * high
            iou = common / ((r1 - x1) * (l1 - y1) + (r2 - x2) * (l2 - y2) - common)
            share = common / np.minimum(np.maximum(w1 * h1, 1e-9), np.maximum(w2 * h2, 1e-9))
            return np.where((wide > 0) & (high > 0) & (w1 > 0) & (h1 > 0) & (w2 > 0) & (h2 > 0), np.minimum(1.0, np.maximum(iou, share)), 0.0)

    def run(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out, classes, lists = [], {}, {}
        if len(g) and len(p):
            g["kind"] = [classes.setdefault(c, len(classes)) for c in g["class"]]
            p["kind"] = [lists.setdefault(None if c is None or not len(c) else tuple(c), len(lists)) for c in p.compatible]
            fits = np.array([[k is None or (c is not None and c in k) for k in lists] for c in classes])
            others = dict(list(p.groupby("frame")))
            for frame, a in g.groupby("frame"):
                b = others.get(frame)
                if b is None:
                    continue
                (x, kinds, first), (y, wanted, second) = groups(a, a.kind.to_numpy()), groups(b, b.kind.to_numpy())
                table = np.where(fits[kinds][:, wanted], overlaps(x, y), 0.0)
                i, j = np.nonzero(table >= least)
                chosen = greedy_groups(list(zip(table[i, j].tolist(), i.tolist(), j.tolist(), strict=True)), first, second)
                labels, confs = b.label.tolist(), b.conf.tolist()
                out += [(g.sequence.iloc[0], frame, one[1], other[1], iou, labels[other[2]], confs[other[2]]) for iou, one, other in chosen]
        return pd.DataFrame(out, columns=[c.split()[0] for c in f"{MATCH}, {LABEL}".split(", ")])

    block = F.floor(F.col("frame") / GREEDY_BLOCK).alias("block")
    sides = [df.dropna("any", subset=[*FRAME, "pos"]).select("*", block).groupBy("sequence", "block") for df in (tracks, proposals)]
    return sides[0].cogroup(sides[1]).applyInPandas(run, f"{MATCH}, {LABEL}")


def proposal_matches(tracks: DataFrame, proposals: DataFrame, least: float = 0.35) -> DataFrame:
    """One-to-one pairs of tracks (gt_) and labelled proposals (pred_) of a frame by falling overlap, the greater of IoU and the share of the smaller box that is covered; of
    equal ones the pair of the last places first. A proposal with a list `compatible` goes to tracks of these classes only. Adds label, conf and weight, max(conf, 0.01) * overlap."""
    place = lambda df: df if "pos" in df.columns else df.withColumn("pos", F.col("track_id"))
    size = lambda p: F.greatest(F.col(f"{p}_w") * F.col(f"{p}_h"), F.lit(1e-9))
    first, second = box_of("gt"), box_of("pred")
    overlap = F.least(F.lit(1.0), F.greatest(g.iou(first, second), g.intersection(first, second) / F.least(size("gt"), size("pred"))))
    allowed = F.col("pred_compatible").isNull() | (F.size("pred_compatible") == 0) | F.array_contains("pred_compatible", F.col("gt_class"))
    tracks, proposals = place(tracks).select(*FRAME, "track_id", "pos", "class", *BOX), place(proposals).select(*FRAME, "track_id", "pos", "label", "conf", "compatible", *BOX)
    if least > 0:
        found = _proposals_in_tasks(tracks, proposals, least)
    else:
        links = lambda a, b: a.join(b, FRAME).where(allowed).withColumn("iou", overlap).where(F.col("iou") >= least)
        found = _greedy_by_groups(tracks, proposals, links, ([*BOX, "class"], [*BOX, "compatible"]), True, LABEL)
    return found.withColumn("weight", F.greatest("conf", F.lit(0.01)) * F.col("iou"))


def hungarian_match(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of least total (1 - IoU) over the whole frame; those under `least` are dropped afterwards.

    The rows of both sides meet in tasks of a few frames, no pairs are shuffled. Equal boxes of a frame are assigned as one with their number, in the order of their places."""

    def copies(f: pd.DataFrame) -> tuple[np.ndarray, list[list[int]]]:
        """The different boxes, and the places of their rows."""
        boxes, of, n = np.unique(f[BOX].to_numpy(), axis=0, return_inverse=True, return_counts=True)
        return boxes, [x.tolist() for x in np.split(np.argsort(of.ravel(), kind="stable"), np.cumsum(n)[:-1])]

    def choose(g: pd.DataFrame, p: pd.DataFrame) -> list[tuple]:
        if g.pos.is_unique and p.pos.is_unique:
            (x, first), (y, second) = copies(g), copies(p)
            table, taken = iou_table(x, y), []
            for a, b, n in transport(table, np.array([len(r) for r in first]), np.array([len(r) for r in second])):
                taken += [(first[a].pop(0), second[b].pop(0), table[a, b]) for _ in range(n)]
        else:  # rows of one place are one
            table = iou_table(g[BOX].to_numpy(), p[BOX].to_numpy())
            (rows, at), (columns, to) = (np.unique(f.pos.to_numpy(), return_inverse=True) for f in (g, p))
            best = np.zeros((len(rows), len(columns)))
            np.maximum.at(best, (at[:, None], to[None, :]), table)
            pairs = {(a, b) for a, b, _ in transport(best, np.ones(len(rows), int), np.ones(len(columns), int))}
            taken = [(i, j, table[i, j]) for i in range(len(g)) for j in range(len(p)) if (at[i], to[j]) in pairs]
        return [(g.track_id.iloc[i], p.track_id.iloc[j], v) for i, j, v in taken if v >= least]

    def run(gt: pd.DataFrame, pred: pd.DataFrame) -> pd.DataFrame:
        gt, pred = (df.sort_values(["frame", "pos"], kind="stable") for df in (gt, pred))
        others = dict(list(pred.groupby("frame")))
        out = [(g.sequence.iloc[0], f, *pair) for f, g in gt.groupby("frame") if f in others for pair in choose(g, others[f])]
        return pd.DataFrame(out, columns=[c.split()[0] for c in MATCH.split(", ")])

    block = F.floor(F.col("frame") / GREEDY_BLOCK).alias("block")
    sides = [df.dropna("any", subset=[*FRAME, "pos"]).select("*", block).groupBy("sequence", "block") for df in _with_positions(gt, pred)]
    return sides[0].cogroup(sides[1]).applyInPandas(run, MATCH)


def error_analysis(gt: DataFrame, det: DataFrame, least: float = 0.5, localized: float = 0.1) -> DataFrame:
    """Each detection as true_positive, duplicate, localization or false_positive, by its best gt box alone (the first of equal ones)."""
    lowest = gt.groupBy(*FRAME).agg(F.min("track_id").alias("lowest"))  # the first of a frame where none overlaps
    d = with_boxes(det, best_boxes(det, gt), "pred").join(lowest, FRAME, "left")
    found = F.round("best.iou", 12) > 0
    d = d.select(*FRAME, F.col("track_id").alias("pred_track_id"), "conf", F.when(found, F.col("best.track_id")).otherwise(F.col("lowest")).alias("gt_track_id"), F.when(found, F.col("best.iou")).otherwise(0.0).alias("iou"))
    best = F.max_by(F.struct("gt_track_id", "iou"), F.struct(F.round("iou", 12), -F.col("gt_track_id")))
    per = d.groupBy(*FRAME, "pred_track_id").agg(F.max("conf").alias("conf"), best.alias("b")).select(*FRAME, "pred_track_id", "conf", "b.gt_track_id", "b.iou")
    hit = F.col("iou") >= least
    order = F.row_number().over(W.partitionBy(*FRAME, "gt_track_id", hit).orderBy(F.desc("conf"), "pred_track_id"))
    kind = F.when(hit & (order == 1), "true_positive").when(hit, "duplicate").when(F.col("iou") >= localized, "localization").otherwise("false_positive")
    return per.select(*FRAME, "pred_track_id", "gt_track_id", "iou", kind.alias("kind"))


def missed(gt: DataFrame, errors: DataFrame) -> DataFrame:
    """Ground-truth boxes without a true positive."""
    return gt.select(*FRAME, F.col("track_id").alias("gt_track_id")).join(errors.where("kind = 'true_positive'"), [*FRAME, "gt_track_id"], "left_anti")


def label_transfer(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Class of each predicted track: that of the best gt box of each of its rows, weighted by IoU; ties go to the greater name."""
    rows = with_boxes(pred, best_boxes(pred, gt, "class"), "pred", "inner")
    pairs = rows.groupBy(*FRAME, F.col("track_id").alias("pred_track_id")).agg(F.max_by("best", F.struct(F.round("best.iou", 12), -F.col("best.track_id"))).alias("b"))
    votes = pairs.groupBy("sequence", "pred_track_id", F.col("b.class").alias("class")).agg(F.sum("b.iou").alias("score"), F.count("*").alias("n"))
    return votes.groupBy("sequence", "pred_track_id").agg(F.max_by(F.struct("class", "score"), F.struct(F.round("score", 9), "class")).alias("b"), F.sum("n").alias("rows")).select("sequence", "pred_track_id", "b.class", "b.score", "rows")


def ignore_regions(boxes: DataFrame, regions: DataFrame, least: float = 0.5) -> DataFrame:
    """Boxes of which no region of the sequence covers a share of `least`. regions: sequence, rx, ry, rw, rh; a few for each sequence."""
    b, r = g.corners("b.x", "b.y", "b.w", "b.h"), g.corners("r.rx", "r.ry", "r.rw", "r.rh")
    inside = F.try_divide(g.intersection(b, r), F.col("b.w") * F.col("b.h")) >= least
    return boxes.alias("b").join(regions.alias("r"), (F.col("b.sequence") == F.col("r.sequence")) & inside, "left_anti")


def others_near(obs: DataFrame, near: Column, extra: dict[str, str]) -> DataFrame:
    """For each track of a frame how many boxes of other tracks are near one of its own: a frame's different boxes are compared, with the numbers of their rows, and the track's own are taken
    off. near: a condition on gt_ and pred_ boxes with the columns of with_edges and extra."""
    rows = obs.select(*FRAME, "track_id", *BOX)
    more = lambda df, p: with_edges(df, p).withColumns({f"{p}_{k}": F.expr(v.replace("$", f"{p}_")) for k, v in extra.items()})
    boxes = rows.groupBy(*FRAME, *BOX).agg(F.count("track_id").alias("n"))
    box = [f"gt_{c}" for c in BOX]
    near_boxes = more(prefixed(boxes, "gt"), "gt").join(more(prefixed(boxes, "pred"), "pred"), FRAME).where(near).groupBy(*FRAME, *box).agg(F.sum("pred_n").alias("near"))
    own = more(prefixed(rows, "gt"), "gt").join(more(prefixed(rows, "pred"), "pred").withColumnRenamed("pred_track_id", "gt_track_id"), [*FRAME, "gt_track_id"]).where(near)
    own = own.groupBy(*FRAME, F.col("gt_track_id").alias("track_id")).agg(F.count("*").alias("own"))
    found = with_boxes(rows, near_boxes, "gt").where("sequence is not null and frame is not null").groupBy(*FRAME, "track_id").agg(F.sum(F.coalesce("near", F.lit(0))).alias("near"))
    others = F.when(F.col("track_id").isNull(), 0).otherwise(F.col("near") - F.coalesce("own", F.lit(0)))
    return found.join(own, [*FRAME, "track_id"], "left").select(*FRAME, "track_id", others.cast("long").alias("others"))


def neighbours(obs: DataFrame, diagonal: float, near: float = 0.15, overlap: float = 0.1) -> DataFrame:
    """For each box how many others of its frame have a near centre or overlap it."""
    touching = meets() & (met_iou() >= overlap) if overlap > 0 else F.lit(True)
    found = others_near(obs, (met_distance() / diagonal <= near) | (F.col("gt_sound") & F.col("pred_sound") & touching), {"sound": "$w > 0 and $h > 0"})
    return found.where("others > 0").withColumnRenamed("others", "neighbours")


def nearby_count(obs: DataFrame, factor: float = 1.5) -> DataFrame:
    """For each box the others of its frame whose centre lies within factor * its own longer side."""
    reach = F.col("gt_reach")
    near = (F.abs(F.col("gt_cx") - F.col("pred_cx")) <= reach) & (F.abs(F.col("gt_cy") - F.col("pred_cy")) <= reach) & (met_distance() <= reach)
    return others_near(obs, near, {"reach": f"{factor}D * greatest($w, $h)"}).withColumnRenamed("others", "nearby")


def grounding_candidates(boxes: DataFrame, tracks: DataFrame, least_iou: float = 0.3, least_cover: float = 0.5) -> DataFrame:
    """Scores of all tracks for each grounded box of a frame; pred_rank among those that pass the gate, else the reason.

    boxes are the gt_ side with track_id as the box's number. Score: .70 IoU, .20 coverage, .10 closeness of centres.
    """
    a, b = box_of("gt"), box_of("pred")
    pairs = prefixed(boxes, "gt").join(prefixed(tracks, "pred"), FRAME)
    m = g.association_metrics(a, b, 200.0, 120.0)
    pairs = pairs.withColumns({k: m[k] for k in ("iou", "a_coverage", "centre_similarity", "b_centre_inside")})
    passed = (F.col("iou") >= least_iou) | (F.col("b_centre_inside") & (F.col("a_coverage") >= least_cover))
    reason = F.when(passed, None).when(F.col("iou") <= 0, "no_overlap").otherwise("low_overlap")
    score = 0.7 * F.col("iou") + 0.2 * F.col("a_coverage") + 0.1 * F.col("centre_similarity")
    scored = pairs.select(*FRAME, F.col("gt_track_id").alias("box"), F.col("pred_track_id").alias("track"), F.round(score, 9).alias("score"), reason.alias("reason"))
    rank = F.row_number().over(W.partitionBy(*FRAME, "box", F.col("reason").isNull()).orderBy(F.desc("score"), "track"))
    return scored.withColumn("rank", F.when(F.col("reason").isNull(), rank))


def grounding_summary(boxes: DataFrame, tracks: DataFrame, least_iou: float = 0.3, least_cover: float = 0.5) -> DataFrame:
    """What grounding_candidates says of each box, without its pairs: candidates, passed, track and score of the best that pass, and the score of the second (second)."""
    a = distinct_boxes(boxes.select(*FRAME, "track_id", *BOX), "gt", F.count("*").alias("n"))
    b = distinct_boxes(tracks.select(*FRAME, "track_id", *BOX), "pred", F.count("*").alias("n"), F.min("track_id").alias("track"))
    box, cover = [f"gt_{c}" for c in BOX], common_area() / F.col("gt_area")
    inside = F.col("pred_cx").between(F.col("gt_x"), F.col("gt_x2")) & F.col("pred_cy").between(F.col("gt_y"), F.col("gt_y2"))
    gate = meets() & ((met_iou() >= least_iou) | (inside & (cover >= least_cover)))
    score = 0.7 * met_iou() + 0.2 * cover + 0.1 * (1 - F.least(F.lit(1.0), met_distance() / F.lit((200.0**2 + 120.0**2) ** 0.5)))
    top = a.join(b, FRAME).where(gate).groupBy(*FRAME, *box).agg(F.sum("pred_n").alias("passed"), F.max(score).alias("top"))
    pairs = with_edges(top, "gt").join(b, FRAME).where(gate).select(*FRAME, *box, "passed", "top", "pred_n", "pred_track", score.alias("score"))
    first = (F.col("score") >= F.col("top") - 1e-8) & (F.round("score", 9) == F.round("top", 9))
    best = pairs.groupBy(*FRAME, *box).agg(F.max("passed").alias("passed"), F.max("top").alias("top"), F.min(F.when(first, F.col("pred_track"))).alias("track"), F.sum(F.when(first, F.col("pred_n"))).alias("equal"), F.max(F.when(~first, F.col("score"))).alias("next"))
    best = best.select(*FRAME, *box, "passed", "track", F.round("top", 9).alias("score"), F.round(F.when(F.col("equal") > 1, F.col("top")).otherwise(F.col("next")), 9).alias("second"))
    rows = boxes.select(*FRAME, F.col("track_id").alias("box"), *BOX).join(tracks.groupBy(*FRAME).agg(F.count("*").alias("candidates")), FRAME)
    return with_boxes(rows, best, "gt").drop(*BOX).withColumn("passed", F.coalesce("passed", F.lit(0)))


def scoped_scores(boxes: DataFrame, tracks: DataFrame, owner: Column) -> DataFrame:
    """For each box the best grounding score of the tracks that it owns (score) and of all others (other); owner: a column of tracks.

    The best of all is found among a frame's different boxes. Only where no other owner has that place do the box's own rows meet the frame's places again."""
    sound = lambda df, p: with_edges(df, p).withColumn(f"{p}_sound", (F.col(f"{p}_w") > 0) & (F.col(f"{p}_h") > 0))
    side = lambda df, p: sound(prefixed(df, p), p)
    touching = F.when(F.col("gt_sound") & F.col("pred_sound") & meets(), 0.7 * met_iou() + 0.2 * (common_area() / F.col("gt_area"))).otherwise(0.0)
    score = touching + 0.1 * (1 - F.least(F.lit(1.0), met_distance() / F.lit((200.0**2 + 120.0**2) ** 0.5)))
    rows = boxes.select(*FRAME, F.col("track_id").alias("box"), *BOX)
    owned, place = tracks.select(*FRAME, *BOX, owner.alias("owner")).where("owner is not null"), W.partitionBy(*FRAME, *BOX)
    places = side(owned.groupBy(*FRAME, *BOX).agg(F.min("owner").alias("low"), F.max("owner").alias("high")), "pred")
    top = side(rows.select(*FRAME, *BOX).distinct(), "gt").join(places, FRAME).groupBy(*FRAME, *[f"gt_{c}" for c in BOX]).agg(F.max(score).alias("top"))
    mine = owned.withColumn("alone", F.min("owner").over(place) == F.max("owner").over(place)).withColumnRenamed("owner", "box")
    mine = side(rows, "gt").withColumnRenamed("gt_box", "box").join(side(mine, "pred").withColumnRenamed("pred_box", "box"), [*FRAME, "box"]).withColumn("s", score)
    mine = mine.groupBy(*FRAME, "box").agg(F.max("s").alias("score"), F.max(F.when(F.col("pred_alone"), F.col("s"))).alias("alone"))
    found = with_boxes(rows, top, "gt", "inner").join(mine, [*FRAME, "box"], "left")
    first = F.coalesce(F.col("alone") >= F.col("top"), F.lit(False))
    again = side(found.where(first).select(*FRAME, "box", *BOX), "gt").join(places, FRAME).where((F.col("pred_low") != F.col("gt_box")) | (F.col("pred_high") != F.col("gt_box")))
    again = again.groupBy(*FRAME, F.col("gt_box").alias("box")).agg(F.max(score).alias("second"))
    found = found.join(again, [*FRAME, "box"], "left")
    return found.select(*FRAME, "box", F.round("score", 9).alias("score"), F.round(F.when(first, F.col("second")).otherwise(F.col("top")), 9).alias("other"))


def resolve(candidates: DataFrame, least: float = 0.4, margin: float = 0.05) -> DataFrame:
    """Status of each box: resolved, ambiguous or not_found. A track that several boxes win stays with the highest score, of equal ones with the lowest box; the
    others become ambiguous."""
    top = candidates.where("rank <= 2").groupBy(*FRAME, "box").agg(F.max(F.when(F.col("rank") == 1, F.struct("score", "track"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    top = candidates.select(*FRAME, "box").distinct().join(top, [*FRAME, "box"], "left").select(*FRAME, "box", F.col("a.track").alias("track"), F.col("a.score").alias("score"), "second")
    return settled(top, least, margin)


def settled(top: DataFrame, least: float = 0.4, margin: float = 0.05) -> DataFrame:
    """resolve from each box's best track, its score and the second's, as in grounding_summary."""
    status = F.when(F.col("score").isNull() | (F.col("score") < least), "not_found").when(F.col("score") - F.col("second") < margin, "ambiguous").otherwise("resolved")
    top = top.withColumn("status", status)
    owner = F.row_number().over(W.partitionBy(*FRAME, "track", F.col("status") == "resolved").orderBy(F.desc("score"), "box"))
    return top.withColumn("status", F.when((F.col("status") == "resolved") & (owner > 1), "ambiguous").otherwise(F.col("status"))).select(*FRAME, "box", "track", "score", (F.col("score") - F.col("second")).alias("margin"), "status")


def overall_status(resolved: DataFrame) -> DataFrame:
    is_ = lambda s: F.col("status") == s
    return resolved.groupBy(*FRAME).agg(F.when(F.bool_and(is_("resolved")), "resolved").when(F.bool_or(is_("resolved")), "partial").when(F.bool_or(is_("ambiguous")), "ambiguous").otherwise("not_found").alias("status"))
