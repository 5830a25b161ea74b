"""Cuts, trackers split at cuts, held colours, label masks and resumed runs, each against a plain version."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxtrail.operators import scenes, tracker
from boxtrail.operators.resume import Runs, fingerprints
from boxtrail.sources import masks
from boxtrail.streaming import live

DETECTION = "sequence string, frame long, x double, y double, w double, h double, conf double, class string"


def test_spaced_against_a_walk(spark):
    rng = random.Random(3)
    rows = [(s, rng.randrange(1, 900)) for s in ("a", "b", None) for _ in range(120)] + [("c", 5), ("c", 5)]
    want = set()
    for s in {s for s, _ in rows}:
        last = None
        for f in sorted(f for t, f in rows if t == s):
            if last is None or f - last >= 12:
                want.add((s, f))
                last = f
    got = [tuple(r) for r in scenes.spaced(spark.createDataFrame(rows, "sequence string, frame long"), 12).collect()]
    assert len(got) == len(want) and set(got) == want


def test_changes_are_bhattacharyya_distances(spark):
    rng = np.random.default_rng(5)
    samples = [("s", f, float(rng.uniform(-20, 200)), float(rng.uniform(0, 300))) for f in (2, 6, 7, 11, 16) for _ in range(60)]
    got = {r.frame: r for r in scenes.changes(scenes.histograms(spark.createDataFrame(samples, "sequence string, frame long, a double, b double"), "a", "b", bins=(4, 4))).collect()}
    assert sorted(got) == [2, 6, 11, 16] and (got[2].score, got[2].previous) == (0.0, None)
    table = {f: np.histogram2d([s[2] for s in samples if s[1] == f], [s[3] for s in samples if s[1] == f], 4, [[0, 180], [0, 256]])[0] for f in got}
    for f, p in ((6, 2), (11, 6), (16, 11)):
        share = np.sqrt(table[f] * table[p]).sum() / np.sqrt(table[f].sum() * table[p].sum())
        assert abs(got[f].score - np.sqrt(1 - share)) < 1e-9


def test_cuts_need_a_score_and_a_gap(spark):
    rows = [("s", f, v) for f, v in ((1, 0.9), (11, 0.9), (16, 0.7), (21, 0.9), (31, 0.6), (36, 0.65))] + [("t", 40, 0.1)]
    got = scenes.scene_cuts(spark.createDataFrame(rows, "sequence string, frame long, score double")).collect()
    assert sorted(map(tuple, got)) == [("s", 16), ("s", 36)]
    assert scenes.scene_cuts(spark.createDataFrame([], "sequence string, frame long, score double")).count() == 0


def plain_tracks(rows, cuts=(), **options):
    """One tracker over all frames of a sequence; at a cut its tracks go and its next id stays."""
    out = []
    for s in {r[0] for r in rows}:
        t = tracker.Sort(**options)
        frames = sorted({r[1] for r in rows if r[0] == s})
        for f in range(frames[0], frames[-1] + 1):
            if (s, f) in cuts:
                t.tracks = []
            here = sorted(r for r in rows if r[0] == s and r[1] == f)
            b = np.array([[r[2], r[3], r[2] + r[4], r[3] + r[5]] for r in here]).reshape(-1, 4)
            out += [(s, f, i, round(box[0], 6), round(box[1], 6)) for i, _, box in t.step(b)]
    return sorted(out, key=str)


@pytest.mark.parametrize("max_age", [0, 2])
def test_tracker_in_groups_gives_the_ids_of_one_pass(spark, max_age):
    rng = random.Random(max_age)
    rows, cuts = [], [("a", 31), ("b", 10), ("a", 400)]
    for s in ("a", "b"):
        for f in range(1, 90):
            if rng.random() < 0.7 and f % 30 > 4:
                rows += [(s, f, 20.0 * k + f % 7, 5.0 * k, 18.0, 18.0, 0.5 + k / 10, "x") for k in range(rng.randrange(1, 4))]
    d = spark.createDataFrame(rows, DETECTION)
    options = {"max_age": max_age, "min_hits": 1}
    plain = lambda df: sorted(((r.sequence, r.frame, r.track_id, round(r.x, 6), round(r.y, 6)) for r in df.collect()), key=str)
    assert plain(tracker.sort_tracks(d, **options)) == plain_tracks(rows, **options)
    cut = spark.createDataFrame(cuts, "sequence string, frame long")
    got = plain(tracker.sort_tracks(d, cuts=cut, **options))
    assert got == plain_tracks(rows, set(cuts), **options)
    ends = {i: max(f for s, f, j, *_ in got if (s, j) == ("a", i)) for s, _, i, *_ in got if s == "a"}
    starts = {i: min(f for s, f, j, *_ in got if (s, j) == ("a", i)) for i in ends}
    assert not any(starts[i] < 31 <= ends[i] for i in ends)
    assert tracker.sort_tracks(d.limit(0), cuts=cut).count() == 0


def plain_colours(rows, every, history, least, consensus, change, retention):
    """Frame by frame as an online store would: [(frame, held, confidence)] of one track."""
    held, seen, out, by = None, [], [], {r[0]: r for r in rows}
    for f in range(min(by), max(by) + 1):
        if f in by and (f - 1) % every == 0 and by[f][1]:
            seen.append((f, by[f][1], max(by[f][2] or 0.0, 0.01)))
        seen = [x for x in seen if x[0] > f - history]
        sums = {c: (sum(x[2] for x in seen if x[1] == c), sum(x[1] == c for x in seen), c) for _, c, _ in seen}
        if sums:
            best = max(sums, key=sums.get)
            share = sums[best][0] / sum(v[0] for v in sums.values())
            if sums[best][1] >= least and share >= consensus and (held is None or held[0] == best or share >= change):
                held = (best, min(sums[best][0] / sums[best][1], 1.0), max(x[0] for x in seen if x[1] == best))
        if held and f - held[2] > retention:
            held, seen = None, []
        if f in by:
            out.append((f, *(held or (None, None, None))))
    return out


def colours(spark):
    rng, rows = random.Random(9), []
    for track in range(1, 7):
        f = 1
        for _ in range(140):
            f += rng.choice([1, 1, 2, 3, 40 if rng.random() < 0.1 else 1])
            rows.append(("s", track, f, "car", rng.choice(["red", "red", "blue", None]) if f % 200 < 100 else rng.choice(["blue", "blue", "blue", "red"]), rng.choice([0.0, 0.4, 0.9, 1.5, None])))
    return spark.createDataFrame(rows, "sequence string, track_id long, frame long, class string, color string, conf double"), rows


def test_colours_against_a_plain_store(spark):
    obs, rows = colours(spark)
    got = tracker.visual_attributes(obs, every=2, history=30, retention=35).collect()
    assert len(got) == len(rows) and any(r.held is None and r.frame > 100 for r in got)
    for track in range(1, 7):
        want = plain_colours([(r[2], r[4], r[5]) for r in rows if r[1] == track], 2, 30, 3, 0.62, 0.76, 35)
        have = sorted((r.frame, r.held, r.confidence, r.last) for r in got if r.track_id == track)
        assert [(f, h, None if c is None else round(c, 9), at) for f, h, c, at in have] == [(f, h, None if c is None else round(c, 9), at) for f, h, c, at in want]


def test_colours_are_shown_once_and_for_vehicles_only(spark):
    rows = [("s", t, f, c, "red", 0.9) for t, c in ((1, "Car"), (2, "Red truck"), (3, "person"), (4, None)) for f in range(1, 21)]
    got = tracker.visual_attributes(spark.createDataFrame(rows, "sequence string, track_id long, frame long, class string, color string, conf double")).where("frame = 20").collect()
    assert {r.track_id: r.display for r in got} == {1: "red Car", 2: "Red truck", 3: "person", 4: None}
    assert [r.held for r in got if r.track_id == 3] == [None]


def test_colours_as_a_stream(spark, tmp_path):
    obs, _ = colours(spark)
    slim = obs.select("sequence", "track_id", "frame", F.col("color").alias("class"), "conf")
    for i, (low, high) in enumerate([(0, 60), (60, 130), (130, 10**6)]):
        slim.where((F.col("frame") >= low) & (F.col("frame") < high)).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(slim.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.stabilized_stream(stream, tracker.VisualAttributes, every=2, history=30).writeStream.format("memory").queryName("held_colours").outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(((r.track_id, r.frame, r.stable) for r in spark.table("held_colours").collect()), key=str)
    assert got == sorted(((r.track_id, r.frame, r.held) for r in tracker.visual_attributes(obs, every=2, history=30).collect()), key=str)


def test_a_store_sees_what_leaves_while_it_catches_up():
    p = tracker.ProposalStore(history=10, rows=1, consensus=0.6, change=0.6, retention=20)
    assert [p.step(f, c, w) for f, c, w in ((1, "a", 1.0), (5, "b", 1.0), (8, "b", 0.4))] == ["a", "a", "a"]
    p.step(40, "a", 1.0)  # b is held from frame 11, when a leaves, to 28; so a is new
    assert (p.stable, p.last, len(p.seen)) == ("a", 40, 1)


def tiff(mask, order, strips, pack, compression, predictor=1):
    """A TIFF as other programs write it: several strips, a given byte order."""
    kind = np.dtype(f"{order}u{mask.dtype.itemsize}")
    data = np.diff(mask, axis=1, prepend=mask.dtype.type(0)) if predictor == 2 else mask
    rows = -(-mask.shape[0] // strips)
    parts = [pack(data[i : i + rows].astype(kind).tobytes()) for i in range(0, mask.shape[0], rows)]
    at = np.cumsum([8, *map(len, parts)])
    body = b"".join(parts)
    lists = struct.pack(f"{order}{2 * len(parts)}I", *at[:-1], *map(len, parts))
    start = 8 + len(body)
    short, one = lambda tag, v: struct.pack(order + "HHIHH", tag, 3, 1, v, 0), len(parts) == 1
    long_ = lambda tag, v, n: struct.pack(order + "HHII", tag, 4, n, v)
    entries = [short(256, mask.shape[1]), short(257, mask.shape[0]), short(258, 8 * mask.dtype.itemsize), short(259, compression), long_(273, 8 if one else start, len(parts)), short(278, rows), long_(279, len(body) if one else start + 4 * len(parts), len(parts)), short(317, predictor)]
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", start + len(lists)) + body + lists + struct.pack(order + "H", len(entries)) + b"".join(entries) + b"\0" * 4


def lzw(data):
    table, width, bits, word = {bytes([i]): i for i in range(256)}, 9, ["100000000"], b""
    n = 258
    for byte in data:
        c = bytes([byte])
        if word + c in table:
            word += c
            continue
        bits.append(f"{table[word]:0{width}b}")
        table[word + c], n, word = n, n + 1, c
        width = min(12, max(9, n.bit_length()))
        if n == 4094:
            bits.append(f"{256:0{width}b}")
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
    if word:
        bits.append(f"{table[word]:0{width}b}")
        width = min(12, max(9, (n + 1).bit_length()))
    text = "".join([*bits, f"{257:0{width}b}"])
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def pack_bits(data):
    return b"".join(bytes([len(c) - 1]) + c for c in (data[i : i + 100] for i in range(0, len(data), 100))) + b"\x80"


def labels(kind, height=61, width=83):
    m = np.zeros((height, width), kind)
    rng = np.random.default_rng(4)
    for i in range(1, 30):
        y, x = rng.integers(0, height), rng.integers(0, width)
        m[y : y + 9, x : x + 12] = i if kind == np.uint8 else i * 1500
    return m


@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.uint32])
@pytest.mark.parametrize("order", ["<", ">"])
def test_masks_as_others_write_them(kind, order):
    m = labels(kind)
    for pack, compression in ((bytes, 1), (lzw, 5), (zlib.compress, 8), (zlib.compress, 32946), (pack_bits, 32773)):
        for strips, predictor in ((1, 1), (4, 1), (3, 2)):
            assert (masks.decode(tiff(m, order, strips, pack, compression, predictor)) == m).all()
    noise = np.random.default_rng(1).integers(0, 200, (90, 97)).astype(kind)  # fills the table of LZW
    assert (masks.decode(tiff(noise, order, 1, lzw, 5)) == noise).all()
    assert masks.unpack_bits(bytes([254, 7, 1, 1, 2, 128])) == b"\x07\x07\x07\x01\x02"


def test_boxes_of_masks(spark, tmp_path):
    m = labels(np.uint16)
    for name, data in (("01_GT/TRA/man_track007.tif", tiff(m, ">", 2, lzw, 5)), ("01_GT/TRA/man_track008.tif", masks.encode(np.zeros((4, 4), np.uint16))), ("02_GT/TRA/man_track000.tif", masks.encode(m.astype(np.uint32) * 70)), ("01_GT/TRA/man_seg007.tif", b"other")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = masks.read_masks(spark, str(tmp_path)).collect()
    want = []
    for v in set(m[m > 0].tolist()):
        ys, xs = np.where(m == v)
        box = (float(xs.min()), float(ys.min()), float(xs.max() - xs.min() + 1), float(ys.max() - ys.min() + 1))
        want += [("01", 8, v, *box), ("02", 1, v * 70, *box)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_masks_from_rows(spark):
    images = "path string, content binary"
    good = masks.encode(np.array([[0, 3], [0, 3]]))
    rows = [("man_track2.tif", good), ("f/man_track2.tif", good), ("_GT/f/man_track2.tif", good), ("x/y/none.tif", b"")]
    assert sorted(r.sequence or "-" for r in masks.mask_boxes(spark.createDataFrame(rows, images)).collect()) == ["-", "f", "f"]
    for bad in (b"", b"II*\0", good[:-30], None):
        with pytest.raises(Exception, match="unreadable mask"):
            masks.mask_boxes(spark.createDataFrame([("a/b/m1.tif", bad)], images)).collect()
    assert masks.mask_boxes(spark.createDataFrame([], images)).count() == 0


ROWS = "sequence string, frame long, conf double"


class Counted:
    def __init__(self):
        self.calls = []

    def __call__(self, rows, options):
        self.calls.append((sorted({r.sequence or "-" for r in rows.select("sequence").distinct().collect()}), options["least"]))
        return rows.where(F.col("conf") >= options["least"]).groupBy("sequence").agg(F.count("*").alias("n"))


def test_runs_compute_what_is_new(spark, tmp_path):
    rows = [(s, f, f / 10) for s in ("a", "b", None) for f in range(10)]
    first, c = spark.createDataFrame(rows, ROWS), Counted()
    runs = Runs(spark, str(tmp_path / "r"), c)
    settings = {"low": {"least": 0.2}, "never": {"least": 5.0}}
    got, plan = runs.run(first, settings)
    assert sorted((r.sequence or "-", r.setting, r.n) for r in got.collect()) == [("-", "low", 8), ("a", "low", 8), ("b", "low", 8)]
    assert len(c.calls) == 2 and not plan.where("reused").count()
    c.calls.clear()
    again, plan = runs.run(first.repartition(3).orderBy(F.desc("frame")), settings)
    assert again.count() == 3 and plan.where("reused").count() == 6 and c.calls == []
    changed = spark.createDataFrame([*rows, ("b", 10, 1.0), ("c", 1, 1.0)], ROWS)
    got, plan = runs.run(changed, settings | {"high": {"least": 0.9}})
    assert c.calls == [(["b", "c"], 0.2), (["b", "c"], 5.0), (["-", "a", "b", "c"], 0.9)]
    assert sorted((r.sequence or "-", r.setting, r.n) for r in got.collect()) == [("-", "high", 1), ("-", "low", 8), ("a", "high", 1), ("a", "low", 8), ("b", "high", 2), ("b", "low", 9), ("c", "high", 1), ("c", "low", 1)]
    c.calls.clear()
    Runs(spark, str(tmp_path / "r"), c, version="2").run(first, {"low": {"least": 0.2}})
    assert c.calls == [(["-", "a", "b"], 0.2)]


def test_a_lost_run_is_passed_over(spark, tmp_path):
    first, root = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.5)], ROWS), str(tmp_path / "r")
    c = Counted()
    runs = Runs(spark, root, c)
    runs.run(first, {"low": {"least": 0.2}})
    spark.createDataFrame([("a", 7, "low")], "sequence string, n long, setting string").write.parquet(f"{root}/results/run=0lost")  # results without a manifest
    got, plan = runs.run(first, {"low": {"least": 0.2}})
    assert sorted((r.sequence, r.n) for r in got.collect()) == [("a", 1), ("b", 1)] and plan.where("reused").count() == 2
    manifest = spark.read.parquet(f"{root}/manifest/*").withColumn("rows", F.col("rows") + 1).collect()
    spark.createDataFrame(manifest, "sequence string, setting string, fingerprint string, rows long").write.mode("overwrite").parquet(f"{root}/manifest/" + next(p.name for p in (tmp_path / "r" / "manifest").iterdir()))
    c.calls.clear()
    got, plan = runs.run(first, {"low": {"least": 0.2}})  # fewer rows than the manifest names
    assert sorted((r.sequence, r.n) for r in got.collect()) == [("a", 1), ("b", 1)] and len(c.calls) == 1


def test_fingerprints_tell_rows_apart(spark):
    def mark(*rows):
        return fingerprints(spark.createDataFrame(rows, "k string, a string, b string"), "k").first().fingerprint

    base = mark(("k", "x", None), ("k", "y", "z"))
    assert base == mark(("k", "y", "z"), ("k", "x", None))
    assert len({base, mark(("k", None, "x"), ("k", "y", "z")), mark(("k", "x", None), ("k", "y", "z"), ("k", "y", "z")), mark(("k", "x", ""), ("k", "y", "z"))}) == 4


def test_tracker_reads_its_frames_in_batches(spark):
    rng = random.Random(4)
    rows = [(s, f, 20.0 * k + f % 5, 5.0 * k, 18.0, 18.0, 0.5, "x") for s in ("a", "b") for f in range(1, 40) if f % 13 > 3 for k in range(rng.randrange(1, 5))]
    d = spark.createDataFrame(rows, DETECTION)
    plain = lambda df: sorted(((r.sequence, r.frame, r.track_id, round(r.x, 6), round(r.y, 6)) for r in df.collect()), key=str)
    name, cut = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.createDataFrame([("a", 20)], "sequence string, frame long")
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        assert plain(tracker.sort_tracks(d, cuts=cut, min_hits=1)) == plain_tracks(rows, {("a", 20)}, min_hits=1)
    finally:
        spark.conf.set(name, before)
    fold = tracker.Sort(min_hits=1)
    fold.step(np.array([[0.0, 0, 10, 10], [50, 0, 60, 10]]))
    assert fold.tracks == [1, 2]
    fold.tracks = [2]
    assert [t for t, *_ in fold.step(np.array([[0.0, 0, 10, 10], [50, 0, 60, 10]]))] == [2, 3]


def test_prices_of_a_transport_prove_it():
    from boxtrail.operators.assignment import priced_transport
    from boxtrail.operators.matching import hungarian

    rng = np.random.default_rng(6)
    for _ in range(60):
        n, m = rng.integers(1, 9, 2)
        weight = rng.random((n, m)) * (rng.random((n, m)) < 0.7)
        supply, demand = rng.integers(1, 5, n), rng.integers(1, 5, m)
        found, u, v = priced_transport(weight, supply, demand)
        assert (weight <= u[:, None] + v + 1e-12).all() and min(u.min(), v.min()) >= 0
        total = sum(weight[i, j] * k for i, j, k in found)
        assert total == pytest.approx(u @ supply + v @ demand)
        rows = np.repeat(np.repeat(weight, supply, 0), demand, 1)
        assert total == pytest.approx(sum(rows[a, b] for a, b in hungarian(1 - rows)))
