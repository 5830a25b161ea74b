"""Each text operator against a brute-force version, with nulls, empty and long texts, repeated rows and columns of clashing names."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from boxtrail.llm import op1_merkle_audit as op1
from boxtrail.llm import op2_byte_bpe as op2
from boxtrail.llm import op3_winnowing as op3
from boxtrail.llm import op4_minhash_forest as op4
from boxtrail.llm import op5_maxent_lm as op5
from boxtrail.llm import op6_byte_gru as op6
from boxtrail.llm import op7_sparse_suffixes as op7
from boxtrail.llm import op8_likelihood_ratio as op8
from boxtrail.llm import op9_url_rules as op9
from boxtrail.llm import op10_license_index as op10
from boxtrail.llm.common import Scratch, components

DOCS = "doc_id long, text string, lang string, tokens string, row string, words string"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs_of(spark, texts):
    """Rows with columns whose names the operators use inside; ids repeat where a pair gives them."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, None, "x", "y", "z") for i, t in pairs], DOCS).repartition(3)


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 12, 60, 130, 400)]
    near = base[3].split()
    near[20] = "changed"
    return [None, "", " \n\t ", "one", "Two words", *base, base[4], base[4], " ".join(near), base[2] + " " + base[3], "É " + base[2].upper(), "la " * 200, prose(rng, 3000)]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (9, 8), (8, 9)], "a long, b long")
    found = dict(components(spark, edges, Scratch(spark)).collect())
    assert found == {**{i: 100 for i in range(100, 161)}, 5: 5, **{i: 5 for i in range(200, 260)}, 8: 8, 9: 8}


def records(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    record = op1.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    return pages.select("page_id", F.sha2(record, 256).alias("hash"), F.length(record).cast("long").alias("size"))


def test_op1_finds_altered_missing_and_extra_records(spark):
    rows = [(i, f"http://h/{i}", "x" * (i % 7)) for i in range(700)] + [(3, "http://h/3", "xxx")] * 2 + [(None, None, None)]
    listed = op1.lay_out(records(spark, rows), Scratch(spark))
    got = listed.collect()
    assert len(got) == 703 and {(r.file, r.slot) for r in got} == {divmod(i, op1.FILE_RECORDS) for i in range(703)}
    assert op1.audit(listed, listed).count() == 0
    bad = {(0, 5), (1, 0), (2, 190)}
    key = F.struct("file", "slot")
    wrong = listed.select("file", "slot", F.when((F.col("file") == 0) & (F.col("slot") == 5), "0" * 64).when((F.col("file") == 1) & (F.col("slot") == 0), None).otherwise(F.col("hash")).alias("hash"))
    wrong = wrong.where(~((key["file"] == 2) & (key["slot"] == 190))).union(spark.createDataFrame([(2, 255, "f" * 64)], "file long, slot int, hash string"))
    found = {(r.file, r.slot): r.status for r in op1.audit(listed, wrong).collect()}
    assert found == {(0, 5): "altered", (1, 0): "missing", (2, 190): "missing", (2, 255): "extra"} and bad < set(found)


def test_op1_empty(spark):
    listed = op1.lay_out(records(spark, []), Scratch(spark))
    assert op1.audit(listed, listed).count() == 0


def test_op2_equals_tiktoken_and_round_trips(spark, texts):
    ranks = op2.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*texts, "ab" * 3000, "a" * 2000, " " * 500 + "x", "héllo wörld's 123,456 \U0001f600!!", "<|endoftext|>"]
    got = {r.doc_id: r for r in op2.encode_and_decode(docs_of(spark, texts), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    for i, text in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == known.encode_ordinary(text or "")
        assert bytes(got[i].decoded) == (text or "").encode()
    assert op2.encode_and_decode(docs_of(spark, []).limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_op2_long_words_in_single_steps(spark):
    """Where a pair has a lower rank than a token in it, sweeps and single steps are mixed; all tokens of this made-up table are such, or none."""
    rng = random.Random(40)
    tokens = [bytes([b]) for b in range(256)]
    made = list({"".join(rng.choice("ab") for _ in range(rng.randrange(2, 6))).encode() for _ in range(60)})
    rng.shuffle(made)  # ranks in no order of length
    ranks = {t: i for i, t in enumerate([*tokens, *made])}
    codec = op2.Codec(ranks, r"[^ ]+")
    known = tiktoken.Encoding("made", pat_str=r"[^ ]+", mergeable_ranks=ranks, special_tokens={})
    assert codec.early
    for n in (70, 200, 700):
        word = "".join(rng.choice("ab") for _ in range(n))
        assert np.frombuffer(codec.encode([word])[0], "<u4").tolist() == known.encode_ordinary(word)


def brute_op3(docs, items):
    words = lambda t: [w.decode() for w in WORD.findall((t or "").encode().lower())]
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for item, t in sorted(set(items), key=repr):
            v = words(t)
            m = min(13, len(v))
            grams = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if v else set()
            for k in range(len(w) - m + 1 if v else 0):
                if tuple(w[k : k + m]) in grams:
                    hit |= set(range(k, k + m))
                    names |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), len(names), ",".join(sorted(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [op3.SMALL_BYTES, 0])
def test_op3_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(op3, "SMALL_BYTES", limit)
    rng = random.Random(3)
    long, other = prose(rng, 40), prose(rng, 20)
    items = [(1, long), (2, other), (10, "w1 w2"), (3, "w5"), (4, None), (5, ""), (2, other), (6, other), (7, prose(rng, 5)), (8, prose(rng, 12)), (None, prose(rng, 30)), (9, prose(rng, 13))]
    w = long.split()
    docs = [(0, None), (1, ""), (2, long.upper()), (3, "x " * 30 + " ".join(w[5:18]) + " y" * 5), (4, " ".join(w[5:17])), (5, other + " " + long), (5, other), (6, "w1, w2! w1"), (7, prose(rng, 2000)), (8, items[8][1] + " z " + items[9][1]), (9, "é " + other), (10, "q " + items[10][1]), (11, items[11][1] + " r"), (12, " ".join(items[10][1].split()[3:17]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    got = op3.decontaminate(docs_of(spark, docs), benchmark).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got), key=repr) == brute_op3(docs, items)


def test_op3_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in op3.decontaminate(docs_of(spark, ["a b"]), none).collect()] == [(0, 2, 0, 0, [], hashlib.sha256(b"").hexdigest(), False)]
    assert op3.decontaminate(docs_of(spark, []), none).count() == 0


def test_op3_items_that_share_a_header(spark):
    """Two thousand items begin with one passage, which a third of the texts have: the index has it once, and each text's row gets the items at the end."""
    rng = random.Random(8)
    head = prose(rng, 20, 5000)
    items = [(f"i{i:05}", f"{head} {prose(rng, 30, 5000)}") for i in range(2000)]
    texts = [f"{prose(rng, 20, 5000)} {head} {prose(rng, 20, 5000)}" if i % 3 == 0 else prose(rng, 60, 5000) for i in range(60)] + [items[7][1]]
    prints, windows, members = op3.item_index(spark.createDataFrame(items, "item_id string, text string"), Scratch(spark))
    assert windows.where(F.array_join("words", " ") == " ".join(head.split()[:13])).count() == 1 and members.where(F.size("ids") == 2000).count() == 1
    got = {r.doc_id: r for r in op3.decontaminate(docs_of(spark, texts), spark.createDataFrame(items, "item_id string, text string")).collect()}
    for i, text in enumerate(texts):
        if i % 3 == 0:
            assert got[i].n_items == 2000 and got[i].items == [x for x, _ in items] and got[i].n_hit >= 20
            assert got[i].items_sha256 == hashlib.sha256(",".join(got[i].items).encode()).hexdigest()
        else:
            assert got[i].n_items == 0
    assert got[60].n_hit == 50


def brute_op4(docs, k, threshold):
    sets = {}
    for n, (_, t) in enumerate(docs):
        w = (t or "").encode().lower().split()
        sets[n] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    root = {n: n for n in sets}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    least = defaultdict(list)
    for n in sets:
        least[find(n)].append(docs[n][0])
    return sorted((docs[n][0], len(sets[n]), min(least[find(n)]), docs[n][0] == min(least[find(n)])) for n in sets)


@pytest.mark.parametrize(("k", "threshold"), [(3, 85), (5, 80)])
def test_op4_equals_brute_force(spark, texts, k, threshold):
    rng = random.Random(9)
    source = prose(rng, 150, 5000).split()
    variants = []
    for _ in range(60):
        v = list(source)
        for _ in range(rng.randrange(6)):
            v[rng.randrange(len(v))] = f"e{rng.randrange(10**6)}"
        variants.append(" ".join(v))
    docs = [(i, t) for i, t in enumerate([*texts, *variants, *(prose(rng, 30, 50) for _ in range(40))])]
    got = op4.near_duplicates(docs_of(spark, docs), k, threshold).collect()
    assert sorted(tuple(r) for r in got) == brute_op4(docs, k, threshold)


def test_op4_finds_the_one_partner_in_a_family_below_the_threshold(spark):
    """Relatives reach 0.8 or so with each other, and every second one 0.87 with one partner."""
    rng = random.Random(21)
    source, docs = [f"s{i}" for i in range(240)], []
    edit = lambda v, n: [v.__setitem__(i, f"e{rng.randrange(10**9)}") for i in rng.sample(range(len(v)), n)]
    for i in range(900):
        if i % 2:
            v = docs[-1][1].split()
            edit(v, 5)
        else:
            v = list(source)
            edit(v, 5)
        docs.append((i, " ".join(v)))
    got = op4.near_duplicates(docs_of(spark, docs), 3, 85).collect()
    assert sorted(tuple(r) for r in got) == brute_op4(docs, 3, 85)


def test_op4_compares_across_several_partitions_of_ends(spark, monkeypatch):
    """The rows at the ends of sorted runs fill several partitions, for some levels."""
    monkeypatch.setattr(op4, "ENDS", 300)
    rng = random.Random(22)
    docs = []
    for i in range(700):
        if i % 2:
            v = docs[-1][1].split()
            v[rng.randrange(len(v))] = "changed"
            docs.append((i, " ".join(v)))
        else:
            docs.append((i, prose(rng, 60, 9000)))
    frame = docs_of(spark, docs)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = op4.near_duplicates(frame, 3, 85).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(tuple(r) for r in got) == brute_op4(docs, 3, 85)


def test_op4_parity_bitmaps_differ_in_no_more_bits_than_the_sets():
    dice = np.random.default_rng(4)
    for n, changed in [(1, 1), (30, 3), (500, 40), (5000, 900), (5000, 0)]:
        x = np.unique(dice.integers(-(2**63), 2**63 - 1, n + changed))
        a, b = x[changed // 2 :], x[: len(x) - changed // 3]
        apart = int(np.bitwise_count((op4.parity(a) ^ op4.parity(b)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(a, b))
        assert (apart == 0) == (len(np.setxor1d(a, b)) == 0)


def test_components_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr("boxtrail.llm.common.TASK_ROWS", 7)
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)] + [(9, 8), (8, 9), (5, 5)], "a long, b long")
    found = dict(components(spark, edges, Scratch(spark)).collect())
    assert found == {i: 100 for i in range(100, 131)} | {i: 200 for i in range(200, 240)} | {9: 8, 8: 8}


def test_op4_descends_larger_regions():
    """Rows of a region are compared whole up to REACH + 1, beyond that in parts of at most LEAF rows, and neighbours always."""
    key = np.zeros((100, op4.VALUES), np.uint16)
    key[:, op4.PREFIX] = np.arange(100) // 5
    last = op4._leaves(np.zeros(100, int), key)
    assert last.tolist() == [max(5 * (i // 5) + 5, min(i + 2, 100)) for i in range(100)]
    assert op4._leaves(np.zeros(40, int), key[:40]).tolist() == [40] * 40
    assert op4._leaves(np.arange(3), key[:3]).tolist() == [1, 2, 3]
    assert op4._leaves(np.zeros(60, int), key[:1].repeat(60, 0)).tolist() == [min(i + 2, 60) for i in range(60)]


def test_op4_repeated_ids_with_other_texts(spark):
    rng = random.Random(30)
    a, b = prose(rng, 90, 5000), prose(rng, 90, 5000)
    docs = [(5, a), (5, b), (8, a + " more"), (9, b + " more"), (7, a), (6, None), (6, prose(rng, 50, 5000))]
    got = op4.near_duplicates(docs_of(spark, docs), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (6, 6, True), (6, 6, True), (7, 5, False), (8, 5, False), (9, 5, False)]


def test_op4_empty_and_null_ids(spark):
    assert op4.near_duplicates(docs_of(spark, [])).count() == 0
    got = {(r.doc_id, r.component_id, r.kept) for r in op4.near_duplicates(docs_of(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (None, None)])).collect()}
    assert got == {(None, 4, False), (4, 4, True), (None, None, True)}
    rng = random.Random(31)
    a, b = prose(rng, 90, 5000), prose(rng, 90, 5000)
    got = op4.near_duplicates(docs_of(spark, [(None, a), (3, a + " more"), (None, b), (None, b + " more")]), 3, 85).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == [(3, 3, True), (None, 3, False), (None, None, True), (None, None, True)]


def test_op5_base_is_exact_and_the_model_sums_to_one(spark, texts):
    rng = random.Random(2)
    half = [" ".join(rng.choice([f"{a}th" for a in "abcdefgh"]) for _ in range(40)) for _ in range(60)] + [" ".join(rng.choice([f"{a}ção" for a in "abcdefgh"]) for _ in range(40)) for _ in range(60)]
    docs = list(enumerate([*texts, *half]))
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    frame = docs_of(spark, docs).withColumn("held_out", F.col("doc_id").isin(*held))
    got = {r.doc_id: r for r in op5.score_texts(frame, frame.where("not held_out")).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in docs}
    count = Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    total, kinds = sum(count.values()), len(count)
    for i, ws in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), total)
        assert math.isclose(got[i].base_score, sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), rel_tol=1e-9)
        assert got[i].score < 0
    own = [i for i, _ in docs if i >= len(texts) and i in held]
    assert own and sum(got[i].score - got[i].base_score for i in own) > 0
    # probabilities of all known tokens and of one unseen token per class sum to one after any context
    model, counts, *_ = op5.fit(frame.where("not held_out"), Scratch(spark))
    hashes = op5.PackedWords()
    stream, owner = op5.sequences(["ath bth"], hashes)
    p = op5.probabilities(model.weights, op5.features(stream, np.array([5])))[0]
    inside = np.zeros(op5.CLASSES)
    for r in counts.collect():
        inside[model.class_of[r.token & (op5.ENDINGS - 1)]] += r.c + op5.ADD
    inside[1:] += op5.ADD
    assert abs((p * inside / 10**model.log_size).sum() - 1) < 1e-4


def test_op5_empty(spark):
    frame = docs_of(spark, ["a"]).withColumn("held_out", F.lit(True))
    r = op5.score_texts(frame, frame.limit(0)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0)
    assert op5.score_texts(frame.limit(0), frame).count() == 0


def test_op6_learns_and_rejects(spark):
    rng = random.Random(4)
    a, b = ["the", "with", "thing", "other"], ["que", "ção", "não", "então"]
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(30)), "en" if i % 2 else "pt") for i in range(400)]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "pt"), (1003, "the other thing " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    network = op6.train_on_documents(docs)
    got = {r.doc_id: r for r in op6.identify(docs, network).collect()}
    held = [r for r in rows if r[2] and r[0] < 1000 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002)) and got[1003].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert op6.train_on_documents(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert op6.identify(docs.limit(3), None).select("lang_pred").distinct().first()[0] == "und"


def test_op6_gradients_are_right():
    network = op6.Network(["a", "b", "c"], hidden=3)
    for way in network.ways:
        way.x, way.u = way.x.astype(np.float64), way.u.astype(np.float64)
    rows, target = np.random.default_rng(0).integers(0, 5, (4, op6.SEGMENT)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        p = network.positions(rows)[:, target, np.arange(4)]
        mask = rows.T != 0
        return -(np.log(p) * mask).sum() / mask.sum()

    grads = network._gradients(rows, target)
    for param, grad in zip([network.ways[0].x, network.ways[0].u, network.ways[1].x, network.ways[1].u, network.v], grads, strict=False):
        spot = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        kept, step = param[spot], 1e-2
        param[spot] = kept + step
        up = loss()
        param[spot] = kept - step
        down = loss()
        param[spot] = kept
        assert abs((up - down) / (2 * step) - grad[spot]) < 0.02 * abs(grad[spot]) + 1e-4


def brute_op7(docs, n):
    words = [(i, (t or "").encode().lower().split()) for i, t in docs]
    seen = Counter(tuple(w[s : s + n]) for _, w in words for s in range(len(w) - n + 1))
    out = []
    for i, w in words:
        spans = []
        for s in range(len(w) - n + 1):
            if seen[tuple(w[s : s + n])] > 1:
                if spans and spans[-1][1] >= s:
                    spans[-1][1] = s + n
                else:
                    spans.append([s, s + n])
        out += [(i, len(w), a, b) for a, b in spans]
    return sorted(out)


@pytest.mark.parametrize("n", [50, 20])
def test_op7_equals_brute_force(spark, texts, n):
    rng = random.Random(8)
    passages = [prose(rng, m, 3000) for m in (50, 51, 49, 80, 20, 19)]
    mixed = [" ".join(rng.choice([prose(rng, 15, 3000), *passages]) for _ in range(6)) for _ in range(25)]
    docs = list(enumerate([*texts, *mixed]))
    got = op7.repeated_passages(docs_of(spark, docs), n).collect()
    assert sorted(tuple(r) for r in got) == brute_op7(docs, n)
    assert op7.repeated_passages(docs_of(spark, [])).count() == 0


def test_op7_null_and_repeated_ids(spark):
    rng = random.Random(18)
    passage = prose(rng, 80, 3000)
    docs = [(None, passage + " " + prose(rng, 30, 3000)), (None, prose(rng, 10, 3000) + " " + passage), (4, prose(rng, 70, 3000)), (4, prose(rng, 5, 3000) + " " + passage), (None, None)]
    got = op7.repeated_passages(docs_of(spark, docs), 50).collect()
    assert sorted((tuple(r) for r in got), key=repr) == [(4, 85, 5, 85), (None, 110, 0, 80), (None, 90, 10, 90)]


def brute_op8(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_op8_base_rules_and_ratio(spark, texts):
    rng = random.Random(6)
    good = [prose(rng, 80) for _ in range(30)]
    junk = [" ".join(f"j{rng.randrange(300)} |" for _ in range(60)) for _ in range(30)]
    docs = list(enumerate([*texts, "a b c d a b c e a b\nline\nline\n \n \nx#*", *good, *junk]))
    trusted = spark.createDataFrame([(i,) for i, t in docs if t in good[:20]] * 2 + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in op8.judge(docs_of(spark, docs), trusted).collect()}
    for i, text in docs:
        base = brute_op8(text)
        assert tuple(got[i][1:6]) == base
        assert got[i].base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (got[i].base_failed and got[i].kept)
    assert all(got[i].kept for i, t in docs if t in good[:20]) and not any(got[i].kept for i, t in docs if t in junk)
    assert min(got[i].score for i, t in docs if t in good) > max(got[i].score for i, t in docs if t in junk)
    # the ratio itself, recomputed from the buckets that Spark's hash gives
    feats = {r.doc_id: r.f for r in docs_of(spark, docs).select("doc_id", op8.words_of(F.coalesce("text", F.lit(""))).alias("words")).transform(op8.with_hashes).select("doc_id", op8.features("hashes").alias("f")).collect()}
    ids = {r.doc_id for r in trusted.collect()}
    raw, target = Counter(x for f in feats.values() for x in f), Counter(x for i, f in feats.items() if i in ids for x in f)
    n, m, b = sum(raw.values()), sum(target.values()), op8.BUCKETS
    for i, f in feats.items():
        want = sum(math.log((target[x] + 1) / (m + b)) - math.log((raw[x] + 1) / (n + b)) for x in f) / max(1, len(f))
        assert abs(want - got[i].score) < 2e-4
    assert op8.judge(docs_of(spark, []), trusted.limit(0)).count() == 0


def test_op9_equals_sql(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7x", "https://a.example.com/en/8", "http://example.com/EN/7", "http://xexample.net/de/8", "http://example.net/de/8?x#y", "http://org/es/", "http://my-casino.de/a", "http://casino.example.com/en/7", "x://h://casino/", "http://h#f", "http://free-bets.x/robots.txt", "http://h/cgi-bin/x", "http://a.com/en/\n7", "http://b.com:80/en/"]
    rows = [(i, u, "h", "t") for i, u in enumerate([*urls, *urls[4:7]])] + [(3, urls[5], "h", "t"), (None, urls[5], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, token string").repartition(3)
    got = sorted((tuple(r) for r in op9.judge_urls(pages).collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows])
    assert got == sorted((tuple(r) for r in con.execute(op9.OP9_SQL).fetchall()), key=repr)
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[4][3:] == ("example.com/en/7", "allow") and by[5][3:] == ("com/en/", "block") and by[0] == (0, "", "", None, "allow")
    assert op9.judge_urls(pages.limit(0)).count() == 0


def test_op9_fetches_a_rule_by_either_of_its_tokens(spark):
    urls = ["http://ad.example.de/x", "http://ads.example.de/x", "https://x.AD.de/", "http://my.ads.de", "http://add.de/", "http://bad.de/ad.", "http://ad.de/robots.txt", "http://ad.ads.de/", "http://ad/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted((tuple(r) for r in op9.judge_urls(pages).collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(urls)))
    assert got == sorted((tuple(r) for r in con.execute(op9.OP9_SQL).fetchall()), key=repr)
    assert [r[4] for r in got] == ["block"] * 4 + ["allow"] * 3 + ["block", "allow"]


def test_op10_equals_brute_force(spark, texts):
    docs = [*texts, "MIT License. mit  license", "the Apache license; GNU General Public License", "general public mit apache", "MIT-License mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "license mit license", "permission is hereby granted to any person obtaining a copy"]
    got = {r.doc_id: r for r in op10.scan(docs_of(spark, docs)).collect()}
    for i, text in enumerate(docs):
        w, starts, labels = [x.decode() for x in WORD.findall((text or "").encode().lower())], [], set()
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[len(texts) + 4].labels == "mit" and got[len(texts) + 4].n_base == 0 and got[len(texts) + 6].labels == ""
    assert op10.scan(docs_of(spark, [])).count() == 0


def test_op10_equals_sql(spark):
    """Whole templates, cut and changed ones, repeated ids with other texts, repeated rows, long texts with the same phrase throughout."""
    rng = random.Random(14)
    vocab = sorted({w for x in op10.TEMPLATES for w in x[2].split()})
    docs = [(i, f"head {x[2]} tail") for i, x in enumerate(op10.TEMPLATES)]
    for i in range(100, 160):
        words = " x ".join(rng.choice(op10.TEMPLATES)[2] for _ in range(3)).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append((i, " ".join(words)))
    docs += [(200, " ".join(rng.choice(vocab) for _ in range(5000))), (201, "mit license " * 9000), (3, "Apache-License"), (3, "Apache-License"), (None, "MIT License"), (None, "all rights reserved"), (202, None), (203, ""), (204, "license " * 50)]
    got = sorted((tuple(r) for r in op10.scan(docs_of(spark, docs)).collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert got == sorted((tuple(r) for r in con.execute(op10.OP10_SQL).fetchall()), key=repr)
    assert all(x[0] in r[6].split(",") for x, r in zip(op10.TEMPLATES, sorted(r for r in got if r[0] is not None and r[0] < len(op10.TEMPLATES) and r[1] > 3), strict=False))


def test_hash_of_ids_is_as_the_contract_says(spark, tmp_path):
    docs_of(spark, ["hello world", None]).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op2.op2_byte_bpe(spark, str(tmp_path)).collect()}
    assert got[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and got[0].decoded_sha256 == hashlib.sha256(b"hello world").hexdigest() and got[0].n_tokens == 2


def test_op7_spans_of_many_windows(spark):
    rng = random.Random(3)
    starts = [sorted(rng.sample(range(9000), n)) for n in (0, 1, 2, 40, 300)] + [[61 * i for i in range(30_000)], [50 * i for i in range(1000)]]

    def merged(row):
        out = []
        for s in row:
            if out and out[-1][1] >= s:
                out[-1] = (out[-1][0], s + 50)
            else:
                out.append((s, s + 50))
        return out

    rows = spark.createDataFrame([(i, s) for i, s in enumerate(starts)] + [(-1, None)], "id int, starts array<int>").select("id", op7._spans(F.col("starts"), 50).alias("spans")).collect()
    got = {r.id: r.spans for r in rows}
    assert got.pop(-1) is None
    assert {i: [tuple(s) for s in spans] for i, spans in got.items()} == {i: merged(s) for i, s in enumerate(starts)}


def test_op7_windows_with_equal_first_hashes_stay_apart(monkeypatch):
    # words of one length share their first hash; the second one still tells the passages apart
    monkeypatch.setattr(op7.WordHashes, "__missing__", lambda self, word: 7 + len(word))
    texts = [" ".join(f"{c}{i:02d}" for i in range(50)) for c in "aba"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(map(op7.text_key, texts)), pa.array([list(range(50))] * 3), pa.array(texts)], ["doc_id", "text_key", "seeds", "text"])
    a, b, c = pa.Table.from_batches(op7._windows(50)(iter([batch]))).to_pylist()
    assert a["window"] == b["window"] == c["window"] and a["second"] == c["second"] != b["second"]


def test_op2_spills_where_spark_does(spark):
    def where(batches):
        codec = op2.Codec({bytes([b]): b for b in range(256)}, r"[^ ]+")
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.environ["SPARK_LOCAL_DIRS"].split(",")[0]]), pa.array([codec.con.execute("SELECT current_setting('temp_directory')").fetchone()[0]])], ["own", "used"])

    row = spark.range(1).mapInArrow(where, "own string, used string").first()
    assert row.own and row.used.startswith(row.own)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_op7_runs_of_windows_over_batches(size):
    rng = random.Random(size)
    rows = sorted((rng.randrange(3), rng.randrange(2), rng.choice([b"a", b"b", b"c"]), rng.randrange(3)) for _ in range(40)) + [(9, 9, b"z", 0)]
    table = pa.table({n: pa.array(c, t) for n, c, t in zip(["window", "second", "text_key", "start"], zip(*rows), [pa.int64(), pa.int64(), pa.binary(), pa.int32()])})
    got = [tuple(r.values()) for b in op7._repeats(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    runs = [list(g) for _, g in itertools.groupby(rows, key=lambda r: r[:2])]
    assert got == [(*r[2:], r[2:] != run[0][2:]) for run in runs if len(run) > 1 for r in run]


def test_op4_shingles_that_cant_bring_roots_together_give_no_rows():
    counts, mixed = np.zeros(op4.BUCKETS, np.int32), np.zeros(op4.BUCKETS, bool)
    counts[5], mixed[5] = 2, True
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 1]), pa.array([[1, 2, 3, 4, 5], [11, 12, 13, 14, 15]], pa.list_(pa.int64()))], ["cid", "root", "members"])
    rows = [r for b in op4._rarest(counts, mixed, 20)(iter([batch])) for r in b.to_pylist()]
    assert [(r["s"], r["cid"], r["n"], r["at"], r["short"]) for r in rows] == [(5, 1, 5, 4, False)]  # the place among all shingles


@pytest.mark.parametrize("top", [1.0, 500.0])
def test_op5_exponents_stay_in_reach(top):
    rng = np.random.default_rng(1)
    weights = (rng.normal(size=(50, op5.CLASSES)) * top).astype(np.float32)
    rows = np.concatenate([np.zeros((40, 1), int), rng.integers(1, 50, (40, op5.FEATURES - 1))], axis=1).astype(np.uint16)
    logits = weights[rows].astype(float).sum(1)
    want = np.exp(logits - logits.max(1, keepdims=True))
    parts, sums = op5.exponents(weights, rows)
    assert np.allclose(parts / sums[:, None], want / want.sum(1, keepdims=True), atol=1e-4)
