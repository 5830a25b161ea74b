"""Operators 11 to 13 against brute-force versions, with nulls, empty and long texts, repeated rows and ids and columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from boxtrail.llm import op11_spelling_groups as op11
from boxtrail.llm import op12_merkle_manifest as op12
from boxtrail.llm import op13_phrase_automata as op13
from boxtrail.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, no long, key binary, g string, hash binary, idx long, one string, shard long"


def docs_of(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars), with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, 2, b"k", "g", b"h", 3, "o", 4) for r in rows], DOCS).repartition(3)


def plain_docs(spark, texts):
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return docs_of(spark, [(i, t, None, None, None) for i, t in pairs])


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling(rows, damage):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x7f" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        by = sorted((-words[v], v) for v in words if near(v, w))
        form = by[0][1] if by and -by[0][0] >= 5 * n else None
        out[w] = (form, n, len(by), words[form] if form else None)
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


@pytest.mark.parametrize("damage", [None, 7])
def test_op11_equals_all_pairs(spark, damage):
    rng = random.Random(3)
    base = ["harbour", "bookkeeper", "committee", "aaaaaaa", "straße", "ÀÉÎõü÷", "mississippi", "l" * 300]
    words = [(w, 400) for w in base] + [("comttep", 6), ("comtteep", 30), ("commtteep", 160), ("commtteepe", 801)]  # a chain: an edit and over five times as often each
    for w in base:
        for _ in range(12):
            i, c = rng.randrange(len(w)), rng.choice("abelmÿ")
            words.append((rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]]), rng.choice([3, 5, 16, 80])))
    pool = [w for w, n in words for _ in range(n)]
    rng.shuffle(pool)
    texts = [None, "", " .,;", "Harbour HARBOUR harboUR", *(rng.choice([" ", ". ", "7"]).join(pool[i::40]) for i in range(40)), (None, "harbour " * 9), (3, "harbor " * 6), (3, "harbor " * 6), "z" * 20_000 + "q", ("x1 " + "Z" * 20_000 + " ") * 5]
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in op11.spelling_forms(plain_docs(spark, texts), damage=damage).collect()}
    want = spelling(rows, damage)
    assert got == want
    assert any(form for form, *_ in want.values()) and any(form and root != form for form, root, *_ in want.values())


def test_op11_empty(spark):
    assert op11.spelling_forms(plain_docs(spark, []).limit(0)).count() == 0
    assert op11.spelling_forms(plain_docs(spark, [None, "", "one two"])).count() == 0


def test_op11_numbers_of_places_are_those_of_the_words():
    for word in ("banana", "aab", "x", "ÿÿÿaÿÿ"):
        blanks, gaps = op11.places(word)
        assert blanks == [op11.polynomial(word[:i] + "\0" + word[i + 1 :]) for i in range(len(word))]
        assert sorted(gaps) == sorted({op11.polynomial(word[:i] + word[i + 1 :]) for i in range(len(word))})


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout):
    """(root, siblings of each leaf)."""
    paths, nodes, under = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        up, members = [], []
        for i in range(0, len(nodes), fanout):
            run = nodes[i : i + fanout]
            for k in range(len(run)):
                for leaf in under[i + k]:
                    paths[leaf].append((run[:k], run[k + 1 :]))
            up.append(sha(*run))
            members.append([x for u in under[i : i + fanout] for x in u])
        nodes, under = up, members
    return nodes[0], paths


def leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(rows, fanout, tampered):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        h = leaf((doc_id, source, lang, n_chars, text))
        hit = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % tampered == 0
        groups[lang].append((doc_id is not None, doc_id or 0, h, doc_id, leaf((doc_id, source, lang, n_chars + 1, text)) if hit else h))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        groups[x].sort()
        trees[x] = tree([g[2] for g in groups[x]], fanout)
    root, tops = tree([trees[x][0] for x in langs], fanout)
    out = []
    for k, x in enumerate(langs):
        for (_, _, h, doc_id, other), path in zip(groups[x], trees[x][1], strict=True):
            value, seen = other, []
            for left, right in path + tops[k]:
                value = sha(*left, value, *right)
                seen += left + right
            out.append((doc_id, h, trees[x][0], root, sha(*seen), value, value == root))
    return sorted(out, key=repr)


def table_rows(rng, n):
    langs = [None, "", "de", "en", "en", "en", "zz", "é"]
    return [(i, rng.choice([None, "", "a:b", "é" * (i % 9)]), rng.choice(langs), rng.choice([None, "web", "-"]), rng.choice([None, 0, i, 99])) for i in rng.sample(range(-50, 5000), n)]


@pytest.mark.parametrize("fanout,step,n", [(2, 12, 700), (2, 2, 700), (3, 1, 400), (16, 2, 600), (2, 3, 1), (2, 1, 2)])
def test_op12_equals_trees_built_whole(spark, fanout, step, n):
    rows = table_rows(random.Random(n), n)
    if n > 2:
        rows += [(None, None, None, None, None), (None, "x", "en", None, 4), (None, "x", "en", None, 4), rows[0], rows[0], (14, "", "only", "s", 9_223_372_036_854_775_807)]
    got = sorted((tuple(r) for r in op12.manifest(docs_of(spark, rows), fanout=fanout, step=step).collect()), key=repr)
    assert got == plain_manifest(rows, fanout, op12.TAMPERED)


def test_op12_untampered_rows_verify(spark):
    rows = table_rows(random.Random(9), 120)
    assert all(r.verified for r in op12.manifest(docs_of(spark, rows), tampered=None).collect())


def test_op12_empty(spark):
    assert op12.manifest(docs_of(spark, []).limit(0)).count() == 0


def test_op12_counts_places_over_unequal_partitions(spark):
    leaves = spark.createDataFrame([("a" if i % 5 else "b", i % 3, bytes([i % 7])) for i in range(300)], "g string, k long, hash binary").repartition(7)
    got = op12.numbered(leaves, ["k"], Scratch(spark)).collect()
    for g, n in (("a", 240), ("b", 60)):
        own = sorted((r.idx, r.n, r.k, bytes(r.hash)) for r in got if r.g == g)
        assert [(i, m) for i, m, _, _ in own] == [(i, n) for i in range(n)] and [x[2:] for x in own] == sorted(x[2:] for x in own)


def cut(rows, window):
    first = {}
    rank = lambda d: (d is None, d or 0)
    split = [(d, [w.decode() for w in (t or "").encode().split()]) for d, t in rows]
    for d, words in split:
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            first[key] = min(first.get(key, rank(d)), rank(d))
    out = []
    for d, words in split:
        gone = set()
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < rank(d):
                gone.update(range(s, s + window))
        out.append((d, len(words), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def test_op13_equals_all_windows(spark, monkeypatch):
    monkeypatch.setattr(op13, "SHARD_WINDOWS", 40)  # several shards, pieces and copies of a shard
    monkeypatch.setattr(op13, "PIECE", 5)
    monkeypatch.setattr(op13, "TASK_BYTES", 4000)
    rng = random.Random(11)
    a, b, c = prose(rng, 300), prose(rng, 120), prose(rng, 49)
    x, y = prose(rng, 50), prose(rng, 51)
    texts = [None, "", " \n\t", "one", (900, a), (17, a), (17, a), f"{prose(rng, 30)} {b} {prose(rng, 9)}", f"{b.upper()} {b}", f"{c} q", f"{c} z {c}", (None, a + " " + b), (None, b), (5, x), (5, x + " tail"), (6, x)]
    texts += [f"{x} {x} {x}", f"{y} {x}", "la " * 200, "la " * 120 + "end", "ö\x1c\x85 " * 70, "ö\x1c\x85\n" * 60]
    words = a.split()
    for _ in range(25):  # copies with edits, and parts of all lengths: phrases begin and end everywhere
        i, n = rng.randrange(200), rng.randrange(40, 100)
        near_copy = list(words)
        near_copy[rng.randrange(300)] = f"e{rng.randrange(5)}"
        texts += [" ".join(near_copy), f"{prose(rng, 5)} {' '.join(words[i : i + n])} {prose(rng, 5)}", f"{' '.join(words[i : i + 50])} {' '.join(words[i + 1 : i + 60])}"]
    texts.append(prose(rng, 5000) + " " + a)
    rows = [t if isinstance(t, tuple) else (1000 + i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = sorted((tuple(r) for r in op13.cut_repeats(plain_docs(spark, rows)).collect()), key=repr)
    assert got == cut(rows, 50)
    assert sum(r[2] > 0 for r in got) > 40


def test_op13_short_windows(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(60)]
    got = sorted((tuple(r) for r in op13.cut_repeats(plain_docs(spark, rows), window=5).collect()), key=repr)
    assert got == cut(rows, 5)


def test_op13_empty(spark):
    assert op13.cut_repeats(plain_docs(spark, []).limit(0)).count() == 0
    assert [tuple(r)[:3] for r in op13.cut_repeats(plain_docs(spark, [(None, None)])).collect()] == [(None, 0, 0)]


def test_op13_powers():
    assert op13.powers(7, 1009, 50).tolist() == [pow(7, i, 1009) for i in range(50)] and op13.powers(3, 7, 0).tolist() == []
