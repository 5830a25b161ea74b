"""Removal of passages that an earlier document has, by automata of recurring phrases.

Windows of WINDOW words that recur are found without counting all windows: any two copies of a window choose the same k-gram of theirs, so
only windows around k-grams that several texts have are hashed and counted. A recurring window belongs to the first text that has
it. Neighbouring windows of that text make one phrase if they occur at the same places of the same texts. Phrases are dealt to shards, each shard
is compiled into an Aho-Corasick automaton, and the texts are streamed through the automata of the shards that hold phrases of theirs, which locates
every occurrence and compares every letter: a hash decides nothing but what is compiled and where a text is sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm.common import Scratch, WordHashes, bounded_batches, maybe_broadcast, table
from boxtrail.llm.op7_sparse_suffixes import minimisers

WINDOW = 50
SHARD_WINDOWS = 8192  # recurring windows that one automaton is made for
PIECE = 12  # bits of a window's place: up to so many windows of a text go to one shard
TASK_BYTES = 16 << 20  # of texts streamed through one copy of a shard's automaton
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo prime, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += step
    return out[:n]


def _texts(window: int):
    """(doc_id, key, n_words, sha, grams) of (doc_id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, shas, grams = [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                at, all_grams = minimisers(hashes.of(words), window)
                sizes.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                grams.append(np.unique(all_grams[np.unique(at)]).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(grams, pa.binary())], ["doc_id", "key", "n_words", "sha", "grams"])

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = batch.column(1).to_pylist()
        no = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(p) // 8 for p in packed])
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(packed), "<i8")), pa.array(no, pa.int64())], ["gram", "no"])


def _windows(window: int):
    """(w1, w2, no, start, p1, p2) for the windows of (no, grams, text) around the grams: the hash, and numbers of the text and the place, which
    sums over a window's occurrences make a number of where it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for no, grams, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = words_of(text.as_py())
                at, own = minimisers(hashes.of(words), window)
                start = np.flatnonzero(np.isin(own[at].view(np.int64), np.array(grams.as_py(), np.int64)))
                if not len(start):
                    continue
                body, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
                begins = np.concatenate([[0], ends])[start].tolist()
                lasts = (ends[start + window - 1] - 1).tolist()
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(body[a:b]) for a, b in zip(begins, lasts, strict=True)), "<i8").reshape(-1, 2)
                seed = xxhash.xxh3_64_intdigest(str(no).encode())
                marks = [(powers(x, p, len(words))[start] * np.uint64(seed % (p - 1) + 1) % np.uint64(p)).astype(np.int32) for x, p in zip(BASES, PRIMES, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([no] * len(start), pa.int64()), pa.array(start.astype(np.int32)), *map(pa.array, marks)], ["w1", "w2", "no", "start", "p1", "p2"])

    return run


def _phrases(window: int):
    """(shard, text) of (windows, text): runs of windows with a shard each, where each occurs one place after the one before, wherever it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shards, texts = [], [], []
            for row, (own, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                words = words_of(text.as_py())
                own.sort(key=lambda w: w["start"])
                first = 0
                for i, w in enumerate(own):
                    after = own[i + 1] if i + 1 < len(own) else None
                    if after and after["start"] == w["start"] + 1 and after["shard"] == w["shard"] and all(w[s] * x % p == after[s] for s, x, p in zip(("s1", "s2"), BASES, PRIMES, strict=True)):
                        continue
                    ids.append(row)
                    shards.append(w["shard"])
                    texts.append(b" ".join(words[own[first]["start"] : w["start"] + window]).decode())
                    first = i + 1
            of = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), *(c.take(of) for c in batch.columns[2:]), pa.array(texts, pa.string())], ["shard", "no", "last", "id", "text"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(no, spans) of rows (shard, salt, kind, no, last, id, text) in order: of each shard first its phrases (kind 0), then the texts. spans are
    [start, end) in letters of the text with single spaces around its words, where phrases of texts with a smaller id stand."""
    where, phrases, automaton = None, {}, None
    for batch in batches:
        nos, found = [], []
        for shard, salt, kind, no, last, number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if where != (shard, salt):
                where, phrases, automaton = (shard, salt), {}, None
            rank = (last, number or 0)
            if kind == 0:
                phrases[f" {text} "] = rank
                continue
            if automaton is None:
                automaton = ahocorasick.Automaton()
                for phrase, owner in phrases.items():
                    automaton.add_word(phrase, (len(phrase), owner))
                automaton.make_automaton()
            if not phrases:
                continue
            body = f" {b' '.join(words_of(text)).decode()} "
            spans = merged([(end - size + 2, end) for end, (size, owner) in automaton.iter(body) if owner < rank])
            if spans:
                nos.append(no)
                found.append(np.array(spans, "<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nos, pa.int64()), pa.array(found, pa.binary())], ["no", "spans"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(no, n_removed, kept_sha) of (no, spans, text)."""
    for batch in batches:
        removed, shas = [], []
        for packed, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            body = f" {b' '.join(words_of(text.as_py())).decode()} "
            kept, gone, at = [], 0, 0
            for a, b in merged([tuple(s) for s in np.frombuffer(b"".join(packed), "<i8").reshape(-1, 2).tolist()]):
                kept += body[at:a].encode().split()
                gone += body.count(" ", a, b) + 1
                at = b
            kept += body[at:].encode().split()
            removed.append(gone)
            shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["no", "n_removed", "kept_sha"])


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256.

    docs needs doc_id and text; other columns are ignored. Words lie between ASCII white space. A word is removed if it lies in some window
    consecutive words that also start in a document with a smaller doc_id; a row without a doc_id is later than all others, rows of the same doc_id are not earlier than
    each other. Windows are judged on the input. Null, empty and short texts lose nothing. An empty table gives no rows.

    Equal texts are one class from the start: it is handled as its row of the smallest doc_id, and its later rows lose all if they have a window.
    Texts of common phrases are dealt to as many copies of a shard as their bytes need.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    texts = scratch.save(slim.mapInArrow(_texts(window), "doc_id long, key binary, n_words long, sha string, grams binary"), "texts")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"))
    classes = texts.where(F.col("n_words") >= window).groupBy("key").agg(F.min(place).alias("one"), F.first("grams").alias("grams"))
    order = ["one", "key"]
    numbered = scratch.save(classes.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("no"), "key", "one.last", "one.id", "grams"), "numbered")
    grams = numbered.select("no", "grams").mapInArrow(_grams, "gram long, no long")
    common = grams.groupBy("gram").agg(F.min("no").alias("a"), F.max("no").alias("b")).where("a < b").select("gram")
    seeds = grams.join(common, "gram").groupBy("no").agg(F.collect_set("gram").alias("grams"))
    seeds = scratch.save(seeds.join(numbered.drop("grams"), "no"), "seeds")
    same = slim.doc_id.eqNullSafe(F.col("id")) & (slim.key == seeds.key)
    live = scratch.save(slim.join(seeds, same).select("no", "last", "id", "grams", F.octet_length("text").alias("size"), "text"), "live")

    windows = scratch.save(live.select("no", "grams", "text").mapInArrow(_windows(window), "w1 long, w2 long, no long, start int, p1 int, p2 int"), "windows")
    counted = windows.groupBy("w1", "w2").agg(F.min(F.struct("no", "start")).alias("one"), F.max("no").alias("b"), F.sum("p1").alias("s1"), F.sum("p2").alias("s2")).where("one.no < b")
    counted = scratch.save(counted.select("w1", "w2", F.col("one.no").alias("owner"), F.col("one.start").alias("first"), (F.col("s1") % PRIMES[0]).alias("s1"), (F.col("s2") % PRIMES[1]).alias("s2")), "counted")
    shards = 1 + counted.count() // SHARD_WINDOWS
    shard = F.pmod(F.xxhash64("owner", F.shiftright("first", PIECE)), F.lit(shards)).alias("shard")
    routes = scratch.save(windows.select("w1", "w2", "no").join(counted.select("w1", "w2", "owner", shard), ["w1", "w2"]).where("no <> owner").select("no", "shard").distinct(), "routes")
    scratch.drop("windows")

    own = counted.groupBy("owner").agg(F.collect_list(F.struct(F.col("first").alias("start"), shard, "s1", "s2")).alias("windows"))
    phrases = own.join(live, own.owner == live.no).select("windows", "text", "no", "last", "id").mapInArrow(_phrases(window), "shard long, no long, last boolean, id long, text string")
    load = routes.join(live.select("no", "size"), "no").groupBy("shard").agg((1 + F.floor(F.sum("size") / TASK_BYTES)).alias("copies"))
    load = maybe_broadcast(scratch.save(load, "load"), shards)

    columns = ["shard", "salt", "kind", "no", "last", "id", "text"]
    dealt = phrases.join(load, "shard").withColumns({"salt": F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)), "kind": F.lit(0)}).select(*columns)
    sent = routes.join(load, "shard").join(live, "no").withColumns({"salt": F.pmod(F.xxhash64("no"), F.col("copies")), "kind": F.lit(1)}).select(*columns)
    stream = dealt.unionByName(sent).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    spans = scratch.save(stream.mapInArrow(_located, "no long, spans binary"), "spans")
    cut = spans.groupBy("no").agg(F.collect_list("spans").alias("spans")).join(live.select("no", "text"), "no").select("no", "spans", "text").mapInArrow(_kept, "no long, n_removed long, kept_sha string").dropDuplicates(["no"])
    decided = numbered.drop("grams").join(cut, "no", "left").select("key", "last", "id", "n_removed", "kept_sha")
    rows = texts.drop("grams").join(decided, "key", "left")
    later = F.coalesce(place > F.struct("last", "id"), F.lit(False))
    whole = F.lit(hashlib.sha256(b"").hexdigest())
    n_removed = F.when(F.col("last").isNull(), 0).when(later, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(F.col("last").isNull(), F.col("sha")).when(later, whole).otherwise(F.coalesce("kept_sha", "sha"))
    return rows.select("doc_id", "n_words", n_removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))


#: The same rows by comparing all windows.
OP13_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT r, doc_id, s, md5(array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS words FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS s FROM d WHERE len(w) >= {WINDOW})),
firsts AS (SELECT words, min(doc_id) AS one FROM win GROUP BY words HAVING count(*) > 1),
hit AS (SELECT r, s FROM win JOIN firsts USING (words) WHERE one < doc_id OR (doc_id IS NULL AND one IS NOT NULL)),
each AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
marked AS (SELECT e.r, word, k, count(h.s) OVER (PARTITION BY e.r ORDER BY k ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) > 0 AS gone FROM each e LEFT JOIN hit h ON h.r = e.r AND h.s = k),
cut AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM marked GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN cut USING (r)
"""
