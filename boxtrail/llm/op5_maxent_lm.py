"""Language-model scores from a hashed maximum-entropy model.

A token's probability is that of its class given the tokens before it, times that of the token within its class. The first is a
softmax over CLASSES with hashed features: the endings of the last three tokens (the third and second as skips), the pair of the
last two, and the last token itself. The second is a softmax over the class's words with one feature each, whose maximum-likelihood weights are log counts. Classes
are clusters of word endings that occur in like surroundings. Weights are trained by rounds of gradient steps inside
tasks, averaged between rounds; texts are scored in sparse numpy batches.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm.common import Scratch, WordHashes, bounded_batches, mix, table

CLASSES = 24
ENDINGS = 512  # hashed word endings; the last stands for the end and the start of a text
EDGE = ENDINGS - 1
ROWS = 1 << 14  # hashed features
FEATURES = 6
ROUNDS = 3  # each training text takes part in one
STEP = 8192  # tokens of a gradient step
RATE = 0.5
HOT = 300_000  # at most so many frequent words, whose counts every task has; the others are joined
ADD = 0.1
SLICE = 3_000_000  # characters handled at once


class PackedWords(WordHashes):
    """Word hashes: 55 bits of the word's own, the low 9 its ending."""

    LIMIT = 400_000  # about 80 MB

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = (xxhash.xxh3_64_intdigest(word) & ~(ENDINGS - 1)) | zlib.crc32(word[-2:]) % EDGE
        return value


END = np.uint64(EDGE)


def sequences(texts: list[str | None], hashes: PackedWords) -> tuple[np.ndarray, np.ndarray]:
    """Packed tokens of all texts, each after three edges and before its end, and the text that each belongs to."""
    parts, sizes, edge = [], [], np.full(3, END)
    for text in texts:
        words = hashes.of((text or "").encode().lower().split())
        parts += [edge, words, edge[:1]]
        sizes.append(len(words) + 4)
    return np.concatenate(parts), np.repeat(np.arange(len(texts)), sizes)


def features(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of the weight table for the contexts of the positions at."""
    ends = (tokens & np.uint64(ENDINGS - 1)).astype(np.int64)
    e1, e2, e3 = ends[at - 1], ends[at - 2], ends[at - 3]
    pairs, words = 1 + 3 * ENDINGS, ROWS // 2
    pair = (mix((e1 * ENDINGS + e2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(words - pairs)
    word = (mix(tokens[at - 1]) >> np.uint64(20)) % np.uint64(ROWS - words)
    return np.stack([np.zeros_like(e1), 1 + e1, 1 + ENDINGS + e2, 1 + 2 * ENDINGS + e3, pairs + pair.astype(np.int64), words + word.astype(np.int64)], axis=1).astype(np.uint16)


def targets(tokens: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Positions to be predicted: all but the three edges before each text."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    keep = np.ones(len(tokens), bool)
    keep[(first[:, None] + np.arange(3)).ravel()] = False
    return np.flatnonzero(keep)


def exponents(weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the probabilities of each position's classes are in proportion to, and their sums. Row 0 of the weights is a feature of every position."""
    logits = weights.take(rows[:, 1], axis=0)
    for i in range(2, rows.shape[1]):
        logits += weights.take(rows[:, i], axis=0)
    logits += weights[0]
    if len(logits) and not (logits.max() < 60 and logits.min() > -60):  # exp is in reach of single precision otherwise
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, logits)
    return logits, logits @ np.ones(logits.shape[1], logits.dtype)


def probabilities(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    parts, sums = exponents(weights, rows)
    parts /= sums[:, None]
    return parts


def gradient_steps(weights: np.ndarray, scale: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """Adagrad steps on the log-likelihood, in place. scale: sums of squares of each row so far."""
    for at in range(0, len(rows), STEP):
        r, y = rows[at : at + STEP], target[at : at + STEP]
        error = probabilities(weights, r)
        error[np.arange(len(y)), y] -= 1
        flat = r[:, 1:].T.ravel().astype(np.intp)
        touched = np.flatnonzero(np.bincount(flat, minlength=ROWS))
        of_class = np.tile(error.T.astype(np.float64), r.shape[1] - 1)
        sums = np.stack([np.bincount(flat, e, ROWS)[touched] for e in of_class], axis=1)
        touched, sums = np.concatenate([[0], touched]), np.concatenate([error.sum(0, dtype=np.float64)[None], sums])
        scale[touched] += (sums * sums).mean(axis=1)
        weights[touched] -= RATE * sums / np.sqrt(scale[touched] + 1e-6)[:, None]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        start, texts, held = 0, [], 0
        for i, text in enumerate(batch.column(column)):
            texts.append(text.as_py())
            held += len(texts[-1] or "")
            if held > SLICE or i + 1 == batch.num_rows:
                yield batch.slice(start, len(texts)), texts
                start, texts, held = i + 1, [], 0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of the task's texts, and the counts of pairs of endings as tokens below zero."""
    hashes, count, pairs = PackedWords(), Counter(), np.zeros(ENDINGS * ENDINGS, np.int64)
    names = ["token", "pair", "n"]

    def emit(token, pair, n):
        size = len(n)
        return pa.RecordBatch.from_arrays([pa.array(token, pa.int64()) if token is not None else pa.nulls(size, pa.int64()), pa.array(pair, pa.int32()) if pair is not None else pa.nulls(size, pa.int32()), pa.array(n, pa.int64())], names)

    def flush():
        tokens = np.fromiter(count.keys(), np.uint64, len(count)).view(np.int64)
        yield emit(tokens, None, np.fromiter(count.values(), np.int64, len(count)))
        count.clear()

    for _, texts in _slices(batches, 0):
        tokens, owner = sequences(texts, hashes)
        at = targets(tokens, owner)
        ends = (tokens & np.uint64(ENDINGS - 1)).astype(np.int64)
        pairs += np.bincount(ends[at - 1] * ENDINGS + ends[at], minlength=ENDINGS * ENDINGS)
        value, n = np.unique(tokens[at], return_counts=True)
        count.update(dict(zip(value.tolist(), n.tolist(), strict=True)))
        if len(count) > 300_000:
            yield from flush()
    yield from flush()
    some = np.flatnonzero(pairs)
    yield emit(None, some.astype(np.int32), pairs[some])


def cluster(pairs: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each ending, from how often endings follow each other; class 0 is the end of a text alone."""
    total, left, right = max(pairs.sum(), 1), pairs.sum(1), pairs.sum(0)
    joint = np.log((pairs + 0.5) * total / (left[:, None] + 0.5 * len(pairs) + 1) / (right[None, :] + 0.5 * len(pairs) + 1))
    u, s, _ = np.linalg.svd(np.maximum(joint, 0), full_matrices=False)
    places = u[:, :6] * np.sqrt(s[:6])
    weight = np.sqrt(left + 1.0)
    words = np.arange(len(pairs)) != EDGE
    centre = places[words][np.argsort(-weight[words], kind="stable")[: classes - 1]]
    for _ in range(30):
        near = ((places[:, None] - centre[None]) ** 2).sum(-1).argmin(1)
        for k in range(len(centre)):
            own = words & (near == k)
            if own.any():
                centre[k] = np.average(places[own], axis=0, weights=weight[own])
    near = near + 1
    near[EDGE] = 0
    return near.astype(np.int64)


def _train(weights: np.ndarray, class_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own, scale, seen = PackedWords(), weights.copy(), np.zeros(ROWS, np.float32), 0
        for _, texts in _slices(batches, 0):
            tokens, owner = sequences(texts, hashes)
            at = targets(tokens, owner)
            ends = (tokens[at] & np.uint64(ENDINGS - 1)).astype(np.int64)
            gradient_steps(own, scale, features(tokens, at), class_of[ends])
            seen += len(at)
        moved = np.flatnonzero(scale)
        change = (own[moved] - weights[moved]) * seen
        yield pa.RecordBatch.from_arrays([pa.array(moved.astype(np.int32)), pa.array(np.full(len(moved), seen, np.int64)), *(pa.array(change[:, j]) for j in range(CLASSES))], ["row", "seen", *(f"w{j}" for j in range(CLASSES))])

    return run


class Model:
    """Class weights, the classes of endings, and what normalises the words of each class."""

    def __init__(self, weights, class_of, log_size, hot_tokens, hot_counts):
        self.weights, self.class_of, self.log_size = weights, class_of, log_size
        self.hot_tokens, self.hot_counts = hot_tokens, hot_counts


def _score(model: Model):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "log_context", "rare"]
    log_hot = np.log10(model.hot_counts + ADD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = PackedWords()
        for part, texts in _slices(batches, 2):
            tokens, owner = sequences(texts, hashes)
            at = targets(tokens, owner)
            cls = model.class_of[(tokens[at] & np.uint64(ENDINGS - 1)).astype(np.int64)]
            rows, context = features(tokens, at), np.empty(len(at))
            for i in range(0, len(at), STEP):
                parts, sums = exponents(model.weights, rows[i : i + STEP])
                context[i : i + STEP] = np.log10(np.maximum(parts[np.arange(len(parts)), cls[i : i + STEP]] / sums, 1e-30))
            context -= model.log_size[cls]
            n, text, token = len(texts), owner[at], tokens[at].view(np.int64)
            spot = np.minimum(np.searchsorted(model.hot_tokens, token), max(len(model.hot_tokens) - 1, 0))
            hot = model.hot_tokens[spot] == token if len(model.hot_tokens) else np.zeros(len(token), bool)
            known = np.bincount(text[hot], minlength=n)
            counts = np.bincount(text[hot], log_hot[spot[hot]], n) if hot.any() else np.zeros(n)
            # the other words go to the join, text by text
            cuts = pa.array(np.searchsorted(text[~hot], np.arange(n + 1)).astype(np.int32))
            rare = pa.ListArray.from_arrays(cuts, pa.array(token[~hot]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.bincount(text, minlength=n)), pa.array(known), pa.array(counts), pa.array(np.bincount(text, context, n)), rare],
                names,
            )

    return run


def fit(training: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame, float, int, int]:
    """(model, counts of all tokens, N, V, tokens of the training texts) from a table with text."""
    spark = training.sparkSession
    texts = training.select("text")
    gathered = scratch.save(texts.mapInArrow(_counts, "token long, pair int, n long").groupBy("token", "pair").agg(F.sum("n").alias("n")), "gathered")
    counts = gathered.where("token is not null").select("token", F.col("n").alias("c"))
    pairs = np.zeros((ENDINGS, ENDINGS))
    for row in gathered.where("pair is not null").select("pair", "n").collect():  # ENDINGS * ENDINGS rows at most
        pairs[divmod(row["pair"], ENDINGS)] = row["n"]
    class_of = cluster(pairs)
    by_ending = counts.groupBy(F.col("token").bitwiseAND(F.lit(ENDINGS - 1)).alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    total, kinds = sum(r["c"] for r in by_ending), sum(r["v"] for r in by_ending)
    size = np.zeros(CLASSES)
    for r in by_ending:
        size[class_of[r["e"]]] += r["c"] + ADD * r["v"]
    size[1:] += ADD  # the unseen words of a class; the end is never unseen
    size = np.maximum(size, ADD)
    # The least count of which at most HOT words have as much, from a histogram of a few hundred bins: sorting all counts
    # would send HOT rows of each partition to the driver.
    bins, words, least = counts.groupBy(F.floor(8 * F.log2("c")).alias("bin")).agg(F.min("c").alias("c"), F.count("*").alias("n")).orderBy(F.desc("bin")).collect(), 0, None
    for r in bins:
        words += r["n"]
        if words <= HOT:
            least = r["c"]
    hot = sorted((r["token"], r["c"]) for r in counts.where(F.col("c") >= least).collect()) if least else []
    weights = np.zeros((ROWS, CLASSES), np.float32)
    shard = F.pmod(F.xxhash64("text"), F.lit(ROUNDS))
    wide = ", ".join(f"w{j} float" for j in range(CLASSES))
    for r in range(ROUNDS):
        steps = texts.where(F.coalesce(shard, F.lit(0)) == r).mapInArrow(_train(weights, class_of), f"row int, seen long, {wide}")
        steps = scratch.save(steps, f"steps{r}")
        seen = steps.where("row = 0").agg(F.sum("seen")).first()[0]
        if seen:
            mean = steps.groupBy("row").agg(*[(F.sum(f"w{j}") / seen).cast("float").alias(f"w{j}") for j in range(CLASSES)]).toArrow()
            weights[mean["row"].to_numpy()] += np.stack([mean[f"w{j}"].to_numpy() for j in range(CLASSES)], axis=1)
        scratch.drop(f"steps{r}")
    model = Model(weights, class_of, np.log10(size), np.array([t for t, _ in hot], np.int64), np.array([c for _, c in hot], np.float64))
    return model, counts, total, kinds


def score_texts(docs: DataFrame, train_on: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs needs doc_id, held_out and text, train_on text; other columns are ignored. Tokens are the words between ASCII white space, A-Z as a-z, and one end
    per text. base_score is the log10 probability of the text by single tokens with ADD added to each count, score that of the model, which
    sums to one over the known tokens and an unseen one per class. A null or empty text is an end alone. Repeated rows are scored alike and, in train_on, count as often as they occur; an
    empty train_on makes all tokens unseen; an empty table gives no rows. Token identity is 55 bits of a hash, beside the ending.

    What tasks get is of fixed size: weights and HOT counts. Counts of all other words are joined by a shuffle.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    model, counts, total, kinds = fit(train_on, scratch)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, log_context double, rare array<long>"
    scored = scratch.save(slim.mapInArrow(_score(model), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode("rare").alias("token"))
    found = rare.join(counts, "token", "left").select("row", F.coalesce("c", F.lit(0)).alias("c"))
    sums = found.groupBy("row").agg(F.sum(F.log10(F.col("c") + F.lit(ADD))).alias("more"), F.count_if(F.col("c") > 0).alias("known"))
    out = scored.drop("rare").join(sums, "row", "left")
    counted = F.col("log_counts") + F.coalesce("more", F.lit(0.0))
    base = counted - F.col("n_tokens") * float(np.log10(total + ADD * (kinds + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), (counted + F.col("log_context")).alias("score"))


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False))
    docs = docs.select("doc_id", held_out.alias("held_out"), "text")
    return score_texts(docs, docs.where("not held_out"))
