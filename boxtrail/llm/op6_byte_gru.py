"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of SEGMENT bytes; both directions of the network start afresh in each, as they do in
training. Every byte position gets a distribution over the learned languages, and a document's distribution
is the mean over all its positions. The network is trained with numpy by backpropagation through time on a
bounded sample of labelled rows, then applied to all rows inside Spark tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxtrail.llm.common import bounded_batches, table

SEGMENT = 64  # bytes read from a fresh state
HIDDEN = 12  # units of each direction
TRAIN_DOCS = 400  # labelled rows of each language, about: the bound of the training sample
DOC_SEGMENTS = 12  # segments of a training row, spread evenly over its whole text
EPOCHS = 4
BATCH = 256
WIDE = 1024  # segments scored at once
LETTER = regex.compile(r"\p{L}")
UNDECIDED = "und"
IS_LETTER = np.array([chr(b).isalpha() or b > 127 for b in range(256)])  # bytes; those above 127 are parts of letters mostly


def segments(text: bytes) -> np.ndarray:
    """A text as rows of SEGMENT bytes; the last is filled up with zeros."""
    n = -(-len(text) // SEGMENT)
    return np.frombuffer(text.ljust(n * SEGMENT, b"\0"), np.uint8).reshape(n, SEGMENT)


class Direction:
    """One gated recurrent layer; arrays hold units by segments, so that a step's arithmetic runs over rows."""

    def __init__(self, rng: np.random.Generator | None, hidden: int):
        if rng is not None:
            self.x = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            self.u = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)

    def run(self, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step; steps is (time, segment). keep: gets what the backward pass needs."""
        size = self.u.shape[1]
        h = np.zeros((size, steps.shape[1]), np.float32)
        out = np.empty((len(steps), size, steps.shape[1]), np.float32)
        for t, now in enumerate(steps):
            x, g = np.take(self.x, now, axis=1), self.u @ h
            gates = x[: 2 * size] + g[: 2 * size]
            np.exp(np.negative(gates, gates), gates)
            gates += 1
            np.reciprocal(gates, gates)
            new = gates[size:] * g[2 * size :]
            new += x[2 * size :]
            np.tanh(new, new)
            if keep is not None:
                keep.append((h, gates, new, g[2 * size :]))
            h = new + gates[:size] * (h - new)
            out[t] = h
        return out

    def back(self, steps: np.ndarray, kept: list, above: np.ndarray) -> list[np.ndarray]:
        """Gradients of x and u from those of the states."""
        size = self.u.shape[1]
        dx, du = np.zeros_like(self.x), np.zeros_like(self.u)
        dh, one = np.zeros_like(above[0]), np.eye(256, dtype=np.float32)
        for t in range(len(steps) - 1, -1, -1):
            h, gates, new, gn = kept[t]
            z, r = gates[:size], gates[size:]
            dh = dh + above[t]
            dn = dh * (1 - z) * (1 - new * new)
            dz, dr = dh * (h - new) * z * (1 - z), dn * gn * r * (1 - r)
            into = np.concatenate([dz, dr, dn * r])
            dx += np.concatenate([dz, dr, dn]) @ one[steps[t]]
            du += into @ h.T
            dh = dh * z + self.u.T @ into
        return [dx, du]


class Network:
    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.by_letters = labels, False
        self.ways = [Direction(rng, hidden), Direction(rng, hidden)]
        self.v = rng.normal(0, 0.1, (len(labels), 2 * hidden)).astype(np.float32)
        self.c = np.zeros((len(labels), 1), np.float32)

    def _probabilities(self, states: np.ndarray) -> np.ndarray:
        logits = self.v @ states
        logits += self.c
        logits -= logits.max(axis=-2, keepdims=True)
        np.exp(logits, logits)
        logits /= logits.sum(axis=-2, keepdims=True)
        return logits

    def positions(self, rows: np.ndarray) -> np.ndarray:
        """(time, label, segment) probabilities."""
        steps = np.ascontiguousarray(rows.T)
        ahead, behind = self.ways[0].run(steps), self.ways[1].run(steps[::-1])[::-1]
        return self._probabilities(np.concatenate([ahead, behind], axis=1))

    def train(self, rows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> None:
        """Adam on the mean cross-entropy of all positions."""
        rng, step = np.random.default_rng(11), 0
        params = [self.ways[0].x, self.ways[0].u, self.ways[1].x, self.ways[1].u, self.v, self.c]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                for i, g in enumerate(self._gradients(rows[pick], target[pick])):
                    if i == 0:
                        step += 1
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, rows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        steps, kept = np.ascontiguousarray(rows.T), ([], [])
        ahead, behind = self.ways[0].run(steps, kept[0]), self.ways[1].run(steps[::-1], kept[1])
        states = np.concatenate([ahead, behind[::-1]], axis=1)
        error = self._probabilities(states)
        error[:, target, np.arange(len(target))] -= 1
        error *= (steps != 0)[:, None, :] / max(1, (steps != 0).sum())
        dv = np.einsum("tls,ths->lh", error, states, optimize=True)
        below = self.v.T @ error
        half = below.shape[1] // 2
        return [*self.ways[0].back(steps, kept[0], below[:, :half]), *self.ways[1].back(steps[::-1], kept[1], below[::-1, half:]), dv, error.sum(axis=(0, 2))[:, None]]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(text, label): mean probabilities over all positions, or all letters (by_letters); zeros for a text without one."""
        parts = [segments(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        rows = np.concatenate(parts) if len(owner) else np.empty((0, SEGMENT), np.uint8)
        left = np.array([len(t) for t in texts])
        total, counted = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        starts = np.cumsum([0] + [len(p) for p in parts])[:-1]
        used = np.minimum(SEGMENT, left[owner] - SEGMENT * (np.arange(len(owner)) - starts[owner])) if len(owner) else left
        for at in range(0, len(rows), WIDE):
            part = slice(at, at + WIDE)
            p = self.positions(rows[part])
            mask = np.arange(SEGMENT)[:, None] < used[part][None, :]
            if self.by_letters:
                mask &= IS_LETTER[rows[part].T]
            p *= mask[:, None, :]
            sums = p.sum(axis=0)
            counted += np.bincount(owner[part], mask.sum(axis=0), len(texts))
            for j in range(len(self.labels)):
                total[:, j] += np.bincount(owner[part], sums[j], len(texts))
        return total / np.maximum(counted, 1)[:, None]


def _sample_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, rows, order = [], [], []
        for label, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = text.as_py()
            if not LETTER.search(text):
                continue
            whole = segments(text.encode())
            for i in np.unique(np.linspace(0, len(whole) - 1, DOC_SEGMENTS).astype(int)):
                lang.append(label)
                order.append(key)
                rows.append(whole[i].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(order, pa.int64()), pa.array(rows, pa.binary())], ["lang", "key", "bytes"])


def no_language(rows: np.ndarray, n: int) -> np.ndarray:
    """n segments in no language, in equal shares: the bytes of texts in another order, random printable bytes, words of random letters, hexadecimal digits,
    Base64, and digits with signs. Other scripts are not among them: a language that was not learned is not junk."""
    rng = np.random.default_rng(13)
    share = -(-n // 6)
    drawn = lambda alphabet: np.frombuffer(alphabet, np.uint8)[rng.integers(0, len(alphabet), (share, SEGMENT))]
    letters = b"abcdefghijklmnopqrstuvwxyz"
    kinds = [
        rng.permuted(rows[rng.integers(0, len(rows), share)], axis=1),
        rng.integers(33, 127, (share, SEGMENT), dtype=np.uint8),
        drawn(letters + b" " * 4),
        drawn(b"0123456789abcdef"),
        drawn(letters + letters.upper() + b"0123456789+/"),
        drawn(b"0123456789 .,;:-=+*#/|%$&<>_()[]{}"),
    ]
    return np.concatenate(kinds)[:n]


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS, reject: bool = False) -> Network | None:
    """A network from rows (doc_id, text, lang); None without a labelled row that has a letter. With reject, it also learns UNDECIDED from segments
    in no language, and decides on a text by its letters alone.

    Every label is learned. About train_docs rows of each are taken, those of the smallest hashes of their ids, and DOC_SEGMENTS segments of each: what the
    task holds that trains grows with the number of languages (300 KB each) but not with the rows.
    """
    bounded_batches(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1 << 30, int((1 << 30) * train_docs / n)))])
    picked = labelled.where(key < share[F.col("lang")]).select("lang", key.alias("key"), "text")
    sample = picked.mapInArrow(_sample_segments, "lang string, key long, bytes binary").orderBy("key", "lang", "bytes").limit(2 * train_docs * DOC_SEGMENTS * len(counts))
    fitted = sample.mapInArrow(_fit_sample(reject), "network binary").collect()  # one task: the sample is bounded, and workers keep to one thread
    return pickle.loads(fitted[0]["network"]) if fitted else None


def _fit_sample(reject: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, raw = [], []
        for batch in batches:
            names += batch.column(0).to_pylist()
            raw += batch.column(2).to_pylist()
        if not names:
            return
        labels = sorted(set(names))
        target = np.array([labels.index(x) for x in names])
        rows = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, SEGMENT)
        most = np.bincount(target).max()  # each label as often as the most frequent one
        balanced = np.concatenate([np.resize(np.flatnonzero(target == j), most) for j in range(len(labels))])
        rows, target = rows[balanced], target[balanced]
        if reject and UNDECIDED not in labels:
            rows = np.concatenate([rows, no_language(rows, most)])
            target = np.concatenate([target, np.full(most, len(labels))])
            labels.append(UNDECIDED)
        network = Network(labels)
        network.by_letters = reject  # numbers and addresses in a text don't tell against its language
        network.train(rows, target)
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(network)], pa.binary())], ["network"])

    return run


def label_texts(network: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and score of each text, in slices of bounded size."""
    label, score = [UNDECIDED] * len(texts), [0.0] * len(texts)
    at, held, size = [], [], 0
    for i, text in enumerate(texts):
        if network is not None and text and LETTER.search(text):
            at.append(i)
            held.append(text.encode())
            size += len(held[-1])
        if held and (size > 1_000_000 or i + 1 == len(texts)):
            for k, p in zip(at, network.pooled(held), strict=True):
                label[k], score[k] = network.labels[int(p.argmax())], float(min(1.0, p.max()))
            at, held, size = [], [], 0
    return label, score


def _label(network: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, score = label_texts(network, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def label_column(network: Network | None):
    """A function of a text column that gives a struct (lang_pred, score), to label rows in place."""

    def run(text: pd.Series) -> pd.DataFrame:
        label, score = label_texts(network, [t if isinstance(t, str) else None for t in text])
        return pd.DataFrame({"lang_pred": label, "score": score})

    return F.pandas_udf(run, T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType()))


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (the mean probability of that label over all byte positions).

    docs needs doc_id and text; only the text is an input of the prediction, and other columns are ignored. A null text or one without a letter
    gives `und` and 0; so does every text where nothing could be learned. Repeated rows get the same result; an empty
    table gives no rows. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_label(network), "doc_id long, lang_pred string, score double")


def remainder(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def train_on_documents(docs: DataFrame, reject: bool = False) -> Network | None:
    """Learns from the rows that are not held out."""
    return fit(docs.where(remainder(4) != 2).select("doc_id", "text", "lang"), reject=reject)


def op6_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train_on_documents(docs))
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
