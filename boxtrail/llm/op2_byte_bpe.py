"""Byte-level BPE encoding and decoding with DuckDB's recursive queries inside each task.

A task splits its texts by the tokenizer's pattern and keeps every distinct match once. A recursive
query holds one row per token position of those words, joins adjacent positions to the merge table and contracts the
leftmost pair of least rank of each word until no pair is left. Texts are put together
from the ids of their words; decoding joins ids to the vocabulary and aggregates the bytes in order.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm.common import bounded_batches, table

CACHED = 500_000  # distinct words whose ids a task keeps, about 100 MB
SLICE = 2_000_000  # characters of text encoded at once
LONG = 64  # bytes from which a word is contracted by sweeps of its own, so that it doesn't hold up the others

ENCODE = """
WITH RECURSIVE step(word, depth, pos, id) AS (
  SELECT word, 0::SMALLINT, pos, id FROM bytes
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT p.*, m.merged FROM (
       SELECT *, CASE WHEN lead(word) OVER w = word THEN lead(id) OVER w END AS next, lag(pos) OVER w AS before
       FROM step WINDOW w AS (ORDER BY pos)) p
     LEFT JOIN merges m ON m.l = p.id AND m.r = p.next),
   best AS (
     SELECT word, min(merged::BIGINT * 4294967296 + pos) % 4294967296 AS spot
     FROM pairs WHERE merged IS NOT NULL GROUP BY word)
   SELECT word, (depth + 1)::SMALLINT, pos, CASE WHEN pos = spot THEN merged ELSE id END
   FROM pairs JOIN best USING (word) WHERE before IS DISTINCT FROM spot)
)
SELECT word, list(id ORDER BY pos) AS ids
FROM step JOIN (SELECT word, max(depth) AS depth FROM step GROUP BY word) USING (word, depth)
GROUP BY word ORDER BY word
"""
#: One step for a long word contracts pairs of the least rank at once, from the left and without overlap. That equals single
#: steps until a merged token forms a pair of lower rank with what stands before it then, or after: the step ends with the first such one. Only
#: tokens of which the merge table has a pair of lower rank (Codec.early) need that test.
PAIRS = """
CREATE OR REPLACE TABLE pairs AS SELECT p.*, m.merged FROM (
  SELECT pos, id, lead(id) OVER w AS next, row_number() OVER w AS n FROM bytes WINDOW w AS (ORDER BY pos)) p
LEFT JOIN merges m ON m.l = p.id AND m.r = p.next
"""
SWEEP = """
CREATE OR REPLACE TABLE bytes AS
WITH hits AS (SELECT n, n - row_number() OVER (ORDER BY n) AS run FROM pairs WHERE merged = {best}),
taken AS (SELECT n FROM (SELECT n, row_number() OVER (PARTITION BY run ORDER BY n) AS k FROM hits) WHERE k % 2 = 1),
until AS ({until}),
now AS (SELECT n FROM taken, until WHERE n <= last)
SELECT pos, CASE WHEN t.n IS NOT NULL THEN merged ELSE id END AS id
FROM pairs p LEFT JOIN now t ON t.n = p.n ANTI JOIN now u ON u.n + 1 = p.n
"""
ALL = "SELECT max(n) AS last FROM taken"
FIRST_LOWER = """
SELECT coalesce(min(t.n) FILTER (x.merged < {best} OR y.merged < {best}), max(t.n)) AS last
FROM taken t LEFT JOIN pairs p ON p.n = t.n - 1 LEFT JOIN taken u ON u.n = t.n - 2 LEFT JOIN pairs q ON q.n = t.n + 2
LEFT JOIN merges x ON x.l = CASE WHEN u.n IS NULL THEN p.id ELSE {best} END AND x.r = {best}
LEFT JOIN merges y ON y.l = {best} AND y.r = q.id
"""
DECODE = "SELECT i.doc, string_agg(v.hex, '' ORDER BY i.pos) AS hex FROM ids i JOIN vocabulary v ON v.id = i.id GROUP BY i.doc"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """One DuckDB connection with the merge table and the vocabulary; lives as long as a task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        # what doesn't fit goes to the executor's own folder, which Spark deletes; outside of a task there is none
        spill = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": spill and f"{spill}/words-{uuid.uuid4().hex}"})
        tokens = list(ranks)
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.early = {x for l, r, m in merges for x in (l, r) if m < x}  # tokens of which some pair has a lower rank than they
        left, right, merged = (pa.array(x, pa.int32()) for x in zip(*merges, strict=True)) if merges else (pa.array([], pa.int32()),) * 3
        self._put("merges", pa.table({"l": left, "r": right, "merged": merged}))
        self._put("vocabulary", pa.table({"id": pa.array([ranks[t] for t in tokens], pa.int32()), "hex": [t.hex() for t in tokens]}))

    def _put(self, name: str, data: pa.Table) -> None:
        self.con.register("incoming", data)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _load(self, words: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        self._put("bytes", pa.table({"word": word, "pos": np.arange(len(flat), dtype=np.int32), "id": self.byte_ids[flat]}))

    def _words(self, words: list[bytes]) -> list[bytes]:
        self._load(words)
        ids = self.con.sql(ENCODE).to_arrow_table()["ids"].combine_chunks()
        flat, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), (4 * (ids.offsets.to_numpy() - ids.offsets[0].as_py())).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _long(self, word: bytes) -> bytes:
        self._load([word])
        while True:
            self.con.execute(PAIRS)
            best = self.con.execute("SELECT min(merged) FROM pairs").fetchall()[0][0]
            if best is None:
                return self.con.sql("SELECT id FROM pairs ORDER BY n").to_arrow_table()["id"].to_numpy().astype("<u4").tobytes()
            self.con.execute(SWEEP.format(best=best, until=FIRST_LOWER.format(best=best) if best in self.early else ALL))

    def learn(self, words: set[str]) -> None:
        """Ids of words not seen before, as little-endian bytes."""
        new = sorted(words.difference(self.cache))
        if len(self.cache) + len(new) > CACHED:
            self.cache.clear()
            new = sorted(words)
        short = [w for w in new if len(w.encode()) < LONG]
        for part in (short[i : i + 10_000] for i in range(0, len(short), 10_000)):
            self.cache.update(zip(part, self._words([w.encode() for w in part]), strict=True))
        for word in new:
            if word not in self.cache:
                self.cache[word] = self._long(word.encode())

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.pattern.findall(t) for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.cache.__getitem__, words)) for words in split]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
        sizes = np.array([len(e) // 4 for e in encoded], np.int64)
        self._put("ids", pa.table({"doc": np.repeat(np.arange(len(encoded), dtype=np.int32), sizes), "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
        out = [b""] * len(encoded)
        found = self.con.sql(DECODE).to_arrow_table()
        for doc, text in zip(found["doc"].to_pylist(), found["hex"].to_pylist(), strict=True):
            out[doc] = bytes.fromhex(text)
        return out


def _code(ranks: dict[bytes, int], pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)

        def emit(ids, texts):
            encoded = codec.encode(texts)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(encoded, pa.binary()), pa.array(codec.decode(encoded), pa.binary())], ["doc_id", "ids", "decoded"])

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > SLICE:
                    yield emit(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield emit(ids, texts)

    return run


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """One row per row of docs: doc_id, ids (little-endian unsigned 32-bit integers), decoded (the bytes of the ids).

    docs needs doc_id and text; other columns are ignored. Every whole text is encoded, each match of the
    pattern by itself, without special tokens. A null text counts as empty and gives no ids; repeated rows and ids give
    a row each; an empty table gives no rows. The vocabulary is read on the driver (its size is fixed) and
    sent with the task; a task holds one slice of texts, a bounded word cache and a DuckDB connection of limited memory.
    No rows are shuffled.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(_code(load_ranks(ranks_path), pattern), "doc_id long, ids binary, decoded binary")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
