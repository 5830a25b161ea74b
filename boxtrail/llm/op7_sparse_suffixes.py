"""Repeated passages by sparse suffix arrays.

Only suffixes at minimiser positions are kept: the least hash of each window of word k-grams, which the content alone
selects, so that any two copies of a passage of MIN_WORDS words keep a suffix at the same place. The suffixes of
all texts are sorted by their words, in blocks of k; one that starts with the same k words as a neighbour is a seed. Seeds are extended left and right to all
windows of MIN_WORDS words of which they are the minimiser. A suffix array knows for a suffix which other has most words to its right in common,
but the one that also has those to its left may lie anywhere among the rows with the same start; so the extended
windows are compared by their hashes of 128 bits, and those that occur more than once make up the repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm.common import Scratch, WordHashes, bounded_batches, gram_hashes, table

MIN_WORDS = 50  # shortest repeated passage
GRAM = 16  # words that a seed shares with its neighbour
BLOCKS = 3  # blocks of GRAM words by which suffixes are sorted
POSITION = np.uint64((1 << 30) - 1)  # low bits of a packed k-gram: its position from the end; a text of 2 GB has no more words


class SecondHashes(WordHashes):
    """Hashes that don't depend on the first ones, so that two of a window make 128 bits."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, 1)
        return value


def text_key(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode())


def word_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of((text or "").encode().lower().split())


def minimisers(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of min_words words the position of its least k-gram (the rightmost of equals), and the k-gram hashes."""
    k = min(GRAM, min_words)
    grams = gram_hashes(words, k)
    width = min_words - k + 1
    if len(grams) < width:
        return np.empty(0, np.int64), grams
    packed = (grams & ~POSITION) | np.arange(len(grams) - 1, -1, -1, dtype=np.uint64)
    least = packed.copy()  # sliding minimum by doubling
    span = 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    return len(grams) - 1 - (least & POSITION).astype(np.int64), grams


def _suffixes(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, sizes, heads = [], [], []
            for text in batch.column(2):
                text = text.as_py()
                words = word_hashes(text, hashes)
                at, grams = minimisers(words, min_words)
                at = np.unique(at)
                rows = [grams[np.minimum(at + b * GRAM, len(grams) - 1)] if len(at) else at.astype(np.uint64) for b in range(BLOCKS)]
                keys.append(text_key(text))
                sizes.append(len(words))
                heads.append(np.stack([at.astype(np.uint64), *rows], axis=1).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(heads, pa.binary())], ["doc_id", "text_hash", "text_key", "n_words", "suffixes"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*(f"b{i}" for i in range(BLOCKS)), "text_key", "pos"]
    for batch in batches:
        keys, packed = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = np.frombuffer(b"".join(packed), "<u8").reshape(-1, 1 + BLOCKS)
        owner = np.repeat(np.arange(len(keys)), [len(p) // (8 + 8 * BLOCKS) for p in packed])
        owners = pa.array(keys, pa.binary()).take(pa.array(owner))
        yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, 1 + i].astype(np.int64)) for i in range(BLOCKS)), owners, pa.array(rows[:, 0].astype(np.int32))], names)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes those that share their first block with a neighbour; also the first and last rows of a run, whose
    neighbours another task has."""
    held = None  # the last row, its equality with the row before not yet decided upon

    def emit(key, pos):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(pos, pa.int32())], ["text_key", "pos"])

    before = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        head, key, pos = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2)
        same = head[1:] == head[:-1]
        up = np.concatenate([[before is None or head[0] == before], same])
        down = np.concatenate([same, [False]])
        if held is not None and (held[0] == head[0]):
            yield emit([held[1]], [held[2]])
        keep = up | down
        chosen = pa.array(np.flatnonzero(keep))
        yield emit(key.take(chosen).to_pylist(), pos.take(chosen).to_pylist())
        before = head[-1]
        held = None if keep[-1] else (head[-1], key[-1].as_py(), pos[-1].as_py())
    if held is not None:
        yield emit([held[1]], [held[2]])


def _windows(min_words: int):
    """Hashes of the windows whose own minimiser is a seed: two of 64 bits, from different hashes of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, others = WordHashes(), SecondHashes()
        names = ["window", "second", "doc_id", "text_key", "start"]
        for batch in batches:
            for doc_id, key, seeds, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                text = text.as_py()
                if text_key(text) != key:
                    continue  # another text of the same id and hash
                words = word_hashes(text, hashes)
                at, _ = minimisers(words, min_words)
                start = np.flatnonzero(np.isin(at, np.array(seeds.as_py())))
                n = len(start)
                if n:
                    both = [pa.array(gram_hashes(w, min_words)[start].view(np.int64)) for w in (words, word_hashes(text, others))]
                    yield pa.RecordBatch.from_arrays([*both, pa.array([doc_id] * n, pa.int64()), pa.array([key] * n, pa.binary()), pa.array(start.astype(np.int32))], names)

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted windows those that occur more than once; again where it isn't the first place of the window. The first row of the last window is carried over."""
    tail, told = None, False
    for batch in batches:
        if batch.num_rows == 0:
            continue
        batch = batch if tail is None else pa.concat_batches([tail, batch])
        one, two = (batch.column(i).to_numpy() for i in (0, 1))
        opens = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        at, run = np.flatnonzero(opens), np.cumsum(opens) - 1
        sizes = np.diff([*at, len(one)])
        chosen = np.flatnonzero(sizes[run] > 1)
        chosen = chosen[chosen > 0] if told else chosen
        here, first = pa.array(chosen), pa.array(at[run[chosen]])
        pairs = [(batch.column(i).take(here), batch.column(i).take(first)) for i in (2, 3)]
        again = pc.or_(*(pc.not_equal(x, y) for x, y in pairs))
        yield pa.RecordBatch.from_arrays([pairs[0][0], pairs[1][0], again], ["text_key", "start", "again"])
        tail, told = batch.slice(int(at[-1]), 1), bool(sizes[-1] > 1)


def _spans(starts, min_words: int):
    """Merged [start, end) spans of sorted windows, as an array of structs. A span opens and closes where the next window is no neighbour, so that long arrays cost
    no more for each window than short ones."""
    opens = F.filter(starts, lambda s, i: (i == 0) | (s - F.get(starts, i - 1) > min_words))
    closes = F.filter(starts, lambda s, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) - s > min_words))
    return F.zip_with(opens, closes, lambda a, z: F.struct(a.cast("int").alias("start"), (z + min_words).cast("int").alias("end")))


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(texts, marks). texts: doc_id, text_key, n_words for each row of docs. marks: text_key, spans and later, one row for
    each text with a repeated passage. spans are its repeated passages, later those parts that occur before,
    in a text of a smaller doc_id (texts without an id come last, of those with the same the one of the smaller key first) or further up in the same; both [start, end) in words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = scratch.save(slim.mapInArrow(_suffixes(min_words), "doc_id long, text_hash long, text_key binary, n_words int, suffixes binary"), "texts")
    classes = texts.groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("one"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("suffixes").alias("suffixes")).where(F.col("n_words") >= min_words)
    classes = scratch.save(classes, "classes")
    heads = [f"b{i}" for i in range(BLOCKS)]
    order = [*heads, "text_key", "pos"]
    rows = scratch.save(classes.select("text_key", "suffixes").mapInArrow(_unpacked, f"{', '.join(f'{h} long' for h in heads)}, text_key binary, pos int"), "rows")
    ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("b0", "text_key", "pos")
    seeds = ranked.mapInArrow(_seeds, "text_key binary, pos int").groupBy("text_key").agg(F.collect_set("pos").alias("seeds"))
    seeds = scratch.save(seeds.join(classes.select("text_key", "one"), "text_key").select(F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash"), "text_key", "seeds"), "seeds")
    scratch.drop("rows")

    # a text is fetched by its least id and hash; equal rows of one id give their windows each, but such copies are repeated whole anyway
    found = slim.join(seeds, slim.doc_id.eqNullSafe(F.col("one_id")) & (F.col("text_hash") == F.col("one_hash"))).select("doc_id", "text_key", "seeds", "text").mapInArrow(_windows(min_words), "window long, second long, doc_id long, text_key binary, start int")
    # one shuffle of the windows: sorted, a window's rows are neighbours, the first of them at its head
    order = ["window", "second", F.col("doc_id").isNull(), "doc_id", "text_key", "start"]
    sorted_windows = found.repartition("window", "second").sortWithinPartitions(*order).select("window", "second", "text_key", "start")
    repeated = sorted_windows.mapInArrow(_repeats, "text_key binary, start int, again boolean")
    marked = repeated.groupBy("text_key").agg(F.sort_array(F.collect_set("start")).alias("starts"), F.sort_array(F.collect_set(F.when(F.col("again"), F.col("start")))).alias("again"))
    both = classes.where("copies > 1").select("text_key", "n_words").join(marked, "text_key", "full")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))
    marks = both.select("text_key", F.when(F.col("n_words").isNotNull(), whole).otherwise(_spans(F.col("starts"), min_words)).alias("spans"), F.coalesce(_spans(F.col("again"), min_words), F.array().cast("array<struct<start:int,end:int>>")).alias("later"))
    marks = scratch.save(marks, "marks")
    scratch.drop("seeds", "classes")
    return texts.select("doc_id", "text_key", "n_words"), marks


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage of each row of docs: doc_id, n_words, start_word, end_word.

    docs needs doc_id and text; other columns are ignored. Words are separated by ASCII white space and A-Z count
    as a-z. A passage is a longest run of words each of which lies in some min_words consecutive words that occur more than once in all
    texts together, in another row or at another place of the same. Texts of fewer words, empty and null
    ones have none. Repeated rows are copies of each other and get a row each; an empty table gives no rows.

    Copies are one class from the start. Sorting is by range over the suffix's words, then text and position, so that no
    common passage lands in one task; a window's rows meet in one task, which sorts them and looks at neighbours only.
    """
    texts, marks = repeated_windows(docs, min_words)
    return texts.join(marks.select("text_key", "spans"), "text_key").select("doc_id", "n_words", F.explode("spans").alias("s")).select("doc_id", "n_words", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"))


def op7_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


#: The same rows by counting all windows of 50 words.
OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, s, md5(array_to_string(w[s:s + 49], ' ')) AS words FROM (SELECT r, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
again AS (SELECT r, s FROM win WHERE words IN (SELECT words FROM win GROUP BY words HAVING count(*) > 1)),
cut AS (SELECT r, s, coalesce(s - lag(s) OVER (PARTITION BY r ORDER BY s) > 50, true)::INTEGER AS opens FROM again),
runs AS (SELECT r, s, sum(opens) OVER (PARTITION BY r ORDER BY s) AS run FROM cut)
SELECT doc_id, len(w)::INTEGER AS n_words, (min(s) - 1)::INTEGER AS start_word, (max(s) + 49)::INTEGER AS end_word FROM runs JOIN d USING (r) GROUP BY r, run, doc_id, len(w)
"""
