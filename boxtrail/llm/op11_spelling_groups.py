"""Spelling variants by groups of words that agree but for one place.

A word belongs to one group for each of its places: that of all words with the same letters before and after it. Any two
words of a group differ by one replaced letter, and two such words share one group, so a word's neighbours are counted by the sizes of
its groups, and the best of them is the first of a group's two best words, or the second where the first is the word itself.
What is left of a word without one letter is looked up among the words, for inserted and deleted letters. No pair of words is
made within a group, and a group has no more words than there are letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm.common import LOWER, UPPER, Scratch, bounded_batches, table

RUN = re.compile("[a-zÀ-ÿ]+")  # of texts with A-Z as a-z
LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5  # a form occurs at least so many times as often
DAMAGE = 199  # a run whose checksum this divides has lost a letter
HELD = 200_000  # words that a task counts before it passes them on
PRIME, BASE = (1 << 127) - 1, 0x5DEECE66D1234567890ABCDEF1234567


def _counted(least_letters: int, damage: int | None):
    """(word, n) counted by task, with the stated damage done to runs."""

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(RUN.findall((text.as_py() or "").encode().lower().decode())).items():
                    if len(word) < least_letters:
                        continue  # a letter less would not make it longer
                    if damage and (h := zlib.crc32(word.encode(), begun)) % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_letters:
                            continue
                    counts[word] += n
                if len(counts) >= HELD:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    return run


def polynomial(word: str) -> int:
    value = 0
    for c in word:
        value = (value * BASE + ord(c)) % PRIME
    return value


def places(word: str) -> tuple[list[int], list[int]]:
    """Numbers of 127 bits: for each place that of the word with a blank there, and that of each different word which one letter less leaves.

    A word's number is its letters as digits in base BASE modulo a prime; blanks and gaps follow from those of the parts before and after.
    """
    n = len(word)
    before = [0]
    for c in word:
        before.append((before[-1] * BASE + ord(c)) % PRIME)
    blanks, gaps, after, power = [], [], 0, 1
    for i in range(n - 1, -1, -1):  # after and power are those of word[i + 1:]
        blanks.append((before[i] * BASE % PRIME * power + after) % PRIME)
        if i == 0 or word[i] != word[i - 1]:  # of equal letters in a row only the first
            gaps.append((before[i] * power + after) % PRIME)
        after = (ord(word[i]) * power + after) % PRIME
        power = power * BASE % PRIME
    return blanks[::-1], gaps[::-1]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, no): b for a word with a blank, g with a letter less, w for the word itself. Length and place go with a blank's number."""
    for batch in batches:
        kinds, keys, nos = [], [], []
        for no, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = len(word)
            blanks, gaps = places(word)
            keys += [b.to_bytes(16, "little") + n.to_bytes(5, "little") + i.to_bytes(5, "little") for i, b in enumerate(blanks)]
            keys += [g.to_bytes(16, "little") + (n - 1).to_bytes(5, "little") for g in gaps]
            keys.append(polynomial(word).to_bytes(16, "little") + n.to_bytes(5, "little"))
            kinds += ["b"] * n + ["g"] * len(gaps) + ["w"]
            nos += [no] * (n + len(gaps) + 1)
            if len(keys) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys, pa.binary()), pa.array(nos, pa.int64())], ["kind", "key", "no"])
                kinds, keys, nos = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.binary()), pa.array(nos, pa.int64())], ["kind", "key", "no"])


def words_of(docs: DataFrame, scratch: Scratch, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """(no, word, n): the words of docs and their counts; numbers rise with falling counts, and among equals in code-point order."""
    bounded_batches(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(least_letters, damage), "word string, n long")
    words = scratch.save(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "words")
    order = [F.desc("n"), "word"]
    return scratch.save(words.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("no"), "word", "n"), "numbered")


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(no, n_near, best): for each word with a near one how many there are, and the least number of them."""
    keys = scratch.save(words.select("no", "word").mapInArrow(_keys, "kind string, key binary, no long"), "keys")
    # the words of a group differ in one letter only, so that a group has as many as the alphabet at most
    groups = keys.where("kind = 'b'").groupBy("key").agg(F.sort_array(F.collect_list("no")).alias("all")).where(F.size("all") > 1)
    top, second = F.col("all")[0], F.col("all")[1]
    replaced = groups.select((F.size("all") - 1).cast("long").alias("near"), top.alias("top"), second.alias("second"), F.explode("all").alias("no")).select("no", "near", F.when(F.col("no") == F.col("top"), F.col("second")).otherwise(F.col("top")).alias("best"))
    shorter = keys.where("kind = 'w'").select("key", F.col("no").alias("short"))
    met = keys.where("kind = 'g'").join(shorter, "key")
    one = F.lit(1).cast("long")
    indels = met.select(F.inline(F.array(F.struct(F.col("no").alias("no"), one.alias("near"), F.col("short").alias("best")), F.struct(F.col("short").alias("no"), one.alias("near"), F.col("no").alias("best")))))
    return replaced.unionByName(indels).groupBy("no").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots_of(links: DataFrame, most: int, scratch: Scratch, ratio: int = RATIO) -> DataFrame:
    """(no, root) for links (no, form_no). Each form occurs ratio times as often as its word, so that the count of the commonest word bounds
    the length of a chain, and each round doubles the steps gone."""
    steps, reach = 1, max(most, 1)
    while reach >= ratio:
        steps, reach = steps + 1, reach // ratio
    roots, gone = scratch.save(links.select("no", F.col("form_no").alias("root")), "roots"), 1
    while gone < steps:
        further = roots.select(F.col("no").alias("root"), F.col("root").alias("beyond"))
        roots = scratch.save(roots.join(further, "root", "left").select("no", F.coalesce("beyond", "root").alias("root")), "roots")
        gone *= 2
    return roots


def spelling_forms(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    docs needs doc_id and text; other columns are ignored. Words are runs of letters (A-Z as a-z, and those of Latin-1 as they are) of at
    least least_letters code points that occur least_count times in all texts. With damage, a run whose checksum with its doc_id (nothing, where
    that is null) it divides loses a letter first. form is the commonest near word, if it occurs RATIO times as often, else null; root
    is the last of the chain of forms. Null and empty texts have no words, equal rows count each, an empty table gives no rows. A run
    may be as long as a text: its keys have a fixed size. Keys are numbers of 127 bits; equal numbers count as equal words.
    """
    scratch = Scratch(docs.sparkSession)
    words = words_of(docs, scratch, least_letters, least_count, damage)
    near = scratch.save(near_words(words, scratch), "near")
    other = words.select(F.col("no").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    fits = F.col("best_n") >= RATIO * F.col("n")
    known = scratch.save(words.join(near, "no", "left").join(other, "best", "left").select("no", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best")).alias("form_no"), F.when(fits, F.col("best_word")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "known")
    roots = roots_of(known.where("form_no is not null"), known.agg(F.max("n")).first()[0] or 0, scratch)
    last = words.select(F.col("no").alias("root"), F.col("word").alias("root_word"))
    out = known.join(roots, "no", "left").join(last, "root", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"))


#: The same rows: checksums byte by byte over a table made from the polynomial, groups and lookups on strings.
OP11_SQL = rf"""
WITH RECURSIVE
bits AS (SELECT i AS byte, 0 AS step, i AS v FROM range(256) t(i) UNION ALL SELECT byte, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY byte) AS t FROM bits WHERE step = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
own AS (SELECT id, w, count(*) AS n FROM runs WHERE length(w) >= {LEAST_LETTERS} GROUP BY id, w),
bytes AS (SELECT w, n, flatten(list_transform(string_split(id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c)::BIGINT >> 6), 128 + (unicode(c)::BIGINT & 63)] END)) AS b FROM own),
sums AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
damaged AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM sums),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
spots AS MATERIALIZED (SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v)),
pairs AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM spots x JOIN spots y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT x.word, v.word, v.n FROM spots x JOIN v ON v.word = x.a || x.z
  UNION SELECT v.word, x.word, x.n FROM spots x JOIN v ON v.word = x.a || x.z),
near AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n FROM pairs GROUP BY word),
best AS (SELECT word, n_near, best_n, min(other) AS best FROM near JOIN pairs USING (word) WHERE other_n = best_n GROUP BY word, n_near, best_n),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * v.n THEN best END AS form, CASE WHEN best_n >= {RATIO} * v.n THEN best_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.root FROM walk w JOIN f ON f.word = w.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)
"""
