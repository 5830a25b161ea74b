"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text's fingerprints are the least of each WINNOW consecutive hashes of GRAM words, so any WINDOW = GRAM + WINNOW - 1
words that a document shares with a benchmark item have a fingerprint in common at the same place. Document and
item fingerprints are joined, and every hit is extended to the WINDOW-word windows over it, which are looked up among the
items' windows and compared word by word. Items of fewer words are fingerprinted by their first words and compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm.common import LOWER, UPPER, Scratch, table

WINDOW = 13
GRAM = 8
WINNOW = WINDOW - GRAM + 1
HEAD = 3  # words by which shorter items are looked up, at most
#: Low bits of a packed fingerprint: the position counted from the end, so that the rightmost of equals is least. An array of longs holds no more.
POSITION_BITS = 28
SMALL_BYTES = 64 << 20  # size of the item index, and of the hits, up to which they are broadcast
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column | str) -> Column:
    """Words of a lower-cased text (A-Z only); null has none."""
    lower = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lower, NOT_WORD), lambda w: w != "")


def _with_codes(df: DataFrame) -> DataFrame:
    """Adds codes, the hashes of words, from which those of several words are made, so that no word is hashed twice."""
    return df.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))


def _grams(k: int) -> Column:
    """Hashes of all k consecutive words, from codes."""
    n = F.size("codes")
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice("codes", i, k)))).otherwise(F.array().cast("array<bigint>"))


def _packed(hashes: str) -> Column:
    low = (1 << POSITION_BITS) - 1
    return F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(F.lit(low) - i))


def _winnowed(packed: str) -> Column:
    n = F.size(packed)
    least = F.array_distinct(F.transform(F.sequence(F.lit(1), n - (WINNOW - 1)), lambda i: F.array_min(F.slice(packed, i, WINNOW))))
    return F.when(n >= WINNOW, least).otherwise(F.array().cast("array<bigint>"))


def _print(packed: Column) -> tuple[Column, Column]:
    """(hash bits, position) of a packed fingerprint."""
    low = (1 << POSITION_BITS) - 1
    return F.shiftright(packed, POSITION_BITS), F.lit(low) - packed.bitwiseAND(F.lit(low))


def _with_prints(df: DataFrame) -> DataFrame:
    """Adds prints, the winnowed fingerprints of words; needs codes."""
    return df.withColumn("hashes", _grams(GRAM)).withColumn("packed", _packed("hashes")).drop("hashes").withColumn("prints", _winnowed("packed")).drop("packed")


def _head_prints(k: int) -> Column:
    return F.transform(_grams(k), lambda h, i: F.struct(F.lit(k).alias("kind"), h.alias("print"), i.alias("pos")))


def item_index(benchmark: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prints, windows, members). prints (kind, print, sizes): kind 0 for winnowed items, else the number of head words of shorter ones, and how many words the windows there
    have. windows (m, code, words, members): each different window once, whatever items have it. members (members, ids): the items that have a window, under a name
    which windows of the same items share."""
    # outer, as else Spark would evaluate what is exploded once more, in a filter for empty arrays before
    items = _with_codes(benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of("text").alias("words")).where(F.size("words") > 0).distinct())
    long, short = _with_prints(items.where(F.size("words") >= WINDOW)), items.where(F.size("words") < WINDOW)
    head = F.least(F.lit(HEAD), F.size("words"))
    size = F.least(F.lit(WINDOW), F.size("words"))
    prints = long.select(F.explode_outer("prints").alias("p")).select(F.lit(0).alias("kind"), _print(F.col("p"))[0].alias("print"), F.lit(WINDOW).alias("m"))
    prints = prints.unionByName(short.select(head.alias("kind"), F.xxhash64(F.slice("codes", 1, head)).alias("print"), size.alias("m"))).groupBy("kind", "print").agg(F.collect_set("m").alias("sizes"))
    each = items.select("item_id", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("words"))
    named = each.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("ids")).select(F.size("words").alias("m"), F.xxhash64("words").alias("code"), "words", F.md5(F.to_json("ids")).alias("members"), "ids")
    named = scratch.save(named, "windows")
    return scratch.save(prints, "prints"), named.drop("ids"), named.groupBy("members").agg(F.first("ids").alias("ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items (sorted ids as strings), items_sha256 (of these, comma-joined), contaminated.

    docs needs doc_id and text, benchmark item_id and text; other columns are ignored. n_hit counts the words of
    the document inside any occurrence of WINDOW consecutive words of an item, or of a whole item of fewer words;
    contaminated is n_hit > 0 and 20 * n_hit >= n_words. A null or empty text has no words and no hits; an item without words
    never occurs; items of equal text count each, repeated items once. The words of an item without an id are hit as those of
    others, but it is not among the items and n_items doesn't count it. Each row counts alone, repeated ids too. An empty
    table of documents gives no rows, an empty benchmark no hits. Texts of any length that an array of their words can hold are handled whole.

    A passage that many items have is one row of the index for each fingerprint and for each window, so that hits do not grow with the items that share it; the
    names of items come in last, once for each different set of them. Both indexes are broadcast while they take at most SMALL_BYTES, else joined by a shuffle. Documents are read
    twice: for their fingerprints, of which only hits go on, and for the words around hits. Hits are
    broadcast to the second reading while they take at most SMALL_BYTES, so that no text is shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    prints, windows, members = item_index(benchmark, scratch)
    kinds = sorted(r[0] for r in prints.select("kind").distinct().collect())  # at most HEAD + 1 values
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words_of("text").alias("words"))
    hits = scratch.save(_hits(rows, _small(prints, F.lit(40) + 4 * F.size("sizes")), kinds), "hits").toDF("its_id", "its_hash", "hits")
    hits = _small(hits, F.lit(100) + 60 * F.size("hits"))
    rows = rows.join(hits, rows.doc_id.eqNullSafe(F.col("its_id")) & (F.col("text_hash") == F.col("its_hash")), "left")
    read = scratch.save(rows.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.array_distinct(F.flatten(F.transform("hits", _around))).alias("around")), "read")

    near = read.where(F.size("around") > 0).select("doc_id", "text_hash", F.explode("around").alias("w")).select("doc_id", "text_hash", "w.start", "w.words", F.size("w.words").alias("m"), F.xxhash64("w.words").alias("code"))
    index = _small(windows.withColumnRenamed("words", "theirs"), F.lit(100) + _bytes("theirs"))
    found = near.join(index, ["m", "code"]).where(F.col("words") == F.col("theirs"))
    span = F.struct("start", (F.col("start") + F.col("m")).alias("end"))
    per = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(span)).alias("spans"), F.sort_array(F.collect_set("members")).alias("sets"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["upto"], s["start"]))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto")),
    )["n"]
    per = scratch.save(per.select(F.col("doc_id").alias("its_id"), F.col("text_hash").alias("its_hash"), covered.alias("n_hit"), F.md5(F.to_json("sets")).alias("all_of"), "sets"), "per")
    lists = per.groupBy("all_of").agg(F.first("sets").alias("sets")).select("all_of", F.explode("sets").alias("members")).join(members, "members")
    lists = lists.groupBy("all_of").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    lists = scratch.save(lists.select("all_of", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items"), "lists")
    out = read.drop("around").join(per.drop("sets"), read.doc_id.eqNullSafe(F.col("its_id")) & (F.col("text_hash") == F.col("its_hash")), "left").join(lists, "all_of", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    nothing = F.array().cast("array<string>")
    digest = F.coalesce("items_sha256", F.sha2(F.lit(""), 256))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", nothing).alias("items"), digest.alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def _around(h: Column) -> Column:
    """The windows over a hit that fit into the text, as (start, words)."""
    shift = F.when(h["kind"] == 0, F.sequence(F.lit(0), F.lit(WINNOW - 1))).otherwise(F.array(F.lit(0)))
    of = lambda m: F.transform(F.filter(shift, lambda o: (h["pos"] - o >= 0) & (h["pos"] - o + m <= F.size("words"))), lambda o: F.struct((h["pos"] - o).alias("start"), F.slice("words", h["pos"] - o + 1, m).alias("words")))
    return F.flatten(F.transform(h["sizes"], of))


def _bytes(words: Column | str) -> Column:
    return F.length(F.array_join(words, " ")) + 20 * F.size(words)


def _small(df: DataFrame, size: Column) -> DataFrame:
    """A broadcast hint behind the sum of the rows' sizes; what is larger is left to a shuffled join."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= SMALL_BYTES else df


def _hits(rows: DataFrame, prints: DataFrame, kinds: list[int]) -> DataFrame:
    """(doc_id, text_hash, hits): the fingerprints of each text that are in the index, with the sizes of the windows there; rows without any are left out."""
    rows = _with_codes(rows)
    rows = _with_prints(rows) if 0 in kinds else rows.withColumn("prints", F.array().cast("array<bigint>"))
    long = F.transform("prints", lambda p: F.struct(F.lit(0).alias("kind"), _print(p)[0].alias("print"), _print(p)[1].cast("int").alias("pos")))
    every = rows.select("doc_id", "text_hash", F.concat(long, *[_head_prints(k) for k in kinds if k]).alias("every"))
    # outer, as else Spark would evaluate every once more, in a filter for empty arrays before
    own = every.select("doc_id", "text_hash", F.explode_outer("every").alias("f")).select("doc_id", "text_hash", "f.kind", "f.print", "f.pos")
    found = own.join(prints, ["kind", "print"]).select("doc_id", "text_hash", F.struct("kind", "pos", "sizes").alias("hit"))
    return found.groupBy("doc_id", "text_hash").agg(F.collect_set("hit").alias("hits"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: The same rows by comparing every window of every item with every place of every document.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram
  FROM (SELECT *, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d JOIN (SELECT DISTINCT m FROM iw) s ON len(w) >= m)),
hit AS (SELECT DISTINCT r, i, dw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.gram = iw.gram),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN named USING (r)
"""
