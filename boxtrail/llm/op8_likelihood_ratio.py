"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text, with DataFrame functions only.

Words and word pairs are hashed into BUCKETS. Two multinomials over the buckets are counted, one over the texts labelled as good
and one over all texts. A document's score is the mean over its features of log(P(trusted) / P(raw)), and every document
is kept or not by a fixed threshold, after base rules on length and repetition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm.common import Scratch, maybe_broadcast, table

BUCKETS = 1 << 13
SMOOTHING = 1.0  # added to each bucket's count
THRESHOLD = -0.03  # least mean log-likelihood ratio of a kept document
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column | str) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def with_hashes(df: DataFrame) -> DataFrame:
    """Adds hashes, those of the words; pairs and windows are hashed from them, so that no word is hashed twice."""
    return df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def features(hashes: str) -> Column:
    """Buckets of all words and of all pairs of consecutive words, from the words' hashes."""
    n = F.size(hashes)
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: bucket(F.xxhash64(F.element_at(hashes, i), F.element_at(hashes, i + 1))))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(hashes, bucket), pairs)


def base_columns(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; needs text (not null), words and hashes."""
    n = F.size("words")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    # Windows are compared by 64-bit hashes; only texts that repeat some window sort them to find where.
    grams = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at("hashes", i), F.element_at("hashes", i + 1), F.element_at("hashes", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("grams", grams)
    df = df.withColumn("ranked", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    equal = lambda i, j: F.coalesce(F.get("ranked", i)["h"] == F.get("ranked", j)["h"], F.lit(False))
    twice = F.array_sort(F.transform(F.filter(F.transform("ranked", lambda x, i: F.struct(x["i"].alias("i"), (equal(i, i - 1) | equal(i, i + 1)).alias("same"))), lambda x: x["same"]), lambda x: x["i"]))
    df = df.withColumn("twice", twice)
    covered = F.aggregate("twice", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda a, s: F.struct((a["n"] + s + 3 - F.greatest(a["upto"], s)).alias("n"), (s + 3).alias("upto")))["n"]
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.regexp_replace("text", SPACE, "")).cast("long"),
            "n_symbols": (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("lines", "grams", "ranked", "twice")


def bucket_weights(docs: DataFrame, trusted: DataFrame, scratch: Scratch) -> Column:
    """The log-likelihood ratio of each bucket, counted over all rows of docs; BUCKETS doubles at any input size."""
    good = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("good", F.lit(1))
    good = scratch.save(good, "good")
    rows = docs.select("doc_id", words_of(F.coalesce("text", F.lit(""))).alias("words")).join(maybe_broadcast(good, good.count()), "doc_id", "left")
    found = with_hashes(rows).select(F.col("good"), F.explode(features("hashes")).alias("bucket"))
    counts = found.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    counts = scratch.save(counts, "counts")
    whole = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    spare = SMOOTHING * BUCKETS
    ratio = F.log((F.col("target") + SMOOTHING) / (whole["target"] + spare)) - F.log((F.col("raw") + SMOOTHING) / (whole["raw"] + spare))
    found = {r["bucket"]: r["w"] for r in counts.select("bucket", F.round(ratio, 4).alias("w")).collect()}
    unseen = math.log((whole["raw"] + spare) / (whole["target"] + spare))
    listed = ",".join(str(found.get(i, round(unseen, 4))) for i in range(BUCKETS))
    return F.split(F.lit(listed), ",").cast("array<double>")  # constant: folded once, before any row is read


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, min_words: int = 50) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    docs needs doc_id and text, trusted the doc_id of the texts to resemble; other columns are ignored. score is the
    mean log-likelihood ratio of all features of the text, 0 without a word. base_failed: fewer than min_words words, or more
    than half of the words in windows of three words that the text repeats. kept: not base_failed and score
    at least threshold. A null text has no words. Without trusted texts all scores are near 0. Repeated rows get the same result and count
    as often as they occur; an empty table gives no rows.

    Documents are read twice, once to count (a partial aggregation into BUCKETS rows) and once to score; no row of a document is shuffled while the
    trusted ids are few enough to be broadcast.
    """
    scratch = Scratch(docs.sparkSession)
    weights = bucket_weights(docs, trusted, scratch)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = base_columns(with_hashes(rows.withColumn("words", words_of("text"))))
    rows = rows.withColumn("features", features("hashes"))
    rows = rows.withColumn("total", F.aggregate("features", F.lit(0.0), lambda a, b: a + F.get(weights, b)))
    score = F.coalesce(F.try_divide("total", F.size("features").cast("double")), F.lit(0.0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.round(score, 6).alias("score"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op8_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
