"""Corpus preparation in stages: language, near duplicates, repeated passages, benchmark contamination, tokens.

Each stage works on all that the one before has kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxtrail.llm.common import Scratch, bounded_batches, table
from boxtrail.llm.op2_byte_bpe import encode_and_decode
from boxtrail.llm.op3_winnowing import decontaminate
from boxtrail.llm.op4_minhash_forest import near_duplicates
from boxtrail.llm.op6_byte_gru import UNDECIDED, label_column, train_on_documents
from boxtrail.llm.op7_sparse_suffixes import repeated_windows, text_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Mean probability of "no language" over a text's letters from which it is dropped. Made-up junk of six kinds reaches 0.96; of the labelled texts of sf0.1 a few
#: short ones with numbers and tokens reach 0.9.
JUNK = 0.9
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the network rejects: null texts and those without a letter, and those whose letters it takes to be in no language, a class that it here
    learns from segments of junk beside the languages. Where nothing can be learned, only the first rule is left. A row without a doc_id, and each of
    the rows that share one, is judged by its text."""
    docs = docs.select(*COLUMNS)
    network = train_on_documents(docs, reject=True)
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    junk = (F.col("found.lang_pred") == UNDECIDED) & ((F.col("found.score") == 0) | (F.col("found.score") >= JUNK))
    return docs.withColumn("found", label_column(network)("text")).where(~junk).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the smallest doc_id, of rows that share it one, and a row without a doc_id only where all of the group
    lack one. Rows count by themselves, so texts that differ stay apart under one doc_id. Rows without words all stay."""
    rows = Scratch(spark).save(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), k=5, threshold=80)
    members = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")).select("first.row")
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [text_key(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "text_key"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their spans; what stood between the words that stay is kept."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("later").to_pylist(), strict=True):
            if spans:
                places = [m.span() for m in WORD.finditer(text)]
                parts, at = [], 0
                for s in spans:
                    parts.append(text[at : places[s["start"]][0]])
                    at = places[s["end"]][0] if s["end"] < len(places) else len(text)
                text = "".join([*parts, text[at:]])
            out.append(text)
        names = [n for n in batch.schema.names if n != "later"]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names], names)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes each passage of 50 words or more that occurs before, in a document of a smaller doc_id or further up; drops documents
    of which nothing is left. n_chars follows the text. Passages are found by the text, as rows may share a doc_id or have none."""
    docs = docs.select(*COLUMNS)
    marks = repeated_windows(docs)[1].where(F.size("later") > 0).select("text_key", "later")
    keyed = docs.mapInArrow(_keyed, T.StructType([*docs.schema, T.StructField("text_key", T.BinaryType())])).join(marks, "text_key", "left").withColumn("whole", F.col("later").isNull())
    cut = keyed.drop("text_key").mapInArrow(_without, T.StructType([*docs.schema, T.StructField("whole", T.BooleanType())]))
    cut = cut.where(F.col("whole") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.when(F.col("whole"), F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are contaminated by benchmark items. A text decides for itself, whatever its doc_id."""
    docs = docs.select(*COLUMNS)
    key = F.xxhash64("text")
    bad = decontaminate(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return docs.withColumn("key", key).join(bad.withColumnRenamed("doc_id", "key"), "key", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that is left, checked by decoding."""
    coded = encode_and_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("language ID", language), ("MinHash near-dedup", deduplicate), ("suffix-array dedup", cut_repeats), ("benchmark decontamination", drop_contaminated), ("byte-level BPE", tokens)]
#: SQL has neither the network nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
