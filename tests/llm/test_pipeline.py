"""The pipeline's stages against brute force, each on its own input."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = {lang: [f"{p}{i}{q}" for i in "abcdefghijklm" for p in prefix for q in ("a", "o", "us", "ing")] for lang, prefix in (("en", ("th", "wh", "sh")), ("fr", ("éau", "què", "ço")))}
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "fr"
        rows.append((i, prose(rng, 150, vocab[lang]), lang))
    passage, item = prose(rng, 70, vocab["en"]), prose(rng, 30, vocab["en"])
    edited = rows[5][1].split()
    edited[40] = "edited"
    rows += [(200, rows[5][1], "en"), (201, " ".join(edited), "en"), (202, None, "en"), (203, "123 !! 456", "en"), (204, "", None)]
    rows += [(210, prose(rng, 60, vocab["en"]) + "\n" + passage + "\n" + prose(rng, 60, vocab["en"]), "en"), (211, prose(rng, 90, vocab["en"]) + "  " + passage, "en")]
    rows += [(220, prose(rng, 40, vocab["en"]) + " " + item, "en"), (200, rows[5][1], "en")]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], COLUMNS).repartition(3).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), rows, passage


def test_stages(spark, folder):
    d, rows, passage = folder
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs.withColumn("words", F.lit(1)) if i == 0 else docs, d)
        if i < 4:
            assert out.dtypes == docs.select(*pipeline.COLUMNS).dtypes
        out.write.parquet(f"{d}/stage{i}")
        docs = spark.read.parquet(f"{d}/stage{i}")
        kept.append(docs.collect())
    ids = [sorted(r.doc_id for r in k) for k in kept]
    clean = set(range(120))
    assert set(ids[0]) == clean | {200, 201, 210, 211, 220} and ids[0].count(200) == 2
    assert ids[1] == sorted(clean | {210, 211, 220})
    text = {r.doc_id: r for r in kept[2]}
    assert ids[2] == ids[1] and passage in text[210].text and passage not in text[211].text
    before = {r.doc_id: r.text for r in kept[1]}
    assert text[211].text == before[211].removesuffix(passage) and text[211].n_chars == len(text[211].text)
    assert all(text[i].text == before[i] for i in ids[2] if i != 211)
    assert set(ids[3]) == (clean | {210, 211})
    assert all(r.n_tokens > 0 and re.fullmatch("[0-9a-f]{64}", r.decoded_sha256) for r in kept[4]) and ids[4] == ids[3]


def test_stages_decide_by_row(spark, folder, tmp_path):
    """Rows without a doc_id and rows that share one, through the stages after the first."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    a, b, c, d, e, passage, item = (prose(rng, n, words) for n in (120, 120, 120, 120, 120, 70, 30))
    near = " ".join([*a.split()[:-1], "edited"])
    rows = [(1, a), (7, b), (7, c), (7, b), (3, near), (9, d), (None, d), (None, e), (None, a + " " + e), (None, None)]
    rows += [(12, passage + " " + prose(rng, 60, words)), (14, prose(rng, 80, words)), (14, prose(rng, 60, words) + " " + passage), (16, prose(rng, 100, words)), (16, prose(rng, 40, words) + " " + item), (None, prose(rng, 45, words) + " " + item)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3)
    order = lambda found: sorted(((r.doc_id, r.text) for r in found), key=repr)
    kept = pipeline.deduplicate(spark, docs, str(tmp_path)).collect()
    assert order(kept) == sorted([x for i, x in enumerate(rows) if i not in (3, 4, 6)], key=repr)
    docs = spark.createDataFrame(kept, COLUMNS)
    cut = pipeline.cut_repeats(spark, docs, str(tmp_path)).collect()
    # of a + e, which has no id, a goes as doc 1 has it; e stays in one of the two texts without an id, and the other goes if nothing is left of it
    assert sum((r.text or "").count(e) for r in cut) == sum((r.text or "").count(a) for r in cut) == 1 and len(kept) - len(cut) in (0, 1)
    assert {r.text for r in cut if r.doc_id == 14} == {rows[11][1], rows[12][1].removesuffix(passage)}
    assert all(r.n_chars == len(r.text or "") for r in cut) and {r.text for r in cut if r.doc_id == 7} == {b, c}
    clean = pipeline.drop_contaminated(spark, spark.createDataFrame(cut, COLUMNS), str(tmp_path)).collect()
    assert order(clean) == order(r for r in cut if item not in (r.text or ""))


def test_run_gives_the_last_stage(spark, folder):
    assert {r.doc_id for r in pipeline.run(spark, folder[0]).collect()} == set(range(120)) | {210, 211}


def test_empty_documents(spark, folder, tmp_path):
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, folder[0]).count() == 0


def test_language_drops_texts_in_no_language(spark, folder):
    rng = random.Random(3)
    drawn = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    junk = [drawn("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 300), "a" + drawn("0123456789abcdef", 300), "x " + drawn("#*$%&|<>0123456789 ", 300)]
    extra = [(301 + i, t, None, None, len(t)) for i, t in enumerate(junk)] + [(310, "what thao", "en", None, 9)]
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id < 120").union(spark.createDataFrame(extra, COLUMNS))
    assert {r.doc_id for r in pipeline.language(spark, docs, folder[0]).collect()} == set(range(120)) | {310}


def test_language_without_labels_keeps_all_with_letters(spark, folder):
    docs = spark.createDataFrame([(1, "some text", None, None, 9), (2, "12 34", None, None, 5), (3, None, None, None, 0)], COLUMNS)
    assert [r.doc_id for r in pipeline.language(spark, docs, folder[0]).collect()] == [1]
