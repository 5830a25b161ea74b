"""Validation: rows in, issues out. Each check names a code and a severity; a row may have several issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.functions import geometry as g


def issues(rows: DataFrame, keys: list[str], checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """(keys, code, severity) for each failed check: {code: (condition that is a fault, severity)}. One pass."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(s).alias("severity"))) for code, (c, s) in checks.items()]))
    return rows.select(*keys, F.explode(found).alias("i")).select(*keys, "i.code", "i.severity")


def mot_issues(rows: DataFrame, length: int | None = None, order: str = "line_number") -> DataFrame:
    """Issues of track rows (sequence, frame, track_id, x, y, w, h, conf, line_number): numbers, ranges, geometry, sequence length, duplicates and order."""
    b = g.corners("x", "y", "w", "h")
    line = W.partitionBy("sequence").orderBy(order)
    same = W.partitionBy("sequence", "frame", "track_id").orderBy(order)
    key = F.struct("frame", "track_id")
    r = rows.withColumns({"_dup": F.row_number().over(same) > 1, "_back": F.lag(key).over(line) > key})
    checks = {
        "not_finite": (~g.finite(F.col("x"), F.col("y"), F.col("w"), F.col("h")), "error"),
        "bad_frame": (F.coalesce(F.col("frame") < 1, F.lit(True)), "error"),
        "bad_id": (F.coalesce(F.col("track_id") < 0, F.lit(True)), "error"),
        "bad_box": (g.finite(*b) & ~g.is_valid(b), "error"),
        "bad_confidence": (~F.col("conf").between(0, 1), "warning"),
        "beyond_length": (F.col("frame") > length if length else F.lit(False), "error"),
        "duplicate": (F.col("_dup"), "error"),
        "unordered": (F.col("_back"), "warning"),
    }
    return issues(r, ["sequence", "frame", "track_id", order], checks)


def cache_issues(frames: DataFrame, meta: DataFrame) -> DataFrame:
    """Issues of detection caches by sequence. frames: sequence, frame, n; meta: sequence, frame_count, detections, floor, threshold, complete."""
    f = frames.groupBy("sequence").agg(F.count("*").alias("rows"), F.countDistinct("frame").alias("distinct"), F.min("frame").alias("lo"), F.max("frame").alias("hi"), F.sum("n").alias("n"))
    j = meta.join(f, "sequence", "left")
    checks = {
        "missing_cache": (F.col("rows").isNull(), "error"),
        "incomplete": (~F.col("complete"), "error"),
        "duplicate_frames": (F.col("rows") > F.col("distinct"), "error"),
        "missing_frames": (F.col("distinct") < F.col("frame_count"), "error"),
        "out_of_bounds": ((F.col("lo") < 1) | (F.col("hi") > F.col("frame_count")), "error"),
        "count_mismatch": (F.col("n") != F.col("detections"), "error"),
        "floor_above_threshold": (F.col("floor") > F.col("threshold"), "error"),
    }
    return issues(j, ["sequence"], checks)


def manifest_issues(segments: DataFrame, queries: DataFrame, sequences: DataFrame) -> DataFrame:
    """Referential and range faults of a language manifest: (subject, code)."""
    s = segments.join(queries, ["sequence", "query"], "left_anti").select(F.concat_ws("/", "sequence", "query").alias("subject"), F.lit("segment_without_query").alias("code"))
    q = queries.join(sequences, "sequence", "left_anti").select(F.concat_ws("/", "sequence", "query").alias("subject"), F.lit("unknown_sequence").alias("code"))
    r = queries.join(sequences, "sequence").where("eval_end < eval_start or eval_start < 1 or eval_end > frame_count").select(F.concat_ws("/", "sequence", "query").alias("subject"), F.lit("bad_range").alias("code"))
    d = queries.groupBy("sequence", "query").agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws("/", "sequence", "query").alias("subject"), F.lit("duplicate_query").alias("code"))
    return s.unionByName(q).unionByName(r).unionByName(d)


def cross_checks(actual: DataFrame, expected: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(name, expected, found, code) where a named value is missing, extra or different. Both: name, value."""
    j = expected.select("name", F.col("value").alias("expected")).join(actual.select("name", F.col("value").alias("found")), "name", "full")
    code = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.abs(F.col("found") - F.col("expected")) > tolerance, "different")
    return j.withColumn("code", code).where("code is not null")


def release_gate(checks: DataFrame) -> DataFrame:
    """One row from (name, ok): ready and the failed names."""
    return checks.agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ready"), F.array_sort(F.collect_list(F.when(~F.coalesce("ok", F.lit(False)), F.col("name")))).alias("failed"))


def split_overlap(splits: DataFrame) -> DataFrame:
    """Names in more than one split, with the pair of splits. splits: name, split."""
    a, b = splits.distinct().toDF("name", "split"), splits.distinct().toDF("name", "other")
    return a.join(b, "name").where("split < other")


def missing_frames(obs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Frames 1..n of each sequence (sequence, n) that have no row."""
    spine = lengths.select("sequence", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("frame"))
    return spine.join(obs.select("sequence", "frame").distinct(), ["sequence", "frame"], "left_anti")


def set_difference(expected: DataFrame, actual: DataFrame, name: str) -> DataFrame:
    """Missing and extra names."""
    miss = expected.select(name).distinct().join(actual, name, "left_anti").select(name, F.lit("missing").alias("kind"))
    return miss.unionByName(actual.select(name).distinct().join(expected, name, "left_anti").select(name, F.lit("extra").alias("kind")))
