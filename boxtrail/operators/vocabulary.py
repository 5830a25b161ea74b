"""Class names, aliases, label policies, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.functions.scalars import class_name, phrase

ACTIONS = ("ignore", "detect_only", "track")


def class_policy(rows: DataFrame, column: str, mapping: DataFrame, ignored: list[str], unknown: str = "unknown") -> DataFrame:
    """Adds status (mapped, ignored, unknown), target and ignored by a table (source, target); a mapped name beats the ignore list."""
    names = mapping.select(class_name(F.col("source")).alias("_name"), F.col("target").alias("_target"))
    j = rows.withColumn("_name", class_name(F.col(column))).join(F.broadcast(names), "_name", "left")
    status = F.when(F.col("_target").isNotNull(), "mapped").when(F.col("_name").isin([i.lower() for i in ignored]), "ignored").otherwise("unknown")
    return j.withColumns({"status": status, "target": F.coalesce("_target", F.when(status == "unknown", F.lit(unknown))), "ignored": status != "mapped"}).drop("_name", "_target")


def longest_alias(rows: DataFrame, text: Column, aliases: DataFrame) -> DataFrame:
    """Adds canonical and alias: the longest alias that stands in the phrase between word bounds; ties go to the lower alias. Rows need a key column `id`.

    Phrases and aliases meet on single words: the first word of an alias must be a word of the phrase.
    """
    a = aliases.select(phrase(F.col("alias"), False).alias("alias"), "canonical").withColumn("word", F.split("alias", " ")[0])
    p = rows.withColumn("_p", phrase(text, False))
    hits = p.select("id", "_p", F.explode(F.array_distinct(F.split("_p", " "))).alias("word")).join(F.broadcast(a), "word")
    hits = hits.where(F.concat(F.lit(" "), F.col("_p"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("alias"), F.lit(" "))))
    best = hits.groupBy("id").agg(F.min_by(F.struct("alias", "canonical"), F.struct(-F.length("alias"), "alias")).alias("b"))
    return rows.join(best, "id", "left").select(*rows.columns, "b.canonical", "b.alias")


def merge_objects(objects: DataFrame, floor: float = 0.15, most: int = 12) -> DataFrame:
    """Objects of a scene merged by canonical name: greatest confidence, strongest action, distinct attributes; the first `most` by action, confidence and name.

    objects: scene, canonical, conf, action, attributes (array).
    """
    level = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    m = objects.where(F.col("conf") >= floor).groupBy("scene", "canonical").agg(F.max("conf").alias("conf"), F.max_by("action", level).alias("action"), F.max(level).alias("level"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("attributes")))).alias("attributes"))
    rank = F.row_number().over(W.partitionBy("scene").orderBy(F.desc("level"), F.desc("conf"), "canonical"))
    return m.withColumn("rank", rank).where(F.col("rank") <= most).drop("level")


def family(name: Column, families: dict[str, list[str]]) -> Column:
    """The first family of which an alias is in the name."""
    out = None
    for label, words in families.items():
        test = F.lower(name).rlike("|".join(words))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("other")


def closed_taxonomy(label: Column, confidence: Column, allowed: list[str], parents: dict[str, str]) -> tuple[Column, Column]:
    """A label held to the allowed ones: a fine label becomes its parent, others unknown with 1 - confidence."""
    table = F.create_map(*[F.lit(x) for kv in parents.items() for x in kv])
    fine = table[label]
    return F.when(label.isin(allowed), label).when(fine.isin(allowed), fine).otherwise("unknown"), F.when(label.isin(allowed) | fine.isin(allowed), confidence).otherwise(1 - confidence)


def split_by_group(rows: DataFrame, name: str, group: Column, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """(name, split) so that a group is never divided: groups are taken in the order of a seeded MD5 until the rows of a split are reached. The order is
    the hash's, not a random generator's. What comes before a group is summed by the first byte of the hash, then within it, so that no task sees all groups."""
    g = rows.select(F.col(name), group.alias("g")).distinct()
    sizes = g.groupBy("g").agg(F.count("*").alias("n")).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), "g"))).withColumn("part", F.substring("h", 1, 2))
    within = W.partitionBy("part").orderBy("h", "g").rowsBetween(W.unboundedPreceding, 0)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("m"))  # 256 rows at most
    whole = W.partitionBy()
    parts = parts.withColumns({"earlier": F.sum("m").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("m"), "whole": F.sum("m").over(whole)})
    sizes = sizes.withColumn("before", F.sum("n").over(within) - F.col("n")).join(F.broadcast(parts), "part")
    share = (F.col("earlier") + F.col("before")) / F.col("whole")
    split = F.when(share < ratios[0], "train").when(share < ratios[0] + ratios[1], "val").otherwise("test")
    return g.join(sizes.select("g", split.alias("split")), "g").select(name, "split")
