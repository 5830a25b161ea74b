"""Embeddings: prototypes, similarity, consistency and nearest-prototype classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxtrail.functions.scalars import cosine01, is_embedding, l2_normalized

#: Numbers in all vectors of a side up to which it is broadcast, 32 MB.
SENT = 4_000_000
#: Vectors of a block, where a side is not broadcast.
BLOCK = 1024


def against(rows: DataFrame, key: str, vectors: DataFrame, vector: str) -> DataFrame:
    """Each row beside each of vectors (label, vector, ...). Few vectors, by a count of their numbers, are broadcast; more are cut into blocks, as are the rows, and meet by a join on both
    numbers of blocks, so that no task has more than a block of either for a key. Blocks go by hashes of key and label, which a repeated task finds again."""
    n, width = vectors.agg(F.count("*"), F.max(F.size(vector))).first()
    if n * (width or 1) <= SENT:
        return rows.join(F.broadcast(vectors), F.lit(True))
    parts = -(-n // BLOCK)
    salts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // parts)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).withColumn("_part", every(parts))
    right = vectors.withColumn("_part", F.pmod(F.xxhash64("label"), F.lit(parts)).cast("int")).withColumn("_salt", every(salts))
    return left.join(right, ["_part", "_salt"]).drop("_part", "_salt")


def mean_vectors(rows: DataFrame, by: str, vector: str = "embedding", weight: str | None = None) -> DataFrame:
    """Element-wise (weighted) mean vectors and counts; invalid vectors are left out. Positions are aggregated, so no group is gathered whole."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = rows.where(is_embedding(F.col(vector))).select(by, w.alias("w"), F.posexplode(vector).alias("pos", "v"))
    s = e.groupBy(by, "pos").agg((F.sum(F.col("w") * F.col("v").cast("double")) / F.sum("w")).alias("v"), F.count("*").alias("n"))
    return s.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("mean"), F.max("n").alias("n"))


def prototypes(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    return mean_vectors(rows, by, vector).withColumn("prototype", l2_normalized(F.col("mean")))


def cosine_topk(queries: DataFrame, prototypes: DataFrame, k: int) -> DataFrame:
    """The k prototypes (label, prototype) most alike for each query (query, embedding). Each task keeps its k best of a query before they meet."""
    s = against(queries.select("query", "embedding"), "query", prototypes.select("label", "prototype"), "prototype").select("query", "label", F.round(cosine01(F.col("embedding"), F.col("prototype")), 9).alias("score"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "label"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k)


def leave_one_out(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Mean cosine01 of each sample to the mean of the others of its group, null for one sample. The others' sum is the group's less the sample, so there are no pairs."""
    m = mean_vectors(rows, by, vector)
    j = rows.where(is_embedding(F.col(vector))).join(m, by)
    others = F.zip_with("mean", vector, lambda a, b: a * F.col("n") - b.cast("double"))
    j = j.withColumn("score", F.when(F.col("n") > 1, cosine01(F.col(vector), others)))
    return j.groupBy(by).agg(F.count("*").alias("n"), F.avg("score").alias("consistency"))


def nearest_prototype(rows: DataFrame, means: DataFrame, key: str, own: str | None = None, vector: str = "embedding") -> DataFrame:
    """The label of the nearest mean vector by Euclidean distance, and sigmoid(6 * margin to the second). own: a column with each row's label, which is then left
    out of that label's mean; labels of a single sample are skipped."""
    m = means.select("label", "mean", "n")
    pairs = against(rows.select(key, vector, *([] if own is None else [own])), key, m, "mean")
    centre = F.col("mean")
    if own is not None:
        mine = F.col(own) == F.col("label")
        pairs = pairs.where(~mine | (F.col("n") > 1))
        left_out = F.zip_with("mean", vector, lambda a, b: (a * F.col("n") - b.cast("double")) / (F.col("n") - 1))
        centre = F.when(mine, left_out).otherwise(centre)
    gap = F.aggregate(F.zip_with(centre, F.col(vector), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    near = pairs.select(key, "label", F.round(F.sqrt(gap), 9).alias("distance"))
    near = near.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("distance", "label"))).where("_n <= 2")
    best = near.groupBy(key).agg(F.min(F.struct("_n", "label", "distance")).alias("r"), (F.max("distance") - F.min("distance")).alias("margin"))
    return best.select(key, "r.label", "r.distance", F.round(1 / (1 + F.exp(-6 * F.col("margin"))), 9).alias("confidence"))
