"""What the text operators share: table paths, scratch tables, components, word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Rows up to which a side of narrow rows (a few longs each) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of bounded bytes for the session, as texts may be long; a setting of the user's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in (None, "-1", str(2**63 - 1)):
        spark.conf.set(key, size)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the session names; one of our own only where none is set and all tasks run in this process. On a cluster executors
    wouldn't see each other's local folders."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="boxtrail-"))
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit
        pass


class Scratch:
    """Tables written to the shared checkpoint folder: they cut lineage and survive lost executors.

    ``save`` writes and rereads, ``drop`` deletes a table that is no longer read; the rest goes at exit.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        self.root = f"{checkpoint_root(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.paths.pop(name))


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint behind a count; a larger side is left to a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


#: Rows that one task takes in a round of components; a table of fewer needs no shuffle.
TASK_ROWS = 200_000


def _both(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Two rows (u, v) from one, in place, so that a table in one partition stays in one."""
    return F.inline(F.array(F.struct(p.alias("u"), q.alias("v")), F.struct(r.alias("u"), s.alias("v"))))


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, rounds: int = 40) -> DataFrame:
    """(node, root) with the smallest node reachable, for every node of edges (a, b).

    Alternating large-star and small-star contraction (Kiveris et al. 2014): each round is two
    aggregations joined back to the edges, so no list of a hub's edges is ever built (as rows of one key
    they share a partition of the join, unless Spark splits or broadcasts it), and the number
    of rounds grows with the logarithm of the longest chain. Stops when a round changes nothing.
    Each round is written to as many files as its rows need, and read by as many tasks.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0")
    last, before, rows = "edges0", None, e.count()
    for i in range(rounds):
        parts = 1 + rows // TASK_ROWS
        both = e.coalesce(parts).select(_both(u, v, v, u))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(v.alias("u"), m.alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(_both(v, m, u, m)).where("u <> v")
        e = scratch.save(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(parts), f"edges{i + 1}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(last)
        last = f"edges{i + 1}"
        if now == before:
            return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, rows = now, now[0]
    raise RuntimeError(f"components did not settle in {rounds} rounds")


class WordHashes(dict):
    """Word to 64-bit hash, computed once per distinct word; bounded, as a task may see any number of words."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive word hashes; none when there are fewer than k."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(3) + words[i : len(words) - k + 1 + i])
    return out
