"""Runs of several settings over the same input that compute only what no earlier run has computed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprints(rows: DataFrame, by: str) -> DataFrame:
    """(by, fingerprint): one for each key of `by`, equal for equal rows in any order, columns and repeats included; partial sums of hashes."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    total = [F.sum(F.xxhash64(F.lit(salt), text).cast("decimal(38,0)")).cast("string") for salt in ("a", "b")]
    types = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted(rows.schema, key=lambda f: f.name))
    return rows.groupBy(by).agg(F.sha2(F.concat_ws("/", F.lit(types), F.count("*").cast("string"), *total), 256).alias("fingerprint"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class Runs:
    """A folder of results. Each run writes results/run=<id>, and after it manifest/run=<id>: by, setting, fingerprint, rows. What a manifest names and the results
    hold in that number is done; a run lost on its way has no manifest and is passed over, so that a run may be repeated after any failure.

    compute(rows, options) gives a table with the column `by` and the same columns for all settings; version stands for its code.
    """

    def __init__(self, spark: SparkSession, root: str, compute: Callable[[DataFrame, dict], DataFrame], by: str = "sequence", version: str = "1"):
        self.spark, self.root, self.compute, self.by, self.version = spark, root, compute, by, version

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{part}").parquet(f"{self.root}/{part}/*").withColumn("run", F.col("run").cast("string"))

    def _same(self, a: DataFrame, b: DataFrame, *names: str):
        return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in (self.by, *names)])

    def done(self) -> DataFrame | None:
        """by, setting, fingerprint, run: the first whole result of each fingerprint."""
        if not _exists(self.spark, f"{self.root}/manifest"):
            return None
        m = self._read("manifest")
        held = self._read("results").groupBy("run", self.by, "setting").agg(F.count("*").alias("held"))
        whole = m.join(held, self._same(m, held, "setting", "run"), "left").where(F.col("rows") == F.coalesce("held", F.lit(0)))
        return whole.groupBy(m[self.by], m["setting"], "fingerprint").agg(F.min(m["run"]).alias("run"))

    def plan(self, rows: DataFrame, settings: dict[str, dict]) -> DataFrame:
        """by, setting, fingerprint, run: what the settings need of the rows, with the run that has it, or null. The fingerprint is of the key's rows and the setting's options."""
        marks = F.array(*[F.struct(F.lit(n).alias("setting"), F.lit(json.dumps([self.version, o], sort_keys=True)).alias("options")) for n, o in settings.items()])
        wanted = fingerprints(rows, self.by).select(self.by, "fingerprint", F.explode(marks).alias("m"))
        wanted = wanted.select(self.by, "m.setting", F.sha2(F.concat_ws("/", "fingerprint", "m.options"), 256).alias("fingerprint"))
        if (done := self.done()) is None:
            return wanted.withColumn("run", F.lit(None).cast("string"))
        return wanted.join(done, self._same(wanted, done, "setting", "fingerprint"), "left").select(*[wanted[c] for c in wanted.columns], "run")

    def run(self, rows: DataFrame, settings: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
        """(results, plan): the results of all keys and settings with setting, and what of it was there before (reused)."""
        name = uuid.uuid4().hex
        plan_at = f"{self.root}/plans/run={name}"
        self.plan(rows, settings).write.parquet(plan_at)
        plan = self.spark.read.parquet(plan_at)
        todo = plan.where("run IS NULL")
        if not todo.isEmpty():
            parts = []
            for setting, options in settings.items():
                keys = todo.where(F.col("setting") == setting).select(self.by)
                if not keys.isEmpty():
                    parts.append(self.compute(rows.join(keys, self._same(rows, keys), "left_semi"), options).withColumn("setting", F.lit(setting)))
            target = f"{self.root}/results/run={name}"
            reduce(DataFrame.unionByName, parts).write.parquet(target)
            held = self.spark.read.parquet(target).groupBy(self.by, "setting").agg(F.count("*").alias("held"))
            entries = todo.join(held, self._same(todo, held, "setting"), "left").select(todo[self.by], todo["setting"], "fingerprint", F.coalesce("held", F.lit(0)).alias("rows"))
            entries.write.parquet(f"{self.root}/manifest/run={name}")
        where = plan.select(self.by, "setting", F.coalesce("run", F.lit(name)).alias("run"))
        found = self._read("results")
        return found.join(where, self._same(found, where, "setting", "run"), "left_semi").drop("run"), plan.select(self.by, "setting", F.col("run").isNotNull().alias("reused"))
