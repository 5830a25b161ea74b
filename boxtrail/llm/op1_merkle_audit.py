"""Merkle fixity audit of WARC replicas.

Records lie at ordered offsets in WARC files. The manifest fixes for each record its file, its place in the file and its offset; a replica's
leaf is the hash of the record's bytes found there. Nodes hash FANOUT children each with the range of offsets that
they span, level by level up to one root per file, and FANOUT files at a time up to one root of all. Two replicas are
compared from the top: a level is only looked at below the nodes of the level above that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm.common import Scratch, table

FANOUT = 16
FILE_LEVELS = 2
FILE_RECORDS = FANOUT**FILE_LEVELS  # records of a WARC file


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a response record; a null url has no header, a null body is empty."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    target = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\n"), target, F.lit("Content-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def lay_out(records: DataFrame, scratch: Scratch) -> DataFrame:
    """records (page_id, hash, size, ...) with file, slot, start and end: all in order of page_id and hash, FILE_RECORDS to a file.

    Equal rows lie one after the other. Ranks come from range partitions and their sizes, so that no task sees more than a
    partition; offsets from windows over one file.
    """
    columns = records.columns
    counted = records.groupBy(*columns).agg(F.count("*").alias("copies")).withColumn("n", F.explode(F.expr("sequence(1L, copies)"))).drop("copies")
    order = ["page_id", "hash", *(c for c in columns if c not in ("page_id", "hash")), "n"]
    local = F.monotonically_increasing_id()
    ranked = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = scratch.save(ranked.withColumns({"part": F.shiftright(local, 33), "at": local.bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    before, starts = 0, []
    for row in sorted(ranked.groupBy("part").agg((F.max("at") + 1).alias("n")).collect()):  # two numbers for each partition
        starts.append((row["part"], before))
        before += row["n"]
    bases = ranked.sparkSession.createDataFrame(starts or [(0, 0)], "part long, base long")
    rank = F.col("base") + F.col("at")
    placed = ranked.join(bases, "part").select(*columns, F.floor(rank / FILE_RECORDS).alias("file"), (rank % FILE_RECORDS).cast("int").alias("slot"))
    placed = placed.withColumn("end", F.expr("sum(size) OVER (PARTITION BY file ORDER BY slot)"))
    return scratch.save(placed.withColumn("start", F.col("end") - F.col("size")), "listed")


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above: (node, start, end, hash) of FANOUT nodes each; a node's hash covers its children's, with their offsets, in order."""
    child = F.struct("node", F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), "hash").alias("text"))
    return nodes.groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: x["text"]), ","), 256).alias("hash")
    )


def tree(leaves: DataFrame, levels: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """Levels of the tree over (node, start, end, hash), from the leaves to the root; children of node i are FANOUT * i onwards."""
    out = [leaves]
    for level in range(levels):
        out.append(scratch.save(_parents(out[-1]), f"{name}{level}"))
    return out


def differing_leaves(good: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """(node, expected, found) of leaves that differ. Each level is first joined to the differing nodes above, so that equal branches are not looked at."""
    found = None
    for a, b in zip(reversed(good), reversed(other), strict=True):
        if found is not None:
            above = found.select(F.col("node").alias("up"))
            a, b = (x.withColumn("up", F.floor(F.col("node") / FANOUT)).join(above, "up", "left_semi") for x in (a, b))
        a, b = a.select("node", F.col("hash").alias("expected")), b.select("node", F.col("hash").alias("found"))
        found = a.join(b, "node", "full").where(~F.col("expected").eqNullSafe(F.col("found")))
    return found


def audit(listed: DataFrame, replica: DataFrame) -> DataFrame:
    """One row for each damaged record: page_id, file, slot, start_offset, end_offset, expected, found, status.

    listed is the manifest (page_id, file, slot, start, end, hash) with one row per file and slot, replica has file, slot and the hash of the bytes that lie
    there, null or no row where nothing does; other columns are ignored. status is altered, missing, or extra for a place that the manifest doesn't have. Equal
    replicas and empty tables give no rows. A record that lies in the replica twice is an error of the reader, not of this audit.
    """
    scratch = Scratch(listed.sparkSession)
    node = (F.col("file") * FILE_RECORDS + F.col("slot")).alias("node")
    last = listed.agg(F.max("file")).first()[0] or 0
    levels, reach = FILE_LEVELS, 1
    while reach <= last:
        levels, reach = levels + 1, reach * FANOUT
    places = listed.select("page_id", "file", "slot", "start", "end", node, "hash")
    good = places.select("node", "start", "end", "hash")
    held = replica.where("hash is not null").select(node, "hash")
    other = held.join(places.select("node", "start", "end"), "node", "left").select("node", "start", "end", "hash")
    found = differing_leaves(tree(good, levels, scratch, "a"), tree(other, levels, scratch, "b"))
    out = found.join(places.drop("hash"), "node", "left")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("altered")
    return out.select(
        "page_id",
        F.floor(F.col("node") / FILE_RECORDS).alias("file"),
        (F.col("node") % FILE_RECORDS).cast("int").alias("slot"),
        F.col("start").alias("start_offset"),
        F.col("end").alias("end_offset"),
        "expected",
        "found",
        status.alias("status"),
    )


def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a second copy of all pages. The tables hold one copy only, so the other is derived: the body of some pages is
    altered in its first character and some records are lost, by fixed rules on page_id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    bad = F.when(F.col("page_id") % 53 == 7, F.concat(F.lit("~"), F.substring("html", 2, 2147483647))).otherwise(F.col("html"))
    copy = F.when(F.coalesce(F.col("page_id") % 59 != 11, F.lit(True)), F.sha2(warc_record(F.col("page_id"), F.col("url"), bad), 256))
    records = pages.select("page_id", F.sha2(record, 256).alias("hash"), F.length(record).cast("long").alias("size"), copy.alias("copy"))
    listed = lay_out(records, Scratch(spark))
    return audit(listed, listed.select("file", "slot", F.col("copy").alias("hash")))


#: The same rows by comparing all records.
OP1_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
    || coalesce('WARC-Target-URI: ' || url || chr(13) || chr(10), '') || 'Content-Length: ' AS head, chr(13) || chr(10) || chr(13) || chr(10) AS gap FROM pages),
r AS (
  SELECT page_id, head || strlen(html) || gap || html || gap AS record,
    CASE WHEN page_id % 53 = 7 THEN head || strlen('~' || substr(html, 2)) || gap || '~' || substr(html, 2) || gap ELSE head || strlen(html) || gap || html || gap END AS copy FROM p),
h AS (SELECT page_id, sha256(record) AS expected, strlen(record) AS size, CASE WHEN page_id % 59 = 11 THEN NULL ELSE sha256(copy) END AS found FROM r),
n AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, expected) - 1 AS n FROM h),
l AS (SELECT *, n // {FILE_RECORDS} AS file, (n % {FILE_RECORDS})::INTEGER AS slot, sum(size) OVER (PARTITION BY n // {FILE_RECORDS} ORDER BY n) AS stop FROM n)
SELECT page_id, file, slot, (stop - size)::BIGINT AS start_offset, stop::BIGINT AS end_offset, expected, found, CASE WHEN found IS NULL THEN 'missing' ELSE 'altered' END AS status
FROM l WHERE found IS DISTINCT FROM expected
"""
