"""Merkle manifest of a dataset, with a proof for each row.

Leaves are numbered within their group over range partitions. Each task goes through its consecutive leaves with a mountain range: a stack
in which a run of FANOUT nodes that is complete is carried up into one node. What a task has of a run that others hold too stays on the
stack as peaks of several heights. Peaks of all tasks are merged by their common ancestor, STEP levels at a time, so
that a group of the merge has a bounded number of rows. No run is padded: the last run of a level is as short as it is. A leaf's proof is
its siblings below its peak, which its task knows, and those of the peak, which the merge gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm.common import Scratch, bounded_batches, maybe_broadcast, table

FANOUT = 2
STEP = 12  # levels of a task's peaks, and of one round of the merge
TAMPERED = 7  # rows whose checksum this divides are tampered with


def digest(parts: list[bytes]) -> bytes:
    """The hash of nodes, which go in as hexadecimal text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def run_of(at: int, n: int, fanout: int) -> tuple[int, int]:
    """First node of the run of node at, and one past its last, on a level of n nodes."""
    first = at - at % fanout
    return first, min(first + fanout, n)


def carry(stack: list[tuple[int, int, bytes]], n: int, level: int, fanout: int, top: int, made: dict) -> None:
    """Carries complete runs at the top of the stack of (level, at, hash) into their parents, up to level top. n: nodes of the top node's level.
    made gets each parent with its children."""
    while n > 1 and level < top:
        at = stack[-1][1]
        first, end = run_of(at, n, fanout)
        if at + 1 != end or len(stack) < end - first or stack[first - end][:2] != (level, first):
            return
        run = stack[first - end :]
        del stack[first - end :]
        level, n = level + 1, -(-n // fanout)
        stack.append((level, first // fanout, digest([h for _, _, h in run])))
        made[level, first // fanout] = run


def below(peak: tuple[int, int, bytes], made: dict) -> Iterator[tuple[int, int, bytes]]:
    """(level, at, siblings up to the peak) of all that was put on the stack under a peak."""
    todo = [(peak, b"")]
    while todo:
        (level, at, _), path = todo.pop()
        run = made.get((level, at))
        if run is None:
            yield level, at, path
            continue
        for k, node in enumerate(run):
            todo.append((node, b"".join(h for _, _, h in run[:k] + run[k + 1 :]) + path))


PEAK = "level int, at long, top binary, siblings binary"


def _mountains(fanout: int, step: int, n_columns: int):
    """Rows (g, n, idx, hash, ...) in order of g and idx, each with its peak and the siblings below it; the first row of a peak has the peak's hash."""
    block = fanout**step

    def flush(held: list[pa.RecordBatch], start: int, n: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        stack, made = [], {}
        for i, h in enumerate(rows.column(3).to_pylist()):
            stack.append((0, start + i, h))
            carry(stack, n, 0, fanout, step, made)
        level, at, top, siblings = ([None] * len(rows) for _ in range(4))
        for peak in stack:
            own = []
            for _, i, path in below(peak, made):
                own.append(i - start)
                level[i - start], at[i - start], siblings[i - start] = peak[0], peak[1], path
            top[min(own)] = peak[2]
        more = [pa.array(level, pa.int32()), pa.array(at, pa.int64()), pa.array(top, pa.binary()), pa.array(siblings, pa.binary())]
        return pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, "level", "at", "top", "siblings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, where, begun = [], None, 0  # where: (g, n, next idx)
        for batch in batches:
            groups, sizes, at = (batch.column(i).to_pylist() for i in range(3))
            first = 0
            for i in range(batch.num_rows):
                if where != (groups[i], sizes[i], at[i]) or at[i] % block == 0:  # another group or block, or rows between that another task has
                    if i > first:
                        held.append(batch.slice(first, i - first))
                    if held:
                        yield flush(held, begun, where[1])
                    held, first, begun = [], i, at[i]
                where = (groups[i], sizes[i], at[i] + 1)
            if batch.num_rows > first:
                held.append(batch.slice(first))
        if held:
            yield flush(held, begun, where[1])

    return run


def _lifted(fanout: int, high: int):
    """Of all nodes under one ancestor of level high (or the root, if that is lower): each with its siblings up to the ancestor, and the ancestor's hash on the first."""

    def run(group: pa.Table) -> pa.Table:
        g, n = group.column("g")[0].as_py(), group.column("n")[0].as_py()
        nodes = sorted(zip(group.column("level").to_pylist(), group.column("at").to_pylist(), group.column("hash").to_pylist(), strict=True), key=lambda x: x[1] * fanout ** x[0])
        stack, made = [], {}
        for node in nodes:
            stack.append(node)
            carry(stack, -(-n // fanout ** node[0]), node[0], fanout, high, made)
        (peak,) = stack
        rows = list(below(peak, made))
        return pa.table(
            {
                "g": pa.array([g] * len(rows), pa.string()),
                "n": pa.array([n] * len(rows), pa.int64()),
                "level": pa.array([r[0] for r in rows], pa.int32()),
                "at": pa.array([r[1] for r in rows], pa.int64()),
                "path": pa.array([r[2] for r in rows], pa.binary()),
                "up_level": pa.array([peak[0]] * len(rows), pa.int32()),
                "up_at": pa.array([peak[1]] * len(rows), pa.int64()),
                "up_hash": pa.array([peak[2]] + [None] * (len(rows) - 1), pa.binary()),
            }
        )

    return run


LIFTED = "g string, n long, level int, at long, path binary, up_level int, up_at long, up_hash binary"


def numbered(leaves: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """leaves (g, ..., hash) with idx, the place within g by order and hash, and n, the rows of g. Places come from range partitions and their
    counts; equal rows are spread over partitions, and may stand in any order among themselves."""
    columns = leaves.columns
    order = ["g", *order, "hash", "tie"]
    rows = scratch.save(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    local = F.monotonically_increasing_id()
    ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    ranked = scratch.save(ranked.withColumns({"part": F.shiftright(local, 33), "pos": local.bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    counts = ranked.groupBy("g", "part").agg(F.count("*").alias("c"), F.min("pos").alias("first"))  # one row for each group and partition that meet
    before = F.expr("sum(c) OVER (PARTITION BY g ORDER BY part) - c - first")
    bases = scratch.save(counts.select("g", "part", before.alias("base"), F.expr("sum(c) OVER (PARTITION BY g)").alias("n")), "bases")
    return ranked.join(maybe_broadcast(bases, bases.count()), ["g", "part"]).select("g", "n", (F.col("base") + F.col("pos")).alias("idx"), "hash", *[c for c in columns if c not in ("g", "hash")])


def proofs(leaves: DataFrame, order: list[str], scratch: Scratch, fanout: int = FANOUT, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """(rows, peaks) of one tree for each g. leaves: g (not null), hash (binary) and others. rows: the leaves with n, idx, level, at and siblings, those up to
    the peak (level, at); peaks: g, level, at, path and root, the siblings from there on and the hash of g's whole tree."""
    spark = leaves.sparkSession
    bounded_batches(spark)
    placed = numbered(leaves, order, scratch)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    rows = scratch.save(placed.repartitionByRange("g", "idx").sortWithinPartitions("g", "idx").mapInArrow(_mountains(fanout, step, len(placed.columns)), f"{kinds}, {PEAK}"), "rows")
    nodes = rows.where("top IS NOT NULL").select("g", "n", "level", "at", F.col("top").alias("hash"))
    largest = rows.agg(F.max("n")).first()[0] or 1
    height, width = 0, 1
    while width < largest:
        height, width = height + 1, width * fanout
    lifted, high = [], step
    while True:
        nodes = nodes.withColumn("up", F.floor(F.col("at") / F.pow(F.lit(float(fanout)), F.lit(high) - F.col("level"))))
        up = scratch.save(nodes.where(F.col("level") < high).groupBy("g", "up").applyInArrow(_lifted(fanout, high), LIFTED), "lifted")
        lifted.append(up)
        done = up.where("up_hash IS NOT NULL").select("g", "n", F.col("up_level").alias("level"), F.col("up_at").alias("at"), F.col("up_hash").alias("hash"))
        nodes = scratch.save(nodes.where(F.col("level") >= high).drop("up").unionByName(done), "nodes")
        if high >= height:
            break
        high += step
    roots = nodes.select("g", F.col("hash").alias("root"))  # one node is left of each tree
    above = nodes.select("g", "level", "at", F.lit(b"").alias("path"))
    for up in reversed(lifted):
        known = above.select("g", F.col("level").alias("up_level"), F.col("at").alias("up_at"), F.col("path").alias("more"))
        fuller = up.join(known, ["g", "up_level", "up_at"]).where(~((F.col("level") == F.col("up_level")) & (F.col("at") == F.col("up_at")))).select("g", "level", "at", F.concat("path", "more").alias("path"))
        above = above.unionByName(fuller)
    return rows, above.join(roots, "g")


def leaf_text(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in (doc_id, source, lang, n_chars, text))])


def _finished(fanout: int):
    def folded(value: bytes, path: bytes, trees: list[tuple[int, int]]) -> bytes:
        """The root that a leaf and its siblings give. trees: (place, leaves) of the leaf in its tree, of that tree's root in the next."""
        used = 0
        for at, n in trees:
            while n > 1:
                first, end = run_of(at, n, fanout)
                run = [path[i : i + 32] for i in range(used, used + 32 * (end - first - 1), 32)]
                used += 32 * len(run)
                run.insert(at - first, value)
                value, at, n = digest(run), at // fanout, -(-n // fanout)
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaves, tampered, at, n, at2, n2, siblings, path, path2, subroots, roots = (c.to_pylist() for c in batch.columns)
            proof, fold = [], []
            for i in range(batch.num_rows):
                whole = siblings[i] + path[i] + path2[i]
                proof.append(hashlib.sha256(whole.hex().encode()).hexdigest())
                fold.append(folded(tampered[i] or leaves[i], whole, [(at[i], n[i]), (at2[i], n2[i])]))
            texts = [[v.hex() for v in c] for c in (leaves, subroots, roots)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(t, pa.string()) for t in texts), pa.array(proof, pa.string()), pa.array([f.hex() for f in fold], pa.string()), pa.array([f == r for f, r in zip(fold, roots, strict=True)], pa.bool_())],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return run


def manifest(docs: DataFrame, tampered: int | None = TAMPERED, fanout: int = FANOUT, step: int = STEP) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    docs needs doc_id, source, lang, n_chars and text; other columns are ignored. A leaf is the hash of these five, nulls apart from empty texts.
    Rows of one lang (nulls are one of their own) make a tree in order of doc_id, rows without one first and those of the same by their leaf; the roots of these trees make
    another in order of lang. folded_root is what the row's leaf and its siblings give, after 1 was added to n_chars of each row
    whose checksum of doc_id tampered divides; rows without a doc_id or n_chars stay as they are. Repeated rows have a place each. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    five = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = F.unhex(F.sha2(leaf_text(*five), 256))
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    other = F.unhex(F.sha2(leaf_text(*five[:3], more, five[4]), 256))
    hit = F.lit(False) if tampered is None else F.coalesce(F.crc32(F.col("doc_id").cast("string")) % tampered == 0, F.lit(False))
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # no lang comes first
    leaves = docs.select(lang.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("hash"), F.when(hit & F.col("n_chars").isNotNull(), other).alias("tampered"))
    rows, peaks = proofs(leaves, ["doc_id"], scratch, fanout, step)
    peaks = scratch.save(peaks, "peaks")
    subroots = peaks.groupBy("g").agg(F.first("root").alias("root")).select(F.lit("").alias("g"), F.col("g").alias("lang"), F.col("root").alias("hash"))
    trees, tops = proofs(subroots, ["lang"], scratch, fanout, step)
    tops = trees.join(tops.withColumnRenamed("root", "whole"), ["g", "level", "at"]).select(F.col("lang").alias("g"), F.col("idx").alias("idx2"), F.col("n").alias("n2"), F.concat("siblings", "path").alias("path2"), "whole")
    upper = scratch.save(peaks.join(tops, "g"), "upper")
    out = rows.join(upper, ["g", "level", "at"]).select("doc_id", "hash", "tampered", "idx", "n", "idx2", "n2", "siblings", "path", "path2", "root", "whole")
    return out.mapInArrow(_finished(fanout), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


#: The same rows: trees level by level over all nodes, checksums byte by byte over a table made from the polynomial.
OP12_SQL = f"""
WITH RECURSIVE
bits AS (SELECT i AS byte, 0 AS step, i AS v FROM range(256) t(i) UNION ALL SELECT byte, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY byte) AS t FROM bits WHERE step = 8),
fields AS (SELECT row_number() OVER () AS r, doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS body, strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) AS more, coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM documents, crc),
leaves AS MATERIALIZED (SELECT r, doc_id, lang, sha256(head || body || tail) AS leaf, CASE WHEN h % {TAMPERED} = 0 AND n_chars IS NOT NULL THEN sha256(head || more || tail) ELSE sha256(head || body || tail) END AS held FROM fields),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (SELECT lang, 0 AS level, i, n, leaf AS h FROM placed UNION ALL SELECT lang, level + 1, i // {FANOUT}, any_value((n + {FANOUT - 1}) // {FANOUT}), sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // {FANOUT}),
subs AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, i, n, subroot AS h FROM subs UNION ALL SELECT level + 1, i // {FANOUT}, any_value((n + {FANOUT - 1}) // {FANOUT}), sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // {FANOUT}),
allnodes AS MATERIALIZED (SELECT lang, 0 AS tree, level, i, h FROM nodes UNION ALL SELECT s.lang, 1, t.level, t.i, t.h FROM tops t, subs s),
walk AS (
  SELECT r, lang, 0 AS tree, 0 AS level, i, n, held AS value, '' AS seen FROM placed
  UNION ALL
  SELECT r, lang, CASE WHEN n > 1 THEN tree ELSE 1 END, CASE WHEN n > 1 THEN level + 1 ELSE 0 END, CASE WHEN n > 1 THEN i // {FANOUT} ELSE s END, CASE WHEN n > 1 THEN (n + {FANOUT - 1}) // {FANOUT} ELSE sn END,
    CASE WHEN n > 1 THEN sha256(left_h || value || right_h) ELSE value END, seen || CASE WHEN n > 1 THEN left_h || right_h ELSE '' END
  FROM (SELECT w.*, s.i AS s, s.n AS sn, CASE WHEN w.i % 2 = 1 THEN coalesce(b.h, '') ELSE '' END AS left_h, CASE WHEN w.i % 2 = 0 THEN coalesce(b.h, '') ELSE '' END AS right_h
    FROM walk w JOIN subs s ON s.lang IS NOT DISTINCT FROM w.lang LEFT JOIN allnodes b ON b.lang IS NOT DISTINCT FROM w.lang AND b.tree = w.tree AND b.level = w.level AND b.i = xor(w.i, 1)
    WHERE w.n > 1 OR w.tree = 0)),
done AS (SELECT r, value AS folded_root, sha256(seen) AS proof_sha256 FROM walk WHERE tree = 1 AND n = 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN done USING (r) JOIN subs s ON s.lang IS NOT DISTINCT FROM p.lang, (SELECT h AS root FROM tops WHERE n = 1)
"""
