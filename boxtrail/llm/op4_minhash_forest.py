"""MinHash near-deduplication by an LSH forest.

Every distinct shingle set is a class and gets a signature. Each tree of the forest is one sorted order of all
signatures, rotated by the tree's permutation: rows close in that order share the longest prefixes. A region (the rows that share a tree's shortest
prefix) of few rows is enumerated whole. A larger one is descended by longer prefixes, each of its parts as deep as it takes to leave few rows, whose
pairs are compared, and every row with its neighbour; between what these leave apart, an exact join on the rarest
shingles finds all links. Candidate links are confirmed on the full sets; components follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm.common import Scratch, WordHashes, bounded_batches, components, gram_hashes, maybe_broadcast, mix, table

VALUES = 64  # signature length; 16 bits of each minimum are kept
TREES = 14
PREFIX = 2  # shortest shared prefix of a candidate
REACH = 47  # of a region of at most REACH + 1 rows all pairs are compared; larger ones are descended and then joined exactly
LEAF = 8  # rows of a part of a larger region whose pairs are compared
ENDS = 200_000  # rows at the ends of sorted runs that one task compares; more of them are sorted by range again
BUCKETS = 1 << 20  # of the counts that order shingles by rarity; they decide on the work only, as any order is exact
PARITY = 8  # longs of a set's parity bitmap
SALT = 1_000  # rows of a shingle in one block of the exact join
SLACK = 14  # equal values that a pair at the threshold may lack: over four deviations
BLOCK = 400_000  # shingles hashed at once, for bounded memory


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter sequence counts whole, no words give none."""
    words = hashes.of((text or "").encode().lower().split())
    if len(words) == 0:
        return words
    return np.unique(gram_hashes(words, min(k, len(words))) ^ np.uint64(min(k, len(words))))


def signatures(sets: list[np.ndarray], values: int = VALUES) -> np.ndarray:
    """One row of minima for each non-empty set."""
    odd = mix(np.arange(1, values + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.empty((len(sets), values), np.uint16)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    for j in range(values if sets else 0):
        out[:, j] = mix(np.minimum.reduceat((flat * odd[j]) >> np.uint64(32), starts))
    return out


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def emit(part, sets):
            full = [s for s in sets if len(s)]
            each = iter(signatures(full))
            sig = [next(each).astype(">u2").tobytes() if len(s) else None for s in sets]
            key = [_key(s) if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_key", "sig"])

        for batch in batches:
            start, sets, held = 0, [], 0
            for i, text in enumerate(batch.column(2)):
                sets.append(shingle_set(text.as_py(), k, hashes))
                held += len(sets[-1])
                if held > BLOCK or i + 1 == batch.num_rows:
                    yield emit(batch.slice(start, len(sets)), sets)
                    start, sets, held = i + 1, [], 0

    return run


def _key(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            cids, sets = [], []
            for cid, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingle_set(text.as_py(), k, hashes)
                if len(s) and _key(s) == key:
                    cids.append(cid)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["cid", "members"])

    return run


def tree_order(t: int) -> np.ndarray:
    """The order of the signature's values in a tree: no two trees start alike."""
    return (t * (VALUES // TREES) + np.arange(VALUES) * (2 * t + 1)) % VALUES


def _tree_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class once per tree, under the bytes of its signature in that tree's order."""
    for batch in batches:
        cids = batch.column(0)
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, VALUES)
        for t in range(TREES):
            keys = np.ascontiguousarray(sig[:, tree_order(t)]).view(f"V{2 * VALUES}").ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array([x.tobytes() for x in keys], pa.binary()), cids], ["tree", "key", "cid"])


def _leaves(tree: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each of the sorted rows the end of the rows after it with which it is compared: those of its region of at most REACH + 1 rows, of its part of at
    most LEAF rows of a larger region, at the least prefix that has so few, and always its next neighbour in the region."""
    n = len(tree)
    same = key[1:] == key[:-1]
    shared = np.where(same.all(1), VALUES, same.argmin(1))  # values that a row has in common with the next one, from the first on
    shared[tree[1:] != tree[:-1]] = 0
    last, left, most = np.arange(n) + 1, np.ones(n, bool), REACH + 1
    for depth in range(PREFIX, VALUES + 1):
        starts = np.flatnonzero(np.concatenate([[True], shared < depth]))
        sizes = np.diff([*starts, n])
        few = left & np.repeat(sizes <= most, sizes)
        last[few] = np.repeat(starts + sizes, sizes)[few]
        left &= ~few
        most = LEAF
        if not left.any():
            break
    next_too = np.flatnonzero(shared >= PREFIX)
    last[next_too] = np.maximum(last[next_too], next_too + 2)
    return last


def _neighbours(least: int, edges: bool):
    """Candidates within a sorted run of rows; with edges, also the rows at both ends of the run, whose neighbours another task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "score", "tree", "key"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        tail, first = None, True

        def ends(tree, key, cid):
            n = len(cid)
            return pa.RecordBatch.from_arrays([pa.array(cid, kinds[0]), pa.nulls(n, kinds[1]), pa.nulls(n, kinds[2]), pa.array(tree, kinds[3]), pa.array([k.astype(">u2").tobytes() for k in key], kinds[4])], names)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            tree = batch.column(0).to_numpy(zero_copy_only=False)
            key = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, VALUES).astype(np.uint16)
            cid = batch.column(2).to_numpy(zero_copy_only=False)
            if edges and first:
                yield ends(tree[:REACH], key[:REACH], cid[:REACH])
            old = 0 if tail is None else len(tail[2])
            if old:
                tree, key, cid = (np.concatenate(x) for x in zip(tail, (tree, key, cid), strict=True))
            last, at = _leaves(tree, key), np.arange(len(cid))
            for j in range(1, REACH + 1):
                x = np.flatnonzero(last > at + j)
                x = x[x + j >= old]  # pairs that end in the old rows were seen with the batch before
                y = x + j
                score = (key[x] == key[y]).sum(1)
                hit = score >= least
                p, q, n = cid[x][hit], cid[y][hit], int(hit.sum())
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q), kinds[0]), pa.array(np.maximum(p, q), kinds[1]), pa.array(score[hit].astype(np.int32)), pa.nulls(n, kinds[3]), pa.nulls(n, kinds[4])], names)
            tail, first = tuple(x[-REACH:] for x in (tree, key, cid)), False
        if edges and tail is not None:
            yield ends(*tail)

    return run


def parity(s: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY bits whether an odd number of members falls on it. Two sets differ in at least as many members as their bitmaps in bits."""
    bits = np.bincount((s.view(np.uint64) >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _rarest(counts: np.ndarray, mixed: np.ndarray, threshold: int):
    """Of each set its rarest shingles: a partner of at most its size that reaches the threshold has one of them among its own short ones. Shingles of buckets
    that are not mixed, of one set or of sets of one root, can't bring two roots together and are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["s", "cid", "root", "n", "at", "short", *(f"p{i}" for i in range(PARITY))], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        for batch in batches:
            for cid, root, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = members.values.to_numpy(zero_copy_only=False)
                n, bits = len(s), parity(s)
                s = s[np.lexsort((s, counts[s & (BUCKETS - 1)]))][: n + 1 - -(-threshold * n // 100)]
                at = np.arange(len(s), dtype=np.int32)
                short = at < n + 1 - -(-2 * threshold * n // (100 + threshold))
                live = mixed[s & (BUCKETS - 1)]
                if not live.any():
                    continue
                s, at, short = s[live], at[live], short[live]
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array([cid] * len(s), kinds[1]), pa.array([root] * len(s), kinds[2]), pa.array(np.full(len(s), n, np.int64)), pa.array(at), pa.array(short), *(pa.array(np.full(len(s), p)) for p in bits)], names)

    return run


def _exact_pairs(big: DataFrame, scratch: Scratch, threshold: int) -> DataFrame:
    """(a, b, ra, rb) with a < b: all pairs of big (cid, root, members) that can reach the threshold and have two roots. Two sets that reach it
    share one of the rarest shingles of each (Xiao et al. 2008), by any one order; after the first of those enough others must be left, and their
    parity bitmaps (Sandes et al. 2020) may differ in no more bits than the sets in members."""
    seen = big.select("root", F.explode("members").alias("s")).groupBy(F.col("s").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("mixed")).where("n > 1").toArrow()
    counts, mixed = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, bool)
    counts[seen["bucket"].to_numpy()] = np.minimum(seen["n"].to_numpy(), 2**31 - 1)
    mixed[seen["bucket"].to_numpy()] = seen["mixed"].to_numpy()
    rare = scratch.save(big.select("cid", "root", "members").mapInArrow(_rarest(counts, mixed, threshold), "s long, cid long, root long, n long, at int, short boolean, " + ", ".join(f"p{i} long" for i in range(PARITY))), "rare")
    used = rare.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows"), F.bool_or("short").alias("any"))
    used = used.where("lo <> hi and any").select("s", F.ceil(F.col("rows") / SALT).cast("int").alias("blocks"))
    rare = scratch.save(rare.join(used, "s"), "shared")
    x = rare.select("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("cid").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("at").alias("ix"), *(F.col(f"p{i}").alias(f"px{i}") for i in range(PARITY)))
    y = rare.where("short").select("s", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"), F.col("cid").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("at").alias("iy"), *(F.col(f"p{i}").alias(f"py{i}") for i in range(PARITY)))
    apart = " + ".join(f"bit_count(px{i} ^ py{i})" for i in range(PARITY))
    near = f"rx <> ry and (ny < nx or (ny = nx and y < x)) and 100 * ny >= {threshold} * nx and {100 + threshold} * least(nx - ix, ny - iy) >= {threshold} * (nx + ny)"
    near += f" and {100 + threshold} * ({apart}) <= {100 - threshold} * (nx + ny)"
    found = x.join(y, ["s", "block"]).where(near)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.expr("if(x < y, rx, ry)").alias("ra"), F.expr("if(x < y, ry, rx)").alias("rb")).distinct()


PAIRS = "a long, b long, score int, tree int, key binary"


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    docs needs doc_id (long) and text; other columns are ignored. Two rows are linked when
    100 * intersection >= threshold * union of their sets of k-word shingles. component_id is the
    smallest doc_id reachable; kept marks the row whose id it is. Empty or null texts have no set and
    stay alone. Copies (rows with equal sets) are one class, so no pairs of copies are made. Every row counts by its own text:
    rows that share an id link what each of them resembles, and rows without one link others too. Where no row of a component has an id,
    component_id is null and all are kept. An empty table gives no rows.

    Each class costs TREES sorted keys of 2 * VALUES bytes; a pair at the threshold shares no region in any tree with a
    probability of (1 - (threshold / 100) ** PREFIX) ** TREES (below 1e-7 for 85, 1e-6 for 80), and in a region of at most REACH + 1 rows it is dropped by its estimate (SLACK) with
    2e-6 for 85 and 1.4e-5 for 80. Rows of larger regions are joined exactly, so nothing is lost there. Every confirmed link is exact.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    signed = scratch.save(slim.mapInArrow(_sign(k), "doc_id long, text_hash long, n_shingles long, set_key binary, sig binary"), "signed")
    grouped = signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = scratch.save(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    roots = _linked_classes(spark, slim, classes, scratch, k, threshold)
    joined = roots.join(classes.select(F.col("cid").alias("node"), "set_key", "least"), "node")
    lowest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = joined.select("root", "set_key").join(lowest, "root").select("set_key", "component_id")
    copies = classes.where("copies > 1").select("set_key", "least").join(linked, "set_key", "full")
    shared = copies.select("set_key", F.coalesce("component_id", "least").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(shared, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _linked_classes(spark: SparkSession, slim: DataFrame, classes: DataFrame, scratch: Scratch, k: int, threshold: int) -> DataFrame:
    """(node, root) of the classes that have a link."""
    least = max(PREFIX, int(VALUES * threshold / 100) - SLACK)
    keys = scratch.save(classes.select("cid", "sig").mapInArrow(_tree_keys, "tree int, key binary, cid long"), "keys")
    order = ["tree", "key", "cid"]
    found = scratch.save(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(least, True), PAIRS), "found")
    met, level = found.where("b is not null").select("a", "b", "score"), found
    for step in range(20):  # a few rows of each partition are left each time, at last one partition's
        ends = level.where("b is null").select("tree", "key", F.col("a").alias("cid")).distinct()
        parts = 1 + ends.count() // ENDS
        dealt = ends.repartitionByRange(parts, *order) if parts > 1 else ends.coalesce(1)
        level = scratch.save(dealt.sortWithinPartitions(*order).mapInArrow(_neighbours(least, parts > 1), PAIRS), f"across{step}")
        met = met.union(level.where("b is not null").select("a", "b", "score"))
        if parts == 1:
            break
    regions = keys.select("tree", F.substring("key", 1, 2 * PREFIX).alias("start"), "cid")
    crowded = scratch.save(regions.groupBy("tree", "start").agg(F.count("*").alias("n")).where(F.col("n") > REACH + 1).select("tree", "start"), "crowded")
    dense = scratch.save(regions.join(maybe_broadcast(crowded, crowded.count()), ["tree", "start"], "left_semi").select("cid").distinct(), "dense")
    pairs = scratch.save(met.where("a <> b").groupBy("a", "b").agg(F.max("score").alias("score"), F.count("*").alias("trees")), "pairs")
    scratch.drop("keys", "found")

    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(dense).distinct().join(classes.select("cid", "set_key", F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash")), "cid")
    wanted = scratch.save(wanted, "wanted")
    want = maybe_broadcast(wanted, wanted.count())
    # a class is fetched by one of its texts; what else answers to that id and hash has another set, or an equal one
    one_of = slim.doc_id.eqNullSafe(F.col("one_id")) & (F.col("text_hash") == F.col("one_hash"))
    sets = slim.join(want, one_of).select("cid", "set_key", "text").mapInArrow(_full_sets(k), "cid long, members array<long>")
    sets = scratch.save(sets.groupBy("cid").agg(F.first("members").alias("members")), "sets")

    def confirmed(some: DataFrame) -> DataFrame:
        left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
        n, both = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
        return some.join(left, "a").join(right, "b").where(100 * n >= threshold * (both - n)).select("a", "b")

    def linked(tried: DataFrame) -> DataFrame:
        """Components of the confirmed ones of the tried pairs (a, b) of classes in the components (ra, rb)."""
        links = confirmed(tried.select("a", "b")).join(tried, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        return components(spark, links, scratch)

    # First the pairs that are likely links, and each class with its best neighbour; then only pairs that still cross.
    sides = pairs.union(pairs.select("b", "a", "score", "trees"))
    best = sides.groupBy("a").agg(F.max_by("b", F.struct("score", "trees", F.xxhash64("a", "b"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    likely = pairs.where(100 * F.col("score") >= VALUES * threshold).select("a", "b").union(best).distinct()
    tried = scratch.save(likely.withColumns({"ra": F.col("a"), "rb": F.col("b")}), "tried")
    labels = scratch.save(linked(tried), "labels")
    ra, rb = labels.toDF("a", "ra"), labels.toDF("b", "rb")
    rest = pairs.select("a", "b").join(tried.select("a", "b"), ["a", "b"], "left_anti")
    rest = rest.join(ra, "a", "left").join(rb, "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}).where("ra <> rb").select("a", "b", "ra", "rb")
    # Texts made from one another resemble all of their kind, but reach the threshold with few of them: in dense regions all that can are found.
    big = sets.join(dense, "cid", "left_semi").join(labels.toDF("cid", "root"), "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"), "members")
    rest = scratch.save(rest.union(_exact_pairs(big, scratch, threshold)).distinct(), "rest")
    found = linked(rest)
    top = found.toDF("root", "top")
    grown = labels.union(found.toDF("node", "root").join(labels.select("node"), "node", "left_anti"))
    return scratch.save(grown.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=85)


#: The same rows by counting the shingles that any two rows have in common.
OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS gram
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - least(3, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.gram = y.gram AND x.r <> y.r GROUP BY x.r, y.r),
link AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON d.r = b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, component_id IS NULL) AS kept
FROM d JOIN low ON a = d.r LEFT JOIN n ON n.r = d.r
"""
