"""MinHash near-duplicate groups (operator 9).

SuperMinHash: each shingle walks the signature's slots in a permutation of its own and offers slot p_j the
rank j plus a random fraction. Level j beats every later level, so a slot that is filled is final and a
document stops as soon as all its slots are (early stopping). Permutations are affine modulo the prime SLOTS.
30 bands of 6 slots find a pair of similarity 0.85 but for a chance of 7e-7; banded pairs are then confirmed
on full shingle sets and grouped by union-find.

Scale: exact copies (equal sets) collapse first by a partial aggregation. A bucket gives one edge for each
member, to its smallest, never all pairs. Components of these edges are blocks; sets meet only inside a
block, large blocks are cut into chunk pairs of bounded size, and each task returns a spanning forest.

Nodes are classes of equal sets: named by their smallest id, or, where classes share one, by numbers that are given once
and checkpointed. So rows that share a doc_id but not a set keep apart, and every class is compared by a text of its own.

Defined results: null and word-less texts have no shingles and no links; repeated rows are copies; rows that share a
doc_id are documents of their own, linked by their texts alone; a null doc_id comes before all others as the smallest
of a group; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SLOTS, BANDS, ROWS = 181, 30, 6
#: Members of a block that meet in one task at most (two chunks of as many).
CHUNK = 1500
#: Copies that a class has at least to be joined by broadcast.
LARGE = 256


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of k words of each text; the whole sequence if it has fewer."""
    data = C.LOWER[data]
    starts, ends, at = C.words(data, off)
    h = C.span(C.prefix(C.BYTE_KEYS[data]), starts, ends)
    s = C.prefix(h)
    full = C.span(s, np.arange(max(0, len(h) - k + 1)), np.arange(k, len(h) + 1)) if len(h) >= k else h[:0]
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(full[a : b - k + 1]))
        else:
            out.append(C.span(s, np.array([a]), np.array([b])) if b > a else full[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash of each set: SLOTS values, the level in the upper 32 bits."""
    n = len(sets)
    none = np.uint64(2**64 - 1)
    sig = np.full(n * SLOTS, none, np.uint64)
    doc = np.repeat(np.arange(n), [len(x) for x in sets])
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    a, b = C.mix(h + np.uint64(1)), C.mix(h ^ np.uint64(0x5851F42D4C957F2D))
    step, slot = (a % np.uint64(SLOTS - 1)).astype(np.int64) + 1, (b % np.uint64(SLOTS)).astype(np.int64)
    for j in range(SLOTS):
        if not len(h):
            break
        at = doc * SLOTS + slot
        free = np.flatnonzero(sig[at] == none)
        v = C.mix(h[free] + np.uint64(0x9E3779B97F4A7C15 * (j + 2) % 2**64)) >> np.uint64(32)
        np.minimum.at(sig, at[free], v | np.uint64(j << 32))
        open_docs = (sig.reshape(n, SLOTS) == none).any(axis=1)
        keep = open_docs[doc]
        if not keep.all():
            h, doc, step, slot = h[keep], doc[keep], step[keep], slot[keep]
        slot = (slot + step) % SLOTS
    return sig.reshape(n, SLOTS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    parts = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
    for i in range(ROWS):
        x = C.mix(x * np.uint64(C.MULT) + parts[:, :, i])
    return x.view(np.int64)


def _sketch(k: int):
    def run(batches):
        C.take_turn("near_dedup")
        for batch in batches:
            data, off = C.flat(batch.column(1))
            for i, j in C.blocks(off):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                sig = signatures(sets)
                keys = band_keys(sig)
                empty = [not len(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).cast(pa.int64()),
                        batch.column(2).slice(i, j - i),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([int(x.sum(dtype=np.uint64).view(np.int64)) for x in sets], pa.int64()),
                        pa.array([int(np.bitwise_xor.reduce(C.mix(x)).view(np.int64)) if len(x) else 0 for x in sets], pa.int64()),
                        pa.array([None if e else list(r) for e, r in zip(empty, keys.tolist(), strict=True)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "k1", "k2", "bands"],
                )

    return run


def _packed(batches):
    C.take_turn("near_dedup")
    for batch in batches:
        col = C.as_binary(batch.column(2)).fill_null(b"")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([C.pack(x) for x in col.to_pylist()], pa.binary())], ["id", "text_hash", "z"])


class Forest:
    """Union-find; the smaller index is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def links(sets: list[np.ndarray], percent: int, side: list[int] | None = None):
    """Index pairs that span the groups of `sets` linked by 100 * intersection >= percent * union.

    Exact. Each set is compared with all that are not yet in its group, by bit sets over the shingles that
    at least two sets have. side: 0 or 1; pairs are then looked for between sides only."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    if n == 2:
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * inter >= percent * (int(size.sum()) - inter) else []
    allh = np.concatenate(sets)
    word, inv, cnt = np.unique(allh, return_inverse=True, return_counts=True)
    col = np.cumsum(cnt > 1) - 1
    shared = cnt > 1
    width = int(shared.sum())
    bits = np.zeros((n, (width + 63) // 64 + 1), np.uint64)
    row = np.repeat(np.arange(n), size)
    on = shared[inv]
    c = col[inv[on]]
    np.bitwise_or.at(bits, (row[on], c >> 6), np.uint64(1) << (c & 63).astype(np.uint64))
    forest, out = Forest(n), []
    comp = np.arange(n)
    sides = np.array(side) if side is not None else None
    for i in range(n - 1):
        ok = (comp[i + 1 :] != comp[i]) & (100 * np.minimum(size[i + 1 :], size[i]) >= percent * np.maximum(size[i + 1 :], size[i]))
        if sides is not None:
            ok &= sides[i + 1 :] != sides[i]
        js = np.flatnonzero(ok) + i + 1
        if not len(js):
            continue
        inter = np.bitwise_count(bits[js] & bits[i]).sum(axis=1, dtype=np.int64)
        for j in js[100 * inter >= percent * (size[js] + size[i] - inter)].tolist():
            if forest.join(i, j):
                out.append((i, j))
                a, b = comp[i], comp[j]
                comp[comp == b] = a
    return out


def _confirm(k: int, percent: int):
    """Rows (block, i, j, chunk, node, z) sorted by block, i, j: edges (a, b), a < b, that span each task's groups."""

    def group(rows):
        if len(rows) < 2:
            return []
        texts = [C.unpack(r[5]) for r in rows]
        sets = []
        for lo in range(0, len(texts), 256):
            data, off = C.flat(pa.array(texts[lo : lo + 256], pa.binary()))
            sets += shingle_sets(data, off, k)
        side = [int(r[3] == r[2]) for r in rows] if rows[0][1] != rows[0][2] else None
        return [tuple(sorted((rows[a][4], rows[b][4]))) for a, b in links(sets, percent, side)]

    def run(batches):
        C.take_turn("near_dedup")
        rows, out = [], []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][:3] != r[:3]:
                    out += group(rows)
                    rows = []
                rows.append(r)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out + (group(rows) if rows else []))

    return run


def _edges(out):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable. Alternating large and small stars, checkpointed each round.

    A node's neighbours are never collected: its minimum is aggregated and joined back."""
    e = C.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        e = C.cut(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def with_hot(many: DataFrame, one: DataFrame, keys: list[str], how: str) -> DataFrame:
    """many joined with one, whose keys are unique and whose column n counts the rows that they have in many.

    Keys with a thousandth of all rows or more (so 1000 at most) are joined by broadcast, the rest by shuffle."""
    total = one.agg(F.sum("n")).first()[0] or 0
    big = F.col("n") >= max(LARGE, total / 1000)
    hot = F.broadcast(one.where(big).drop("n"))
    return many.join(hot, keys).unionByName(many.join(hot, keys, "left_anti").join(one.where(~big).drop("n"), keys, how))


def near_groups(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    C.tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    sk = docs.mapInArrow(_sketch(shingle_words), "doc_id long, text_hash long, n_shingles long, k1 long, k2 long, bands array<long>")
    sk = C.cut(sk.withColumn("id", F.coalesce("doc_id", F.lit(C.NULL_ID))))
    some = sk.where("n_shingles > 0")
    # one row for each class of equal sets; copies meet in partial aggregations, not in a join
    reps = some.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min_by(F.struct("bands", "text_hash"), "id").alias("one"), F.count("*").alias("n"))
    reps = C.cut(reps.select("k1", "k2", "id", "n", "one.*", F.monotonically_increasing_id().alias("number")))
    # an id names its class where no two classes share one, as in most tables; else their numbers do, and ids come back at the end
    shared = not reps.groupBy("id").count().where("count > 1").isEmpty()
    reps = reps.withColumn("node", F.col("number") if shared else F.col("id"))
    classes = reps.select("k1", "k2", "id", "node", "n")
    rows = reps.select("node", F.explode("bands").alias("band"))
    least = rows.groupBy("band").agg(F.min("node").alias("m"), F.count("*").alias("n")).where("n > 1")
    block = components(rows.join(least, "band").where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b")).distinct())
    members = block.union(block.select("root", "root").distinct()).toDF("node", "block")
    sizes = members.groupBy("block").agg(F.count("*").alias("m"))
    members = members.join(sizes, "block").withColumn("k", F.ceil(F.col("m") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    members = members.join(reps.select("node", "id", "text_hash"), "node")
    own = docs.select(F.coalesce("doc_id", F.lit(C.NULL_ID)).alias("id"), "text_hash", "text").mapInArrow(_packed, "id long, text_hash long, z binary")
    held = own.join(members, ["id", "text_hash"]).dropDuplicates(["node"])
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(o, "chunk").alias("i"), F.greatest(o, "chunk").alias("j")))).alias("p")
    meet = held.select("block", "chunk", "node", "z", pair).select("block", "p.i", "p.j", "chunk", "node", "z")
    meet = meet.repartition(C.shards(spark), "block", "i", "j").sortWithinPartitions("block", "i", "j", "node")
    root = components(meet.mapInArrow(_confirm(shingle_words, percent), "a long, b long"))
    if shared:  # the smallest id of each group of classes
        root = root.union(root.select("root", "root").distinct())
        grouped = root.join(reps.select("node", "id"), "node")
        firsts = grouped.groupBy("root").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        root = with_hot(grouped.select("node", "root"), firsts, ["root"], "inner").select("node", "first")
    else:
        root = root.withColumnRenamed("root", "first")
    named = classes.join(root, "node", "left").select("k1", "k2", "n", F.coalesce("first", "id").alias("first"))
    out = with_hot(some, named, ["k1", "k2"], "left").unionByName(sk.where("n_shingles = 0").withColumn("first", F.col("id")))
    comp = F.when(F.col("first") != C.NULL_ID, F.col("first"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.col("doc_id").isNull() & comp.isNull()).alias("kept"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(C.table(spark, sf_dir, "documents"), 3, 85)


#: DuckDB: all pairs that share a shingle, then the transitive closure.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
c AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY ALL),
x AS (SELECT rep, n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS root FROM r GROUP BY a),
k AS (SELECT s.doc_id, len(s.s) AS n, coalesce(m.root, s.doc_id) AS root FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN m ON c.rep = m.a)
SELECT doc_id, n::BIGINT AS n_shingles, root AS component_id, doc_id = root AS kept FROM k
"""
