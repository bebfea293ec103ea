"""Document fingerprints by closed syncmers (operator 8).

Of the K-byte strings of a text, closed syncmers are those whose smallest S-byte substring (by hash) stands at
an edge: a property of the string alone, so the same anchors are found wherever a passage stands. The
fingerprint keeps all anchors, each with its byte position, an anchor that stands several times with the first;
so K and S alone set the density. Likeness is a positional match: of the anchors of both texts together, the share
that both have in the same order (the longest chain that ascends in both). A text without anchors stands for
itself as one anchor. As text a fingerprint is the base64 form of 10 bytes an anchor, by ascending hash: 6 of the
hash, 4 of the position (parse() reads it).

For the query each text is also edited: its last third is replaced by the beginning of the next document, by
descending doc_id. Documents are dealt to range partitions by splits of their ids, and an id that takes up several
splits by a hash of the text; equal rows of a batch travel once, with their number. The first document of a
partition also travels to the one before, so one shuffle of the texts gives each its neighbour.

Defined results: null and empty texts have the fingerprint '' and likeness 1 to one another, 0 to others;
rows that share an id are ordered by a hash of their texts, descending; null ids come last; the only document of a table is its own neighbour; extra
columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

K, S = 24, 8
#: Anchors that a fingerprint keeps at most: no bound.
SIZE = None
ANCHOR = np.dtype([("low", "<u4"), ("high", "<u2"), ("pos", "<u4")])

Fingerprint = tuple[np.ndarray, np.ndarray]


def anchors(data: np.ndarray, off: np.ndarray) -> list[Fingerprint]:
    """(hashes ascending, positions) of all of each text's closed syncmers, of equal ones the first."""
    n = len(off) - 1
    sums = C.prefix(C.BYTE_KEYS[data])
    pos = np.zeros(0, np.int64)
    if len(data) >= K:
        at = np.arange(len(data) - S + 1)
        inner = C.span(sums, at, at + S)
        low = C.slide_min(inner, K - S + 1)
        pos = np.flatnonzero((inner[: len(low)] == low) | (inner[K - S :] == low))
    doc = np.searchsorted(off, pos, side="right") - 1
    ok = pos + K <= off[1:][doc]
    pos, doc = pos[ok], doc[ok]
    h = C.span(sums, pos, pos + K) >> np.uint64(16)
    order = np.lexsort((pos, h, doc))
    pos, doc, h = pos[order], doc[order], h[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    pos, doc, h = pos[new], doc[new], h[new]
    edge = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for d in range(n):
        a, b = int(edge[d]), int(edge[d + 1])
        if a < b or off[d] == off[d + 1]:
            out.append((h[a:b], pos[a:b] - off[d]))
        else:
            out.append((C.span(sums, off[d : d + 1], off[d + 1 : d + 2]) >> np.uint64(16), np.zeros(1, np.int64)))
    return out


def as_text(f: Fingerprint) -> str:
    x = np.empty(len(f[0]), ANCHOR)
    x["low"], x["high"], x["pos"] = f[0] & np.uint64(0xFFFFFFFF), f[0] >> np.uint64(32), f[1]
    return base64.b64encode(x.tobytes()).decode()


def parse(text: str) -> Fingerprint:
    x = np.frombuffer(base64.b64decode(text), ANCHOR)
    return x["low"].astype(np.uint64) | (x["high"].astype(np.uint64) << np.uint64(32)), x["pos"].astype(np.int64)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of the anchors of both that both have in the same order."""
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    follow = b[1][j][np.argsort(a[1][i])]
    if (follow[1:] > follow[:-1]).all():
        n = len(follow)
    else:
        chain: list[int] = []
        for q in follow.tolist():
            k = bisect_left(chain, q)
            chain[k : k + 1] = [q]
        n = len(chain)
    return n / (len(a[0]) + len(b[0]) - len(both))


def _fingerprints(texts: list[bytes]) -> list[Fingerprint]:
    data, off = C.flat(pa.array(texts, pa.large_binary()))
    out = []
    for i, j in C.blocks(off, 2 << 20):
        out += anchors(data[off[i] : off[j]], off[i : j + 1] - off[i])
    return out


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _fingerprint_column(batches):
    C.take_turn("fingerprints")
    for batch in batches:
        f = _fingerprints([x or b"" for x in C.as_binary(batch.column(1)).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(list(map(as_text, f)), pa.string())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row of docs; one scan without a shuffle."""
    C.tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_column, "doc_id long, fingerprint string")


class Splits:
    """Parts of documents by (id, hash of the text): an id that is a split k times is dealt to k parts by its hash."""

    def __init__(self, ids: list[int]):
        self.ids = np.array(sorted(ids), np.int64)

    def __len__(self):
        return len(self.ids) + 1

    def part(self, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        return low + ((h >> 10) * (high - low) >> 53)


def _tops(splits: Splits):
    def run(batches):
        for batch in batches:
            ids, h = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            part = splits.part(ids, h)
            order = np.lexsort((h, ids, part))
            last = order[np.append(part[order][1:] != part[order][:-1], True)] if len(ids) else order
            yield pa.RecordBatch.from_arrays([pa.array(part[last], pa.int32()), pa.array(ids[last]), pa.array(h[last])], ["part", "id", "h"])

    return run


def _deal(splits: Splits, before: dict[tuple[int, int], int]):
    """Each document to its part, equal ones of a batch once; the largest of a part also, as a guest, to the part that it follows."""

    def run(batches):
        for batch in batches:
            ids, h = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            texts = batch.column(2).to_pylist()
            many: dict[tuple[int, int, str | None], int] = {}
            for x in zip(ids.tolist(), h.tolist(), texts, strict=True):
                many[x] = many.get(x, 0) + 1
            own = list(many)
            part = splits.part(np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64)).tolist()
            rows = [(p, False, n, *x) for p, (x, n) in zip(part, many.items(), strict=True)]
            rows += [(before[x[:2]], True, 1, *x) for x in own if x[:2] in before]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["part", "guest", "n", "id", "h", "text"])

    return run


def _compare(batches):
    """Rows of one part by descending id and hash, the guests last."""
    C.take_turn("fingerprints")

    def rows(own, following):
        texts = [t for _, t, _, _ in own]
        then = [*texts[1:], following]
        new = [edited(a, b) for a, b in zip(texts, then, strict=True)]
        f = _fingerprints([t.encode() for t in [*texts, following, *new]])
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if x[0] == C.NULL_ID else x[0] for x in own], pa.int64()),
                pa.array(list(map(len, texts)), pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new]),
                pa.array([as_text(x) for x in f[:n]], pa.string()),
                pa.array([as_text(x) for x in f[n + 1 :]], pa.string()),
                pa.array([likeness(f[k], f[n + 1 + k]) for k in range(n)], pa.float64()),
                pa.array([likeness(f[k], f[k + 1]) for k in range(n)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def repeats(x):
        """All of n equal documents but the last: each is followed by its like."""
        one = rows([x], x[1])
        for left in range(x[2] - 1, 0, -C.BATCH_ROWS):
            yield one.take(pa.array([0] * min(left, C.BATCH_ROWS)))

    kept: list[tuple[int, str, int, bool]] = []
    for batch in batches:
        guest, n, ids, texts = (batch.column(c).to_pylist() for c in (1, 2, 3, 5))
        kept += [(i, t or "", k, g) for i, t, k, g in zip(ids, texts, n, guest, strict=True)]
        own = sum(not x[3] for x in kept)
        at = 0
        while at < own - 1:
            # some MB of texts at a time: fingerprints outgrow them
            to, size = at, 0
            while to < own - 1 and size < C.BLOCK:
                size += len(kept[to][1])
                to += 1
            yield rows(kept[at:to], kept[to][1])
            for x in kept[at:to]:
                if x[2] > 1:
                    yield from repeats(x)
            at = to
        kept = kept[at:]
    if kept and not kept[0][3]:
        if kept[0][2] > 1:
            yield from repeats(kept[0])
        yield rows(kept[:1], kept[1][1])


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs."""
    spark = docs.sparkSession
    C.tune(spark)
    h = F.shiftrightunsigned(F.xxhash64("text"), 1)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("id"), h.alias("h"), "text")
    parts = C.shards(spark)
    probs = F.array(*[F.lit(k / parts) for k in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    splits = Splits(docs.agg(F.percentile_approx("id", probs, F.lit(10_000)).alias("p")).first()[0] or [])
    tops = docs.select("id", "h").mapInArrow(_tops(splits), "part int, id long, h long").groupBy("part").agg(F.max(F.struct("id", "h")).alias("top")).collect()
    tops = {r["part"]: tuple(r["top"]) for r in tops}
    order = sorted(tops)
    # a part's last document is followed by the largest one of the next lower part; the very last by the first of all
    before = {tops[p]: order[(k + 1) % len(order)] for k, p in enumerate(order)}
    dealt = docs.mapInArrow(_deal(splits, before), "part int, guest boolean, n long, id long, h long, text string").repartitionById(len(splits), "part")
    dealt = dealt.sortWithinPartitions("guest", F.desc("id"), F.desc("h"))
    return dealt.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_edited(C.table(spark, sf_dir, "documents"))
