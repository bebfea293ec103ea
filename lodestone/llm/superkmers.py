"""Exact matching of fixed windows across a corpus by super-k-mers; shared by operators 5 and 10.

A document is a row of units (words, or bytes); a window is WINDOW consecutive units. Consecutive windows that
share a minimiser (the smallest hash of their M-unit grams) travel as one packed string to the minimiser's
bucket, where all equal windows meet. What a task has already seen twice it settles itself: of equal packed
strings one travels. Minimisers that hold more than a fair share of the corpus (counted over all of it in a
first pass; at most 2 * max(P, 1000) of them, so the list that is shipped has a proven bound) are split: their
windows travel alone, as 128-bit cryptographic digests (BLAKE2b), pre-aggregated by task, to the digest's own bucket.

Memory: partitions are as many as the texts' bytes ask for (ROOM each), and a partition is read bin by bin (BIN each),
sorted by Spark, so a task holds one bin, however large the corpus. The first pass estimates a minimiser's weight
without bias: a task reports a count of FEW or more as it is, a smaller one n as FEW with probability n / FEW. The
estimates only decide how a window travels, never what is found.

A task's answer is removed unit ranges by document (id, tag): tag is a hash of the text, so that rows which
share a doc_id keep apart. Ranges join back to the documents by that key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of text that a map task gathers before it settles repeats and sends.
FLUSH = 16 << 20
#: Bytes of text that numpy works on at once.
PIECE = 2 << 20
#: Reduce partitions for each shuffle partition, at least; bytes of packed strings of a partition, and of a bin in it, about.
SPREAD, ROOM, BIN = 4, 256 << 20, 12 << 20
#: Bytes of packed strings for each byte of text, about.
PACKED = 3.5
#: Counts of a task that are reported as they are.
FEW = 64

ENTRY = [("key", "<u4"), ("id", "<i8"), ("tag", "<i4"), ("start", "<i4"), ("count", "<i4"), ("size", "<i4"), ("many", "u1")]
ALONE = [("h1", "<u8"), ("h2", "<u8"), ("id", "<i8"), ("tag", "<i4"), ("start", "<i4"), ("many", "u1")]
SPAN = [("id", "<i8"), ("tag", "<i4"), ("start", "<i4"), ("end", "<i4")]


class Words:
    """Units are words [^\\x20\\x09-\\x0D]+; their text is the words joined by single spaces."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = data
        self.starts, self.ends, self.off = C.words(data, off)
        self.sums = C.prefix(C.span(C.prefix(C.BYTE_KEYS[data]), self.starts, self.ends))

    def edges(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte of the n units from each place on."""
        return self.starts[at], self.ends[at + n - 1]

    def text(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The text with one separator after each word, and each word's start and end in it."""
        if not len(self.starts):
            return b"", self.starts, self.ends
        n = self.ends - self.starts
        at = np.cumsum(n + 1) - n - 1
        keep = np.zeros(len(self.data) + 1, bool)
        keep[:-1] = ~C.SPACE[self.data]
        out = np.full(int(at[-1] + n[-1]) + 1, 32, np.uint8)
        place = np.ones(len(out), bool)
        place[at + n] = False
        out[place] = self.data[keep[:-1]]
        return out.tobytes(), at, at + n


class Bytes:
    """Units are bytes."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.sums = C.prefix(C.BYTE_KEYS[data])

    def edges(self, at: np.ndarray, n: int):
        return at, at + n

    def text(self):
        n = np.arange(len(self.data))
        return self.data.tobytes(), n, n + 1


class Match:
    """What is matched: the kind of unit, the window and the gram that minimisers are made of.

    later: only windows that also start earlier go (by id, then start); else all windows that occur twice.
    whole: a bin's packed strings are looked at together, in order of arrival; else some minimisers at a time."""

    def __init__(self, unit: type, window: int, gram: int, later: bool, whole: bool = False):
        self.unit, self.window, self.gram, self.later, self.whole = unit, window, gram, later, whole


def hashes(u, n: int) -> np.ndarray:
    """Hash of the n units from each place on."""
    total = len(u.sums) - 1
    if total < n:
        return np.zeros(0, np.uint64)
    at = np.arange(total - n + 1)
    return C.span(u.sums, at, at + n)


def pieces(u, m: Match) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one minimiser: (minimiser, document, first window, windows)."""
    h, off = hashes(u, m.gram), u.off
    w = m.window - m.gram + 1
    if len(h) < w:
        none = np.zeros(0, np.int64)
        return h[:0], none, none, none
    anchor, first = C.runs_long(h, w)
    ends = off[1:] - m.window + 1
    cuts = np.union1d(first, off[:-1][ends > off[:-1]])
    at = np.searchsorted(first, cuts, side="right") - 1
    doc = np.searchsorted(off, cuts, side="right") - 1
    doc = np.minimum(doc, len(off) - 2)
    end = np.minimum(np.append(cuts[1:], len(h) - w + 1), ends[doc])
    ok = end > cuts
    return h[anchor[at]][ok], doc[ok], cuts[ok], (end - cuts)[ok]


def _batches(batches):
    """Whole texts in groups of about FLUSH bytes: lists of (ids, tags, data, off), each of about PIECE bytes."""
    group, held = [], 0
    for batch in batches:
        data, off = C.flat(batch.column(2))
        ids, tags = np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1)).astype(np.int32)
        for i, j in C.blocks(off, PIECE):
            group.append((ids[i:j], tags[i:j], data[off[i] : off[j]], off[i : j + 1] - off[i]))
            held += int(off[j] - off[i])
            if held >= FLUSH:
                yield group
                group, held = [], 0
    if group:
        yield group


def _count(m: Match, least: float):
    """Minimisers with the number of their packed strings, distinct ones of a group, and that of all (k null).

    Small counts are rounded to 0 or FEW at random, by the key and the group, so that their expectation stays."""

    def run(batches):
        C.take_turn("superkmers")
        for group in _batches(batches):
            keys, same = [], []
            for _, _, data, off in group:
                u = m.unit(data, off)
                key, _, first, n = pieces(u, m)
                keys.append(key)
                same.append(C.span(u.sums, first, first + n + m.window - 1))
            keys, same = np.concatenate(keys), np.concatenate(same)
            _, one = np.unique(same, return_index=True)
            key, n = np.unique(keys[one], return_counts=True)
            few = max(FEW, least * len(one) / 4)
            coin = C.mix(key ^ C.mix(same[:1] if len(same) else np.zeros(1, np.uint64))) >> np.uint64(11)
            n = np.where(n >= few, n, np.where(coin < n / few * 2.0**53, np.ceil(few), 0)).astype(np.int64)
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array([None, *key[some].view(np.int64).tolist()], pa.int64()), pa.array([len(one), *n[some].tolist()], pa.int64())], ["k", "n"])

    return run


def _pack(kind: int, *parts: bytes) -> bytes:
    return bytes([kind]) + C.pack(b"".join(parts))


def _spans(rows) -> bytes:
    return _pack(2, np.array(rows, SPAN).tobytes())


def _send(m: Match, parts: int, hot: np.ndarray, bins: int = 1):
    """Documents -> (part, bin, data): packed strings (kind 0), single windows (1) and ranges already settled (2)."""

    def settle(group):
        keys, metas, texts, gone = [], [], [], []
        seen: dict[bytes, int] = {}
        for ids, tags, data, off in group:
            u = m.unit(data, off)
            key, doc, first, n = pieces(u, m)
            body, at, end = u.text()
            rows = zip(key.tolist(), ids[doc].tolist(), tags[doc].tolist(), (first - u.off[doc]).tolist(), n.tolist(), at[first].tolist() if len(first) else [], end[first + n + m.window - 2].tolist() if len(first) else [], strict=True)
            for k, i, tag, s, c, a, b in rows:
                t = body[a:b]
                old = seen.get(t)
                if old is None:
                    seen[t] = len(texts)
                    keys.append(k)
                    metas.append([i, tag, s, c, 0])
                    texts.append(t)
                    continue
                x = metas[old]
                if not m.later:
                    if not x[4]:
                        gone.append((x[0], x[1], x[2], x[2] + c + m.window - 1))
                        x[4] = 1
                    gone.append((i, tag, s, s + c + m.window - 1))
                elif (i, s) > (x[0], x[2]):
                    gone.append((i, tag, s, s + c + m.window - 1))
                elif (i, s) < (x[0], x[2]):
                    gone.append((x[0], x[1], x[2], x[2] + c + m.window - 1))
                    x[:3] = i, tag, s
                elif tag != x[1]:  # two texts under one id: neither is earlier
                    keys.append(k)
                    metas.append([i, tag, s, c, 0])
                    texts.append(t)
        return np.array(keys, np.uint64), metas, texts, gone

    def run(batches):
        C.take_turn("superkmers")
        for group in _batches(batches):
            keys, metas, texts, gone = settle(group)
            del group
            out: list[tuple[int, bytes]] = []
            is_hot = np.isin(keys, hot)
            for x in _alone(m, np.flatnonzero(is_hot).tolist(), metas, texts, gone):
                part = (x["h1"] % np.uint64(parts * bins)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edge = np.flatnonzero(np.diff(part[order], prepend=-1))
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
                    out.append((int(part[order[a]]), _pack(1, x[order[a:b]].tobytes())))
            part = (C.mix(keys) % np.uint64(parts * bins)).astype(np.int64)
            part[is_hot] = parts * bins
            order = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.diff(part[order], prepend=-1))
            short = (keys >> np.uint64(32)).astype(np.uint32)
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
                p = int(part[order[a]])
                if p == parts * bins:
                    continue
                few = order[a:b].tolist()
                e = np.zeros(len(few), ENTRY)
                e["key"] = short[order[a:b]]
                e["id"], e["tag"], e["start"], e["count"], e["many"] = np.array([metas[k] for k in few], np.int64).T
                e["size"] = [len(texts[k]) for k in few]
                head = np.array([len(few)], "<i8").tobytes()
                out.append((p, _pack(0, head, *[e[name].tobytes() for name, _ in ENTRY], *[texts[k] for k in few])))
            del keys, metas, texts
            gone.sort()
            step = max(1, len(gone) // parts)
            for a in range(0, len(gone), max(step, 1000)):
                out.append((gone[a][0] % (parts * bins), _spans(gone[a : a + max(step, 1000)])))
            for a in range(0, len(out), 64):
                to = np.array([p for p, _ in out[a : a + 64]], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(to % parts, pa.int32()), pa.array(to // parts, pa.int32()), pa.array([b for _, b in out[a : a + 64]], pa.binary())], ["part", "bin", "data"])

    return run


def _alone(m: Match, few: list[int], metas, texts, gone):
    """The windows of the chosen packed strings, each content once; the others' ranges are added to gone."""
    lo = 0
    while lo < len(few):
        hi, held = lo, 0
        while hi < len(few) and held < PIECE:
            held += len(texts[few[hi]])
            hi += 1
        part, lo = few[lo:hi], hi
        body = b"\n".join(texts[k] for k in part) if m.unit is Words else b"".join(texts[k] for k in part)
        data = np.frombuffer(body, np.uint8)
        off = np.array([0, len(data)])
        meta = np.array([metas[k] for k in part], np.int64)
        n = meta[:, 3]
        base = np.cumsum(n + m.window - 1) - n - m.window + 1
        e = np.repeat(np.arange(len(part)), n)
        k = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
        x = np.zeros(len(e), ALONE)
        begin, end = m.unit(data, off).edges(base[e] + k, m.window)
        digest = b"".join([hashlib.blake2b(body[p:q], digest_size=16).digest() for p, q in zip(begin.tolist(), end.tolist(), strict=True)])
        x["h1"], x["h2"] = np.frombuffer(digest, "<u8").reshape(-1, 2).T
        x["id"], x["tag"], x["start"], x["many"] = meta[e, 0], meta[e, 1], meta[e, 2] + k, meta[e, 4]
        keep, lost = _first(x, m)
        for y in _ranges(x[lost], m.window):
            gone.append(tuple(y.tolist()))
        yield x[keep]


def _first(x: np.ndarray, m: Match) -> tuple[np.ndarray, np.ndarray]:
    """Indices of one window for each content, and of those known to go."""
    order = np.lexsort((x["start"], x["id"], x["h2"], x["h1"]))
    y = x[order]
    new = np.concatenate([[True], (y["h1"][1:] != y["h1"][:-1]) | (y["h2"][1:] != y["h2"][:-1])]) if len(y) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    if m.later:
        lost = (y["id"] != y["id"][head]) | (y["start"] != y["start"][head])
        return order[~lost], order[lost]
    size = np.diff(np.append(np.flatnonzero(new), len(y)))
    many = np.add.reduceat(y["many"].astype(np.int64), np.flatnonzero(new)) if len(y) else size
    lost = ((size > 1) | (many > 0))[np.cumsum(new) - 1]
    x["many"][order[head[lost]]] = 1
    return order[new], order[lost]


def _ranges(x: np.ndarray, window: int) -> np.ndarray:
    """Windows -> maximal unit ranges by document."""
    if not len(x):
        return np.zeros(0, SPAN)
    x = x[np.lexsort((x["start"], x["tag"], x["id"]))]
    same = (x["id"][1:] == x["id"][:-1]) & (x["tag"][1:] == x["tag"][:-1]) & (x["start"][1:] <= x["start"][:-1] + window)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.append(first[1:], len(x)) - 1
    out = np.zeros(len(first), SPAN)
    out["id"], out["tag"], out["start"], out["end"] = x["id"][first], x["tag"][first], x["start"][first], x["start"][last] + window
    return out


def same(body: bytes, begin: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the windows that start at a and at b hold the same bytes; window i is body[begin[i]:end[i]].

    Runs in which both sides go on one by one are compared as one string."""
    ok = np.ones(len(a), bool)
    if not len(a):
        return ok
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(x) != 1) | (np.diff(y) != 1)]))
    last = np.append(edge[1:], len(x)) - 1
    for i, j, p, q, r, s in zip(edge.tolist(), last.tolist(), begin[x[edge]].tolist(), end[x[last]].tolist(), begin[y[edge]].tolist(), end[y[last]].tolist(), strict=True):
        if body[p:q] != body[r:s]:
            for k in range(i, j + 1):
                ok[order[k]] = body[begin[x[k]] : end[x[k]]] == body[begin[y[k]] : end[y[k]]]
    return ok


class Bucket:
    """The packed strings of one partition whose minimisers occur more than once, laid end to end.

    Window i has the bytes body[begin[i]:end[i]] and the hash h[i], and starts at (id[i], start[i])."""

    def __init__(self, e: np.ndarray, texts: list[bytes], m: Match):
        glue = b"\n" if m.unit is Words else b""
        self.m, self.body = m, glue.join(texts)
        u = m.unit(np.frombuffer(self.body, np.uint8), np.array([0, len(self.body)]))
        h = hashes(u, m.window)
        n = e["count"].astype(np.int64)
        base = np.cumsum(n + m.window - 1) - n - m.window + 1
        self.entry = np.repeat(np.arange(len(e)), n)
        k = np.arange(len(self.entry)) - np.repeat(np.cumsum(n) - n, n)
        at = base[self.entry] + k
        self.h = h[at]
        self.begin, self.end = u.edges(at, m.window)
        self.e, self.k = e, k
        self.many = e["many"][self.entry] > 0

    def __len__(self):
        return len(self.h)

    def windows(self, chosen: np.ndarray) -> np.ndarray:
        x = np.zeros(len(chosen), ALONE)
        e = self.e[self.entry[chosen]]
        x["id"], x["tag"], x["start"] = e["id"], e["tag"], e["start"] + self.k[chosen]
        return x

    def contents(self, chosen: np.ndarray) -> dict[bytes, list[int]]:
        """Chosen windows by content: the exact way where hashes collide."""
        out: dict[bytes, list[int]] = {}
        for i in chosen.tolist():
            out.setdefault(self.body[self.begin[i] : self.end[i]], []).append(i)
        return out


def _gather(m: Match, find):
    """(part, bin, data) rows of one partition, by bin -> (id, tag, ranges). find(bucket) gives the windows that go."""

    def settle(rows):
        blobs, alone, spans = [], [], []
        for b in rows:
            (blobs, alone, spans)[b[0]].append(b[1:])
        spans = [np.frombuffer(C.unpack(b), SPAN) for b in spans]
        metas, texts = [], []
        for b in blobs:
            b = C.unpack(b)
            n = int(np.frombuffer(b, "<i8", 1)[0])
            e, at = np.zeros(n, ENTRY), 8
            for name, kind in ENTRY:
                e[name] = np.frombuffer(b, kind, n, at)
                at += e[name].nbytes
            metas.append(e)
            for s in e["size"].tolist():
                texts.append(b[at : at + s])
                at += s
        del blobs
        if metas:
            e = np.concatenate(metas)
            _, inv, n = np.unique(e["key"], return_inverse=True, return_counts=True)
            # a packed string alone repeats no window: equal windows have their minimiser at the same offset
            few = np.flatnonzero(n[inv] > 1)
            order = few if m.whole else few[np.argsort(e["key"][few], kind="stable")]
            cut = np.flatnonzero(np.diff(e["key"][order].astype(np.int64), prepend=-1))
            size = np.cumsum(e["size"][order].astype(np.int64))
            lo = 0
            while lo < len(order):  # whole minimisers, about 4 PIECE of text at a time
                room = np.searchsorted(size, (size[lo - 1] if lo else 0) + 4 * PIECE, side="right")
                i = np.searchsorted(cut, max(room, lo + 1), side="left")
                hi = int(cut[i]) if i < len(cut) and not m.whole else len(order)
                part = order[lo:hi]
                bucket = Bucket(e[part], [texts[k] for k in part.tolist()], m)
                spans.append(_ranges(bucket.windows(find(bucket)), m.window))
                lo = hi
        if alone:
            x = np.concatenate([np.frombuffer(C.unpack(b), ALONE) for b in alone])
            _, lost = _first(x, m)
            spans.append(_ranges(x[lost], m.window))
        if spans:
            yield from _rows(np.concatenate(spans))

    def run(batches):
        C.take_turn("superkmers")
        rows, at = [], None
        for batch in batches:
            for k, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != at and rows:
                    yield from settle(rows)
                    rows = []
                at = k
                rows.append(b)
        if rows:
            yield from settle(rows)

    return run


def _rows(s: np.ndarray, limit: int = 20_000):
    """One row for each document: its ranges merged, as pairs of int32."""
    if not len(s):
        return
    s = s[np.lexsort((s["start"], s["tag"], s["id"]))]
    doc = np.cumsum(np.concatenate([[0], (s["id"][1:] != s["id"][:-1]) | (s["tag"][1:] != s["tag"][:-1])]))
    start, end = merge(doc, s["start"].astype(np.int64), s["end"].astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], start[0][1:] != start[0][:-1]]))
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    pairs = np.stack([start[1], end], axis=1).astype("<i4")
    edge = np.append(first, len(pairs))
    for a in range(0, len(first), limit):
        b = min(a + limit, len(first))
        data = [pairs[edge[i] : edge[i + 1]].tobytes() for i in range(a, b)]
        yield pa.RecordBatch.from_arrays([pa.array(s["id"][heads[a:b]]), pa.array(s["tag"][heads[a:b]]), pa.array(data, pa.binary())], ["id", "tag", "ranges"])


def merge(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Overlapping or touching ranges of a document as one; sorted by document and start: ((doc, start), end)."""
    far = 1 << 40
    reach = np.maximum.accumulate(doc * far + end)
    new = np.concatenate([[True], doc[1:] * far + start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return (doc[first], start[first]), reach[last] - doc[last] * far


def removed_ranges(docs: DataFrame, m: Match, find) -> DataFrame:
    """id, tag, ranges of documents (id, tag, text) that lose units; several rows a document."""
    spark = docs.sparkSession
    packed = PACKED * (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = max(SPREAD * C.shards(spark), int(packed / ROOM) + 1)
    bins = int(packed / parts / BIN) + 1
    share = 1 / (2 * max(parts, 1000))
    seen = docs.mapInArrow(_count(m, share), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    rows = C.cut(seen)
    total = rows.where("k IS NULL").agg(F.sum("n")).first()[0] or 0
    # about 1 / share keys can hold so much
    hot = np.array(sorted(r[0] for r in rows.where((F.col("n") >= F.lit(max(64.0, share * total))) & F.col("k").isNotNull()).select("k").collect()), np.int64).view(np.uint64)
    sent = docs.mapInArrow(_send(m, parts, hot, bins), "part int, bin int, data binary").repartitionById(parts, "part")
    if bins > 1:
        sent = sent.sortWithinPartitions("bin")
    return sent.mapInArrow(_gather(m, find), "id long, tag int, ranges binary")


def keyed(docs: DataFrame) -> DataFrame:
    """id, tag, text, doc_id: the key that ranges come back by."""
    return docs.select(F.coalesce("doc_id", F.lit(C.NULL_ID)).alias("id"), F.hash("text").alias("tag"), "text", F.col("doc_id").cast("long").alias("doc_id"))


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Documents (id, tag, text, doc_id) with all their ranges: an array of binaries, or null."""
    got = ranges.groupBy("id", "tag").agg(F.collect_list("ranges").alias("ranges"))
    return docs.join(got.hint("shuffle_hash"), ["id", "tag"], "left").select("doc_id", "text", "ranges")


def joined(parts: list[bytes] | None) -> np.ndarray:
    """A document's ranges, merged: n x 2."""
    if not parts:
        return np.zeros((0, 2), np.int64)
    x = np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2).astype(np.int64)
    x = x[np.argsort(x[:, 0], kind="stable")]
    (_, start), end = merge(np.zeros(len(x), np.int64), x[:, 0], x[:, 1])
    return np.stack([start, end], axis=1)
