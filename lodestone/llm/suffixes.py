"""Suffix-array dedup over bytes (operator 10): a logarithmic family of suffix arrays.

Every byte that a WINDOW-byte string covers goes if that string also starts anywhere else. Suffixes meet by
minimiser (superkmers.py); in a bucket they arrive in batches, as the map tasks sent them. A batch gets a suffix
array: its suffixes in lexicographic order, as far as WINDOW bytes tell them apart. It is merge-scanned against
every level that exists: suffixes with equal beginnings are brought into one order, and neighbours that agree on
WINDOW bytes are long matches. Then the batch becomes a level, and levels of equal rank merge, as digits carry in a
binary counter; such a merge is at once the scan.

Order and matches come from the bytes: 8 first, then 5 at a time for suffixes that are still tied. A group whose
windows have one hash is compared byte for byte at once; where that fails the ordering goes on.

Windows of minimisers that hold more than a fair share of the corpus don't reach a bucket's index: they are dealt by
128-bit cryptographic digests (superkmers.py), the way that keeps such a group out of one task.

Defined results: null, empty and short texts lose nothing; every row is a text of its own, so repeated rows
are copies, also those that share a doc_id; null ids pass through; extra columns are ignored; an empty table
gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from . import superkmers as S

WINDOW, GRAM = 200, 32
#: Suffixes of one batch.
BATCH = 1 << 19
#: Bytes of the first comparison and of each later one.
FIRST, STEP = 8, 5


def heads(keys: np.ndarray) -> np.ndarray:
    """Marks where a run of equal keys begins."""
    return np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)


class Suffixes:
    """The suffixes of a body that begin windows: suffix i is body[begin[i]:], of which `window` bytes count; h is their hash."""

    def __init__(self, body: bytes, begin: np.ndarray, h: np.ndarray, window: int):
        self.body, self.begin, self.h, self.window = body, begin, h, window
        data = np.frombuffer(body + bytes(FIRST), np.uint8)
        self.be = np.zeros(len(body), np.uint64)  # the 8 bytes from each place on, as one big-endian number
        for k in range(FIRST):
            self.be <<= np.uint64(8)
            self.be |= data[k : k + len(body)]
        self.steps = [min(at, window - STEP) for at in range(FIRST, window, STEP)]

    def first(self, x: np.ndarray) -> np.ndarray:
        return self.be[self.begin[x]] >> np.uint64(8 * max(0, FIRST - self.window))

    def order(self, x: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Brings x[at] into order, group by group (at ascends, groups are runs), and marks those that equal their predecessor."""
        twin = np.zeros(len(x), bool)
        for step in [*self.steps, None]:
            many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
            at, group = at[many], group[many]
            if not len(at):
                return twin
            edge = np.flatnonzero(heads(group))
            size = np.diff(np.append(edge, len(at)))
            h = self.h[x[at]]
            # all words compared, or all hashes equal: whole matches, if the bytes agree
            alike = np.minimum.reduceat(h, edge) == np.maximum.reduceat(h, edge) if step is not None else np.ones(len(edge), bool)
            nth = np.repeat(np.arange(len(edge)), size)
            inner = alike[nth]
            inner[edge] = False
            q = at[inner]
            ok = np.ones(len(q), bool) if step is None else S.same(self.body, self.begin, self.begin + self.window, x[q], x[q - 1])
            alike[nth[inner][~ok]] = False
            whole = alike[nth]
            inner &= whole
            twin[at[inner]] = True
            at, group = at[~whole], np.cumsum(heads(group[~whole])) - 1
            if not len(at) or step is None:
                return twin
            key = (group.astype(np.uint64) << np.uint64(8 * STEP)) | (self.be[self.begin[x[at]] + step] >> np.uint64(8 * (8 - STEP)))
            o = np.argsort(key)
            x[at] = x[at[o]]
            group = np.cumsum(heads(key[o])) - 1
        return twin


class Level:
    """A suffix array: suffixes in lexicographic order, with their first bytes; rank r holds 2 ** r batches."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, rank: int = 0):
        self.keys, self.at, self.rank = keys, at, rank


class LogIndex:
    """Levels of suffix arrays; add() finds the batch's long matches in itself and in all levels."""

    def __init__(self, suffixes: Suffixes):
        self.suffixes = suffixes
        self.levels: list[Level] = []
        self.found = np.zeros(len(suffixes.begin), bool)

    def _sorted(self, x: np.ndarray, at: np.ndarray, group: np.ndarray) -> None:
        """Orders x[at] within its groups; neighbours that match over the whole window are found."""
        twin = np.flatnonzero(self.suffixes.order(x, at, group))
        self.found[x[twin]] = True
        self.found[x[twin - 1]] = True

    def add(self, x: np.ndarray) -> None:
        keys = self.suffixes.first(x)
        o = np.argsort(keys)
        x, keys = x[o], keys[o]
        self._sorted(x, np.arange(len(x)), np.cumsum(heads(keys)) - 1)
        batch = level = Level(keys, x)
        while self.levels and self.levels[-1].rank == level.rank:
            level = self._merge(self.levels.pop(), level)
        for old in self.levels:
            self._scan(old, batch)
        self.levels.append(level)

    def _merge(self, a: Level, b: Level) -> Level:
        keys = np.concatenate([a.keys, b.keys])
        o = np.argsort(keys, kind="stable")  # two sorted runs: linear
        keys, x = keys[o], np.concatenate([a.at, b.at])[o]
        group = np.cumsum(heads(keys)) - 1
        n = np.bincount(group)
        right = np.bincount(group[o >= len(a.at)], minlength=len(n))
        at = np.flatnonzero(((right > 0) & (right < n))[group])  # groups of one side are in order
        self._sorted(x, at, group[at])
        return Level(keys, x, a.rank + 1)

    def _scan(self, a: Level, b: Level) -> None:
        """The suffixes of both that share a beginning, in one order; only what is found stays."""
        keys = b.keys[heads(b.keys)]
        lo, hi = np.searchsorted(a.keys, keys, "left"), np.searchsorted(a.keys, keys, "right")
        both = np.flatnonzero(hi > lo)
        n = (hi - lo)[both]
        left = np.repeat(lo[both] - np.cumsum(n) + n, n) + np.arange(n.sum())
        group = np.cumsum(heads(b.keys)) - 1
        right = np.flatnonzero((hi > lo)[group])
        x = np.concatenate([a.at[left], b.at[right]])
        group = np.concatenate([np.repeat(both, n), group[right]])
        o = np.argsort(group, kind="stable")
        self._sorted(x[o], np.arange(len(x)), group[o])


def repeated_windows(b: S.Bucket) -> np.ndarray:
    """Windows of a bucket whose bytes occur more than once; the bucket's windows stand in order of arrival."""
    index = LogIndex(Suffixes(b.body, b.begin, b.h, b.m.window))
    for i in range(0, len(b), BATCH):
        index.add(np.arange(i, min(i + BATCH, len(b))))
    return np.flatnonzero(index.found | b.many)


def _finish(full: bool):
    def run(batches):
        for batch in batches:
            ranges = batch.column(2).to_pylist()
            n, lost, runs, kept = [], [], [], []
            for t, r in zip(C.as_binary(batch.column(1)).to_pylist(), ranges, strict=True):
                t = t or b""
                part, x = [], 0
                spans = S.joined(r).tolist()
                for a, b in spans:
                    part.append(t[x:a])
                    x = b
                part.append(t[x:])
                n.append(len(t))
                lost.append(sum(b - a for a, b in spans))
                runs.append(spans)
                kept.append(b"".join(part))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array([len(x) for x in runs], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            if full:
                cols += [pa.array(kept, pa.binary()), pa.array(runs, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: len(cols)])

    return run


def drop_repeated_bytes(docs: DataFrame, window: int = WINDOW, full: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (full) the kept bytes and removed spans of each row of docs."""
    C.tune(docs.sparkSession)
    docs = S.keyed(docs)
    m = S.Match(S.Bytes, window, min(GRAM, window), later=False, whole=True)
    both = S.with_ranges(docs, S.removed_ranges(docs.select("id", "tag", "text"), m, repeated_windows))
    return both.mapInArrow(_finish(full), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<array<long>>" * full)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(C.table(spark, sf_dir, "documents"), full=False)
