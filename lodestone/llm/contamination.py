"""Benchmark decontamination (operator 4): rare pair seeds, then Smith-Waterman alignment.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case. A document's place is aligned with a
test item word by word: a match scores 2, a mismatch or a gap -1, and the best local score over 2 * (words of the
item) is the score. A document with a place that scores CUT or more holds a copy of the item: whole, edited or
paraphrased.

The seeds lose no such place. Of two matches in a row with no word between them on either side, the pair stands in
both texts; with one mismatch or gap between them, it stands at a distance of 1 or 2 words in both. Let a place have
m matches, a of the first links, b of the second, and so at least b + 2 (m - 1 - a - b) errors: if its points are N or
more, 2 a + b >= N - 2. Links lie side by side over the gaps between the item's words and weigh at most 2 each, so
the seeds over d gaps can go, and the others still weigh N - 2 - 2 d together. The gaps whose pairs are the most
frequent over all documents go, for as long as that stays 1 or more. No place is longer than 3 n - N words (n: the
item's words). What passes is weighed by all its pairs, then aligned.

Scale: two scans of the documents (count the seeds, then look for them) and no shuffle of texts. The items
travel to the tasks only in blocks of BLOCK_BYTES, by a count of the table's bytes; a benchmark beyond that is
taken block by block, each against all documents.

Defined results: null, empty and short texts hold nothing; items of fewer than LEAST words aren't looked for;
repeated rows give equal rows, repeated items rows of their own; null ids pass through; extra columns are
ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

LEAST, CUT = 3, 0.5
#: Bytes of test items that a task gets at once.
BLOCK_BYTES = 16 << 20


def split_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the word offsets of the texts."""
    low = C.LOWER[data]
    starts, ends, at = C.words(low, off, C.PLAIN)
    return C.span(C.prefix(C.BYTE_KEYS[low]), starts, ends), at


def pairs(words: np.ndarray, apart: int) -> np.ndarray:
    """Hash of each word with the one `apart` places on."""
    return C.mix(words[:-apart] * np.uint64(C.MULT) + words[apart:]) if len(words) > apart else words[:0]


class Items:
    """A block of test items: words, and their pairs of words 1 and 2 apart as sorted keys with (item, place, apart)."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.ids = ids
        data, off = C.flat(pa.array(texts, pa.string()))
        w, at = split_words(data, off)
        self.words = [w[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.size = np.diff(at)
        points = np.ceil(2 * CUT * self.size).astype(np.int64)
        #: Weight that the links of a copy have at least, with all seeds and with those kept; words it spans at most.
        self.full = self.need = np.maximum(1, points - 2)
        self.reach = 3 * self.size - points
        key, item, place, apart = [], [], [], []
        owner = np.repeat(np.arange(len(ids)), self.size)
        for d in (1, 2):
            h = pairs(w, d)
            inside = np.flatnonzero((owner[: len(h)] == owner[d:][: len(h)]) & (self.size[owner[: len(h)]] >= LEAST))
            key.append(h[inside])
            item.append(owner[inside])
            place.append(inside - at[owner[inside]])
            apart.append(np.full(len(inside), d))
        self._set(*map(np.concatenate, (key, item, place, apart)))

    def _set(self, key, item, place, apart):
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place, self.apart = key[order], item[order], place[order], apart[order]
        self.keys, self.first, self.many = np.unique(self.key, return_index=True, return_counts=True)
        self.may = np.zeros(1 << 22, bool)  # by the top bits; most words of a text end here
        self.may[self.keys >> np.uint64(42)] = True

    def keep_rare(self, count: dict[int, int]) -> None:
        """Drops the seeds over each item's most frequent gaps, as many as leave a copy with a seed for certain."""
        start = np.cumsum(self.size) - self.size
        n = np.array([count.get(k, 0) for k in self.key.view(np.int64).tolist()], np.float64)
        gap = start[self.item] + self.place
        wide = self.apart == 2
        cost = np.bincount(np.concatenate([gap, gap[wide] + 1]), np.concatenate([n, n[wide]]), self.size.sum() + 1)
        hot = np.zeros(len(cost), bool)
        drop = (self.full - 1) // 2
        for i in np.flatnonzero(self.size >= LEAST).tolist():
            gaps = start[i] + np.arange(self.size[i] - 1)
            hot[gaps[np.argsort(-cost[gaps], kind="stable")[: drop[i]]]] = True
        self.need = self.full - 2 * drop
        keep = ~(hot[gap] | (wide & hot[gap + 1]))
        self._set(self.key[keep], self.item[keep], self.place[keep], self.apart[keep])

    def hits(self, w: np.ndarray, at: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in w, index into keys) of all seeds whose words stand so far apart in a text; at: the texts' word offsets."""
        h = pairs(w, apart)
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.flatnonzero(self.may[h >> np.uint64(42)])
        h = h[place]
        k = np.searchsorted(self.keys, h).clip(max=len(self.keys) - 1)
        ok = self.keys[k] == h
        place, k = place[ok], k[ok]
        inside = place + apart < at[np.searchsorted(at, place, side="right").clip(max=len(at) - 1)]
        return place[inside], k[inside]

    def regions(self, w: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, end word) in w of all places that can hold a copy, by text, then item."""
        place, item, weight = [], [], []
        for d in (1, 2):
            p, k = self.hits(w, at, d)
            n = self.many[k]
            e = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place.append(np.repeat(p, n))
            item.append(self.item[e])
            weight.append(np.where(self.apart[e] == 1, 3 - d, 1))
        place, item, weight = map(np.concatenate, (place, item, weight))
        if not len(place):
            return []
        text = np.searchsorted(at, place, side="right") - 1
        order = np.lexsort((place, text, item))
        place, item, weight, text = place[order], item[order], weight[order], text[order]
        # places of different items lie far apart on one line
        line = item * (len(w) + int(self.reach.max()) + 1) + place
        total = np.concatenate([[0], np.cumsum(weight)])
        reach = self.reach[item]
        end = np.searchsorted(line, np.minimum(line + reach, line - place + at[text + 1] - 1), side="right")
        ok = total[end] - total[:-1][: len(end)] >= self.need[item]
        place, item, text, reach = place[ok], item[ok], text[ok], reach[ok]
        if not len(place):
            return []
        lo, hi = np.maximum(place - reach, at[text]), np.minimum(place + reach + 1, at[text + 1])
        new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (lo[1:] > hi[:-1])]))
        last = np.append(new[1:], len(place)) - 1
        return sorted(zip(text[new].tolist(), item[new].tolist(), lo[new].tolist(), hi[last].tolist(), strict=True))


def weighs_enough(own: np.ndarray, part: np.ndarray, full: int, reach: int) -> bool:
    """Whether the links of some `reach` words of part can weigh `full`, by all pairs of the item."""
    near, far = pairs(own, 1), pairs(own, 2)
    h = pairs(part, 1)
    v = np.isin(h, near) * 2
    v = np.maximum(v, np.isin(h, far))
    v[: max(0, len(h) - 1)] = np.maximum(v[: max(0, len(h) - 1)], np.isin(pairs(part, 2), np.concatenate([near, far])))
    total = np.concatenate([[0], np.cumsum(v)])
    return bool((total[np.minimum(np.arange(len(v)) + reach, len(v))] - total[:-1]).max(initial=0) >= full)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score (match 2, mismatch and gap -1), and the end of the first such place in text."""
    col = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item.tolist():
        t = np.maximum(row - 1, 0)
        t[1:] = np.maximum(t[1:], row[:-1] + np.where(text == np.uint64(w), 2, -1))
        row = np.maximum.accumulate(t + col) - col  # gaps in the item
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def copies(items: Items, w: np.ndarray, at: np.ndarray):
    """(text, item, score, first word, end word) of each item that a text holds: its best place."""
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    for d, i, lo, hi in items.regions(w, at):
        own, part = items.words[i], w[lo:hi]
        if not weighs_enough(own, part, int(items.full[i]), int(items.reach[i])):
            continue
        score, end = align(own, part)
        s = score / (2 * len(own))
        if s >= CUT and ((d, i) not in out or s > out[d, i][0]):
            back, length = align(own[::-1], part[:end][::-1])
            out[d, i] = (s, lo - int(at[d]) + end - length, lo - int(at[d]) + end)
    return [(d, i, *x) for (d, i), x in out.items()]


def _count(items: Items):
    def run(batches):
        C.take_turn("contamination")
        n = np.zeros(len(items.keys), np.int64)
        for batch in batches:
            data, off = C.flat(batch.column(0))
            for i, j in C.blocks(off):
                w, at = split_words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for apart in (1, 2):
                    n += np.bincount(items.hits(w, at, apart)[1], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(items.keys[some].view(np.int64)), pa.array(n[some])], ["k", "n"])

    return run


def prepare(docs: DataFrame, benchmark: DataFrame) -> list[Items]:
    """The test items in blocks of bounded size, each with its rare seeds; one scan of docs for each block."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    out = []
    for b in range(blocks):
        part = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = sorted(part.select("item_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        items = Items([r[0] for r in rows], [r[1] for r in rows])
        counts = docs.select("text").mapInArrow(_count(items), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
        items.keep_rare(Counter({r["k"]: r["n"] for r in counts.collect()}))
        out.append(items)
    return out


def _find(blocks: list[Items]):
    def run(batches):
        C.take_turn("contamination")
        for batch in batches:
            data, off = C.flat(batch.column(1))
            ids = batch.column(0).to_pylist()
            rows = []
            for i, j in C.blocks(off):
                w, at = split_words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for items in blocks:
                    rows += [(ids[i + d], items.ids[k], score, a, b) for d, k, score, a, b in copies(items, w, at)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "first_word", "end_word"])

    return run


def find_copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word of each document that holds a copy of a test item."""
    C.tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find(prepare(docs, benchmark)), "doc_id long, item_id long, score double, first_word long, end_word long")


def holds_copy(blocks: list[Items]):
    """An Arrow UDF: whether a text holds a copy of any test item."""

    def f(text):
        import pandas as pd

        data, off = C.flat(pa.array(text, pa.string(), from_pandas=True))
        out = np.zeros(len(text), bool)
        for i, j in C.blocks(off):
            w, at = split_words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            for items in blocks:
                out[[i + c[0] for c in copies(items, w, at)]] = True
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(f, T.BooleanType())


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_copies(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
