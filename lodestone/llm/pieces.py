"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies (operator 6).

A score-ordered agenda holds adjacent symbol pairs that form a piece; the best score goes first, then the
leftmost. What stays unmerged and isn't a piece becomes byte pieces. No piece of such a vocabulary holds the
space mark after another character, so a text splits exactly at its spaces, and at characters that no longer
piece contains; each distinct part goes through the agenda once per cache of a Python worker. The agendas of a
batch's new parts run side by side, a row of a numpy matrix each, one merge of every row at a time. Each part that
enters the cache is checked there against the sentencepiece library, a whole Arrow batch's new parts at a
time; a text with a part on which they differ takes the library's ids. The decoded text is the library's decode(ids).

Scale: one scan, no shuffle; a worker holds one Arrow batch with its parts and 2 * CACHE parts of LONG characters at most,
and drops them when another operator begins in it.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows give equal
rows; null ids pass through; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from . import common as C

MARK = "▁"
CACHE, LONG = 200_000, 100
#: Characters of a part up to which its agenda is a plain list or a row of a matrix.
SHORT = 48
#: New parts from which on their agendas are rows of matrices, and rows of one matrix.
MANY, ROWS = 64, 2048


class PairTable:
    """The pieces that two adjacent pieces form, for whole arrays of pairs: a hash table with open addresses."""

    def __init__(self, ids: dict[str, int], n: int):
        found = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        a = np.array(found, np.int64).reshape(-1, 3)
        self.n = n + 1  # id n stands for no symbol
        self.bits = max(4, (4 * len(a)).bit_length())
        self.key, self.into = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, n, np.int32)
        key, into = a[:, 0] * self.n + a[:, 1], a[:, 2]
        at = self.place(key)
        while len(key):
            slot, first = np.unique(at, return_index=True)
            first = first[self.key[slot] < 0]
            self.key[at[first]], self.into[at[first]] = key[first], into[first]
            left = np.ones(len(key), bool)
            left[first] = False
            key, into, at = key[left], into[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(C.MULT)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair's piece, or n where it forms none."""
        key = left.astype(np.int64) * self.n + right
        at = self.place(key)
        have = self.key[at]
        out = self.into[at]
        if len(go := np.flatnonzero(have != key)):
            out[go] = self.n - 1
            go = go[have[go] >= 0]
        while len(go):
            at[go] = (at[go] + 1) & ((1 << self.bits) - 1)
            have = self.key[at[go]]
            same = have == key[go]
            out[go[same]] = self.into[at[go[same]]]
            go = go[~same & (have >= 0)]
        return out


class MergePieces:
    """A merge-type vocabulary, read through the library; encode() is our own."""

    def __init__(self, path: str):
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score, self.id, self.byte = {}, {}, {}
        for i in range(self.lib.vocab_size()):
            p = self.lib.id_to_piece(i)
            if self.lib.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_unused(i)):
                self.score[p], self.id[p] = self.lib.get_score(i), i
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces with an inner space mark: texts don't split at spaces")
        if not self.byte:
            raise ValueError("byte fallback is needed")
        self.newline_alone = not any("\n" in p for p in self.id)
        self.known: dict[str, bytes] = {}  # ids of parts, four bytes each
        self.old: dict[str, bytes] = {}
        self.odd: set[str] = set()
        n = self.lib.vocab_size()
        self.pairs = PairTable(self.id, n)
        order = {s: k for k, s in enumerate(sorted(set(self.score.values())))}
        self.rank = np.full(n + 1, -1, np.int32)  # by id, higher is better; -1: no piece
        self.single = np.full(0x110000, n, np.int32)  # by character
        for p, i in self.id.items():
            self.rank[i] = order[self.score[p]]
            if len(p) == 1:
                self.single[ord(p)] = i
        digits = [f"{i}," for i in range(n)]
        self.n_digits = np.array([len(d) for d in digits])
        width = int(self.n_digits.max())
        self.digits = np.frombuffer("".join([d.ljust(width) for d in digits]).encode(), np.uint8).reshape(n, width)

    def forget(self) -> None:
        self.known, self.old = {}, {}

    def agenda(self, part: str) -> list[int]:
        """Ids of one part, its spaces already marked."""
        return self.ids_of(self.merged_list(part) if len(part) <= SHORT else self.merged_heap(part))

    def ids_of(self, symbols: list[str]) -> list[int]:
        ids = self.id
        try:
            return [ids[p] for p in symbols]
        except KeyError:  # a symbol that is no piece
            pass
        out = []
        for p in symbols:
            i = ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out.extend([self.byte[b] for b in p.encode()])
        return out

    def merged_list(self, part: str) -> list[str]:
        """Symbols left of a short part: its agenda is the row of the pairs' scores, the best and leftmost of which goes first."""
        get, none = self.score.get, -math.inf
        sym = list(part)
        row = [get(part[i : i + 2], none) for i in range(len(part) - 1)]
        while row and (best := max(row)) != none:
            i = row.index(best)
            both = sym[i] = sym[i] + sym.pop(i + 1)
            del row[i]
            if i < len(row):
                row[i] = get(both + sym[i + 1], none)
            if i:
                row[i - 1] = get(sym[i - 1] + both, none)
        return sym

    def merged_heap(self, part: str) -> list[str]:
        """Symbols left of a part of any length: its agenda is a heap, whose entries lapse when a symbol of theirs has merged."""
        score = self.score
        sym = list(part)
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            s = score.get(sym[i] + sym[i + 1])
            if s is not None:
                heap.append((-s, i, i + 1, sym[i] + sym[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if sym[i] is None or sym[j] is None or right[i] != j or len(sym[i]) + len(sym[j]) != len(both):
                continue
            sym[i], sym[j] = both, None
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                s = score.get(p := both + sym[k])
                if s is not None:
                    heapq.heappush(heap, (-s, i, k, p))
            h = left[i]
            if h >= 0:
                s = score.get(p := sym[h] + both)
                if s is not None:
                    heapq.heappush(heap, (-s, h, i, p))
        return [p for p in sym if p is not None]

    def merged_rows(self, parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
        """Short parts all of whose characters are pieces, by length; all their ids and how many each has; then the other parts."""
        none = len(self.rank) - 1
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = self.single[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        start = np.cumsum(size) - size
        fit = (size <= SHORT) & (np.add.reduceat(codes == none, start) == 0)
        order = np.flatnonzero(fit)
        order = order[np.argsort(size[order], kind="stable")]
        got = [self.matrix(codes, start[rows], size[rows]) for rows in (order[i : i + ROWS] for i in range(0, len(order), ROWS))]
        ids, counts = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        return [parts[i] for i in order.tolist()], ids, counts, [parts[i] for i in np.flatnonzero(~fit).tolist()]

    def matrix(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts codes[start : start + size], one row each, and how many each has. A row ends with a cell that is no symbol; it
        also stands left of the next row, and the last one left of the first."""
        n, w, none = len(start), int(size.max()) + 1, len(self.rank) - 1
        col = np.arange(w)
        sym = np.where(col < size[:, None], codes[np.minimum(start[:, None] + col, len(codes) - 1)], none).ravel()
        into = np.full(n * w, none, np.int32)
        into[:-1] = self.pairs.find(sym[:-1], sym[1:])
        score = self.rank[into]
        cells = np.arange(n * w)
        left, right = cells - 1, cells + 1
        table, rows = score.reshape(n, w), np.arange(n)
        while len(rows):
            at = rows * w + (table if len(rows) == n else table[rows]).argmax(1)
            live = score[at] >= 0
            if not live.all():
                rows, at = rows[live], at[live]
            if not len(at):
                break
            mid, before = right[at], left[at]
            after, both = right[mid], into[at]
            sym[at], sym[mid], score[mid] = both, none, -1
            right[at], left[after] = after, at
            new = self.pairs.find(np.concatenate([sym[before], both]), np.concatenate([both, sym[after]]))
            at = np.concatenate([before, at])
            into[at], score[at] = new, self.rank[new]
        left_over = sym != none
        return sym[left_over], left_over.reshape(n, w).sum(1)

    def parts(self, text: str) -> list[str]:
        """The text with marks for spaces, split where no piece can cross."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if self.newline_alone and text[0] != " " and "  " not in text:  # each mark begins a part
            out = (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")
            return out if all(out) else list(filter(None, out))
        lines = text.split("\n") if self.newline_alone else [text]
        out, lead = [], True
        for n, line in enumerate(lines):
            if n:
                out.append("\n")
            if lead or line:
                line = (MARK if lead else "") + line.replace(" ", MARK)
                if MARK + MARK in line or line.endswith(MARK):
                    out += re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line)
                else:
                    first, *rest = line.split(MARK)
                    if first:
                        out.append(first)
                    out += [MARK + w for w in rest]
            lead = False
        return out

    def learn(self, missing: list[str]) -> None:
        """Encodes new parts and checks them against the library."""
        marked = [p for p in missing if p[0] == MARK]
        for parts in (marked, [p for p in missing if p[0] != MARK]):
            if len(parts) >= MANY:
                *got, parts = self.merged_rows(parts)
                self.enter(*got)
            if parts:
                ours = [self.agenda(p) for p in parts]
                self.enter(parts, np.fromiter(itertools.chain.from_iterable(ours), np.int32), np.fromiter(map(len, ours), np.int64))

    def enter(self, parts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Checks the ids of parts, with a mark in front of all or of none, and keeps them."""
        if not parts:
            return
        # the library puts a mark in front; a part without one follows a line end there
        bare = parts[0][0] != MARK
        asked = ["\n" + p for p in parts] if bare else [p[1:].replace(MARK, " ") for p in parts]
        theirs = self.lib.encode(asked, num_threads=1)
        ends, flat = np.cumsum(counts).tolist(), ids.tolist()
        if bare or list(map(len, theirs)) != counts.tolist() or list(itertools.chain.from_iterable(theirs)) != flat:
            head = self.agenda(MARK + "\n") if bare else []
            for p, a, i, j, his in zip(parts, asked, [0, *ends], ends, theirs, strict=False):
                if a and head + flat[i:j] != his:
                    self.odd.add(p)
        raw = ids.astype(np.int32).tobytes()
        self.known.update({p: raw[4 * i : 4 * j] for p, i, j in zip(parts, [0, *ends], ends, strict=False)})

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and how many each has."""
        parts = [self.parts(x) for x in texts]
        if len(self.known) > CACHE:  # two generations: what is used moves to the new one
            self.old, self.known = self.known, {}
        flat = list(itertools.chain.from_iterable(parts))
        got = list(map(self.known.get, flat))
        holes = [i for i, x in enumerate(got) if x is None]
        if holes:
            old = self.old.get
            missing = {flat[i] for i in holes}
            used = {p: x for p in missing if (x := old(p)) is not None}
            self.known.update(used)
            new = [p for p in missing if p not in used]
            self.learn(new)
            for i in holes:
                got[i] = self.known[flat[i]]
            for p in new:
                if len(p) > LONG:
                    del self.known[p]
        out, at = [], 0
        for text, ps in zip(texts, parts, strict=True):
            out.append(b"".join(got[at : at + len(ps)]))
            at += len(ps)
            if self.odd and not self.odd.isdisjoint(ps):
                out[-1] = np.array(self.lib.encode(text), np.int32).tobytes()
        return np.frombuffer(b"".join(out), np.int32), np.array([len(x) // 4 for x in out], np.int64)

    def joined(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The ids of each text as decimal numbers, joined by commas."""
        n = self.n_digits[ids]
        raw = self.digits[ids][np.arange(self.digits.shape[1]) < n[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[i : max(i, j - 1)] for i, j in itertools.pairwise(ends)]

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Ids of each text, and the same as a comma-joined string."""
        ids, counts = self.ids(texts)
        return [(x, s.decode()) for x, s in zip(lists(ids, counts), self.joined(ids, counts), strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode(ids, num_threads=1) if ids else []


def lists(ids: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    ends = np.cumsum(counts).tolist()
    flat = ids.tolist()
    return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]


_loaded: dict[str, MergePieces] = {}


def model(path: str) -> MergePieces:
    if path not in _loaded:
        _loaded[path] = MergePieces(path)
    return _loaded[path]


def _run(path: str, full: bool):
    def run(batches):
        m = model(path)
        C.take_turn("pieces", m.forget)
        for batch in batches:
            _, off = C.flat(batch.column(1))
            for i, j in C.blocks(off, 1 << 20):
                texts = [x or "" for x in batch.column(1).slice(i, j - i).to_pylist()]
                ids, counts = m.ids(texts)
                back = m.decode(lists(ids, counts))
                sha = lambda x: hashlib.sha256(x).hexdigest()
                cols = [
                    batch.column(0).slice(i, j - i).cast(pa.int64()),
                    pa.array(counts),
                    pa.array([sha(s) for s in m.joined(ids, counts)]),
                    pa.array([sha(x.encode()) for x in back]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if full:
                    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                    cols += [pa.ListArray.from_arrays(ends, pa.array(ids)), pa.array(back, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, full: bool = True) -> DataFrame:
    """Ids and decoded text of each row of docs (doc_id, text), with their digests; full=False: digests only."""
    C.tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_run(path, full), SCHEMA + ", ids array<int>, decoded string" * full)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), full=False)
