"""Operators 5 and 10 against brute force, with edge cases, split minimisers and colliding hashes."""

import hashlib
import random
import re

import numpy as np
import pytest

from lodestone.llm import passages, suffixes
from lodestone.llm import superkmers as S

SCHEMA = "doc_id long, text string, ranges string, tag int"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [prose(60), prose(45), prose(25)]
    out = []
    for i in range(n):
        t = prose(rng.randint(0, 90))
        if rng.random() < 0.6:
            t += rng.choice([" ", "\n", "  "]) + rng.choice(shared) + " " + prose(rng.randint(0, 30))
        out.append((i * 3, t))
    loop = " ".join(["ab"] * 150)
    out += [(500, None), (501, ""), (502, " \t\n"), (503, loop), (504, "x" * 900), (505, out[3][1]), (505, out[3][1]), (None, out[4][1]), (506, prose(6000) + shared[0])]
    return out


def brute5(rows, window=20):
    docs = [(-1 if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (1 << 60, 0)), (i, k))
    out = []
    for (i, w), (doc_id, _) in zip(docs, rows, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i, k):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute10(rows, window=200):
    texts = [(t or "").encode() for _, t in rows]
    n = {}
    for t in texts:
        for k in range(len(t) - window + 1):
            n[t[k : k + window]] = n.get(t[k : k + window], 0) + 1
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - window + 1):
            if n[t[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((doc_id, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(parts)


@pytest.fixture(params=["plain", "split", "small pieces"])
def how(request, monkeypatch):
    """split: every minimiser counts as one that holds too much; workers are forked after the change."""
    if request.param == "split":
        real = S._send
        monkeypatch.setattr(S, "_send", lambda m, parts, hot, bins: _all_hot(real, m, parts, bins))
    if request.param == "small pieces":
        monkeypatch.setattr(suffixes, "BATCH", 64)
    return request.param


def _all_hot(real, m, parts, bins):
    class Every:
        pass

    def run(batches):
        isin = np.isin
        np.isin = lambda a, b: np.ones(len(a), bool) if isinstance(b, Every) else isin(a, b)
        try:
            yield from real(m, parts, Every(), bins)(batches)
        finally:
            np.isin = isin

    return run


def test_substring_dedup(spark, how):
    rows = corpus()
    got = passages.drop_repeats(frame(spark, rows), full=False).collect()
    assert sorted(map(tuple, got), key=str) == brute5(rows)


def test_suffix_dedup(spark, how):
    rows = corpus(2)
    got = suffixes.drop_repeated_bytes(frame(spark, rows), full=False).collect()
    assert sorted(map(tuple, got), key=str) == brute10(rows)


def test_real_outputs(spark):
    rows = corpus(3, 12)
    for r in passages.drop_repeats(frame(spark, rows)).collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    for r in suffixes.drop_repeated_bytes(frame(spark, rows)).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        assert sum(b - a for a, b in r.spans) == r.n_removed


def test_empty_table(spark):
    none = frame(spark, [], 1)
    assert passages.drop_repeats(none).count() == 0
    assert suffixes.drop_repeated_bytes(none).count() == 0


def suffixes_of(texts, window):
    body = b"".join(texts)
    size = [len(t) for t in texts]
    begin = np.concatenate([np.arange(n - window + 1) + sum(size[:k]) for k, n in enumerate(size) if n >= window])
    return suffixes.Suffixes(body, begin, np.array([hash(body[i : i + window]) % 2**64 for i in begin.tolist()], np.uint64), window)


@pytest.mark.parametrize("window", [3, 8, 9, 13, 40])
@pytest.mark.parametrize("clash", [False, True])
def test_levels_are_suffix_arrays(window, clash):
    rng = np.random.default_rng(window)
    texts = [bytes(rng.choice(np.frombuffer(b"ab\0", np.uint8), rng.integers(1, 90))) for _ in range(40)]
    texts += [texts[3] + texts[4], b"a" * 100]
    s = suffixes_of(texts, window)
    if clash:
        s.h = s.h % np.uint64(5)
    index = suffixes.LogIndex(s)
    n = len(s.begin)
    strings = [s.body[i : i + window] for i in s.begin.tolist()]
    for k, i in enumerate(range(0, n, 64)):
        index.add(np.arange(i, min(i + 64, n)))
        assert [x.rank for x in index.levels] == [r for r in range(20, -1, -1) if (k + 1) >> r & 1]
        for level in index.levels:
            got = [strings[x] for x in level.at.tolist()]
            assert got == sorted(got)
        assert sorted(np.concatenate([x.at for x in index.levels]).tolist()) == list(range(min(i + 64, n)))
        seen = strings[: i + 64]
        assert [bool(f) for f in index.found[: i + 64]] == [seen.count(x) > 1 for x in seen]


@pytest.mark.parametrize("how", ["plain", "bins"])
def test_bins_of_a_partition(spark, monkeypatch, how):
    if how == "bins":
        monkeypatch.setattr(S, "BIN", 500)
        monkeypatch.setattr(S, "ROOM", 4000)
    rows = corpus(5)
    assert sorted(map(tuple, passages.drop_repeats(frame(spark, rows), full=False).collect()), key=str) == brute5(rows)
    assert sorted(map(tuple, suffixes.drop_repeated_bytes(frame(spark, rows), full=False).collect()), key=str) == brute10(rows)


@pytest.mark.parametrize("kind", [passages.later_windows, suffixes.repeated_windows])
def test_equal_hashes_of_different_text(kind):
    """All hashes forced equal: the exact way decides."""
    m = S.Match(S.Bytes, 4, 2, kind is passages.later_windows)
    e = np.zeros(2, S.ENTRY)
    e["id"], e["count"], e["size"] = [1, 2], [5, 5], [8, 8]
    b = S.Bucket(e, [b"abcdefgh", b"xxcdefyy"], m)
    b.h = np.zeros_like(b.h)
    want = [7] if m.later else [2, 7]
    assert sorted(kind(b).tolist()) == want
