"""Toxicity by compression distance (operator 7).

Two zstandard dictionaries are trained on labelled windows of SPAN words outside the held-out fold: one on windows
of ordinary text, one on windows of toxic text that hold evidence (stems that toxic documents have far more
often than ordinary ones). Both share the ordinary content at their end, at equal distances, so a window's two
compressed lengths differ by what the toxic content explains. Every window of a text is compressed with both;
a document's statistic is the bytes saved by windows that save at least `least`, and a threshold calibrated on the labelled
sample turns it into a score. Window lengths are cached per distinct window of a worker.

Scale: at most SAMPLE labelled documents of each class reach the driver (filter by hash, then a limit; their texts
come through a broadcast of the sampled ids only). Scoring is one scan without a shuffle.

Defined results: null and empty texts score as texts without evidence; without labels of both classes every score is 0;
null ids are in the training fold; repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled documents of each class to learn from at most.
SAMPLE = 1000
SPAN = 1
CONTENT, EVIDENCE = 4000, 400
#: HEAD stands before each word, so that its beginning weighs more than its inside. CARRIER stands before and after each window and at the end of both dictionaries: so short windows are never stored raw, and matches at their end are seen.
HEAD = " \x02\x03"
CARRIER = b"#0123456789#abcdefghijklmnopqrstuvwxyz#"
CACHE = 150_000


def windows(text: str) -> list[bytes]:
    """All words of a text, SPAN to a window, lower-cased and with spaces around."""
    w = text.lower().split()
    return [CARRIER + (HEAD + HEAD.join(w[i : i + SPAN]) + " ").encode() + CARRIER for i in range(0, len(w), SPAN)]


class Pair:
    """The two dictionaries and the calibration."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.content = (b" " * len(toxic) + ordinary + CARRIER, toxic + ordinary + CARRIER)
        self.least, self.cut, self.scale = 2, 1.0, 1.0
        self._open()

    def _open(self):
        self.cache: dict[bytes, int] = {}
        self.z = []
        for c in self.content:
            d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            # a strategy that enters every position of the dictionary, with short matches
            how = zstandard.ZstdCompressionParameters(window_log=13, chain_log=12, hash_log=13, search_log=5, min_match=5, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_checksum=False, write_content_size=False, write_dict_id=False)
            d.precompute_compress(compression_params=how)
            self.z.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("z", "cache")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._open()

    def gain(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves."""
        got = self.cache.get(window)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            got = self.cache[window] = len(self.z[0].compress(window)) - len(self.z[1].compress(window))
        return got

    def stat(self, text: str | None) -> int:
        least = self.least
        return sum([g for g in map(self.gain, windows(text or "")) if g >= least])

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(min(50.0, max(-50.0, -(self.stat(text) - self.cut) / self.scale))))


def fit(toxic: list[str], ordinary: list[str]) -> Pair | None:
    if not toxic or not ordinary:
        return None
    # a stem counts once for each different word before it, so that copies of a document count once
    pairs = [{x for w in (t.lower().split() for t in texts) for x in zip(["", *w], w, strict=False)} for texts in (ordinary, toxic)]
    stems_of = lambda w: [w[:n] for n in range(4, min(len(w), 12) + 1)]
    df = [Counter(), Counter()]
    for c, ps in zip(df, pairs, strict=True):
        for w, n in Counter(w for _, w in ps).items():
            for x in stems_of(w):
                c[x] += n
    n1, n0 = len(toxic), len(ordinary)
    odds = lambda x: math.log((df[1][x] + 0.05) / (n1 + 1)) - math.log((df[0][x] + 0.05) / (n0 + 1))
    good = {x: odds(x) for x, c in df[1].items() if c >= max(8, n1 // 60) and odds(x) > 2.5}
    # evidence: the stem that explains most, then the one that explains most of the rest, and so on
    rest = {w: n for w, n in Counter(w for _, w in pairs[1]).items() if any(x in good for x in stems_of(w))}
    parts: list[str] = []
    while rest and len(parts) < EVIDENCE:
        left: Counter = Counter()
        for w, n in rest.items():
            for x in stems_of(w):
                if x in good:
                    left[x] += n
        x = max(left, key=lambda x: (left[x] * good[x], len(x), x), default=None)
        if x is None or left[x] < max(8, n1 // 60):
            break
        parts.append(HEAD + x)
        rest = {w: n for w, n in rest.items() if not w.startswith(x)}
    toxic_part = "".join(reversed(parts)).encode() + b" "
    # ordinary: the trainer's choice from ordinary windows
    samples = [(" " + " ".join(w[i : i + 16]) + " ").encode() for w in (t.lower().split() for t in ordinary) for i in range(0, len(w), 16)]
    try:
        base = zstandard.train_dictionary(CONTENT, samples).as_bytes()[-CONTENT + 600 :]
    except zstandard.ZstdError:  # too few samples to train on: the samples themselves
        base = b"".join(samples)[-CONTENT:]
    pair = Pair(toxic_part, base)
    best = (-1.0, 0, 0)
    for least in (1, 2, 3, 4):  # calibration: the floor of a window, then the cut of a document
        pair.least = least
        s1, s0 = sorted(pair.stat(t) for t in toxic), sorted(pair.stat(t) for t in ordinary)
        for cut in sorted({*s1, *(x + 1 for x in s0)}):
            hit = sum(x >= cut for x in s1) / n1
            false = sum(x >= cut for x in s0) / n0
            if cut > 0 and (q := hit - 5 * false) > best[0]:
                best = (q, least, cut)
    _, pair.least, cut = best
    pair.least = max(pair.least, 1)
    below = max([x for t in ordinary + toxic if (x := pair.stat(t)) < cut], default=0)
    pair.cut, pair.scale = (cut + below) / 2, max(0.5, (cut - below) / 4)
    return pair


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """Texts of at most SAMPLE toxic and SAMPLE ordinary labelled documents outside fold 0."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (C.fold() != 0)).select("doc_id", "toxic")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    out = []
    for k in (1, 0):
        few = known.where((F.col("toxic") == k) & (rank < int(min(1.0, 1.3 * SAMPLE / max(1, n.get(k, 0))) * (1 << 30)))).select("doc_id").distinct().orderBy(rank, "doc_id").limit(SAMPLE)
        ids = [r[0] for r in few.collect()]
        chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
        # one text for each sampled id, whatever the number of rows that share it
        rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).where(F.col("text").isNotNull()).collect()
        out.append([r["text"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))])
    return out[0], out[1]


def _score(pair: Pair | None):
    def run(batches):
        C.take_turn("toxicity")
        for batch in batches:
            s = [0.0 if pair is None else pair.score(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_documents(docs: DataFrame, pair: Pair | None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    C.tune(docs.sparkSession)
    return docs.select("doc_id", "text", (C.fold() == 0).alias("held_out")).mapInArrow(_score(pair), "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return score_documents(docs, fit(*sample(docs, C.table(spark, sf_dir, "labels"))))
