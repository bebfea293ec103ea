"""Language identification by a bidirectional gated recurrent network over bytes (operator 3).

Two GRUs of HIDDEN units read windows of WINDOW bytes from both ends; a softmax over the joined states labels
every position, and a document's probabilities pool all its positions by geometric mean. Training is numpy
back-propagation through time (Adam) on the driver, over windows from anywhere in a sample of the labelled documents
outside the held-out fold: of each of the L languages, all that the labels name, the SAMPLE // L + 1 documents of
smallest hash (of doc_id and text; equal ones count once), so SAMPLE + L at most. Prediction reads every byte of
every text.

Scale: the sample is a filter by hash, cut to size on the driver, which gets about 1.3 * SAMPLE + 22 * L texts;
prediction is one scan without a shuffle, the weights a few KB.

Defined results: `und` with score 0 for null texts and texts without a letter; null lang rows aren't learned
from; without any labelled row all are `und`; repeated rows give equal rows; null ids are in the training fold
and pass through; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled documents to learn from, dealt evenly to the languages; steps and windows a step.
SAMPLE, STEPS, BATCH = 1600, 350, 192
HIDDEN, WINDOW = 8, 96
#: Rows of one matrix product in a prediction. Products round by shape and by place in a wide block, so equal texts would score unequally.
TILE = 8


def tiled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for a of rows in a multiple of TILE, in products of one small shape."""
    return (a.reshape(-1, TILE, a.shape[-1]) @ b).reshape(*a.shape[:-1], b.shape[1])


class ByteGru:
    """One direction has Tab (256 x 3H: inputs' share of update, reset, candidate), U (H x 3H)."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n, h = len(langs), HIDDEN
        self.langs = langs
        f = lambda *s, k=1.0: (rng.standard_normal(s) * k).astype(np.float32)
        self.w = {"t0": f(256, 3 * h, k=0.3), "u0": f(h, 3 * h, k=0.35), "t1": f(256, 3 * h, k=0.3), "u1": f(h, 3 * h, k=0.35), "v": f(2 * h, n, k=0.3), "b": np.zeros(n, np.float32)}

    def states(self, x: np.ndarray, d: int, keep: bool = False, size: np.ndarray | None = None):
        """States after each position of x (time x batch), read forwards (d = 0) or backwards.

        size: the windows' lengths, ascending; reading backwards, what lies behind a window's end leaves no trace in its state."""
        tab, u, h2 = self.w[f"t{d}"], self.w[f"u{d}"], 2 * HIDDEN
        steps, n = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        saved = []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            g, a = tab[x[t]], h @ u if keep or n % TILE else tiled(h, u)
            zr = g[:, :h2]
            zr += a[:, :h2]
            np.tanh(zr, out=zr)  # sigmoid(2y) = (tanh(y) + 1) / 2
            zr += 1
            zr *= 0.5
            c = zr[:, HIDDEN:] * a[:, h2:]
            c += g[:, h2:]
            np.tanh(c, out=c)
            if keep:
                saved.append((t, h, zr.copy(), c.copy(), a[:, h2:].copy()))
            z = h - c
            z *= zr[:, :HIDDEN]
            z += c
            h = z
            if d and size is not None and size[0] <= t:
                h[: np.searchsorted(size, t, side="right")] = 0
            out[t] = h
        return (out, saved) if keep else out

    def position_logs(self, x: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
        """Log-probabilities of each language at each position: time x batch x languages."""
        v = self.w["v"]
        by = tiled if x.shape[1] % TILE == 0 else np.matmul
        y = by(self.states(x, 0), v[:HIDDEN])
        y += by(self.states(x, 1, size=size), v[HIDDEN:])
        y += self.w["b"]
        y -= y.max(axis=2, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=2, keepdims=True))
        return y

    def grads(self, x: np.ndarray, label: np.ndarray, mask: np.ndarray):
        """Loss and gradients of the masked mean cross-entropy over all positions."""
        w, H = self.w, HIDDEN
        (f, sf), (b, sb) = self.states(x, 0, True), self.states(x, 1, True)
        hs = np.concatenate([f, b], axis=2)
        y = hs @ w["v"] + w["b"]
        y -= y.max(axis=2, keepdims=True)
        p = np.exp(y)
        p /= p.sum(axis=2, keepdims=True)
        n = mask.sum()
        at = np.take_along_axis(p, label[None, :, None].repeat(len(x), 0), 2)[:, :, 0]
        loss = -(np.log(at + 1e-9) * mask).sum() / n
        dy = p
        np.put_along_axis(dy, label[None, :, None].repeat(len(x), 0), at[:, :, None] - 1, 2)
        dy *= mask[:, :, None] / n
        g = {"v": np.einsum("tbh,tbl->hl", hs, dy), "b": dy.sum((0, 1))}
        dh_all = dy @ w["v"].T
        for d, saved in ((0, sf), (1, sb)):
            u = w[f"u{d}"]
            gu, gt = np.zeros_like(u), np.zeros_like(w[f"t{d}"])
            dh = np.zeros((x.shape[1], H), np.float32)
            for t, h, zr, c, ac in reversed(saved):
                dh = dh + dh_all[t, :, d * H : (d + 1) * H]
                z, r = zr[:, :H], zr[:, H:]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z) * 2
                dr = dc * ac * r * (1 - r) * 2
                da = np.concatenate([dz, dr, dc * r], axis=1)
                gu += h.T @ da
                np.add.at(gt, x[t], np.concatenate([dz, dr, dc], axis=1))
                dh = dh * z + da @ u.T
            g[f"u{d}"], g[f"t{d}"] = gu, gt
        return loss, g

    def fit(self, texts: list[bytes], labels: list[int], steps: int = STEPS, batch: int = BATCH, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        by = [[t for t, y in zip(texts, labels, strict=True) if y == k and t] for k in range(len(self.langs))]
        live = [k for k, b in enumerate(by) if b]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        for i in range(steps if live else 0):
            y = np.array([live[(i * batch + j) % len(live)] for j in range(batch)])
            x, mask = np.full((WINDOW, batch), 32, np.intp), np.zeros((WINDOW, batch), np.float32)
            for j, k in enumerate(y.tolist()):
                t = by[k][rng.integers(len(by[k]))]
                at = int(rng.integers(max(1, len(t) - WINDOW + 1)))
                part = np.frombuffer(t[at : at + WINDOW], np.uint8)
                x[: len(part), j], mask[: len(part), j] = part, 1
            _, g = self.grads(x, y, mask)
            norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
            rate = 0.02 * min(1, 1.5 - 1.4 * i / steps)
            for k, v in g.items():
                v = v * min(1, 1 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9 ** (i + 1))) / (np.sqrt(s[k] / (1 - 0.99 ** (i + 1))) + 1e-7)).astype(np.float32)

    def documents(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Normalised geometric means over all positions of each text (nan: empty)."""
        size = np.diff(off)
        count = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = off[:-1][doc] + nth * WINDOW
        length = np.minimum(WINDOW, off[1:][doc] - start)
        total = np.zeros((len(size), len(self.langs)))
        data = np.concatenate([data, np.full(WINDOW, 32, np.uint8)])
        order = np.argsort(length, kind="stable")
        cols = np.arange(WINDOW)
        for i in range(0, len(doc), 4096):
            w = order[i : i + 4096]
            k = len(w)
            w = np.concatenate([w, np.repeat(w[-1:], -k % TILE)])
            n = length[w]
            x = data[start[w][:, None] + cols[None, : n.max()]]
            p = self.position_logs(np.ascontiguousarray(x.T).astype(np.intp), n)
            if n.min() < n.max():
                p *= (cols[: n.max(), None] < n[None, :])[:, :, None]
            np.add.at(total, doc[w[:k]], p.sum(axis=0, dtype=np.float64)[:k])
        with np.errstate(invalid="ignore"):
            p = np.exp(total / size[:, None])
            return p / p.sum(axis=1, keepdims=True)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, text) to learn from: every language outside fold 0, SAMPLE // languages + 1 documents of each at most."""
    rank = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (C.fold() != 0)).select("lang", "text", rank.alias("r"))
    per = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("r").alias("first")).collect()
    if not per:
        return []
    each = SAMPLE // len(per) + 1
    # no language goes without a row
    bounds = [(p["lang"], max(p["first"], int(min(1.0, (1.3 * each + 20) / p["n"]) * (1 << 62)))) for p in per]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    rows = known.join(bounds, "lang").where("r <= bound").groupBy("lang", "r").agg(F.min("text").alias("text")).collect()
    out, taken = [], Counter()
    for x in sorted(rows, key=lambda x: (x["r"], x["lang"])):
        if taken[x["lang"]] < each:
            taken[x["lang"]] += 1
            out.append((x["lang"], x["text"]))
    return out


def train(docs: DataFrame) -> ByteGru | None:
    """A network fitted on a sample of the rows with a lang outside fold 0."""
    rows = sample(docs)
    if not rows:
        return None
    langs = sorted({k for k, _ in rows})
    index = {k: i for i, k in enumerate(langs)}
    net = ByteGru(langs)
    net.fit([t.encode() for _, t in rows], [index[k] for k, _ in rows])
    return net


def _predict(net: ByteGru | None):
    def run(batches):
        C.take_turn("language")
        for batch in batches:
            data, off = C.flat(batch.column(1))
            for i, j in C.blocks(off):
                texts = batch.column(1).slice(i, j - i).to_pylist()
                lang, score = ["und"] * (j - i), [0.0] * (j - i)
                if net is not None:
                    p = net.documents(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    best = np.nan_to_num(p).argmax(axis=1)
                    for k, x in enumerate(texts):
                        if has_letter(x):
                            lang[k], score[k] = net.langs[best[k]], min(1.0, float(p[k, best[k]]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), batch.column(2).slice(i, j - i), pa.array(lang), pa.array(score, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return run


def identify(docs: DataFrame, net: ByteGru | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs."""
    C.tune(docs.sparkSession)
    return docs.select("doc_id", "text", (C.fold() == 0).alias("held_out")).mapInArrow(_predict(net), "doc_id long, held_out boolean, lang_pred string, score double")


def label_texts(net: ByteGru | None):
    """An Arrow UDF: text -> struct(lang_pred, score), for use on a frame whose other columns stay."""

    @F.pandas_udf("lang_pred string, score double")
    def f(text):
        import pandas as pd

        out = [pd.DataFrame({"lang_pred": b.column(2).to_pandas(), "score": b.column(3).to_pandas()}) for b in _predict(net)([pa.RecordBatch.from_arrays([pa.array([0] * len(text), pa.int64()), pa.array(text, pa.string(), from_pandas=True), pa.array([False] * len(text))], ["a", "b", "c"])])]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": pd.Series(dtype=str), "score": pd.Series(dtype=float)})

    return f


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
