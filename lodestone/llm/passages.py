"""Substring dedup over words (operator 5): super-k-mers of 20-word windows.

Every window of WINDOW words whose words also start earlier (smaller doc_id, or the same document at an
earlier word) is covered, and its words go. Super-k-mers partition the windows (superkmers.py); in a bucket
partition the windows are sorted by hash, then id and start, the first of equal ones stays, and equal hashes
are verified on the words themselves.

Defined results: null, empty and short texts lose nothing; rows that share a doc_id are one document's
readings: of equal windows at the same place neither goes; a null doc_id comes before all others; repeated
rows give equal rows; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from . import superkmers as S

WINDOW, GRAM = 20, 3


def later_windows(b: S.Bucket) -> np.ndarray:
    """Windows of a bucket whose content also starts earlier."""
    order = np.argsort(b.h, kind="stable")
    h = b.h[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    few = order[np.bincount(group)[group] > 1] if len(h) else order
    x = b.windows(few)
    by = np.lexsort((x["start"], x["id"], b.h[few]))
    few, x = few[by], x[by]
    h = b.h[few]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = (x["id"] != x["id"][head]) | (x["start"] != x["start"][head])
    ok = S.same(b.body, b.begin, b.end, few, few[head])
    out = few[gone & ok]
    if not ok.all():  # equal hashes of different words
        clash = np.isin(h, h[~ok])
        out = [few[gone & ok & ~clash]]
        for same in b.contents(few[clash]).values():
            y = b.windows(np.array(same))
            at = list(zip(y["id"].tolist(), y["start"].tolist(), strict=True))
            out.append(np.array([i for i, p in zip(same, at, strict=True) if p > min(at)], np.int64))
        out = np.concatenate(out)
    return out


def _finish(full: bool):
    def run(batches):
        for batch in batches:
            data, off = C.flat(batch.column(1))
            ranges = batch.column(2).to_pylist()
            for i, j in C.blocks(off, S.PIECE):
                u = S.Words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                body, at, end = u.text()
                total, lost, kept = [], [], []
                for d in range(j - i):
                    a, b = int(u.off[d]), int(u.off[d + 1])
                    gone, part, x = 0, [], a
                    for s, t in S.joined(ranges[i + d]).tolist():
                        gone += t - s
                        if a + s > x:
                            part.append(body[at[x] : end[a + s - 1]])
                        x = a + t
                    if x < b:
                        part.append(body[at[x] : end[b - 1]])
                    total.append(b - a)
                    lost.append(gone)
                    kept.append(b" ".join(part))
                cols = [
                    batch.column(0).slice(i, j - i),
                    pa.array(total, pa.int64()),
                    pa.array(lost, pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                ]
                if full:
                    cols.append(pa.array([k.decode() for k in kept]))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(cols)])

    return run


def drop_repeats(docs: DataFrame, window: int = WINDOW, full: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (full) the kept words, of each row of docs (doc_id, text)."""
    C.tune(docs.sparkSession)
    docs = S.keyed(docs)
    m = S.Match(S.Words, window, min(GRAM, window), later=True)
    both = S.with_ranges(docs, S.removed_ranges(docs.select("id", "tag", "text"), m, later_windows))
    return both.mapInArrow(_finish(full), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * full)


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_repeats(C.table(spark, sf_dir, "documents"), full=False)


#: DuckDB: every window of every document, and its first start.
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(0, len(w) - {WINDOW - 1})) AS i FROM d WHERE len(w) >= {WINDOW}),
h AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + {WINDOW}], ' ') AS s FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM h),
g AS (SELECT DISTINCT doc_id, i + unnest(range(0, {WINDOW})) AS p FROM f WHERE n > 1),
r AS (SELECT doc_id, count(*) AS n_removed, list(p) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
    ELSE coalesce(array_to_string(list_transform(list_sort(list_filter(range(0, len(w)), lambda i: NOT list_contains(gone, i))), lambda i: w[i + 1]), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
