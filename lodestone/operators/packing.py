"""Text chunks, lossless blocks, top files and size-bounded packets."""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import top_rows

# Chunk length and stride in lines; the largest block.
LINES, STRIDE = 40, 32
BLOCK_BYTES = 250_000


def text_chunks(df: DataFrame, row: str, text: str, lines: int = LINES, stride: int = STRIDE) -> DataFrame:
    """(row, start_line, end_line, chunk): windows of lines, each starting `stride` after the one before; whole texts."""
    own = df.select(row, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("_l"))
    starts = F.explode(F.sequence(F.lit(0), F.size("_l") - 1, F.lit(stride))).alias("_s")
    c = own.select(row, "_l", starts)
    part = F.slice("_l", F.col("_s") + 1, lines)
    return c.select(row, (F.col("_s") + 1).alias("start_line"), (F.col("_s") + F.size(part)).alias("end_line"), F.array_join(part, "\n").alias("chunk"))


def cut_points(size: int, most: int, boundaries: list[int]) -> list[int]:
    """Ends of blocks of up to `most` bytes; each ends at the last boundary that it reaches, if there is one."""
    ends, at, b = [], 0, sorted(set(boundaries))
    while at < size:
        end = min(at + most, size)
        if end < size:
            i = bisect_right(b, end)
            if i and b[i - 1] > at:
                end = b[i - 1]
        ends.append(end)
        at = end
    return ends


def _blocks(most: int):
    def run(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (t or "").encode()
                lines = [k + 1 for k, x in enumerate(data) if x == 10 and k + 1 < len(data)] if len(data) > most else []
                at = 0
                for n, end in enumerate(cut_points(len(data), most, lines)):
                    rows.append((i, n, at, end, hashlib.sha256(data[at:end]).hexdigest(), data[at:end]))
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["row_id", "block", "start", "end", "sha256", "body"])

    return run


def blocks(df: DataFrame, row: str, text: str, most: int = BLOCK_BYTES) -> DataFrame:
    """(row_id, block, start, end, sha256, body): a text's bytes in blocks that prefer to end at line ends.

    Greedy cuts depend on the cuts before, so a text is cut in Python, one Arrow batch at a time."""
    return df.select(F.col(row).cast("long"), text).mapInArrow(_blocks(most), "row_id long, block long, start long, end long, sha256 string, body binary")


def rebuild(parts: DataFrame) -> DataFrame:
    """(row_id, blocks, bytes, sha256, code): blocks put together again, each checked for place and digest."""
    p = parts.withColumn("_ok", F.sha2("body", 256) == F.col("sha256"))
    g = p.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("block", "start", "end", F.hex("body").alias("h"), "_ok"))).alias("b"))
    whole = F.unhex(F.array_join(F.transform("b", lambda x: x["h"]), ""))
    # the i-th block is number i, and starts where the one before it ends
    placed = F.forall(F.transform("b", lambda x, i: (x["block"] == i) & (x["start"] == F.when(i == 0, F.lit(0)).otherwise(F.get("b", i - 1)["end"]))), lambda x: x)
    code = F.when(F.exists("b", lambda x: ~x["_ok"]), "SOURCE_BLOCK_HASH").when(~placed, "SOURCE_BLOCK_ORDER").otherwise("OK")
    return g.select("row_id", F.size("b").cast("long").alias("blocks"), F.octet_length(whole).cast("long").alias("bytes"), F.sha2(whole, 256).alias("sha256"), code.alias("code"))


def priority_files(df: DataFrame, repo: str, path: str, terms: list[str], n: int) -> DataFrame:
    """The first n files of each repository: most terms in the path, then shortest, then by name."""
    low = F.lower(path)
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return top_rows(df.withColumn("hits", hits), [repo], [F.desc("hits"), F.length(path), F.col(path)], n)


MOST_ROWS = 10_000


def fits(df: DataFrame, by: list[str], order: list[Column], size: str, most: int) -> list[dict]:
    """Rows of a short ranked report that fit into `most` bytes: a row that is too large is skipped, later ones may fit.

    Skipping makes the choice sequential; it is made on the driver from keys and sizes alone, so a report of more than MOST_ROWS rows is
    refused. research.compact_packet() does the same for reports of any size and number."""
    rows = df.select(*by, size).orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("REPORT_ROW_LIMIT")
    left, out = most, []
    for r in rows:
        if r[size] <= left:
            left -= r[size]
            out.append(r.asDict())
    return out
