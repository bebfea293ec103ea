"""Shared pieces of the training-data operators: loading, sharding, byte-level tokenising."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python: rows at most (whole texts; numpy works on slices of BLOCK bytes of them).
BATCH_ROWS = 512
BLOCK = 4 << 20
#: Stands for a null doc_id in joins; no document may carry it.
NULL_ID = -(2**63)

_rng = np.random.default_rng(20240501)
BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULT = 0x9E3779B97F4A7C15
MULT_INV = pow(MULT, -1, 2**64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that a Python worker holds a few MB of texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and cuts the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(True)


_held: dict[str, object] = {}
_last: list[str] = []


def take_turn(name: str, forget=None) -> None:
    """An operator begins in this Python worker: what others have cached in it goes, and the memory that they freed goes back to the
    system. forget() drops the operator's own cache later."""
    for other in [k for k in _held if k != name]:
        _held.pop(other)()
    if _last and _last[0] != name:
        give_back()
    _last[:] = [name]
    if forget is not None:
        _held[name] = forget


def give_back() -> None:
    """Arrow and the C library keep freed memory for themselves, over 100 MB after some operators."""
    _pow.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def shards(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5; 0 is held out. Null ids count as 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(1))


def as_binary(col: pa.Array) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col if pa.types.is_large_binary(col.type) else col.cast(pa.large_binary()) if pa.types.is_binary(col.type) else col.cast(pa.large_string()).cast(pa.large_binary())


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array (null: empty) and the n + 1 offsets."""
    col = as_binary(col)
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8).copy()
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK):
    """Row ranges of about `limit` bytes; one very long text makes a block of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 mod 2 ** 64; kept for later calls."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        a = np.full(size, base, np.uint64)
        a[0] = 1
        have = _pow[base] = np.cumprod(a)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser, so that all bits of a polynomial hash are good."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def prefix(values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[i:j] * MULT ** position, for span()."""
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(MULT, len(values)), out=s[1:])
    return s


def span(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each [start, end), equal for equal contents wherever they stand."""
    return mix((s[end] - s[start]) * powers(MULT_INV, len(s))[start])


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Separators of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of lower-cased text.
PLAIN = np.ones(256, bool)
PLAIN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def words(data: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (by default [^\\x20\\x09-\\x0D]+) of each text: starts, ends (in data) and the n + 1 word offsets of the texts."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = between[data]
    begin = np.zeros(len(data) + 1, bool)
    begin[off] = True  # a text ends the word before
    inner = ~gap
    first = inner.copy()
    first[1:] &= gap[:-1] | begin[1:]
    starts = np.flatnonzero(first)
    last = inner[:-1] & (gap[1:] | begin[1:])
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def slide_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    size, out = 1, a
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(a) - w + 1], out[w - size : len(a) - size + 1]) if w > size else out


def runs(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Leftmost-minimum positions of the windows of w values, run by run: (anchor, first window).

    Windows are numbered by their first value. The top 40 bits are compared, then the position."""
    m = slide_min((h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64), w) & np.uint64(0xFFFFFF)
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    return m[first].astype(np.int64), first


def runs_long(h: np.ndarray, w: int, piece: int = 1 << 23) -> tuple[np.ndarray, np.ndarray]:
    """runs() for any length: pieces that overlap by w - 1 values; a run cut at a border stays in two."""
    if len(h) <= piece:
        return runs(h, w)
    out = []
    for at in range(0, len(h) - w + 1, piece - w + 1):
        a, f = runs(h[at : at + piece], w)
        out.append((a + at, f + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pack(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b)


_unzip = zstandard.ZstdDecompressor()


def unpack(b: bytes) -> bytes:
    return _unzip.decompress(b) if b else b""
