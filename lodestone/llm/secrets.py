"""Secret scans (operator 2): fixed patterns, and character Markov models for what they miss.

Two order-1 character models, one of random strings, one of ordinary identifiers, are trained on labelled samples
(below: seeded random strings of several alphabets, and identifiers put together from common words). A token of 20
or more characters whose mean log-likelihood ratio per transition exceeds THRESHOLD is a span of kind `markov`,
unless it overlaps a base span or lies in a mail address: a local part, @ and a domain with a dot, other than the
credentials and host of a URL.

Scale: one scan without a shuffle; RE2 (through Arrow) picks the texts that can match at all, Python's regular
expressions then read those texts whole.

Defined results: null and empty texts have no spans; repeated rows give equal rows; null ids pass through;
extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so this is [0-9a-f]+ of 16 or more
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
USER = re.compile(r"://[^\s/?#]*@")
MAY_MATCH = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9+/_=-]{20}"""
THRESHOLD = 0.9

WORDS = """get set user name value list item count index file path read write open close start stop time date id key map
data load save parse format text string number node tree graph edge table row column page view model state event handle
error result request response server client config option default build make create delete update insert select query
filter sort merge join group order total average max min length size width height color font image source target message
buffer stream input output thread process worker task queue stack cache memory device driver network socket address host
port session account customer product price invoice payment address city country language version release branch commit
internal external abstract interface implementation factory manager controller service provider container component
international organization administration responsibility communication development environment information""".split()
CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


def samples(n: int = 4000, seed: int = 17) -> tuple[list[str], list[str]]:
    """Labelled samples: random strings and ordinary identifiers."""
    rng = np.random.default_rng(seed)
    alphabets = ["0123456789abcdef", CHARS[:62], CHARS[:64], CHARS[26:62], CHARS[:26] + "0123456789"]
    random = ["".join(rng.choice(list(alphabets[i % len(alphabets)]), rng.integers(20, 65))) for i in range(n)]
    plain = []
    for i in range(n):
        w = [WORDS[k] for k in rng.integers(0, len(WORDS), rng.integers(3, 7))]
        plain.append([w[0] + "".join(x.title() for x in w[1:]), "_".join(w), "-".join(w), "".join(w), "/".join(w), "_".join(w).upper()][i % 6])
    return random, plain


class Markov:
    """Log-likelihood ratio of two order-1 models, as one matrix over character pairs."""

    def __init__(self, random: list[str], plain: list[str]):
        a, b = self.logs(random), self.logs(plain)
        self.ratio = a - b

    @staticmethod
    def codes(s: str) -> np.ndarray:
        x = np.frombuffer(s.encode("ascii", "replace"), np.uint8)
        return np.minimum(x, 127)

    @classmethod
    def logs(cls, strings: list[str]) -> np.ndarray:
        n = np.zeros((128, 128))
        for s in strings:
            x = cls.codes(s)
            np.add.at(n, (x[:-1], x[1:]), 1)
        used = cls.codes(CHARS)
        p = np.zeros((128, 128))
        p[np.ix_(used, used)] = 1.0
        n += p
        total = n.sum(axis=1, keepdims=True)
        return np.log(np.where(n > 0, n, 1) / np.where(total > 0, total, 1))

    def score(self, s: str) -> float:
        """Mean log-likelihood ratio of a transition: above 0 speaks for a random string."""
        x = self.codes(s)
        return float(self.ratio[x[:-1], x[1:]].mean()) if len(x) > 1 else 0.0


_model: list[Markov] = []


def model() -> Markov:
    if not _model:
        _model.append(Markov(*samples()))
    return _model[0]


def mails(text: str) -> list[tuple[int, int]]:
    """(start, end) of all mail addresses. What stands before a URL's host is a credential, not a local part."""
    if "@" not in text:
        return []
    users = {m.end() - 1 for m in USER.finditer(text)}
    return [m.span() for m in MAIL.finditer(text) if text.index("@", m.start()) not in users]


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets by start, then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    taken = [(a, b) for _, a, b in out]
    mail = mails(text)
    begin = [x for x, _ in mail]
    for m in TOKEN.finditer(text):
        a, b = m.span()
        k = bisect_right(begin, a)
        if (k and b <= mail[k - 1][1]) or any(a < y and x < b for x, y in taken):
            continue
        if len(set(m[0])) >= 8 and model().score(m[0]) > THRESHOLD:
            out.append(("markov", a, b))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _digest(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _scan(batches):
    C.take_turn("secrets")
    for batch in batches:
        text = batch.column(1)
        may = pc.fill_null(pc.match_substring_regex(text, MAY_MATCH), False).to_pylist()
        found = [spans(t) if m else [] for t, m in zip(_only(text, may), may, strict=True)]
        base = [[x for x in f if x[0] != "markov"] for f in found]
        count = lambda kind: pa.array([sum(x[0] == kind for x in f) for f in found], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                *map(count, KINDS),
                pa.array([hashlib.sha256(_digest(f).encode()).hexdigest() for f in base]),
                pa.array([_digest(f) for f in found]),
            ],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def _only(text: pa.Array, may: list[bool]):
    it = iter(text.filter(pa.array(may, pa.bool_())).to_pylist())
    return [next(it) if m else "" for m in may]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of each row of docs (doc_id, text)."""
    C.tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def clean(t: str | None) -> str | None:
    """The text with its secrets replaced by [kind]; overlapping spans count as the first. Null stays null."""
    if t is None:
        return None
    out, at = [], 0
    for kind, a, b in spans(t):
        if a >= at:
            out += [t[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, t[at:]]) if out else t


def redact(text):
    """Column of texts with their secrets replaced; Arrow batches."""
    return F.pandas_udf(lambda s: s.map(clean, na_action="ignore"), T.StringType())(text)


def op2_secret_scans(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(C.table(spark, sf_dir, "documents"))
