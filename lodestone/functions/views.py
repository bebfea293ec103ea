"""Views of texts and JSON values: fence indentation, line offsets, draft cues, exact equality, digests, case folding."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import canon

TAB = 4
# What a cue is told by, and the limits of a cue.
CUES = {
    "manual": r"\b(manually|manual|re-enter|copy and paste)\b",
    "requirement": r"\b(must|requires?|need(?:s)? to)\b",
    "limitation": r"\b(cannot|not supported|does not|missing|without)\b",
}
MOST_CUES, MOST_SPAN = 12, 1500


def without_indent(line: str, indent: int) -> str:
    """A line without its first `indent` columns of blanks; what is left of a tab that reaches beyond them becomes spaces."""
    blanks = re.match(r"[ \t]*", line)[0]
    width = 0
    for k, c in enumerate(blanks):
        if width >= indent:
            return " " * (width - indent) + line[k:]
        width += 1 if c == " " else TAB - width % TAB
    return " " * max(0, width - indent) + line[len(blanks) :]


def lines_of(text: str) -> list[str]:
    """Lines with their ends."""
    return re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z", text)


def fence_view(text: Column | str, indent: int) -> Column:
    """A fenced block's text as it reads, when its fence is indented; line ends stay."""

    def view(s: pd.Series) -> pd.Series:
        return s.map(lambda t: "".join(without_indent(x, indent) for x in lines_of(t)), na_action="ignore")

    return F.pandas_udf(view, "string")(text)


def line_offsets(text: Column | str) -> Column:
    """Byte offsets at which the lines of a text begin, and its end."""

    def offsets(s: pd.Series) -> pd.Series:
        def one(t):
            at = [0]
            for x in lines_of(t or ""):
                at.append(at[-1] + len(x.encode()))
            return at

        return s.map(one)

    return F.pandas_udf(offsets, "array<long>")(text)


def window(offsets: Column, start_line: Column, end_line: Column) -> Column:
    """struct(start, end) in bytes of lines start_line to end_line, by a text's own line offsets; null where there are no such lines."""
    inside = (start_line >= 1) & (start_line <= end_line) & (end_line < F.size(offsets))
    return F.when(inside, F.struct(F.get(offsets, (start_line - 1).cast("int")).alias("start"), F.get(offsets, end_line.cast("int")).alias("end")))


def _exact(text: str | None) -> str | None:
    try:
        return None if text is None else canon.canonical(json.loads(text))
    except (ValueError, RecursionError):
        return None


def same_json(a: Column | str, b: Column | str) -> Column:
    """Whether two JSON texts hold the same value, to the spelling of its numbers: true is not 1, and 1 is not 1.0. Null if one is none."""

    def same(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = [(_exact(p), _exact(q)) for p, q in zip(x, y, strict=True)]
        return pd.Series([None if p is None or q is None else p == q for p, q in pairs], dtype=object)

    return F.pandas_udf(same, "boolean")(a, b)


def record_digests(text: Column | str) -> Column:
    """struct(plain, strict, code): a record's digest as any parser reads it, and as a strict one does (null with a refusal code)."""

    def one(t: str | None):
        try:
            plain = hashlib.sha256(repr(json.loads(t or "")).encode()).hexdigest()
        except (ValueError, RecursionError):
            plain = None
        try:
            if not 0 < len((t or "").encode()) <= 100_000:
                raise canon.Refused("JSON_RECORD_BYTE_LIMIT")
            value = canon.strict(t)
            if not isinstance(value, dict):
                raise canon.Refused("JSON_OBJECT_REQUIRED")
            return plain, hashlib.sha256(canon.canonical(value).encode()).hexdigest(), "OK"
        except canon.Refused as e:
            return plain, None, str(e)

    return F.pandas_udf(lambda s: pd.DataFrame([one(t) for t in s], columns=["plain", "strict", "code"], dtype=object), "plain string, strict string, code string")(text)


def casefold(text: Column | str) -> Column:
    return F.pandas_udf(lambda s: s.map(str.casefold, na_action="ignore"), "string")(text)


def folded(text: Column | str) -> Column:
    """Case-folded text with each run of white space as one space, none at the ends."""
    return F.pandas_udf(lambda s: s.map(lambda t: " ".join(t.casefold().split()), na_action="ignore"), "string")(text)


def cues(text: str):
    """(cue, start, end) of sentences that hold a cue: from the full stop or line end before to the full stop behind."""
    for cue, pattern in CUES.items():
        for m in list(re.finditer(pattern, text, re.I))[:MOST_CUES]:
            before = max(text.rfind(c, 0, m.start()) for c in ".\n")
            stop = text.find(".", m.end())
            end = stop + 1 if stop >= 0 else len(text)
            if end - before - 1 <= MOST_SPAN:
                yield cue, before + 1, end


def draft_cues(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cue, start, end, quote) of each text's cues: code points, end exclusive."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(k, c, a, b, t[a:b]) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c, a, b in cues(t or "")]
            keys = pa.array([r[0] for r in rows], batch.column(0).type)
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[i] for r in rows], t) for i, t in enumerate((None, pa.string(), pa.int64(), pa.int64(), pa.string())) if i)], ["key", "cue", "start", "end", "quote"])

    return df.select(key, text).mapInArrow(run, f"key {kind}, cue string, start long, end long, quote string").withColumnRenamed("key", key)


def escaped(text: Column | str) -> Column:
    """A text for HTML: the five characters with a meaning replaced. Stays in the JVM."""
    c = F.col(text) if isinstance(text, str) else text
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def table_rows(columns: list[str]) -> Column:
    """One HTML table row of the given columns, escaped; null is empty."""
    cells = [F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def listed(items: Column, cap: int = 20) -> Column:
    """A list for people: one line an item, at most `cap`, and how many more there are."""
    more = F.when(F.size(items) > cap, F.concat(F.lit("\n... "), (F.size(items) - cap).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.transform(F.slice(items, 1, cap), lambda x: F.concat(F.lit("- "), x)), "\n"), more)
