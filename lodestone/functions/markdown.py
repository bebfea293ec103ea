"""Lines of Markdown text: fenced blocks, what stands outside of them, and code spans. Text is read, never rendered."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_MARK = re.compile(r"(?P<indent> {0,3})(?P<mark>`{3,}|~{3,})(?P<info>.*)")
_TITLE = re.compile(r" {0,3}#{1,6}(?:[ \t]+(?P<title>.*))?")


class Fence(NamedTuple):
    """A fenced block of lines[first:end]; closed is false where the text ends before its closing mark."""

    first: int
    end: int
    indent: int
    info: str
    closed: bool


def split_lines(text: str) -> list[str]:
    return re.split(r"\r\n|\r|\n", text)


def fence_at(lines: list[str], at: int, quoted_info: bool = True) -> Fence | None:
    """The block that the mark on lines[at] opens; quoted_info: whether a line with more backticks after its own is a mark."""
    m = _MARK.fullmatch(lines[at])
    if not m or (not quoted_info and m["mark"][0] == "`" and "`" in m["info"]):
        return None
    closing = re.compile(rf" {{0,3}}{re.escape(m['mark'])}{re.escape(m['mark'][0])}*\s*")
    end = next((k for k in range(at + 1, len(lines)) if closing.fullmatch(lines[k])), None)
    return Fence(at + 1, len(lines) if end is None else end, len(m["indent"]), m["info"].strip(), end is not None)


def comment_end(lines: list[str], at: int) -> int | None:
    """The line after a comment that begins on lines[at]; its first and last line count as comment as a whole."""
    if "<!--" not in lines[at]:
        return None
    ends = (k for k in range(at, len(lines)) if lines[k].rfind("-->") > lines[k].rfind("<!--"))
    return next(ends, len(lines) - 1) + 1


def prose(text: str) -> Iterator[tuple[int, str]]:
    """(line number, line) of what is neither fenced, commented, indented code, quoted nor empty."""
    lines = split_lines(text)
    at = 0
    while at < len(lines):
        after = comment_end(lines, at)
        if after is None and (fence := fence_at(lines, at, quoted_info=False)):
            after = fence.end + 1
        if after is not None:
            at = after
            continue
        line = lines[at]
        at += 1
        if line.strip() and not line.startswith(("    ", "\t")) and line.lstrip()[0] != ">":
            yield at, line


def title(line: str) -> str | None:
    """The text of a heading line; None if it is none."""
    m = _TITLE.fullmatch(line)
    return m and re.sub(r"(^|[ \t]+)#+[ \t]*$", "", m["title"] or "").strip()


def code_spans(line: str) -> list[str]:
    """What stands between runs of backticks of one length; a run after an odd number of backslashes opens nothing."""
    runs = [m.span() for m in re.finditer("`+", line)]
    out, k = [], 0
    while k < len(runs):
        begin, end = runs[k]
        before = line[:begin]
        escaped = (len(before) - len(before.rstrip("\\"))) % 2 == 1
        twin = None if escaped else next((j for j in range(k + 1, len(runs)) if runs[j][1] - runs[j][0] == end - begin), None)
        if twin is not None:
            out.append(line[end : runs[twin][0]])
            k = twin
        k += 1
    return out
