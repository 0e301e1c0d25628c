"""A formatter for white space and import order: a part of canonical rendering, never a change of tokens.

What it settles: line ends, trailing white space, runs of blank lines, blank lines next to braces,
indentation by tabs, spaces after commas and inside brackets, the order of import specs within a block
of lines, and one line end at the end of the file. What it leaves as it is: alignment, line width, spaces
around operators, and everything inside raw strings and block comments.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexer import Source, SourceError
from .parser import parse

_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")
#: After these a statement does not go on in the next line, though no semicolon is inserted.
_NO_CONTINUATION = frozenset("([{,;:")


@dataclass
class _Piece:
    """A token or comment with the white space before it."""

    kind: str
    text: str
    start: int
    breaks: int  # line ends before it
    gap: str  # spaces and tabs before it, if on the same line


def _pieces(source: Source, data: bytes) -> list[_Piece]:
    found = sorted([(t.start, t.end, t.kind) for t in source.tokens if t.end > t.start] + [(c.start, c.end, "comment") for c in source.comments])
    out, at = [], 0
    for start, end, kind in found:
        between = data[at:start]
        text = data[start:end].decode("utf-8", "surrogateescape")
        if kind == "comment":
            text = text.rstrip() if text.startswith("//") else text.replace("\r\n", "\n")
        out.append(_Piece(kind, text, start, between.count(b"\n"), between.decode("ascii", "replace").replace("\r", "").replace("\n", "")))
        at = end
    return out


def _lines(pieces: list[_Piece]) -> list[tuple[int, list[_Piece]]]:
    """Line ends before each line, and its pieces."""
    lines: list[tuple[int, list[_Piece]]] = []
    for p in pieces:
        if not lines or p.breaks:
            lines.append((p.breaks, [p]))
        else:
            lines[-1][1].append(p)
    return lines


def _joined(pieces: list[_Piece]) -> str:
    """A line's text with the spaces that are not in doubt settled."""
    out = pieces[0].text
    for before, p in zip(pieces, pieces[1:], strict=False):
        gap = p.gap
        if p.kind != "comment" and before.kind != "comment":
            if p.text in (",", ";", ")", "]") and before.text != ";" or before.text in ("(", "["):
                gap = ""
            elif before.text == ",":
                gap = " "
        elif before.text == "," and not gap:
            gap = " "
        out += gap + p.text
    return out


def _sorted_imports(lines: list[tuple[int, list[_Piece]]]) -> list[tuple[int, list[_Piece]]]:
    """Import specs in order of their paths, within lines that no blank line or comment line parts."""
    out = list(lines)
    inside, run = False, []

    def settle() -> None:
        if len(run) > 1:
            key = lambda k: next(p.text for p in lines[k][1] if p.kind == "string").strip('"`')
            for at, k in zip(run, sorted(run, key=key), strict=True):
                out[at] = (lines[at][0], lines[k][1])
        run.clear()

    for i, (breaks, pieces) in enumerate(lines):
        words = [p.text for p in pieces if p.kind != "comment"]
        if words[:2] == ["import", "("] and len(words) == 2:
            inside = True
            continue
        if not inside:
            continue
        spec = words and [p.kind for p in pieces if p.kind != "comment"][-1] == "string" and len(words) <= 2
        if breaks > 1 or not spec or any(p.kind == "comment" and p.text.startswith("/*") for p in pieces):
            settle()
        if spec and not any(p.kind == "comment" and p.text.startswith("/*") for p in pieces):
            run.append(i)
        if words[:1] == [")"]:
            settle()
            inside = False
    settle()
    return out


def formatted(data: bytes) -> bytes:
    """The file with its white space and import order settled; an unreadable file raises ``SourceError``."""
    parse(data)
    source = Source(data)
    lines = _sorted_imports(_lines(_pieces(source, data)))
    closing = {t.start for t, after in zip(source.tokens, source.tokens[1:], strict=False) if after.end == after.start and after.kind != "eof"}
    opened: list[int] = []  # the line of each open bracket
    out: list[str] = []
    last: _Piece | None = None
    ended = True  # the statement before is over
    for number, (breaks, pieces) in enumerate(lines):
        first = pieces[0]
        for p in pieces:
            if p.kind == "comment" or p.text not in _CLOSE:
                break
            if opened:
                opened.pop()
        depth = len(set(opened))
        if opened and first.text in ("case", "default") and first.kind == "keyword":
            depth -= 1
        elif opened and first.kind == "ident" and len(pieces) > 1 and pieces[1].text == ":" and ended and len(pieces) == 2:
            depth -= 1  # a label
        elif not ended and first.kind != "comment" and first.text not in _CLOSE:
            depth += 1
        if out:
            near = last is not None and last.text == "{" or first.text == "}"
            out.append("\n" if near or breaks < 2 else "\n\n")
        out.append("\t" * max(0, depth) + _joined(pieces))
        leading = True
        for p in pieces:
            if p.kind == "comment":
                leading = False
                continue
            if p.text in _OPEN:
                opened.append(number)
            elif p.text in _CLOSE:
                if not leading and opened:
                    opened.pop()
                continue
            leading = False
        code = [p for p in pieces if p.kind != "comment"]
        if code:
            last = code[-1]
            ended = last.text in _NO_CONTINUATION or last.start in closing
        elif first.kind == "comment":
            last = None
    return ("".join(out) + "\n").encode("utf-8", "surrogateescape") if out else b""


def rewritten(files: DataFrame) -> DataFrame:
    """``path, content, formatted`` of files that formatting changes; unreadable files are left out."""

    @F.pandas_udf("binary")
    def settled(contents: pd.Series) -> pd.Series:
        def one(c) -> bytes | None:
            data = bytes(c or b"")
            try:
                return formatted(data)
            except SourceError:
                return None

        return pd.Series([one(c) for c in contents], dtype=object)

    return files.select("path", "content", settled("content").alias("formatted")).where("formatted IS NOT NULL AND formatted <> content")
