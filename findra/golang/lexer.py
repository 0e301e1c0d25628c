"""A lossless Go lexer: every byte of the source is in exactly one token, comment or gap of white space.

Offsets are bytes from 0, lines and columns count from 1, columns in bytes. Semicolons that the
language inserts at line ends are zero-width tokens.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

#: Fixed values of the language.
KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
PREDECLARED = frozenset(
    "any bool byte comparable complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr true false iota nil "
    "append cap clear close complex copy delete imag len make max min new panic print println real recover".split()
)
_OPERATORS = sorted(
    "+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! ~ != <= >= := ... ( [ { , . ) ] } ; :".split(), key=len, reverse=True
)
_TOKEN = re.compile(
    rb"(?P<space>[ \t\r\n]+)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)"
    rb"|(?P<ident>(?:[A-Za-z_]|[\x80-\xff])(?:[A-Za-z0-9_]|[\x80-\xff])*)"
    rb"|(?P<imag>(?:0[xX][0-9a-fA-F_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)i)"
    rb"|(?P<float>0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?[0-9_]+|[0-9][0-9_]*\.[0-9_]*(?:[eE][+-]?[0-9_]+)?|[0-9][0-9_]*[eE][+-]?[0-9_]+|\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?)"
    rb"|(?P<int>0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|[0-9][0-9_]*)"
    rb"|(?P<char>'(?:\\.[^'\n]*|[^'\\\n]+)')|(?P<string>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`)"
    rb"|(?P<op>" + b"|".join(re.escape(o.encode()) for o in _OPERATORS) + rb")",
    re.S,
)
#: After these a line end inserts a semicolon.
_ENDS = frozenset(["ident", "imag", "float", "int", "char", "string"])
_END_WORDS = frozenset(["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


class SourceError(ValueError):
    """The source cannot be read."""


@dataclass(slots=True)
class Token:
    kind: str  # ident, keyword, op, int, float, imag, char, string, eof
    text: str
    start: int
    end: int


@dataclass(slots=True)
class Comment:
    text: str
    start: int
    end: int


class Source:
    """Tokens and comments of one file."""

    def __init__(self, data: bytes):
        self.data = data
        self.line_starts = [0, *[m.end() for m in re.finditer(b"\n", data)]]
        self.tokens: list[Token] = []
        self.comments: list[Comment] = []
        self._scan()

    def position(self, offset: int) -> tuple[int, int]:
        """Line and column of a byte offset."""
        line = bisect.bisect_right(self.line_starts, offset)
        return line, offset - self.line_starts[line - 1] + 1

    def _scan(self) -> None:
        data, at, pending = self.data, 0, False
        while at < len(data):
            m = _TOKEN.match(data, at)
            if m is None:
                raise SourceError(f"unexpected byte at offset {at}")
            kind, raw = m.lastgroup, m.group()
            if kind in ("space", "line", "block"):
                # A line end, also one inside a comment, closes a statement.
                breaks = b"\n" in raw or (kind == "line" and m.end() == len(data))
                if pending and breaks:
                    where = at + raw.index(b"\n") if kind == "space" else at
                    self.tokens.append(Token("op", ";", where, where))
                    pending = False
                if kind != "space":
                    self.comments.append(Comment(raw.decode("utf-8", "replace"), at, m.end()))
            else:
                text = raw.decode("utf-8", "replace")
                if kind == "ident" and text in KEYWORDS:
                    kind = "keyword"
                self.tokens.append(Token(kind, text, at, m.end()))
                pending = kind in _ENDS or text in _END_WORDS
            at = m.end()
        if pending:
            self.tokens.append(Token("op", ";", at, at))
        self.tokens.append(Token("eof", "", len(data), len(data)))

    def rebuilt(self) -> bytes:
        """The source from its tokens, comments and the white space between: equal to the input."""
        parts = sorted([(t.start, t.end) for t in self.tokens if t.end > t.start] + [(c.start, c.end) for c in self.comments])
        out, at = [], 0
        for start, end in parts:
            gap = self.data[at:start]
            if gap.strip(b" \t\r\n"):
                raise SourceError("lost bytes")
            out += [gap, self.data[start:end]]
            at = end
        return b"".join([*out, self.data[at:]])
