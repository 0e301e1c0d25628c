"""Go files as DataFrames: nodes, comments, files.

One file is parsed by one task; a file's rows are independent of all others, so the tables scale with the
number of files. Every node row carries its ancestors (outermost first) and a summary of its direct
children, which lets most checks be a filter on one row, without a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import constants
from .lexer import SourceError, Source
from .parser import Node, parse

#: Spellings of more tokens than this are replaced by a digest; they are only compared.
SPELLED_TOKENS = 80

#: ``bare`` and ``bare_kind``: spelling and kind inside all parentheses; ``value``: of a literal; ``constant``: with named constants; ``target``: see ``constants.target``.
CHILD = "struct<role: string, kind: string, name: string, spelling: string, bare_kind: string, bare: string, value: string, constant: string, target: string, id: int, start: int, stop: int>"
NODES = (
    "path string, id int, parent int, ordinal int, role string, kind string, name string, spelling string, start int, stop int, line int, col int, end_line int, end_col int, "
    f"target string, func int, ancestors array<struct<id: int, kind: string, role: string>>, children array<{CHILD}>"
)
COMMENTS = "path string, idx int, text string, start int, stop int, line int, col int, end_line int, blank_before boolean, next_code int, gap_lines int"
_FUNCTIONS = ("FunctionDecl", "MethodDecl", "FunctionLit")


def _spelling(source: Source, n: Node) -> str:
    words = [t.text for t in source.tokens[n.first : n.last] if t.end > t.start]
    text = " ".join(words)
    return text if len(words) <= SPELLED_TOKENS else "#" + hashlib.sha256(text.encode()).hexdigest()


def node_rows(path: str, source: Source, root: Node) -> list[tuple]:
    """Rows of a tree in pre-order; ids are places in it."""
    order: list[tuple[Node, int, int, int, list]] = []
    ids: dict[int, int] = {}
    stack = [(root, -1, 0, -1, [])]
    while stack:
        n, parent, ordinal, func, above = stack.pop()
        ids[id(n)] = me = len(order)
        order.append((n, parent, ordinal, func, above))
        inner = me if n.kind in _FUNCTIONS else func
        below = [*above, {"id": me, "kind": n.kind, "role": n.role}]
        stack.extend((c, me, k, inner, below) for k, c in reversed([*enumerate(n.children)]))
    spelled = {id(n): _spelling(source, n) for n, *_ in order}
    named, packages = constants.named_constants(root), constants.imported(root)

    def child(c: Node) -> dict:
        inner = constants.bare(c)
        return {
            "role": c.role, "kind": c.kind, "name": c.name, "spelling": spelled[id(c)], "bare_kind": inner.kind, "bare": spelled[id(inner)], "value": constants.literal(c),
            "constant": constants.constant(c, named), "target": constants.target(c, packages), "id": ids[id(c)], "start": c.start, "stop": c.end,
        }

    rows = []
    for me, (n, parent, ordinal, func, above) in enumerate(order):
        line, col = source.position(n.start)
        end_line, end_col = source.position(n.end)
        named_by = constants.target(n, packages) if n.kind in ("Call", "Selector") else ""
        rows.append((path, me, parent, ordinal, n.role, n.kind, n.name, spelled[id(n)], n.start, n.end, line, col, end_line, end_col, named_by, func, above, [child(c) for c in n.children]))
    return rows


def nodes(files: DataFrame, strict: bool = True) -> DataFrame:
    """The node table of ``files`` (``path``, ``content`` binary). A file that cannot be parsed fails the job, or with
    ``strict`` off is left out (see ``failures``)."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in "path id parent ordinal role kind name spelling start stop line col end_line end_col target func ancestors children".split()]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    source, root = parse(bytes(content or b""))
                except SourceError as e:
                    if strict:
                        raise SourceError(f"{path}: {e}") from e
                    continue
                yield pd.DataFrame(node_rows(path, source, root), columns=names)

    return files.select("path", "content").mapInPandas(parsed, NODES)


def lines(files: DataFrame) -> DataFrame:
    """``path, line_starts``: the byte offset at which each line begins."""

    @F.pandas_udf("array<int>")
    def starts(contents: pd.Series) -> pd.Series:
        return pd.Series([np.append(0, np.flatnonzero(np.frombuffer(bytes(c or b""), np.uint8) == 10) + 1).astype(np.int32) for c in contents], dtype=object)

    return files.select("path", starts("content").alias("line_starts"))


def line_of(at: Column, starts: str = "line_starts") -> Column:
    """The line, from 1, of a byte offset, by binary search in the starts."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"] + 1, 1)
        right = F.get(starts, mid) <= at
        return F.struct(F.when(right, mid).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(F.greatest(s["lo"], mid - 1)).alias("hi"))

    span = F.struct(F.lit(0).alias("lo"), (F.size(starts) - 1).alias("hi"))
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(starts).cast("bigint"))))
    return F.aggregate(steps, span, halve, lambda s: s["lo"] + 1)


def failures(files: DataFrame) -> DataFrame:
    """``path, error`` of files that cannot be parsed."""

    @F.pandas_udf("string")
    def error(contents: pd.Series) -> pd.Series:
        out = []
        for c in contents:
            try:
                parse(bytes(c or b""))
                out.append(None)
            except SourceError as e:
                out.append(str(e))
        return pd.Series(out, dtype=object)

    return files.select("path", error("content").alias("error")).where("error IS NOT NULL")


def comments(files: DataFrame) -> DataFrame:
    """Comments in order, each with the offset of the code that follows and the line breaks between."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = "path idx text start stop line col end_line blank_before next_code gap_lines".split()
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(content or b"")
                try:
                    source = Source(data)
                except SourceError:
                    continue
                code = [t.start for t in source.tokens if t.end > t.start]
                starts = sorted([*code, *[c.start for c in source.comments]])
                rows, k = [], 0
                for i, c in enumerate(source.comments):
                    while k < len(starts) and starts[k] < c.end:
                        k += 1
                    following = starts[k] if k < len(starts) else len(data)
                    line, col = source.position(c.start)
                    before = data[source.line_starts[line - 1] : c.start]
                    rows.append((path, i, c.text, c.start, c.end, line, col, source.position(c.end)[0], not before.strip(), following, data[c.end : following].count(b"\n")))
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(read, COMMENTS)
