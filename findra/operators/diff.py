"""Line diffs: shortest edit scripts, hunks with context, unified text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = 3


def _meeting(x: list[str], y: list[str], x0: int, x1: int, y0: int, y1: int) -> tuple[int, int, int, int]:
    """A run of equal lines, from ``(a, b)`` to ``(c, d)``, in the middle of a shortest path through the rectangle.

    Paths grow from both corners at once, by one change a step, until they meet; only their furthest ends are held.
    """
    n, m = x1 - x0, y1 - y0
    odd, shift = (n - m) & 1, n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            i = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            j = i - k
            a, b = i, j
            while i < n and j < m and x[x0 + i] == y[y0 + j]:
                i, j = i + 1, j + 1
            ahead[k] = i
            if odd and abs(shift - k) < d and i + back.get(shift - k, -1) >= n:
                return x0 + a, y0 + b, x0 + i, y0 + j
        for k in range(-d, d + 1, 2):
            i = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            j = i - k
            a, b = i, j
            while i < n and j < m and x[x1 - 1 - i] == y[y1 - 1 - j]:
                i, j = i + 1, j + 1
            back[k] = i
            if not odd and abs(shift - k) <= d and i + ahead.get(shift - k, -1) >= n:
                return x1 - i, y1 - j, x1 - a, y1 - b
    raise AssertionError("paths meet")


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """A shortest script of (mark, line) from ``a`` to ``b``; marks are space, minus and plus.

    Rectangles are halved where paths from both their corners meet, so memory is linear in the lines.
    """
    out: list[tuple[str, str]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        x0, x1, y0, y1 = todo.pop()
        while x0 < x1 and y0 < y1 and a[x0] == b[y0]:
            out.append((" ", a[x0]))
            x0, y0 = x0 + 1, y0 + 1
        if x0 == x1 or y0 == y1:
            out += [("-", s) for s in a[x0:x1]] + [("+", s) for s in b[y0:y1]]
            continue
        p, q, r, s = _meeting(a, b, x0, x1, y0, y1)
        if (p, q) == (x0, y0) and (r, s) == (x1, y1):  # nothing but equal lines
            out += [(" ", line) for line in a[p:r]]
            continue
        todo.append((r, x1, s, y1))
        todo.append((p, r, q, s))
        todo.append((x0, p, y0, q))
    return out


def hunks(script: list[tuple[str, str]], context: int = CONTEXT) -> list[tuple[int, int, int, int, list[str]]]:
    """Changed runs with context, merged where they touch: start and length on both sides, and marked lines."""
    changed = [i for i, (m, _) in enumerate(script) if m != " "]
    ranges: list[list[int]] = []
    for i in changed:
        lo, hi = max(0, i - context), min(len(script), i + context + 1)
        if ranges and lo <= ranges[-1][1]:
            ranges[-1][1] = hi
        else:
            ranges.append([lo, hi])
    out, i, old, new = [], 0, 1, 1
    for lo, hi in ranges:
        for m, _ in script[i:lo]:
            old, new = old + (m != "+"), new + (m != "-")
        part = script[lo:hi]
        a, b = sum(m != "+" for m, _ in part), sum(m != "-" for m, _ in part)
        out.append((old if a else old - 1, a, new if b else new - 1, b, [m + s for m, s in part]))
        old, new, i = old + a, new + b, hi
    return out


def unified(before: str, after: str, path: str = "") -> str:
    """Unified diff text; empty for equal texts."""
    if before == after:
        return ""
    parts = [f"--- {path}", f"+++ {path}"]
    for a, n, b, m, body in hunks(edit_script(before.split("\n"), after.split("\n"))):
        parts += [f"@@ -{a},{n} +{b},{m} @@", *body]
    return "\n".join(parts) + "\n"


def diffed(pairs: DataFrame) -> DataFrame:
    """``pairs`` (``before``, ``after``) with numbers of removed and added lines and of hunks; a null side has no lines."""

    @F.pandas_udf("removed int, added int, hunks int")
    def measured(before: pd.Series, after: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(before, after, strict=True):
            script = edit_script(a.split("\n") if a is not None else [], b.split("\n") if b is not None else [])
            rows.append((sum(m == "-" for m, _ in script), sum(m == "+" for m, _ in script), len(hunks(script))))
        return pd.DataFrame(rows, columns=["removed", "added", "hunks"])

    return pairs.withColumn("_m", measured("before", "after")).select(*[c for c in pairs.columns], "_m.removed", "_m.added", "_m.hunks")
