"""Sinks: text, JSON and HTML reports, baseline files, guarded source rewriting.

Reports are read by people, so they go to one place: rows stream to the driver in order and are never
held together, and limits are applied in Spark before.
"""

from __future__ import annotations

import hashlib
import html
import json
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import findings as algebra

HTML_LIMIT = 1000


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*algebra.canonical_order())


def text_lines(findings: DataFrame, files: DataFrame | None = None) -> Iterator[str]:
    """One line a finding, with its source line where ``files`` (``path, content``) are given."""
    rows = findings
    if files is not None:
        source = F.split(F.decode("content", "UTF-8"), "\n", -1)
        wanted = findings.select(F.col("file").alias("path"), F.col("start.Line").alias("line")).distinct()
        shown = wanted.join(files.select("path", source.alias("lines")), "path").select(F.col("path").alias("file"), "line", F.get("lines", F.col("line") - 1).alias("source"))
        rows = findings.withColumn("line", F.col("start.Line")).join(shown, ["file", "line"], "left")
    for r in ordered(rows).toLocalIterator():
        yield f"{r['file']}:{r['start']['Line']}:{r['start']['Column']}: {r['severity']}: {r['message']} ({r['code']})"
        if files is not None and r["source"] is not None:
            yield "    " + r["source"].strip()


def text_summary(findings: DataFrame) -> Iterator[str]:
    """Counts by code, then the total by severity."""
    for r in algebra.summary_by_code(findings).toLocalIterator():
        yield f"{r['findings']:6d}  {r['severity']:8s} {r['code']}"
    totals = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
    yield ", ".join(f"{totals.get(s, 0)} {s}s" for s in ("error", "warning", "note"))


def _plain(value):
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items() if v is not None}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def json_report(findings: DataFrame, path: str) -> None:
    """An indented array in canonical order; ``[]`` without findings."""
    with open(path, "w", encoding="utf-8") as f:
        first = True
        for r in ordered(findings).toLocalIterator():
            f.write("[\n" if first else ",\n")
            f.write("\n".join("  " + line for line in json.dumps(_plain(r), indent=2, ensure_ascii=False).split("\n")))
            first = False
        f.write("[]\n" if first else "\n]\n")


def html_report(findings: DataFrame, path: str, limit: int = HTML_LIMIT) -> None:
    """A self-contained page: totals with truncated percentages, codes, and a limited turn-taking choice of findings."""
    codes = algebra.summary_by_code(findings).collect()  # a row for each check
    total = sum(r["findings"] for r in codes) or 1
    top = max((r["findings"] for r in codes), default=1)
    shown = algebra.stratified_limit(findings, "code", algebra.canonical_order(), limit).drop("turn")
    with open(path, "w", encoding="utf-8") as f:
        f.write("<!doctype html><meta charset=utf-8><title>Findings</title><style>body{font:14px sans-serif}td{padding:2px 8px}</style><h1>Findings</h1><table>\n")
        for r in codes:
            f.write(f"<tr><td>{html.escape(r['code'])}<td>{r['severity']}<td>{r['findings']}<td>{100 * r['findings'] // total}%<td><meter max=100 value={100 * r['findings'] // top}></meter>\n")
        f.write("</table>\n")
        file = None
        for r in ordered(shown).toLocalIterator():
            if r["file"] != file:
                file = r["file"]
                f.write(f"<h2>{html.escape(file)}</h2>\n")
            f.write(f"<p>{r['start']['Line']}:{r['start']['Column']} <b>{html.escape(r['code'])}</b> {html.escape(r['message'])}</p>\n")


def write_baseline(baseline: DataFrame, path: str) -> None:
    """A baseline file, written beside its place and moved over it, readable by its owner only."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write("version = 1\n")
        for r in baseline.orderBy(*algebra.ISSUE_KEY).toLocalIterator():
            f.write(f"\n[[issues]]\nfile = {json.dumps(r['file'])}\ncode = {json.dumps(r['code'])}\nstart-line = {r['start_line']}\nend-line = {r['end_line']}\n")
    os.chmod(temporary, 0o600)
    os.replace(temporary, path)


def rewrite(changes: dict[str, tuple[bytes, bytes]], guards: dict[str, bytes] | None = None) -> None:
    """Replaces files (path to content before and after) only if all of them, and the guards, are as they were.

    Contents are checked before anything is staged and again before each rename; two paths to one file
    are refused. On failure staged files are removed and files already renamed are put back.
    """
    def unchanged(path: str, before: bytes) -> None:
        with open(path, "rb") as f:
            if hashlib.sha256(f.read()).digest() != hashlib.sha256(before).digest():
                raise RuntimeError(f"changed meanwhile: {path}")

    targets: dict[str, str] = {}
    for path in changes:
        real = os.path.realpath(path)
        if real in targets:
            raise RuntimeError(f"one file by two paths: {targets[real]}, {path}")
        targets[real] = path
    for path, before in [*((p, b) for p, (b, _) in changes.items()), *(guards or {}).items()]:
        unchanged(path, before)
    staged: list[tuple[str, str, bytes]] = []
    done: list[tuple[str, bytes]] = []
    try:
        for path, (before, after) in changes.items():
            real = os.path.realpath(path)
            handle, temporary = tempfile.mkstemp(dir=os.path.dirname(real))
            with os.fdopen(handle, "wb") as f:
                f.write(after)
            os.chmod(temporary, os.stat(real).st_mode & 0o7777)
            staged.append((temporary, real, before))
        for temporary, real, before in staged:
            unchanged(real, before)
            os.replace(temporary, real)
            done.append((real, before))
    except BaseException:
        for real, before in done:
            with open(real, "wb") as f:
                f.write(before)
        raise
    finally:
        for temporary, _, _ in staged:
            if os.path.exists(temporary):
                os.remove(temporary)
