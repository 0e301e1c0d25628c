"""Regression runs over a corpus of projects: measured operations against budgets and recorded results."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classified(operations: DataFrame, recorded: DataFrame) -> DataFrame:
    """Operations with what became of them.

    ``operations``: ``name, operation, findings, digest, duration_ms, budget_ms, error``; ``recorded``: ``name,
    operation, findings, digest``. Adds ``baseline`` (same, changed; a missing record is changed),
    ``performance`` (error before slower before within) and ``status`` (pass if same and within).
    """
    was = recorded.select("name", "operation", F.col("findings").alias("was_findings"), F.col("digest").alias("was_digest"), F.lit(True).alias("recorded"))
    rows = operations.join(was, ["name", "operation"], "left")
    same = F.coalesce("recorded", F.lit(False)) & F.col("findings").eqNullSafe(F.col("was_findings")) & F.col("digest").eqNullSafe(F.col("was_digest"))
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    within = F.coalesce(F.col("duration_ms") <= F.col("budget_ms"), F.lit(False))
    rows = rows.withColumns(
        {
            "baseline": F.when(same, "same").otherwise("changed"),
            "performance": F.when(failed, "error").when(within, "within").otherwise("slower"),
            "status": F.when(same & within & ~failed, "pass").otherwise("fail"),
        }
    )
    return rows.drop("was_findings", "was_digest", "recorded")


def any_error(operations: DataFrame) -> bool:
    """Whether an operation failed; recorded results are not replaced then."""
    return bool(operations.agg(F.bool_or(F.coalesce(F.col("error"), F.lit("")) != "")).first()[0])


def by_code(findings: DataFrame) -> DataFrame:
    """``project, code, findings``: counts of each project's codes."""
    return findings.groupBy("project", "code").agg(F.count(F.lit(1)).alias("findings"))


def source_lines(content: Column) -> Column:
    """Lines of a text that hold more than white space; null has none."""
    return F.coalesce(F.size(F.filter(F.split(content, "\n", -1), lambda s: F.trim(F.translate(s, "\t\r", "  ")) != "")), F.lit(0))


def plural(n: Column, word: str) -> Column:
    """A count with its word, in the plural unless it is 1."""
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))


def timing(operations: DataFrame, project: str) -> dict[str, int]:
    """Milliseconds of one project's operations; all must be positive."""
    rows = {r["operation"]: r["duration_ms"] for r in operations.where(F.col("name") == project).select("operation", "duration_ms").collect()}
    if not rows or any(v is None or v <= 0 for v in rows.values()):
        raise ValueError(f"no positive timings of {project}")
    return rows


def summary_lines(rows: DataFrame) -> list[str]:
    """A Markdown table of classified operations (a row for each project and operation)."""
    out = ["| Project | Operation | Findings | Time | Budget | Baseline | Performance |", "| --- | --- | ---: | ---: | ---: | --- | --- |"]
    for r in rows.orderBy("name", "operation").toLocalIterator():
        out.append(f"| {r['name']} | {r['operation']} | {r['findings']} | {r['duration_ms'] / 1000:.2f}s | {r['budget_ms'] / 1000:.2f}s | {r['baseline']} | {r['performance']} |")
    return out


def write_if_changed(path: str, text: str) -> bool:
    """Writes a file only if its content would change; whether it did."""
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            if f.read() == text:
                return False
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return True


def write_json(rows: DataFrame, path: str) -> bool:
    """Classified operations as an indented JSON list, written only if changed."""
    return write_if_changed(path, json.dumps([r.asDict(recursive=True) for r in rows.orderBy("name", "operation").toLocalIterator()], indent=2, default=str) + "\n")
