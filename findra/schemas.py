"""Explicit schemas and the severity order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITION = "struct<Filename: string, Offset: int, Line: int, Column: int>"
FINDINGS = (
    f"code string, message string, severity string, file string, start {POSITION}, end {POSITION}, "
    f"notes array<struct<message: string, start: {POSITION}, end: {POSITION}>>, "
    "fixes array<struct<message: string, safety: string, automatic: boolean, edits array<struct<start: int, end: int, old_text: string, new_text: string>>>>"
).replace("edits array", "edits: array")
BASELINE = "file string, code string, start_line int, end_line int"
CHECKS = "code string, engine string, severity string, summary string"
SETTINGS = "code string, severity string, excludes array<string>"

#: Fixed values, in rising order.
SEVERITIES = ("none", "note", "warning", "error")


def severity_rank(severity: Column) -> Column:
    """Place in the order of severities; null for an unknown one."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(SEVERITIES):
        out = F.when(severity == name, i).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)
