"""One query for each Go check over the inline fixture, with the marked findings as SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..golang import checks, fixes, fixture
from ..operators import findings

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _values(rows: list[tuple[str, int]]) -> str:
    if not rows:
        return "SELECT CAST(NULL AS VARCHAR) AS file, CAST(NULL AS INTEGER) AS line WHERE false"
    return "SELECT file, line FROM (VALUES " + ", ".join(f"('{f}', {n})" for f, n in rows) + ") AS t(file, line)"


def _query(code: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return checks.run(fixture.files(spark), [code]).select("file", F.col("start.Line").alias("line"))

    return query


for _code in checks.supported():
    _name = "go_" + _code.replace("-", "_")
    QUERIES[_name] = _query(_code)
    ORACLE[_name] = _values([(f, n) for f, n, c in fixture.expected() if c == _code])


def go_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks by engine, severity and support."""
    return checks.catalogue(spark).groupBy("engine", "severity", "supported").agg(F.count(F.lit(1)).alias("n"))


def go_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings at or above warning, suppressed where directives say so, counted by code."""
    files = fixture.files(spark)
    found = checks.suppressed(files, findings.at_least(checks.run(files), "warning"))
    return findings.summary_by_code(found)


def go_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that automatic fixes change, with the digest of the result."""
    return fixes.fixed(fixture.files(spark)).select("path", F.sha2("content", 256).alias("digest"))


#: What the fixes take out of the fixture's files.
_FIXED = {"shapes/control.go": ("break", ""), "shapes/expressions.go": ("!!b", "b"), "semantic/calls.go": ("append(s)", "s")}
QUERIES["go_fixed"] = go_fixed
ORACLE["go_fixed"] = "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{hashlib.sha256(fixture.sources()[p].replace(*r).encode()).hexdigest()}')" for p, r in _FIXED.items()) + ") AS t(path, digest)"
QUERIES |= {"go_catalogue": go_catalogue, "go_findings": go_findings}
#: How many checks there are.
ORACLE["go_catalogue"] = """
SELECT engine, severity, supported, CAST(n AS BIGINT) AS n FROM (VALUES
  ('format', 'warning', true, 1), ('syntax', 'error', true, 20), ('syntax', 'warning', true, 62), ('syntax', 'note', true, 15),
  ('semantic', 'error', true, 29), ('semantic', 'warning', true, 55),
  ('semantic', 'error', false, 9), ('semantic', 'warning', false, 9), ('semantic', 'note', false, 1)
) AS t(engine, severity, supported, n)
"""
