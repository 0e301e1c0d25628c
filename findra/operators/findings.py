"""The findings algebra: selection, suppression, baseline, order, summaries, limits.

Functions take the key columns they work on, so they serve findings and any other table. Bag
subtraction and stratified limits number rows within keys: a key is a finding's identity, so groups are
small; ``baseline_apply`` counts keys with partial aggregation before it joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import severity_name, severity_rank

FINDING_KEY = ("file", "start", "end", "code", "message")
ISSUE_KEY = ("file", "code", "start_line", "end_line")


def at_least(findings: DataFrame, floor: str, severity: str = "severity") -> DataFrame:
    """Rows of at least the given severity, in rank order."""
    return findings.where(severity_rank(F.col(severity)) >= severity_rank(F.lit(floor)))


def with_settings(checks: DataFrame, settings: DataFrame) -> DataFrame:
    """Checks with their effective severity: the setting's, else the default. The check list is a catalogue of fixed size."""
    over = settings.select(F.lower("code").alias("code"), F.col("severity").alias("set_severity"))
    return checks.join(F.broadcast(over), "code", "left").withColumn("severity", F.coalesce("set_severity", "severity")).drop("set_severity")


def select_checks(checks: DataFrame, only: list[str] | None = None, floor: str = "note") -> DataFrame:
    """Checks that run: chosen codes (any case; unknown ones are an error), at or above the floor."""
    if only:
        wanted = sorted({c.lower() for c in only})
        known = {r[0] for r in checks.select("code").collect()}
        if unknown := [c for c in wanted if c not in known]:
            raise ValueError("unknown checks: " + ", ".join(unknown))
        checks = checks.where(F.col("code").isin(wanted))
    return at_least(checks, floor)


def suppress(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings not inside a directive's range for their code or ``all``.

    ``directives``: ``path, code, from, to`` (offsets; a file directive spans the whole file).
    """
    d = directives.select(F.col("path").alias("d_path"), F.col("code").alias("d_code"), F.col("from").alias("d_from"), F.col("to").alias("d_to"))
    inside = (F.col("file") == F.col("d_path")) & (F.col("d_from") <= F.col("start.Offset")) & (F.col("d_to") >= F.col("end.Offset"))
    return findings.join(d, inside & ((F.col("d_code") == "all") | (F.col("d_code") == F.col("code"))), "left_anti")


def dedupe(findings: DataFrame, key=FINDING_KEY) -> DataFrame:
    return findings.dropDuplicates(list(key))


def canonical_order() -> list[Column]:
    """Sort columns of the canonical finding order; severity sorts as text."""
    return [F.col("file"), F.col("start.Offset"), F.col("code"), F.col("message"), F.col("end.Offset"), F.col("severity")]


def baseline_numbers(rows: DataFrame, baseline: DataFrame, key, order) -> DataFrame:
    """``rows`` with ``nth`` within their key and the key's multiplicity ``recorded`` in the baseline."""
    counts = baseline.groupBy(*key).agg(F.count(F.lit(1)).alias("recorded"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return numbered.join(counts, list(key), "left").withColumn("recorded", F.coalesce("recorded", F.lit(0)))


def baseline_apply(rows: DataFrame, baseline: DataFrame, key=ISSUE_KEY, order=None) -> DataFrame:
    """Bag difference: each baseline row cancels the earliest row of its key."""
    return baseline_numbers(rows, baseline, key, order or canonical_order()).where("nth > recorded").drop("nth", "recorded")


def baseline_stale(rows: DataFrame, baseline: DataFrame, key=ISSUE_KEY) -> DataFrame:
    """Baseline rows that no row matches: key and ``stale`` multiplicity."""
    have = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("have"))
    want = baseline.groupBy(*key).agg(F.count(F.lit(1)).alias("want"))
    return want.join(have, list(key), "left").select(*key, F.greatest(F.col("want") - F.coalesce("have", F.lit(0)), F.lit(0)).alias("stale")).where("stale > 0")


def baseline_generate(findings: DataFrame) -> DataFrame:
    """The baseline that records all findings but those of ``format``."""
    rows = findings.where("code <> 'format'")
    return rows.select("file", "code", F.col("start.Line").alias("start_line"), F.col("end.Line").alias("end_line")).orderBy(*ISSUE_KEY)


def baseline_prune(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline rows that still match a finding, with multiplicity."""
    have = baseline_generate(findings).groupBy(*ISSUE_KEY).agg(F.count(F.lit(1)).alias("have"))
    nth = F.row_number().over(Window.partitionBy(*ISSUE_KEY).orderBy(F.lit(1)))
    return baseline.withColumn("nth", nth).join(have, list(ISSUE_KEY)).where("nth <= have").select(*ISSUE_KEY)


def baseline_states(baseline: DataFrame, selected: list[str], known: list[str]) -> DataFrame:
    """Baseline rows with ``state``: ``compared`` for selected codes, ``matched`` for other known ones (they are kept as they are), ``stale`` for unknown ones."""
    state = F.when(F.col("code").isin(selected), "compared").when(F.col("code").isin(known), "matched").otherwise("stale")
    return baseline.withColumn("state", state)


def fixability(fixes: Column) -> Column:
    """``safe`` with an automatic safe fix, else ``unsafe`` with any automatic one, else ``none``."""
    auto = F.filter(fixes, lambda f: f["automatic"])
    return F.when(F.exists(auto, lambda f: f["safety"] == "safe"), "safe").when(F.size(auto) > 0, "unsafe").otherwise("none")


def summary_by_code(findings: DataFrame) -> DataFrame:
    """Count and highest severity by code, most frequent first."""
    per = findings.groupBy("code").agg(F.count(F.lit(1)).alias("findings"), F.max(severity_rank(F.col("severity"))).alias("rank"))
    return per.select("code", "findings", severity_name(F.col("rank")).alias("severity")).orderBy(F.desc("findings"), "code")


def stratified_limit(rows: DataFrame, stratum: str, order: list, limit: int) -> DataFrame:
    """At most ``limit`` rows, in turn from each stratum: the first of every one, then the second of every one.

    Ranks need only the first ``limit`` rows of a stratum; the rank filter becomes a per-task group limit.
    """
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return rows.withColumn("turn", rank).where(F.col("turn") <= limit).orderBy("turn", stratum, *order).limit(limit)
