"""Automatic fixes: planned edits of three checks, without conflicts, spliced into the files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import edits
from .checks import E, Tables
from .lexer import Source, SourceError
from .parser import parse

#: White space that canonical rendering never has: trailing, carriage returns, several blank lines, space indents.
_DRIFT = re.compile(rb"[ \t]\n|\r|\n\n\n|\n +\t*(?=[^ \t\n])")


def planned(files: DataFrame) -> DataFrame:
    """Safe edits as ``file, id, lo, hi, new_text`` (byte offsets); all edits of a finding are by themselves valid."""
    t = Tables(files)
    double = t.of("Unary").where("name = '!' AND get(children, 0).kind = 'Unary' AND get(children, 0).name = '!'")
    double = double.where("NOT (try_element_at(ancestors, -1).kind = 'Unary' AND startswith(spelling, '! ! !'))")
    last = t.blocks.where("kind = 'CaseClause' AND size(stmts) > 0").withColumn("z", E("try_element_at(stmts, -1)")).where("z.kind = 'BreakStmt' AND z.spelling = 'break'")
    single = t.calls.where("callee = 'append' AND size(args) = 1 AND name = ''").withColumn("a", E("get(args, 0)"))
    parts = [
        double.select(F.col("path").alias("file"), F.col("start").alias("lo"), E("get(children, 0).start + 1").alias("hi")),
        last.select(F.col("path").alias("file"), F.col("z.start").alias("lo"), F.col("z.stop").alias("hi")),
        single.select(F.col("path").alias("file"), F.col("start").alias("lo"), F.col("a.start").alias("hi")),
        single.select(F.col("path").alias("file"), F.col("a.stop").alias("lo"), F.col("stop").alias("hi")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    numbered = rows.withColumn("id", F.row_number().over(Window.partitionBy("file").orderBy("lo", "hi")))
    return numbered.select("file", "id", "lo", "hi", F.lit("").alias("new_text"))


def fixed(files: DataFrame) -> DataFrame:
    """``path, content`` of the files that fixes change; a file's conflicting edits are left out, and the result must parse."""
    return _spliced(files).where("parses").select("path", "content")


def refused(files: DataFrame) -> DataFrame:
    """``path`` of files that stay as they are because the fixed text would not parse."""
    return _spliced(files).where("NOT parses").select("path")


def _spliced(files: DataFrame) -> DataFrame:
    """``path, content, parses`` of the files with their edits."""
    chosen = edits.without_conflicts(planned(files))
    per_file = chosen.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct(F.col("lo").alias("start"), F.col("hi").alias("end"), "new_text")).alias("made"))
    raw = F.decode("content", "ISO-8859-1")

    @F.pandas_udf("boolean")
    def parses(contents: pd.Series) -> pd.Series:
        def ok(c: bytes) -> bool:
            try:
                parse(bytes(c))
                return True
            except SourceError:
                return False

        return pd.Series([ok(c) for c in contents])

    spliced = files.join(per_file, "path").select("path", F.encode(edits.applied(raw, F.col("made")), "ISO-8859-1").alias("content"))
    return spliced.withColumn("parses", parses("content"))


def format_drift(files: DataFrame) -> DataFrame:
    """``path`` of files whose white space differs from canonical rendering.

    A subset of the whole rendering: white space between tokens and comments and the file's end, no
    alignment, line width or import order.
    """

    @F.pandas_udf("boolean")
    def drifts(contents: pd.Series) -> pd.Series:
        def one(c) -> bool:
            data = bytes(c or b"")
            try:
                source = Source(data)
            except SourceError:
                return False
            if data and (not data.endswith(b"\n") or data.endswith(b"\n\n")):
                return True
            at = 0
            for start, end in sorted([(t.start, t.end) for t in source.tokens if t.end > t.start] + [(x.start, x.end) for x in source.comments]):
                if _DRIFT.search(data[at:start] + data[start : start + 1]):
                    return True
                at = end
            return bool(_DRIFT.search(data[at:]))

        return pd.Series([one(c) for c in contents])

    return files.where(drifts("content")).select("path")
