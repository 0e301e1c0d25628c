"""Dotted version comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """Numbers of a dotted version, for comparison in order; a leading ``go`` or ``v`` is dropped."""
    return F.transform(F.split(F.regexp_replace(version, "^(go|v)", ""), "\\."), lambda x: x.cast("int"))


def at_least_version(have: Column, need: Column) -> Column:
    return version_key(have) >= version_key(need)
