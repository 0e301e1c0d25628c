"""Source discovery and configuration: files, config, baseline and manifest readers."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paths import display_path, excluded, in_skipped_directory, is_generated
from ..schemas import BASELINE


def discover(spark: SparkSession, root: str, patterns: list[str] | None = None, suffix: str = ".go", generated: bool = False) -> DataFrame:
    """Files below ``root`` as ``path`` (root-relative), ``content`` and ``hash``, distinct.

    Hidden, underscored and vendor directories and excluded paths are left out, and so are generated
    files unless asked for. Any store that Spark reads will do.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    base = root if "://" in root or root.startswith("file:") else "file:" + os.path.abspath(root)
    rows = raw.select(display_path(F.regexp_replace("path", "^file:/+", "file:/"), base).alias("path"), "content")
    rows = rows.where(~in_skipped_directory(F.col("path")) & ~excluded(F.col("path"), patterns or []))
    if not generated:
        rows = rows.where(~is_generated(F.col("content")))
    return rows.dropDuplicates(["path"]).withColumn("hash", F.sha2("content", 256))


#: Keys of the configuration file.
CONFIG_KEYS = {"floor", "exclude", "checks", "format", "baseline"}
CHECK_KEYS = {"severity", "exclude", "options"}


def load_config(start: str, name: str = "findra.toml") -> dict:
    """The nearest configuration file upward of ``start``; unknown keys are errors; empty where there is none."""
    here = os.path.abspath(start)
    while not os.path.isfile(os.path.join(here, name)):
        parent = os.path.dirname(here)
        if parent == here:
            return {}
        here = parent
    with open(os.path.join(here, name), "rb") as f:
        config = tomllib.load(f)
    if unknown := sorted(set(config) - CONFIG_KEYS):
        raise ValueError("unknown configuration keys: " + ", ".join(unknown))
    spelt: dict[str, str] = {}
    for code, setting in config.get("checks", {}).items():
        if unknown := sorted(set(setting) - CHECK_KEYS):
            raise ValueError(f"unknown keys of {code}: " + ", ".join(unknown))
        if other := spelt.get(code.lower()):
            raise ValueError(f"check is set twice: {other}, {code}")
        spelt[code.lower()] = code
    return config


def settings_of(spark: SparkSession, config: dict) -> DataFrame:
    """``code, severity, excludes`` of the configured checks."""
    rows = [(c.lower(), s.get("severity"), s.get("exclude", [])) for c, s in config.get("checks", {}).items()]
    return spark.createDataFrame(rows, "code string, severity string, excludes array<string>")


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A recorded baseline: a TOML file with a strict list of issues."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    if set(data) - {"version", "issues"}:
        raise ValueError("unknown baseline keys")
    rows = []
    for issue in data.get("issues", []):
        if set(issue) != {"file", "code", "start-line", "end-line"}:
            raise ValueError("malformed baseline issue")
        rows.append((issue["file"], issue["code"], issue["start-line"], issue["end-line"]))
    return spark.createDataFrame(rows, BASELINE)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A regression manifest: projects with 40-character revisions and positive budgets, else an error."""
    schema = "name string, repository string, revision string, budgets_ms struct<format: int, check: int>, paths array<string>, format_excludes array<string>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    bad = (F.length("revision") != 40) | (F.col("budgets_ms.format") <= 0) | (F.col("budgets_ms.check") <= 0)
    return rows.withColumn("name", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("malformed project: "), "name"))).otherwise(F.col("name")))
