"""Path predicates: globs, exclusion, directory pruning, display paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set("*?[")


def check_globs(patterns: list[str]) -> None:
    """Raises on malformed patterns, naming all of them in order."""
    bad = sorted(p for p in patterns if not _well_formed(p))
    if bad:
        raise ValueError("malformed exclude patterns: " + ", ".join(bad))


def _well_formed(pattern: str) -> bool:
    if not pattern or pattern.endswith("\\"):
        return False
    depth = 0
    for c in re.sub(r"\\.", "", pattern):
        if c == "[":
            depth += 1
        elif c == "]" and depth:
            depth -= 1
    return depth == 0


def glob_regex(pattern: str) -> str:
    """A regular expression in the common subset of Java and RE2: ``**`` crosses directories, ``*`` and ``?`` do not."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("([^/]+/)*")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        else:
            out.append("[" + c + "]" if c in ".+(){}|$" else "\\" + c if c in "^\\" else c)
        i += 1
    return "^" + "".join(out) + "$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a root-relative path is excluded: by a glob, else by equality or as below a directory."""
    check_globs(patterns)
    out = F.lit(False)
    for p in patterns:
        if _SPECIAL & set(p):
            out = out | path.rlike(glob_regex(p))
        else:
            out = out | (path == p) | path.startswith(p.rstrip("/") + "/")
    return out


def in_skipped_directory(path: Column) -> Column:
    """Whether a directory above the file is hidden, underscored or ``vendor``."""
    parts = F.split(path, "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(above, lambda d: d.rlike("^[._]") | (d == "vendor"))


def display_path(path: Column, root: str) -> Column:
    """Root-relative where below ``root``, else as it is."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, F.length(path))).otherwise(path)


def is_generated(content: Column) -> Column:
    """Whether the first 4 KiB have a generated-code line."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    return head.rlike(r"(?m)^// Code generated .* DO NOT EDIT\.\r?$")
