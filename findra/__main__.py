"""Command line: ``check`` and ``fmt`` over Go files, ``list`` and ``explain``.

Exit codes: 0 without findings or changes, 1 with some, 2 for wrong use or unreadable input.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .golang import checks, fixes, formatting
from .golang.lexer import SourceError
from .operators import findings, paths
from .operators.diff import unified
from .sources import files, reports

#: Options that exclude each other.
CONFLICTS = [
    ("watch", "structured report", "--watch needs the text format"),
    ("summary", "structured report", "--summary-only needs the text format"),
    ("fix", "unsafe fix", "--fix and --fix-unsafe exclude each other"),
    ("any fix", "watch", "fixing and --watch exclude each other"),
    ("any fix", "baseline update", "fixing cannot update a baseline"),
    ("watch", "baseline update", "--watch cannot update a baseline"),
]
_COLOURS = {"error": "31", "warning": "33", "note": "36"}


class UsageError(ValueError):
    """The command line or configuration makes no sense."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="findra")
    p.add_argument("--config", default="")
    p.add_argument("--no-config", action="store_true")
    p.add_argument("--color", choices=["auto", "always", "never"], default="auto")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("check")
    c.add_argument("root", nargs="?", default=".")
    c.add_argument("--only", default="")
    c.add_argument("--minimum-severity", "--floor", dest="floor", default=None)
    c.add_argument("--exclude", action="append", default=[])
    c.add_argument("--generated", action="store_true")
    c.add_argument("--format", choices=["text", "json", "html"], default="text")
    c.add_argument("--output", default="")
    c.add_argument("--baseline", default="")
    c.add_argument("--generate-baseline", "--write-baseline", dest="write_baseline", default="")
    c.add_argument("--remove-outdated", action="store_true")
    c.add_argument("--summary-only", "--summary", dest="summary", action="store_true")
    c.add_argument("--no-package-loading", action="store_true", help="leave out the semantic checks")
    c.add_argument("--fix", action="store_true")
    c.add_argument("--fix-unsafe", action="store_true")
    c.add_argument("--watch", action="store_true")
    c.add_argument("--turns", type=int, default=0, help="end --watch after so many looks; 0 for never")
    c.add_argument("--list-checks", action="store_true")
    c.add_argument("--explain", default="")
    f = sub.add_parser("fmt")
    f.add_argument("root", nargs="?", default=".")
    f.add_argument("--check", action="store_true")
    f.add_argument("--diff", action="store_true")
    f.add_argument("--write", action="store_true")
    f.add_argument("--stdin", action="store_true")
    f.add_argument("--stdin-filename", default="stdin.go")
    f.add_argument("--exclude", action="append", default=[])
    sub.add_parser("list")
    e = sub.add_parser("explain")
    e.add_argument("code")
    return p


def conflicts(args: argparse.Namespace) -> list[str]:
    """Messages of the excluded pairs that are both asked for."""
    asked = {
        "watch": args.watch,
        "structured report": args.format != "text",
        "summary": args.summary,
        "fix": args.fix,
        "unsafe fix": args.fix_unsafe,
        "any fix": args.fix or args.fix_unsafe,
        "baseline update": bool(args.write_baseline) or args.remove_outdated,
    }
    return [message for a, b, message in CONFLICTS if asked[a] and asked[b]]


def _config(args: argparse.Namespace, root: str) -> dict:
    if args.no_config:
        if args.config:
            raise UsageError("--config and --no-config exclude each other")
        return {}
    if args.config:
        return files.load_config(os.path.dirname(os.path.abspath(args.config)), os.path.basename(args.config))
    return files.load_config(root)


def _source_root(root: str) -> None:
    if os.path.isfile(root) and not root.endswith(".go"):
        raise UsageError(f"no Go file: {root}")
    if "://" not in root and not os.path.exists(root):
        raise UsageError(f"no such file or folder: {root}")


def _found(spark: SparkSession, args: argparse.Namespace, config: dict, sources: DataFrame) -> DataFrame:
    """Findings after selection, severities, suppression and excludes."""
    listed = checks.catalogue(spark).where("supported")
    if args.no_package_loading:
        listed = listed.where("engine <> 'semantic'")
    listed = findings.with_settings(listed, files.settings_of(spark, config))
    chosen = findings.select_checks(listed, [x for x in args.only.split(",") if x] or None, args.floor or config.get("floor", "warning"))
    severities = {r["code"]: r["severity"] for r in chosen.collect()}
    if not severities:
        raise UsageError("no check is chosen")
    found = checks.suppressed(sources, checks.run(sources, sorted(severities), checks.bound_options(config)))
    found = found.withColumn("severity", F.coalesce(*[F.when(F.col("code") == k, v) for k, v in severities.items()], F.col("severity")))
    for code, setting in config.get("checks", {}).items():
        if setting.get("exclude"):
            found = found.where(~((F.col("code") == code.lower()) & paths.excluded(F.col("file"), setting["exclude"])))
    return found


def _sources(spark: SparkSession, args: argparse.Namespace, config: dict) -> DataFrame:
    return files.discover(spark, args.root, args.exclude + config.get("exclude", []), generated=getattr(args, "generated", False)).select("path", "content").persist()


def _fix(args: argparse.Namespace, sources: DataFrame) -> None:
    """Writes fixed files over the originals, if these are as they were; the result is formatted where the original was."""
    changed = {r["path"]: bytes(r["content"]) for r in fixes.fixed(sources).toLocalIterator()}
    before = {r["path"]: bytes(r["content"]) for r in sources.where(F.col("path").isin([*changed])).toLocalIterator()} if changed else {}
    for r in fixes.refused(sources).toLocalIterator():
        print(f"not fixed, as the result does not parse: {r['path']}", file=sys.stderr)
    for path, after in changed.items():
        if formatting.formatted(before[path]) == before[path]:
            changed[path] = formatting.formatted(after)
    reports.rewrite({os.path.join(args.root, p) if os.path.isdir(args.root) else args.root: (before[p], after) for p, after in changed.items()})
    print(f"fixed files: {len(changed)}")


def _report(args: argparse.Namespace, found: DataFrame, sources: DataFrame) -> None:
    if args.format == "json":
        reports.json_report(found, args.output or "/dev/stdout")
    elif args.format == "html":
        reports.html_report(found, args.output or "findings.html")
    else:
        colour = args.color == "always" or args.color == "auto" and sys.stdout.isatty()
        for line in () if args.summary else reports.text_lines(found, sources):
            if colour:
                for word, code in _COLOURS.items():
                    line = line.replace(f": {word}: ", f": \x1b[{code}m{word}\x1b[0m: ", 1)
            print(line)
        for line in reports.text_summary(found):
            print(line)


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    config = _config(args, args.root)
    _source_root(args.root)
    sources = _sources(spark, args, config)
    try:
        if args.fix or args.fix_unsafe:
            _fix(args, sources)
            sources.unpersist()
            sources = _sources(spark, args, config)
        found = _found(spark, args, config, sources)
        if args.write_baseline:
            reports.write_baseline(findings.baseline_generate(found), args.write_baseline)
            return 0
        if args.remove_outdated:
            if not args.baseline:
                raise UsageError("--remove-outdated needs --baseline")
            reports.write_baseline(findings.baseline_prune(found, files.load_baseline(spark, args.baseline)), args.baseline)
        if args.baseline:
            keyed = found.withColumns({"start_line": F.col("start.Line"), "end_line": F.col("end.Line")})
            found = findings.baseline_apply(keyed, files.load_baseline(spark, args.baseline)).drop("start_line", "end_line")
        found = found.persist()
        _report(args, found, sources)
        return 1 if found.limit(1).count() else 0
    finally:
        sources.unpersist()
        spark.catalog.clearCache()


def watch(spark: SparkSession, args: argparse.Namespace, pause: float = 1.0) -> int:
    """Checks again whenever a file's content changes; an error is told once until it goes."""
    seen, told, code, turn = None, None, 0, 0
    while not args.turns or turn < args.turns:
        turn += 1
        if turn > 1:
            time.sleep(pause)
        try:
            config = _config(args, args.root)
            listed = files.discover(spark, args.root, args.exclude + config.get("exclude", []), generated=args.generated)
            now = (str(config), *(listed.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "hash").cast("decimal(20,0)"))).first()))
            if now != seen:
                code = check(spark, args)
                seen = now
            told = None
        except (ValueError, OSError) as e:
            if str(e) != told:
                print(f"findra: {e}", file=sys.stderr)
                told = str(e)
            code = 2
    return code


def fmt(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.stdin:
        if args.write:
            raise UsageError("--stdin and --write exclude each other")
        before = sys.stdin.buffer.read()
        after = formatting.formatted(before)
        if args.check:
            return int(before != after)
        sys.stdout.write(unified(before.decode(), after.decode(), args.stdin_filename) if args.diff else after.decode())
        return 0
    if args.check and args.write:
        raise UsageError("--check and --write exclude each other")
    _source_root(args.root)
    sources = _sources(spark, args, _config(args, args.root))
    changed = formatting.rewritten(sources).orderBy("path")
    count, made = 0, {}
    for r in changed.toLocalIterator():
        count += 1
        if args.diff:
            sys.stdout.write(unified(bytes(r["content"]).decode(), bytes(r["formatted"]).decode(), r["path"]))
        else:
            print(r["path"])
        if args.write:
            made[os.path.join(args.root, r["path"]) if os.path.isdir(args.root) else args.root] = (bytes(r["content"]), bytes(r["formatted"]))
    sources.unpersist()
    reports.rewrite(made)
    return 0 if args.write or not count else 1


def explain(spark: SparkSession, code: str) -> int:
    rows = checks.catalogue(spark).where(F.col("code") == code.lower()).collect()
    if not rows:
        raise UsageError(f"unknown check: {code}")
    r = rows[0]
    options = [f"{name} (default {default})" for (c, name), default in checks.option_defaults().items() if c == r["code"]]
    print(f"{r['code']}: {r['engine']} check, severity {r['severity']}" + ("" if r["supported"] else ", not supported: never reports"))
    for line in options:
        print(f"  option {line}")
    return 0


def listing(spark: SparkSession) -> int:
    for r in checks.catalogue(spark).orderBy("code").toLocalIterator():
        print(f"{r['code']:40s} {r['engine']:9s} {r['severity']:8s} {'' if r['supported'] else 'unsupported'}")
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
        if args.command == "check" and (found := conflicts(args)):
            raise UsageError("; ".join(found))
        spark = SparkSession.builder.appName("findra").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
        if args.command == "list" or args.command == "check" and args.list_checks:
            return listing(spark)
        if args.command == "explain" or args.command == "check" and args.explain:
            return explain(spark, args.code if args.command == "explain" else args.explain)
        if args.command == "fmt":
            return fmt(spark, args)
        return watch(spark, args) if args.watch else check(spark, args)
    except SystemExit as e:
        return e.code if isinstance(e.code, int) else 2
    except (ValueError, OSError, RuntimeError, SourceError) as e:
        print(f"findra: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
