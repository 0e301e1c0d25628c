"""Syntax checks as queries over the node, comment and file tables.

A check is a function from a ``Tables`` to rows ``path, start, stop, message``. ``run`` joins none of them:
it unions the selected ones, adds severity and position, and gives the findings schema's columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables
from .lexer import PREDECLARED

E = F.expr

#: Default severity of each syntax check.
SEVERITY = {
    "error": "redundant-atomic-result-assignment banned-characters bidirectional-control-character confusing-naming deep-exit deferred-recover-call discarded-deferred-result "
    "double-negation duplicated-imports empty-conditional-block ineffective-pointer-copy inefficient-map-lookup modifies-parameter modulo-one package-directory-mismatch string-of-int "
    "invalid-struct-tag unchecked-type-assertion waitgroup-by-value zero-integer-division",
    "warning": "cyclomatic-complexity max-parameters no-naked-return no-package-var no-defer-in-loop no-else-after-return blank-imports excessive-blank-identifiers "
    "top-level-declaration-order boolean-literal-comparison call-to-gc cognitive-complexity confusing-results constant-logical-expr context-as-argument dot-imports early-return "
    "enforce-switch-style error-naming error-last-result error-strings prefer-fmt-errorf function-length function-result-limit identical-branches identical-if-chain-branches "
    "identical-if-chain-conditions identical-switch-branches identical-switch-conditions redundant-error-return-check import-alias-naming import-shadowing imports-blocklist "
    "marshal-receiver max-control-nesting modifies-value-receiver package-naming range-value-address simplify-range receiver-naming redefines-builtin-id redundant-build-tag "
    "redundant-import-alias redundant-final-return redundant-switch-break single-case-switch spaced-compiler-directive spinning-select-default time-date time-naming unexported-naming "
    "unexported-return unnecessary-if unreachable-code insecure-url-scheme unused-parameter use-any use-errors-new use-fmt-print use-slices-sort var-declaration var-naming",
    "note": "no-init add-constant doc-comment-period task-comment exported-declaration-comment file-length-limit filename-format flag-parameter get-function-return-value "
    "increment-decrement max-public-structs nested-structs package-comments unnecessary-format unused-receiver",
}
#: Default options.
OPTIONS = {
    "max-parameters": 8, "max-complexity": 10, "max-cognitive": 7, "max-lines": 75, "max-statements": 50, "max-file-lines": 500, "max-results": 3, "max-public-structs": 5, "max-methods": 10,
    "blocked-imports": [], "characters": ["Ω", "λ"],
}

CHECKS: dict[str, Callable[[Tables], DataFrame]] = {}

_CONTROL = "('IfStmt', 'ForStmt', 'SwitchStmt', 'TypeSwitchStmt', 'SelectStmt')"
_FUNC = "('FunctionDecl', 'MethodDecl', 'FunctionLit')"
_EXIT = "('os.Exit', 'log.Fatal', 'log.Fatalf', 'log.Fatalln', 'log.Panic', 'log.Panicf', 'log.Panicln')"
#: A statement summary after which the next one is not reached.
_ENDS = (
    "({0}.kind IN ('ReturnStmt', 'BreakStmt', 'ContinueStmt', 'GotoStmt', 'FallthroughStmt') OR ({0}.kind = 'ExprStmt' AND regexp_like({0}.spelling, "
    "'^(panic|os . Exit|log . (Fatal|Fatalf|Fatalln|Panic|Panicf|Panicln)) \\\\( ')))"
)


def check(code: str):
    def add(f):
        CHECKS[code] = f
        return f

    return add


def kids(role: str, of: str = "children") -> str:
    return f"filter({of}, c -> c.role = '{role}')"


def kid(role: str) -> str:
    return f"get(filter(children, c -> c.role = '{role}'), 0)"


@dataclass(frozen=True)
class Rows:
    """Rows of the node table that conditions on a row alone select, kept as expressions so that many checks share one scan.

    Whatever needs other rows makes a DataFrame of them.
    """

    table: DataFrame
    conditions: tuple[Column, ...] = ()
    columns: tuple[tuple[str, Column], ...] = ()

    def where(self, condition: str | Column) -> Rows | DataFrame:
        if "judge(" in str(condition):  # a Python function sees no more rows than it must
            return self.frame.where(condition)
        return replace(self, conditions=(*self.conditions, E(condition) if isinstance(condition, str) else condition))

    def withColumn(self, name: str, column: Column) -> Rows | DataFrame:  # noqa: N802
        if re.search("explode|OVER|window", str(column), re.I):
            return self.frame.withColumn(name, column)
        return replace(self, columns=(*self.columns, (name, column)))

    @cached_property
    def frame(self) -> DataFrame:
        out = self.table
        for name, column in self.columns:
            out = out.withColumn(name, column)
        return out.where(self.condition)

    @property
    def condition(self) -> Column:
        return reduce(Column.__and__, self.conditions, F.lit(True))

    def __getattr__(self, name: str):
        return getattr(self.frame, name)


@dataclass(frozen=True)
class Report:
    """Findings of such rows."""

    rows: Rows
    message: Column
    start: str
    stop: str

    @cached_property
    def frame(self) -> DataFrame:
        return self.rows.frame.select("path", E(self.start).alias("start"), E(self.stop).alias("stop"), self.message.alias("message"))

    def __getattr__(self, name: str):
        return getattr(self.frame, name)


def report(rows: Rows | DataFrame, message: str | Column, start: str = "start", stop: str = "stop") -> Report | DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    if isinstance(rows, Rows):
        return Report(rows, text, start, stop)
    return rows.select("path", E(start).alias("start"), E(stop).alias("stop"), text.alias("message"))


#: Checks that one projection evaluates at most.
FOLDED = 30


def folded(found: dict[str, Report | DataFrame]) -> list[DataFrame]:
    """Findings with ``code``: reports over the same columns are evaluated together, one scan for up to ``FOLDED`` checks."""
    out, shared = [], {}
    for code, rows in found.items():
        if isinstance(rows, Report):
            shared.setdefault(tuple((n, str(c)) for n, c in rows.rows.columns), []).append((code, rows))
        else:
            out.append(rows.select("path", F.lit(code).alias("code"), "start", "stop", "message"))
    for same in shared.values():
        table = same[0][1].rows.table
        for name, column in same[0][1].rows.columns:
            table = table.withColumn(name, column)
        for lo in range(0, len(same), FOLDED):
            hits = [F.when(r.rows.condition, F.struct(F.lit(c).alias("code"), E(r.start).cast("int").alias("start"), E(r.stop).cast("int").alias("stop"), r.message.alias("message"))) for c, r in same[lo : lo + FOLDED]]
            hit = F.filter(F.array(*hits), lambda h: h.isNotNull())
            out.append(table.select("path", F.explode(hit).alias("h")).select("path", "h.*"))
    return out


@dataclass
class Tables:
    """Lazily built tables over one set of files; with ``share`` parsed rows are kept for all checks."""

    files: DataFrame
    options: dict = field(default_factory=lambda: dict(OPTIONS))
    share: bool = False
    made: dict = field(default_factory=dict)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several checks start from, made for the first of them."""
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    @cached_property
    def nodes(self) -> DataFrame:
        return self._by_file(tables.nodes(self.files))

    @cached_property
    def comments(self) -> DataFrame:
        return self._by_file(tables.comments(self.files))

    def _by_file(self, rows: DataFrame) -> DataFrame:
        """Shared rows are dealt by file once; joins and groups within a file then need no exchange."""
        if not self.share:
            return rows
        rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        return rows.repartition("path").persist()

    @cached_property
    def text(self) -> DataFrame:
        return self.files.select("path", F.decode("content", "UTF-8").alias("text"), F.length("content").alias("size"))

    @cached_property
    def rows(self) -> Rows:
        return Rows(self.nodes)

    def of(self, *kinds: str) -> Rows:
        return self.rows.where(F.col("kind").isin(*kinds))

    @cached_property
    def functions(self) -> DataFrame:
        return self.of("FunctionDecl", "MethodDecl").withColumn("name_start", E(f"{kid('name')}.start")).withColumn("name_stop", E(f"{kid('name')}.stop"))

    @cached_property
    def calls(self) -> DataFrame:
        """Calls with ``callee`` (no spaces) and ``args``."""
        return self.of("Call").withColumn("callee", E(f"replace({kid('fun')}.spelling, ' ', '')")).withColumn("args", E(kids("arg")))

    @cached_property
    def params(self) -> DataFrame:
        """Parameters, results and receivers of declared functions: a row for each, with its ``names`` and ``type``."""
        rows = self.of("Param").where("try_element_at(ancestors, -1).kind IN ('FunctionDecl', 'MethodDecl')")
        return rows.withColumn("names", E(kids("name"))).withColumn("type", E(f"replace({kid('type')}.spelling, ' ', '')"))

    @cached_property
    def names(self) -> DataFrame:
        """Declared names: a row for each identifier that a declaration introduces, with ``owner`` kind."""
        rows = self.of("Ident").where("role = 'name' OR (role = 'left' AND try_element_at(ancestors, -1).kind = 'AssignStmt')")
        rows = rows.withColumn("owner", E("try_element_at(ancestors, -1).kind"))
        define = self.of("AssignStmt").where("name = ':='").select("path", F.col("id").alias("parent"))
        plain = rows.where("role = 'name' AND owner NOT IN ('PackageClause', 'ImportSpec')")
        return plain.unionByName(rows.where("role = 'left'").join(define, ["path", "parent"], "left_semi"))

    @cached_property
    def imports(self) -> DataFrame:
        return self.of("ImportSpec").withColumn("target", E("substring(name, 2, length(name) - 2)")).withColumn("alias", E(f"{kid('alias')}.name")).withColumn("base", E("substring_index(target, '/', -1)"))

    @cached_property
    def ifs(self) -> DataFrame:
        return self.of("IfStmt").withColumn("cond", E(kid("cond"))).withColumn("then", E(kid("then"))).withColumn("other", E(kid("else")))

    @cached_property
    def blocks(self) -> DataFrame:
        """Statement lists: blocks and clauses, with ``stmts``."""
        return self.of("Block", "CaseClause", "CommClause").withColumn("stmts", E(kids("stmt")))

    def last_of(self, name: str) -> DataFrame:
        """Blocks as ``path, <name>_id, <name>_stmts, <name>_ends``, to be joined to what holds them."""
        ends = _ENDS.format("try_element_at(stmts, -1)")
        return self.of("Block").withColumn("stmts", E(kids("stmt"))).select("path", F.col("id").alias(f"{name}_id"), F.col("stmts").alias(f"{name}_stmts"), E(f"size(stmts) > 0 AND {ends}").alias(f"{name}_ends"))

    @cached_property
    def branches(self) -> DataFrame:
        """Conditionals with both blocks' statements."""
        both = self.ifs.where("other.kind = 'Block'").withColumn("a_id", E("then.id")).withColumn("b_id", E("other.id"))
        return both.join(self.last_of("a"), ["path", "a_id"]).join(self.last_of("b"), ["path", "b_id"])


# --- functions


@check("cyclomatic-complexity")
def _(t):
    hit = t.nodes.where("kind IN ('IfStmt', 'ForStmt', 'TypeSwitchStmt') OR (kind IN ('CaseClause', 'CommClause') AND name <> 'default') OR (kind = 'Binary' AND name IN ('&&', '||'))")
    return _counted(t, hit, F.lit(1)).where(F.col("n") + 1 > t.options["max-complexity"]).transform(lambda d: report(d, F.format_string("function complexity is %d", F.col("n") + 1), "name_start", "name_stop"))


@check("cognitive-complexity")
def _(t):
    hit = t.nodes.where(f"kind IN {_CONTROL} OR kind IN ('BreakStmt', 'ContinueStmt', 'GotoStmt', 'FallthroughStmt')").where("size(ancestors) > 0")
    inside = f"size(filter(ancestors, a -> a.kind IN {_CONTROL}))"
    score = F.when(E(f"kind IN {_CONTROL}"), 1 + E(inside)).otherwise(1)
    return _counted(t, hit, score).where(F.col("n") > t.options["max-cognitive"]).transform(lambda d: report(d, F.format_string("cognitive complexity is %d", "n"), "name_start", "name_stop"))


def _counted(t, hit, score):
    """Declared functions with the summed score of the nodes in their bodies."""
    owned = hit.withColumn("s", score).withColumn("fn", E("get(filter(ancestors, a -> a.kind IN ('FunctionDecl', 'MethodDecl')), 0).id")).where("fn IS NOT NULL")
    sums = owned.groupBy("path", "fn").agg(F.sum("s").alias("n"))
    return t.functions.join(sums.withColumnRenamed("fn", "id"), ["path", "id"])


@check("function-length")
def _(t):
    body = t.functions.where(f"{kid('body')} IS NOT NULL")
    stmts = t.nodes.where("role = 'stmt' AND kind <> 'LabeledStmt' OR role = 'stmt' AND try_element_at(ancestors, -1).kind <> 'LabeledStmt'")
    counts = stmts.withColumn("fn", E("get(filter(ancestors, a -> a.kind IN ('FunctionDecl', 'MethodDecl')), 0).id")).groupBy("path", "fn").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("fn", "id")
    long = body.join(counts, ["path", "id"], "left").where((F.coalesce("n", F.lit(0)) > t.options["max-statements"]) | (F.col("end_line") - F.col("line") + 1 > t.options["max-lines"]))
    return report(long, "function is too long", "name_start", "name_stop")


@check("max-parameters")
def _(t):
    n = E(f"aggregate({kids('param')}, 0, (s, p) -> s + 1)")
    counts = t.params.where("role = 'param'").groupBy("path", F.col("parent").alias("id")).agg(F.sum(E("size(names)")).alias("n"))
    return report(t.functions.join(counts, ["path", "id"]).where((F.col("n") > t.options["max-parameters"]) & (n > 0)), "function has too many parameters", "name_start", "name_stop")


@check("function-result-limit")
def _(t):
    counts = t.params.where("role = 'result'").groupBy("path", F.col("parent").alias("id")).agg(F.sum(E("greatest(1, size(names))")).alias("n"))
    return report(t.functions.join(counts, ["path", "id"]).where(F.col("n") > t.options["max-results"]), "function has too many results", "name_start", "name_stop")


@check("no-init")
def _(t):
    return report(t.functions.where("kind = 'FunctionDecl' AND name = 'init'"), "avoid init functions", "name_start", "name_stop")


@check("get-function-return-value")
def _(t):
    return report(t.functions.where(f"upper(name) LIKE 'GET%' AND size({kids('result')}) = 0"), "a getter should return a value", "name_start", "name_stop")


@check("redundant-final-return")
def _(t):
    rows = t.functions.where(f"size({kids('result')}) = 0 AND {kid('body')} IS NOT NULL").select("path", E(f"{kid('body')}.id").alias("id"))
    last = t.blocks.join(rows, ["path", "id"], "left_semi").withColumn("z", E("try_element_at(stmts, -1)")).where("size(stmts) > 0 AND z.kind = 'ReturnStmt' AND z.spelling = 'return'")
    return report(last, "final return is redundant", "z.start", "z.stop")


@check("no-naked-return")
def _(t):
    named = t.of("Param").where(f"role = 'result' AND size({kids('name')}) > 0").select("path", F.col("parent").alias("func")).distinct()
    return report(t.of("ReturnStmt").where("size(children) = 0").join(named, ["path", "func"], "left_semi"), "return the named results explicitly")


@check("confusing-results")
def _(t):
    unnamed = t.params.where("role = 'result' AND size(names) = 0")
    w = Window.partitionBy("path", "parent").orderBy("ordinal")
    return report(unnamed.withColumn("before", F.lag("type").over(w)).where("before = type"), "adjacent results of one type should be named")


@check("context-as-argument")
def _(t):
    w = Window.partitionBy("path", "parent").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    rows = t.params.where("role = 'param'").withColumn("at", F.coalesce(F.sum(E("greatest(1, size(names))")).over(w), F.lit(0)))
    return report(rows.where("type = 'context.Context' AND at > 0"), "context.Context should be the first parameter")


@check("error-last-result")
def _(t):
    w = Window.partitionBy("path", "parent")
    rows = t.params.where("role = 'result'").withColumn("last", F.max("ordinal").over(w))
    return report(rows.where("type = 'error' AND ordinal < last"), "error should be the last result")


@check("waitgroup-by-value")
def _(t):
    return report(t.params.where("role = 'param' AND type = 'sync.WaitGroup'"), "pass sync.WaitGroup by pointer")


@check("unexported-return")
def _(t):
    fns = t.functions.where("regexp_like(name, '^[A-Z]')").select("path", F.col("id").alias("parent"))
    rows = t.params.where("role = 'result' AND regexp_like(type, '^[*]*[a-z_][A-Za-z0-9_]*$')").where(~F.regexp_replace("type", "^[*]+", "").isin(*sorted(PREDECLARED)))
    return report(rows.join(fns, ["path", "parent"], "left_semi"), "exported function returns an unexported type")


def _param_names(t, role):
    rows = t.params.where(F.col("role") == role).select("path", F.col("parent").alias("fn"), "type", F.explode("names").alias("p"))
    return rows.select("path", "fn", "type", F.col("p.name").alias("name"), F.col("p.start").alias("start"), F.col("p.stop").alias("stop")).where("name <> '_'")


def _body_names(t):
    """Identifiers in bodies: ``path, fn, name``."""
    return t.of("Ident").where("exists(ancestors, a -> a.role = 'body')").withColumn("fn", E("get(filter(ancestors, a -> a.kind IN ('FunctionDecl', 'MethodDecl')), 0).id")).select("path", "fn", "name").distinct()


def _with_body(t, rows):
    return rows.join(t.functions.where(f"{kid('body')} IS NOT NULL").select("path", F.col("id").alias("fn")), ["path", "fn"], "left_semi")


@check("unused-parameter")
def _(t):
    return report(_with_body(t, _param_names(t, "param")).join(_body_names(t), ["path", "fn", "name"], "left_anti"), F.concat(F.lit("parameter is not used: "), "name"))


@check("unused-receiver")
def _(t):
    return report(_with_body(t, _param_names(t, "receiver")).join(_body_names(t), ["path", "fn", "name"], "left_anti"), F.concat(F.lit("receiver is not used: "), "name"))


@check("flag-parameter")
def _(t):
    conds = t.of("Ident").where("exists(ancestors, a -> a.role = 'cond') AND exists(ancestors, a -> a.kind = 'IfStmt') OR role = 'cond' AND try_element_at(ancestors, -1).kind = 'IfStmt'")
    used = conds.withColumn("fn", E("get(filter(ancestors, a -> a.kind IN ('FunctionDecl', 'MethodDecl')), 0).id")).select("path", "fn", "name").distinct()
    return report(_param_names(t, "param").where("type = 'bool'").join(used, ["path", "fn", "name"], "left_semi"), "parameter controls the function's flow")


def _mutations(t):
    """Roots of assigned expressions: ``path, fn, name, start, stop``."""
    targets = t.nodes.where("role = 'left' AND try_element_at(ancestors, -1).kind IN ('AssignStmt', 'IncDecStmt')")
    define = t.of("AssignStmt").where("name = ':='").select("path", F.col("id").alias("parent"))
    rows = targets.join(define, ["path", "parent"], "left_anti").withColumn("name", E("regexp_extract(spelling, '^[*( ]*([A-Za-z_][A-Za-z0-9_]*)', 1)"))
    return rows.withColumn("fn", E("get(filter(ancestors, a -> a.kind IN ('FunctionDecl', 'MethodDecl')), 0).id")).where("name <> ''").select("path", "fn", "name", "start", "stop")


@check("modifies-parameter")
def _(t):
    return report(_mutations(t).join(_param_names(t, "param").select("path", "fn", "name"), ["path", "fn", "name"], "left_semi"), F.concat(F.lit("parameter is modified: "), "name"))


@check("modifies-value-receiver")
def _(t):
    return report(_mutations(t).join(_param_names(t, "receiver").where("NOT startswith(type, '*')").select("path", "fn", "name"), ["path", "fn", "name"], "left_semi"), F.concat(F.lit("value receiver is modified: "), "name"))


def _receivers(t):
    rows = _param_names(t, "receiver").join(t.functions.select("path", F.col("id").alias("fn"), F.col("name").alias("method")), ["path", "fn"])
    return rows.withColumn("base", E("regexp_replace(regexp_replace(type, '^[*]+', ''), '\\\\[.*$', '')"))


@check("receiver-naming")
def _(t):
    rows = _receivers(t)
    unlike = rows.withColumn("first_name", F.first("name").over(Window.partitionBy("path", "base").orderBy("start"))).where("name <> first_name")
    return report(unlike, "receiver is named unlike the type's first one").unionByName(report(rows.where("name IN ('this', 'self')"), "receiver name says nothing"))


@check("marshal-receiver")
def _(t):
    rows = _receivers(t).where("regexp_like(method, '^(Marshal|Unmarshal|Encode|Decode)')").withColumn("pointer", E("startswith(type, '*')"))
    return report(rows.withColumn("f", F.first("pointer").over(Window.partitionBy("path", "base").orderBy("start"))).where("pointer <> f"), "marshalling methods mix value and pointer receivers")


@check("time-naming")
def _(t):
    rows = t.of("ValueSpec", "VarSpec", "ConstSpec", "Param", "Field").where(f"regexp_like(replace({kid('type')}.spelling, ' ', ''), '^[*]?time[.]Duration$')").select("path", F.explode(E(kids("name"))).alias("p"))
    return report(rows.where("regexp_like(p.name, '(?i)(ns|us|ms|secs?|seconds?|mins?|minutes?|hours?|millis|micros|nanos|milliseconds?|microseconds?|nanoseconds?)$')"), "a duration's name should not have a unit", "p.start", "p.stop")


# --- names


@check("var-naming")
def _(t):
    return report(t.names.where("contains(substring(name, 2, length(name)), '_') AND NOT (owner IN ('FunctionDecl') AND regexp_like(name, '^(Test|Benchmark|Example|Fuzz)'))"), "name contains an underscore")


@check("unexported-naming")
def _(t):
    return report(t.names.where("startswith(name, '_') AND name <> '_'"), "name starts with an underscore")


@check("redefines-builtin-id")
def _(t):
    return report(t.names.where(F.col("name").isin(*sorted(PREDECLARED))).where("owner NOT IN ('Field', 'MethodSpec', 'MethodDecl')"), F.concat(F.lit("redefines "), "name"))


@check("import-shadowing")
def _(t):
    seen = t.imports.select("path", F.coalesce("alias", "base").alias("name")).where("name NOT IN ('_', '.')").distinct()
    return report(t.names.where("owner NOT IN ('Field', 'MethodSpec', 'MethodDecl')").join(seen, ["path", "name"], "left_semi"), F.concat(F.lit("shadows import "), "name"))


@check("banned-characters")
def _(t):
    hit = reduce(lambda a, b: a | b, [F.contains("name", F.lit(c)) for c in t.options["characters"]], F.lit(False))
    return report(t.names.where(hit), "name contains a banned character")


@check("confusing-naming")
def _(t):
    rows = t.functions.withColumn("owner", E(f"coalesce(regexp_extract({kid('receiver')}.spelling, '([A-Za-z0-9_]+)[^A-Za-z0-9_]*$', 1), '')"))
    first = F.first("name").over(Window.partitionBy("path", "owner", F.lower("name")).orderBy("start"))
    return report(rows.withColumn("first_name", first).where("name <> first_name"), "name differs from another only by case", "name_start", "name_stop")


@check("error-naming")
def _(t):
    rows = t.of("VarSpec").where(f"NOT exists(ancestors, a -> a.kind IN {_FUNC}) AND regexp_like(replace({kid('value')}.spelling, ' ', ''), '^(errors[.]New|fmt[.]Errorf)[(]')")
    return report(rows.select("path", F.explode(E(kids("name"))).alias("p")).where("NOT regexp_like(p.name, '^(err|Err|_$)')"), "error variables should be named err or Err", "p.start", "p.stop")


# --- declarations and imports


@check("no-package-var")
def _(t):
    rows = t.of("VarSpec").where(f"NOT exists(ancestors, a -> a.kind IN {_FUNC})").select("path", F.explode(E(kids("name"))).alias("p"))
    return report(rows.where("p.name <> '_'"), "package variables are global state", "p.start", "p.stop")


@check("var-declaration")
def _(t):
    zero = f"{kid('value')}.spelling IN ('0', '0.0', '\"\"', '``', 'false', 'nil')"
    return report(t.of("VarSpec").where(f"{kid('type')} IS NOT NULL AND size({kids('value')}) = 1 AND {zero}"), "the zero value need not be given")


@check("max-public-structs")
def _(t):
    rows = t.of("TypeSpec").where(f"{kid('type')}.kind = 'StructType' AND regexp_like(name, '^[A-Z]')")
    return report(rows.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("start"))).where(F.col("nth") > t.options["max-public-structs"]), "file has too many exported structs")


@check("nested-structs")
def _(t):
    return report(t.of("StructType").where("try_element_at(ancestors, -1).kind <> 'TypeSpec'"), "struct type should be named")


@check("use-any")
def _(t):
    return report(t.of("InterfaceType").where("size(children) = 0"), "use any")


@check("top-level-declaration-order")
def _(t):
    rank = "CASE kind WHEN 'ConstDecl' THEN 0 WHEN 'VarDecl' THEN 1 WHEN 'TypeDecl' THEN 2 WHEN 'FunctionDecl' THEN 3 WHEN 'MethodDecl' THEN 3 END"
    rows = t.nodes.where("role = 'decl' AND try_element_at(ancestors, -1).kind = 'SourceFile'").withColumn("rank", E(rank)).where("rank IS NOT NULL")
    w = Window.partitionBy("path").orderBy("start")
    low = rows.withColumn("top", F.max("rank").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("rank < top")
    return report(low.withColumn("nth", F.row_number().over(w)).where("nth = 1"), "declaration is out of order")


@check("dot-imports")
def _(t):
    return report(t.imports.where("alias = '.'"), "avoid dot imports")


@check("duplicated-imports")
def _(t):
    return report(t.imports.withColumn("nth", F.row_number().over(Window.partitionBy("path", "target").orderBy("start"))).where("nth > 1"), "path is imported again")


@check("import-alias-naming")
def _(t):
    return report(t.imports.where("alias NOT IN ('_', '.') AND NOT regexp_like(alias, '^[a-z][a-z0-9]*$')"), "alias should be lower case letters and digits", f"{kid('alias')}.start", f"{kid('alias')}.stop")


@check("redundant-import-alias")
def _(t):
    return report(t.imports.where("alias = base"), "alias is the import's own name")


@check("imports-blocklist")
def _(t):
    return report(t.imports.where(F.col("target").isin(*t.options["blocked-imports"])) if t.options["blocked-imports"] else t.imports.where("false"), "import is blocked")


@check("blank-imports")
def _(t):
    main = t.of("PackageClause").where("name = 'main'").select("path")
    near = t.comments.select("path", F.col("end_line").alias("c_line")).distinct()
    rows = t.imports.where("alias = '_' AND NOT endswith(path, '_test.go')").join(main, "path", "left_anti")
    beside = rows.select("*", F.explode(E("array(line, line - 1)")).alias("c_line")).join(near, ["path", "c_line"], "left_semi").select("path", "id")
    return report(rows.join(beside, ["path", "id"], "left_anti"), "a blank import needs a comment")


# --- statements


@check("no-defer-in-loop")
def _(t):
    return report(t.of("DeferStmt").where(f"try_element_at(filter(ancestors, a -> a.kind = 'ForStmt' OR a.kind IN {_FUNC}), -1).kind = 'ForStmt'"), "defer runs only when the function ends")


@check("deferred-recover-call")
def _(t):
    return report(t.of("DeferStmt").where("spelling = 'defer recover ( )'"), "a deferred recover does nothing")


@check("discarded-deferred-result")
def _(t):
    calls = t.calls.where("role = 'call' AND try_element_at(ancestors, -1).kind = 'DeferStmt'").select("path", F.col("parent").alias("defer_id"), E(f"{kid('fun')}.id").alias("id"))
    lits = t.of("FunctionLit").where(f"size({kids('result')}) > 0").join(calls, ["path", "id"]).select("path", "defer_id")
    return report(t.of("DeferStmt").join(lits.withColumnRenamed("defer_id", "id"), ["path", "id"], "left_semi"), "the deferred function's result is lost")


@check("no-else-after-return")
def _(t):
    rows = t.ifs.where("other IS NOT NULL").withColumn("a_id", E("then.id")).join(t.last_of("a"), ["path", "a_id"])
    return report(rows.where("try_element_at(a_stmts, -1).kind = 'ReturnStmt'"), "remove else after return", "other.start", "other.stop")


@check("early-return")
def _(t):
    return report(t.branches.where("b_ends AND NOT a_ends"), "invert the condition and return early")


@check("identical-branches")
def _(t):
    return report(t.ifs.where("other.kind = 'Block' AND then.spelling = other.spelling"), "branches are alike", "other.start", "other.stop")


@check("unnecessary-if")
def _(t):
    one = "size({0}) = 1 AND get({0}, 0).kind = 'ReturnStmt'"
    pair = "(get(a_stmts, 0).spelling = 'return true' AND get(b_stmts, 0).spelling = 'return false' OR get(a_stmts, 0).spelling = 'return false' AND get(b_stmts, 0).spelling = 'return true')"
    return report(t.branches.where(f"{one.format('a_stmts')} AND {one.format('b_stmts')} AND {pair}"), "return the condition")


@check("empty-conditional-block")
def _(t):
    return report(t.blocks.where("kind = 'Block' AND size(stmts) = 0 AND try_element_at(ancestors, -1).kind = 'IfStmt'"), "block is empty")


def _chains(t):
    """Conditionals of chains of two or more: ``chain`` is the first one's id."""
    up = "size(ancestors) - coalesce(nullif(array_position(reverse(transform(ancestors, a -> a.kind = 'IfStmt' AND a.role = 'else')), false), 0), 0)"
    rows = t.ifs.withColumn("depth", F.when(E("role = 'else'"), E(up)).otherwise(F.lit(-1)))
    return rows.withColumn("chain", F.when(E("role = 'else'"), E("get(ancestors, depth).id")).otherwise(F.col("id")))


@check("identical-if-chain-conditions")
def _(t):
    rows = _chains(t).where(f"{kid('init')} IS NULL AND NOT contains(cond.spelling, '(') AND NOT contains(cond.spelling, '<-')")
    return report(rows.withColumn("nth", F.row_number().over(Window.partitionBy("path", "chain", "cond.spelling").orderBy("start"))).where("nth > 1"), "condition is tested before", "cond.start", "cond.stop")


@check("identical-if-chain-branches")
def _(t):
    rows = _chains(t)
    bodies = rows.select("path", "chain", F.col("then.spelling").alias("s"), F.col("then.start").alias("start"), F.col("then.stop").alias("stop"), F.lit(False).alias("final"))
    last = rows.where("other.kind = 'Block'").select("path", "chain", F.col("other.spelling").alias("s"), F.col("other.start").alias("start"), F.col("other.stop").alias("stop"), F.lit(True).alias("final"))
    whole = bodies.unionByName(last).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("path", "chain")))
    return report(whole.withColumn("nth", F.row_number().over(Window.partitionBy("path", "chain", "s").orderBy("start"))).where("nth > 1 AND size > 2"), "branch repeats another one of the chain")


@check("unreachable-code")
def _(t):
    ends = _ENDS.format("get(stmts, i - 1)")
    rows = t.blocks.where("size(stmts) > 1").select("path", F.explode(E(f"filter(transform(stmts, (s, i) -> IF(i > 0 AND {ends}, s, NULL)), s -> s IS NOT NULL)")).alias("s"))
    return report(rows, "statement is not reached", "s.start", "s.stop")


@check("redundant-switch-break")
def _(t):
    rows = t.blocks.where("kind = 'CaseClause' AND size(stmts) > 0").withColumn("z", E("try_element_at(stmts, -1)"))
    return report(rows.where("z.kind = 'BreakStmt' AND z.spelling = 'break'"), "break is implied", "z.start", "z.stop")


@check("single-case-switch")
def _(t):
    rows = t.of("SwitchStmt", "TypeSwitchStmt").where(f"size({kids('clause')}) = 1")
    one = t.of("CaseClause").where(f"size({kids('value')}) <= 1").select("path", F.col("parent").alias("id"))
    return report(rows.join(one, ["path", "id"], "left_semi"), "use if for a single case")


@check("enforce-switch-style")
def _(t):
    rows = t.of("CaseClause").withColumn("last", F.max("ordinal").over(Window.partitionBy("path", "parent")))
    return report(rows.where("name = 'default' AND ordinal < last"), "default should be the last clause")


@check("identical-switch-conditions")
def _(t):
    rows = t.of("CaseClause").where("try_element_at(ancestors, -1).kind = 'SwitchStmt'").select("path", "parent", F.explode(E(kids("value"))).alias("v"))
    return report(rows.withColumn("nth", F.row_number().over(Window.partitionBy("path", "parent", "v.spelling").orderBy("v.start"))).where("nth > 1"), "case is listed before", "v.start", "v.stop")


@check("identical-switch-branches")
def _(t):
    rows = t.blocks.where("kind = 'CaseClause' AND size(stmts) > 0").withColumn("s", E("array_join(transform(stmts, x -> x.spelling), ' ; ')"))
    return report(rows.withColumn("nth", F.row_number().over(Window.partitionBy("path", "parent", "s").orderBy("start"))).where("nth > 1"), "case body repeats another one")


@check("redundant-error-return-check")
def _(t):
    pairs = "filter(transform(stmts, (s, i) -> IF(i + 1 < size(stmts) AND regexp_like(s.spelling, '^if err := .* ; err != nil [{] return err [}]$') AND get(stmts, i + 1).spelling = 'return nil', s, NULL)), s -> s IS NOT NULL)"
    return report(t.blocks.select("path", F.explode(E(pairs)).alias("s")), "return the call's error", "s.start", "s.stop")


@check("increment-decrement")
def _(t):
    left = f"{kid('left')}.spelling"
    right = f"{kid('right')}.spelling"
    return report(t.of("AssignStmt").where(f"name = '=' AND size(children) = 2 AND {right} IN (concat({left}, ' + 1'), concat({left}, ' - 1')) OR name IN ('+=', '-=') AND {right} = '1'"), "use ++ or --")


@check("excessive-blank-identifiers")
def _(t):
    return report(t.of("AssignStmt").where(f"size(filter({kids('left')}, c -> c.name = '_' AND c.kind = 'Ident')) >= 3"), "too many blank identifiers")


@check("max-control-nesting")
def _(t):
    return report(t.rows.where(f"kind IN {_CONTROL} AND size(filter(ancestors, a -> a.kind IN {_CONTROL})) >= 5"), "control flow is nested too deeply")


@check("spinning-select-default")
def _(t):
    loops = t.of("ForStmt").where("size(children) = 1").select("path", F.col("id").alias("loop"), "start", "stop", E("get(children, 0).id").alias("id"))
    only = t.blocks.where("kind = 'Block' AND size(stmts) = 1 AND get(stmts, 0).kind = 'SelectStmt'").select("path", "id", E("get(stmts, 0).id").alias("parent"))
    idle = t.blocks.where("kind = 'CommClause' AND name = 'default' AND size(stmts) = 0").select("path", "parent")
    return report(loops.join(only, ["path", "id"]).join(idle, ["path", "parent"], "left_semi"), "loop spins on an empty default")


@check("simplify-range")
def _(t):
    runes = t.of("Range").where("regexp_like(spelling, '^range \\\\[ \\\\] rune \\\\( ') AND try_element_at(ancestors, -1).kind = 'AssignStmt'").select("path", F.col("parent").alias("id"), F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    rows = t.of("AssignStmt").where(f"role = 'range' AND size({kids('left')}) = 2 AND {kid('left')}.name = '_'").join(runes, ["path", "id"]).select("path", "r_start", "r_stop")
    blank = t.of("AssignStmt").where(f"role = 'range' AND size({kids('left')}) = 2 AND get({kids('left')}, 1).name = '_' AND get({kids('left')}, 1).kind = 'Ident'").select("path", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    return report(rows.unionByName(blank), "range can be simpler", "r_start", "r_stop")


@check("range-value-address")
def _(t):
    loops = t.of("AssignStmt").where(f"role = 'range' AND name = ':='").select("path", F.col("parent").alias("loop"), F.explode(E(kids("left"))).alias("v")).select("path", "loop", F.col("v.name").alias("var"))
    rows = t.of("Unary").where("name = '&' AND get(children, 0).kind = 'Ident'").withColumn("var", E("get(children, 0).name")).withColumn("loop", F.explode(E("transform(filter(ancestors, a -> a.kind = 'ForStmt'), a -> a.id)")))
    return report(rows.join(loops.where("var <> '_'"), ["path", "loop", "var"], "left_semi").dropDuplicates(["path", "id"]), "address of a range variable")


# --- expressions


@check("boolean-literal-comparison")
def _(t):
    return report(t.of("Binary").where("name IN ('==', '!=') AND exists(children, c -> c.bare IN ('true', 'false'))"), "compare with a boolean literal is needless")


@check("constant-logical-expr")
def _(t):
    return report(t.of("Binary").where("name = '&&' AND get(children, 0).bare = 'false' OR name = '||' AND get(children, 0).bare = 'true'"), "expression has a constant value")


@check("modulo-one")
def _(t):
    return report(t.of("Binary").where("name = '%' AND get(children, 1).value = '1'"), "x % 1 is always 0")


@check("zero-integer-division")
def _(t):
    number = "TRY_CAST(get(children, {0}).value AS DECIMAL(38,0))"
    literals = "forall(children, c -> c.bare_kind = 'BasicLit' AND regexp_like(c.bare, '^[0-9]'))"
    return report(t.of("Binary").where(f"name = '/' AND {literals} AND {number.format(0)} < {number.format(1)}"), "integer division gives 0")


@check("double-negation")
def _(t):
    return report(t.of("Unary").where("name = '!' AND get(children, 0).kind = 'Unary' AND get(children, 0).name = '!' AND NOT (try_element_at(ancestors, -1).kind = 'Unary' AND startswith(spelling, '! ! !'))"), "double negation")


@check("ineffective-pointer-copy")
def _(t):
    one = t.of("Unary").where("name = '&' AND get(children, 0).kind = 'Star'").where("NOT regexp_like(spelling, '_C(func|var)_')")
    two = t.of("Star").where("get(children, 0).kind = 'Unary' AND get(children, 0).name = '&'").where("NOT regexp_like(spelling, '_C(func|var)_')")
    return report(one.unionByName(two), "pointer is not copied")


@check("unchecked-type-assertion")
def _(t):
    rows = t.of("TypeAssert").where("name <> 'type'")
    checked = t.of("AssignStmt").where(f"size({kids('left')}) = 2 AND size({kids('right')}) = 1").select("path", F.col("id").alias("parent"))
    declared = t.of("VarSpec").where(f"size({kids('name')}) = 2 AND size({kids('value')}) = 1").select("path", F.col("id").alias("parent"))
    return report(rows.join(checked.unionByName(declared), ["path", "parent"], "left_anti"), "type assertion is unchecked")


@check("insecure-url-scheme")
def _(t):
    return report(t.of("BasicLit").where("regexp_like(lower(name), '^[\"`](http|ws|ftp)://') AND NOT exists(ancestors, a -> a.kind = 'ImportSpec')"), "URL has no transport security")


@check("add-constant")
def _(t):
    rows = t.of("BasicLit").where("regexp_like(name, '^[\"`]') AND length(name) > 2 AND NOT exists(ancestors, a -> a.kind IN ('ConstDecl', 'VarDecl', 'TypeDecl', 'ImportDecl'))")
    return report(rows.withColumn("nth", F.row_number().over(Window.partitionBy("path", "name").orderBy("start"))).where("nth = 3"), "repeated literal should be a constant")


@check("inefficient-map-lookup")
def _(t):
    heads = t.of("AssignStmt").where(f"role = 'init' AND size({kids('left')}) = 2 AND size({kids('right')}) = 1 AND {kid('right')}.kind = 'Index'")
    heads = heads.where("try_element_at(ancestors, -1).kind = 'IfStmt'").select("path", F.col("parent").alias("owner"), E(f"{kid('right')}.spelling").alias("spelling"))
    inner = t.of("Index").withColumn("owner", F.explode(E("transform(filter(ancestors, (a, i) -> a.kind = 'IfStmt' AND coalesce(get(ancestors, i + 1).role, '') = 'then'), a -> a.id)")))
    return report(inner.join(heads, ["path", "owner", "spelling"], "left_semi").dropDuplicates(["path", "id"]), "the looked-up value is at hand")


# --- calls


def _call(code: str, where: str, message: str):
    CHECKS[code] = lambda t: report(t.calls.where(where), message)


_call("call-to-gc", "callee = 'runtime.GC'", "the collector runs by itself")
_call("use-fmt-print", "callee IN ('print', 'println')", "use the fmt package")
_call("use-slices-sort", "callee IN ('sort.Slice', 'sort.SliceStable')", "use the slices package")
_call("use-errors-new", "callee = 'fmt.Errorf' AND size(args) = 1 AND get(args, 0).kind = 'BasicLit' AND NOT contains(get(args, 0).name, '%')", "use errors.New")
_call("prefer-fmt-errorf", "callee = 'errors.New' AND size(args) = 1 AND regexp_like(get(args, 0).spelling, '^fmt [.] Sprintf ')", "use fmt.Errorf")
_call("unnecessary-format", "callee IN ('fmt.Sprintf', 'fmt.Printf', 'fmt.Fprintf') AND get(args, 0).kind = 'BasicLit' AND NOT contains(get(args, 0).name, '%')", "nothing is formatted")
_call("string-of-int", "callee = 'string' AND size(args) = 1 AND (get(args, 0).kind = 'BasicLit' AND regexp_like(get(args, 0).name, '^[0-9]') OR get(args, 0).kind = 'Call' AND regexp_like(get(args, 0).spelling, '^(int|uint)[A-Za-z0-9]* [(]'))", "conversion gives a character")
_call(
    "error-strings",
    "callee IN ('errors.New', 'fmt.Errorf') AND get(args, 0).kind = 'BasicLit' AND (regexp_like(get(args, 0).name, '^[\"`]\\\\p{Lu}[^\\\\p{Lu}]') OR regexp_like(get(args, 0).name, '([.:!]|\\\\\\\\n)[\"`]$'))",
    "error text should not be capitalised or end with punctuation",
)


@check("deep-exit")
def _(t):
    fine = t.functions.where("kind = 'FunctionDecl' AND name IN ('main', 'init')").select("path", F.col("id").alias("fn"))
    rows = t.calls.where(f"callee IN {_EXIT}").withColumn("fn", E("try_element_at(filter(ancestors, a -> a.kind IN ('FunctionDecl', 'MethodDecl')), -1).id"))
    return report(rows.join(fine, ["path", "fn"], "left_anti"), "exit only from main or init")


@check("redundant-atomic-result-assignment")
def _(t):
    rows = t.of("AssignStmt").where(f"name = '=' AND size({kids('left')}) = 1 AND size({kids('right')}) = 1 AND {kid('right')}.kind = 'Call'")
    calls = t.calls.where("startswith(callee, 'atomic.') AND size(args) > 0").select("path", F.col("id").alias("call"), E("regexp_replace(get(args, 0).spelling, '^& ', '')").alias("target"))
    joined = rows.withColumn("call", E(f"{kid('right')}.id")).withColumn("target", E(f"{kid('left')}.spelling")).join(calls, ["path", "call", "target"], "left_semi")
    return report(joined, "the atomic call stores its result itself")


@check("time-date")
def _(t):
    ranges = "array(named_struct('i', 1, 'lo', 1, 'hi', 12), named_struct('i', 2, 'lo', 1, 'hi', 31), named_struct('i', 3, 'lo', 0, 'hi', 23), named_struct('i', 4, 'lo', 0, 'hi', 59), named_struct('i', 5, 'lo', 0, 'hi', 59), named_struct('i', 6, 'lo', 0, 'hi', 999999999))"
    rows = t.calls.where("callee = 'time.Date' AND size(args) >= 7").select("path", "args", F.explode(E(ranges)).alias("r")).withColumn("a", E("get(args, r.i)"))
    return report(rows.where("a.kind = 'BasicLit' AND regexp_like(a.name, '^[0-9]+$') AND NOT TRY_CAST(a.name AS DECIMAL(38,0)) BETWEEN r.lo AND r.hi"), "argument is out of range", "a.start", "a.stop")


# --- files and comments


@check("file-length-limit")
def _(t):
    limit = t.options["max-file-lines"]
    rows = t.text.where(F.size(F.split("text", "\n", -1)) > limit) if limit else t.text.where("false")
    return report(rows, "file is too long", "0", "size")


@check("filename-format")
def _(t):
    return report(t.text.where("NOT regexp_like(substring_index(path, '/', -1), '^[_A-Za-z0-9][_A-Za-z0-9-]*\\\\.go$')"), "file name has odd characters", "0", "0")


@check("package-naming")
def _(t):
    return report(t.of("PackageClause").where("NOT regexp_like(regexp_replace(name, '_test$', ''), '^[a-z][a-z0-9]*$')"), "package name should be lower case letters and digits", f"{kid('name')}.start", f"{kid('name')}.stop")


@check("package-directory-mismatch")
def _(t):
    rows = t.of("PackageClause").where("name <> 'main' AND contains(path, '/')").withColumn("dir", E("lower(regexp_replace(try_element_at(split(path, '/'), -2), '[-_]', ''))"))
    return report(rows.where("dir <> '' AND regexp_replace(name, '_test$', '') <> dir"), "package is named unlike its directory", f"{kid('name')}.start", f"{kid('name')}.stop")


@check("package-comments")
def _(t):
    rows = t.of("PackageClause").where("NOT endswith(path, '_test.go')")
    documented = t.comments.where("gap_lines <= 1").select("path", F.col("next_code").alias("start"))
    return report(rows.join(documented, ["path", "start"], "left_anti"), "package has no documentation")


@check("bidirectional-control-character")
def _(t):
    marks = "[" + "".join(map(chr, [*range(0x202A, 0x202F), *range(0x2066, 0x206A)])) + "]"
    parts = t.text.where(F.col("text").rlike(marks)).select("path", F.split("text", marks, -1).alias("parts"))
    at = E("transform(sequence(1, size(parts) - 1), k -> octet_length(array_join(slice(parts, 1, k), '')) + 3 * (k - 1))")
    return report(parts.select("path", F.explode(at).alias("start")), "bidirectional control character", "start", "start + 3")


@check("task-comment")
def _(t):
    return report(t.comments.where("exists(split(text, '[^\\\\p{L}]+'), w -> w IN ('TODO', 'FIXME', 'BUG'))"), "comment marks a task")


@check("spaced-compiler-directive")
def _(t):
    return report(t.comments.where("col = 1 AND regexp_like(text, '^//[ \\\\t]+go:[a-z]')"), "a directive has no space")


@check("redundant-build-tag")
def _(t):
    rows = t.comments.where("col = 1 AND (startswith(text, '//go:build ') OR regexp_like(text, '^// ?[+]build '))").withColumn("modern", E("startswith(text, '//go:build ')"))
    rows = rows.withColumn("has", F.max("modern").over(Window.partitionBy("path"))).withColumn("terms", E("array_join(array_sort(split(regexp_replace(text, '^//(go:build| ?[+]build) ', ''), '[ ]+')), ' ')"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("path", "modern", "terms").orderBy("start")))
    return report(rows.where("has AND NOT modern OR nth > 1"), "build constraint is redundant")


def _documented(t):
    """Exported top-level declarations with the comment directly before them (or null)."""
    fns = t.functions.where("try_element_at(ancestors, -1).kind = 'SourceFile'").select("path", "start", "name", F.col("name_start").alias("n_start"), F.col("name_stop").alias("n_stop"))
    specs = t.of("TypeDecl", "VarDecl", "ConstDecl").where("try_element_at(ancestors, -1).kind = 'SourceFile' AND size(children) = 1").select("path", F.col("id").alias("parent"), F.col("start").alias("d_start"))
    named = t.of("TypeSpec", "VarSpec", "ConstSpec").join(specs, ["path", "parent"]).select("path", F.col("d_start").alias("start"), E(f"{kid('name')}.name").alias("name"), E(f"{kid('name')}.start").alias("n_start"), E(f"{kid('name')}.stop").alias("n_stop"))
    docs = t.comments.where("gap_lines <= 1").select("path", F.col("next_code").alias("start"), F.col("text").alias("doc"), F.col("start").alias("c_start"), F.col("stop").alias("c_stop"))
    return fns.unionByName(named).where("regexp_like(name, '^\\\\p{Lu}')").join(docs, ["path", "start"], "left")


@check("exported-declaration-comment")
def _(t):
    first = t.comments.where("blank_before").select("path", "line", "end_line", "text", "next_code", "gap_lines", F.col("start").alias("c"))
    # Runs of comment lines end before the declaration; the first line of the run names it.
    w = Window.partitionBy("path").orderBy("c")
    runs = first.withColumn("new", F.when(F.lag("end_line").over(w) + 1 == F.col("line"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    heads = runs.groupBy("path", "run").agg(F.min_by("text", "c").alias("head"), F.max_by("next_code", "c").alias("start"), F.max_by("gap_lines", "c").alias("gap"))
    rows = _documented(t).drop("doc", "c_start", "c_stop").join(heads.where("gap <= 1").select("path", "start", "head"), ["path", "start"], "left")
    text = E("trim(regexp_replace(head, '^(//|/[*])', ''))")
    return report(rows.where(F.col("head").isNull() | ~F.startswith(text, F.col("name"))), "exported declaration needs a comment that starts with its name", "n_start", "n_stop")


@check("doc-comment-period")
def _(t):
    package = t.of("PackageClause").select("path", "start").join(t.comments.where("gap_lines <= 1").select("path", F.col("next_code").alias("start"), F.col("text").alias("doc"), F.col("start").alias("c_start"), F.col("stop").alias("c_stop")), ["path", "start"])
    rows = package.select("path", "doc", "c_start", "c_stop").unionByName(_documented(t).where("doc IS NOT NULL").select("path", "doc", "c_start", "c_stop")).distinct()
    text = E("trim(regexp_replace(regexp_replace(doc, '^(//|/[*])', ''), '[*]/$', ''))")
    return report(rows.where((text != "") & ~text.rlike("[.!?:]$")), "documentation comment should end with punctuation", "c_start", "c_stop")


@check("invalid-struct-tag")
def _(t):
    rows = t.of("Field").withColumn("tag", E(kid("tag"))).where("tag IS NOT NULL AND startswith(tag.name, '`')").withColumn("text", E("trim(substring(tag.name, 2, length(tag.name) - 2))"))
    keys = E("regexp_extract_all(text, '([^\\\\s\":]+):\"(?:[^\"\\\\\\\\]|\\\\\\\\.)*\"', 1)")
    valid = "text = '' OR regexp_like(text, '^([^\\\\s\":]+:\"(?:[^\"\\\\\\\\]|\\\\\\\\.)*\"\\\\s*)*$')"
    rows = rows.withColumn("keys", keys)
    return report(rows.where(f"NOT ({valid}) OR size(keys) <> size(array_distinct(keys))"), "struct tag is malformed", "tag.start", "tag.stop")


#: Options of checks by code and name, and the key and kind under which they are kept.
_BOUND = {
    ("max-parameters", "max-parameters"): "max-parameters",
    ("function-length", "max-lines"): "max-lines",
    ("function-length", "max-statements"): "max-statements",
    ("function-result-limit", "max-results"): "max-results",
    ("file-length-limit", "max-lines"): "max-file-lines",
    ("max-public-structs", "max-public-structs"): "max-public-structs",
    ("interface-method-limit", "max-methods"): "max-methods",
    ("imports-blocklist", "blocked-imports"): "blocked-imports",
    ("banned-characters", "characters"): "characters",
}


def option_defaults() -> dict[tuple[str, str], object]:
    return {k: OPTIONS[key] for k, key in _BOUND.items()}


def bound_options(config: dict) -> dict:
    """Options of the configured checks, checked by name and kind: whole numbers from 0, or lists of texts."""
    out = {}
    for code, setting in config.get("checks", {}).items():
        for name, value in setting.get("options", {}).items():
            key = _BOUND.get((code.lower(), name))
            if key is None:
                raise ValueError(f"unknown option of {code}: {name}")
            if isinstance(OPTIONS[key], list):
                if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
                    raise ValueError(f"option {name} of {code} is a list of texts")
            elif not isinstance(value, int) or isinstance(value, bool):
                raise ValueError(f"option {name} of {code} is a whole number")
            elif value < 0:
                raise ValueError(f"option {name} of {code} is out of range")
            out[key] = value
    return out


def _semantic() -> tuple:
    """The modules of the approximated checks; all of them add to one table."""
    from . import semantic, semantic_calls, semantic_local

    return semantic, semantic_calls, semantic_local


def _all() -> dict[str, Callable[[Tables], DataFrame]]:
    return CHECKS | _semantic()[0].CHECKS | {"format": _format}


def _format(t: Tables) -> DataFrame:
    from .formatting import rewritten

    rows = rewritten(t.files).select("path", F.lit(0).alias("start"), F.octet_length("content").alias("stop"))
    return report(rows, "file is not formatted")


def supported() -> list[str]:
    return [*_all()]


def severities() -> list[tuple[str, dict[str, str], bool]]:
    """Engine, codes by severity, and whether they are supported."""
    modules = _semantic()
    return [("format", {"warning": "format"}, True), ("syntax", SEVERITY, True), *[("semantic", m.SEVERITY, True) for m in modules], ("semantic", modules[0].UNSUPPORTED, False)]


def severity_of(code: str) -> str:
    return next(s for _, of, _ in severities() for s, codes in of.items() if code in codes.split())


def catalogue(spark: SparkSession) -> DataFrame:
    """All checks: ``code, engine, severity, supported``; unsupported ones never count as clean."""
    rows = [(c, engine, s, ok) for engine, of, ok in severities() for s, codes in of.items() for c in codes.split()]
    return spark.createDataFrame(sorted(rows), "code string, engine string, severity string, supported boolean")


def run(files: DataFrame, codes: list[str] | None = None, options: dict | None = None) -> DataFrame:
    """Findings of the chosen checks (all supported ones by default) over ``files`` (``path``, ``content``)."""
    known = _all()
    chosen = sorted(known) if codes is None else codes
    if unknown := [c for c in chosen if c not in known]:
        raise ValueError("unsupported checks: " + ", ".join(unknown))
    t = Tables(files, OPTIONS | (options or {}), share=len(chosen) > 1)
    rows = reduce(DataFrame.unionByName, folded({c: known[c](t) for c in chosen}))
    severity = F.create_map(*[F.lit(x) for c in chosen for x in (c, severity_of(c))])
    # A file's findings are gathered first, so its line starts are joined to them once.
    gathered = rows.groupBy("path").agg(F.collect_list(F.struct("code", "message", "start", "stop")).alias("found"))

    def position(at: Column) -> Column:
        line = tables.line_of(at)
        return F.struct(F.col("path").alias("Filename"), at.alias("Offset"), line.alias("Line"), (at - F.get("line_starts", line - 1) + 1).alias("Column"))

    each = gathered.join(tables.lines(files), "path").select("path", "line_starts", F.explode("found").alias("x"))
    return each.select("x.code", "x.message", severity[F.col("x.code")].alias("severity"), F.col("path").alias("file"), position(F.col("x.start")).alias("start"), position(F.col("x.stop")).alias("end"))


def directives(files: DataFrame, marker: str = "findra") -> DataFrame:
    """Suppressing comments as ``path, code, from, to``.

    ``//findra:ignore-file a,b`` before the package clause spans the file; ``//findra:ignore a,b`` spans the
    first declaration or statement that starts after it (the widest of those that start together).
    """
    t = Tables(files)
    rows = t.comments.withColumn("m", F.regexp_extract("text", f"^//{marker}:(ignore-file|ignore) +([a-z0-9, -]+)", 1)).where("m <> ''")
    rows = rows.withColumn("code", F.explode(F.split(F.regexp_replace(F.regexp_extract("text", f"^//{marker}:(ignore-file|ignore) +([a-z0-9, -]+)", 2), " ", ""), ",")))
    package = t.of("PackageClause").select("path", F.col("start").alias("package"))
    whole = rows.where("m = 'ignore-file'").join(package, "path").where("stop < package").select("path", "code", F.lit(0).alias("from"), F.lit(2**31 - 1).alias("to"))
    targets = t.nodes.where("role IN ('decl', 'stmt', 'spec')").select("path", F.col("start").alias("from"), F.col("stop").alias("to"))
    nearest = rows.where("m = 'ignore'").join(targets, "path").where("from >= stop").groupBy("path", "code", "stop").agg(F.min_by(F.struct("from", "to"), F.struct("from", -F.col("to"))).alias("n"))
    return whole.unionByName(nearest.select("path", "code", "n.from", "n.to"))


def suppressed(files: DataFrame, found: DataFrame) -> DataFrame:
    """Findings left by the files' directives, which bind syntax checks only."""
    from ..operators.findings import suppress

    syntax = F.col("code").isin(*sorted(CHECKS))
    return suppress(found.where(syntax), directives(files)).unionByName(found.where(~syntax))
