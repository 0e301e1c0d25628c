"""Approximations, from syntax and import names alone, of checks that properly need types.

They look at how calls and constants are spelt: an import under another name, a named constant or a
shadowed package is missed. Checks that need the type checker or control flow are listed in
``UNSUPPORTED`` and are never run, so that nothing reports silence as cleanliness.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .checks import E, Tables, kid, kids, report

#: Default severities of the approximated checks.
SEVERITY = {
    "error": "benchmark-iteration-mutation dangerous-directory-removal deferred-lock-after-lock invalid-strconv-argument",
    "warning": "constant-negative-zero decimal-file-mode duplicate-trim-cutset empty-critical-section invalid-exec-command negative-length-capacity-comparison partially-typed-constant-group "
    "random-bound-one single-argument-append spinning-empty-loop standard-http-method-constant suspicious-sleep swapped-seek-arguments test-main-missing-exit untrappable-signal weak-cryptography "
    "zero-replacement-limit",
}
#: Checks that need types, data flow or a constraint solver.
UNSUPPORTED = {
    "error": "contradictory-interface-assertion impossible-interface-nil-comparison invalid-template invalid-time-layout misaligned-atomic-64 sort-non-slice timer-reset-drain-race "
    "unsupported-binary-write unsupported-marshal-type",
    "warning": "constructor-interface-return deprecated-api-usage impossible-platform-comparison ineffective-value-receiver-assignment leaky-time-tick overwritten-before-use range-value-capture separate-byte-string-map-key unreachable-type-switch-case",
    "note": "slice-preallocation",
}

CHECKS: dict = {}


def check(code: str):
    def add(f):
        CHECKS[code] = f
        return f

    return add


def _call(code: str, where: str, message: str) -> None:
    CHECKS[code] = lambda t: report(t.calls.where(where), message)


_STRING = "'^\"[^\"\\\\\\\\]*\"$'"

_call("suspicious-sleep", "callee = 'time.Sleep' AND size(args) = 1 AND get(args, 0).kind = 'BasicLit' AND regexp_like(get(args, 0).name, '^[1-9][0-9]{0,2}$') AND TRY_CAST(get(args, 0).name AS INT) <= 120", "sleep of a few nanoseconds")
_call("invalid-exec-command", f"callee = 'exec.Command' AND get(args, 0).kind = 'BasicLit' AND regexp_like(get(args, 0).name, {_STRING}) AND contains(get(args, 0).name, ' ') AND NOT regexp_like(get(args, 0).name, '[/\\\\\\\\]')", "command name holds arguments")
_call("zero-replacement-limit", "callee IN ('strings.Replace', 'bytes.Replace') AND size(args) = 4 AND get(args, 3).spelling = '0'", "nothing is replaced")
_call("random-bound-one", "regexp_like(callee, '^rand[.](Intn|Int31n|Int63n|IntN|Int32N|Int64N|UintN|Uint32N|Uint64N|N)$') AND size(args) = 1 AND get(args, 0).spelling = '1'", "result is always 0")
_call("untrappable-signal", "callee IN ('signal.Notify', 'signal.Ignore', 'signal.Reset') AND exists(args, a -> a.spelling IN ('os . Kill', 'syscall . SIGKILL', 'syscall . SIGSTOP'))", "signal cannot be trapped")
_call("duplicate-trim-cutset", f"callee IN ('strings.Trim', 'strings.TrimLeft', 'strings.TrimRight') AND size(args) = 2 AND get(args, 1).kind = 'BasicLit' AND regexp_like(get(args, 1).name, {_STRING}) AND size(split(substring(get(args, 1).name, 2, length(get(args, 1).name) - 2), '')) > size(array_distinct(split(substring(get(args, 1).name, 2, length(get(args, 1).name) - 2), '')))", "cutset repeats a character")
_call("decimal-file-mode", "callee IN ('os.Mkdir', 'os.MkdirAll', 'os.Chmod', 'os.OpenFile', 'os.WriteFile', 'ioutil.WriteFile') AND size(args) > 1 AND regexp_like(try_element_at(args, -1).spelling, '^[1-7][0-7]{2}$')", "file mode is decimal")
_call("swapped-seek-arguments", "endswith(callee, '.Seek') AND size(args) = 2 AND get(args, 0).spelling IN ('io . SeekStart', 'io . SeekCurrent', 'io . SeekEnd')", "Seek takes the offset first")
_call("single-argument-append", "callee = 'append' AND size(args) = 1 AND name = ''", "append of nothing")
_call("standard-http-method-constant", "callee IN ('http.NewRequest', 'httptest.NewRequest') AND get(args, 0).name IN ('\"GET\"', '\"HEAD\"', '\"POST\"', '\"PUT\"', '\"PATCH\"', '\"DELETE\"', '\"CONNECT\"', '\"OPTIONS\"', '\"TRACE\"')", "use the method's constant")
_call("dangerous-directory-removal", "callee = 'os.RemoveAll' AND size(args) = 1 AND regexp_like(get(args, 0).spelling, '^os [.] (TempDir|UserCacheDir|UserConfigDir|UserHomeDir) [(] [)]$')", "removes a directory of the user or system")
_call("invalid-strconv-argument", "callee IN ('strconv.ParseInt', 'strconv.ParseUint') AND size(args) = 3 AND (regexp_like(get(args, 1).spelling, '^[0-9]+$') AND (TRY_CAST(get(args, 1).spelling AS INT) = 1 OR TRY_CAST(get(args, 1).spelling AS INT) > 36) OR regexp_like(get(args, 2).spelling, '^[0-9]+$') AND TRY_CAST(get(args, 2).spelling AS INT) > 64) OR callee = 'strconv.ParseFloat' AND size(args) = 2 AND regexp_like(get(args, 1).spelling, '^[0-9]+$') AND get(args, 1).spelling NOT IN ('32', '64')", "argument is out of range")


@check("weak-cryptography")
def _(t: Tables):
    weak = t.imports.where("target IN ('crypto/md5', 'crypto/sha1', 'crypto/des', 'crypto/rc4')").select("path", F.coalesce("alias", "base").alias("package"))
    return report(t.calls.withColumn("package", E("substring_index(callee, '.', 1)")).where("contains(callee, '.')").join(weak, ["path", "package"], "left_semi"), "weak cryptographic function")


@check("spinning-empty-loop")
def _(t):
    empty = t.blocks.where("kind = 'Block' AND role = 'body' AND size(stmts) = 0").select("path", F.col("parent").alias("id"))
    return report(t.of("ForStmt").where(f"{kid('range')} IS NULL AND {kid('post')} IS NULL AND {kid('init')} IS NULL AND NOT regexp_like(coalesce({kid('cond')}.spelling, ''), '[(]|<-|^false$')").join(empty, ["path", "id"], "left_semi"), "loop does nothing for ever")


def _pairs(t, first: str, second: str, message: str):
    """Adjacent statements whose spellings match two patterns with one receiver."""
    hit = f"regexp_like(s.spelling, '^(.*) [.] {first} [(] [)]$')"
    nxt = "get(stmts, i + 1).spelling"
    receiver = f"regexp_extract(s.spelling, '^(.*) [.] {first} [(] [)]$', 1)"
    return report(t.blocks.select("path", F.explode(E(f"filter(transform(stmts, (s, i) -> IF({hit} AND {nxt} = concat({second.format(r=receiver)}), s, NULL)), s -> s IS NOT NULL)")).alias("s")), message, "s.start", "s.stop")


@check("deferred-lock-after-lock")
def _(t):
    found = [_pairs(t, m, "'defer ', {r}, ' . " + m + " ( )'", "lock is deferred, not its release") for m in ("Lock", "RLock")]
    return found[0].unionByName(found[1])


@check("empty-critical-section")
def _(t):
    return _pairs(t, "Lock", "{r}, ' . Unlock ( )'", "nothing is done under the lock").unionByName(_pairs(t, "RLock", "{r}, ' . RUnlock ( )'", "nothing is done under the lock"))


@check("negative-length-capacity-comparison")
def _(t):
    one = "regexp_like({0}, '^(len|cap) [(] ')"
    return report(t.of("Binary").where(f"name = '<' AND {one.format('get(children, 0).spelling')} AND get(children, 1).spelling = '0' OR name = '>' AND get(children, 0).spelling = '0' AND {one.format('get(children, 1).spelling')}"), "length is never negative")


@check("constant-negative-zero")
def _(t):
    return report(t.of("Unary").where("name = '-' AND regexp_like(get(children, 0).spelling, '^(0[.]0*|[.]0+|float(32|64) [(] 0([.]0*)? [)])$')"), "this is positive zero")


@check("benchmark-iteration-mutation")
def _(t):
    benches = t.params.where("type = '*testing.B'").select("path", F.col("parent").alias("fn"), E("get(names, 0).name").alias("b"))
    writes = t.nodes.where("role = 'left' AND kind = 'Selector' AND name = 'N' AND try_element_at(ancestors, -1).kind IN ('AssignStmt', 'IncDecStmt')")
    writes = writes.withColumn("b", E("get(children, 0).name")).withColumn("fn", E("get(filter(ancestors, a -> a.kind IN ('FunctionDecl', 'MethodDecl')), 0).id"))
    return report(writes.join(benches, ["path", "fn", "b"], "left_semi"), "the benchmark's count is changed")


@check("test-main-missing-exit")
def _(t):
    mains = t.functions.where("name = 'TestMain' AND kind = 'FunctionDecl'")
    inner = t.calls.withColumn("fn", E("get(filter(ancestors, a -> a.kind = 'FunctionDecl'), 0).id")).groupBy("path", "fn").agg(F.bool_or(E("endswith(callee, '.Run')")).alias("runs"), F.bool_or(E("callee = 'os.Exit'")).alias("exits"))
    return report(mains.join(inner.withColumnRenamed("fn", "id"), ["path", "id"]).where("runs AND NOT exits"), "TestMain drops the exit code", "name_start", "name_stop")


@check("partially-typed-constant-group")
def _(t):
    specs = t.of("ConstSpec").withColumn("typed", E(f"{kid('type')} IS NOT NULL")).withColumn("plain", E(f"{kid('type')} IS NULL AND size({kids('value')}) > 0 AND forall({kids('value')}, v -> v.kind = 'BasicLit')"))
    groups = specs.groupBy("path", "parent").agg(F.min_by("typed", "start").alias("first"), F.count_if("typed").alias("t"), F.count_if("plain").alias("p"), F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.min_by("stop", "start").alias("stop"))
    return report(groups.where("first AND n > 1 AND t = 1 AND p = n - 1"), "only the first constant has the type")
