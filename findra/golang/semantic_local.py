"""Approximations of type-based checks that follow names within one function, file or directory.

A variable's type is what its declaration spells (parameters, ``var``, ``:=`` of a literal or conversion);
variables are told apart by function and name, so a shadowed name is taken for the outer one. Types and
functions are looked for in the same directory. Where nothing is known of a name, nothing is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import E, Tables, kid, kids, report
from .semantic import check

#: Default severities of these checks.
SEVERITY = {
    "error": "copy-lock-value defer-close-before-error-check discarded-error-result finalizer-captures-object infinite-recursion never-nil-comparison nil-error-return nil-map-assignment "
    "non-pointer-unmarshal testing-fatal-in-goroutine unchecked-rows-error unclosed-http-response-body unclosed-sql-resource unused-append-result waitgroup-add-inside-goroutine "
    "waitgroup-go-forbidden-call writer-buffer-mutation",
    "warning": "append-to-sized-slice argument-overwritten-before-use context-cancel-in-loop deferred-return-function-not-called error-type-naming impossible-integer-comparison inefficient-sprintf "
    "ip-byte-comparison nil-value-with-nil-error non-pointer-sync-pool-value pointless-integer-math redundant-conversion single-iteration-loop time-value-equality unbuffered-signal-channel unchanged-loop-condition "
    "unexported-serialization-fields",
}

#: Fixed values of the standard library.
LOCKS = "'sync.Mutex', 'sync.RWMutex', 'sync.Once', 'sync.Cond', 'sync.Pool', 'sync.Map', 'sync.WaitGroup'"
INTEGERS = "'int', 'int8', 'int16', 'int32', 'int64', 'uint', 'uint8', 'uint16', 'uint32', 'uint64', 'uintptr', 'byte', 'rune'"
UNSIGNED = "'uint', 'uint8', 'uint16', 'uint32', 'uint64', 'uintptr', 'byte'"
BASIC = INTEGERS + ", 'string', 'bool', 'float32', 'float64'"

FN = "get(filter(ancestors, a -> a.kind IN ('FunctionDecl', 'MethodDecl')), 0).id"
#: The start of a composite literal or conversion gives the type of what it initialises.
_TYPE_OF_INIT = (
    "CASE WHEN init.bare_kind = 'CompositeLit' AND regexp_like(init.bare, '^[A-Za-z_][A-Za-z0-9_]*( [.] [A-Za-z_][A-Za-z0-9_]*)? [{]') THEN replace(regexp_extract(init.bare, '^([^{]*) [{]', 1), ' ', '') "
    "WHEN init.bare_kind = 'Call' AND init.target IN (" + BASIC + ") THEN init.target WHEN init.bare_kind = 'Call' AND init.target = 'len' THEN 'int' "
    "WHEN init.bare_kind = 'Call' AND init.target = 'time.Now' THEN 'time.Time' WHEN init.bare_kind = 'Call' AND init.target IN ('net.ParseIP', 'net.IPv4') THEN 'net.IP' "
    "WHEN startswith(init.constant, '\"') THEN 'string' WHEN init.bare IN ('true', 'false') THEN 'bool' WHEN init.bare_kind = 'BasicLit' AND regexp_like(init.bare, '^[0-9]+$') THEN 'int' END"
)


def folder(path: str = "path") -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def variables(t: Tables) -> DataFrame:
    return t.once("variables", lambda: _variables(t))


def _variables(t: Tables) -> DataFrame:
    """``path, fn, name, vtype, init, start``: parameters and local variables, types spelt without spaces, null where not told."""
    nothing = F.lit(None).cast(t.nodes.schema["children"].dataType.elementType)
    params = t.params.where("role IN ('param', 'receiver')").select("path", F.col("parent").alias("fn"), F.explode("names.name").alias("name"), F.col("type").alias("vtype"), nothing.alias("init"), "start")
    specs = t.of("VarSpec").withColumn("fn", E(FN)).where("fn IS NOT NULL").withColumn("type", E(f"replace({kid('type')}.spelling, ' ', '')"))
    specs = specs.select("path", "fn", "type", "start", F.posexplode(E(kids("name"))).alias("at", "n"), E(kids("value")).alias("values"))
    specs = specs.select("path", "fn", F.col("n.name").alias("name"), "type", E("get(values, at)").alias("init"), "start").withColumn("vtype", E(f"coalesce(type, {_TYPE_OF_INIT})"))
    defined = t.of("AssignStmt").where("name = ':='").withColumn("fn", E(FN)).where("fn IS NOT NULL")
    defined = defined.select("path", "fn", "start", F.posexplode(E(kids("left"))).alias("at", "n"), E(kids("right")).alias("values"), E(f"size({kids('left')})").alias("wide"))
    # One call on the right gives several values; only the first variable is told of it.
    defined = defined.select("path", "fn", F.col("n.name").alias("name"), E("CASE WHEN size(values) = wide THEN get(values, at) WHEN at = 0 THEN get(values, 0) END").alias("init"), E("size(values) = wide").alias("single"), "start")
    defined = defined.withColumn("vtype", E(f"IF(single, {_TYPE_OF_INIT}, NULL)"))
    columns = ["path", "fn", "name", "vtype", "init", "start"]
    return params.select(columns).unionByName(specs.select(columns)).unionByName(defined.select(columns))


def of_type(t: Tables, types: str) -> DataFrame:
    """``path, fn, name`` of variables all whose declarations in the function have one of the types (a list in SQL)."""

    def make() -> DataFrame:
        per = variables(t).groupBy("path", "fn", "name").agg(F.min(E(f"coalesce(vtype IN ({types}), false)")).alias("all"))
        return per.where("all").drop("all")

    return t.once(f"of type {types}", make)


def in_fn(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fn", E(FN)).where("fn IS NOT NULL")


def writes(t: Tables) -> DataFrame:
    return t.once("writes", lambda: _writes(t))


def _writes(t: Tables) -> DataFrame:
    """``path, fn, name, id, parent, start, stop, op`` of plain names on the left of assignments, ``++`` and ``--``."""
    rows = in_fn(t.of("Ident").where("role = 'left' AND try_element_at(ancestors, -1).kind IN ('AssignStmt', 'IncDecStmt')"))
    how = t.of("AssignStmt", "IncDecStmt").select("path", F.col("id").alias("parent"), F.col("name").alias("op"), E(kids("right")).alias("right"))
    return rows.select("path", "fn", "name", "id", "parent", "start", "stop", "ancestors").join(how, ["path", "parent"])


def results(t: Tables) -> DataFrame:
    return t.once("results", lambda: _results(t))


def _results(t: Tables) -> DataFrame:
    """``path, fn, types``: result types of declared functions in order."""
    rows = t.params.where("role = 'result'").select("path", F.col("parent").alias("fn"), "start", E("transform(sequence(1, greatest(1, size(names))), k -> type)").alias("types"))
    ordered = rows.groupBy("path", "fn").agg(F.array_sort(F.collect_list(F.struct("start", "types"))).alias("r"))
    return ordered.select("path", "fn", F.flatten(F.transform("r", lambda x: x["types"])).alias("types"))


def method_calls(t: Tables, names: str) -> DataFrame:
    """Calls ``x.Name(...)`` on a plain name: with ``fn``, ``on`` and ``method``."""
    pattern = f"^([A-Za-z_][A-Za-z0-9_]*) [.] ({names})$"
    rows = in_fn(t.calls.withColumn("fun", E(kid("fun"))).where(F.col("fun.spelling").rlike(pattern)))
    return rows.withColumn("on", F.regexp_extract("fun.spelling", pattern, 1)).withColumn("method", F.regexp_extract("fun.spelling", pattern, 2))


# --- types of variables


def _typed_binary(t, where: str) -> DataFrame:
    """Comparisons of two plain names: with ``fn``, ``x`` and ``y``."""
    rows = in_fn(t.of("Binary").where(where))
    return rows.withColumn("x", E("get(children, 0).bare")).withColumn("y", E("get(children, 1).bare"))


@check("time-value-equality")
def _(t):
    times = of_type(t, "'time.Time'")
    rows = _typed_binary(t, "name IN ('==', '!=')")
    rows = rows.join(times.withColumnRenamed("name", "x"), ["path", "fn", "x"], "left_semi").join(times.withColumnRenamed("name", "y"), ["path", "fn", "y"], "left_semi")
    return report(rows, "compare times with Equal")


@check("impossible-integer-comparison")
def _(t):
    rows = _typed_binary(t, "name IN ('<', '>=') AND get(children, 1).constant = '0' AND get(children, 0).bare_kind = 'Ident'")
    return report(rows.join(of_type(t, UNSIGNED).withColumnRenamed("name", "x"), ["path", "fn", "x"], "left_semi"), "the integer's type settles the comparison")


def _typed_argument(t, calls: DataFrame, at: int, types: str) -> DataFrame:
    rows = in_fn(calls).withColumn("arg", E(f"get(args, {at}).bare")).where(f"get(args, {at}).bare_kind = 'Ident'")
    return rows.join(of_type(t, types).withColumnRenamed("name", "arg"), ["path", "fn", "arg"], "left_semi")


@check("ip-byte-comparison")
def _(t):
    both = _typed_argument(t, t.calls.where("target = 'bytes.Equal' AND size(args) = 2"), 0, "'net.IP'").drop("fn", "arg")
    return report(_typed_argument(t, both, 1, "'net.IP'"), "compare addresses with Equal")


@check("redundant-conversion")
def _(t):
    rows = in_fn(t.calls.where(f"target IN ({BASIC}) AND size(args) = 1 AND get(args, 0).bare_kind = 'Ident'")).withColumn("name", E("get(args, 0).bare"))
    typed = variables(t).groupBy("path", "fn", "name").agg(F.min("vtype").alias("vtype"), F.max("vtype").alias("other"), F.count_if(F.col("vtype").isNull()).alias("untold")).where("vtype = other AND untold = 0")
    return report(rows.drop("name").withColumn("name", E("get(args, 0).bare")).join(typed, ["path", "fn", "name"]).where("target = vtype"), "value has this type already")


@check("inefficient-sprintf")
def _(t):
    calls = t.calls.where("target = 'fmt.Sprintf' AND size(args) = 2 AND name = ''")
    found = []
    for formats, types in (("'\"%s', '\"%v'", "'string'"), ("'\"%t', '\"%v'", "'bool'"), ("'\"%d', '\"%v'", "'int', 'int64', 'uint64'")):
        found.append(_typed_argument(t, calls.where(f"get(args, 0).constant IN ({formats})"), 1, types).select("path", "start", "stop"))
    words = calls.where("get(args, 0).constant IN ('\"%s', '\"%v') AND startswith(get(args, 1).value, '\"')").select("path", "start", "stop")
    return report(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(words), "the value needs no formatting")


@check("pointless-integer-math")
def _(t):
    outer = t.calls.where("target IN ('math.Ceil', 'math.Floor', 'math.Trunc', 'math.IsNaN', 'math.IsInf') AND get(args, 0).bare_kind = 'Call' AND get(args, 0).target IN ('float64', 'float32')")
    inner = _typed_argument(t, t.calls.where("target IN ('float64', 'float32') AND size(args) = 1"), 0, INTEGERS).select("path", F.col("spelling").alias("inner"), F.col("parent").alias("id"))
    counted = t.calls.where("target IN ('float64', 'float32') AND get(args, 0).bare_kind = 'Call' AND get(args, 0).target IN ('len', 'cap', 'int', 'int64')").select("path", F.col("spelling").alias("inner"), F.col("parent").alias("id"))
    return report(outer.join(inner.unionByName(counted), ["path", "id"], "left_semi"), "an integer has no fraction")


@check("non-pointer-sync-pool-value")
def _(t):
    rows = method_calls(t, "Put").where("size(args) = 1").withColumn("name", F.col("on")).join(of_type(t, "'sync.Pool', '*sync.Pool'"), ["path", "fn", "name"], "left_semi")
    literal = rows.where("get(args, 0).bare_kind = 'CompositeLit'").select("path", "start", "stop", E("get(args, 0)").alias("a"))
    typed = _typed_argument(t, rows.drop("fn", "name"), 0, "'[]byte', '[]int', '[]string', 'string', 'int'").select("path", "start", "stop", E("get(args, 0)").alias("a"))
    return report(literal.unionByName(typed), "the pool allocates for this value", "a.start", "a.stop")


@check("non-pointer-unmarshal")
def _(t):
    calls = in_fn(t.calls.where("target IN ('encoding/json.Unmarshal', 'encoding/xml.Unmarshal') AND size(args) = 2 AND get(args, 1).bare_kind = 'Ident'")).withColumn("name", E("get(args, 1).bare"))
    plain = variables(t).groupBy("path", "fn", "name").agg(F.min(E("coalesce(NOT regexp_like(vtype, '^([*]|map|interface|any$|func|chan)') AND NOT regexp_like(vtype, '[.]'), false)")).alias("plain")).where("plain")
    interfaces = t.of("TypeSpec").where(f"{kid('type')}.kind IN ('InterfaceType', 'Star', 'MapType')").select("path", folder().alias("dir"), F.col("name").alias("vtype"))
    known = variables(t).withColumn("dir", folder()).join(interfaces.drop("path"), ["dir", "vtype"], "left_semi").select("path", "fn", "name")
    return report(calls.drop("name").withColumn("name", E("get(args, 1).bare")).join(plain, ["path", "fn", "name"], "left_semi").join(known, ["path", "fn", "name"], "left_anti"), "destination is no pointer", "get(args, 1).start", "get(args, 1).stop")


@check("unexported-serialization-fields")
def _(t):
    fields = t.of("Field").where("try_element_at(ancestors, -1).kind = 'StructType' AND get(ancestors, size(ancestors) - 2).kind = 'TypeSpec'").withColumn("spec", E("get(ancestors, size(ancestors) - 2).id"))
    shown = fields.groupBy("path", "spec").agg(F.max(E(f"size({kids('name')}) = 0 OR exists({kids('name')}, n -> regexp_like(n.name, '^\\\\p{{Lu}}'))")).alias("shown"))
    hidden = t.of("TypeSpec").select("path", F.col("id").alias("spec"), F.col("name").alias("vtype")).join(shown.where("NOT shown"), ["path", "spec"]).select(folder().alias("dir"), "vtype")
    own = t.of("MethodDecl").where("name IN ('MarshalJSON', 'MarshalText', 'MarshalXML', 'UnmarshalJSON', 'UnmarshalXML', 'UnmarshalText')").select(folder().alias("dir"), E(f"regexp_extract({kid('receiver')}.spelling, '([A-Za-z_0-9]+)$', 1)").alias("vtype"))
    calls = in_fn(t.calls.where("target IN ('encoding/json.Marshal', 'encoding/json.MarshalIndent', 'encoding/xml.Marshal') AND size(args) > 0")).withColumn("arg", E("get(args, 0)")).withColumn("dir", folder())
    direct = calls.where("arg.bare_kind = 'CompositeLit'").withColumn("vtype", E("regexp_extract(arg.bare, '^([A-Za-z_0-9]+) [{]', 1)")).select("path", "dir", "vtype", "arg")
    named = calls.where("arg.bare_kind = 'Ident'").withColumn("name", F.col("arg.bare")).drop("start")
    named = named.join(variables(t).select("path", "fn", "name", "vtype"), ["path", "fn", "name"]).select("path", "dir", E("regexp_replace(vtype, '^[*]', '')").alias("vtype"), "arg")
    return report(direct.unionByName(named).join(hidden, ["dir", "vtype"], "left_semi").join(own, ["dir", "vtype"], "left_anti"), "no field is written", "arg.start", "arg.stop")


# --- locks, goroutines, tests


@check("copy-lock-value")
def _(t):
    fields = t.of("Field").where(f"try_element_at(ancestors, -1).kind = 'StructType' AND get(ancestors, size(ancestors) - 2).kind = 'TypeSpec' AND replace({kid('type')}.spelling, ' ', '') IN ({LOCKS})")
    holders = t.of("TypeSpec").select("path", F.col("id").alias("spec"), "name").join(fields.select("path", E("get(ancestors, size(ancestors) - 2).id").alias("spec")), ["path", "spec"], "left_semi").select(folder().alias("dir"), F.col("name").alias("type")).distinct()
    params = t.params.where("role IN ('param', 'receiver')").select("path", "type", "start", "stop", folder().alias("dir"))
    direct = params.where(f"type IN ({LOCKS})").select("path", "start", "stop")
    return report(params.join(holders, ["dir", "type"], "left_semi").select("path", "start", "stop").unionByName(direct), "a lock is copied")


_GO_LITERAL = "size(filter(ancestors, (a, i) -> a.kind = 'FunctionLit' AND a.role = 'fun' AND coalesce(get(ancestors, i - 2).kind, '') = 'GoStmt')) > 0"


@check("waitgroup-add-inside-goroutine")
def _(t):
    rows = method_calls(t, "Add").where(_GO_LITERAL).withColumn("name", F.col("on"))
    return report(rows.join(of_type(t, "'sync.WaitGroup', '*sync.WaitGroup'"), ["path", "fn", "name"], "left_semi"), "add before the goroutine starts")


@check("waitgroup-go-forbidden-call")
def _(t):
    groups = of_type(t, "'sync.WaitGroup', '*sync.WaitGroup'").withColumnRenamed("name", "on")
    tasks = method_calls(t, "Go").join(groups, ["path", "fn", "on"], "left_semi").where("get(args, 0).kind = 'FunctionLit'").select("path", "fn", "on", E("get(args, 0).id").alias("task"))
    inner = in_fn(t.calls).withColumn("task", F.explode(E("transform(filter(ancestors, a -> a.kind = 'FunctionLit'), a -> a.id)")))
    inner = inner.withColumn("done", E("regexp_extract(callee, '^([A-Za-z_0-9]+)[.]Done$', 1)"))
    rows = inner.join(tasks, ["path", "fn", "task"]).where("callee IN ('panic', 'recover') OR done = on AND done <> ''")
    return report(rows, "the group's task may not call this")


@check("testing-fatal-in-goroutine")
def _(t):
    rows = method_calls(t, "Fatal|Fatalf|FailNow|Skip|Skipf|SkipNow").where(_GO_LITERAL).withColumn("name", F.col("on")).withColumn("go", E("get(filter(ancestors, a -> a.kind = 'GoStmt'), 0).id"))
    rows = rows.join(of_type(t, "'*testing.T', '*testing.B', 'testing.TB', '*testing.F'"), ["path", "fn", "name"], "left_semi").select("path", F.col("go").alias("id")).distinct()
    return report(t.of("GoStmt").join(rows, ["path", "id"], "left_semi"), "only the test's goroutine may end the test")


@check("unbuffered-signal-channel")
def _(t):
    calls = in_fn(t.calls.where("target = 'os/signal.Notify' AND get(args, 0).bare_kind = 'Ident'")).withColumn("name", E("get(args, 0).bare"))
    unbuffered = variables(t).where("init.bare_kind = 'Call' AND init.target = 'make' AND regexp_like(init.bare, '^make [(] chan [^,]*( , 0)? [)]$')").select("path", "fn", "name")
    return report(calls.drop("name").withColumn("name", E("get(args, 0).bare")).join(unbuffered, ["path", "fn", "name"], "left_semi"), "signals are lost on an unbuffered channel", "get(args, 0).start", "get(args, 0).stop")


@check("finalizer-captures-object")
def _(t):
    calls = t.calls.where("target = 'runtime.SetFinalizer' AND size(args) = 2 AND get(args, 0).bare_kind = 'Ident' AND get(args, 1).kind = 'FunctionLit'")
    calls = calls.select("path", "start", "stop", E("get(args, 0).bare").alias("name"), E("get(args, 1).id").alias("closure"))
    used = t.of("Ident").where("role NOT IN ('sel', 'name', 'key')").withColumn("closure", F.explode(E("transform(filter(ancestors, a -> a.kind = 'FunctionLit'), a -> a.id)"))).select("path", "name", "closure")
    own = t.of("Param").where("try_element_at(ancestors, -1).kind = 'FunctionLit'").select("path", F.col("parent").alias("closure"), F.explode(E(f"transform({kids('name')}, n -> n.name)")).alias("name"))
    return report(calls.join(used, ["path", "name", "closure"], "left_semi").join(own, ["path", "name", "closure"], "left_anti"), "the finalizer keeps its object alive")


@check("writer-buffer-mutation")
def _(t):
    writers = t.of("MethodDecl").where(f"name = 'Write' AND size({kids('param')}) = 1 AND regexp_like({kid('param')}.spelling, '^[A-Za-z_0-9]+ \\\\[ \\\\] byte$')").select("path", F.col("id").alias("fn"), E(f"regexp_extract({kid('param')}.spelling, '^([A-Za-z_0-9]+) ', 1)").alias("name"))
    writers = writers.join(results(t).where("types = array('int', 'error')"), ["path", "fn"], "left_semi")
    stores = in_fn(t.of("Index").where("role = 'left' AND get(children, 0).kind = 'Ident'")).withColumn("name", E("get(children, 0).name"))
    return report(stores.join(writers, ["path", "fn", "name"], "left_semi"), "Write may not change its buffer")


# --- errors and results


@check("error-type-naming")
def _(t):
    plain = t.of("MethodDecl").where(f"name = 'Error' AND size({kids('param')}) = 0 AND size({kids('result')}) = 1 AND {kid('result')}.spelling = 'string'")
    errors = plain.select(folder().alias("dir"), E(f"regexp_extract({kid('receiver')}.spelling, '([A-Za-z_0-9]+)$', 1)").alias("name")).distinct()
    rows = t.of("TypeSpec").withColumn("dir", folder()).where("NOT endswith(name, 'Error')")
    return report(rows.join(errors, ["dir", "name"], "left_semi"), "error type is not named so", f"{kid('name')}.start", f"{kid('name')}.stop")


@check("deferred-return-function-not-called")
def _(t):
    made = t.of("FunctionDecl").where(f"size({kids('result')}) = 1 AND startswith({kid('result')}.spelling, 'func (')").select(folder().alias("dir"), F.col("name").alias("callee")).distinct()
    rows = t.of("DeferStmt").withColumn("callee", E("IF(get(children, 0).kind = 'Call', get(children, 0).target, '')")).withColumn("dir", folder())
    return report(rows.join(made, ["dir", "callee"], "left_semi"), "the returned function is never called")


@check("defer-close-before-error-check")
def _(t):
    first = "regexp_extract(s.spelling, '^([A-Za-z_][A-Za-z0-9_]*) , [A-Za-z0-9_]*[eE]rr[A-Za-z0-9_]* :?= .*[)]$', 1)"
    at = f"filter(transform(stmts, (s, i) -> IF({first} <> '' AND get(stmts, i + 1).spelling = concat('defer ', {first}, ' . Close ( )'), get(stmts, i + 1), NULL)), s -> s IS NOT NULL)"
    return report(t.blocks.select("path", F.explode(E(at)).alias("s")), "check the error before deferring Close", "s.start", "s.stop")


@check("discarded-error-result")
def _(t):
    failing = results(t).where("try_element_at(types, -1) = 'error'").join(t.of("FunctionDecl").select("path", F.col("id").alias("fn"), "name"), ["path", "fn"]).select(folder().alias("dir"), F.col("name").alias("callee")).distinct()
    dropped = t.calls.where("role = 'x' AND try_element_at(ancestors, -1).kind = 'ExprStmt'").withColumn("dir", folder())
    known = dropped.where("target IN ('os.Remove', 'os.RemoveAll', 'os.Mkdir', 'os.MkdirAll', 'os.Chdir', 'os.Chmod', 'os.Rename', 'os.Setenv', 'os.WriteFile', 'encoding/json.Unmarshal')").select("path", "start", "stop")
    return report(dropped.join(failing, ["dir", "callee"], "left_semi").select("path", "start", "stop").unionByName(known), "the error is dropped")


@check("nil-error-return")
def _(t):
    tests = in_fn(t.ifs.where("regexp_like(cond.spelling, '^[A-Za-z0-9_]*[eE]rr[A-Za-z0-9_]* != nil$')")).select("path", "fn", E("then.id").alias("id"), E("regexp_extract(cond.spelling, '^([^ ]+) ', 1)").alias("err"))
    failing = results(t).where("try_element_at(types, -1) = 'error'").select("path", "fn")
    stmts = t.blocks.join(tests.join(failing, ["path", "fn"], "left_semi"), ["path", "id"])
    stmts = stmts.where("NOT exists(stmts, s -> s.kind = 'AssignStmt' AND startswith(s.spelling, concat(err, ' ')))")
    returned = stmts.select("path", F.explode(E("filter(stmts, s -> s.kind = 'ReturnStmt' AND regexp_like(s.spelling, '^return (.* , )?nil$'))")).alias("s"))
    return report(returned, "an error is there, and nil is returned", "s.start", "s.stop")


@check("nil-value-with-nil-error")
def _(t):
    both = results(t).where("size(types) = 2 AND types[1] = 'error' AND (startswith(types[0], '*') OR types[0] IN ('any', 'interface{}'))")
    rows = in_fn(t.of("ReturnStmt").where(f"size({kids('value')}) = 2 AND forall({kids('value')}, v -> v.bare = 'nil') AND NOT exists(ancestors, a -> a.kind = 'FunctionLit')"))
    return report(rows.join(both, ["path", "fn"], "left_semi"), "neither a value nor an error is returned")


def _unreleased(t, targets: str, method: str, release: str, message: str) -> DataFrame:
    """Variables set by a call and neither released nor handed on in their function."""
    made = variables(t).where(f"init.bare_kind = 'Call' AND (init.target IN ({targets}) OR regexp_like(init.target, '{method}')) AND name <> '_'").select("path", "fn", "name", E("init.start").alias("start"), E("init.stop").alias("stop"))
    closed = in_fn(t.of("Selector")).withColumn("name", F.regexp_extract("spelling", f"^([A-Za-z_][A-Za-z0-9_]*) [.] {release}$", 1)).where("name <> ''").select("path", "fn", "name")
    handed = in_fn(t.of("Ident").where("role IN ('arg', 'value', 'right', 'element') AND try_element_at(ancestors, -1).kind IN ('Call', 'ReturnStmt', 'AssignStmt', 'KeyValue', 'CompositeLit')")).select("path", "fn", "name")
    return report(made.join(closed, ["path", "fn", "name"], "left_anti").join(handed, ["path", "fn", "name"], "left_anti"), message)


@check("unclosed-http-response-body")
def _(t):
    return _unreleased(t, "'net/http.Get', 'net/http.Post', 'net/http.PostForm', 'net/http.Head'", "^~[A-Za-z_.]*[cC]lient[.](Do|Get|Post|PostForm|Head)$", "Body [.] Close", "the response's body is not closed")


@check("unclosed-sql-resource")
def _(t):
    return _unreleased(t, "''", "^~(db|tx|conn|stmt)[.](Query|QueryContext|Prepare|PrepareContext)$", "Close", "the database's resource is not closed")


@check("unchecked-rows-error")
def _(t):
    rows = variables(t).where("init.bare_kind = 'Call' AND regexp_like(init.target, '[.](Query|QueryContext)$')").select("path", "fn", "name").distinct()
    turns = method_calls(t, "Next").where("role = 'cond'").withColumn("name", F.col("on")).join(rows, ["path", "fn", "name"], "left_semi")
    asked = method_calls(t, "Err").select("path", "fn", F.col("on").alias("name"))
    first = turns.join(asked, ["path", "fn", "name"], "left_anti").groupBy("path", "fn", "name").agg(F.min(F.struct("start", "stop")).alias("at"))
    return report(first, "the rows' error is not asked for", "at.start", "at.stop")


# --- values through a function


@check("nil-map-assignment")
def _(t):
    empty = variables(t).where("startswith(vtype, 'map[') AND init IS NULL").join(t.params.select("path", F.col("parent").alias("fn"), F.explode("names.name").alias("name")), ["path", "fn", "name"], "left_anti").select("path", "fn", "name")
    given = writes(t).select("path", "fn", "name").unionByName(in_fn(t.of("Unary").where("name = '&' AND get(children, 0).kind = 'Ident'")).select("path", "fn", E("get(children, 0).name").alias("name")))
    stores = in_fn(t.of("Index").where("role = 'left' AND get(children, 0).kind = 'Ident'")).withColumn("name", E("get(children, 0).name"))
    return report(stores.join(empty.join(given, ["path", "fn", "name"], "left_anti"), ["path", "fn", "name"], "left_semi"), "the map is nil")


@check("append-to-sized-slice")
def _(t):
    made = variables(t).where("init.bare_kind = 'Call' AND init.target = 'make' AND regexp_like(init.bare, '^make [(] \\\\[ \\\\] [^,]* , [1-9][0-9]* [)]$')").select("path", "fn", "name", E("init.start").alias("start"), E("init.stop").alias("stop"))
    appended = writes(t).withColumn("grows", E("op = '=' AND regexp_like(get(right, 0).bare, concat('^append [(] ', name, ' ,'))")).where("op <> ':='")
    per = appended.groupBy("path", "fn", "name").agg(F.max("grows").alias("some"), F.min("grows").alias("only")).where("some AND only")
    return report(made.join(per, ["path", "fn", "name"], "left_semi"), "append leaves the made elements before the new ones")


@check("unused-append-result")
def _(t):
    return report(t.of("AssignStmt").where(f"name = '=' AND size({kids('left')}) = 1 AND {kid('left')}.name = '_' AND {kid('right')}.target = 'append' AND {kid('right')}.kind = 'Call'"), "the result of append is not used", f"{kid('right')}.start", f"{kid('right')}.stop")


@check("never-nil-comparison")
def _(t):
    fresh = variables(t).groupBy("path", "fn", "name").agg(F.min(E("coalesce(init.bare_kind = 'Unary' AND startswith(init.bare, '& ') OR init.bare_kind = 'Call' AND init.target IN ('new', 'make'), false)")).alias("fresh")).where("fresh")
    later = writes(t).where("op <> ':='").select("path", "fn", "name")
    rows = in_fn(t.of("Binary").where("role = 'cond' AND name IN ('==', '!=') AND get(children, 1).bare = 'nil' AND get(children, 0).bare_kind = 'Ident'")).drop("name").withColumn("name", E("get(children, 0).bare"))
    return report(rows.join(fresh.join(later, ["path", "fn", "name"], "left_anti"), ["path", "fn", "name"], "left_semi"), "the value is never nil")


@check("argument-overwritten-before-use")
def _(t):
    params = t.params.where("role = 'param'").select("path", F.col("parent").alias("fn"), F.explode("names").alias("p")).select("path", "fn", F.col("p.name").alias("name"), F.col("p.start").alias("p_start"), F.col("p.stop").alias("p_stop"))
    uses = in_fn(t.of("Ident").where("role NOT IN ('name', 'sel', 'key')")).groupBy("path", "fn", "name").agg(F.min("start").alias("start"))
    plain = writes(t).where("op = '='").withColumn("again", E("exists(right, r -> regexp_like(concat(' ', r.spelling, ' '), concat('[^.A-Za-z0-9_] ?', name, ' ')))")).where("NOT again")
    plain = plain.where("NOT exists(slice(ancestors, 2, size(ancestors)), a -> a.kind IN ('IfStmt', 'ForStmt', 'SwitchStmt', 'TypeSwitchStmt', 'SelectStmt', 'FunctionLit'))")
    return report(params.join(uses, ["path", "fn", "name"]).join(plain.select("path", "fn", "name", "start"), ["path", "fn", "name", "start"], "left_semi"), "the argument is overwritten before it is used", "p_start", "p_stop")


@check("unchanged-loop-condition")
def _(t):
    loops = t.of("ForStmt").withColumn("cond", E(kid("cond"))).where(f"{kid('init')} IS NOT NULL AND {kid('post')} IS NOT NULL AND cond.kind = 'Binary'").select("path", F.col("id").alias("loop"), F.col("cond.id").alias("id"))
    tests = t.of("Binary").where("get(children, 0).kind = 'Ident' AND name IN ('<', '>', '<=', '>=', '!=')").withColumn("var", E("get(children, 0).name")).join(loops, ["path", "id"])
    inside = writes(t).withColumn("loop", F.explode(E("transform(filter(ancestors, (a, i) -> a.kind = 'ForStmt' AND coalesce(get(ancestors, i + 1).role, '') <> 'init'), a -> a.id)"))).select("path", "loop", F.col("name").alias("var"))
    shared = t.of("Unary").where("name = '&' AND get(children, 0).kind = 'Ident'").withColumn("loop", F.explode(E("transform(filter(ancestors, a -> a.kind = 'ForStmt'), a -> a.id)"))).select("path", "loop", E("get(children, 0).name").alias("var"))
    other = t.of("Binary").select("path", "id", E("get(children, 1).bare").alias("bound"))
    rows = tests.join(other, ["path", "id"]).join(inside.unionByName(shared), ["path", "loop", "var"], "left_anti")
    return report(rows.join(inside.withColumnRenamed("var", "bound"), ["path", "loop", "bound"], "left_anti"), "the loop never changes its condition")


# --- control flow


@check("infinite-recursion")
def _(t):
    bodies = t.blocks.where("kind = 'Block' AND role = 'body'").select("path", F.col("parent").alias("fn"), "stmts")
    # Statements that are always reached: those up to the first that may branch or return.
    plain = "s.kind IN ('ExprStmt', 'AssignStmt', 'DeclStmt', 'IncDecStmt', 'DeferStmt')"
    always = bodies.withColumn("n", E(f"coalesce(nullif(array_position(transform(stmts, s -> NOT {plain}), true), 0), size(stmts))"))
    always = always.select("path", "fn", F.explode(E("filter(slice(stmts, 1, CAST(n AS INT)), s -> s.kind IN ('ExprStmt', 'AssignStmt', 'ReturnStmt'))")).alias("s")).select("path", "fn", F.col("s.id").alias("stmt"))
    names = t.of("FunctionDecl").select("path", F.col("id").alias("fn"), F.col("name").alias("callee"))
    calls = in_fn(t.calls.where(f"{kid('fun')}.kind = 'Ident' AND NOT exists(ancestors, a -> a.kind IN ('FunctionLit', 'GoStmt', 'DeferStmt'))")).withColumn("stmt", F.explode(E("transform(ancestors, a -> a.id)")))
    calls = calls.where("NOT exists(ancestors, a -> a.kind = 'Binary')")
    return report(calls.join(names, ["path", "fn", "callee"], "left_semi").join(always, ["path", "fn", "stmt"], "left_semi").dropDuplicates(["path", "id"]), "the function never stops calling itself")


@check("single-iteration-loop")
def _(t):
    bodies = t.blocks.where("kind = 'Block' AND role = 'body' AND try_element_at(stmts, -1).kind IN ('ReturnStmt', 'BreakStmt') AND size(stmts) > 1").select("path", F.col("parent").alias("id"), E("try_element_at(stmts, -1)").alias("exit"))
    branching = t.blocks.where("kind = 'Block' AND role = 'body' AND exists(stmts, s -> s.kind IN ('IfStmt', 'SwitchStmt', 'TypeSwitchStmt'))").select("path", F.col("parent").alias("id"))
    escapes = t.of("ContinueStmt", "GotoStmt", "LabeledStmt").withColumn("id", F.explode(E("transform(filter(ancestors, a -> a.kind = 'ForStmt'), a -> a.id)"))).select("path", "id")
    maps = in_fn(t.of("ForStmt").where(f"{kid('range')} IS NOT NULL")).select("path", "fn", "id", E(f"regexp_extract({kid('range')}.spelling, 'range ([A-Za-z_][A-Za-z0-9_]*)$', 1)").alias("name"))
    unordered = maps.join(variables(t).where("startswith(vtype, 'map[') OR startswith(vtype, 'chan') OR vtype IS NULL AND regexp_like(init.bare, '^(map|make [(] (map|chan))')").select("path", "fn", "name"), ["path", "fn", "name"], "left_semi").select("path", "id")
    loops = t.of("ForStmt").select("path", "id").join(bodies, ["path", "id"]).join(branching, ["path", "id"], "left_semi")
    return report(loops.join(escapes, ["path", "id"], "left_anti").join(unordered, ["path", "id"], "left_anti"), "the loop ends in its first turn", "exit.start", "exit.stop")


@check("context-cancel-in-loop")
def _(t):
    loop = "try_element_at(filter(slice(ancestors, cast(greatest(1, array_position(transform(ancestors, a -> a.kind = 'FunctionLit'), true)) AS INT), size(ancestors)), a -> a.kind = 'ForStmt'), -1).id"
    made = t.of("AssignStmt").where(f"size({kids('left')}) = 2 AND size({kids('right')}) = 1 AND {kid('right')}.target IN ('context.WithCancel', 'context.WithTimeout', 'context.WithDeadline')")
    made = made.withColumn("loop", E(loop)).where("loop IS NOT NULL").select("path", "loop", E(f"get({kids('left')}, 1).name").alias("callee"), E(f"{kid('right')}.start").alias("start"), E(f"{kid('right')}.stop").alias("stop"))
    called = t.calls.where("try_element_at(ancestors, -1).kind = 'ExprStmt'").withColumn("loop", F.explode(E("transform(filter(ancestors, a -> a.kind = 'ForStmt'), a -> a.id)"))).select("path", "loop", "callee")
    return report(made.join(called, ["path", "loop", "callee"], "left_anti"), "the context is not cancelled in its turn")
