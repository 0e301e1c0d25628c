"""Approximations of type-based checks that look at calls, operators and constants of one place.

Packages are told by the file's imports, constants by literals and the file's named constants (see
``constants``); types of variables are not known here.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import E, Tables, kid, kids, report
from .semantic import CHECKS, check

#: Default severities of these checks.
SEVERITY = {
    "error": "invalid-listen-address invalid-regexp invalid-url invalid-utf8 nan-comparison nil-context odd-paired-arguments swapped-errors-is-arguments",
    "warning": "address-nil-comparison byte-string-write case-insensitive-string-comparison context-key-type context-stored-in-struct discarded-pure-result duration-multiplied-by-duration "
    "dynamic-printf identical-binary-operands ineffective-bitwise-zero interface-method-limit non-canonical-header overlapping-encode-buffers oversized-fixed-width-shift regexp-find-all-zero "
    "regexp-match-in-loop self-assignment slog-argument-shape sort-conversion-without-sort unsafe-formatted-url-host-port url-query-copy-mutation",
}

#: Names of the standard library that the checks are about.
PURE = {
    "errors": "New",
    "fmt": "Sprint Sprintf Sprintln",
    "sort": "Reverse",
    "strings": "Map Repeat Replace Title ToLower ToTitle ToUpper Trim TrimFunc TrimLeft TrimLeftFunc TrimPrefix TrimRight TrimRightFunc TrimSpace TrimSuffix",
}
FORMATS_AT = {"fmt.Printf": 0, "fmt.Sprintf": 0, "fmt.Errorf": 0, "fmt.Fprintf": 1, "log.Printf": 0, "log.Fatalf": 0, "log.Panicf": 0}
CUTSETS = "Trim TrimLeft TrimRight IndexAny LastIndexAny ContainsAny"
WIDTHS = {"int8": 8, "uint8": 8, "byte": 8, "int16": 16, "uint16": 16, "int32": 32, "uint32": 32, "rune": 32, "int64": 64, "uint64": 64}
CONTEXT_FIRST = "context.WithCancel context.WithTimeout context.WithDeadline context.WithValue os/exec.CommandContext net/http.NewRequestWithContext"
TIME_UNITS = "Nanosecond Microsecond Millisecond Second Minute Hour"

def _in(names: str | list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in (names.split() if isinstance(names, str) else names)) + ")"


def _text_of(arg: str) -> str:
    """The content of a constant string, null for anything else."""
    return f"IF(startswith({arg}.constant, '\"'), substring({arg}.constant, 2), NULL)"


def _call(code: str, where: str, message: str, start: str = "start", stop: str = "stop") -> None:
    CHECKS[code] = lambda t: report(t.calls.where(where), message, start, stop)


def _binary(code: str, where: str, message: str) -> None:
    CHECKS[code] = lambda t: report(t.of("Binary").where(where), message)


_A, _B = "get(children, 0)", "get(children, 1)"


# --- operators

_binary("address-nil-comparison", f"name IN ('==', '!=') AND ({_A}.bare = 'nil' AND {_B}.bare_kind = 'Unary' AND regexp_like({_B}.bare, '^& [^*]') OR {_B}.bare = 'nil' AND {_A}.bare_kind = 'Unary' AND regexp_like({_A}.bare, '^& [^*]'))", "an address is never nil")
_binary(
    "case-insensitive-string-comparison",
    f"name IN ('==', '!=') AND {_A}.kind = 'Call' AND {_B}.kind = 'Call' AND {_A}.target = {_B}.target AND {_A}.target IN ('strings.ToLower', 'strings.ToUpper')",
    "compare with strings.EqualFold",
)
_binary(
    "identical-binary-operands",
    f"name IN ('==', '!=', '-', '/', '&', '%', '|', '^', '&^', '&&', '||', '<', '>', '<=', '>=') AND {_A}.spelling = {_B}.spelling AND {_A}.bare_kind NOT IN ('BasicLit', 'CompositeLit') "
    f"AND NOT (name IN ('==', '!=') AND regexp_like({_A}.spelling, '(?i)float|nan')) AND NOT startswith({_A}.target, 'math/rand')",
    "the same expression stands on both sides",
)
_binary("ineffective-bitwise-zero", f"name IN ('&', '|', '^') AND {_B}.constant = '0' AND {_B}.bare_kind IN ('BasicLit', 'Ident')", "operation with 0 has no use")
_binary("nan-comparison", f"name IN ('==', '!=', '<', '>', '<=', '>=') AND exists(children, c -> c.bare_kind = 'Call' AND c.target = 'math.NaN')", "compare with math.IsNaN")
_binary(
    "duration-multiplied-by-duration",
    "name = '*' AND size(children) = 2 AND forall(children, c -> regexp_like(c.spelling, '(^|[(] |[*] )time [.] (" + TIME_UNITS.replace(" ", "|") + ")($| [)]| [*])')) "
    "AND NOT (try_element_at(ancestors, -1).kind = 'Binary')",
    "a duration is multiplied by a duration",
)
_binary(
    "oversized-fixed-width-shift",
    f"name IN ('<<', '>>') AND {_A}.bare_kind = 'Call' AND {_A}.target IN {_in([*WIDTHS])} AND TRY_CAST({_B}.constant AS DECIMAL(38,0)) >= CASE {_A}.target " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WIDTHS.items()) + " END",
    "the shift drops all bits",
)


# --- calls

_call("byte-string-write", "target = 'io.WriteString' AND size(args) = 2 AND get(args, 1).bare_kind = 'Call' AND get(args, 1).target = 'string'", "write the bytes")
_call(
    "context-key-type",
    "target = 'context.WithValue' AND size(args) = 3 AND (get(args, 1).constant IS NOT NULL OR get(args, 1).bare = 'nil' OR get(args, 1).bare = 'struct { } { }' OR get(args, 1).bare_kind = 'Call' AND get(args, 1).target IN ('string', 'int', 'byte', 'rune'))",
    "context key needs a type of its own", "get(args, 1).start", "get(args, 1).stop",
)
_call("dynamic-printf", " OR ".join(f"target = '{k}' AND size(args) = {i + 1} AND name = '' AND get(args, {i}).kind IN ('Call', 'Ident') AND get(args, {i}).constant IS NULL" for k, i in FORMATS_AT.items()), "format is not constant")
_call("nil-context", f"target IN {_in(CONTEXT_FIRST)} AND get(args, 0).bare = 'nil'", "nil is no context", "get(args, 0).start", "get(args, 0).stop")
_call("odd-paired-arguments", "target = 'strings.NewReplacer' AND name = '' AND size(args) % 2 = 1", "arguments come in pairs")
_call("regexp-find-all-zero", "regexp_like(target, '[.]FindAll(String)?(Submatch)?(Index)?$') AND size(args) = 2 AND try_element_at(args, -1).constant = '0'", "0 matches are asked for")
_call(
    "regexp-match-in-loop",
    "target IN ('regexp.Match', 'regexp.MatchReader', 'regexp.MatchString') AND get(args, 0).constant IS NOT NULL "
    "AND exists(slice(ancestors, cast(greatest(1, array_position(transform(ancestors, a -> a.kind = 'FunctionLit'), true)) AS INT), size(ancestors)), a -> a.kind = 'ForStmt')",
    "pattern is compiled in every turn",
)
_call(
    "swapped-errors-is-arguments",
    "target = 'errors.Is' AND size(args) = 2 AND get(args, 0).kind = 'Selector' AND regexp_like(get(args, 0).target, '[.](EOF|Err[A-Z][A-Za-z]*)$|^context[.](Canceled|DeadlineExceeded)$') AND get(args, 1).kind = 'Ident'",
    "errors.Is takes the error first", "get(args, 0).start", "get(args, 0).stop",
)
_call(
    "overlapping-encode-buffers",
    "(target IN ('encoding/ascii85.Encode', 'encoding/hex.Encode') OR regexp_like(target, '^encoding/base(32|64)[.][A-Za-z]+Encoding[.]Encode$')) AND size(args) = 2 "
    "AND get(args, 0).bare <> 'nil' AND regexp_replace(get(args, 0).bare, ' \\\\[ : .*$| \\\\[ 0 : .*$', '') = regexp_replace(get(args, 1).bare, ' \\\\[ : .*$| \\\\[ 0 : .*$', '')",
    "encoding writes over its source", "get(args, 0).start", "get(args, 0).stop",
)
_call("sort-conversion-without-sort", "false", "")
_call(
    "url-query-copy-mutation",
    f"regexp_like({kid('fun')}.spelling, ' [.] (Add|Del|Set)$') AND regexp_like({kid('fun')}.spelling, '[A-Za-z0-9_)] [.] Query [(] [)] [.] (Add|Del|Set)$')",
    "a copy of the query is changed",
)
_call("discarded-pure-result", f"role = 'x' AND try_element_at(ancestors, -1).kind = 'ExprStmt' AND target IN {_in([f'{p}.{n}' for p, names in PURE.items() for n in names.split()])}", "the result is what the call is for")
_FORMAT = _text_of("get(args, 0)")
_ADDRESS_AT = {"net.Dial": 1, "net.DialTimeout": 1, "net.Listen": 1, "net.ListenPacket": 1, "net.ResolveTCPAddr": 1, "net.ResolveUDPAddr": 1, "net/http.ListenAndServe": 0, "net/http.ListenAndServeTLS": 0, "crypto/tls.Dial": 1}


@check("unsafe-formatted-url-host-port")
def _(t: Tables) -> DataFrame:
    formats = t.calls.where("target = 'fmt.Sprintf' AND size(args) >= 3").withColumn("format", E(_FORMAT))
    as_url = formats.where("regexp_like(format, '://[^/?#]*%[sv]:')").select("path", E("get(args, 0).start").alias("start"), E("get(args, 0).stop").alias("stop"))
    at = "CASE target " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _ADDRESS_AT.items()) + " END"
    users = t.calls.where(f"target IN {_in([*_ADDRESS_AT])}").select("path", E(f"get(args, {at}).id").alias("id"))
    bare = formats.where("format IN ('%s:%d', '%s:%s', '%v:%d', '%v:%s')").join(users, ["path", "id"], "left_semi").select("path", E("get(args, 0).start").alias("start"), E("get(args, 0).stop").alias("stop"))
    return report(as_url.unionByName(bare), "join host and port with net.JoinHostPort")


@check("sort-conversion-without-sort")
def _(t):
    rows = t.of("AssignStmt").where(f"name = '=' AND size({kids('left')}) = 1 AND {kid('right')}.kind = 'Call' AND {kid('right')}.target IN ('sort.IntSlice', 'sort.StringSlice', 'sort.Float64Slice')")
    return report(rows.where(f"regexp_extract({kid('right')}.spelling, '[(] (.*) [)]$', 1) = {kid('left')}.spelling"), "the conversion does not sort")


@check("self-assignment")
def _(t):
    # No side effects: no receive, no call but of built-ins that have none.
    calm = "NOT contains(l.spelling, '<-') AND NOT regexp_like(regexp_replace(l.spelling, '(^|[^.] )(len|cap|min|max) [(]', '['), r'[A-Za-z0-9_)\\]] [(]')"
    same = f"exists(transform({kids('left')}, (l, i) -> l.spelling = get({kids('right')}, i).spelling AND l.spelling <> '_' AND {calm}), x -> x)"
    return report(t.of("AssignStmt").where(f"name = '=' AND size({kids('left')}) = size({kids('right')}) AND {same}"), "value is assigned to itself")


@check("non-canonical-header")
def _(t):
    key = E("IF(startswith(get(children, 1).constant, '\"'), substring(get(children, 1).constant, 2), NULL)")
    rows = t.of("Index").where("role <> 'left' AND regexp_like(get(children, 0).spelling, '(^|[.] )Header( [(] [)])?$')").withColumn("key", key)
    canonical = F.array_join(F.transform(F.split("key", "-", -1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), "-")
    return report(rows.where(F.col("key").rlike("^[!#$%&'*+.^_`|~0-9A-Za-z-]+$") & (F.col("key") != canonical)), "header key is not canonical")


@check("slog-argument-shape")
def _(t):
    at = "CASE WHEN target IN ('log/slog.Debug', 'log/slog.Info', 'log/slog.Warn', 'log/slog.Error', 'log/slog.Group') THEN 1 WHEN target IN ('log/slog.DebugContext', 'log/slog.InfoContext', 'log/slog.WarnContext', 'log/slog.ErrorContext') THEN 2 WHEN target = 'log/slog.Log' THEN 3 END"
    rows = t.calls.where("startswith(target, 'log/slog.') AND name = ''").withColumn("at", E(at)).where("size(args) > at").withColumn("tail", E("slice(args, at + 1, size(args))"))
    rows = rows.withColumn("attrs", E("size(filter(tail, a -> a.bare_kind = 'Call' AND startswith(a.target, 'log/slog.')))")).where("attrs < size(tail)")
    keys = "filter(tail, (a, i) -> i % 2 = 0 AND (a.bare_kind IN ('CompositeLit', 'FunctionLit') OR a.constant IS NOT NULL AND NOT startswith(a.constant, '\"')))"
    bad = E(f"CASE WHEN attrs > 0 THEN struct(start, stop) WHEN size(tail) % 2 = 1 THEN struct(try_element_at(tail, -1).start, try_element_at(tail, -1).stop) WHEN size({keys}) > 0 THEN struct(get({keys}, 0).start, get({keys}, 0).stop) END")
    rows = rows.withColumn("bad", bad).where("bad IS NOT NULL")
    return report(rows.select("path", E("bad.start").alias("start"), E("bad.stop").alias("stop")), "arguments are not pairs of key and value")


# --- declarations


@check("context-stored-in-struct")
def _(t):
    return report(t.of("Field").where(f"role = 'field' AND try_element_at(ancestors, -1).kind = 'StructType' AND {kid('type')}.target = 'context.Context'"), "context is stored in a struct")


@check("interface-method-limit")
def _(t):
    rows = t.of("InterfaceType").where(f"size({kids('method')}) > {t.options['max-methods']}")
    return report(rows, "interface has too many methods")


# --- constants that are texts of small languages

_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
_GROUP = re.compile(r"\(\?(P?<([A-Za-z_][A-Za-z0-9_]*)>|[imsU]*(-[imsU]+)?[:)])")
_MOST_REPEATS = 1000


def _class_end(p: str, at: int) -> int | None:
    """Where the bracket class that begins at ``at`` ends, None if it is not well formed."""
    at += 1
    if p[at : at + 1] == "^":
        at += 1
    first, low = True, None
    while at < len(p):
        if p[at] == "]" and not first:
            return at + 1
        first = False
        if m := re.match(r"\[:\^?([a-z]+):\]", p[at:]):
            if m[1] not in "alnum alpha ascii blank cntrl digit graph lower print punct space upper word xdigit".split():
                return None
            at, low = at + len(m[0]), None
            continue
        if p[at] == "\\":
            m = re.match(r"\\(x\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|[pP](\{\^?[A-Za-z_]+\}|[A-Z])|[0-7]{1,3}|[dDsSwWafnrtv]|[^\w\s]|_)", p[at:])
            if not m:
                return None
            one, size = (None, len(m[0])) if m[1][0] in "pPdDsSwW" else (m[1] if len(m[1]) > 1 else {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "f": "\f", "v": "\v"}.get(m[1], m[1]), len(m[0]))
        else:
            one, size = p[at], 1
        if p[at + size : at + size + 1] == "-" and p[at + size + 1 : at + size + 2] not in ("]", "") and one is not None:
            high = p[at + size + 1]
            if len(one) == 1 and high not in "\\[" and high < one:
                return None
        at += size
    return None


def valid_pattern(p: str) -> bool:
    """Whether a regular expression is one of the linear-time dialect: no look-around, no back references."""
    at, depth, names = 0, 0, set()
    operand = repeated = False
    while at < len(p):
        c = p[at]
        if c == "(":
            if p[at + 1 : at + 2] == "?":
                m = _GROUP.match(p, at)
                if not m or m[2] in names or m[0] == "(?)" or m[0].endswith("-)") or m[0].endswith("-:"):
                    return False
                if m[2]:
                    names.add(m[2])
                if not m[0].endswith(")"):
                    depth += 1
                    operand = False
                at += len(m[0])
            else:
                depth, at, operand = depth + 1, at + 1, False
            repeated = False
            continue
        if c == ")":
            depth -= 1
            if depth < 0:
                return False
            operand, repeated = True, False
        elif c == "|":
            operand = repeated = False
        elif c == "[":
            end = _class_end(p, at)
            if end is None:
                return False
            at, operand, repeated = end, True, False
            continue
        elif c in "*+?" or c == "{" and (m := _REPEAT.match(p, at)):
            size = 1
            if c == "{":
                low, high = int(m[1]), int(m[3]) if m[3] else int(m[1])
                if low > _MOST_REPEATS or high > _MOST_REPEATS or high < low:
                    return False
                size = len(m[0])
            if not operand or repeated:
                return False
            at += size
            if p[at : at + 1] == "?":
                at += 1
            repeated = True
            continue
        elif c == "\\":
            m = re.match(r"\\(x\{([0-9A-Fa-f]+)\}|x[0-9A-Fa-f]{2}|[pP](\{\^?[A-Za-z_]+\}|[A-Z])|[AabBdDfnrsStvwWzC]|0[0-7]{0,2}|[1-7][0-7]{1,2}|[^\w\s]|_|Q)", p[at:], re.S)
            if not m or m[2] and int(m[2], 16) > 0x10FFFF:
                return False
            if m[1] == "Q":
                end = p.find("\\E", at)
                at = len(p) if end < 0 else end + 2
            else:
                at += len(m[0])
            operand, repeated = True, False
            continue
        else:
            operand, repeated = True, False
        at += 1
    return depth == 0


def valid_url(u: str) -> bool:
    """Whether a text parses as a URL reference."""
    if re.search(r"[\x00-\x1f\x7f]", u):
        return False
    rest, _, fragment = u.partition("#")
    if re.search(r"%(?![0-9A-Fa-f]{2})", fragment):
        return False
    if rest == "*":
        return True
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", rest)
    if not scheme and rest.startswith(":"):
        return False
    after = rest[len(scheme[0]) :] if scheme else rest
    after = after.partition("?")[0]
    if not after.startswith("/"):
        if scheme:
            return True  # opaque
        if ":" in after.partition("/")[0]:
            return False
    if after.startswith("//") and (scheme or not after.startswith("///")):
        authority, _, path = after[2:].partition("/")
        user, at, host = authority.rpartition("@")
        if at and re.search(r"[^A-Za-z0-9._:~!$&'()*+,;=%@-]", user):
            return False
        if host.startswith("["):
            close = host.rfind("]")
            if close < 0 or not re.fullmatch(r"(:[0-9]*)?", host[close + 1 :]):
                return False
        elif ":" in host and not re.fullmatch(r"[0-9]*", host.rpartition(":")[2]):
            return False
        if re.search(r"[ <>\"^`{|}\\]", host) or re.search(r"%(?![0-9A-Fa-f]{2})", host):
            return False
    else:
        path = after
    if re.search(r"%(?![0-9A-Fa-f]{2})", path):
        return False
    unquote_to_bytes(path)
    return True


def _judged(test: Callable[[str], bool]) -> Callable[[Column], Column]:
    """A column function that judges each different text of a batch once."""

    @F.pandas_udf("boolean")
    def judge(values: pd.Series) -> pd.Series:
        return values.map({v: test(v) for v in values.dropna().unique()}).astype("boolean")

    return judge


def _argument(t: Tables, where: str, at: int, test: Callable[[str], bool], message: str) -> DataFrame:
    rows = t.calls.where(where).select("path", E(f"get(args, {at}).start").alias("start"), E(f"get(args, {at}).stop").alias("stop"), E(_text_of(f"get(args, {at})")).alias("value"))
    return report(rows.where("value IS NOT NULL").where(~_judged(test)(F.col("value"))), message)


@check("invalid-regexp")
def _(t):
    return _argument(t, "target IN ('regexp.Compile', 'regexp.MustCompile', 'regexp.Match', 'regexp.MatchReader', 'regexp.MatchString')", 0, valid_pattern, "regular expression is not valid")


@check("invalid-url")
def _(t):
    return _argument(t, "target = 'net/url.Parse'", 0, valid_url, "URL does not parse")


def valid_listen_address(address: str) -> bool:
    """Whether a text is a host and port as servers listen on them, either empty."""
    if not address:
        return True
    m = re.fullmatch(r"(\[[^\[\]]*\]|[^:\[\]]*):([^:\[\]]*)", address)
    if not m:
        return False
    port = m[2]
    if re.fullmatch(r"[0-9]+", port):
        return int(port) <= 65535
    return not port or bool(re.fullmatch(r"(?=.{1,15}$)(?=.*[A-Za-z])[A-Za-z0-9]+(-[A-Za-z0-9]+)*", port))


@check("invalid-listen-address")
def _(t):
    return _argument(t, "target IN ('net/http.ListenAndServe', 'net/http.ListenAndServeTLS')", 0, valid_listen_address, "listen address is not host:port")


@check("invalid-utf8")
def _(t):
    rows = t.calls.where(f"target IN {_in([f'strings.{n}' for n in CUTSETS.split()])} AND size(args) = 2 AND startswith(get(args, 1).constant, '\\\\')")
    return report(rows, "set of characters is not UTF-8", "get(args, 1).start", "get(args, 1).stop")
