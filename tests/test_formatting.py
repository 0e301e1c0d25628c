import io
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from findra.__main__ import main
from findra.golang import checks, fixture, formatting
from findra.golang.lexer import Source, SourceError
from findra.golang.parser import parse

DRIFTED = b"""package p\r
\r
\r
import (
  "b"
\t"a" // first

\tz "c"
)

func f( a int ,b int ) {

switch a {
case 1:
x := call(
a,
b )
_ = x +
y
}
loop:
for {
go func() { run(func() {
raw := `  kept
   as it is`
}) }()
break loop
}
return   

}"""
SETTLED = b"""package p

import (
\t"a" // first
\t"b"

\tz "c"
)

func f(a int, b int) {
\tswitch a {
\tcase 1:
\t\tx := call(
\t\t\ta,
\t\t\tb)
\t\t_ = x +
\t\t\ty
\t}
loop:
\tfor {
\t\tgo func() { run(func() {
\t\t\traw := `  kept
   as it is`
\t\t}) }()
\t\tbreak loop
\t}
\treturn
}
"""


def words(data):
    return [t.text for t in Source(data).tokens if t.end > t.start]


def test_drift_is_settled_once():
    assert formatting.formatted(DRIFTED) == SETTLED
    assert formatting.formatted(SETTLED) == SETTLED
    assert formatting.formatted(b"package p") == b"package p\n"
    with pytest.raises(SourceError):
        formatting.formatted(b"package")


PIECES = ["x := 1", "f(a, b)", "if a {", "}", "for {", "case 1:", "// c", "", "  ", "/* b\n c */", "y = `r\n  r`", "g(func() {", "})", "z = a +", "b", "switch a {", "l:", "return"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_formatting_keeps_tokens_and_settles(lines):
    data = ("package p\n\nfunc f() {\n" + "\n".join(lines) + "\n}\n").encode()
    try:
        parse(data)
    except SourceError:
        return
    once = formatting.formatted(data)
    assert words(once) == words(data)
    assert formatting.formatted(once) == once


def test_the_fixture_drifts_where_it_is_marked(spark):
    got = sorted(r["path"] for r in formatting.rewritten(fixture.files(spark)).collect())
    assert got == sorted(f for f, _, code in fixture.expected() if code == "format")
    odd = spark.createDataFrame([("e.go", b""), ("n.go", None), ("x.go", b"func")], "path string, content binary")
    assert formatting.rewritten(odd).count() == 0
    whole = checks.run(spark.createDataFrame([("d.go", DRIFTED)], "path string, content binary"), ["format"]).first()
    assert (whole["start"]["Offset"], whole["end"]["Offset"], whole["severity"]) == (0, len(DRIFTED), "warning")


def test_fmt_command(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.go").write_bytes(DRIFTED)
    (tmp_path / "b.go").write_bytes(SETTLED)
    assert main(["fmt", str(tmp_path), "--check"]) == 1
    assert capsys.readouterr().out.split() == ["a.go"]
    assert main(["fmt", str(tmp_path), "--diff"]) == 1
    assert "+func f(a int, b int) {" in capsys.readouterr().out
    assert main(["fmt", str(tmp_path), "--write"]) == 0
    assert (tmp_path / "a.go").read_bytes() == SETTLED and (tmp_path / "b.go").read_bytes() == SETTLED
    assert main(["fmt", str(tmp_path), "--check"]) == 0
    capsys.readouterr()
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(DRIFTED)))
    assert main(["fmt", "--stdin"]) == 0
    assert capsys.readouterr().out == SETTLED.decode()
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(b"func")))
    assert main(["fmt", "--stdin"]) == 2
