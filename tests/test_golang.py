import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from findra.__main__ import main
from findra.golang import checks, fixture, tables
from findra.golang.lexer import Source, SourceError
from findra.golang.parser import parse
from findra.golang.semantic_calls import valid_listen_address, valid_pattern, valid_url


@pytest.fixture(scope="module")
def found(spark):
    return checks.run(fixture.files(spark)).collect()


def test_findings_equal_the_marks(found):
    assert sorted((r["file"], r["start"]["Line"], r["code"]) for r in found) == fixture.expected()


def test_every_finding_is_in_bounds(found):
    sources = {p: t.encode() for p, t in fixture.sources().items()}
    for r in found:
        assert r["message"] and r["severity"] in ("note", "warning", "error")
        assert 0 <= r["start"]["Offset"] <= r["end"]["Offset"] <= len(sources[r["file"]])
        assert r["start"]["Line"] >= 1 and r["start"]["Column"] >= 1
        before = sources[r["file"]][: r["start"]["Offset"]]
        assert r["start"]["Column"] == len(before) - (before.rfind(b"\n") + 1) + 1


def test_catalogue_counts(spark):
    rows = checks.catalogue(spark).collect()
    assert len({r["code"] for r in rows}) == len(rows) == 201
    assert sum(r["engine"] == "syntax" for r in rows) == 97


def test_limits_are_options(spark):
    files = fixture.files(spark)
    got = checks.run(files, ["file-length-limit", "function-length", "imports-blocklist"], {"max-file-lines": 60, "max-lines": 45, "blocked-imports": ["runtime"]}).collect()
    assert {r["code"] for r in got} == {"file-length-limit", "function-length", "imports-blocklist"}
    with pytest.raises(ValueError, match="invalid-template"):
        checks.run(files, ["invalid-template"])


def test_options_come_from_the_configuration():
    options = {"max-parameters": {"options": {"max-parameters": 2}}, "Imports-Blocklist": {"options": {"blocked-imports": ["os"]}}, "function-length": {"options": {"max-lines": 3}}}
    assert checks.bound_options({"checks": options}) == {"max-parameters": 2, "blocked-imports": ["os"], "max-lines": 3}
    assert checks.bound_options({}) == {}
    for code, option, value, message in (("no-init", "x", 1, "unknown option"), ("max-parameters", "max-parameters", "2", "whole number"), ("max-parameters", "max-parameters", True, "whole number"), ("max-parameters", "max-parameters", -1, "out of range"), ("imports-blocklist", "blocked-imports", [1], "list of texts")):
        with pytest.raises(ValueError, match=message):
            checks.bound_options({"checks": {code: {"options": {option: value}}}})


def spans(spark, text, codes):
    """Code and spelling of every finding, so that both its ends count."""
    data = text.encode()
    rows = checks.run(spark.createDataFrame([("p/p.go", data)], "path string, content binary"), codes).collect()
    return sorted((r["code"], data[r["start"]["Offset"] : r["end"]["Offset"]].decode()) for r in rows)


def test_literals_in_parentheses_and_other_forms(spark):
    text = "package p\n\nfunc f(a int, x bool) {\n\t_ = a % 0x1\n\t_ = a % (1)\n\t_ = a % 0b10\n\t_ = (1) / 2\n\t_ = 0x1 / 0x2\n\t_ = 1.0 / 2\n\t_ = 2 / 0\n\t_ = x == (true)\n\t_ = (false) && x\n\t_ = (true) && x\n}\n"
    got = spans(spark, text, ["modulo-one", "zero-integer-division", "boolean-literal-comparison", "constant-logical-expr"])
    assert got == [("boolean-literal-comparison", "x == (true)"), ("constant-logical-expr", "(false) && x"), ("modulo-one", "a % (1)"), ("modulo-one", "a % 0x1"), ("zero-integer-division", "(1) / 2"), ("zero-integer-division", "0x1 / 0x2")]


def test_a_long_file_is_reported_as_a_whole(spark):
    text = "package p\n" + "\n" * 600
    assert spans(spark, text, ["file-length-limit"]) == [("file-length-limit", text)]


def test_ends_of_semantic_findings(spark):
    text = """package p

import (
	"context"
	sig "os/signal"
	"regexp"
	"os"
	"net/http"
)

const bad = "a(" + "b"

func f(ctx context.Context, a, b int) {
	regexp.MustCompile(bad)
	regexp.MustCompile(`a(b)`)
	other.MustCompile(bad)
	_ = context.WithValue(ctx, "k", 1)
	_ = a-b == a-b
	c := make(chan os.Signal, 0)
	sig.Notify(c)
	_ = http.ListenAndServe("host:port:80", nil)
	if a > 1 {
		regexp := other{}
		regexp.MustCompile(bad)
	}
}
"""
    got = spans(spark, text, ["invalid-regexp", "context-key-type", "identical-binary-operands", "unbuffered-signal-channel", "invalid-listen-address"])
    # A name that the file declares itself is not taken for the package anywhere in it.
    assert got == [("context-key-type", '"k"'), ("identical-binary-operands", "a-b == a-b"), ("invalid-listen-address", '"host:port:80"'), ("unbuffered-signal-channel", "c")]
    got = spans(spark, text.replace("regexp := other{}", "other()"), ["invalid-regexp"])
    assert got == [("invalid-regexp", "bad"), ("invalid-regexp", "bad")]


@pytest.mark.parametrize("pattern", ["", "a|b", "(?i)x", "(?P<n>a)(?<m>b)", "[]a]", "[^]]", "[a-z&&\\d]", "\\Qa(\\E", "a{2,1000}", "a{,2}", "x*?", "\\p{Greek}", "\\x{10FFFF}", "^$", "a{2}b{3}", "\\A\\z\\b", "[[:^alpha:]]", "(?:a)", "(?s-i:.)"])
def test_patterns_that_compile(pattern):
    assert valid_pattern(pattern)


@pytest.mark.parametrize("pattern", ["(", ")", "[", "[z-a]", "*a", "a**", "a{1001}", "a{2,1}", "(?=a)", "(?!a)", "(?<=a)", "\\1", "\\Z", "a|*", "(*)", "[[:foo:]]", "\\", "(?P<n>a)(?P<n>b)", "(?P=n)", "\\x{110000}", "(?"])
def test_patterns_that_do_not_compile(pattern):
    assert not valid_pattern(pattern)


def test_urls_and_addresses():
    good = ["", "a", "/a:b", "http://h", "http://h:80/p?q#f", "http://[::1]:80/", "mailto:a@b", "//h/p", "?q=%zz", "http://u:p@h/", "*", "a/b:c", "http://h:/"]
    bad = [":a", "%zz", "http://h:x/", "a:b\x7f", "1:2", "http://[::1", "http://h/%2", "http://a b/", "#%2"]
    assert [u for u in good if not valid_url(u)] == [] and [u for u in bad if valid_url(u)] == []
    good, bad = ["", ":80", "h:80", "[::1]:80", ":", ":http", "h:65535", ":http-alt"], ["h", "h:65536", "a:b:80", ":-http", ":a--b", "h:80x!", "::1:80"]
    assert [a for a in good if not valid_listen_address(a)] == [] and [a for a in bad if valid_listen_address(a)] == []


def test_suppression_binds_the_next_statement(spark):
    text = b"""//findra:ignore-file no-init
// Package p is short.
package p

func init() {
	//findra:ignore modulo-one
	_ = 3 % 1
	_ = 4 % 1
	//findra:ignore all
	_ = 5 % 1
}
"""
    files = spark.createDataFrame([("p/p.go", text)], "path string, content binary")
    left = checks.suppressed(files, checks.run(files, ["modulo-one", "no-init"])).collect()
    assert [(r["code"], r["start"]["Line"]) for r in left] == [("modulo-one", 8)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["x", " ", "\n", "\r\n", "\t", "// c\n", "/* a\nb */", "'a'", '"s\\""', "`r\r\nw`", "0x1F", "1.5e3", "&^=", "<-", "é", "func", ":=", "...", "return"]), max_size=30))
def test_lexer_is_lossless(parts):
    data = " ".join(parts).encode()
    assert Source(data).rebuilt() == data


def test_semicolons_follow_line_ends():
    assert [t.text for t in Source(b"x\ny++ // c\nreturn\n)").tokens][:-1] == ["x", ";", "y", "++", ";", "return", ";", ")", ";"]


@pytest.mark.parametrize("text", [
    "package p\nvar f = func(a ...int) (x, y int) { return }\n", "package p\ntype T[K comparable, V any] struct { m map[K]V; *E; x, y int `t` }\n", "package p\nvar a = [...]int{1, 2: 3}\nvar b = []struct{ x int }{{1}, {x: 2}}\n",
    "package p\nfunc f() { for i := range 10 { _ = i }; for range c {}; if x := (T{1}); x.ok {} }\n", "package p\nfunc f() { switch x := v.(type) { case []int, map[string]int: ; case nil: }; L: for { break L } }\n",
    "package p\nfunc (t *T[K]) m(a, b int, c func(int) error) <-chan int { go func() {}(); select { case v, ok := <-c: _ = v; _ = ok; case c <- 1: default: }; return nil }\n",
    "package p\nvar x = a[1:2:3][i](b...).c.(*T) + -*p&^q<<2\nvar y = make(chan<- int, 3)\nvar z = f[int](g[K, V]{})\n", "package p\ntype I interface { ~int | ~string; M(x int) (y int); fmt.Stringer }\ntype A = []B\ntype N [n]int\n",
])
def test_parser_reads(text):
    source, root = parse(text.encode())
    assert source.rebuilt() == text.encode()
    rows = tables.node_rows("f", source, root)
    assert [r[1] for r in rows] == list(range(len(rows)))
    assert all(r[2] < r[1] for r in rows)


def test_bad_source_is_an_error(spark):
    with pytest.raises(SourceError, match="expected"):
        parse(b"package p\nfunc {\n")
    files = spark.createDataFrame([("a.go", b"package a\n"), ("b.go", b"func")], "path string, content binary")
    assert [r["path"] for r in tables.failures(files).collect()] == ["b.go"]
    assert {r["path"] for r in tables.nodes(files, strict=False).collect()} == {"a.go"}


def test_command_line(spark, tmp_path, capsys):
    for path, text in fixture.sources().items():
        full = tmp_path / path
        os.makedirs(full.parent, exist_ok=True)
        full.write_text(text)
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "v.go").write_text("package v\nvar x = 1 % 1\n")
    (tmp_path / "gen.go").write_text("// Code generated by x. DO NOT EDIT.\npackage gen\nvar x = 1 % 1\n")
    assert main(["check", str(tmp_path), "--only", "modulo-one,no-init", "--floor", "note"]) == 1
    out = capsys.readouterr().out
    assert "shapes/expressions.go:39:6: error: x % 1 is always 0 (modulo-one)" in out and "vendor" not in out and "gen.go" not in out
    base = str(tmp_path / "base.toml")
    assert main(["check", str(tmp_path), "--only", "modulo-one", "--write-baseline", base]) == 0
    assert main(["check", str(tmp_path), "--only", "modulo-one", "--baseline", base, "--format", "json", "--output", str(tmp_path / "o.json")]) == 0
    assert (tmp_path / "o.json").read_text() == "[]\n"
    assert main(["check", str(tmp_path), "--only", "no-init", "--floor", "note", "--baseline", base, "--remove-outdated"]) == 1
    assert "[[issues]]" not in open(base).read()
    capsys.readouterr()
    assert main(["--color", "always", "check", str(tmp_path), "--only", "double-negation"]) == 1
    assert "\x1b[31merror" in capsys.readouterr().out
    assert main(["check", str(tmp_path), "--only", "double-negation", "--fix"]) == 0
    assert "!!b" not in (tmp_path / "shapes" / "expressions.go").read_text()
    (tmp_path / "findra.toml").write_text('[checks.max-parameters]\nseverity = "error"\noptions = { max-parameters = 2 }\n')
    capsys.readouterr()
    assert main(["check", str(tmp_path), "--only", "max-parameters", "--summary"]) == 1
    configured = capsys.readouterr().out
    assert main(["--no-config", "check", str(tmp_path), "--only", "max-parameters", "--summary"]) == 1
    plain = capsys.readouterr().out
    assert "error    max-parameters" in configured and "warning  max-parameters" in plain and int(configured.split()[0]) > int(plain.split()[0])
    assert main(["check", str(tmp_path), "--only", "max-parameters", "--summary", "--watch", "--turns", "1"]) == 1
    capsys.readouterr()
    assert main(["explain", "max-parameters"]) == 0 and "option max-parameters (default 8)" in capsys.readouterr().out
    assert main(["check", str(tmp_path), "--list-checks"]) == 0 and "invalid-regexp" in capsys.readouterr().out
    for wrong in (["check", "--watch", "--format", "json"], ["check", "--fix", "--fix-unsafe"], ["check", "--summary", "--format", "html"], ["check", "--fix", "--watch"], ["check", "--fix", "--generate-baseline", "x"], ["check", "--watch", "--remove-outdated"], ["check", "--nothing"], ["explain", "no-such"], ["check", str(tmp_path / "none")], ["--config", "a", "--no-config", "check", str(tmp_path)], ["fmt", "--check", "--write", str(tmp_path)]):
        assert main(wrong) == 2, wrong
    assert "exclude each other" in capsys.readouterr().err
    assert main(["check", str(tmp_path), "--only", "no-package-var", "--format", "html", "--output", str(tmp_path / "o.html")]) == 1
    assert "no-package-var" in (tmp_path / "o.html").read_text()
