from findra.golang import checks, fixes

SOURCE = b"""// Package p has fixes; \xc3\xa9.
package p

func f(b bool, s []int, n int) []int {
	switch n {
	case 1:
		s = append(s)
		break
	case 2:
		_ = !!b
	}
	return append(s)
}
"""


def test_fixes_remove_their_findings(spark):
    files = spark.createDataFrame([("p/p.go", SOURCE), ("p/q.go", b"package p\n")], "path string, content binary")
    got = fixes.fixed(files).collect()
    assert [r["path"] for r in got] == ["p/p.go"]
    want = SOURCE.replace(b"append(s)", b"s").replace(b"!!b", b"b").replace(b"break", b"")
    assert bytes(got[0]["content"]) == want
    again = spark.createDataFrame([(r["path"], r["content"]) for r in got], "path string, content binary")
    assert checks.run(again, ["double-negation", "redundant-switch-break", "single-argument-append"]).count() == 0
    assert fixes.fixed(again).count() == 0


def test_drift_is_white_space_between_tokens(spark):
    clean = b"package p\n\n// two\n\nvar x = `a  \n\n\n  b`\n"
    bad = [b"package p", b"package p \n", b"package p\r\n", b"package p\n\n\nvar x = 1\n", b"package p\n\nfunc f() {\n    g()\n}\n", b"package p\n\n"]
    files = spark.createDataFrame([("clean.go", clean), *[(f"{i}.go", b) for i, b in enumerate(bad)]], "path string, content binary")
    assert sorted(r["path"] for r in fixes.format_drift(files).collect()) == [f"{i}.go" for i in range(len(bad))]
