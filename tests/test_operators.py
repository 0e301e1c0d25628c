import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findra.operators import edits, findings, paths
from findra.operators.diff import edit_script, hunks, unified
from findra.streaming.watch import generation_changes, watch


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_edit_script_rebuilds_both_sides(a, b):
    script = edit_script(a, b)
    assert [s for m, s in script if m != "+"] == a
    assert [s for m, s in script if m != "-"] == b
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
    assert sum(m != " " for m, _ in script) == len(a) + len(b) - 2 * longest[-1][-1]


def test_unified_merges_close_hunks():
    before = "\n".join(map(str, range(30)))
    after = before.replace("\n5\n", "\nfive\n").replace("\n9\n", "\nnine\n").replace("\n25\n", "\n25\nmore\n")
    assert unified(before, before) == ""
    text = unified(before, after, "f")
    assert text.count("@@ -") == 2
    assert "@@ -3,11 +3,11 @@" in text
    assert len(hunks(edit_script(before.split("\n"), after.split("\n")))) == 2


@pytest.mark.parametrize(
    ("path", "pattern", "hit"),
    [
        ("a/b.go", "a", True), ("ab/c.go", "a", False), ("a/b.go", "a/b.go", True), ("x/y/z_test.go", "**/*_test.go", True), ("z_test.go", "**/*_test.go", True),
        ("x/y.go", "*.go", False), ("y.go", "*.go", True), ("x/y.go", "x/?.go", True), ("x/y.go", "x/[a-x].go", False), ("x/y.go", "x/[!a-x].go", True),
    ],
)
def test_exclusion(spark, path, pattern, hit):
    assert spark.createDataFrame([(path,)], "p string").select(paths.excluded(F.col("p"), [pattern])).first()[0] is hit


def test_malformed_globs_are_named_in_order():
    with pytest.raises(ValueError, match=r"a\[, b\["):
        paths.check_globs(["b[", "fine*", "a["])


def test_baseline_is_a_bag(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i) for i in range(60)]
    base = [(rng.choice("abc"),) for _ in range(25)]
    found = findings.baseline_apply(spark.createDataFrame(rows, "k string, i int"), spark.createDataFrame(base, "k string"), ["k"], ["i"]).collect()
    left = {k: sum(1 for b in base if b[0] == k) for k in "abc"}
    want = []
    for k, i in rows:
        if left[k]:
            left[k] -= 1
        else:
            want.append((k, i))
    assert sorted(map(tuple, found)) == sorted(want)
    stale = findings.baseline_stale(spark.createDataFrame(rows, "k string, i int"), spark.createDataFrame(base, "k string"), ["k"]).collect()
    assert {r["k"]: r["stale"] for r in stale} == {k: n for k, n in left.items() if n}


def test_suppression_needs_range_and_code(spark):
    pos = "struct<Filename: string, Offset: int, Line: int, Column: int>"
    def finding(f, c, lo, hi):
        return (f, c, (f, lo, 1, 1), (f, hi, 1, 1))
    rows = spark.createDataFrame([finding("f", "x", 5, 6), finding("f", "y", 5, 6), finding("f", "x", 50, 60), finding("g", "z", 1, 2)], f"file string, code string, start {pos}, end {pos}")
    off = spark.createDataFrame([("f", "x", 0, 10), ("g", "all", 0, 99)], "path string, code string, `from` int, `to` int")
    assert sorted((r["file"], r["code"], r["start"]["Offset"]) for r in findings.suppress(rows, off).collect()) == [("f", "x", 50), ("f", "y", 5)]


def test_edits_apply_from_the_back(spark):
    made = F.expr("array(named_struct('start', 1, 'end', 2, 'new_text', 'XX'), named_struct('start', 3, 'end', 3, 'new_text', '-'))")
    assert spark.createDataFrame([("abcd",)], "t string").select(edits.applied(F.col("t"), made)).first()[0] == "aXXc-d"


def test_conflicts_and_equal_edits(spark):
    rows = [("f", 1, 0, 5, "a"), ("f", 2, 4, 6, "b"), ("f", 3, 6, 9, "c"), ("f", 4, 20, 22, "d"), ("f", 5, 20, 22, "d")]
    df = spark.createDataFrame(rows, "file string, id int, lo int, hi int, new_text string")
    assert sorted(r["lo"] for r in edits.without_conflicts(df).collect()) == [6, 20]


def test_generations(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, t string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "k string, t string")
    assert sorted(map(tuple, generation_changes(old, new, "k", "t").collect())) == [("b", "changed"), ("c", "removed"), ("d", "added")]


def test_watch_emits_changed_results_only(spark, tmp_path):
    source = tmp_path / "in"
    for n, key in enumerate("aab"):
        spark.createDataFrame([(key, n)], "k string, v int").coalesce(1).write.parquet(str(source / f"g{n}"))
    stream = spark.readStream.schema("k string, v int").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(str(source))
    seen = []
    q = watch(stream, lambda df: df.select("k").distinct(), lambda df, n: seen.append(sorted(r["k"] for r in df.collect())), availableNow=True)
    q.awaitTermination(60)
    assert seen == [["a"], ["b"]]
