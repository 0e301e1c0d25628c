import pytest
from pyspark.sql import functions as F

from findra.operators import regression

OPERATIONS = "name string, operation string, findings int, digest string, duration_ms int, budget_ms int, error string"
ROWS = [
    ("a", "check", 3, "x", 10, 20, None), ("a", "format", 1, "y", 30, 20, ""), ("b", "check", 3, "z", 10, 20, None), ("b", "format", 0, None, 5, 20, None),
    ("c", "check", 0, None, 1, 20, "crashed"), ("c", "format", None, None, None, 20, None),
]


def operations(spark):
    return spark.createDataFrame(ROWS, OPERATIONS)


def test_states_of_operations(spark):
    recorded = spark.createDataFrame([("a", "check", 3, "x"), ("a", "format", 1, "y"), ("b", "check", 3, "old"), ("c", "check", 0, None), ("gone", "check", 1, "x")], "name string, operation string, findings int, digest string")
    got = {(r["name"], r["operation"]): (r["baseline"], r["performance"], r["status"]) for r in regression.classified(operations(spark), recorded).collect()}
    assert got == {
        ("a", "check"): ("same", "within", "pass"), ("a", "format"): ("same", "slower", "fail"), ("b", "check"): ("changed", "within", "fail"), ("b", "format"): ("changed", "within", "fail"),
        ("c", "check"): ("same", "error", "fail"), ("c", "format"): ("changed", "slower", "fail"),
    }


def test_errors_and_timings(spark):
    ops = operations(spark)
    assert regression.any_error(ops) and not regression.any_error(ops.where("name <> 'c'")) and not regression.any_error(ops.limit(0))
    assert regression.timing(ops, "a") == {"check": 10, "format": 30}
    for name in ("c", "none"):
        with pytest.raises(ValueError, match="no positive timings"):
            regression.timing(ops, name)


def test_counts_and_words(spark):
    rows = spark.createDataFrame([("p", "x"), ("p", "x"), ("q", "x")], "project string, code string")
    assert sorted(map(tuple, regression.by_code(rows).collect())) == [("p", "x", 2), ("q", "x", 1)]
    texts = spark.createDataFrame([("a\n\n \t\r\nb", 1), (None, 0), ("", 2)], "t string, n int")
    got = texts.select(regression.source_lines(F.col("t")), regression.plural(F.col("n"), "file")).collect()
    assert [tuple(r) for r in got] == [(2, "1 file"), (0, "0 files"), (0, "2 files")]


def test_reports_are_written_only_if_changed(spark, tmp_path):
    rows = regression.classified(operations(spark).where("duration_ms > 0"), operations(spark).select("name", "operation", "findings", "digest"))
    path = str(tmp_path / "out" / "r.json")
    assert regression.write_json(rows, path) and not regression.write_json(rows, path)
    assert regression.write_json(rows.where("name = 'a'"), path)
    lines = regression.summary_lines(rows)
    assert len(lines) == 2 + rows.count() and "| a | check | 3 | 0.01s | 0.02s | same | within |" in lines
