"""Line and literal checks over text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import severity_name, severity_rank

LINE_LIMIT = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as lines, numbered from 1."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def file_length_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.split("text", "\n", -1))
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", n.alias("n_lines")).where(F.col("n_lines") > LINE_LIMIT)


def repeated_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "line").orderBy("line_no")
    return lines(spark, sf_dir).where(F.length("line") > 0).withColumn("nth", F.row_number().over(w)).where("nth = 3").select("doc_id", "line_no", "line")


def text_check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the two checks, counted by code with their highest severity."""
    found = file_length_limit(spark, sf_dir).select(F.lit("file-length-limit").alias("code"), F.lit("note").alias("severity"))
    found = found.unionByName(repeated_literal(spark, sf_dir).select(F.lit("repeated-literal").alias("code"), F.lit("warning").alias("severity")))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("findings"), F.max(severity_rank(F.col("severity"))).alias("rank")).select("code", "findings", severity_name(F.col("rank")).alias("severity")).orderBy(F.desc("findings"), "code")


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL"
_LENGTH = f"SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines FROM documents WHERE len(string_split(text, chr(10))) > {LINE_LIMIT}"
_REPEATED = f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS nth FROM ({_LINES}) WHERE length(line) > 0) WHERE nth = 3"

QUERIES = {
    "file_length_limit": file_length_limit,
    "repeated_literal": repeated_literal,
    "text_check_summary": text_check_summary,
}
ORACLE = {
    "file_length_limit": _LENGTH,
    "repeated_literal": _REPEATED,
    "text_check_summary": f"SELECT code, count(*) AS findings, max_by(severity, CASE severity WHEN 'note' THEN 1 WHEN 'warning' THEN 2 WHEN 'error' THEN 3 ELSE 0 END) AS severity FROM (SELECT 'file-length-limit' AS code, 'note' AS severity FROM ({_LENGTH}) UNION ALL SELECT 'repeated-literal', 'warning' FROM ({_REPEATED})) GROUP BY code",
}
