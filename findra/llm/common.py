"""Shared pieces of the training-data operators: table access, shared storage, word and shingle hashes.

Words of the shingle operators are lower-cased over A-Z only and separated by ASCII white space
(space, tab, line feed, vertical tab, form feed, carriage return). ``bytes.lower`` and
``bytes.split`` have exactly these semantics on UTF-8, so no regular expression is needed.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in a shingle of every near-duplicate operator.
SHINGLE_WORDS = 5

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FIN1 = np.uint64(0xFF51AFD7ED558CCD)
_FIN2 = np.uint64(0xC4CEB9FE1A85EC53)
_S29, _S33 = np.uint64(29), np.uint64(33)


#: Rows handed to a Python worker at once: whole texts can be long, and a worker holds several copies of a batch.
BATCH_ROWS = 2_000


def text_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches for operators that hand whole texts to Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hands this worker's freed memory back to the system: workers stay after their tasks, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def frugal(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of a task's batches that gives freed memory back when it ends."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, under the session's ``spark.checkpoint.dir``.

    Only where that setting is absent and everything runs in one process (tests) a temporary folder stands
    in for it; on any other master its absence is an error, as other machines would not see the files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="findra-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/findra-{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` begins with it (in any case)."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = f"_{name}"
    return name


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key's decimal text leaves ``remainder``; a null key counts as held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def whole_id(name: str, known: str = "known") -> tuple[Column, Column]:
    """An integer column as itself with 0 for null, and whether it was not null: pandas keeps whole numbers exact only without nulls."""
    return F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name), F.col(name).isNotNull().alias(known)


def frame_of(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a pandas frame for a flat schema; whole numbers stay exact beside nulls."""
    names = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    whole = {"bigint": "Int64", "int": "Int32"}
    return pd.DataFrame({n: pd.array(c, dtype=whole.get(t, "Float64" if t == "double" else object)) for (n, t), c in zip(names, map(list, columns), strict=True)})


def crc_mod(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def labelled_sample(labels: DataFrame, per_label: int, most: int | None = None) -> dict:
    """Id to label of at most ``per_label`` rows of each label of ``id, label``.

    With ``most`` there are fewer rows of each, one at least, so that all labels have about ``most`` together.

    Rows with the smallest hash of their id are taken. Counts come first; they give each label a hash
    bound that about twice the wanted rows pass, so no label is gathered or ranked as a whole. Null
    ids and labels are left out; an id with several labels has the largest.
    """
    rows = labels.where(F.col("id").isNotNull() & F.col("label").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # a row a label
    if not counts:
        return {}
    if most is not None:
        per_label = max(1, min(per_label, most // len(counts)))
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, (2 * per_label + 50) / n))) for k, n in counts.items()], F.lit(0.0))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    passed = rows.withColumn("draw", draw).where(F.col("draw") < share * (1 << 30)).select("id", "label", "draw").distinct()
    got = passed.orderBy("draw", "id", "label").limit(4 * len(counts) * (per_label + 50)).collect()
    taken: dict = {}
    used = dict.fromkeys(counts, 0)
    for i, label, _ in got:
        if used[label] < per_label:
            used[label] += 1
            taken[i] = max(label, taken.get(i, label))
    return taken


def texts_of(docs: DataFrame, ids: list, doc_id: str = "doc_id", text: str = "text") -> list[tuple]:
    """Id and text of the documents with the given ids (a bounded list), ordered by id and text, one for each id."""
    if not ids:
        return []
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where(F.col("i").isin(ids) & F.col("t").isNotNull())
    return [(r["i"], r["t"]) for r in rows.groupBy("i").agg(F.min("t").alias("t")).orderBy("i").collect()]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift multiply), elementwise."""
    h = h ^ (h >> _S33)
    h = h * _FIN1
    h = h ^ (h >> _S33)
    h = h * _FIN2
    return h ^ (h >> _S33)


def shingle_hashes(words: list[bytes], width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles.

    Fewer words than ``width`` make one shingle of the whole sequence; no words make none.
    """
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    a = np.array([digest(w) for w in words], dtype=np.uint64)
    n = len(a)
    k = min(width, n)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ a[i : n - k + 1 + i]) * _MIX
        h ^= h >> _S29
    return np.unique(mix64(h))


def batches_by_size(texts: list, limit: int, size_of=lambda t: len(t) if t is not None else 0):
    """Index ranges of consecutive texts with about ``limit`` characters each (one text at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        n = size_of(t)
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


#: Most buckets that ``range_bounds`` makes; whatever has a row for each bucket is bounded by it.
MAX_BUCKETS = 65_536


def range_bounds(df: DataFrame, key: str, rows_per_bucket: int) -> list[int]:
    """Split points that cut the integer ``key`` into buckets of about ``rows_per_bucket`` rows.

    Quantiles come from Spark's bounded sketch, so the driver holds one number a bucket, of at
    most ``MAX_BUCKETS``; beyond that the buckets grow instead.
    """
    n = df.select(F.count(key)).first()[0]
    buckets = min(MAX_BUCKETS, max(1, -(-n // rows_per_bucket)))
    if buckets == 1:
        return []
    got = df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.2 / buckets)
    return sorted({int(x) for x in got})


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """The number of split points at or below the key, by binary search; null keys go first."""
    if not bounds:
        return F.lit(0)
    points = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s.lo + s.hi, 1)
        right = (s.lo < s.hi) & (F.get(points, mid) <= key)
        return F.struct(
            F.when(right, mid + 1).otherwise(s.lo).alias("lo"),
            F.when(right, s.hi).otherwise(F.when(s.lo < s.hi, mid).otherwise(s.hi)).alias("hi"),
        )

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.when(key.isNull(), F.lit(0)).otherwise(F.aggregate(steps, start, halve, lambda s: s.lo))
