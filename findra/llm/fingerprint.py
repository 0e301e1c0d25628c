"""Document fingerprints: threshold-scaled sketches of word-shingle hashes.

A sketch keeps every 5-word shingle hash below a fixed fraction of the hash range, whatever the
document's length, so sketches of very unequal documents estimate containment, and the sketch of a
union is the union of sketches. Hashes below the fraction are uniform there; 48 bits of each are kept.
A text whose hashes all lie above the fraction keeps its smallest one, marked by lying above it, so that
only a text without words has an empty sketch; merging drops such a stand-in where others are kept.

As text a sketch is the base64 of its sorted hashes, 6 bytes each, big-endian.

Defined results: null and empty texts have the empty sketch and empty text form; two empty sketches are
fully alike (1.0), an empty and another not at all (0.0). In the sequence query rows are ordered by id,
null ids first, equal ids by text; repeated rows are rows of the sequence; other columns are ignored; an
empty table gives no rows; a table of one row is followed by itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frame_of, frugal, range_bounds, range_bucket, shingle_hashes, stored, table, text_batches, whole_id, words_of

#: Share of the hash range that is kept.
FRACTION = 0.25
ROWS_PER_BUCKET = 4_000

_BITS = 48
_LIMIT = int(FRACTION * (1 << _BITS))


def sketch(text: str | None) -> np.ndarray:
    """Sorted kept hashes of a text."""
    h = shingle_hashes(words_of(text)) >> np.uint64(64 - _BITS)
    if len(h) == 0:
        return h
    low = h[: int(np.searchsorted(h, np.uint64(_LIMIT)))]
    return np.unique(low) if len(low) else h[:1]


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of all the texts together."""
    h = np.unique(np.concatenate([np.empty(0, np.uint64), *sketches]))
    low = h[h < _LIMIT]
    return low if len(low) else h[:1]


def to_text(h: np.ndarray) -> str:
    return base64.b64encode(h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    return (1.0 if len(b) == 0 else 0.0) if len(a) == 0 else _shared(a, b) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated shared part of all shingles of both (Jaccard)."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    s = _shared(a, b)
    return s / (len(a) + len(b) - s)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every whole text."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([to_text(sketch(t)) for t in texts], dtype=object)

    return docs.withColumn(name, made(F.col(text)))


SEQUENCE_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "contained_edited double, contained_next double"
)

ENDS_SCHEMA = "bucket int, first_id bigint, first_text string, last_id bigint, last_text string"


def edited_text(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first code points of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compare(key: int | None, text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    e = own if edited == text else sketch(edited)
    return (
        key, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(e),
        likeness(own, e), likeness(own, theirs), containment(own, e), containment(own, theirs),
    )


def sequence_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, compared along the ascending ids.

    The texts are shuffled once, into contiguous ranges of ids. A document and its successor meet in
    their range's task; the last document of each range is compared with the first of the next one
    from a second look at the same shuffle, which yields two texts a range; these are joined by range.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = range_bounds(docs, "doc_id", ROWS_PER_BUCKET)
    dealt = docs.withColumn("bucket", range_bucket(F.col("doc_id"), bounds)).repartitionById(len(bounds) + 1, "bucket")

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for pdf in batches:
            rows = []
            for bucket, key, known, t in zip(pdf["bucket"].tolist(), pdf["doc_id"].tolist(), pdf["known"].tolist(), pdf["text"].tolist(), strict=True):
                now = (bucket, key if known else None, t, sketch(t))
                if before is not None and before[0] == bucket:
                    rows.append(_compare(*before[1:], *now[2:]))
                before = now
            yield frame_of(rows, SEQUENCE_SCHEMA)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least: dict[int, tuple] = {}
        most: dict[int, tuple] = {}
        for pdf in batches:
            for bucket, key, known, t in zip(pdf["bucket"].tolist(), pdf["doc_id"].tolist(), pdf["known"].tolist(), pdf["text"].tolist(), strict=True):
                at = (known, key, t.encode("utf-8", "surrogatepass"))
                least[bucket] = min(at, least.get(bucket, at))
                most[bucket] = max(at, most.get(bucket, at))
        rows = [(b, *[x for has, key, t in (least[b], most[b]) for x in (key if has else None, t.decode("utf-8", "surrogatepass"))]) for b in least]
        yield frame_of(rows, ENDS_SCHEMA)

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf["last_id"].tolist(), pdf["known"].tolist(), pdf["last_text"].tolist(), pdf["following"].tolist(), strict=True)
            yield frame_of([_compare(key if known else None, t, sketch(t), f, sketch(f)) for key, known, t, f in rows], SEQUENCE_SCHEMA)

    main = dealt.sortWithinPartitions("bucket", "doc_id", "text").select("bucket", *whole_id("doc_id"), "text").mapInPandas(frugal(inside), SEQUENCE_SCHEMA)
    edges = dealt.select("bucket", *whole_id("doc_id"), "text").mapInPandas(frugal(ends), ENDS_SCHEMA)
    edges = stored(docs.sparkSession, edges, "ends")
    # A number for each range, of MAX_BUCKETS at most; after the last range comes the first.
    order = Window.orderBy("bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = edges.select("bucket", F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(whole)).alias("next"))
    firsts = edges.select(F.col("bucket").alias("next"), F.col("first_text").alias("following"))
    joints = edges.join(turns, "bucket").join(firsts, "next").select(*whole_id("last_id"), "last_text", "following").mapInPandas(frugal(across), SEQUENCE_SCHEMA)
    return main.unionByName(joints)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with their likeness."""
    return sequence_fingerprints(table(spark, sf_dir, "documents"))
