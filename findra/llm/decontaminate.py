"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training token windows.

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased. A window is
ten consecutive words of an item; an item with fewer words (but some) is one window of all its words.
Every document position is looked up in the hash set of windows; a hash hit counts only if the window's
text is equal, which the join's key comparison verifies. All of it is DataFrame expressions.

The window table is broadcast only up to ``BROADCAST_BYTES`` (summed first). A larger benchmark is joined
by shuffle: only real windows of documents are shuffled, as numbers, the found ones are verified on the
documents' texts, and documents without any are added from the documents, with the same result.

Defined results: null, empty or wordless texts have no words and no hits; null or wordless items have no
windows; repeated documents are each reported; repeated windows count once an item; items with a null
id have windows, but are left out of the item list; empty tables give no rows or no hits. Other columns,
whatever their names, are kept by the removing functions and ignored by the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

WINDOW_WORDS = 10
#: Bytes of windows and item lists that are broadcast at most.
BROADCAST_BYTES = 64 << 20

_UPPER = "".join(map(chr, range(0x41, 0x5B)))
_OTHER = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: One word with the separators before it.
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The normalised words of a text, none for null."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER)))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def _window(ws: Column, at: Column, width: Column) -> Column:
    return F.array_join(F.slice(ws, at, width), " ")


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW_WORDS) -> DataFrame:
    """``window, len, items``: each distinct window with its length and the distinct items that hold it."""
    ws = items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    ws = ws.withColumn("len", F.least(F.size("ws"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.size("ws") - F.col("len") + 1)
    each = ws.select("item", "len", F.explode(F.transform(starts, lambda i: _window(F.col("ws"), i, F.col("len")))).alias("window"))
    return each.groupBy("window", "len").agg(F.collect_set("item").alias("items"))


def _fit_broadcast(windows: DataFrame) -> bool:
    size = windows.agg(F.sum(F.octet_length("window") + 16 * F.size("items") + 64)).first()[0] or 0
    return size <= BROADCAST_BYTES


def _lengths(windows: DataFrame) -> list[int]:
    return sorted(r[0] for r in windows.select("len").distinct().collect())  # WINDOW_WORDS values at most


def _starts(n: int) -> Column:
    return F.when(F.size("ws") >= n, F.sequence(F.lit(1), F.size("ws") - (n - 1))).otherwise(F.array().cast("array<int>"))


def _hits(docs: DataFrame, keys: dict[str, Column], windows: DataFrame, text: str) -> DataFrame:
    """A row for every occurring window (``at`` from 1, ``len``, ``items``), and one with null ``items`` for each document; ``windows`` are broadcast."""

    def of(n: int) -> Column:
        return F.transform(_starts(n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), _window(F.col("ws"), i, F.lit(n)).alias("window")))

    none = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("window")))
    doc = docs.select(*[c.alias(k) for k, c in keys.items()], words(F.col(text)).alias("ws"))
    each = doc.select(*keys, F.size("ws").cast("bigint").alias("n_words"), F.explode(F.concat(none, *map(of, _lengths(windows)))).alias("w")).select(*keys, "n_words", "w.*")
    joined = each.join(F.broadcast(windows.select("window", "items", "len")), ["window", "len"], "left")
    return joined.where(F.col("items").isNotNull() | (F.col("len") == 0)).drop("window")


def _hits_by_shuffle(docs: DataFrame, windows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``hit_id, hit_text, at, len, items`` of every occurring window, for each different document once."""
    code = lambda w, n: F.xxhash64(w, n)
    numbers = windows.select(code(F.col("window"), F.col("len")).alias("code")).distinct()

    def of(n: int) -> Column:
        return F.transform(_starts(n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), code(_window(F.col("ws"), i, F.lit(n)), F.lit(n)).alias("code")))

    doc = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("hit_id"), F.xxhash64(text).alias("hit_text"), words(F.col(text)).alias("ws"))
    each = doc.select("hit_id", "hit_text", F.explode(F.concat(*map(of, _lengths(windows)))).alias("w")).select("hit_id", "hit_text", "w.*")
    found = each.join(numbers, "code", "left_semi").groupBy("hit_id", "hit_text").agg(F.collect_set(F.struct("at", "len")).alias("spans")).toDF("id", "hash", "spans")
    texts = doc.join(found, F.col("hit_id").eqNullSafe(F.col("id")) & (F.col("hit_text") == F.col("hash"))).select("hit_id", "hit_text", "ws", F.explode("spans").alias("s"))
    named = texts.select("hit_id", "hit_text", "s.at", "s.len", _window(F.col("ws"), F.col("s.at"), F.col("s.len")).alias("window")).distinct()
    return named.join(windows.select("window", "len", "items"), ["window", "len"]).drop("window")


def _covered(spans: Column) -> Column:
    """How many word positions the spans (``at, len``) cover together."""

    def add(s: Column, x: Column) -> Column:
        end = x["at"] + x["len"]
        return F.struct((s["n"] + F.greatest(F.lit(0), end - F.greatest(s["end"], x["at"]))).alias("n"), F.greatest(s["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda s: s["n"].cast("bigint"))


def _gathered() -> list[Column]:
    """The distinct items and spans of a document's hits."""
    hit = F.col("items").isNotNull()
    return [F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.array_sort(F.collect_set(F.when(hit, F.struct("at", "len")))).alias("spans")]


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW_WORDS) -> DataFrame:
    """A row for each document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    ``spans`` are the occurring windows as (``at`` from 1, ``len``) in words.
    """
    windows = benchmark_windows(items, width=width)
    if _fit_broadcast(windows):
        # The row number is made and used within one job, only to keep repeated documents apart.
        rows = _hits(docs, {"row": F.monotonically_increasing_id(), doc_id: F.col(doc_id)}, windows, text)
        per = rows.groupBy("row", doc_id).agg(F.max("n_words").alias("n_words"), *_gathered())
    else:
        found = _hits_by_shuffle(docs, windows, doc_id, text).groupBy("hit_id", "hit_text").agg(*_gathered())
        plain = docs.select(F.col(doc_id).alias("own_id"), F.xxhash64(text).alias("own_text"), F.size(words(F.col(text))).cast("bigint").alias("n_words"))
        joined = plain.join(found, F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_text") == F.col("hit_text")), "left")
        none = [F.array().cast(found.schema[c].dataType) for c in ("items", "spans")]
        per = joined.select(F.col("own_id").alias(doc_id), "n_words", F.coalesce("items", none[0]).alias("items"), F.coalesce("spans", none[1]).alias("spans"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return per.select(
        doc_id,
        "n_words",
        _covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def _contaminated(docs: DataFrame, items: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Id and text hash of the contaminated documents with their spans; rows equal in both share the verdict."""
    windows = benchmark_windows(items, width=width)
    if _fit_broadcast(windows):
        rows = _hits(docs, {"hit_id": F.col(doc_id), "hit_text": F.xxhash64(text)}, windows, text).where(F.col("items").isNotNull())
    else:
        rows = _hits_by_shuffle(docs, windows, doc_id, text)
    return rows.groupBy("hit_id", "hit_text").agg(F.array_sort(F.collect_set(F.struct("at", "len"))).alias("hit_spans"))


def _same(docs: DataFrame, found: DataFrame, doc_id: str, text: str, own: str = "hit_") -> Column:
    return docs[doc_id].eqNullSafe(found[f"{own}id"]) & (F.xxhash64(docs[text]) == found[f"{own}text"])


def remove_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without the documents in which a window occurs."""
    found = _contaminated(docs, items, doc_id, text, width).drop("hit_spans")
    return docs.join(found, _same(docs, found, doc_id, text), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with every hit word, and the separators before it, cut out of the text."""
    own = unused(docs, "hit_")
    found = _contaminated(docs, items, doc_id, text, width)
    found = found.toDF(*[c.replace("hit_", own) for c in found.columns])
    pieces = F.regexp_extract_all(text, F.lit(f"({_PIECE})"))
    tail = F.regexp_extract(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    clean = F.filter(pieces, lambda _, i: ~F.exists(f"{own}spans", lambda s: (i + 1 >= s["at"]) & (i + 1 < s["at"] + s["len"])))
    cut = F.when(F.col(f"{own}spans").isNull(), F.col(text)).otherwise(F.concat(F.array_join(clean, ""), tail))
    joined = docs.join(found, _same(docs, found, doc_id, text, own), "left")
    return joined.withColumn(text, cut).select(*docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and benchmark items of every document."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, ws, least(len(ws), {WINDOW_WORDS}) AS n FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
bs AS (SELECT item_id, n, ws, unnest(generate_series(1, len(ws) - n + 1)) AS p FROM b),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[p : p + n - 1], ' ') AS win FROM bs),
ds AS (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n),
dw AS (SELECT doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') AS win FROM ds),
h AS (SELECT DISTINCT doc_id, item_id, p, n FROM dw JOIN bw USING (n, win)),
w AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN i USING (doc_id)
"""
