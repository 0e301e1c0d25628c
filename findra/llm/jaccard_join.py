"""N-gram Jaccard join: exact set-similarity join on word shingles with set-relation skipping, and its components.

Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity of at least 3/4
(``100 * intersection >= 75 * union``). The result names each document's component of links; links
within one are never enumerated.

How it works:

* Equal sets are one node. Shingles are ordered by rough frequency (hash buckets counted over the whole
  corpus tell the common ones), rare first; a node's prefix is its first ``n - ceil(3n/4) + 1``
  shingles. Linked nodes share a shingle of both prefixes. Prefixes are shuffled by shingle into index
  lists; each map task gathers the nodes of a shingle into one row first, so a shingle that many
  documents share never becomes many rows of one task. Lists of one node end there.
* Positions skip list blocks: an entry holds its set's size and how many of its shingles stand from this one
  on. Where a list has the first shingle that two sets share, their overlap is at most the lesser of
  these two counts; so a list sorted by size is read only where sizes and the entry's own position
  let a link be, and entries that stand too far back are passed over. A linking pair passes at the
  first shingle that it shares. Each distinct pair is then sifted by bit signatures of the sets, whose
  bits tell odd counts of shingles: sets differ in at least as many shingles as signatures in bits.
* Answers are derived from those of a similar set: every list first answers its leader only (a node with
  many common shingles, such as the original of many copies). Whole sets decide these pairs, and each
  node keeps its difference to the nearest leader. Links make components; lists within one component
  are left out, as are pairs within one. What is left are pairs of different components. Two nodes
  with one leader are answered from their differences alone, as these differ from each other
  where the sets do; only pairs without a common leader are read as whole sets. This last pass is
  complete, which makes the components exact however the leaders fared.

Nodes are told apart by 52-bit hashes of sets with their size class and shingles by 64-bit hashes; equal
hashes count as equal. Odds that any two of 10 million
different sets have the same number are below 1 in 1,000.

Defined results: null, empty and wordless texts have an empty set, size 0, and link with nothing; fewer
words than five make one shingle; repeated rows are nodes with equal sets, each reported; documents of
equal id are linked only by their texts; a null id stays null and never names a component; other
columns are ignored by the join and kept by ``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_by_size, frame_of, frugal, shingle_hashes, stored, table, text_batches, whole_id, words_of
from .components import components

#: Hash buckets whose shingle counts order shingles.
BUCKET_BITS = 18
BUCKET_CHUNKS = 16
#: Bits of the filter that spares texts which no candidate pair names; its size does not grow.
BLOOM_BITS = 1 << 22
#: Characters of text a task turns into sets at once (a longer text alone).
BATCH_CHARS = 3_000_000
#: Words of 64 bits of a sketch: a signature folded to a fixed size, which goes with the entries that are compared within a list.
SKETCH_WORDS = 8
#: Size classes, part of a node's number, grow by this factor.
CLASS_BASE = 1.06
#: Sorted rows of index lists that a task looks at together, about.
LIST_ROWS = 50_000

_HASH_MASK = ((1 << 52) - 1) << 8
#: A node in an index list: its number, its set's size, and its shingles from the list's shingle on.
ENTRY = np.dtype([("x", "<i8"), ("n", "<i4"), ("q", "<i4")])
POSTING_SCHEMA = "key bigint, node bigint, n int, q int, more binary"
#: kind 0: an entry of a list; 1: a document's facts; 2: ``node`` may link with the leader ``other`` of a list.
INDEX_SCHEMA = "kind int, key bigint, node bigint, other bigint, row bigint, n int, q int, sig binary, sketch array<bigint>"
PAIR_SCHEMA = "a bigint, b bigint"
ROW_PAIR_SCHEMA = "a bigint, b bigint, row_a bigint, row_b bigint"
ANSWER_SCHEMA = "u bigint, v bigint, linked boolean, n int, differ binary"


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact link test of two sorted sets."""
    if len(a) == 0 or len(b) == 0:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def set_hash(h: np.ndarray) -> int:
    """The set's part of a node number."""
    return (xxhash.xxh64_intdigest(h.tobytes()) << 8) & _HASH_MASK


def _size_class(n: int) -> int:
    return min(255, int(np.log(n) / np.log(CLASS_BASE)))


def signature(h: np.ndarray) -> bytes:
    """Bits by the low bits of hashes, set where an odd number of the set's fall; at least two bits a shingle, and a sketch's."""
    bits = max(64 * SKETCH_WORDS, 1 << (2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def sketch(sig: bytes) -> list[int]:
    """A signature folded to ``SKETCH_WORDS`` words: two sets differ in at least as many shingles as sketches in bits."""
    x = np.frombuffer(sig, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, 8 * SKETCH_WORDS), axis=0).view("<i8").tolist()


def least_apart(a: bytes, b: bytes) -> int:
    """Shingles that two sets differ in, at least. The longer signature is folded to the other's length."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


# --- common shingles -----------------------------------------------------------------------------


def bucket_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles of the corpus by the top bits of their hash; each task counts equal sets once."""
    width = (1 << BUCKET_BITS) // BUCKET_CHUNKS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(1 << BUCKET_BITS, np.int64), set()
        for pdf in batches:
            hashes, size = [], 0
            for t in pdf["t"].tolist():
                h = shingle_hashes(words_of(t))
                if (s := set_hash(h)) not in seen:
                    seen.add(s)
                    hashes.append((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
                    size += len(h)
                if size > 2_000_000:
                    total += np.bincount(np.concatenate(hashes), minlength=len(total))
                    hashes, size = [], 0
            if hashes:
                total += np.bincount(np.concatenate(hashes), minlength=len(total))
        yield pd.DataFrame([(i, zlib.compress(total[i * width : (i + 1) * width].astype("<u4").tobytes(), 1)) for i in range(BUCKET_CHUNKS)], columns=["chunk", "counts"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for i, c in zip(pdf["chunk"], pdf["counts"], strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64)
        yield pd.DataFrame([(i, s.astype("<i8").tobytes()) for i, s in sums.items()], columns=["chunk", "counts"])

    schema = "chunk int, counts binary"
    parts = docs.select(F.col(text).alias("t")).mapInPandas(frugal(count), schema).repartition("chunk").mapInPandas(add, schema)
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for i, c in parts.collect():  # BUCKET_CHUNKS rows
        out[i * width : (i + 1) * width] += np.frombuffer(c, "<i8")
    return out


def commonness(counts: np.ndarray) -> np.ndarray:
    """Rank of each bucket: 0 where its count is ordinary, then growing with the logarithm of the excess."""
    mean = counts.mean()
    slack = 8 * np.sqrt(mean) + 32
    excess = counts - mean
    rank = 1 + 4 * np.log2(np.maximum(excess, slack) / slack)
    return np.where(excess >= slack, np.minimum(rank, 127), 0).astype(np.uint8)


# --- index lists ---------------------------------------------------------------------------------


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.append(True, new)) if len(keys[0]) else np.empty(0, np.int64)


def _grouped(keys: np.ndarray, entries: np.ndarray) -> pd.DataFrame:
    """Postings with the entries of each key in one row: one in columns, the others as bytes."""
    order = np.argsort(keys, kind="stable")
    keys, entries = keys[order], entries[order]
    starts = _starts(keys)
    ends = np.append(starts[1:], len(keys))
    more: list = [None] * len(starts)
    for i in np.flatnonzero(ends - starts > 1):
        more[i] = entries[starts[i] + 1 : ends[i]].tobytes()
    first = entries[starts]
    return pd.DataFrame({"key": keys[starts], "node": first["x"], "n": first["n"], "q": first["q"], "more": pd.Series(more, dtype=object)})


def _postings(batches: Iterator[pd.DataFrame], rank: np.ndarray) -> Iterator[pd.DataFrame]:
    """Prefix postings of each node once a task, and a row with each document's facts (``q`` -1)."""
    seen: set[int] = set()
    for pdf in batches:
        texts, ids = pdf["t"].tolist(), list(zip(pdf["i"].tolist(), pdf["known"].tolist(), pdf["row"].tolist(), strict=True))
        for lo, hi in batches_by_size(texts, BATCH_CHARS):
            keys, entries, facts = [np.empty(0, np.int64)], [np.empty(0, ENTRY)], []
            for (i, known, row), t in zip(ids[lo:hi], texts[lo:hi], strict=True):
                h = shingle_hashes(words_of(t))
                n = len(h)
                node = 0
                if n:
                    r = rank[h >> np.uint64(64 - BUCKET_BITS)]
                    # The node number begins with how few common shingles the set has, so that the least of a list leads.
                    node = ((7 - int(7 * np.count_nonzero(r) / n)) << 60) | set_hash(h) | _size_class(n)
                    if node not in seen:
                        seen.add(node)
                        p = n - (3 * n + 3) // 4 + 1
                        k = np.sort((r.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8)))[:p]
                        e = np.empty(p, ENTRY)
                        e["x"], e["n"], e["q"] = node, n, n - np.arange(p)
                        keys.append(k.astype(np.int64))
                        entries.append(e)
                spread = xxhash.xxh64_intdigest(f"{i} {row} {node}".encode()) >> 8
                facts.append((spread, node, n, -1, struct.pack("<?qq", known, i, row) + (signature(h) if n else b"")))
            yield _grouped(np.concatenate(keys), np.concatenate(entries))
            yield pd.DataFrame(facts, columns=["key", "node", "n", "q", "more"])


def _groups(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``key``, about ``least`` at a time, cut so that no key's rows are in two of them."""
    held, size = [], 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size < least:
            continue
        rows = pd.concat(held) if len(held) > 1 else pdf
        keys = rows["key"].to_numpy()
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last:
            yield rows.iloc[:last]
        held, size = [rows.iloc[last:]], len(rows) - last
        if not last:
            least = 2 * size  # a long list is not put together again for every batch
    if size:
        yield pd.concat(held)


def may_link(n: np.ndarray, q: np.ndarray, n2: np.ndarray, q2: np.ndarray) -> np.ndarray:
    """Whether sets of sizes ``n, n2`` may link if none of their shared shingles stands before the last ``q, q2``: an overlap of 3/7 of both sizes."""
    return 7 * np.minimum(q, q2).astype(np.int64) >= 3 * (n.astype(np.int64) + n2)


def _lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of index lists of two nodes or more, pairs of their leaders, and facts."""
    for pdf in _groups(batches, LIST_ROWS):
        fact = pdf["q"].to_numpy() < 0
        facts, rows = pdf[fact], []
        for key, node, n, raw in zip(facts["key"].tolist(), facts["node"].tolist(), facts["n"].tolist(), facts["more"].tolist(), strict=True):
            known, doc_id, row = struct.unpack_from("<?qq", raw)
            sig = raw[struct.calcsize("<?qq") :]
            rows.append((1, key, node, doc_id if known else None, row, n, 0, sig, sketch(sig) if n else None))
        yield frame_of(rows, INDEX_SCHEMA)
        lists = pdf[~fact]
        own = np.empty(len(lists), ENTRY)
        own["x"], own["n"], own["q"] = lists["node"].to_numpy(), lists["n"].to_numpy(), lists["q"].to_numpy()
        keys = lists["key"].to_numpy(np.int64)
        packed = lists["more"].tolist()
        at = np.flatnonzero(lists["more"].notna().to_numpy())
        more = [np.frombuffer(packed[i], ENTRY) for i in at]
        keys = np.concatenate([keys, np.repeat(keys[at], [len(m) for m in more])])
        entries = np.concatenate([own, *more])
        order = np.lexsort((-entries["q"], entries["x"], keys))
        keys, entries = keys[order], entries[order]
        once = _starts(keys, entries["x"])  # the same node from several tasks
        keys, entries = keys[once], entries[once]
        starts = _starts(keys)
        size = np.diff(np.append(starts, len(keys)))
        several = np.repeat(size > 1, size)
        leads = entries[np.repeat(starts, size)][several]
        keys, entries = keys[several], entries[several]
        yield pd.DataFrame({"kind": 0, "key": keys, "node": entries["x"], "other": None, "row": None, "n": entries["n"], "q": entries["q"], "sig": None, "sketch": None})
        ok = may_link(leads["n"], leads["q"], entries["n"], entries["q"]) & (leads["x"] != entries["x"])
        pairs = np.unique(np.stack([leads["x"][ok], entries["x"][ok]], axis=1), axis=0)
        yield pd.DataFrame({"kind": 2, "key": 0, "node": pairs[:, 1], "other": pairs[:, 0], "row": None, "n": 0, "q": 0, "sig": None, "sketch": None})


def across(entries: np.ndarray, comp: np.ndarray, sketches: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a list's nodes in different components that may link by sizes, positions and sketches; its leader's are left out."""
    n, q = entries["n"].astype(np.int64), entries["q"].astype(np.int64)
    # The least size a partner can have is 3/4 of one's own; who stands too far back for that has none.
    fit = (7 * q >= 3 * (n + np.maximum(n.min(), -(-3 * n // 4)))) & (entries["x"] != entries["x"].min())
    order = np.flatnonzero(fit)[np.argsort(n[fit], kind="stable")]
    # Unsigned: of a negative number, the bits of the absolute value would be counted.
    x, n, q, comp, sketches = entries["x"][order], n[order], q[order], comp[order], sketches[order].view(np.uint64)
    # A partner at least as large has at most 4/3 of one's size, and no more than one's own position allows.
    stop = np.searchsorted(n, np.minimum(4 * n // 3, (7 * q - 3 * n) // 3), side="right")
    room = 7 * q - 3 * n
    for i in np.flatnonzero(stop > np.arange(len(x)) + 1):
        block = slice(i + 1, stop[i])
        at = i + 1 + np.flatnonzero((room[block] >= 3 * n[i]) & (comp[block] != comp[i]))
        apart = np.bitwise_count(sketches[at] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        y = x[at[7 * apart <= n[at] + n[i]]]
        if len(y):
            yield np.minimum(y, x[i]), np.maximum(y, x[i])


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs to be answered of the lists that have several components, once for each batch."""

    def distinct(a: list, b: list) -> pd.DataFrame:
        pairs = np.unique(np.stack([np.concatenate([np.empty(0, np.int64), *a]), np.concatenate([np.empty(0, np.int64), *b])], axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    a, b, size = [], [], 0
    for pdf in batches:
        for packed in pdf["entries"]:
            rows = np.asarray(packed, np.int64).reshape(-1, 4 + SKETCH_WORDS)
            entries = np.empty(len(rows), ENTRY)
            entries["x"], entries["n"], entries["q"] = rows[:, 0], rows[:, 2], rows[:, 3]
            for u, v in across(entries, rows[:, 1], rows[:, 4:]):
                a.append(u)
                b.append(v)
                size += len(u)
                if size > 1_000_000:
                    yield distinct(a, b)
                    a, b, size = [], [], 0
    yield distinct(a, b)


# --- answers -------------------------------------------------------------------------------------


def _sifted(pairs: DataFrame, nodes: DataFrame, for_leaders: bool) -> DataFrame:
    """Pairs ``a, b`` whose signatures let them link, with the rows that stand for them; for leaders, those that may differ in half of ``b``."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("row", "n", "sig")]), side)

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            apart = np.array([least_apart(x, y) for x, y in zip(pdf["sig_a"], pdf["sig_b"], strict=True)], np.int64)
            n_a, n_b = pdf["n_a"].to_numpy(np.int64), pdf["n_b"].to_numpy(np.int64)
            yield pdf[2 * apart <= n_b if for_leaders else 7 * apart <= n_a + n_b][["a", "b", "row_a", "row_b"]]

    return stored(nodes.sparkSession, pairs.mapInPandas(frugal(sift), ROW_PAIR_SCHEMA), "pairs")


def _named(spark: SparkSession, ids: DataFrame) -> Column:
    """A filter on ``row`` that lets all of ``ids`` pass, and few others while these are few."""
    bits = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64("row", F.lit(k)), F.lit(BLOOM_BITS)) for k in (1, 2)])).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 31 AS INT))")).alias("m"))
    filled = np.zeros(BLOOM_BITS // 32, np.int64)
    for w, m in words.collect():  # BLOOM_BITS / 32 rows at most
        filled[w] = m
    shared = spark.sparkContext.broadcast(filled.astype(np.uint32))

    @F.pandas_udf("boolean")
    def named(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.ones(len(x), bool)
        for bit in (x.to_numpy(), y.to_numpy()):
            out &= (shared.value[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1
        return pd.Series(out)

    return named(*[F.pmod(F.xxhash64("row", F.lit(k)), F.lit(BLOOM_BITS)) for k in (1, 2)])


def _row(doc_id: str, text: str) -> Column:
    """What tells rows apart, null-safe: a 64-bit hash of id and text."""
    return F.xxhash64(doc_id, text)


def _verified(pairs: DataFrame, docs: DataFrame, lone: bool) -> DataFrame:
    """Pairs of nodes ``u, v`` answered from their whole sets: ``linked``, and where it is short, ``v``'s difference to ``u``.

    With ``lone`` some nodes have rows with null ids only.
    """
    spark = docs.sparkSession
    named = _named(spark, pairs.select(F.explode(F.array("row_a", "row_b")).alias("row")).distinct())
    rows = docs.select("i", "t", _row("i", "t").alias("row"))
    texts = rows.where(F.col("i").isNotNull()).where(named).select("row", "t")
    if lone:  # equal texts without an id are one row here
        texts = texts.unionByName(rows.where(F.col("i").isNull()).where(named).groupBy("row").agg(F.min("t").alias("t")))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            rows = []
            for a, b, ta, tb in pdf[["a", "b", "ta", "tb"]].itertuples(index=False):
                # Rows come in runs of one leader, whose set is kept.
                if held.get("text") is not ta and held.get("text") != ta:
                    held = {"text": ta, "set": shingle_hashes(words_of(ta))}
                x, y = held["set"], shingle_hashes(words_of(tb))
                # Hashes of rows may be equal; the set must be the node's.
                if set_hash(x) == a & _HASH_MASK and set_hash(y) == b & _HASH_MASK:
                    differ = np.setxor1d(x, y, assume_unique=True)
                    near = 2 * len(differ) <= len(y)
                    rows.append((a, b, links(x, y), len(y), differ.tobytes() if near else None))
            yield frame_of(rows, ANSWER_SCHEMA)

    joined = pairs.join(texts.select(F.col("row").alias("row_b"), F.col("t").alias("tb")), "row_b")
    joined = joined.join(texts.select(F.col("row").alias("row_a"), F.col("t").alias("ta")), "row_a")
    return stored(spark, joined.select("a", "b", "ta", "tb").mapInPandas(frugal(test), ANSWER_SCHEMA), "answers")


def links_by_difference(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> bool:
    """The link test of two sets from their sizes and their differences to a third set: these differ where the sets do."""
    apart = len(a) + len(b) - 2 * len(np.intersect1d(a, b, assume_unique=True))
    return 7 * apart <= n_a + n_b


def _derived(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Pairs with ``linked``: derived from a common leader's answers, null where there is none."""
    near = answers.where(F.col("differ").isNotNull())
    nearest = near.groupBy("v").agg(F.min(F.struct(F.octet_length("differ").alias("far"), "u", "n", "differ")).alias("to"))
    for side in ("a", "b"):
        pairs = pairs.join(nearest.select(F.col("v").alias(side), *[F.col(f"to.{c}").alias(f"{c}_{side}") for c in ("u", "n", "differ")]), side, "left")

    def derive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [links_by_difference(np.frombuffer(x, np.uint64), n, np.frombuffer(y, np.uint64), m) for x, n, y, m in pdf[["differ_a", "n_a", "differ_b", "n_b"]].itertuples(index=False)]
            yield pdf[["a", "b", "row_a", "row_b"]].assign(linked=got)

    common = F.col("u_a") == F.col("u_b")
    told = pairs.where(common).mapInPandas(derive, f"{ROW_PAIR_SCHEMA}, linked boolean")
    return told.unionByName(pairs.where(~F.coalesce(common, F.lit(False))).select("a", "b", "row_a", "row_b", F.lit(None).cast("boolean").alias("linked")))


# --- the operator --------------------------------------------------------------------------------


def _labelled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row for each document: ``doc_id, row, n``, and of its component (null for empty sets) the least id and its row, ``component, kept``."""
    text_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("bigint").alias("i"), F.col(text).alias("t"))
    rank = spark.sparkContext.broadcast(commonness(bucket_counts(docs, "t")))  # 2 ** BUCKET_BITS bytes

    whole = docs.select(_row("i", "t").alias("row"), *whole_id("i"), "t")
    postings = whole.mapInPandas(frugal(lambda batches: _postings(batches, rank.value)), POSTING_SCHEMA)
    index = stored(spark, postings.repartition("key").sortWithinPartitions("key").mapInPandas(frugal(_lists), INDEX_SCHEMA), "lists")
    facts, entries = index.where("kind = 1").withColumnRenamed("other", "doc_id"), index.where("kind = 0")
    nodes = facts.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lone"), "doc_id", "row")).alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    nodes = stored(spark, nodes.select("*", F.col("first.row").alias("row")), "nodes")
    lone = bool(nodes.where("first.lone").limit(1).count())

    def labelled(links_found: DataFrame) -> DataFrame:
        return components(spark, links_found.select("u", "v"))

    led = index.where("kind = 2").select(F.col("other").alias("a"), F.col("node").alias("b")).distinct()
    answers = _verified(_sifted(led, nodes, True), docs, lone)
    links_found = answers.where("linked").select("u", "v")
    labels = labelled(links_found)

    # Lists of several components; each task's entries of a list go on as one row, with their sketches.
    members = entries.select("key", "node", "n", "q").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    members = stored(spark, members, "members")
    several = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    members = members.join(several, "key").join(nodes.select("node", "sketch"), "node")
    packed = F.collect_list(F.concat(F.array("node", "comp", F.col("n").cast("bigint"), F.col("q").cast("bigint")), "sketch"))
    mixed = members.groupBy("key").agg(F.flatten(packed).alias("entries"))
    pairs = _sifted(mixed.select("entries").mapInPandas(frugal(_across), PAIR_SCHEMA).distinct(), nodes, False)
    derived = stored(spark, _derived(pairs, answers), "derived")
    second = derived.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if derived.where("linked IS NULL").limit(1).count():
        rest = _verified(derived.where("linked IS NULL").drop("linked"), docs, lone)
        second = second.unionByName(rest.where("linked").select("u", "v"))
    if second.limit(1).count():
        labels = labelled(links_found.unionByName(second))

    of = nodes.join(labels, "node", "left").select("node", "first", F.coalesce("comp", "node").alias("comp"))
    least = of.groupBy("comp").agg(F.min("first").alias("first"))
    of = of.select("node", "comp").join(least, "comp").select("node", F.col("first.doc_id").alias("component"), F.col("first.row").alias("kept"))
    of = stored(spark, of, "components")
    worded = facts.where("n > 0").join(of, "node").select("doc_id", "row", "n", "component", "kept")
    none = F.lit(None).cast("bigint")
    return worded.unionByName(facts.where("n = 0").select("doc_id", "row", "n", none.alias("component"), none.alias("kept")))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: ``doc_id, n_shingles, component_id``."""
    found = _labelled(docs, doc_id, text)
    return found.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: one of the smallest id, a null id only where there is no other; of repeated rows one stays."""
    others = _labelled(docs, doc_id, text).where("row <> kept").select(F.col("row").alias("other_row")).distinct()
    row = F.xxhash64(docs[doc_id].cast("bigint"), docs[text])
    return docs.join(others, row == others["other_row"], "left_anti").dropDuplicates([doc_id, text])


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))
