"""Token-ID / binary output: length-delimited binary records with masked checksums and a separate offset index.

File format, one file a bucket of the ordered key, all integers little-endian::

    record  = uint64 length | uint32 masked crc of those 8 bytes | payload | uint32 masked crc of the payload
    payload = uint8 has_key | uint8 id_bytes | int64 key | uint32 n_ids | n_ids x id of id_bytes (2 or 4)

The checksum is CRC-32 (zlib), rotated right by 15 bits plus a constant, so that a checksum of data
that holds checksums stays strong. The index is a Parquet table with a row for each record: ``file,
bucket, seq, key, offset, length, first_id, n_ids`` (``first_id``: ids before the record in its file).
A reader that shuffles takes any subset of index rows in any order and seeks straight to them.

Tokenising: where the vocabulary drops white space, splits at it and lower-cases (``SPLITS`` and
``NORMALIZES`` say how; the file is compared with them), ids of a text are the concatenation of the ids
of its white-space separated chunks. So Arrow finds the distinct chunks of a batch, each worker keeps a
bounded cache from chunk to ids, hands only new chunks to the ``tokenizers`` library, and puts the ids
of all texts together in one gather. Texts of any other vocabulary are encoded whole.

Defined results: a null or empty text is the end id alone; a very long text is one record and is encoded
by itself; rows with a null key come first; rows with equal keys are ordered by text and all kept; an empty table gives no files and an empty index; other
columns are ignored. A task writes under a temporary name and moves the finished file over the final
one, so a repeated or speculative attempt is harmless.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_by_size, frame_of, frugal, range_bounds, range_bucket, shared_dir, text_batches

END_ID = 1
#: Chunks in each of a worker's two cache generations at most, before their cores; about 200 bytes each.
CACHE_CHUNKS = 500_000
ROWS_PER_FILE = 4_000
#: Characters of text that are encoded at once (a longer text alone).
BATCH_CHARS = 8_000_000

# The normaliser and pre-tokeniser of vocabularies whose chunks can be encoded one by one.
NORMALIZES = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

INDEX_SCHEMA = "file string, bucket int, seq int, key bigint, offset bigint, length bigint, first_id bigint, n_ids bigint"
READ_SCHEMA = "key bigint, bucket int, first_id bigint, n_ids bigint, ids_crc32 bigint"



def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray) -> bytes:
    """One record; ``ids`` are unsigned 32-bit integers, stored in 2 bytes each where all fit."""
    narrow = not len(ids) or ids.max() < 1 << 16
    payload = struct.pack("<BBqI", key is not None, 2 if narrow else 4, key or 0, len(ids)) + ids.astype("<u2" if narrow else "<u4").tobytes()
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes) -> tuple[int | None, bytes]:
    """Key and id bytes of one whole record; a damaged record raises ``ValueError``."""
    if len(data) < 16 or struct.unpack_from("<I", data, 8)[0] != masked_crc(data[:8]):
        raise ValueError("damaged record length")
    payload = data[12:-4]
    if struct.unpack_from("<Q", data)[0] != len(payload) or struct.unpack("<I", data[-4:])[0] != masked_crc(payload):
        raise ValueError("damaged record")
    has, wide, key, n = struct.unpack_from("<BBqI", payload)
    if len(payload) != 14 + wide * n:
        raise ValueError("damaged record count")
    return (key if has else None), payload[14:] if wide == 4 else np.frombuffer(payload, "<u2", n, 14).astype("<u4").tobytes()


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next free code point from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(free)) for b in range(256)}


class ChunkEncoder:
    """Encodes texts with a ``tokenizers`` vocabulary, each distinct chunk once where chunks can be encoded one by one.

    The cache has two generations of ``cache`` chunks: when the young one is full it becomes the old one,
    and chunks met again move back.
    """

    def __init__(self, path: str, cache: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = cache
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        alphabet = _byte_alphabet()
        self.to_bytes = lambda w: "".join([alphabet[b] for b in w.encode()])
        spec = json.loads(self.tokenizer.to_str())
        # Added tokens are looked for before anything is split; chunks with "<" are encoded whole.
        added = all(t["content"].startswith("<") and not any(c.isspace() for c in t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
        model = spec["model"]
        plain = model["type"] == "BPE" and model["end_of_word_suffix"] and not (model.get("dropout") or model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix"))
        self.by_chunk = bool(added and plain and spec["normalizer"] == NORMALIZES and spec["pre_tokenizer"] == SPLITS)

    def _encode_new(self, chunks: list[str]) -> None:
        """Puts the ids of chunks that no generation has into the young one."""
        tokenize, young, old = self.tokenizer.model.tokenize, self.young, self.old
        whole: dict[str, None] = {}
        parts = []
        for c in chunks:
            # Core and trailing punctuation are separate pre-tokens if a letter ends the core;
            # "<" may begin a special token, whose letters' case matters.
            core = c.rstrip(".,;:!?")
            if "<" in c or not core or not core[-1].isalpha():
                if c not in young:
                    whole[c] = None
                continue
            tail = c[len(core) :]
            plain = core.isascii()
            if plain:
                core = core.lower()
            if core not in young:
                if core in old:
                    young[core] = old[core]
                elif core.isalpha() and (plain or (core == core.lower() and unicodedata.is_normalized("NFC", core))):
                    ids = [t.id for t in tokenize(core if plain else self.to_bytes(core))]
                    young[core] = struct.pack(f"<{len(ids)}I", *ids)
                else:
                    whole[core] = None
            if tail and tail not in young:
                whole[tail] = None
            if core != c:
                parts.append((c, core, tail))
        for c, e in zip(whole, self.tokenizer.encode_batch_fast([*whole], add_special_tokens=False), strict=True):
            young[c] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        for c, core, tail in parts:
            young[c] = young[core] + young[tail] if tail else young[core]

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        """Ids of each of some distinct chunks."""
        new = [c for c in chunks if c not in self.young]
        if len(self.young) + len(new) > self.limit:
            self.old, self.young = self.young, {}
            new = chunks
        if self.old:
            known, old = [c for c in new if c in self.old], self.old
            self.young.update((c, old[c]) for c in known)
            new = [c for c in new if c not in self.young]
        self._encode_new(new)
        young = self.young
        return [young[c] for c in chunks]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (with the end of the last)."""
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            got = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, "<u4"), *got]), np.cumsum([0, *map(len, got)])
        chunks = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = chunks.flatten().dictionary_encode()
        of = coded.indices.to_numpy()
        each = self._ids_of(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        begins = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(each), "<u4")
        n = size[of]
        ends = np.append(0, np.cumsum(n))
        # Where chunk k's ids go, less where they come from, is the same for all of them.
        return ids[np.arange(ends[-1]) + np.repeat(begins[of] - ends[:-1], n)], ends[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]


_ENCODERS: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(path: str, cache: int = CACHE_CHUNKS) -> ChunkEncoder:
    """This worker's encoder of a vocabulary file, one at a time: another file or cache takes the place of the last."""
    if (path, cache) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, cache] = ChunkEncoder(path, cache)
    return _ENCODERS[path, cache]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame, out_dir: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, rows_per_file: int = ROWS_PER_FILE, cache: int = CACHE_CHUNKS, batch_chars: int = BATCH_CHARS
) -> DataFrame:
    """Writes record files of ``docs`` in ascending key order under ``out_dir`` (a URI that all executors share).

    Returns the offset index, itself written there as ``index``. ``cache`` and ``batch_chars`` bound a worker's
    memory and never change a result.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    bounds = range_bounds(docs, "key", rows_per_file)
    end = np.uint32(end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = out = None
        bucket = seq = offset = first = 0
        names = ("", "")

        def close() -> None:
            out.close()
            fs.move(*names)

        for batch in batches:
            rows = []
            sizes, keys = pc.utf8_length(batch["text"]).to_pylist(), list(zip(batch["key"].to_pylist(), batch["bucket"].to_pylist(), strict=True))
            for lo, hi in batches_by_size(sizes, batch_chars, lambda n: n or 0):
                all_ids, at = encoder(vocabulary, cache).encode(batch["text"].slice(lo, hi - lo))
                for i, (k, b) in enumerate(keys[lo:hi]):
                    if out is None or b != bucket:
                        if out is not None:
                            close()
                        fs, base = _filesystem(out_dir)
                        fs.create_dir(base, recursive=True)
                        bucket, seq, offset, first = b, 0, 0, 0
                        final = f"{base}/part-{bucket:06d}.rec"
                        names = (f"{base}/_{uuid.uuid4().hex}.tmp", final)
                        out = fs.open_output_stream(names[0])
                    data = frame(k, np.append(all_ids[at[i] : at[i + 1]], end))
                    out.write(data)
                    n = int(at[i + 1] - at[i]) + 1
                    rows.append((f"{out_dir}/part-{bucket:06d}.rec", bucket, seq, k, offset, len(data), first, n))
                    seq, offset, first = seq + 1, offset + len(data), first + n
            yield pa.RecordBatch.from_pandas(frame_of(rows, INDEX_SCHEMA), preserve_index=False)
        if out is not None:
            close()

    ordered = docs.withColumn("bucket", range_bucket(F.col("key"), bounds)).repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", "key", "text").select("bucket", "key", "text")
    ordered.mapInArrow(frugal(write), INDEX_SCHEMA).write.parquet(f"{out_dir}/index")
    return docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{out_dir}/index")


def read_token_files(index: DataFrame) -> DataFrame:
    """Reads and verifies the records of the given index rows, by seeks.

    Returns ``key, bucket, first_id, n_ids, ids_crc32`` of each; damage raises.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for uri, part in pdf.groupby("file", sort=False):
                fs, path = _filesystem(uri)
                with fs.open_input_file(path) as f:
                    for b, off, n, first in part[["bucket", "offset", "length", "first_id"]].itertuples(index=False):
                        f.seek(off)
                        key, ids = unframe(f.read(n))
                        rows.append((key, b, first, len(ids) // 4, zlib.crc32(ids)))
            yield frame_of(rows, READ_SCHEMA)

    return index.mapInPandas(frugal(read), READ_SCHEMA)


def token_output(
    spark: SparkSession, docs: DataFrame, vocabulary: str, out_dir: str | None = None, key: str = "doc_id", text: str = "text", cache: int = CACHE_CHUNKS, batch_chars: int = BATCH_CHARS
) -> DataFrame:
    """Writes the files, reads them back, and returns ``key, start, n_ids, ids_crc32`` a document.

    ``start`` counts the ids of all documents before it, over all files in order.
    """
    out_dir = out_dir or shared_dir(spark, "tokens")
    index = write_token_files(docs, out_dir, vocabulary, key, text, cache=cache, batch_chars=batch_chars)
    # One row a file, of MAX_BUCKETS at most: the window over them and the broadcast are bounded.
    files = index.groupBy("bucket").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("bucket", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    back = read_token_files(index)
    return back.join(F.broadcast(files), "bucket").select("key", (F.col("base") + F.col("first_id")).alias("start"), "n_ids", "ids_crc32")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token ids with an end id, written to record files and read back."""
    import public_tokenizers

    from .common import table

    out = token_output(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


__all__ = ["ChunkEncoder", "frame", "op8_token_output", "read_token_files", "token_output", "unframe", "write_token_files"]
