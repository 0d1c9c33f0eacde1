"""Token ids in bit- or byte-plane chunks with a chunk index.

Documents are dealt out by ranges of doc_id and sorted inside a range; each
task encodes its range once and cuts the stream of ids into blocks of a fixed
number of ids.  A block is transposed into planes (all first bytes, all second
bytes, ... or all bits 0, all bits 1, ...), each plane compressed with
zstandard.  One row of the file is one chunk: which range and block it is, how
many ids it holds, the planes with their sizes, the documents that begin in it
and the one that is open where it begins, so a chunk can be read alone.  The
chunk index, without planes, is a table of its own: it gives the first id of
every chunk counted over the whole corpus.  Spark's Parquet writer commits
both, so a task that is run again cannot leave half a file.

Defined results: a null text counts as empty and has the end id alone; equal
doc_ids are written in the order of their texts, null doc_ids first; repeated
rows repeat; an empty table gives empty files; other columns are left behind.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.chunks import PieceMemo
from quarry.llm.common import column, text_blocks, texts_of

BLOCK_IDS = 65_536
END_ID = 0
CHUNK = ("part int, chunk int, first_id bigint, n_ids int, planes array<binary>, plane_bytes array<int>, "
         "open_doc struct<doc_id:bigint,start:bigint>, docs array<struct<doc_id:bigint,start:bigint>>")


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Planes of a block of uint32 ids, compressed one by one; the lowest
    byte or bit comes first."""
    import zstandard

    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little"), axis=0, bitorder="little")
    pack = zstandard.ZstdCompressor(level=1).compress
    return [pack(np.ascontiguousarray(rows[:, k]).tobytes()) for k in range(rows.shape[1])]


def from_planes(planes: list[bytes], n_ids: int) -> np.ndarray:
    """The ids again; 4 planes are bytes, 32 are bits."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    flat = np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes], axis=1)
    if len(planes) == 32:
        bits = np.unpackbits(flat, axis=0, bitorder="little", count=n_ids)
        flat = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(flat).view("<u4").reshape(-1)


_plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
#: The letter that a byte-level vocabulary writes for each byte: visible ones stand for themselves, the others follow from 256 on.
BYTE_LETTERS = {b: b for b in _plain} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_plain)))}
LETTERS = re.compile("[ ]?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch

#: Whole texts in, the ids of each out.
Encode = Callable[[list[str]], list[np.ndarray]]

_MEMOS: dict[str, PieceMemo] = {}


def library_memo(path: str) -> PieceMemo:
    """The worker's memo over the tokenizers library, made once."""
    if path not in _MEMOS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings are ordinary text here; library_ids cuts them out first

        model = tokenizer.model

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """A piece of letters is one pre-token and goes straight to the
            library's model, which costs half; others take the whole way."""
            out = [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(BYTE_LETTERS))] if LETTERS(p) else [] for p in pieces]
            others = [i for i, ids in enumerate(out) if not ids]
            for i, got in zip(others, tokenizer.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False)):
                out[i] = got.ids
            return np.fromiter(chain.from_iterable(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out))

        _MEMOS[path] = PieceMemo(encode)
    return _MEMOS[path]


_ADDED: dict[str, Encode] = {}


def library_ids(path: str) -> Encode:
    """Whole texts to the ids that the library gives with the file as loaded
    (`add_special_tokens=False`): each added token in a text is its own id.

    The library cuts a text at its added tokens before anything else, so the
    texts are cut there first and the memo sees only what stands between.  A
    file whose added tokens also take in what is around them, or match
    normalised text, goes through the library whole."""
    if path not in _ADDED:
        memo = library_memo(path)
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = tokenizer.get_added_tokens_decoder()
        number = {t.content: np.array([i], np.uint32) for i, t in added.items()}
        cut = re.compile(f"({'|'.join(map(re.escape, sorted(number, key=len, reverse=True)))})")  # at one place the longest counts

        def whole(texts: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def ids(texts: list[str]) -> list[np.ndarray]:
            parts = [cut.split(t) if any(c in t for c in number) else [t] for t in texts]
            between = iter(memo.ids([p for some in parts for p in some[::2]]))
            return [next(between) if len(some) == 1 else np.concatenate([number[p] if k % 2 else next(between) for k, p in enumerate(some)]) for some in parts]

        _ADDED[path] = whole if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()) else ids
    return _ADDED[path]


def write_token_files(docs: DataFrame, folder: str, path: str, planes: str = "byte", block_ids: int = BLOCK_IDS, added_tokens: bool = False) -> None:
    """Encode every text and write `folder`/chunks and `folder`/index.  With
    `added_tokens` the ids are those of the library with the file as loaded;
    without, the strings of special tokens are ordinary text."""
    end = np.array([END_ID], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = library_ids(path) if added_tokens else library_memo(path).ids, TaskContext.get().partitionId()
        held = bytearray()
        chunk = written = 0
        starts: list[dict] = []
        last: dict | None = None
        open_doc: dict | None = None

        def row(data: bytes) -> pa.RecordBatch:
            nonlocal chunk, written, starts, open_doc
            ids = np.frombuffer(data, "<u4")
            packed = to_planes(ids, planes)
            out = pa.RecordBatch.from_pylist([{
                "part": part, "chunk": chunk, "first_id": written, "n_ids": len(ids), "planes": packed,
                "plane_bytes": [len(p) for p in packed], "open_doc": open_doc,
                "docs": [d for d in starts if d["start"] < written + len(ids)]}], schema=SCHEMA)
            written += len(ids)
            starts = [d for d in starts if d["start"] >= written]
            began = [d for d in out.column(7).to_pylist()[0]]
            open_doc = began[-1] if began else open_doc
            chunk += 1
            return out

        size = 4 * block_ids
        for batch in batches:
            for block in text_blocks(batch):
                for doc_id, ids in zip(column(block, "doc_id").to_pylist(), ids_of(texts_of(block))):
                    last = {"doc_id": doc_id, "start": written + len(held) // 4}
                    starts.append(last)
                    held += ids.astype("<u4").tobytes()
                    held += end
                    cut = len(held) // size * size
                    for k in range(0, cut, size):
                        yield row(bytes(held[k:k + size]))
                    del held[:cut]
        if held:
            yield row(bytes(held))

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    chunks = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text)
              .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, CHUNK))
    chunks.write.mode("overwrite").option("compression", "none").parquet(f"{folder}/chunks")
    spark = docs.sparkSession
    index = spark.read.parquet(f"{folder}/chunks").select("part", "chunk", "first_id", "n_ids", "plane_bytes")
    # one row per written range (bounded by the number of tasks): what all ranges before it hold
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (index.groupBy("part").agg(F.sum("n_ids").alias("n"))
               .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")))
    (index.join(F.broadcast(offsets), "part").select("part", "chunk", (F.col("part_start") + F.col("first_id")).alias("first_id"), "n_ids", "plane_bytes")
     .write.mode("overwrite").parquet(f"{folder}/index"))


SCHEMA = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()),
    ("planes", pa.list_(pa.binary())), ("plane_bytes", pa.list_(pa.int32())),
    ("open_doc", pa.struct([("doc_id", pa.int64()), ("start", pa.int64())])),
    ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64())])))])


def _multiply(a: int, b: int) -> int:
    """Product of two polynomials modulo CRC-32's, lowest power in the top bit."""
    out = 0
    for bit in range(31, -1, -1):
        if b >> bit & 1:
            out ^= a
        a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
    return out


def crc_join(first: int, second: int, n_bytes: int) -> int:
    """CRC-32 of two pieces of data, from their own and the second's length."""
    power, square = 1 << 31, 1 << 23  # x^0, and x^8: one byte
    while n_bytes:
        if n_bytes & 1:
            power = _multiply(power, square)
        square = _multiply(square, square)
        n_bytes >>= 1
    return _multiply(first, power) ^ second


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    Each chunk is decoded alone and gives a piece for every document in it;
    the few numbers of a document's pieces are then joined."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                data = memoryview(from_planes(chunk["planes"], chunk["n_ids"]).tobytes())
                first, end = chunk["first_id"], chunk["first_id"] + chunk["n_ids"]
                docs = ([chunk["open_doc"]] if chunk["open_doc"] else []) + chunk["docs"]
                ends = [d["start"] for d in docs[1:]] + [end]
                rows = [(d, max(d["start"], first), e) for d, e in zip(docs, ends) if e > max(d["start"], first)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk["part"]] * len(rows), pa.int32()), pa.array([d["doc_id"] for d, _, _ in rows], pa.int64()),
                    pa.array([d["start"] for d, _, _ in rows], pa.int64()), pa.array([chunk["chunk"]] * len(rows), pa.int32()),
                    pa.array([e - s for _, s, e in rows], pa.int64()),
                    pa.array([zlib.crc32(data[4 * (s - first):4 * (e - first)]) for _, s, e in rows], pa.int64())],
                    names=["part", "doc_id", "start", "chunk", "n", "crc"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc = [], []
            for parts in column(batch, "pieces").to_pylist():
                count, total = 0, 0
                for p in parts:
                    total = crc_join(total, p["crc"], 4 * p["n"]) if count else p["crc"]
                    count += p["n"]
                n.append(count)
                crc.append(total)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    chunks = spark.read.parquet(f"{folder}/chunks").select("part", "chunk", "first_id", "n_ids", "planes", "open_doc", "docs")
    starts = (spark.read.parquet(f"{folder}/index").where("chunk = 0")
              .select("part", F.col("first_id").alias("part_start")))  # one row per written range
    found = (chunks.mapInArrow(pieces, "part int, doc_id bigint, start bigint, chunk int, n bigint, crc bigint")
             .groupBy("part", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("chunk", "n", "crc"))).alias("pieces"))
             .join(F.broadcast(starts), "part")
             .select("doc_id", (F.col("part_start") + F.col("start")).alias("start"), "pieces"))
    return found.mapInArrow(joined, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
