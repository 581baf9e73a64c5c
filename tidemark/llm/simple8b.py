"""Simple-8b: word-aligned coding of ids, and token files made of it.

A 64-bit word has a 4-bit selector and 60 bits that hold as many ids as fit at one width. Selector 15 is
an escape: one id, whole, in the next word. Ids are coded in runs of `RUN`, each of which starts a word;
an offset for each run lets a reader decode any of them alone, and all words of one selector at once.

A token file is a Parquet table (so that any store and any lost task are the writer's affair) with a row
for each chunk: shard, chunk, ids_before (of the shard's earlier chunks), n_ids, payload. Shards are
ranges of doc_id in order; in a shard, chunks and their documents are in ascending order of doc_id.

payload, little-endian: 4 bytes "TS8B"; u32 documents, u32 runs, u32 words, u64 ids; then i64 doc_id and
u32 length of each document (a null doc_id has the top bit of its length set); u32 start of each run in words; the words.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch
from .bpe import Codec, raw_ids, read_vocabulary

MAGIC, HEAD, RUN, ESCAPE = b"TS8B", struct.Struct("<4sIIIQ"), 16384, 15
#: (ids in a word, bits of each), from the most ids down; the place is the selector.
WIDTHS = [(60 // bits, bits) for bits in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)]
#: Ids of a word by selector.
TAKES = np.array([many for many, _ in WIDTHS] + [0, 1])
#: Ids after which a chunk is closed.
CHUNK = 1 << 18
NULL_ID = 1 << 31
#: Bytes of a stored table that make a shard.
SHARD_BYTES = 64 << 20


def selectors(bits: np.ndarray) -> np.ndarray:
    """For each place of a run, given the widths of its ids: the selector of a word that starts there."""
    n = len(bits)
    widest, span = np.concatenate([bits, np.full(60, 255, np.uint8)]), 1  # widest[i]: of ids i to i + span - 1
    passed = np.zeros(n, np.uint8)  # more ids in fewer bits fit only where fewer ids in more bits do
    for many, width in reversed(WIDTHS):
        while span < many:
            step = min(span, many - span)
            widest = np.maximum(widest[:-step], widest[step:])
            span += step
        fits = widest[:n] <= width
        if many > 1 and not fits.any():
            break
        passed += fits
    return np.where(passed, len(WIDTHS) - passed, ESCAPE).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, and the word where each run of RUN ids starts. ids are unsigned."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    edges = np.array([width for _, width in WIDTHS] + [64], np.uint8)
    bits = edges[np.searchsorted(np.array([1 << width for width in edges[:-1].tolist()], np.uint64), ids, "right")]
    starts, kinds = [], []
    for run in range(0, n, RUN):
        best = selectors(bits[run : run + RUN])
        jump, at, size, own = TAKES[best].tolist(), 0, len(best), []
        while at < size:
            own.append(at)
            at += jump[at]
        own = np.array(own)
        kinds.append(best[own])
        starts.append(own + run)
    kind, starts = np.concatenate(kinds), np.concatenate(starts)
    size = 1 + (kind == ESCAPE)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[place] = kind.astype(np.uint64) << np.uint64(60)
    for selector, (many, width) in enumerate(WIDTHS):
        own = np.nonzero(kind == selector)[0]
        if len(own):
            at, first = place[own], starts[own]
            held = words[at]
            for k in range(many):
                held |= ids[first + k] << np.uint64(k * width)
            words[at] = held
    own = kind == ESCAPE
    words[place[own] + 1] = ids[starts[own]]
    runs = place[np.searchsorted(starts, np.arange(0, n, RUN))]
    return words, runs.astype(np.uint32)


def unpack(words: np.ndarray, runs: np.ndarray, n: int) -> np.ndarray:
    """All n ids."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    if (words >> np.uint64(60) == ESCAPE).any():
        head = np.ones(len(words), bool)
        at, ends = 0, (words >> np.uint64(60) == ESCAPE).nonzero()[0].tolist()
        for k in ends:  # an escaped id may look like an escape itself
            if k >= at:
                head[k + 1], at = False, k + 2
        place = head.nonzero()[0]
    else:
        place = np.arange(len(words))
    kind = (words[place] >> np.uint64(60)).astype(np.int64)
    many = TAKES[kind]
    to = np.cumsum(many) - many
    for selector, (count, width) in enumerate(WIDTHS):
        own = np.nonzero(kind == selector)[0]
        if len(own):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            out[to[own][:, None] + np.arange(count)] = (words[place[own]][:, None] >> shifts) & np.uint64((1 << width) - 1)
    own = kind == ESCAPE
    out[to[own]] = words[place[own] + 1]
    return out


def chunk(doc_ids: list, counts: np.ndarray, flat: np.ndarray) -> bytes:
    """The payload of documents with so many ids each, of which flat has all."""
    words, runs = pack(flat)
    lengths = counts.astype("<u4") | np.array([NULL_ID if d is None else 0 for d in doc_ids], "<u4")
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([HEAD.pack(MAGIC, len(doc_ids), len(runs), len(words), len(flat)), known.tobytes(), lengths.tobytes(), runs.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def cuts(counts: np.ndarray, most: int) -> list[int]:
    """Where chunks end: after the first documents that together have `most` ids, and so on; after the last one."""
    upto, out, before = np.cumsum(counts), [], 0
    while before < len(counts) and (at := int(np.searchsorted(upto, (upto[before - 1] if before else 0) + most, "left"))) < len(counts) - 1:
        out.append(before := at + 1)
    return [*out, len(counts)] if len(counts) else []


def parse(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their lengths, and all ids of a payload."""
    magic, docs, runs, words, n = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token chunk")
    at = HEAD.size
    known = np.frombuffer(payload, "<i8", docs, at)
    lengths = np.frombuffer(payload, "<u4", docs, at := at + 8 * docs)
    starts = np.frombuffer(payload, "<u4", runs, at := at + 4 * docs)
    body = np.frombuffer(payload, "<u8", words, at + 4 * runs)
    doc_ids = [None if x & NULL_ID else d for d, x in zip(known.tolist(), lengths.tolist(), strict=True)]
    return doc_ids, (lengths & np.uint32(NULL_ID - 1)).astype(np.int64), unpack(body.astype(np.uint64), starts, n)


class LibraryCodec(Codec):
    """The tokenizers library's model, asked once for each piece while it's remembered."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__(json.loads(spec))
        self.model = Tokenizer.from_str(spec).model

    def merge_letters(self, piece: str) -> bytes:
        return raw_ids([t.id for t in self.model.tokenize(piece)])


_codecs: dict[int, LibraryCodec] = {}


def shards_of(docs: DataFrame) -> int:
    """Shards, by the size that the table is known to have, so that none grows with the corpus; at least the session's partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, -(-size // SHARD_BYTES)) if size < 1 << 60 else own  # sizes that nobody knows are told as huge


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end: int = 2, shards: int | None = None) -> None:
    """Encodes each whole text (null: empty), appends `end`, and writes token files to path.

    Documents are in ascending order of doc_id (null first; rows that repeat a doc_id, in order of text).
    """
    spark = docs.sparkSession
    scratch.long_rows(spark)
    spec = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    n = shards or shards_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (key := hash(spec.value)) not in _codecs:
            _codecs[key] = LibraryCodec(spec.value)
        codec, shard = _codecs[key], TaskContext.get().partitionId()
        number = before = 0
        doc_ids, counts, ids = [], np.zeros(0, np.int64), np.zeros(0, "<u4")

        def closed(last: bool) -> Iterator[pa.RecordBatch]:
            """Full chunks; the rest waits for more, unless there is none."""
            nonlocal number, before, doc_ids, counts, ids
            done = 0
            for stop in cuts(counts, CHUNK):
                size = int(counts[done:stop].sum())
                if not last and size < CHUNK:
                    break
                row = [shard, number, before, size, chunk(doc_ids[done:stop], counts[done:stop], ids[:size])]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "chunk", "ids_before", "n_ids", "payload"])
                number, before, done, ids = number + 1, before + size, stop, ids[size:]
            doc_ids, counts = doc_ids[done:], counts[done:]

        for batch in batches:
            flat, own = codec.encode_all(batch.column(1).to_pylist())
            doc_ids = doc_ids + batch.column(0).to_pylist()
            counts = np.r_[counts, own + 1]
            ids = np.concatenate([ids, np.insert(flat, np.cumsum(own), end)])
            yield from closed(False)
        yield from closed(True)

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, "shard int, chunk int, ids_before long, n_ids long, payload binary").write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start: ids of all documents before it, n_tokens, ids_crc32, ids) of each document in the files."""
    files = spark.read.schema("shard int, chunk int, ids_before long, n_ids long, payload binary").parquet(path)
    total = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    first = total.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))  # a row for each shard, and a shard is of a size, so few enough to broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, lengths, ids = parse(payload)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in pairwise([0, *ends.tolist()])]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), lists], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    placed = files.join(F.broadcast(first), "shard").select((F.col("shard_start") + F.col("ids_before")).alias("start"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def round_trip(docs: DataFrame, vocabulary: str, end: int = 2) -> DataFrame:
    """Token files of docs in the shared folder, read back: (doc_id, start, n_tokens, ids_crc32, ids) for each row.

    An empty table gives none. Columns of docs other than doc_id and text are not read.
    """
    path = scratch.new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end)
    return read_tokens(docs.sparkSession, path)
