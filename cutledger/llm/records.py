"""Token ids in length-delimited binary records, with checksums and a separate offset index.

A file holds documents in ascending id order. Each record is its payload's length (8 bytes), the
masked CRC-32 of those bytes (4), the payload, and the payload's masked CRC-32 (4), little-endian.
A payload is the document's id (8), flags (1: the id is null), the width of an id in bytes, then
the ids. Beside `x.rec` lies `x.idx` with the place of every record (8 bytes each), so records can
be read in any order. A table lists the files: only what it lists is part of the data, so what a
lost or repeated task left behind is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutledger.llm.common import documents, stored, text_of
from cutledger.llm.tokens import END, encoder, runs, vocabulary_path
from cutledger.session import scratch_path

LENGTH, SUM, HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB")
MANIFEST = "part bigint, path string, n_docs bigint, n_tokens bigint, n_bytes bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def masked(data: bytes) -> bytes:
    """CRC-32, turned and shifted by a constant, so that sums of data holding sums stay apart."""
    crc = zlib.crc32(data)
    return SUM.pack(((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF)


def frame(payload: bytes) -> bytes:
    length = LENGTH.pack(len(payload))
    return b"".join((length, masked(length), payload, masked(payload)))


def payload_at(file) -> bytes | None:
    """The next record's payload; None at the end. A record that fails its sums is an error."""
    head = file.read(LENGTH.size + SUM.size)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != head[8:]:
        raise ValueError("broken record head")
    n = LENGTH.unpack(head[:8])[0]
    body = file.read(n + SUM.size)
    if len(body) < n + 4 or masked(body[:n]) != body[n:]:
        raise ValueError("broken record")
    return body[:n]


def _write(folder: str, path: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
    encode = encoder(path)
    end, width = np.array([END], encode.dtype).tobytes(), encode.dtype.itemsize
    docs = tokens = at = 0
    with store.open_output_stream(f"{name}.rec") as data, store.open_output_stream(f"{name}.idx") as index:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in runs(pc.utf8_length(texts).to_pylist()):
                for doc, coded in zip(ids[a:b], encode(texts.slice(a, b - a).to_pylist()), strict=True):
                    record = frame(HEAD.pack(doc or 0, doc is None, width) + coded + end)
                    index.write(LENGTH.pack(at))
                    data.write(record)
                    docs, tokens, at = docs + 1, tokens + len(coded) // width + 1, at + len(record)
    yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name.rpartition('/')[2]}.rec"], "n_docs": [docs], "n_tokens": [tokens], "n_bytes": [at]})


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and write `docs` below `folder`, which all executors reach; gives the table of files.

    Rows are dealt by ranges of their id and sorted within (null ids first; rows of one id by
    their text), so that files in order of `part` hold all documents in ascending order. A null
    text is an empty one: the end id alone.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(ordered.mapInArrow(partial(_write, folder, path or vocabulary_path()), MANIFEST), "token-files")


def _reader(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, name = fs.FileSystem.from_uri(path)
            rows, size = [], 0
            with store.open_input_stream(name, buffer_size=1 << 20) as file:
                while (payload := payload_at(file)) is not None:
                    doc, null, width = HEAD.unpack_from(payload)
                    ids = np.frombuffer(payload, f"<u{width}", offset=HEAD.size)
                    rows.append((None if null else doc, start, len(ids), ids.astype("<u4").tobytes()))
                    start, size = start + len(ids), size + 4 * len(ids)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def read(files: DataFrame) -> DataFrame:
    """All documents of the files: doc_id, start (ids before it), n_tokens, ids (32-bit, little-endian)."""
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.where("n_docs > 0").select("path", F.coalesce(before, F.lit(0)).alias("start"), "n_bytes")
    spread = placed.repartitionByRange(max(1, files.where("n_docs > 0").count()), "start").select("path", "start")
    return spread.mapInArrow(_reader, ROWS)


def _places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, name = fs.FileSystem.from_uri(path)
            number = 0
            with store.open_input_stream(name.removesuffix(".rec") + ".idx", buffer_size=1 << 20) as file:
                while data := file.read(8 * 100_000):
                    at = np.frombuffer(data, "<i8")
                    n = len(at)
                    yield pa.RecordBatch.from_pydict(
                        {"part": np.full(n, part), "path": pa.array([path]).take(pa.array(np.zeros(n, np.int32))), "number": np.arange(number, number + n), "at": at}
                    )
                    number += n


def places(files: DataFrame) -> DataFrame:
    """Every record of the files as their indexes tell: part, path, number (in its file, from 0), at (byte)."""
    listed = files.where("n_docs > 0").select(F.col("part").cast("bigint").alias("part"), "path")
    return listed.repartition("path").mapInArrow(_places, "part bigint, path string, number bigint, at bigint")


def _fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["part", "number", "doc_id", "n_tokens", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    opened, file, rows, size = None, None, [], 0

    def out() -> pa.RecordBatch:
        nonlocal rows, size
        got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        rows, size = [], 0
        return got

    for batch in batches:
        for part, path, number, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if path != opened:
                if file is not None:
                    file.close()
                store, name = fs.FileSystem.from_uri(path)
                opened, file = path, store.open_input_file(name)
            file.seek(at)
            payload = payload_at(file)
            doc, null, width = HEAD.unpack_from(payload)
            ids = np.frombuffer(payload, f"<u{width}", offset=HEAD.size)
            rows.append((part, number, None if null else doc, len(ids), ids.astype("<u4").tobytes()))
            size += 4 * len(ids)
            if size > 4_000_000:
                yield out()
    if file is not None:
        file.close()
    if rows:
        yield out()


def fetch(wanted: DataFrame) -> DataFrame:
    """The given records alone, each by one seek: part, number, doc_id, n_tokens, ids, in the order of `wanted`.

    `wanted` has rows of places(), in any order and as often as they are wanted; a task opens a
    file again where its rows leave one file for another.
    """
    return wanted.select("part", "path", "number", "at").mapInArrow(_fetch, "part bigint, number bigint, doc_id bigint, n_tokens bigint, ids binary")


def shuffled(files: DataFrame, seed: str, partitions: int) -> DataFrame:
    """All records in an order that the seed alone decides: hashes deal the places to `partitions` and sort them there.

    Only places move; each task then reads its records through the index.
    """
    turn = F.xxhash64(F.lit(seed), "part", "number")
    order = places(files).withColumn("turn", turn).repartition(partitions, F.col("turn")).sortWithinPartitions("turn", "part", "number")
    return fetch(order)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(documents(spark, sf_dir), scratch_path(spark, "tokens"))
    return read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
