"""Token-id files: each document's ids compressed apart, with one dictionary shared by all documents.

A folder holds

* ``dictionary``: the zstandard dictionary, trained on serialised ids of a bounded sample;
* ``part-PPPPPP-RRRR.ids``: header, one zstandard frame per document, then the offset index and a footer;
* ``index``: a Parquet table (file, row, doc_id, offset, length, n_tokens) of all files.

Documents stand in ascending order of id over the files in order of name. A file is named by the task that
writes it, under another name until it is whole, so a task that is run again replaces its own files.
The folder must be reachable for pyarrow on every executor (a shared mount, HDFS, an object store).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyshelf.llm.common import column, join_small
from tallyshelf.llm.tokens import encoder, portions

MAGIC, END = b"TLYIDS01", b"TLYIDSND"
_HEAD, _FOOT = struct.Struct("<8s32sB"), struct.Struct("<QI8s")
HEAD_BYTES = _HEAD.size
_ENTRY = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4")])
#: The dictionary is trained on the ids of at most so many documents, of each at most so many bytes.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 16 * 1024, 64 * 1024
#: A file is closed when it has grown to this size.
FILE_BYTES = 16 * 1024 * 1024
LEVEL = 3


def _open(folder: str):
    """File system and path of a folder given as a path or URI."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return pyarrow.fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, parts: Sequence[bytes]) -> None:
    fs, path = _open(folder)
    aside = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(aside, compression=None) as out:
        for part in parts:
            out.write(part)
    fs.move(aside, f"{path}/{name}")


def _get(folder: str, name: str) -> bytes:
    fs, path = _open(folder)
    with fs.open_input_stream(f"{path}/{name}", compression=None) as file:
        return file.read()


def train(samples: list[bytes]) -> bytes:
    """A dictionary for ids like ``samples``; their own bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _file(frames: list[bytes], entries: list[tuple], digest: bytes, width: int) -> list[bytes]:
    index = np.array(entries, _ENTRY).tobytes()
    at = HEAD_BYTES + sum(map(len, frames))
    return [_HEAD.pack(MAGIC, digest, width), *frames, index, _FOOT.pack(at, len(entries), END)]


def read_index(tail: bytes, size: int) -> tuple[np.ndarray, int]:
    """Index entries from the end of a file of ``size`` bytes, and where the index starts."""
    at, n, end = _FOOT.unpack(tail[-_FOOT.size:])
    if end != END or size - at != n * _ENTRY.itemsize + _FOOT.size:
        raise ValueError("not a whole file of token ids")
    start = at - (size - len(tail))
    return np.frombuffer(tail, _ENTRY, n, start), at


def _header(head: bytes, dictionary: bytes) -> np.dtype:
    magic, digest, width = _HEAD.unpack(head[:HEAD_BYTES])
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a file of token ids, or one of another dictionary")
    return np.dtype(f"<u{width}")


_INDEX = "file string, row bigint, doc_id bigint, offset bigint, length bigint, n_tokens bigint"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write the files of a new folder.

    A null text is empty and has its end id alone; null ids come first; rows of one id stand together by
    a hash of their text, repeated rows each have their entry. An empty table makes no file. Other
    columns are left out. A task holds one unfinished file in memory, not its partition.
    """
    spark = docs.sparkSession
    rows = docs.select(column(key).cast("bigint").alias("doc_id"), column(text).alias("text"))
    chosen = F.xxhash64("doc_id")
    cut = rows.select(chosen.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for batch in batches:
            for part in portions(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_BYTES] for x in known.encode(part)], pa.binary())], ["ids"])

    found = [] if cut is None else rows.filter(chosen <= cut).limit(SAMPLE_DOCS).mapInArrow(samples, "ids binary").collect()
    dictionary = train(sorted(bytes(r["ids"]) for r in found if r["ids"]))
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    _put(folder, "dictionary", [dictionary])
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, data = encoder(tokenizer), shared.value
        digest, held = hashlib.sha256(data).digest(), _dictionary(data)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=held)
        end = np.array([end_id], known.type).tobytes()
        task, roll, row = TaskContext.get().partitionId(), 0, 0
        frames: list[bytes] = []
        entries: list[tuple] = []
        at = HEAD_BYTES

        def close() -> pa.RecordBatch:
            name = f"part-{task:06d}-{roll:04d}.ids"
            _put(folder, name, _file(frames, entries, digest, known.type.itemsize))
            e = np.array(entries, _ENTRY)
            n = len(e)
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array(np.arange(n)), pa.array(e["doc_id"], mask=e["has_id"] == 0),
                 pa.array(e["offset"].astype(np.int64)), pa.array(e["length"].astype(np.int64)), pa.array(e["n_tokens"].astype(np.int64))],
                ["file", "row", "doc_id", "offset", "length", "n_tokens"])

        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for part in portions(batch.column(1).to_pylist()):
                for raw in known.encode(part):
                    raw += end
                    i = next(ids)
                    frame = squeeze.compress(raw)
                    entries.append((i is not None, i or 0, at, len(frame), len(raw) // len(end)))
                    frames.append(frame)
                    at += len(frame)
                    if at >= FILE_BYTES:
                        yield close()
                        frames, entries, at, roll = [], [], HEAD_BYTES, roll + 1
        if entries:
            yield close()

    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(run, _INDEX).write.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in the files: doc_id, start (ids in all documents before it), n_tokens, ids_crc32 and
    the ids themselves as little-endian unsigned 32-bit numbers, in ``ids``."""
    dictionary = spark.sparkContext.broadcast(_get(folder, "dictionary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary.value))
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                content = content.as_py()
                kind = _header(content, dictionary.value)
                entries, _ = read_index(content, len(content))
                starts = np.cumsum(entries["n_tokens"], dtype=np.int64) - entries["n_tokens"]
                for k in range(0, len(entries), 256):
                    part, raw = entries[k:k + 256], []
                    for e in part:
                        frame = content[int(e["offset"]):int(e["offset"]) + int(e["length"])]
                        raw.append(np.frombuffer(expand.decompress(frame), kind).astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.as_py().rsplit("/", 1)[-1]] * len(part)), pa.array(part["doc_id"], mask=part["has_id"] == 0),
                         pa.array(starts[k:k + 256]), pa.array([len(x) // 4 for x in raw], pa.int64()),
                         pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                        ["file", "doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    # One row per file, however many documents; their running total is a window over the file list.
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    files = files.select("file", before.alias("before"))
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
    rows = held.mapInArrow(run, "file string, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return join_small(rows, files, ["file"], "inner", 128).select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def fetch(spark: SparkSession, folder: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ids (doc_id, ids as array<bigint>) of some documents: only their frames are read, by the index."""
    dictionary = spark.sparkContext.broadcast(_get(folder, "dictionary"))
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    asked = wanted.select(column(key).cast("bigint").alias("doc_id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary.value))
        fs, path = _open(folder)
        name, file, kind = None, None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != name:
                    name, file = r["file"], fs.open_input_file(f"{path}/{r['file']}")
                    kind = _header(file.read_at(HEAD_BYTES, 0), dictionary.value)
                out.append(np.frombuffer(expand.decompress(file.read_at(r["length"], r["offset"])), kind).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x.tolist() for x in out], pa.list_(pa.int64()))], ["doc_id", "ids"])

    found = index.join(asked, "doc_id", "left_semi").select("file", "offset", "length", "doc_id")
    return found.sortWithinPartitions("file", "offset").mapInArrow(run, "doc_id bigint, ids array<bigint>")
