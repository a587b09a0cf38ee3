"""Token ids as length-delimited binary records, with an offset index beside each file.

A data file is a run of frames; nothing lies between them:

    length    8 bytes, unsigned, little-endian: bytes of the payload
    check     4 bytes: masked checksum of the length's 8 bytes
    payload   1 byte: 1 if the document has an id, else 0; 8 bytes: the id, signed; then the token ids, unsigned
    check     4 bytes: masked checksum of the payload

A token id takes 2 bytes where the vocabulary and the end id fit into 16 bits, else 4. Checksums are CRC-32, turned
right by 15 bits and raised by a constant, so that a checksum stored in data is not its own check. The index holds,
for each frame, its byte offset and its number of token ids (8 bytes each, unsigned), so a reader can start at any
frame, and what comes before a document is known without reading it. Byte order is little-endian throughout.

Files are in ascending order of ids, as are the frames in them. A task writes files of its own name and reports them
in the manifest; a repeated task writes others, and only those that the manifest names belong to the set.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mentionmill.llm.tables import Table, shared_folder
from mentionmill.llm.tokens import word_encoder

#: Data bytes after which a task goes on in a new file.
FILE_BYTES = 64_000_000
#: Files whose places are summed in one window; sums of such blocks are summed again.
BLOCK_FILES = 1024
#: Frames that a reading task checks at once, in bytes; a longer frame is read alone.
READ_BYTES = 8_000_000
#: Tasks that read files back, at most; beyond, a task reads several files, one after the other.
READ_TASKS = 20_000

_FRAME, _CHECK, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<?q")
# Fixed value: what is added to a turned checksum.
MASK_DELTA = 0xA282EAD8


def masked_checksum(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray) -> bytes:
    """One document's frame; ``ids`` has the type that the file keeps."""
    payload = _HEAD.pack(key is not None, key or 0) + ids.tobytes()
    length = _FRAME.pack(len(payload))
    return b"".join((length, _CHECK.pack(masked_checksum(length)), payload, _CHECK.pack(masked_checksum(payload))))


def unframed(data: memoryview, at: int, kind: str) -> tuple[int | None, np.ndarray, int]:
    """(key, ids, place behind) of the frame at ``at``; an error if a checksum or a length is wrong."""
    head = bytes(data[at : at + 8])
    if len(head) < 8 or _CHECK.unpack_from(data, at + 8)[0] != masked_checksum(head):
        raise ValueError(f"damaged length at byte {at}")
    size = _FRAME.unpack(head)[0]
    payload = bytes(data[at + 12 : at + 12 + size])
    if len(payload) < size or _CHECK.unpack_from(data, at + 12 + size)[0] != masked_checksum(payload):
        raise ValueError(f"damaged record at byte {at}")
    known, key = _HEAD.unpack_from(payload)
    return key if known else None, np.frombuffer(payload, dtype=kind, offset=_HEAD.size), at + 16 + size


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme, or with file:, is one on a mounted disk."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return fs.FileSystem.from_uri(uri)


class _Writer:
    """One data file and its index, written side by side."""

    def __init__(self, folder: str) -> None:
        self.name = uuid.uuid4().hex
        self.system, base = _opened(folder)
        self.data = self.system.open_output_stream(f"{base}/{self.name}.rec")
        self.index_path = f"{base}/{self.name}.idx"
        self.at, self.ids, self.entries = 0, 0, []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        made = frame(key, ids)
        self.data.write(made)
        self.entries.append((self.at, len(ids)))
        self.at += len(made)
        self.ids += len(ids)

    def close(self) -> None:
        self.data.close()
        with self.system.open_output_stream(self.index_path) as out:
            out.write(np.array(self.entries, dtype="<u8").tobytes())


@dataclass(frozen=True)
class RecordSet:
    """Files in ``folder`` and the table that names them (part, file, records, ids, data_bytes)."""

    folder: str
    manifest: Table
    kind: str


def write_records(df: DataFrame, doc: str, text: str, tokenizer: str, end_id: int, folder: str | None = None) -> RecordSet:
    """Write every text's ids, with ``end_id`` behind them, in ascending order of ``doc``.

    ``doc`` is a column of whole numbers. Null ids come last; documents with one id are in the order of a hash of
    their texts; repeated rows are written as often. A null or empty text is its end id alone. No rows, no files.
    The folder must be one that all machines share; by default it is a new one in the folder for intermediate tables.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/records-{uuid.uuid4().hex}"
    _make_folder(spark, folder)
    kind = "<u2" if max(end_id, word_encoder(tokenizer).largest) < 1 << 16 else "<u4"
    order = [F.col("doc").asc_nulls_last(), F.xxhash64("text")]
    placed = df.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, end = word_encoder(tokenizer), np.array([end_id], dtype=kind)
        writer, number = None, 0

        def done() -> pa.RecordBatch:
            writer.close()
            values = (part, number, writer.name, len(writer.entries), writer.ids, writer.at)
            return pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))], schema=schema)

        names = ["part", "number", "file", "records", "ids", "data_bytes"]
        schema = pa.schema([(n, pa.string() if n == "file" else pa.int64()) for n in names])
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer = writer or _Writer(folder)
                writer.add(key, np.concatenate([encoder.ids(value.as_py()).astype(kind), end]))
                if writer.at >= FILE_BYTES:
                    yield done()
                    writer, number = None, number + 1
        if writer:
            yield done()

    fields = "part long, number long, file string, records long, ids long, data_bytes long"
    return RecordSet(folder, Table(placed.mapInArrow(write, fields)), kind)


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def _with_starts(manifest: DataFrame) -> DataFrame:
    """Each file with the token ids of all files before it."""
    block = F.floor(F.col("part") / BLOCK_FILES)
    inside = Window.partitionBy("block").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("block", block)
    blocks = files.groupBy("block").agg(F.sum("ids").alias("of_block"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("of_block").over(earlier), F.lit(0))).drop("of_block")
    placed = files.withColumn("start", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    return placed.join(blocks, "block").withColumn("start", F.col("start") + F.col("before")).drop("block", "before")


def read_records(spark: SparkSession, records: RecordSet) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) of every record, read back by the index and checked.

    start counts the ids of all records before it; the checksum is CRC-32 over the ids as unsigned numbers of 32 bits,
    little-endian. Files can be read in any order; a damaged or incomplete one is an error.
    """
    folder, kind = records.folder, records.kind

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        for batch in batches:
            for name, start, expected in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "records")), strict=True):
                with system.open_input_file(f"{base}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), dtype="<u8").reshape(-1, 2).astype(np.int64)
                if len(index) != expected:
                    raise ValueError(f"the index of {name} has {len(index)} of {expected} records")
                with system.open_input_file(f"{base}/{name}.rec") as data:
                    bounds = np.append(index[:, 0], data.size())
                    first = 0
                    while first < len(index):
                        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + READ_BYTES, side="right")) - 1)
                        data.seek(int(bounds[first]))
                        body = memoryview(data.read(int(bounds[last] - bounds[first])))
                        keys, sums = [], []
                        for i in range(first, last):
                            key, ids, end = unframed(body, int(bounds[i] - bounds[first]), kind)
                            if len(ids) != index[i, 1] or end != bounds[i + 1] - bounds[first]:
                                raise ValueError(f"record {i} of {name} is not as long as its index says")
                            keys.append(key)
                            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        n = index[first:last, 1]
                        starts = start + np.cumsum(n) - n
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys, pa.int64()), pa.array(starts), pa.array(n), pa.array(sums, pa.int64())],
                            names=["doc", "start", "n_tokens", "ids_crc32"],
                        )
                        start, first = start + int(n.sum()), last

    files = _with_starts(records.manifest.df).select("file", "start", "records")
    # The manifest is small beside what it names, so the number of tasks is given: one for each file, up to READ_TASKS.
    tasks = max(1, min(records.manifest.df.count(), READ_TASKS))
    return files.repartition(tasks, "file").mapInArrow(read, "doc long, start long, n_tokens long, ids_crc32 long")
