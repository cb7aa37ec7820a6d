"""Token-id files with fixed-width bit packing.

Ids are stored in the minimum number of bits that the vocabulary needs.  A file
holds consecutive documents in ascending doc_id order:

    header   "TKBP", bits, ids per block                     (little endian)
    blocks   ``block_ids`` ids each, bit-packed, byte-aligned (the last may be short)
    index    per block its byte offset; per document its id and number of ids
    footer   offsets and lengths of the index, number of ids, "TKBP"

so any range of ids is read by seeking to its blocks and unpacking them with
numpy.  ``write`` orders the texts with a range partitioning by doc_id (only
the texts are shuffled), encodes and packs each partition as a stream into one
file (a task that is run again replaces its file as a whole, by rename), and
returns a manifest with one row per file.  The number of ids before each file
comes from the manifest; ``read`` unpacks files in parallel.

Encoding gives the ids of the tokenizers library (see ``byte_bpe``); special
tokens' strings in a text are special tokens.

Defined results: null and empty texts have the end id alone; rows with equal
doc_id are ordered by text, null ids first; an empty table gives no file and no
row; extra columns are ignored.  Memory holds one block, the documents' index
of a file and one Arrow batch.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelab.llm.byte_bpe import ByteBPE
from tablelab.llm.common import arrow_schema, scratch_path

MAGIC = b"TKBP"
BLOCK_IDS = 1 << 16
FILE_BYTES = 64 << 20
_HEADER, _FOOTER = "<4sII", "<QQQQ4s"


# ----------------------------------------------------------------- bit packing

def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` low bits of each id, first id in the lowest bits."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 8:
        return ids.astype("u1").tobytes()
    wide = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(wide.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype(np.uint32)
    if bits == 8:
        return np.frombuffer(data, "u1", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    return (flat.reshape(count, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def min_bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


class Writer:
    """Streams documents into one file."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.rest, self.held, self.at = [], 0, 0
        self.offsets: list[int] = []
        self.doc_ids: list = []
        self.counts: list[int] = []
        self._put(struct.pack(_HEADER, MAGIC, bits, block_ids))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self._put(pack(ids, self.bits))

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            ids = np.concatenate(self.rest)
            whole = len(ids) // self.block_ids * self.block_ids
            for a in range(0, whole, self.block_ids):
                self._block(ids[a:a + self.block_ids])
            self.rest, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> int:
        if self.held:
            self._block(np.concatenate(self.rest))
        blocks = np.array(self.offsets, "<u8").tobytes()
        docs = json.dumps(self.doc_ids).encode()
        counts = np.array(self.counts, "<u8").tobytes()
        start, total = self.at, sum(self.counts)
        self._put(blocks + counts + docs)
        self._put(struct.pack(_FOOTER, start, len(self.offsets), len(self.counts), total, MAGIC))
        return total


class Reader:
    """Random access to one file; ``source`` is a seekable binary file."""

    def __init__(self, source, size: int):
        self.source = source
        magic, self.bits, self.block_ids = struct.unpack(_HEADER, self._at(0, struct.calcsize(_HEADER)))
        foot = struct.calcsize(_FOOTER)
        start, n_blocks, n_docs, self.total, end = struct.unpack(_FOOTER, self._at(size - foot, foot))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a token-id file")
        index = self._at(start, size - foot - start)
        self.offsets = np.frombuffer(index, "<u8", n_blocks)
        self.counts = np.frombuffer(index, "<u8", n_docs, 8 * n_blocks).astype(np.int64)
        self.doc_ids = json.loads(index[8 * (n_blocks + n_docs):])
        self.starts = np.cumsum(self.counts) - self.counts
        self.block_at, self.block = -1, np.zeros(0, np.uint32)

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def ids(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from the id number ``first`` of the file on."""
        out = []
        while count > 0:
            k, skip = divmod(first, self.block_ids)
            if k != self.block_at:
                n = min(self.block_ids, self.total - k * self.block_ids)
                self.block = unpack(self._at(int(self.offsets[k]), -(-n * self.bits // 8)), self.bits, n)
                self.block_at = k
            part = self.block[skip:skip + count]
            out.append(part)
            first, count = first + len(part), count - len(part)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.counts[k]))


# -------------------------------------------------------------------- encoding

_ENCODERS: dict[str, ByteBPE] = {}


def encoder(tokenizer_file: str) -> ByteBPE:
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = ByteBPE(tokenizer_file, special_is_text=False)
    return _ENCODERS[tokenizer_file]


# ------------------------------------------------------------------ Spark jobs

_MANIFEST = "part int, file string, n_docs long, n_ids long"


def write(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int = 0,
          partitions: int | None = None) -> DataFrame:
    """Write the files below ``folder`` (a URI that all executors reach) and
    return the manifest table (read from ``folder/manifest``)."""
    spark = docs.sparkSession
    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if partitions is None:
        size = df.select(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(1, -(-size // FILE_BYTES), min(spark.sparkContext.defaultParallelism, size >> 20))
    ordered = df.repartitionByRange(int(partitions), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc, writer, name = encoder(tokenizer_file), None, f"part-{part:06d}.tkbp"
        system, base = fs.FileSystem.from_uri(folder)
        temp, out = f"{base}/.{name}.{uuid.uuid4().hex}", None
        for b in batches:
            if b.num_rows and writer is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(temp)
                writer = Writer(out, min_bits(len(enc.pieces)))
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for lo in range(0, len(ids), 256):
                for doc_id, got in zip(ids[lo:lo + 256], enc.encode([t or "" for t in texts[lo:lo + 256].to_pylist()])):
                    writer.add(doc_id, np.array([*got, end_id], np.uint32))
        if writer is not None:
            total = writer.close()
            out.close()
            system.move(temp, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([name]), pa.array([len(writer.counts)], pa.int64()),
                 pa.array([total], pa.int64())], names=["part", "file", "n_docs", "n_ids"])

    ordered.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    # one row per file: the prefix sum runs over the number of files
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("part", "file", F.coalesce(before, F.lit(0)).alias("start"))
    n, out = max(1, files.count()), arrow_schema(spark, f"doc_id {id_type}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        kind = out.field(0).type
        for b in batches:
            for name, start in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                path = f"{base}/{name}"
                with system.open_input_file(path) as source:
                    r = Reader(source, system.get_file_info(path).size)
                    for lo in range(0, len(r.counts), 10_000):
                        of = range(lo, min(lo + 10_000, len(r.counts)))
                        crc = [zlib.crc32(r.document(k).astype("<u4").tobytes()) for k in of]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r.doc_ids[k] for k in of], kind), pa.array(start + r.starts[of.start:of.stop]),
                             pa.array(r.counts[of.start:of.stop]), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return (files.repartition(n, "part")
            .mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI; one without a scheme is in the cluster's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_and_read(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """Integer and text ids keep their type, others become text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if id_type not in ("tinyint", "smallint", "int", "bigint"):
        docs, id_type = docs.withColumn("doc_id", F.col("doc_id").cast("string")), "string"
    folder = qualified(docs.sparkSession, scratch_path(docs.sparkSession, "token-files"))
    write(docs, tokenizer_file, folder, end_id)
    return read(docs.sparkSession, folder, id_type)
