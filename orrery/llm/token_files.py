"""Token ids in seekable zstandard files: one independent frame per document.

A file is a run of zstandard frames, each the ids of one document as
little-endian unsigned 32-bit integers, then a skippable frame with the document
ids, then the trailing seek table of the public seekable format: a skippable
frame with compressed size, decompressed size and checksum (low 32 bits of
XXH64) of every frame before it.  A reader seeks to the footer, finds the frames
of the documents it wants and decompresses only those; each frame is checked.
Any zstandard tool can also decompress a file as a whole.

Documents are tokenised and compressed where they lie, only the frames are
shuffled to files by ranges of doc_id.  A file is written under a name of its
attempt and then renamed, so a task that is run again leaves one whole file.

Defined cases: null texts are empty and hold the end id only; null ids come
first; rows that repeat an id each get a frame, in a stable order of content; an
empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._text import body
from orrery.llm._tokens import encoded, vocabulary
from orrery.storage import discard, in_arrow, new_path, stored

# Fixed values of the public seekable zstandard format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
INDEX = 0x184D2A50
LEVEL = 3
#: Bytes of text that a file holds, about.
SHARD_BYTES = 256 << 20
MANIFEST = "shard int, path string, documents long, ids long"


def _frames(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        for rows, flat, ptr in encoded(batches, path):
            raw = memoryview(flat.astype("<u4").tobytes())
            parts = [raw[4 * a : 4 * b] for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
            yield pa.record_batch(
                [rows.column("doc_id"), rows.column("salt"), pa.array([pack.compress(p) for p in parts], pa.binary()), pa.array(np.diff(ptr)), pa.array([xxhash.xxh64_intdigest(p) & 0xFFFFFFFF for p in parts], pa.int64())],
                names=["doc_id", "salt", "frame", "n_tokens", "check"],
            )

    return run


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _close(out, ids: list[int | None], sizes: list[tuple[int, int, int]]) -> None:
    index = struct.pack("<I", len(ids)) + np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], "<u1").tobytes()
    out.write(struct.pack("<II", INDEX, len(index)) + index)
    rows = [*sizes, (8 + len(index), 0, 0)]
    table = b"".join(struct.pack("<III", *r) for r in rows) + struct.pack("<IBI", len(rows), 0x80, SEEKABLE)
    out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def _write(folder: str):
    """One file of the rows of a partition, numbered as the partition is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = _filesystem(folder)
        shard, out, ids, sizes = TaskContext.get().partitionId(), None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    temp = f"{root}/_writing-{shard}-{uuid.uuid4().hex}"
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(temp)
                out.write(row["frame"])
                ids.append(row["doc_id"])
                sizes.append((len(row["frame"]), 4 * row["n_tokens"], row["check"]))
        if out is not None:
            _close(out, ids, sizes)
            out.close()
            name = f"shard-{shard:06d}.ids.zst"
            files.move(temp, f"{root}/{name}")
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(ids)]), pa.array([sum(s[1] for s in sizes) // 4])], names=["shard", "path", "documents", "ids"])

    return run


def write_token_files(docs: DataFrame, folder: str | None = None, shards: int | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files (to a new place in the shared folder by default); the manifest has a row per file.

    There are as many files as leave each about ``SHARD_BYTES`` of text (or
    ``shards``), in ranges of doc_id and, within an id that many rows repeat, of a hash
    of the text, so no id has to lie in one file.  The driver holds a row a file.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    if shards is None:
        size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col))
    frames = keyed.withColumn("salt", F.xxhash64("body")).transform(in_arrow, _frames(tokenizer or vocabulary()), "doc_id long, salt long, frame binary, n_tokens long, check long")
    frames = stored(frames, "frames")  # ranges are found by a sample, which would tokenise everything twice
    order = [F.col("doc_id").asc_nulls_first(), "salt", "check", "n_tokens"]
    placed = frames.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)
    rows = placed.transform(in_arrow, _write(folder), MANIFEST).collect()
    discard(frames)
    return spark.createDataFrame(sorted(rows), MANIFEST)


class TokenFile:
    """Random access to one file: only the frames asked for are read and decompressed."""

    def __init__(self, path: str):
        files, inner = _filesystem(path)
        self.file = files.open_input_file(inner)
        end = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError(f"{path} has no seek table with checksums")
        table = np.frombuffer(self.file.read_at(12 * count, end - 9 - 12 * count), "<u4").reshape(-1, 3)
        self.sizes = table[:-1].astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])
        index = self.file.read_at(int(table[-1, 0]) - 8, int(self.at[-1]) + 8)
        n = struct.unpack_from("<I", index)[0]
        null = np.frombuffer(index, np.uint8, n, 4 + 8 * n)
        self.doc_ids = [None if x else int(i) for i, x in zip(np.frombuffer(index, "<i8", n, 4), null, strict=True)]
        self.unpack = zstandard.ZstdDecompressor()

    def ids(self, frame: int) -> np.ndarray:
        """The ids of one document, after its checksum has been compared."""
        raw = self.unpack.decompress(self.file.read_at(int(self.sizes[frame, 0]), int(self.at[frame])), max_output_size=int(self.sizes[frame, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.sizes[frame, 2]):
            raise ValueError(f"frame {frame} is damaged")
        return np.frombuffer(raw, "<u4")


def _read(wanted: frozenset | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, start, out = TokenFile(row["path"]), row["start"], []
                starts = start + np.concatenate([[0], np.cumsum(file.sizes[:, 1] // 4)])
                for k, doc in enumerate(file.doc_ids):
                    if wanted is None or doc in wanted:
                        ids = file.ids(k)
                        out.append((doc, int(starts[k]), len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32) if with_ids else None))
                    if out and (len(out) >= 2000 or k + 1 == len(file.doc_ids)):
                        yield _rows(out, with_ids)
                        out = []
                if out:
                    yield _rows(out, with_ids)

    return run


def _rows(out: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
    if with_ids:
        arrays.append(pa.array(cols[4], pa.list_(pa.int32())))
    return pa.record_batch(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])


def read_token_files(manifest: DataFrame, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids in all files before it), n_tokens, ids_crc32 and ids, read from the files.

    With ``doc_ids`` only their frames are decompressed.
    """
    spark, start, rows = manifest.sparkSession, 0, []
    for r in manifest.orderBy("shard").collect():  # a row per file
        rows.append((r["path"], start))
        start += r["ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not rows:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(rows, "path string, start long").repartition(len(rows), "path")
    return files.transform(in_arrow, _read(None if doc_ids is None else frozenset(doc_ids), with_ids), schema)
