"""Vectorised word splitting and hashing over Arrow batches, shared by the operators.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, after
lower-casing A-Z only.  Words are known by 64-bit hashes: a polynomial over
random byte codes, finished by a bit mixer.  All of it runs in numpy on the
Arrow buffers, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODES = np.random.default_rng(0x5EED).integers(1, 2**64 - 1, 256, dtype=U64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
#: Texts are taken in blocks of about this many bytes.
BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that every output bit depends on all input bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, BLOCK + 4096)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a block of texts: text i owns words[ptr[i]:ptr[i + 1]]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    ptr: np.ndarray

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.ptr)


def _split_part(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, hash_spans(data, start, end)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans; equal bytes, equal hashes."""
    forward, backward = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_CODES[data] * forward[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * backward[start])


def split_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Lower-case ``data`` (uint8) and split it; ``bounds`` are the offsets of the texts.

    Long stretches are cut at white space, so that working memory stays a small
    multiple of ``BLOCK`` plus 24 bytes a word (more only for a single huge word).
    """
    data = LOWER[data]
    parts, at = [], 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while to < len(data):
            gaps = np.flatnonzero(SPACE[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
                break
            to = min(len(data), to + BLOCK)
        s, e, h = _split_part(data[at:to], bounds - at)
        parts.append((s + at, e + at, h))
        at = to
    if parts:
        start, end, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        start = end = np.zeros(0, np.int64)
        hashes = np.zeros(0, U64)
    return Words(data, start, end, hashes, np.searchsorted(start, bounds))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets of a binary Arrow column; nulls are empty."""
    if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, at, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK, column: str = "body") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows with about ``limit`` bytes of text; a longer text comes alone."""
    for batch in batches:
        data, bounds = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
            at = to


def body(name: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias("body")


def take_pieces(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0]+1, ... for each piece in turn."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    heads = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - heads, length)


class HashIndex:
    """Positions of 64-bit keys in a sorted array: one probe, with a search for the few clashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(U64))
        bits = max(4, int(np.ceil(np.log2(max(1, len(self.keys)) * 4))))
        self.shift = U64(64 - bits)
        slots = (mix(self.keys) >> self.shift).astype(np.int64)
        self.table = np.full(1 << bits, -1, np.int32)
        self.table[slots] = np.arange(len(self.keys), dtype=np.int32)
        self.full = np.zeros(1 << bits, bool)
        self.full[slots[self.table[slots] != np.arange(len(self.keys))]] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash among the sorted keys, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        slots = (mix(h) >> self.shift).astype(np.int64)
        got = self.table[slots].astype(np.int64)
        hit = (got >= 0) & (self.keys[got] == h)
        out = np.where(hit, got, -1)
        rest = np.flatnonzero(~hit & self.full[slots])
        if len(rest):
            at = np.minimum(np.searchsorted(self.keys, h[rest]), len(self.keys) - 1)
            out[rest] = np.where(self.keys[at] == h[rest], at, -1)
        return out


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(name).cast("string")) % modulus
