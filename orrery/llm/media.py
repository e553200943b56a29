"""Media columns: payloads stored as baseline JPEG and read back as DC-only thumbnails.

A payload is padded with zero bytes to a positive multiple of 64 and stored as a
greyscale baseline JPEG in which every sample is one 8x8 block of constant
luminance: 64 blocks a row, DC quantiser 8, so the DC coefficient of a block is
the sample itself and the DC-only thumbnail is the payload, without loss.  Each
row of blocks is a restart interval, so damage stays within a row and rows can be
decoded side by side.  A payload over ``MAX_ROWS`` rows becomes several JPEG
streams, one after the other.

Reading parses the markers of a stream (SOF0, DQT, DHT, DRI, SOS), finds the
restart intervals, removes stuffed bytes, decodes the Huffman codes of all
intervals of a batch in step (any DC and AC tables that a stream brings; AC
values are skipped), adds up the differences and scales by the quantiser.

Defined cases: null texts are empty, and an empty payload is 64 zero bytes; equal
texts give equal values; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._text import blocks, body
from orrery.storage import in_arrow

ACROSS = 64
#: A JPEG is at most 65535 pixels high.
MAX_ROWS = 65535 // 8
UNIT = 1 << 19
# The DC luminance table of the JPEG standard (codes of each length, then categories).
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_VALUES = list(range(12))
#: The only AC symbol that is used: end of block, in one bit.
AC_COUNTS = [1] + [0] * 15
AC_VALUES = [0]


def _codes(counts: list[int], values: list[int]) -> list[tuple[int, int, int]]:
    """(length, code, value) of a Huffman table, by the standard's rule."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((length, code, values[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, bytes([0, 8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_VALUES])),
        _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_VALUES])),
        _segment(0xDD, struct.pack(">H", ACROSS)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length in bits of a whole block, for differences from -255 to 255."""
    codes, lengths = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    table = {v: (n, c) for n, c, v in _codes(DC_COUNTS, DC_VALUES)}
    for d in range(-255, 256):
        size = abs(d).bit_length()
        n, c = table[size]
        bits = d if d >= 0 else d + (1 << size) - 1
        codes[d + 255] = ((c << size) | bits) << 1  # the end of block is a zero bit
        lengths[d + 255] = n + size + 1
    return codes, lengths


_CODE, _LENGTH = _block_codes()


def _scan(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows of 64 samples, stuffed, with the offsets of the rows."""
    rows = samples.reshape(-1, ACROSS).astype(np.int64)
    diff = rows.copy()
    diff[:, 0] -= 128
    diff[:, 1:] -= rows[:, :-1]
    code, length = _CODE[diff + 255], _LENGTH[diff + 255]
    ends = np.cumsum(length, axis=1)
    used = ends[:, -1]
    size = (used + 7) >> 3
    first = np.cumsum(size) - size
    at = (ends - length) + 8 * first[:, None]
    word, room = at >> 5, 64 - (at & 31) - length
    wide = code << room.astype(np.uint64)
    n_words = int((int(size.sum()) + 3) // 4) + 2
    flat_word = word.ravel()
    heads = np.flatnonzero(np.concatenate([[True], flat_word[1:] != flat_word[:-1]]))
    packed = np.zeros(n_words, np.uint64)
    packed[flat_word[heads]] += np.add.reduceat((wide >> np.uint64(32)).ravel(), heads)
    packed[flat_word[heads] + 1] += np.add.reduceat((wide & np.uint64(0xFFFFFFFF)).ravel(), heads)
    data = packed.astype(">u4").view(np.uint8)[: int(size.sum())]
    spare = (8 * size - used).astype(np.uint8)
    data[first + size - 1] |= (np.uint8(1) << spare) - np.uint8(1)  # rows end in one bits
    full = data == 0xFF
    grown = np.concatenate([[0], np.cumsum(1 + full.astype(np.int64))])
    out = np.zeros(int(grown[-1]), np.uint8)
    out[grown[:-1]] = data
    return out, grown[np.concatenate([[0], np.cumsum(size)])]


def _marked(scan: np.ndarray, rows: np.ndarray, count: int) -> bytes:
    """Rows with restart markers between them."""
    if count == 1:
        return scan[rows[0] : rows[1]].tobytes()
    size = np.diff(rows[: count + 1])
    out = np.empty(int(size.sum()) + 2 * (count - 1), np.uint8)
    shift = np.repeat(2 * np.arange(count, dtype=np.int64), size)
    out[np.arange(int(size.sum())) + shift] = scan[rows[0] : rows[count]]
    marks = np.cumsum(size[:-1]) + 2 * np.arange(count - 1)
    out[marks] = 0xFF
    out[marks + 1] = 0xD0 + np.arange(count - 1) % 8
    return out.tobytes()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in blocks(batches, UNIT):
        size = np.diff(bounds)
        padded = np.maximum(64, -(-size // 64) * 64)
        at = np.concatenate([[0], np.cumsum(padded)])
        samples = np.zeros(int(at[-1]), np.uint8)
        samples[np.arange(len(data)) + np.repeat(at[:-1] - bounds[:-1], size)] = data
        scan, ends = _scan(samples)
        media = []
        for a, b in zip((at[:-1] // 64).tolist(), (at[1:] // 64).tolist(), strict=True):
            parts = []
            for r in range(a, b, MAX_ROWS):
                n = min(MAX_ROWS, b - r)
                parts += [_head(n), _marked(scan, ends[r : r + n + 1], n), b"\xff\xd9"]
            media.append(b"".join(parts))
        yield pa.record_batch([rows.column("doc_id"), pa.array(size), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (before padding) and media (the JPEG bytes)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col)).transform(in_arrow, _encode, "doc_id long, n_bytes long, media binary")


class Stream:
    """The header of one JPEG stream and where its restart intervals lie."""

    def __init__(self, media: bytes, at: int):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no JPEG stream starts here")
        self.dc, self.ac, self.quantiser, self.interval = {}, {}, {}, 0
        at += 2
        while True:
            marker = media[at + 1]
            size = struct.unpack_from(">H", media, at + 2)[0]
            part = media[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xC0:
                _, self.height, self.width, planes = struct.unpack_from(">BHHB", part)
                if planes != 1:
                    raise ValueError("only luminance streams are read")
                self.table = part[8]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDB:
                while part:
                    wide = part[0] >> 4
                    self.quantiser[part[0] & 15] = struct.unpack_from(">H", part, 1)[0] if wide else part[1]
                    part = part[129 if wide else 65 :]
            elif marker == 0xC4:
                while part:
                    n = sum(part[1:17])
                    (self.ac if part[0] >> 4 else self.dc)[part[0] & 15] = part[1 : 17 + n]
                    part = part[17 + n :]
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", part)[0]
            elif marker == 0xDA:
                self.tables = (self.dc[part[2] >> 4], self.ac[part[2] & 15])
                break
        self.start = at
        end = media.find(b"\xff\xd9", at)
        if end < 0:
            raise ValueError("the scan has no end")
        self.stop, self.next = end, end + 2
        self.blocks = -(-self.width // 8) * -(-self.height // 8)


def _lookup(table: bytes) -> np.ndarray:
    """length << 8 | value for every 16 bits that may stand next; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int64)
    for length, code, value in _codes(list(table[:16]), list(table[16:])):
        first = code << (16 - length)
        out[first : first + (1 << (16 - length))] = length << 8 | value
    return out


def _decode_rows(data: np.ndarray, first: np.ndarray, count: np.ndarray, tables: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """DC values of intervals that start at the bytes ``first`` (unstuffed data), block after block."""
    dc, ac = _lookup(tables[0]), _lookup(tables[1])
    padded = np.concatenate([data, np.full(12, 0xFF, np.uint8)]).astype(np.uint64)
    wide = np.zeros(len(data) + 5, np.uint64)
    for i in range(5):
        wide |= padded[i : i + len(wide)] << np.uint64(8 * (4 - i))

    def peek(bit: np.ndarray, n: int) -> np.ndarray:
        return ((wide[bit >> 3] >> (40 - n - (bit & 7)).astype(np.uint64)) & np.uint64((1 << n) - 1)).astype(np.int64)

    out = np.zeros((len(first), int(count.max(initial=0))), np.int64)
    order = np.argsort(-count, kind="stable")
    bit, level = 8 * first[order], np.zeros(len(first), np.int64)
    plain = tables[1] == bytes([*AC_COUNTS, *AC_VALUES])
    for k in range(out.shape[1]):
        live = int(np.searchsorted(-count[order], -k, side="left"))
        b = bit[:live]
        got = dc[peek(b, 16)]
        size = got & 255
        b = b + (got >> 8)
        bits = peek(b, 16) >> (16 - size)
        level[:live] += np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)
        b = b + size
        if plain:
            b = b + 1
        else:
            seen, more = np.ones(live, np.int64), np.arange(live)
            while len(more):
                got = ac[peek(b[more], 16)]
                run, size = (got & 255) >> 4, got & 15
                b[more] += (got >> 8) + size
                over = (size == 0) & (run != 15)
                seen[more] += np.where(over, 64, run + 1)
                more = more[seen[more] < 64]
        bit[:live] = b
        out[order[:live], k] = level[:live]
    return out, count


def thumbnails(media: list[bytes]) -> list[tuple[np.ndarray, list[Stream]]]:
    """The DC-only luminance thumbnail (samples in block order) of each column value, and its streams."""
    streams: list[tuple[int, Stream]] = []
    for i, m in enumerate(media):
        at = 0
        while at < len(m):
            s = Stream(m, at)
            streams.append((i, s))
            at = s.next
    values: list[list[np.ndarray]] = [[] for _ in media]
    found = {}
    for tables in {s.tables for _, s in streams}:
        same = [j for j, (_, s) in enumerate(streams) if s.tables == tables]
        data = np.frombuffer(b"".join(media[streams[j][0]][streams[j][1].start : streams[j][1].stop] for j in same), np.uint8)
        sizes = np.array([streams[j][1].stop - streams[j][1].start for j in same], np.int64)
        heads = np.cumsum(sizes) - sizes
        after = np.concatenate([data[1:], np.zeros(1, np.uint8)])
        mark = np.flatnonzero((data == 0xFF) & (after >= 0xD0) & (after <= 0xD7))
        drop = np.zeros(len(data), bool)
        drop[mark] = drop[mark + 1] = True
        drop[1:] |= (data[:-1] == 0xFF) & (data[1:] == 0)
        kept = np.concatenate([[0], np.cumsum(~drop)])
        begins = np.sort(np.concatenate([heads, mark + 2]))
        owner = np.searchsorted(heads, begins, side="right") - 1
        nth = np.arange(len(begins)) - np.searchsorted(owner, owner)
        each = np.array([streams[j][1].interval or streams[j][1].blocks for j in same], np.int64)
        total = np.array([streams[j][1].blocks for j in same], np.int64)
        count = np.minimum(each[owner], total[owner] - nth * each[owner])
        rows, _ = _decode_rows(data[~drop], kept[begins], count, tables)
        edge = np.searchsorted(owner, np.arange(len(same) + 1))
        for x, j in enumerate(same):
            part = rows[edge[x] : edge[x + 1]]
            found[j] = part.ravel()[: total[x]] if each[x] * (edge[x + 1] - edge[x]) == part.size else np.concatenate([r[:n] for r, n in zip(part, count[edge[x] : edge[x + 1]], strict=True)])
    for j, (i, s) in enumerate(streams):
        level = found[j] * s.quantiser[s.table] / 8 + 128
        values[i].append(np.clip(np.rint(level), 0, 255).astype(np.uint8))
    return _by_owner(values, streams, len(media))


def _by_owner(values: list[list[np.ndarray]], streams: list[tuple[int, Stream]], n: int) -> list[tuple[np.ndarray, list[Stream]]]:
    own: list[list[Stream]] = [[] for _ in range(n)]
    for i, s in streams:
        own[i].append(s)
    return [(np.concatenate(v) if v else np.zeros(0, np.uint8), s) for v, s in zip(values, own, strict=True)]


def _hashes(pixels: np.ndarray, across: int) -> tuple[int, int]:
    """Average hash and difference hash of the thumbnail, from an 8 x 9 grid of means."""
    rows = pixels.reshape(-1, across).astype(np.int64)
    ys = np.arange(8) * len(rows) // 8
    sums = np.concatenate([np.zeros((1, across), np.int64), np.cumsum(rows, axis=0)])
    lower = np.maximum(np.append(ys[1:], len(rows)), ys + 1)
    bands = (sums[lower] - sums[ys]) / (lower - ys)[:, None]
    xs = np.arange(9) * across // 9
    grid = np.add.reduceat(bands, xs, axis=1) / np.diff(np.append(xs, across))
    average = np.packbits(grid[:, :8] > grid[:, :8].mean()).tobytes()
    slope = np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes()
    return int.from_bytes(average, "big"), int.from_bytes(slope, "big")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in blocks(batches, UNIT, "media"):
        raw = data.tobytes()
        media = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        out = []
        for m, (pixels, streams) in zip(media, thumbnails(media), strict=True):
            payload = pixels.tobytes()
            width = streams[0].width if streams else 0
            height = sum(s.height for s in streams)
            average, slope = _hashes(pixels, -(-width // 8))
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), width, height, f"{width}x{height}:{average:016x}:{slope:016x}", payload))
        cols = list(zip(*out, strict=True))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "feature", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
        yield pa.record_batch([rows.column("doc_id"), rows.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", *names])


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string, payload binary"


def read_media(media: DataFrame) -> DataFrame:
    """Decode a media column: payload, its digests, dimensions and thumbnail hashes."""
    return media.select("doc_id", "n_bytes", "media").transform(in_arrow, _decode, READ)
