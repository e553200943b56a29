"""Token ids of whole texts with the tokenizers library, one library call a distinct part.

The vocabulary drops white space between words, so the ids of a text are those
of its words in turn.  Plain words are split here into letters, digits and marks,
each distinct part goes once to the library's BPE model; words with rarer
characters, or with the beginning of a special token, go through its whole chain
(normaliser, splitter, model).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from orrery.llm._text import LOWER, SPACE, HashIndex, blocks, hash_spans, take_pieces

END = 2
#: Parts kept with their ids in a worker; when more are known, it starts anew.
KEPT_PARTS = 600_000
#: Bytes of text encoded at once; working memory is many times as much.
TEXT_BLOCK = 1 << 20


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Classes of bytes: white space, letters, digits, other marks; ODD words take the long way.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[SPACE] = 0
_CLASS[0x30:0x3A] = 2
_CLASS[0x61:0x7B] = 1
_CLASS[0x27] = 4
ODD = 4


class Encoder:
    """Turns blocks of texts into token ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.first, self.size, self.hash = array("I", [END]), array("q", [0]), array("q", [1]), array("Q", [0])
        self.index, self.slot_of = HashIndex(np.zeros(0, np.uint64)), np.zeros(0, np.int64)

    def learn(self, part: bytes, odd: bool, key: int) -> int:
        if odd:
            ids = self.tokenizer.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids
        else:
            shown = part.decode() if part.isascii() else part.decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(shown)]
        at = self.known[part] = len(self.first)
        self.first.append(len(self.ids))
        self.size.append(len(ids))
        self.hash.append(key)
        self.ids.extend(ids)
        return at

    def slots(self, low: bytes, start: np.ndarray, end: np.ndarray, odd: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The slot of each part; most are found by their hashes at once."""
        at = self.index.find(keys)
        out = self.slot_of[at] if len(self.slot_of) else at
        rest = np.flatnonzero(at < 0)
        if not len(rest):
            return out
        _, one, back = np.unique(keys[rest], return_index=True, return_inverse=True)
        one, known, found = rest[one], self.known.get, []
        for s, e, o, k in zip(start[one].tolist(), end[one].tolist(), odd[one].tolist(), keys[one].tolist(), strict=True):
            part = low[s:e]
            slot = known(part)
            found.append(self.learn(part, o, k) if slot is None else slot)
        out[rest] = np.array(found, np.int64)[back]
        if len(self.hash) > 1.15 * len(self.slot_of):
            hashes = np.array(self.hash, np.uint64)[1:]
            self.slot_of = np.argsort(hashes, kind="stable") + 1
            self.index = HashIndex(hashes)
        return out

    def block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, each closed by ``END``, and their offsets."""
        data, start, end, odd = _parts(data, bounds)
        if len(self.known) > KEPT_PARTS:
            self.forget()
        slots = self.slots(data.tobytes(), start, end, odd, hash_spans(data, start, end) ^ odd.astype(np.uint64))
        n = len(bounds) - 1
        ptr = np.searchsorted(start, bounds)
        slot = np.insert(slots, ptr[1:], 0)
        ids, first, size = np.array(self.ids, np.uint32), np.array(self.first), np.array(self.size)[slot]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids[take_pieces(first[slot], size)], ends[ptr + np.arange(n + 1)]


def _parts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and oddness of the parts of their words.

    Runs of letters, single digits and runs of other marks are parts, as the
    vocabulary's splitter has them; letters are a-z and U+00C0 to U+00FF but for
    two signs.  A word with anything else (or with an apostrophe) is one odd part,
    left as it was written.
    """
    raw, data = data, LOWER[data]
    kind = _CLASS[data]
    kind[:-1][(data[:-1] == 0x3C) & (data[1:] == 0x7C)] = ODD  # maybe a special token
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    lead = lead[(tail >= 0x80) & (tail < 0xC0) & (tail != 0x97) & (tail != 0xB7)]
    high = lead[data[lead + 1] < 0x9F]  # upper case, but for the sharp s
    data[high + 1] += 0x20
    kind[lead] = kind[lead + 1] = 1
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    gap = kind == 0
    begins = ~gap & (np.concatenate([[True], gap[:-1]]) | fresh[:-1])
    word = np.cumsum(begins)
    odd_words = np.zeros(int(word[-1]) + 1 if len(word) else 1, bool)
    odd_words[word[kind == ODD]] = True
    if odd_words.any():
        whole = odd_words[word] & ~gap
        kind, data = np.where(whole, np.uint8(ODD), kind), np.where(whole, raw, data)
    edge = begins.copy()
    edge[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    start = np.flatnonzero(edge & ~gap)
    stop = np.concatenate([edge[1:] | gap[1:], [True]]) if len(data) else edge
    end = np.flatnonzero(stop & ~gap) + 1
    return data, start, end, kind[start] == ODD


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of rows with a ``body`` column, their ids and the offsets of each row's ids."""
    encoder = Encoder(path)
    for rows, data, bounds in blocks(batches, TEXT_BLOCK):
        flat, ptr = encoder.block(data, bounds)
        yield rows, flat, ptr


def vocabulary() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
