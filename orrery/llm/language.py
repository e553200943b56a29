"""Language identification by segmentation-marginalised unigrams.

The pieces are all those of a fixed public byte-level vocabulary, so every text
can be segmented.  Each language has a probability
for every piece.  A word's likelihood in a language is the sum over all its
segmentations of the product of their pieces' probabilities, by the forward
algorithm; a text's is the product over its words.  Piece probabilities are fit
by EM: forward and backward sums give each piece's expected count over all
segmentations of the training words.

Fitting uses at most ``SAMPLE`` labelled texts for each of the languages, chosen
by a hash of the id, on the driver (a bounded sample; the table of probabilities
has one row a piece of the vocabulary).  Scoring is numpy over Arrow batches,
once for each distinct word of a block.  Words are fit and scored whole; sums of
words over ``WORD_BYTES`` bytes are rescaled as they go.  Nothing is shuffled.

A text's score is the posterior of its language with the evidence of 12 words at
most, as neighbouring words aren't independent.

Defined cases: a text that is null or has no letter gets ``und`` and score 0;
without any labelled text every prediction is ``und``; equal scores go to the
first language in code point order; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm._text import U64, HashIndex, blocks, body, split_words
from orrery.storage import in_arrow

#: Bytes of the longest piece of the default vocabulary.
LONGEST = 128
#: Words up to this size are taken with others of their size, without rescaling.
WORD_BYTES = 32
#: Positions after which sums are rescaled.
RESCALE = 32
#: Bytes of longer words that are taken at once; a larger word comes alone.
AT_ONCE = 400_000
SAMPLE = 400
#: Bytes of the largest text that may be in the sample.
MOST_BYTES = 1 << 17
ROUNDS = 4
#: Bytes of text scored at once.
UNIT = 2 << 20
_LETTER = regex.compile(r"\p{L}")


def vocabulary() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Pieces:
    """All pieces of the vocabulary, found byte by byte in a tree of their prefixes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            known = {base64.b64decode(line.split()[0]).lower() for line in f if line.strip()}
        known |= {bytes([b]) for b in range(256)}
        self.pieces = sorted(p for p in known if p)
        self.longest = max(len(p) for p in self.pieces)
        nodes = {b"": 0}
        for p in self.pieces:
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes))
        number = {p: i for i, p in enumerate(self.pieces)}
        self.piece = np.array([number.get(p, -1) for p in nodes])
        keys = np.array([nodes[p[:-1]] << 9 | p[-1] for p in nodes if p], U64)
        self.index = HashIndex(keys)
        self.node = np.argsort(keys, kind="stable") + 1

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes one byte on, or -1."""
        at = self.index.find((node.astype(U64) << U64(9)) | byte.astype(U64))
        return np.where(at >= 0, self.node[at], -1)


@dataclass
class Model:
    """Piece probabilities (a row a piece, a column a language)."""

    languages: list[str]
    table: np.ndarray
    path: str


def _groups(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, bytes with a space before and ``PAD`` behind) of words of like lengths."""
    size = end - start
    order = np.argsort(size, kind="stable")
    sizes, at = size[order], 0
    while at < len(order):
        n = int(sizes[at])
        if n <= WORD_BYTES:
            to = min(int(np.searchsorted(sizes, n, side="right")), at + 20_000)
        else:
            to = min(int(np.searchsorted(sizes, n + n // 4, side="right")), at + max(1, AT_ONCE // n))
        part, n = order[at:to], int(sizes[to - 1])
        text = np.full((len(part), n + 1), PAD, np.int16)
        text[:, 0] = 32
        inside = np.arange(n) < size[part][:, None]
        text[:, 1:][inside] = data[(start[part][:, None] + np.arange(n))[inside]]
        yield part, text
        at = to


#: No byte, and in no piece.
PAD = 256
Found = list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]


def _found(pieces: Pieces, text: np.ndarray) -> Found:
    """By the size n of pieces: n, their numbers, their words, and the offsets of those that start at each byte."""
    rows, length = text.shape
    flat = np.ascontiguousarray(text.T).ravel()
    at, node, out, n = np.arange(len(flat)), np.zeros(len(flat), np.int64), [], 0
    while len(at):
        node = pieces.step(node, flat[at + n * rows])
        at, node, n = at[node >= 0], node[node >= 0], n + 1
        piece = pieces.piece[node]
        hit = at[piece >= 0]
        if len(hit):
            out.append((n, piece[piece >= 0], hit % rows, np.searchsorted(hit, np.arange(length + 1) * rows)))
        more = at + n * rows < len(flat)
        at, node = at[more], node[more]
    return out


def _sums(pieces: Pieces, found: Found, text: np.ndarray, table: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """sums[j]: probability of all segmentations of the first j bytes (``back``: of those from byte j on), over exp(logs[j])."""
    rows, length = text.shape
    long = length > WORD_BYTES + 1
    kind = np.longdouble if long else float
    sums = np.zeros((length + 1, rows, table.shape[1]), kind)
    logs = np.zeros(sums.shape) if long else None
    if back:
        sums[(text < PAD).sum(axis=1), np.arange(rows)] = 1
    else:
        sums[0] = 1
    for step in range(1, length + 1):
        j = length - step if back else step
        if long:
            logs[j] = logs[j + 1] if back else logs[j - 1]
        for n, piece, row, cut in found:
            first, other = (j, j + n) if back else (j - n, j - n)
            if first < 0 or other > length:
                break
            a, b = cut[first], cut[first + 1]
            if a < b:
                r = row[a:b]
                sums[j, r] += sums[other, r] * table[piece[a:b]]
        if long and step % RESCALE == 0:
            window = slice(j, j + pieces.longest) if back else slice(max(0, j + 1 - pieces.longest), j + 1)
            # a row whose text has no sum here is over, or hasn't begun
            by = np.where(sums[j] > 0, sums[j], 1)
            sums[window] /= by
            logs[window] += np.log(by).astype(float)
    return sums, logs


def word_scores(pieces: Pieces, table: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """log likelihood of each word (a row) in each language; ``table`` ends with a row of zeros."""
    out = np.zeros((len(start), table.shape[1]))
    for part, text in _groups(data, start, end):
        sums, logs = _sums(pieces, _found(pieces, text), text, table)
        last, rows = (text < PAD).sum(axis=1), np.arange(len(part))
        out[part] = np.log(sums[last, rows]) + (0 if logs is None else logs[last, rows])
    return out


def _padded(p: np.ndarray) -> np.ndarray:
    return np.vstack([p, np.zeros((1, p.shape[1]))])


def fit(texts: list[tuple[str, bytes]], path: str, rounds: int = ROUNDS) -> Model:
    """EM over (language, text) pairs."""
    pieces, languages = Pieces(path), sorted({lang for lang, _ in texts})
    columns = []
    for lang in languages:
        raw = [t for name, t in texts if name == lang]
        data = np.frombuffer(b"\n".join(raw), np.uint8)
        words = split_words(data, np.array([0, len(data)]))
        _, one, count = np.unique(words.hash, return_index=True, return_counts=True)
        groups = [(count[part].astype(float), _found(pieces, text), text) for part, text in _groups(words.data, words.start[one], words.end[one])]
        p = np.array([0.05 ** len(x) for x in pieces.pieces])[:, None]
        p /= p.sum()
        for _ in range(rounds):
            expected = np.zeros(len(pieces.pieces) + 1)
            table = _padded(p)
            for weight, found, text in groups:
                (forth, up), (behind, down) = _sums(pieces, found, text, table), _sums(pieces, found, text, table, back=True)
                last, rows = (text < PAD).sum(axis=1), np.arange(len(text))
                whole, log = forth[last, rows, 0], 0 if up is None else up[last, rows, 0]
                for n, ids, row, cut in found:
                    i = np.repeat(np.arange(text.shape[1]), np.diff(cut))
                    share = forth[i, row, 0] * table[ids, 0] * behind[i + n, row, 0] / whole[row]
                    if up is not None:
                        share = share * np.exp((up[i, row, 0] + down[i + n, row, 0] - log[row]).astype(np.longdouble))
                    expected += np.bincount(ids, weight[row] * share.astype(float), len(expected))
            grown = expected[:-1] + 0.02 + 0.5 * np.array([len(x) == 1 for x in pieces.pieces])
            p = (grown / grown.sum())[:, None]
        columns.append(p[:, 0])
    return Model(languages, np.stack(columns, axis=1), path)


def sample(labelled: DataFrame, per_language: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """At most ``per_language`` texts of every language, those with the smallest hash of the id.

    Ids are ranked within (language, hash bucket) first, so what is ranked within a
    language are at most 512 * ``per_language`` ids, whatever the input; only texts
    of the chosen are collected, each once, and none of more than ``MOST_BYTES``.
    """
    mark = F.xxhash64(F.lit("language"), F.col(id_col).cast("string"), F.col(text_col))
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= MOST_BYTES))
    rows = known.select(F.col(lang_col).alias("lang"), mark.alias("mark"), body(text_col))
    near = rows.select("lang", "mark").distinct().withColumn("bucket", F.pmod("mark", F.lit(512)))
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("mark"))).where(F.col("n") <= per_language)
    chosen = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("n", "bucket"))).where(F.col("n") <= per_language).select("lang", "mark")
    rows = rows.join(F.broadcast(chosen), ["lang", "mark"], "left_semi").dropDuplicates(["lang", "mark"])
    return sorted((r["lang"], bytes(r["body"])) for r in rows.collect())


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            pieces = None
        else:
            pieces, table = Pieces(model.path), _padded(model.table)
        for rows, data, bounds in blocks(batches, UNIT):
            n = rows.num_rows
            pred, score = ["und"] * n, np.zeros(n)
            if pieces is not None:
                words = split_words(data, bounds)
                _, one, back = np.unique(words.hash, return_index=True, return_inverse=True)
                each = word_scores(pieces, table, words.data, words.start[one], words.end[one])
                sums = np.zeros((n, len(model.languages)))
                text = np.repeat(np.arange(n), words.per_text)
                for k in range(sums.shape[1]):
                    sums[:, k] = np.bincount(text, each[back, k], n)
                # the posterior with the evidence of 12 words at most: neighbours in a text aren't independent
                per_text = np.maximum(words.per_text, 1)
                sums *= (np.minimum(per_text, 12) / per_text)[:, None]
                post = np.exp(sums - sums.max(axis=1, keepdims=True))
                post /= post.sum(axis=1, keepdims=True)
                best = post.argmax(axis=1)
                raw = data.tobytes()
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    if _LETTER.search(raw[a : min(a + 64, b)].decode("utf-8", "ignore")) or _LETTER.search(raw[a:b].decode("utf-8", "ignore")):
                        pred[i], score[i] = model.languages[best[i]], post[i, best[i]]
            yield pa.record_batch([rows.column("doc_id"), pa.array(pred), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, labelled: DataFrame, tokenizer: str | None = None, per_language: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``, learned from ``labelled``."""
    texts = sample(labelled, per_language, id_col, text_col, lang_col)
    model = fit(texts, tokenizer or vocabulary()) if texts else None
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col)).transform(in_arrow, _score(model), "doc_id long, lang_pred string, score double")
