"""Toxicity scores of whole texts by a bidirectional gated recurrent network.

A text is cut into all windows of ``WINDOW`` words at every ``STRIDE`` words, so
neighbours overlap by half.  A word enters as a word vector (by hash) and a
character vector (the mean of the vectors of all its character n-grams, with marks
at its ends, and their strongest evidence).  A GRU reads the window in each
direction, attention pools the states, a logistic unit scores the window.  A
text's score is that of its highest window, calibrated on texts.

Training is numpy in one task, on a sample of at most ``POSITIVES`` +
``NEGATIVES`` labelled ids chosen by a hash of the id (copies and near copies
within the sample are dropped first).  Labels belong to texts, so windows are
chosen in turns: the highest window of every text under the current evidence,
beside random windows of texts that aren't toxic.  The first component of the
word and character vectors starts as smoothed log odds.

Scoring is numpy over Arrow batches; nothing is shuffled, and what is broadcast
has a fixed size.

Defined cases: a text without words (null, empty) scores 0; without labels of
both kinds every score is 0; several labels for an id count as toxic if one is;
rows whose id has no label don't train; repeated rows get equal scores; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm._joins import unused
from orrery.llm._text import U64, HashIndex, Words, blocks, body, mix, split_words, take_pieces
from orrery.storage import in_arrow, release

WINDOW, STRIDE = 32, 16
POSITIVES, NEGATIVES = 1000, 2000
#: Bytes of the largest text that may be in the sample.
MOST_BYTES = 1 << 18
WORD_BITS, GRAM_BITS = 18, 16
WORD_DIM = GRAM_DIM = 6
HIDDEN, ATTENTION = 8, 8
GRAMS = (3, 4, 5)
#: Words whose vectors a worker keeps; when there are more, it starts anew.
KNOWN_WORDS = 500_000
#: Words or windows whose vectors are made at once.
AT_ONCE = 20_000
#: Bytes or n-grams of words whose vectors are made at once.
SIZE_AT_ONCE = 400_000
#: Bytes of text scored at once.
UNIT = 2 << 20
#: Small samples are gone through more often, to make this many steps.
LEAST_STEPS = 240
SEED = 11
#: Bytes of a row of the trained model, and partitions that these rows come in: the driver never needs one large array.
MODEL_PIECE, MODEL_PARTS = 1 << 18, 16
THRESHOLD = 0.3
Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of whole words, and how many each word has."""
    size = end - start
    heads = np.cumsum(size + 2) - (size + 2)
    text = np.zeros(int((size + 2).sum()) + max(GRAMS), np.uint8)
    text[heads] = 2
    text[take_pieces(heads + 1, size)] = data[take_pieces(start, size)]
    text[heads + size + 1] = 3
    counts = np.maximum(size[:, None] + 3 - np.array(GRAMS), 0)
    total = counts.sum(axis=1)
    out = np.zeros(int(total.sum()), np.int32)
    to = (np.cumsum(total) - total)[:, None] + np.cumsum(counts, axis=1) - counts
    for i, n in enumerate(GRAMS):
        at = take_pieces(heads, counts[:, i])
        packed = np.zeros(len(at), U64)
        for k in range(n):
            packed |= text[at + k].astype(U64) << U64(8 * k)
        out[take_pieces(to[:, i], counts[:, i])] = mix(packed * U64(8) + U64(n)) >> U64(64 - GRAM_BITS)
    return out, total


def _parts(size: np.ndarray) -> Iterator[slice]:
    """Runs of at most ``AT_ONCE`` words with about ``SIZE_AT_ONCE`` in all; a larger word comes alone."""
    sums, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < len(size):
        to = int(np.searchsorted(sums, sums[at] + SIZE_AT_ONCE, side="right")) - 1
        to = min(max(to, at + 1), at + AT_ONCE, len(size))
        yield slice(at, to)
        at = to


class Features:
    """Distinct words of a block with their word and n-gram buckets."""

    def __init__(self, words: Words):
        hashes, one, back = np.unique(words.hash, return_index=True, return_inverse=True)
        self.hash, self.of_token = hashes, back.astype(np.int64)
        self.word = (hashes >> U64(64 - WORD_BITS)).astype(np.int64)
        start, end = words.start[one], words.end[one]
        parts = [_grams(words.data, start[part], end[part]) for part in _parts(end - start)] or [_grams(words.data, start, end)]
        self.grams, self.n_grams = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.heads = np.cumsum(self.n_grams) - self.n_grams

    def vectors(self, p: Params, words: np.ndarray | None = None) -> np.ndarray:
        """One row per distinct word (or per word of ``words``), and a last row of zeros for padding."""
        words = np.arange(len(self.word)) if words is None else words
        out = np.zeros((len(words) + 1, WORD_DIM + GRAM_DIM + 1), np.float32)
        out[:-1, :WORD_DIM] = p["words"][self.word[words]]
        for rows in _parts(self.n_grams[words]):
            part = words[rows]
            size = self.n_grams[part]
            if len(part) == 1:
                grams = self.grams[self.heads[part[0]] : self.heads[part[0]] + size[0]]
                pieces = [grams[i : i + SIZE_AT_ONCE] for i in range(0, len(grams), SIZE_AT_ONCE)]
                out[rows, WORD_DIM:-1] = np.sum([p["grams"][x].sum(axis=0) for x in pieces], axis=0) / size[0]
                out[rows, -1] = max(p["odds"][x].max() for x in pieces)
                continue
            grams = self.grams[take_pieces(self.heads[part], size)]
            heads = np.cumsum(size) - size
            out[rows, WORD_DIM:-1] = np.add.reduceat(p["grams"][grams], heads) / size[:, None]
            out[rows, -1] = np.maximum.reduceat(p["odds"][grams], heads)
        return out


def windows(per_text: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token positions of all windows (-1 past a text's end) and the texts they belong to."""
    count = np.where(per_text > 0, 1 + np.maximum(0, -(-(per_text - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(per_text)), count)
    first = take_pieces(np.zeros(len(count), np.int64), count) * STRIDE
    place = first[:, None] + np.arange(WINDOW)
    past = place >= per_text[owner][:, None]
    place += ptr[:-1][owner][:, None]
    place[past] = -1
    return place, owner


def _run(gates: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction at every step; ``gates`` are the projected inputs (step, row, 3H)."""
    steps, rows = mask.shape
    h, states, kept = np.zeros((rows, HIDDEN), np.float32), np.zeros((steps, rows, HIDDEN), np.float32), []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        x, hu = gates[t], h @ u
        zr = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])))
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        new = np.where(mask[t][:, None], new, h)
        if keep:
            kept.append((t, h, z, r, n, hu[:, 2 * HIDDEN :]))
        h = states[t] = new
    return states, kept


def forward(p: Params, vectors: np.ndarray, tokens: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
    """Window logits; ``tokens`` (window, step) index rows of ``vectors``, the last row pads."""
    at = np.ascontiguousarray(tokens.T)
    mask = at < len(vectors) - 1
    # the input projection is made once a distinct word
    ahead = _run((vectors @ p["wf"] + p["bf"])[at], mask, p["uf"], False, keep)
    behind = _run((vectors @ p["wb"] + p["bb"])[at], mask, p["ub"], True, keep)
    states = np.concatenate([ahead[0], behind[0]], axis=2)
    inner = np.tanh(states @ p["a"])
    weight = np.where(mask, inner @ p["v"], np.float32(-1e9))
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[..., None] * states).sum(axis=0)
    return pooled @ p["w"] + p["b"][0], (at, mask, ahead, behind, states, inner, weight, pooled) if keep else None


def _back_run(kept: list, d_states: np.ndarray, mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of the recurrent weights."""
    d_gates, d_u = np.zeros((*mask.shape, 3 * HIDDEN), np.float32), np.zeros_like(u)
    d_h = np.zeros((mask.shape[1], HIDDEN), np.float32)
    for t, h, z, r, n, hn in reversed(kept):
        d = d_h + d_states[t]
        m = mask[t][:, None]
        d_new = np.where(m, d, 0)
        d_n = d_new * (1 - z) * (1 - n * n)
        d_z = d_new * (h - n) * z * (1 - z)
        d_r = d_n * hn * r * (1 - r)
        d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_u += h.T @ d_hu
        d_h = np.where(m, d_new * z, d) + d_hu @ u.T
    return d_gates, d_u


def _sum_rows(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """values summed by row number."""
    out = np.zeros((size, values.shape[1]), values.dtype)
    order = np.argsort(rows, kind="stable")
    which, heads = np.unique(rows[order], return_index=True)
    out[which] = np.add.reduceat(values[order], heads)
    return out


def gradients(p: Params, vectors: np.ndarray, tokens: np.ndarray, labels: np.ndarray) -> tuple[float, Params, np.ndarray]:
    """Mean loss, gradients of the parameters and of ``vectors``."""
    logits, (at, mask, ahead, behind, states, inner, weight, pooled) = forward(p, vectors, tokens, keep=True)
    prob = _sigmoid(logits)
    loss = -np.mean(labels * np.log(prob + 1e-9) + (1 - labels) * np.log(1 - prob + 1e-9))
    d = ((prob - labels) / len(labels)).astype(np.float32)
    g = {"w": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
    d_pooled = d[:, None] * p["w"]
    d_weight = (states * d_pooled).sum(axis=2)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["v"] = np.einsum("tr,trk->k", d_score, inner)
    d_inner = d_score[..., None] * p["v"] * (1 - inner * inner)
    g["a"] = np.einsum("trh,trk->hk", states, d_inner)
    d_states = weight[..., None] * d_pooled + d_inner @ p["a"].T
    d_vectors = np.zeros_like(vectors)
    for tag, run, part in (("f", ahead, slice(0, HIDDEN)), ("b", behind, slice(HIDDEN, None))):
        d_gates, g["u" + tag] = _back_run(run[1], d_states[..., part], mask, p["u" + tag])
        per_word = _sum_rows(at.ravel(), d_gates.reshape(-1, 3 * HIDDEN), len(vectors))
        per_word[-1] = 0
        g["w" + tag] = vectors.T @ per_word
        g["b" + tag] = per_word.sum(axis=0)
        d_vectors += per_word @ p["w" + tag].T
    return float(loss), g, d_vectors


def _odds(buckets: Iterable[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log odds of a bucket's texts to be toxic, drawn towards 0 where few texts speak for it."""
    seen = np.zeros((2, size))
    for b, y in zip(buckets, labels, strict=True):
        seen[y, np.unique(b)] += 1
    n = np.bincount(labels, minlength=2)
    out = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    sure = np.maximum(np.abs(out) - np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5)), 0)  # less one standard error
    return (np.clip(np.sign(out) * sure, -2, 6) / 3).astype(np.float32)


def _fresh(rng: np.random.Generator) -> Params:
    dim = WORD_DIM + GRAM_DIM + 1
    shapes = {"wf": (dim, 3 * HIDDEN), "wb": (dim, 3 * HIDDEN), "uf": (HIDDEN, 3 * HIDDEN), "ub": (HIDDEN, 3 * HIDDEN), "a": (2 * HIDDEN, ATTENTION), "v": (ATTENTION,), "w": (2 * HIDDEN,)}
    p = {k: (rng.standard_normal(s) * (0.7 / np.sqrt(s[0]))).astype(np.float32) for k, s in shapes.items()}
    p |= {"bf": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32), "b": np.zeros(1, np.float32)}
    p["words"] = (rng.standard_normal((1 << WORD_BITS, WORD_DIM)) * 0.05).astype(np.float32)
    p["grams"] = (rng.standard_normal((1 << GRAM_BITS, GRAM_DIM)) * 0.05).astype(np.float32)
    return p


def _distinct(texts: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """Without copies and most near copies: two minima over hashes of four words in turn."""
    seen: set[int] = set()
    out = []
    for text, label in texts:
        h = split_words(np.frombuffer(text, np.uint8), np.array([0, len(text)])).hash
        if not len(h):
            continue
        n = min(4, len(h))
        grams = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            grams = mix(grams * U64(31) + h[i : len(h) - n + 1 + i])
        marks = {int(grams.min()), int(mix(grams ^ U64(0xABCD)).min())}
        if not marks & seen:
            out.append((text, label))
        seen |= marks
    return out


def train(texts: list[tuple[bytes, int]], epochs: int = 6, batch: int = 192, rate: float = 0.08, seed: int = SEED) -> Params | None:
    """Parameters from labelled texts, or None without both kinds."""
    texts = _distinct(texts)
    labels = np.array([y for _, y in texts], np.int64)
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    data = np.frombuffer(b"".join(t for t, _ in texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t, _ in texts])])
    words = split_words(data, bounds)
    features = Features(words)
    p = _fresh(rng)
    per_text = [features.of_token[a:b] for a, b in zip(words.ptr[:-1], words.ptr[1:], strict=True)]
    p["words"][:, 0] = _odds((features.word[np.unique(t)] for t in per_text), labels, 1 << WORD_BITS)
    p["odds"] = _odds((features.grams[take_pieces(features.heads[w], features.n_grams[w])] for w in map(np.unique, per_text)), labels, 1 << GRAM_BITS)
    p["grams"][:, 0] = p["odds"]
    place, owner = windows(words.per_text, words.ptr)
    pad = len(features.word)
    tokens = features.of_token.astype(np.int32)[place]
    tokens[place < 0] = pad
    del place
    vectors = features.vectors(p)
    evidence = np.maximum(vectors[:, 0], 0) + np.maximum(vectors[:, -1], 0)
    rank = np.concatenate([evidence[t].sum(axis=1) for t in np.array_split(tokens, max(1, len(tokens) // AT_ONCE))])
    del vectors
    past = {k: np.full_like(x, 1e-4) for k, x in p.items() if k != "odds"}
    edges = np.searchsorted(owner, np.arange(len(labels) + 1))

    def step(name: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        past[name][rows] += grad * grad
        p[name][rows] -= rate * grad / np.sqrt(past[name][rows])

    harmless = np.concatenate([t for t, y in zip(per_text, labels, strict=True) if not y]).astype(np.int32)
    per_epoch = -(-(len(labels) + min(len(labels), int((labels[owner] == 0).sum()))) // batch)
    epochs = max(epochs, -(-LEAST_STEPS // per_epoch))
    for epoch in range(epochs):
        if epoch in (epochs // 3, 2 * epochs // 3):
            rank = logits(p, features.vectors(p), tokens)
        top = np.array([edges[i] + int(np.argmax(rank[edges[i] : edges[i + 1]])) for i in range(len(labels))])
        quiet = np.flatnonzero(labels[owner] == 0)
        chosen = np.concatenate([top, rng.choice(quiet, min(len(quiet), len(labels)), replace=False)])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), batch):
            part = chosen[i : i + batch]
            # a harmless word stays harmless if it is repeated
            again = np.repeat(rng.choice(harmless, (len(part) // 6, 1)), WINDOW, axis=1)
            rows = np.concatenate([tokens[part], again])
            used, at = np.unique(rows, return_inverse=True)
            used = used if used[-1] == pad else np.append(used, pad)
            small = features.vectors(p, used[:-1])
            _, g, d_vectors = gradients(p, small, at.reshape(len(rows), WINDOW), np.concatenate([labels[owner[part]], np.zeros(len(again))]).astype(np.float32))
            for name, grad in g.items():
                step(name, grad)
            real = used[:-1]
            rows, back = np.unique(features.word[real], return_inverse=True)
            step("words", _sum_rows(back, d_vectors[:-1, :WORD_DIM], len(rows)), rows)
            each = np.repeat(d_vectors[:-1, WORD_DIM:-1] / np.maximum(features.n_grams[real], 1)[:, None], features.n_grams[real], axis=0)
            rows, back = np.unique(features.grams[take_pieces(features.heads[real], features.n_grams[real])], return_inverse=True)
            step("grams", _sum_rows(back, each, len(rows)), rows)
    rank = logits(p, features.vectors(p), tokens)
    best = np.array([rank[edges[i] : edges[i + 1]].max() for i in range(len(labels))])
    p["scale"] = _calibrate(best, labels)
    return p


def _calibrate(best: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Slope and offset of a logistic fit of texts' highest logits, both kinds with equal weight."""
    n = np.bincount(labels, minlength=2)
    weight = 0.5 / n[labels]
    a, b = 1.0, 0.0
    for _ in range(300):
        prob = _sigmoid(a * best + b)
        d = weight * (prob - labels)
        h = weight * prob * (1 - prob) + 1e-6
        hess = np.array([[(h * best * best).sum() + 1e-3, (h * best).sum()], [(h * best).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(hess, np.array([(d * best).sum() + 1e-3 * (a - 1), d.sum() + 1e-3 * b]))
        a, b = a - 0.3 * move[0], b - 0.3 * move[1]
    return np.array([max(a, 0.1), b])


def logits(p: Params, vectors: np.ndarray, tokens: np.ndarray, part: int = 2048) -> np.ndarray:
    """Logits of many windows."""
    return np.concatenate([forward(p, vectors, tokens[i : i + part])[0] for i in range(0, len(tokens), part)] or [np.zeros(0, np.float32)])


class _Known:
    """Vectors of words that a worker has seen, at most ``KNOWN_WORDS`` of them."""

    def __init__(self, p: Params):
        self.p = p
        self.forget()

    def forget(self) -> None:
        self.index, self.row = HashIndex(np.zeros(0, U64)), np.zeros(0, np.int64)
        self.hash, self.vectors = np.zeros(0, U64), np.zeros((0, WORD_DIM + GRAM_DIM + 1), np.float32)

    def block(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each token's row, and the rows (the last pads)."""
        if len(self.hash) > KNOWN_WORDS:
            self.forget()
        at = self.index.find(words.hash)
        rest = np.flatnonzero(at < 0)
        token = self.row[at] if len(self.row) else at
        if len(rest):
            new = Features(Words(words.data, words.start[rest], words.end[rest], words.hash[rest], words.ptr))
            token[rest] = len(self.hash) + new.of_token
            vectors = np.concatenate([self.vectors, new.vectors(self.p)])
            self.hash, self.vectors = np.concatenate([self.hash, new.hash]), vectors[:-1]
            self.row, self.index = np.argsort(self.hash, kind="stable"), HashIndex(self.hash)
        used, back = np.unique(token, return_inverse=True)
        return back, np.concatenate([self.vectors[used], np.zeros((1, self.vectors.shape[1]), np.float32)])


def _block_scores(p: Params | None, known: _Known | None, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and number of windows of every text of a block."""
    n = len(bounds) - 1
    score, n_windows = np.zeros(n), np.zeros(n, np.int64)
    if p is not None and len(data):
        words = split_words(data, bounds)
        place, owner = windows(words.per_text, words.ptr)
        if len(place):
            of_token, vectors = known.block(words)
            tokens = np.where(place >= 0, of_token[place], len(vectors) - 1)
            prob = _sigmoid(p["scale"][0] * logits(p, vectors, tokens).astype(np.float64) + p["scale"][1])
            np.maximum.at(score, owner, prob)
            n_windows = np.bincount(owner, minlength=n)
    return score, n_windows


def _score(p: Params | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(p) if p is not None else None
        for rows, data, bounds in blocks(batches, UNIT):
            score, n_windows = _block_scores(p, known, data, bounds)
            yield pa.record_batch([rows.column("doc_id"), pa.array(score), pa.array(n_windows)], names=["doc_id", "score", "n_windows"])

    return run


def _below(p: Params | None, threshold: float, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(p) if p is not None else None
        for rows, data, bounds in blocks(batches, UNIT, column):
            score, _ = _block_scores(p, known, data, bounds)
            yield rows.filter(pa.array(score < threshold)).drop_columns([column])

    return run


def sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The bounded training sample: body and label of at most ``positives`` + ``negatives`` texts, by a hash of the id.

    Of rows that repeat an id one is taken (the text with the smallest hash).  Longer
    texts than ``MOST_BYTES`` are left out of the sample, not of the scores.
    """
    mark = F.xxhash64(F.lit("toxicity"), F.col("_id").cast("string"))
    known = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    short = docs.where(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) <= MOST_BYTES)
    known = short.select(F.col(id_col).alias("_id")).distinct().join(known, "_id")
    few = [known.where(F.col("_toxic") == y).withColumn("_mark", mark).orderBy("_mark", "_id").limit(n) for y, n in ((1, positives), (0, negatives))]
    chosen = few[0].unionByName(few[1]).select("_id", "_toxic")
    rows = short.select(F.col(id_col).alias("_id"), body(text_col))
    rows = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "_toxic").agg(F.min_by("body", F.xxhash64("body")).alias("body"))
    return rows.select(F.col("_id").cast("long").alias("doc_id"), "body", F.col("_toxic").cast("int").alias("label"))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in batch.to_pylist()]
    rows.sort(key=lambda r: (r["doc_id"], r["body"]))
    model = pickle.dumps(train([(r["body"], r["label"]) for r in rows]))
    for at in range(0, len(model), MODEL_PIECE):
        yield pa.record_batch([pa.array([at]), pa.array([model[at : at + MODEL_PIECE]], pa.binary())], names=["at", "model"])


def fit(training: DataFrame) -> Params | None:
    """Train on a bounded sample, in one task, so that the driver holds the parameters only."""
    found = training.repartition(1).transform(in_arrow, _fit, "at long, model binary").repartition(MODEL_PARTS).collect()
    model = pickle.loads(b"".join(bytes(r["model"]) for r in sorted(found, key=lambda r: r["at"]))) if found else None
    del found
    release(training.sparkSession)
    return model


def score(docs: DataFrame, p: Params | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and n_windows of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col)).transform(in_arrow, _score(p), "doc_id long, score double, n_windows long")


def drop_toxic(docs: DataFrame, p: Params | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, with all their columns, whatever they are called, in the pass that scores them."""
    column = unused(docs, "body")
    return docs.withColumn(column, body(text_col).alias(column)).transform(in_arrow, _below(p, threshold, column), docs.schema)
