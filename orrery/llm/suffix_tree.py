"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are words (A-Z lower-cased) and one end a text.  The root's distribution
is add-one over all training words; deeper states are contexts of the last one
to ``DEPTH`` words.  A context is retained if its next-symbol distribution
diverges from that of the longest retained context below it by more than the
description of its parameters costs (a log-likelihood-ratio test).  A state holds
the next symbols that follow it at least ``LEAST`` times, discounted by
``DISCOUNT``; the rest of its mass goes to all other symbols in proportion to the
shorter state.  Scoring takes the longest suffix state at every token.

The support is an absolute count, so the tree grows with the input.  Word
sequences (grams) of each length that occur at least ``LEAST`` times are tables:
a gram of m words is a pair (context of m - 1 words, next word), and the count of
a context is its own as a shorter gram.  A state's test is a sum over its pairs,
each joined with its suffix, the same pair one word shorter.

A token whose longest kept gram has m words has the probability of that gram,
times the share that each longer retained context leaves to other symbols.  With
gain(gram) = log10 of its probability over its suffix's, less what its context
leaves (where that is retained), plus what the gram itself leaves as a context,

score(text) = base score + the gains of all grams in the text, as often as they occur.

Grams in at least ``SHARE`` of the tokens are broadcast (at most 1/SHARE a
length); the others are joined by their hashes, as are words.  Bitmaps of at most
2**MOST_BITS bits keep most grams out of the shuffles that can't be in a table:
all in it pass, and the counts and joins are exact.

What is shuffled is packed: a task sorts the hashes of some ``RUN`` tokens and
sends each hash range (span) its part as one binary row; there are as many spans
as leave each some 2**SPAN tokens.  Grams are counted twice: first 32 bits of each, to
find those that may occur ``LEAST`` times, then those alone with their contexts
and suffixes.  The rows of ``docs`` must come in the same order if a task is run
again, as those of a scan do.

Words and grams are known by 64-bit hashes (40 bits and their span when scored).  Defined cases: a null text is empty
and has its end only; repeated rows get equal scores and count as often as they
occur in training; without training texts N = V = 0 and every token has
probability 1/(0 + 1), base score 0; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm._joins import join_even
from orrery.llm._text import U64, HashIndex, Words, blocks, body, mix, split_words
from orrery.storage import discard, in_arrow, release, stored

DEPTH = 3
#: A gram that is kept is seen this often at least.
LEAST = 3
#: Words and grams that make up this share of the tokens are broadcast.
SHARE = 2e-6
DISCOUNT = 0.6
#: The largest bitmap has 2 to this power bits.
MOST_BITS = 27
#: Entries a task gathers before it passes them on as a run.
RUN = 2_000_000
#: Log2 of the tokens of a hash range.
SPAN = 17
END = U64(0x0E2D0F7E87000001)
_ODD = U64(0xD6E8FEB86659FD93)


def _symbols(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with an end after every text, and the offsets of the texts."""
    n = len(words.ptr) - 1
    return np.insert(words.hash, words.ptr[1:], END), words.ptr + np.arange(n + 1)


def _longer(grams: np.ndarray) -> np.ndarray:
    """Hashes of the grams one word longer that end at each token; the first has none and keeps its own."""
    out = grams.copy()
    out[1:] = mix(grams[:-1] * _ODD + grams[1:])
    return out


def _places(ptr: np.ndarray) -> np.ndarray:
    """Each token's number within its text."""
    return np.arange(ptr[-1]) - np.repeat(ptr[:-1], np.diff(ptr))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap that all keys ``k`` pass, and few others: two bits a key."""
    bits = min(MOST_BITS, max(12, int(np.ceil(np.log2(max(1, 32 * keys.count()))))))
    turned = keys.select(F.explode(F.array("k", F.shiftleft("k", 32).bitwiseOR(F.shiftrightunsigned("k", 32)))).alias("k"))
    word, bit = F.shiftrightunsigned("k", 64 - (bits - 6)), F.expr("shiftleft(1L, cast(k & 63 as int))")
    table = turned.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[table["word"].to_numpy()] = table["bit"].to_numpy().astype(np.int64).view(U64)
    return out


def _passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    shift = U64(64 - (len(bitmap).bit_length() - 1))
    out = (bitmap[(keys >> shift).astype(np.int64)] >> (keys & U64(63))) & U64(1) > 0
    some = np.flatnonzero(out)
    turned = (keys[some] << U64(32)) | (keys[some] >> U64(32))
    out[some] = (bitmap[(turned >> shift).astype(np.int64)] >> (turned & U64(63))) & U64(1) > 0
    return out


def _span_bits(n: int) -> int:
    return min(24, max(6, (max(1, n) >> SPAN).bit_length()))


def _cut(keys: np.ndarray, shift: int, data: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Spans of sorted keys (their bits above ``shift``), and the bytes of the rows of ``data`` in each."""
    spans, heads = np.unique((keys >> U64(shift)).astype(np.int32), return_index=True)
    raw, cuts = data.tobytes(), (np.append(heads, len(keys)) * data.dtype.itemsize).tolist()
    return spans, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _rows(spans: np.ndarray, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
    yield from pa.table([pa.array(spans), pa.array(parts, pa.binary())], names=["span", "data"]).to_batches(500)


PACKED = "span int, data binary"
RECORD = np.dtype([("k", "<u8"), ("x", "<u8"), ("s", "<u8"), ("c", "<u4")])


def _by_span(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """The data of each span of rows that are sorted by it."""
    at, held = None, []
    for batch in batches:
        for span, data in zip(batch.column("span").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if span != at and held:
                yield at, b"".join(held)
                held = []
            at = span
            held.append(data)
    if held:
        yield at, b"".join(held)


def _met(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("span").sortWithinPartitions("span", *order)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, sums, size = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        k = np.concatenate(held)
        order = np.argsort(k, kind="stable")
        k = k[order]
        heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        yield from pa.table([pa.array(k[heads].view(np.int64)), pa.array(np.add.reduceat(np.concatenate(sums)[order], heads))], names=["k", "c"]).to_batches(100_000)

    for _, data, bounds in blocks(batches):
        k, c = np.unique(_symbols(split_words(data, bounds))[0], return_counts=True)
        held.append(k)
        sums.append(c)
        size += len(k)
        if size > RUN:
            yield from flush()
            held, sums, size = [], [], 0
    if held:
        yield from flush()


def _candidates(size: int, kept: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grams of ``size`` words, their first and their last ``size`` - 1 words, where both of these pass the bitmap."""
    for _, data, bounds in blocks(batches):
        grams, ptr = _symbols(split_words(data, bounds))
        for _ in range(size - 2):
            grams = _longer(grams)
        good = _passes(kept, grams)
        at = np.flatnonzero((_places(ptr) >= size - 1) & good & np.concatenate([[False], good[:-1]]))
        if len(at):
            yield _longer(grams)[at], grams[at - 1], grams[at]


def _sift(size: int, kept: np.ndarray, bits: int):
    """By span, the next 32 bits of every candidate, up to ``LEAST`` times."""

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, times = np.unique(np.concatenate(held) >> U64(32 - bits), return_counts=True)
        keys = np.repeat(keys, np.minimum(times, LEAST))
        yield from _rows(*_cut(keys, 32, keys.astype("<u4")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for k, _, _ in _candidates(size, kept, batches):
            held.append(k)
            n += len(k)
            if n > RUN:
                yield from packed(held)
                held, n = [], 0
        if held:
            yield from packed(held)

    return run


def _sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mixed keys of what the runs hold ``LEAST`` times."""
    for span, data in _by_span(batches):
        keys, c = np.unique(np.frombuffer(data, "<u4"), return_counts=True)
        keys = mix(keys[c >= LEAST].astype(U64) | (U64(span) << U64(32))).view(np.int64)
        yield from pa.table([pa.array(keys)], names=["k"]).to_batches(100_000)


def _record(size: int, kept: np.ndarray, often: np.ndarray, bits: int):
    """By span, the candidates that may occur ``LEAST`` times, with their contexts, suffixes and counts."""

    def packed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        k, x, s = (np.concatenate(c) for c in zip(*held, strict=True))
        k, one, c = np.unique(k, return_index=True, return_counts=True)
        data = np.empty(len(k), RECORD)
        data["k"], data["x"], data["s"], data["c"] = k, x[one], s[one], c
        yield from _rows(*_cut(k, 64 - bits, data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for found in _candidates(size, kept, batches):
            hit = _passes(often, mix(found[0] >> U64(32 - bits)))
            held.append(tuple(c[hit] for c in found))
            n += int(hit.sum())
            if n > RUN:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    return run


def _recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, x, s and c of every gram that occurs ``LEAST`` times."""
    for _, data in _by_span(batches):
        rows = np.frombuffer(data, RECORD)
        k, one, back = np.unique(rows["k"], return_index=True, return_inverse=True)
        c = np.bincount(back, rows["c"]).astype(np.int64)
        kept = c >= LEAST
        columns = [k[kept].view(np.int64), *(rows[name][one[kept]].view(np.int64) for name in "xs"), c[kept]]
        yield from pa.table([pa.array(np.ascontiguousarray(x)) for x in columns], names=list("kxsc")).to_batches(100_000)


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy("k").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """The tables of a tree."""

    n: int
    v: int
    counts: DataFrame  # k, c of every training word
    grams: list[DataFrame]  # by size from two words: k, x (context), s (suffix), c, lp (log10 probability), gain
    states: list[DataFrame]  # by length from one word: k, c, s (the context one word shorter), spare (log10 factor for other symbols) of retained contexts

    def gains(self) -> DataFrame | None:
        """k, c and v: the gain of each gram as a pair and as a context."""
        parts = [g.where(F.col("gain") != 0).select("k", "c", F.col("gain").alias("v")) for g in self.grams]
        parts += [s.select("k", "c", F.col("spare").alias("v")) for s in self.states]
        out = None
        for part in parts:
            out = part if out is None else out.unionByName(part)
        return None if out is None else out.groupBy("k").agg(F.max("c").alias("c"), F.sum("v").alias("v"))


def grow(train: DataFrame, depth: int = DEPTH) -> Model:
    """The tree's tables, from a frame with a ``body`` column."""
    counts = stored(_summed(train.transform(in_arrow, _count_words, "k long, c long")), "word-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    model = Model(n, v, counts, [], [])
    kept = counts.where(F.col("c") >= LEAST).select("k", "c", F.lit(0).cast("long").alias("s"), F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("lp"))
    bits = _span_bits(n)
    for size in range(2, depth + 2):
        if kept.isEmpty():
            break
        below = _bitmap(kept.select("k"))
        often = stored(_met(train.transform(in_arrow, _sift(size, below, bits), PACKED)).transform(in_arrow, _sifted, "k long"), f"often-{size}")
        rows = _met(train.transform(in_arrow, _record(size, below, _bitmap(often), bits), PACKED)).transform(in_arrow, _recorded, "k long, x long, s long, c long")
        counted = stored(rows, f"grams-{size}")
        discard(often)
        # a kept gram occurs LEAST times, so its suffix and its context are kept, and have no more grams than occurrences
        suffixes = kept.select(F.col("k").alias("s"), F.col("lp").alias("under"), F.col("c").alias("_of_suffix"))
        rows = stored(join_even(counted, suffixes, "s", "_of_suffix", n).select("k", "x", "s", "c", "under"), f"suffixes-{size}")
        discard(counted)
        states = stored(_states(rows, kept, n), f"states-{size}")
        joined = join_even(rows, states.select("x", "spare", "whole", "retained"), "x", "whole", n)
        lp = F.when(F.col("retained"), F.log10((F.col("c") - DISCOUNT) / F.col("whole"))).otherwise(F.col("under"))
        gain = F.when(F.col("retained"), F.col("lp") - F.col("under") - F.col("spare")).otherwise(F.lit(0.0))
        kept = stored(joined.withColumn("lp", lp).select("k", "x", "s", "c", "lp", gain.alias("gain")), f"kept-{size}")
        discard(rows)
        model.grams.append(kept)
        model.states.append(states.where("retained").select(F.col("x").alias("k"), F.col("whole").alias("c"), "s", "spare"))
        release(train.sparkSession)
    return model


def _states(rows: DataFrame, kept: DataFrame, n: int) -> DataFrame:
    """x, s, whole, spare and retained of every context of ``rows``: the sums of its test, and its own count from ``kept``."""
    c, under = F.col("c"), F.col("under")
    sums = rows.groupBy("x").agg(
        F.count("*").alias("own"), F.sum("c").alias("seen"), F.sum(c - DISCOUNT).alias("left"), F.sum(c * F.log10(c - DISCOUNT)).alias("logs"),
        F.sum(c * under).alias("unders"), F.sum(F.pow(F.lit(10.0), under)).alias("mass"),
    )
    out = sums.join(kept.select(F.col("k").alias("x"), "s", F.col("c").alias("whole")), "x")
    whole = F.col("whole")
    left, left_under = F.greatest(F.lit(1e-12), 1 - F.col("left") / whole), F.greatest(F.lit(1e-9), 1 - F.col("mass"))
    out = out.withColumn("spare", F.log10(left / left_under))
    divergence = (F.col("logs") - F.col("seen") * F.log10(whole) - F.col("unders") + (whole - F.col("seen")) * F.col("spare")) * float(np.log(10))
    return out.select("x", "s", "whole", "spare", (divergence > 0.5 * (F.col("own") + 1) * F.log(whole) + float(np.log(max(n, 1)))).alias("retained"))


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a.astype(U64) << U64(32)) | b.astype(U64))


@dataclass
class Tree:
    """A small model's states in memory, to look at."""

    words: np.ndarray  # sorted hashes of kept words, the end among them
    root: np.ndarray  # log10 probability of each
    retained: np.ndarray = field(default_factory=lambda: np.array([True]))  # state 0 is the root
    parent: np.ndarray = field(default_factory=lambda: np.array([0]))
    spare: np.ndarray = field(default_factory=lambda: np.array([0.0]))  # log10 factor of the shorter state for other symbols
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))  # mixed keys (state, word), sorted
    gain: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 of probability over root's

    def index(self) -> None:
        self.find_pair = HashIndex(self.pairs)


def learn(train: DataFrame, depth: int = DEPTH) -> tuple[Tree, DataFrame, int, int]:
    """A small model in memory, the table of word counts (k, c), N and V; scoring uses the tables."""
    model = grow(train, depth)
    rows = sorted((r["k"] % 2**64, r["c"]) for r in model.counts.where(F.col("c") >= LEAST).collect())
    tree = Tree(np.array([k for k, _ in rows], U64), np.log10(np.array([c + 1 for _, c in rows]) / (model.n + model.v + 1)))
    number, shorter, spare = {}, {}, [0.0]
    for level, states in enumerate(model.states):
        shorter |= {r["k"]: r["s"] for r in model.grams[level - 1].select("k", "s").collect()} if level else {}
        for r in states.collect():
            number[r["k"]] = len(spare)
            spare.append(r["spare"])
    parent = [0]
    for k in number:
        k = shorter.get(k)
        while k is not None and k not in number:
            k = shorter.get(k)
        parent.append(number.get(k, 0))
    word_of = {k: i for i, k in enumerate(tree.words.view(np.int64).tolist())}
    state, word, logs = [], [], []
    last: dict[int, int] = {k: k for k in word_of}
    for grams in model.grams:
        ends = {}
        for r in grams.collect():
            ends[r["k"]] = last[r["s"]]
            if r["x"] in number:
                state.append(number[r["x"]])
                word.append(word_of[ends[r["k"]]])
                logs.append(r["lp"])
        last = ends
    tree.spare, tree.parent, tree.retained = np.array(spare), np.array(parent), np.ones(len(spare), bool)
    if state:
        keys = _pair_key(np.array(state), np.array(word))
        order = np.argsort(keys, kind="stable")
        tree.pairs, tree.gain = keys[order], (np.array(logs) - tree.root[word])[order]
    return tree, model.counts, model.n, model.v


def _collected(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """A bounded table, sorted by its key."""
    table = df.toArrow()
    k, x = table["k"].to_numpy().astype(np.int64).view(U64), table[value].to_numpy()
    order = np.argsort(k, kind="stable")
    return k[order], x[order]


#: Kinds of packed rows: entries of the table of gains, what texts look up, and the texts themselves.
ENTRIES, LOOKUPS, TEXTS = 0, 1, 2
KINDS = "span int, kind int, chunk long, data binary"
ENTRY = np.dtype([("k", "<u8"), ("base", "<f8"), ("gain", "<f8"), ("known", "<u4")])
TEXT = np.dtype([("row", "<u2"), ("null", "u1"), ("doc_id", "<i8"), ("n_tokens", "<i8"), ("n_known", "<i8"), ("base", "<f8"), ("gain", "<f8")])
#: A chunk has less texts than a row number can tell apart.
CHUNK_TEXTS = 60_000


def _kinds(span: np.ndarray, kind: int, chunk: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
    n = len(data)
    columns = [pa.array(span, pa.int32()), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, chunk, np.int64)), pa.array(data, pa.binary())]
    yield from pa.table(columns, names=["span", "kind", "chunk", "data"]).to_batches(500)


def _entries(bits: int):
    """The table of gains by span."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        k = table["k"].to_numpy().astype(np.int64).view(U64)
        order = np.argsort(k, kind="stable")
        data = np.empty(len(k), ENTRY)
        data["k"] = k[order]
        for name in ("base", "gain", "known"):
            data[name] = table[name].to_numpy()[order]
        spans, parts = _cut(data["k"], 64 - bits, data)
        yield from _kinds(spans, ENTRIES, 0, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > RUN:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    return run


def _look(words: np.ndarray, root: np.ndarray, grams: np.ndarray, gains: np.ndarray, others: np.ndarray, sizes: int, missing: float, bits: int):
    """What the broadcast tables know of each text, and what it looks up in the table of gains.

    A word that isn't broadcast has the base score of an unseen one; the table adds what it lacks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find_word, find_gram = HashIndex(words), HashIndex(grams)
        chunk = TaskContext.get().partitionId() << 32
        texts, keys, owners, n_texts, n_keys = [], [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield from _kinds(np.array([chunk % (1 << bits)]), TEXTS, chunk, [np.concatenate(texts).tobytes()])
            k, row = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(k, kind="stable")
            k, row = k[order], row[order].astype("<u2")
            bare = (k << U64(bits)) >> U64(24)
            high, low = (bare >> U64(32)).astype(np.uint8), bare.astype("<u4")
            spans, heads = np.unique((k >> U64(64 - bits)).astype(np.int32), return_index=True)
            # the high bytes of sorted keys hardly change, so they are kept apart and compress well
            cuts = np.append(heads, len(k)).tolist()
            parts = [high[a:b].tobytes() + low[a:b].tobytes() + row[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if parts:
                yield from _kinds(spans, LOOKUPS, chunk, parts)

        for rows, data, bounds in blocks(batches):
            for at in range(0, rows.num_rows, CHUNK_TEXTS):
                part = rows.slice(at, CHUNK_TEXTS)
                n = part.num_rows
                if texts and (n_keys > RUN or n_texts + n > CHUNK_TEXTS):
                    yield from flush()
                    chunk += 1
                    texts, keys, owners, n_texts, n_keys = [], [], [], 0, 0
                ends = bounds[at : at + n + 1]
                symbols, ptr = _symbols(split_words(data[ends[0] : ends[-1]], ends - ends[0]))
                ids = find_word.find(symbols)
                text, place = np.repeat(np.arange(n), np.diff(ptr)), _places(ptr)
                known = ids >= 0
                base, gain = np.bincount(text[known], root[ids[known]], n) + missing * np.bincount(text[~known], minlength=n), np.zeros(n)
                each = symbols
                for size in range(1, sizes + 1):
                    each = _longer(each) if size > 1 else each
                    here = place >= size - 1
                    found = find_gram.find(each)
                    hit = here & (found >= 0)
                    gain += np.bincount(text[hit], gains[found[hit]], n) if hit.any() else 0
                    here &= ~hit
                    if size == 1:  # its entry holds what is known of it as a word and as a context
                        here |= ~known
                    may = here & _passes(others, each)
                    keys.append(each[may])
                    owners.append(text[may] + n_texts)
                    n_keys += int(may.sum())
                out, ids = np.zeros(n, TEXT), part.column("doc_id")
                out["row"], out["null"], out["doc_id"] = np.arange(n) + n_texts, np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
                out["n_tokens"], out["n_known"], out["base"], out["gain"] = np.diff(ptr), np.bincount(text[known], minlength=n), base, gain
                texts.append(out)
                n_texts += n
        if texts:
            yield from flush()

    return run


def _answer(bits: int):
    """Sums by text of the entries that it looks up; texts pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, held, bare, entries = None, [], None, None
        sums: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for chunk, table in sums.items():
                row = np.flatnonzero(table.any(axis=0))
                if len(row):
                    yield from _kinds(np.zeros(1, np.int32), LOOKUPS, chunk, [row.astype("<u2").tobytes() + table[0, row].astype("<u4").tobytes() + table[1:, row].astype("<f8").tobytes()])

        for batch in batches:
            for at, kind, chunk, data in zip(*(batch.column(c).to_pylist() for c in ("span", "kind", "chunk", "data")), strict=True):
                if at != span:
                    span, held, entries = at, [], None
                if kind == ENTRIES:
                    held.append(data)
                elif kind == TEXTS:
                    yield from _kinds(np.zeros(1, np.int32), TEXTS, chunk, [data])
                elif held:
                    if entries is None:
                        entries = np.sort(np.frombuffer(b"".join(held), ENTRY), order="k")
                        bare = (entries["k"] << U64(bits)) >> U64(24)
                    n = len(data) // 7
                    k = (np.frombuffer(data, np.uint8, n).astype(U64) << U64(32)) | np.frombuffer(data, "<u4", n, n)
                    row = np.frombuffer(data, "<u2", n, 5 * n)
                    i = np.minimum(np.searchsorted(bare, k), len(bare) - 1)
                    hit = bare[i] == k
                    i, row = i[hit], row[hit].astype(np.int64)
                    if not len(i):
                        continue
                    n, old = int(row.max()) + 1, sums.get(chunk)
                    if old is None or old.shape[1] < n:
                        grown = np.zeros((3, n))
                        if old is not None:
                            grown[:, : old.shape[1]] = old
                        size += n - (0 if old is None else old.shape[1])
                        sums[chunk] = old = grown
                    for j, name in enumerate(("known", "base", "gain")):
                        old[j, :n] += np.bincount(row, entries[name][i], n)
                    if size > RUN:
                        yield from flush()
                        sums, size = {}, 0
        yield from flush()

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each chunk's texts, from rows sorted by chunk and kind (partial sums before the texts)."""
    chunk, known, base, gain = None, *np.zeros((3, 1))
    for batch in batches:
        for at, kind, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "data")), strict=True):
            if at != chunk:
                chunk, (known, base, gain) = at, np.zeros((3, CHUNK_TEXTS))
            if kind == LOOKUPS:
                n = len(data) // 22
                row = np.frombuffer(data, "<u2", n)
                known[row] += np.frombuffer(data, "<u4", n, 2 * n)
                base[row] += np.frombuffer(data, "<f8", n, 6 * n)
                gain[row] += np.frombuffer(data, "<f8", n, 14 * n)
            else:
                texts = np.frombuffer(data, TEXT)
                row = texts["row"]
                columns = [pa.array(np.ascontiguousarray(texts["doc_id"]), mask=texts["null"] > 0), np.ascontiguousarray(texts["n_tokens"]), texts["n_known"] + known[row].astype(np.int64), texts["base"] + base[row], texts["gain"] + gain[row]]
                yield from pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["doc_id", "n_tokens", "n_known", "base_score", "gain"]).to_batches(10_000)


def score(docs: DataFrame, in_training: Column, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score; learned from the rows where ``in_training``."""
    model = grow(docs.where(in_training).select(body(text_col)), depth)
    n, v = model.n, model.v
    many, missing, bits = max(LEAST, SHARE * n), float(-np.log10(n + v + 1)), _span_bits(n)
    words, c = _collected(model.counts.where(F.col("c") >= many), "c")
    root = np.log10(c + 1) + missing
    zero = F.lit(0.0)
    table = model.counts.where(F.col("c") < many).select("k", F.log10(F.col("c") + 1.0).alias("base"), zero.alias("gain"), F.lit(1).alias("known"))
    grams, gains = np.zeros(0, U64), np.zeros(0)
    every = model.gains()
    if every is not None:
        every = stored(every, "gains")
        grams, gains = _collected(every.where(F.col("c") >= many), "v")
        rest = every.where(F.col("c") < many).select("k", zero.alias("base"), F.col("v").alias("gain"), F.lit(0).alias("known"))
        table = stored(table.unionByName(rest).groupBy("k").agg(F.sum("base").alias("base"), F.sum("gain").alias("gain"), F.sum("known").cast("int").alias("known")), "entries")
        discard(every, *model.grams)
    others = _bitmap(table.select("k"))
    release(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col)).transform(in_arrow, _look(words, root, grams, gains, others, len(model.grams) + 1, missing, bits), KINDS)
    asked = _met(table.transform(in_arrow, _entries(bits), KINDS).unionByName(rows), "kind").transform(in_arrow, _answer(bits), KINDS)
    out = asked.repartition("chunk").sortWithinPartitions("chunk", "kind").transform(in_arrow, _total, "doc_id long, n_tokens long, n_known long, base_score double, gain double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gain")).alias("score"))
