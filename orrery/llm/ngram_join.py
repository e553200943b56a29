"""N-gram Jaccard similarity join with rare-first prefix filtering.

A document's set holds its distinct word n-grams (of a shorter text: all its
words as one).  Two documents link if their sets' Jaccard similarity reaches
``percent`` / 100.

1. Frequencies: sorted runs of n-gram hashes are merged by hash range, over all
   documents, and leave the n-grams that several documents hold.  A bitmap of
   these (at most 2**MOST_BITS bits, all of them pass) and how often they fall into
   2**SKETCH_BITS hash buckets are broadcast.  They only order n-grams: those of one
   document first, then rare buckets, ties by hash; any order gives the same links.
2. Documents with equal sets form a class; one of each class goes on.
3. The prefix of a set are its rarest n-grams, of which any partner must share
   one.  Each class posts those of its prefix that aren't its own alone; posts
   that stand alone are dropped.
4. Candidates are filtered by length, by the positions of the shared n-gram in
   both sets, and by a suffix filter (counts of the n-grams by hash range bound
   the overlap from above).
5. Every pair of candidates is verified once, on whole sets.

Pairs within a group that is already connected are not needed: in ``ROUNDS``
rounds each n-gram's group is compared with one leader only, and what is linked
is merged into components.  Then all remaining pairs between different
components of a group are verified, so no link between components is lost, yet
a group of near copies costs as many pairs as it has members.

N-grams are known by 64-bit hashes, classes by 128 bits.  Defined cases: texts
without words (null, empty) have an empty set and link with nothing; an id names
one document, rows that repeat it are its copies; a null id links only through
equal sets; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm._joins import join_even, unused
from orrery.llm._text import U64, Words, blocks, body, mix, split_words
from orrery.storage import discard, in_arrow, release, stored

SKETCH_BITS = 20
RANGES = 128
MOST_BITS = 27
ROUNDS = 2
HEADS = 32
#: N-grams of a run: what a task holds before it passes them on to the 4096 hash ranges.
RUN = 1_000_000
SETS = "doc_id long, n_shingles long, key binary, first int, prefix array<long>, spread binary"


def shingles(words: Words, n: int) -> list[np.ndarray]:
    """The sorted set of n-gram hashes of every text."""
    h = words.hash
    whole = h.copy()
    for j in range(1, n):
        whole[: len(h) - j] = mix(whole[: len(h) - j] * U64(0x9E3779B97F4A7C15) + h[j:])
    out = []
    for a, b in zip(words.ptr[:-1].tolist(), words.ptr[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            one = U64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    one = mix(np.array([one * U64(0x9E3779B97F4A7C15) + x]))[0]
            out.append(np.array([one], U64))
        else:
            out.append(h[:0])
    return out


def overlap_needed(a, b, percent: int):
    """Smallest overlap of sets of the sizes a and b that link: ceil(percent (a + b) / (100 + percent))."""
    return -(-percent * (a + b) // (100 + percent))


def _runs(n: int):
    """Runs: by hash range (the top 12 bits), the next 32 bits of the n-grams in order, twice if several documents hold them."""

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, times = np.unique(np.concatenate(held) >> U64(20), return_counts=True)
        keys = np.repeat(keys, np.minimum(times, 2))
        spans, heads = np.unique((keys >> U64(32)).astype(np.int32), return_index=True)
        raw, cuts = keys.astype("<u4").tobytes(), np.append(heads, len(keys)) * 4
        values = pa.array([raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
        yield from pa.table([pa.array(spans), values], names=["span", "keys"]).to_batches(500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, data, bounds in blocks(batches):
            held += shingles(split_words(data, bounds), n)
            size = sum(len(x) for x in held)
            if size > RUN:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams (44 bits of the hash) that several documents of a range's runs hold, and how often the runs have them."""

    def merged(span: int, raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, c = np.unique(np.frombuffer(b"".join(raw), "<u4"), return_counts=True)
        keys, c = keys[c > 1].astype(np.int64) | (span << 32), c[c > 1]
        for i in range(0, len(keys), 100_000):
            yield pa.record_batch([pa.array(keys[i : i + 100_000]), pa.array(c[i : i + 100_000])], names=["k", "c"])

    at, held = None, []
    for batch in batches:
        for span, raw in zip(batch.column("span").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            if span != at and held:
                yield from merged(at, held)
                held = []
            at = span
            held.append(raw)
    if held:
        yield from merged(at, held)


@dataclass
class Order:
    """The order of n-grams: a bitmap of those that several documents hold, and counts by hash bucket."""

    shared: np.ndarray
    counts: np.ndarray

    def of(self, grams: np.ndarray) -> np.ndarray:
        """0 for n-grams of one document, more for more frequent ones."""
        return np.where(self._passes(grams), self.counts[(grams >> U64(64 - SKETCH_BITS)).astype(np.int64)] + 1, 0)

    def _passes(self, grams: np.ndarray) -> np.ndarray:
        at = _slot(grams >> U64(20), len(self.shared).bit_length() + 5)
        return (self.shared[at >> 6] >> (at & 63).astype(U64)) & U64(1) > 0


def _marks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k").to_numpy().astype(U64)
            at = _slot(k, bits)
            yield pa.record_batch([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(U64)).view(np.int64)), pa.array((k >> U64(44 - SKETCH_BITS)).astype(np.int64)), batch.column("c")], names=["word", "bit", "bucket", "c"])

    return run


def frequencies(docs: DataFrame, n: int) -> Order:
    """The order of all documents' n-grams (a frame with ``body``)."""
    runs = docs.transform(in_arrow, _runs(n), "span int, keys binary").repartition("span").sortWithinPartitions("span")
    found = stored(runs.transform(in_arrow, _merge, "k long, c long"), "shared")
    bits = min(MOST_BITS, max(12, int(np.ceil(np.log2(max(1, 8 * found.count()))))))
    marks = found.transform(in_arrow, _marks(bits), "word long, bit long, bucket long, c long")
    words = marks.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    shared = np.zeros(1 << (bits - 6), np.int64)
    shared[words["word"].to_numpy()] = words["bit"].to_numpy()
    del words
    buckets = marks.groupBy("bucket").agg(F.least(F.sum("c"), F.lit(2**31 - 2)).cast("int").alias("c")).toArrow()
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    counts[buckets["bucket"].to_numpy()] = buckets["c"].to_numpy()
    discard(found)
    return Order(shared.view(U64), counts)


def _sets(n: int, percent: int, rank: Order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in blocks(batches):
            sets = shingles(split_words(data, bounds), n)
            sizes = np.array([len(s) for s in sets], np.int64)
            orders = np.split(rank.of(np.concatenate(sets)), np.cumsum(sizes)[:-1])
            keys, firsts, prefixes, spreads = [], [], [], []
            for s, order in zip(sets, orders, strict=True):
                size = len(s)
                if not size:
                    keys.append(None)
                    firsts.append(0)
                    prefixes.append([])
                    spreads.append(None)
                    continue
                keys.append(np.array([mix(s).sum(), mix(s ^ U64(0x5851F42D4C957F2D)).sum()], U64).tobytes())
                length = size - -(-percent * size // 100) + 1
                own = int((order == 0).sum())
                near = np.flatnonzero(order)  # what only this document holds comes first and needs no post
                left = max(0, length - own)
                if left < len(near):
                    last = np.partition(order[near], left - 1)[left - 1] if left else -1
                    near = near[order[near] <= last]  # all of the last frequency, so that ties go by hash
                firsts.append(own)
                prefixes.append(s[near[np.lexsort((s[near], order[near]))][:left]].view(np.int64))
                spreads.append(np.minimum(np.bincount((mix(s) >> U64(57)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes())
            columns = [rows.column("doc_id"), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(firsts, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(spreads, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "n_shingles", "key", "first", "prefix", "spread"])

    return run


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(U64)) >> U64(64 - bits)).astype(np.int64)


def _slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in ("a", "b"):
                at = _slot(batch.column(c).to_numpy(), bits)
                yield pa.record_batch([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(U64)).view(np.int64))], names=["word", "bit"])

    return run


def membership(pairs: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of hashed ids that occur in pairs, of at most 2**MOST_BITS bits: all of them pass, few others do."""
    bits = min(MOST_BITS, max(12, int(np.ceil(np.log2(max(1, 32 * pairs.count()))))))
    table = pairs.transform(in_arrow, _slots(bits), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[table["word"].to_numpy()] = table["bit"].to_numpy()
    return out.view(U64), bits


def _wanted(marks: np.ndarray, bits: int):
    """Texts whose ids pass the bitmap, lower-cased and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            at = _slot(np.asarray(batch.column("doc_id").fill_null(0)), bits)
            hit = (marks[at >> 6] >> (at & 63).astype(U64)) & U64(1) > 0
            part = batch.filter(pa.array(hit)).filter(pa.compute.is_valid(batch.column("doc_id").filter(pa.array(hit))))
            if part.num_rows:
                yield pa.record_batch([part.column("doc_id"), pa.array([pack.compress(t.as_py().lower()) for t in part.column("body")], pa.binary())], names=["doc_id", "packed"])

    return run


def _near(percent: int):
    """Suffix filter: differences of the counts by hash range bound the sets' symmetric difference from below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int16) for c in ("spread_a", "spread_b"))
                a, b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                keep = np.abs(x - y).sum(axis=1) <= a + b - 2 * overlap_needed(a, b, percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verify(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (unpack.decompress(batch.column(c)[i].as_py()) for c in ("packed_a", "packed_b"))
                s, t = shingles(split_words(np.frombuffer(x + y, np.uint8), np.array([0, len(x), len(x) + len(y)])), n)
                both = np.concatenate([s, t])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component, for nodes with an edge (columns a and b)."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        by_node = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        lowest = both.join(by_node, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        moved = labels.join(lowest, "node").select("node", F.least("label", "other").alias("next"), F.col("label").alias("was"))
        # and on to the label's own label
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        new = stored(moved.join(jump, "next", "left").select("node", F.least("next", F.coalesce("beyond", "next")).alias("label"), "was"), "labels")
        discard(labels)
        labels = new
        if not new.where("label <> was").limit(1).count():
            discard(both)
            return labels.select("node", "label")


def _verified(pairs: DataFrame, docs: DataFrame, spreads: DataFrame, n: int, percent: int) -> DataFrame:
    """The linking ones of distinct pairs (a, b)."""
    sa, sb = (spreads.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("spread").alias(f"spread_{c}")) for c in "ab")
    near = stored(pairs.join(sa, "a").join(sb, "b").select("a", "b", "n_a", "n_b", "spread_a", "spread_b").transform(in_arrow, _near(percent), "a long, b long"), "candidates")
    texts = stored(docs.transform(in_arrow, _wanted(*membership(near)), "doc_id long, packed binary"), "texts")
    ta, tb = (texts.select(F.col("doc_id").alias(c), F.col("packed").alias(f"packed_{c}")) for c in "ab")
    # rows that repeat an id repeat its text, and so its pairs
    return near.join(ta, "a").join(tb, "b").select("a", "b", "packed_a", "packed_b").transform(in_arrow, _verify(n, percent), "a long, b long").distinct()


def _fitting(left: str, right: str, percent: int):
    """Length and positional filters on two posts (size and place of the shared n-gram)."""
    a, b, i, j = F.col(f"{left}.n"), F.col(f"{right}.n"), F.col(f"{left}.at"), F.col(f"{right}.at")
    needed = F.ceil(percent * (a + b) / (100 + percent) - 1e-9)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (F.least(a - i, b - j) >= needed)


def _leaders(posts: DataFrame, member: Column) -> DataFrame:
    """The member of each n-gram's group with the fewest rarer n-grams: of near copies, one with few changes."""
    first = F.min(F.struct("at", F.xxhash64("doc_id"), member.alias("m")))
    return posts.groupBy("gram").agg(first.alias("x")).select("gram", F.col("x.m").alias("l"))


def _across(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs (m, l) of members of different components of an n-gram's group that may link, each at the first n-gram that both have.

    Members of a group's largest component aren't paired with each other, only
    with the others, so a group of near copies costs its stragglers times its size,
    and what doesn't fit never leaves the join.  A pair's first shared n-gram is known
    from the ``HEADS`` first ones of either prefix; beyond these a pair may be met
    again.
    """
    heads = posts.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "gram"))), 1, HEADS).alias("heads"))
    before = F.transform(F.filter("heads", lambda h: h["at"] < F.col("at")), lambda h: h["gram"])
    sizes = posts.groupBy("gram", "label").agg(F.count("*").alias("size"))
    major = sizes.groupBy("gram").agg(F.max(F.struct("size", "label")).alias("x")).select("gram", F.col("x.label").alias("major"))
    full = stored(posts.join(heads, "doc_id").join(major, "gram").select("gram", "doc_id", "n", "at", "label", before.alias("before"), (F.col("label") == F.col("major")).alias("main")), "sides")
    side = F.struct("doc_id", "n", "at", "label", "before", "main")
    minor, every = full.where("not main").select("gram", side.alias("m")), full.select("gram", side.alias("l"))
    met = (F.col("m.label") != F.col("l.label")) & (F.col("l.main") | (F.col("m.doc_id") < F.col("l.doc_id"))) & _fitting("m", "l", percent) & ~F.arrays_overlap("m.before", "l.before")
    return minor.join(every.hint("merge"), "gram").where(met)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


@dataclass
class Posted:
    """What a join starts from."""

    texts: DataFrame  # doc_id, body
    sets: DataFrame  # a row a document
    classes: DataFrame  # key, rep, members: documents with equal sets
    spreads: DataFrame  # doc_id, n, spread of one document of each class
    posts: DataFrame  # gram, doc_id, n, at


def _posted(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> Posted:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col))
    rank = frequencies(texts, n)
    sets = stored(texts.transform(in_arrow, _sets(n, percent, rank), SETS), "sets")
    classes = stored(sets.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes")
    one = sets.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.first(F.struct("n_shingles", "first", "prefix", "spread")).alias("x"))
    one = stored(one.select("doc_id", F.col("x.n_shingles").alias("n"), "x.first", "x.prefix", "x.spread"), "representatives")
    posts = one.select("doc_id", "n", "first", F.posexplode("prefix").alias("at", "gram")).withColumn("at", F.col("at") + F.col("first"))
    shared = posts.groupBy("gram").agg(F.count("*").alias("df"), F.min("n").alias("least")).where("df > 1").select("gram", "least")
    # a post whose n-gram comes too late for even the smallest partner in its group is of no use
    partner = F.greatest(F.col("least"), F.ceil(percent * F.col("n") / 100 - 1e-9))
    useful = F.col("n") - F.col("at") >= F.ceil(percent * (F.col("n") + partner) / (100 + percent) - 1e-9)
    posts = stored(posts.join(shared.hint("shuffle_merge"), "gram").where(useful).select("gram", "doc_id", "n", "at"), "posts")
    release(docs.sparkSession)
    return Posted(texts, sets, classes, one.select("doc_id", "n", "spread"), posts)


def similarity_links(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole join: all links (a, b) between classes of equal sets, and the classes' members (doc_id, n_shingles, rep, members, n_links).

    ``a`` and ``b`` are the smallest ids of their classes.  ``n_links`` counts a
    document's links to other documents, those of its own class among them.
    Every candidate pair is verified, so the work grows with the number of links:
    m different near copies of one text have up to m (m - 1) / 2.  Where only the
    groups are wanted, ``similarity_groups`` needs far fewer.
    """
    p = _posted(docs, n, percent, id_col, text_col)
    member = F.struct("doc_id", "n", "at")
    m, other = p.posts.select("gram", member.alias("m")), p.posts.select("gram", member.alias("l"))
    pairs = m.join(other, "gram").where("m.doc_id < l.doc_id").where(_fitting("m", "l", percent))
    pairs = stored(pairs.select(F.col("m.doc_id").alias("a"), F.col("l.doc_id").alias("b")).distinct(), "pairs")
    links = stored(_verified(pairs, p.texts, p.spreads, n, percent), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = p.classes.where("rep is not null").select(F.col("rep").alias("b"), F.col("members").alias("size"))
    others = both.join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("others"))
    final = p.classes.join(others, "rep", "left").select("key", "rep", "members", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    rows = p.sets.select("doc_id", "n_shingles", "key")
    members = join_even(rows.where("n_shingles > 0"), final, "key", "members", p.sets.count())
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"), F.lit(1).cast("long").alias("members"), F.lit(0).cast("long").alias("n_links"))
    return links, members.select(alone.columns).unionByName(alone)


def similarity_groups(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id (smallest id reachable by links)."""
    p = _posted(docs, n, percent, id_col, text_col)
    texts, sets, classes, spreads, posts = p.texts, p.sets, p.classes, p.spreads, p.posts
    total = sets.count()
    labels, verified = None, None
    for turn in range(ROUNDS + 1):
        if labels is None:
            posts = posts.withColumn("label", F.col("doc_id"))
        else:
            placed = posts.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
            mixed = placed.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("gram")
            posts = stored(placed.join(mixed, "gram", "left_semi").select("gram", "doc_id", "n", "at", "label"), "posts")
        member = F.struct("doc_id", "n", "at", "label")
        if turn < ROUNDS:
            leader = _leaders(posts, member)
            for _ in range(turn):  # the next leader is of another component
                others = posts.join(leader, "gram").where("label <> l.label").select(posts.columns)
                leader = _leaders(others, member)
            pairs = posts.select("gram", member.alias("m")).join(leader, "gram").where("m.label <> l.label")
        else:
            pairs = _across(posts, percent)
        pairs = _ordered(pairs.where(_fitting("m", "l", percent)).select(F.col("m.doc_id").alias("x"), F.col("l.doc_id").alias("y")))
        if verified is not None:
            pairs = pairs.join(verified, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        links = stored(_verified(pairs, texts, spreads, n, percent), "links")
        verified = pairs if verified is None else verified.unionByName(pairs)
        # known components and new links between them
        known = links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = components(known)
        posts = posts.drop("label")
        release(docs.sparkSession)  # each round leaves some ten plans to the driver
    final = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "members", F.coalesce("label", "rep").alias("component_id"))
    members = join_even(sets.where("n_shingles > 0").select("doc_id", "n_shingles", "key"), final, "key", "members", total)
    alone = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return members.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of each group, and all that are in none."""
    kept_id = unused(docs, "kept_id")
    groups = similarity_groups(docs, n, percent, id_col, text_col)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)), "left_semi")
