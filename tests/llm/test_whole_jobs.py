"""Operators do the whole job: nothing is cut by length, share or size of the input."""

import os
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import _tokens, language, licenses, suffix_tree, toxicity
from orrery.llm._text import split_words
from orrery.storage import in_arrow


def words(text):
    return (text or "").split()


def test_rare_contexts_stay_in_large_training(spark):
    """A context's support is a count, not a share of the tokens."""
    rng = np.random.default_rng(3)
    filler = [(i, " ".join(f"f{x}" for x in rng.integers(0, 50, 2000))) for i in range(200)]
    df = spark.createDataFrame([*filler, *((1000 + i, "alpha beta gamma") for i in range(8)), (2000, "alpha beta gamma")], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in suffix_tree.score(df, F.col("doc_id") < 2000).collect()}
    assert got[2000]["score"] > got[2000]["base_score"] + 3


@pytest.mark.parametrize("share", [None, 0.01])
def test_suffix_tree_by_brute_force(spark, monkeypatch, share):
    if share:
        monkeypatch.setattr(suffix_tree, "SHARE", share)
    rng = np.random.default_rng(4)
    lines = ["a b c d e f", "a b d c a b", "x b c y b c", "c d e f a b c d", "q r s t"]
    texts = [" ".join(lines[k] for k in rng.integers(0, 5, rng.integers(1, 12))) for _ in range(120)]
    df = spark.createDataFrame([*enumerate(texts), (500, "b c zz a b c d q r"), (501, None)], "doc_id long, text string")
    every, counts = [[*words(t), None] for t in texts], Counter()
    for t in every:
        counts.update(tuple(t[i : i + m]) for m in range(1, 5) for i in range(len(t) - m + 1))
    one = {g[0]: c for g, c in counts.items() if len(g) == 1}
    n, v, states = sum(one.values()), len(one), {}

    def log_p(context, w):
        while context and context not in states:
            context = context[1:]
        if not context:
            return np.log10((one.get(w, 0) + 1) / (n + v + 1))
        own, spare = states[context]
        return own[w] if w in own else spare + log_p(context[1:], w)

    for size in range(1, 4):
        new = {}
        for context in {g[:-1] for g, c in counts.items() if len(g) == size + 1 and c >= suffix_tree.LEAST}:
            own, whole = {w: counts[*context, w] for w in one if counts[*context, w] >= suffix_tree.LEAST}, counts[context]
            p, under = {w: np.log10((c - suffix_tree.DISCOUNT) / whole) for w, c in own.items()}, {w: log_p(context[1:], w) for w in own}
            spare = np.log10(max(1e-12, 1 - sum(10**x for x in p.values())) / max(1e-9, 1 - sum(10**x for x in under.values())))
            gain = (sum(c * (p[w] - under[w]) for w, c in own.items()) + (whole - sum(own.values())) * spare) * np.log(10)
            if gain > 0.5 * (len(own) + 1) * np.log(whole) + np.log(n):
                new[context] = (p, spare)
        states |= new
    assert {len(s) for s in states} == {1, 2, 3}
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(df, F.col("doc_id") < 500).collect()}
    for i, t in [*enumerate(texts), (500, "b c zz a b c d q r"), (501, None)]:
        t = [*words(t), None]
        assert got[i] == pytest.approx(sum(log_p(tuple(t[max(0, j - 3) : j]), w) for j, w in enumerate(t)))


def test_toxic_word_behind_byte_24(spark, monkeypatch):
    rng = np.random.default_rng(5)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(200):
        text = [str(x) for x in rng.choice(plain, 40)]
        if i % 2:
            text[int(rng.integers(40))] = "grubvilex"
        rows.append((" ".join(text).encode(), i % 2))
    p = toxicity.train(rows)
    clean = " ".join(plain[:20])
    glued = "_".join(plain[20:40])
    df = spark.createDataFrame([(1, f"{clean} {glued}_tail"), (2, f"{clean} {glued}_grubvilex_tail")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, p).collect()}
    assert got[2] > got[1]
    text = ("ab " + "x" * 100 + "grubvilex").encode()
    features = toxicity.Features(split_words(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    assert sorted(features.n_grams.tolist()) == [2 + 1, 109 + 108 + 107]
    assert features.vectors(p)[:-1, -1].max() > 0.5
    whole = features.vectors(p)
    monkeypatch.setattr(toxicity, "SIZE_AT_ONCE", 7)
    again = toxicity.Features(split_words(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    assert (again.grams == features.grams).all() and again.vectors(p) == pytest.approx(whole, abs=1e-6)


def test_every_piece_and_whole_words_in_segmentations():
    pieces = language.Pieces(language.vocabulary())
    assert max(len(p) for p in pieces.pieces) == language.LONGEST
    known = {x: i for i, x in enumerate(pieces.pieces)}
    rng = np.random.default_rng(6)
    p = rng.random((len(pieces.pieces), 2))
    p /= p.sum(axis=0)
    texts = ["international", "x" * 40, "understanding" * 9, "日本語の文章を読む" * 5, "a" * 33, "=" * 200]
    text = " ".join(texts).encode()
    w = split_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    got = language.word_scores(pieces, language._padded(p), w.data, w.start, w.end)
    for i, x in enumerate(texts):
        b = b" " + x.encode()
        for k in (0, 1):
            logs = [0.0]
            for j in range(1, len(b) + 1):
                logs.append(np.logaddexp.reduce([logs[m] + np.log(p[known[b[m:j]], k]) for m in range(max(0, j - language.LONGEST), j) if b[m:j] in known]))
            assert got[i, k] == pytest.approx(logs[-1])


def test_long_words_are_learned_whole():
    tail = "qzvxj" * 20
    model = language.fit([("a", ("o" * 32 + tail).encode()), ("b", ("o" * 32 + "mnwrt" * 20).encode())], language.vocabulary())
    pieces = language.Pieces(model.path)
    text = tail.encode()
    got = language.word_scores(pieces, language._padded(model.table), np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))
    assert got[0, 0] > got[0, 1] + 5


def test_shortened_gpl_notice_is_found(spark):
    text = "You can redistribute it and/or modify it under the terms of the GNU license."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert "gpl" in licenses.scan(df).collect()[0]["labels"].split(",")
    df = spark.createDataFrame([(1, "X11 license"), (2, "licensed under expat"), (3, "ASF 2.0")], "doc_id long, text string")
    assert all(r["labels"] for r in licenses.scan(df).collect())


def test_all_links_are_found_and_counted(spark):
    """The whole join: links between classes of equal sets, and links per document, copies counted."""
    from orrery.llm import ngram_join

    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):  # near copies of one text, each with edits of its own
        t = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            t[k] = f"x{rng.integers(0, 6)}"
        texts.append(" ".join(t))
    texts += [texts[0], texts[3].upper(), "", None, "short one", "Short  one", *(" ".join(str(x) for x in rng.integers(0, 40, 30)) for _ in range(10))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()})
    near = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    links, members = ngram_join.similarity_links(df)
    members = {r["doc_id"]: r for r in members.collect()}
    degree = Counter(x for pair in near for x in pair)
    assert {i: r["n_links"] for i, r in members.items()} == {i: degree[i] for i in range(len(sets))}
    rep = {i: r["rep"] for i, r in members.items()}
    assert {(r["a"], r["b"]) for r in links.collect()} == {(min(rep[a], rep[b]), max(rep[a], rep[b])) for a, b in near if rep[a] != rep[b]}
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_groups(df).collect()}
    for a, b in near:
        assert groups[a] == groups[b]


@pytest.mark.parametrize("rounds", [0, 1])
def test_groups_do_not_hang_on_leaders(spark, monkeypatch, rounds):
    """With few or no leader rounds the last round alone finds the same groups."""
    from orrery.llm import ngram_join

    monkeypatch.setattr(ngram_join, "HEADS", 1)
    rng = np.random.default_rng(9)
    common = [f"c{i}" for i in range(40)]
    texts = [" ".join([*common, *(f"t{rng.integers(0, 3)}{j}" for j in range(4))]) for _ in range(30)] + [" ".join([*common[:20], *(f"u{rng.integers(0, 99)}" for _ in range(20))]) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_groups(df).collect()}
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_groups(df).collect()} == want
    assert len(set(want.values())) < len(want)


def test_scores_by_a_plain_loop():
    """One window's logit, word by word and gate by gate."""
    rng = np.random.default_rng(10)
    p = toxicity._fresh(rng)
    dim, h = toxicity.WORD_DIM + toxicity.GRAM_DIM + 1, toxicity.HIDDEN
    vectors = np.vstack([rng.standard_normal((7, dim)), np.zeros((1, dim))]).astype(np.float32)
    tokens = np.array([[3, 0, 6, 2, 2, 7, 7, 7]])
    logit = lambda x: 1 / (1 + np.exp(-x))

    def run(w, u, b, order):
        state, out = np.zeros(h), {}
        for t in order:
            x, s = vectors[tokens[0, t]] @ p[w] + p[b], state @ p[u]
            z, r = logit(x[:h] + s[:h]), logit(x[h : 2 * h] + s[h : 2 * h])
            state = (1 - z) * np.tanh(x[2 * h :] + r * s[2 * h :]) + z * state
            out[t] = state
        return out

    ahead, behind = run("wf", "uf", "bf", range(5)), run("wb", "ub", "bb", range(4, -1, -1))
    states = [np.concatenate([ahead[t], behind[t]]) for t in range(5)]
    weight = np.exp([np.tanh(s @ p["a"]) @ p["v"] for s in states])
    want = sum(w * s for w, s in zip(weight / weight.sum(), states, strict=True)) @ p["w"] + p["b"][0]
    assert toxicity.forward(p, vectors, tokens)[0][0] == pytest.approx(want, abs=1e-5)


def test_many_sources_give_the_same_mix(spark, monkeypatch):
    from orrery.llm import mixing

    df = spark.createDataFrame([(i, "a b c " * (i % 9), "hot" if i % 3 else f"s{i % 7}") for i in range(300)], "doc_id long, text string, source string")
    rows = lambda: sorted(tuple(r) for r in mixing.mix_rows(df).collect())
    want = rows()
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    assert rows() == want


def test_one_id_may_lie_in_many_files(spark, tmp_path):
    from orrery.llm import token_files

    df = spark.createDataFrame([(7, f"text number {i}") for i in range(400)], "doc_id long, text string")
    manifest = token_files.write_token_files(df, shards=5)
    assert manifest.count() > 1 and token_files.read_token_files(manifest).count() == 400


def test_model_comes_in_small_rows(spark):
    """The driver gets the trained network in rows of a bounded size, spread over partitions, and whole."""
    texts = [(i, f"{'vile awful' if i % 2 else 'kind gentle'} word{i} and more{i * 7} of it{i * 3}".encode(), i % 2) for i in range(40)]
    rows = [pa.record_batch([pa.array([t[0] for t in texts]), pa.array([t[1] for t in texts], pa.binary()), pa.array([t[2] for t in texts])], names=["doc_id", "body", "label"])]
    pieces = [(b["at"][0].as_py(), b["model"][0].as_py()) for b in toxicity._fit(iter(rows))]
    assert len(pieces) > 8 and max(len(m) for _, m in pieces) <= toxicity.MODEL_PIECE
    want = toxicity.train([(t[1], t[2]) for t in texts])
    got = toxicity.fit(spark.createDataFrame(texts, "doc_id long, body binary, label int"))
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)


def test_workers_hand_back_memory(spark):
    """What a pass has freed doesn't stay with its worker, beside the next stages' rows."""

    class Frame:
        sparkSession = spark

        def mapInArrow(self, function, schema):
            return function

    def resident() -> float:
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    def work(batches):
        used = [bytes(2000) for _ in range(100_000)]
        kept.append(bytes(2000))  # the heap's end stays in use
        del used
        during.append(resident())
        yield from batches

    kept, during, before = [], [], resident()
    batch = pa.record_batch([pa.array([1])], names=["x"])
    assert list(in_arrow(Frame(), work, "x long")(iter([batch]))) == [batch]
    assert during[0] - before > 150 and resident() - before < 60


def test_working_memory_is_bounded():
    """Encoding and training take little more than their blocks and their sample."""
    text = (" ".join(f"word{i % 997} and more" for i in range(200)) + " ").encode()
    batch = pa.record_batch([pa.array(range(2000)), pa.array([text] * 2000, pa.binary())], names=["doc_id", "body"])
    tracemalloc.start()
    try:
        ids = [len(flat) for _, flat, _ in _tokens.encoded(iter([batch]), _tokens.vocabulary())]
        assert len(ids) > 1 and tracemalloc.get_traced_memory()[1] < 130e6
        tracemalloc.reset_peak()
        per_text = np.full(200, 8000)
        place, owner = toxicity.windows(per_text, np.concatenate([[0], np.cumsum(per_text)]))
        assert tracemalloc.get_traced_memory()[1] < 1.6 * place.nbytes
    finally:
        tracemalloc.stop()
    assert place.max() == per_text.sum() - 1 and (np.bincount(place[place >= 0]) > 0).all()
