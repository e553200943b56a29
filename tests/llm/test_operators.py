"""Every operator against a brute-force version, on odd documents and on the smallest tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from orrery.llm import exact_dedup, language, licenses, media, mixing, ngram_join, packing, suffix_tree, token_files, toxicity
from orrery.llm._text import remainder
from orrery.llm._tokens import vocabulary

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(UPPER)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- 5 exact dedup ------------------------------------------------------------------
@pytest.mark.parametrize("which", ["odd", "docs", "empty"])
def test_exact_dedup(which, request):
    df = request.getfixturevalue(which)
    rows, groups = plain(df), {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    want = []
    for i, t in rows:
        g = groups[low(t)]
        best = max((x for x in g if x is not None), default=None)
        want.append((i, best, len(g), i == best, hashlib.sha256(low(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_groups(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_dedup_keeps_columns(odd):
    kept = exact_dedup.dedup_exact(odd, keep="smallest")
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 6, 7, 7, 9, 10, 11, 12, 14, 15]


def test_heavy_group_is_spread(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same' else concat('t', id) end as text")
    got = exact_dedup.exact_groups(df)
    assert got.count() == 3000 and got.where("group_size = 1000 and keep_id = 2997").count() == 1000


# --- 2 packing ----------------------------------------------------------------------
@pytest.mark.parametrize("which", ["odd", "docs", "empty"])
def test_packing(which, request, tokenizer):
    df = request.getfixturevalue(which)
    rows = packing.pack(df).collect()
    text = {}
    for i, t in plain(df):
        text.setdefault(i, []).append(ids_of(tokenizer, t))
    seen, sequences = Counter(), {}
    for r in rows:
        own = text[r["doc_id"]][0]
        piece = own[r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(piece) > 0 and r["doc_tokens"] == len(own) and r["ids_crc32"] == crc(piece) and r["ids"] == piece
        seen[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_length"]))
    assert seen == {i: len(x[0]) * len(x) for i, x in text.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length, total in sorted(pieces):
            assert offset == at
            at += length
        assert at == pieces[0][2] <= 4096


def test_differencing():
    groups, sums = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sums) == [14, 16] and sorted(itertools.chain(*groups)) == [0, 1, 2, 3, 4]  # the method's known result
    sizes = np.random.default_rng(3).integers(1, 600, 200).tolist()
    found = packing.windows(sizes, 4096)
    fill = [sum(sizes[i] for i in g) for g in found]
    assert max(fill) <= 4096 and sum(fill) == sum(sizes) and len(found) <= -(-sum(sizes) // 4096) + 1
    assert packing.windows([3000, 3000, 3000], 4096) == [[0], [1], [2]] or len(packing.windows([3000, 3000, 3000], 4096)) == 3


# --- 8 token files ------------------------------------------------------------------
@pytest.mark.parametrize("which", ["odd", "docs", "empty"])
def test_token_files(which, request, tokenizer):
    df = request.getfixturevalue(which)
    manifest = token_files.write_token_files(df, shards=3)
    got = token_files.read_token_files(manifest).collect()
    text = {i: ids_of(tokenizer, t) for i, t in plain(df)}
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in plain(df))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (at, len(text[r["doc_id"]]), crc(text[r["doc_id"]]), text[r["doc_id"]])
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_token_files_random_access(docs, tokenizer):
    import zstandard

    manifest = token_files.write_token_files(docs, shards=4)
    want = [r["doc_id"] for r in docs.limit(3).collect()]
    got = token_files.read_token_files(manifest, doc_ids=want).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    path = manifest.first()["path"].removeprefix("file://")
    file = token_files.TokenFile("file://" + path)
    raw = open(path, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole == b"".join(file.ids(k).tobytes() for k in range(len(file.doc_ids)))  # any zstandard reader can read it
    broken = bytearray(raw)
    broken[12] ^= 0xFF
    open(path + ".broken", "wb").write(broken)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.TokenFile("file://" + path + ".broken").ids(0)


# --- 6 media ------------------------------------------------------------------------
@pytest.mark.parametrize("which", ["odd", "docs", "empty"])
def test_media(which, request):
    df = request.getfixturevalue(which)
    got = media.read_media(media.encode_media(df)).collect()
    assert len(got) == df.count()
    want = Counter()
    for i, t in plain(df):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64) or bytes(64)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    by = {}
    for r in got:
        same = (r["media_bytes"], r["media_sha256"], r["feature"])
        assert by.setdefault(r["payload_sha256"], same) == same


def test_media_any_bytes_and_other_tables():
    rng = np.random.default_rng(0)
    for raw in (b"\xff" * 640, bytes(range(256)), rng.integers(0, 256, 640_000, dtype=np.uint8).tobytes()):
        batch = media.pa.record_batch([media.pa.array([1]), media.pa.array([raw], media.pa.binary())], names=["doc_id", "body"])
        stored = next(media._encode(iter([batch])))
        assert next(media._decode(iter([stored])))["payload"][0].as_py() == raw
    stream = media._head(2)
    assert media.Stream(stream + b"\x00\xff\xd9", 0).height == 16
    with pytest.raises(ValueError):
        media.Stream(b"GIF8", 0)


# --- 9 mixing -----------------------------------------------------------------------
def filled(sizes, weights, epochs=3):
    """Clamp and reshare until nothing is above its cap."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level >= epochs * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        target |= {s: epochs * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize("which", ["odd", "docs", "empty"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    got = mixing.mix_rows(df).collect()
    source, sizes = {}, Counter()
    for r in df.collect():
        source[r["doc_id"]] = r["source"]
        sizes[r["source"]] += len(words(r["text"]))
    want = filled(dict(sizes), (1, 2, 3)) if sizes else {}
    taken, text = Counter(), {i: len(words(t)) for i, t in plain(df)}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == text[r["doc_id"]] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == df.count()
    assert sorted(got, key=repr) == sorted(mixing.mix_rows(df).collect(), key=repr)
    if which == "docs":
        biggest = {s: max(text[i] for i in source if source[i] == s) for s in want}
        assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], 0.5 * biggest[s]) for s in want)
        mixed = mixing.mix(df)
        assert mixed.columns == df.columns
        assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(taken.values())


def test_water_filling_clamps(spark):
    sizes = {"a": 1, "b": 2, "c": 1000, "d": 5, "e": 50, None: 10}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(filled(sizes, (1, 2, 3)))


# --- 4 licenses ---------------------------------------------------------------------
@pytest.mark.parametrize("which", ["odd", "docs", "empty"])
def test_license_base(which, request):
    df = request.getfixturevalue(which)
    want = Counter()
    for i, t in plain(df):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            q = phrase.split()
            hits = [j for j in range(len(ws)) if ws[j : j + len(q)] == q]
            places += hits
            labels |= {label} if hits else set()
        want[i, len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
    got = licenses.scan(df).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_suppression(spark):
    texts = ["under the Apache License, Version 2.0 or later", "GNU General Public License v3", "MIT License", "licensed under the BSD 3-Clause license", "nothing to see"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [got[i]["labels"] for i in range(5)] == ["apache,apache-2.0-or-later", "gpl,gpl-3.0", "mit", "bsd,bsd-3-clause", ""]
    assert len(licenses.rules()) > 300


def sample(pattern, most):
    """A text that a signature matches: with as little, or as much, as it may have."""
    out = re.sub(r"\[([^\]^])[^\]]*\]", r"\1", pattern).replace("[^ ]+", "x")
    while (m := re.search(r"\(\?:([^()]*)\)(\?|\{\d+,\d+\})?", out)) is not None:
        part = m[1].split("|")[-1 if most else 0]
        out = out[: m.start()] + (part if most or m[2] != "?" else "") + out[m.end() :]
    return re.sub(r" +", " ", re.sub(r"(.)\?", r"\1" if most else "", out)).strip()


def test_license_rules_are_gated(spark):
    for r in licenses.rules():
        for most in (False, True):
            text = f" {sample(r.pattern, most)} "
            assert re.fullmatch(r.pattern, text[1:-1]), (r.pattern, text)
            assert any(k in text for k in r.keywords), (r.pattern, text)
            assert any(g in text for g in licenses.GATE), (r.pattern, text)
    prose = ["we use Python 2 here", "Boost 1 voltage", "eclipse 2 of the sun", "the mozilla 1 1 draw", "an artistic 3 day event", "mit 2 friends", "the general public was told", "it is isc 1"]
    df = spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string")
    assert [r["labels"] for r in licenses.scan(df).collect()] == [""] * len(prose)


def test_license_detections_by_brute_force(spark):
    rules = licenses.rules("[a: one]\n3 a3 one two three\n3 a2 one two\n1 a1 one\n[b: two]\n3 b3 two three\n2 b2 two(?: three)? four\n4 b4 four")
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["one", "two", "three", "four", "five"], n)) for n in (0, 1, 3, 8, 20, 60, 900)]
    texts[1] = "One, TWO; three -- four"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(d) for d in r["detections"]] for r in licenses.scan(df, signatures=rules).collect()}
    for i, text in enumerate(texts):
        normal, found = f" {' '.join(re.findall('[a-z]+', text.lower()))} ", []
        for family, priority in dict.fromkeys((r.family, r.priority) for r in rules):
            run = [(k, r) for k, r in enumerate(rules) if (r.family, r.priority) == (family, priority)]
            for m in re.finditer("(?<= )(?:" + "|".join(r.pattern for _, r in run) + ")(?= )", normal):
                k, r = next((k, r) for k, r in run if re.fullmatch(r.pattern, m[0]))
                start = normal[: m.start()].count(" ") - 1
                found.append((start, start + m[0].count(" "), r.priority, k, r.label))

        def beaten(d, found=found):
            return any(e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[3] < d[3])) for e in found)

        assert sorted(got[i]) == sorted(d for d in found if not beaten(d))


def test_gate_covers_all_rules():
    for rule in licenses.rules():
        assert all(any(g in f" {sample(rule.pattern, most)} " for g in licenses.GATE) for most in (False, True)), rule


# --- 10 n-gram join -----------------------------------------------------------------
def brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 40), (1, 30)])
def test_ngram_join(spark, docs, n, percent):
    rows = plain(docs)
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    for k in range(25):  # near copies in a chain
        rows.append((10_000 + k, " ".join(base[k % 3 :] + [f"w{k}", f"w{k + 1}"])))
    rows += [(20_000, None), (20_001, ""), (20_002, "two words"), (20_003, "Two  WORDS")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_groups(df, n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_ngram_join_odd(odd, empty):
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_groups(odd.where("doc_id is not null")).collect()}
    assert {i: got[i] for i in (1, 2, 3, 13)} == {1: 1, 2: 1, 3: 1, 13: 1} and got[7] == got[8] == 7 and got[4] == 4 and got[5] == 5
    assert ngram_join.similarity_groups(odd).count() == odd.count()
    assert ngram_join.similarity_groups(empty).count() == 0
    kept = ngram_join.drop_near_copies(odd.where("doc_id is not null"))
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 4, 5, 6, 7, 9, 10, 11, 12, 14, 15}


# --- 3 suffix tree ------------------------------------------------------------------
@pytest.mark.parametrize("which", ["odd", "docs"])
def test_suffix_tree(which, request):
    df = request.getfixturevalue(which)
    train = {(r["doc_id"], r["text"]) for r in df.where(remainder(7) != 2).collect()}
    got = suffix_tree.score(df, remainder(7) != 2).collect()
    counts = Counter()
    for i, t in plain(df):
        if (i, t) in train:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = {}
    for i, t in plain(df):
        tokens = [*words(t), None]
        want[i] = (len(tokens), sum(counts[w] > 0 for w in tokens), sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
    assert len(got) == df.count()
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (w[0], w[1], n) and r["base_score"] == pytest.approx(w[2])
        assert r["score"] <= 1e-9
    if which == "docs":
        held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_states_are_distributions(docs):
    from orrery.llm._text import body

    tree, _, n, v = suffix_tree.learn(docs.select(body()))
    tree.index()
    assert tree.retained.sum() > 1
    other = 1 - np.power(10.0, tree.root).sum()
    for state in np.flatnonzero(tree.retained)[1:40]:
        ids = np.arange(len(tree.words))
        p, rest, s, add = np.zeros(len(ids)), ids, int(state), 0.0
        while s and len(rest):
            at = tree.find_pair.find(suffix_tree._pair_key(np.full(len(rest), s), rest))
            p[rest[at >= 0]] = 10 ** (add + tree.root[rest[at >= 0]] + tree.gain[at[at >= 0]])
            rest, add, s = rest[at < 0], add + tree.spare[s], int(tree.parent[s])
        p[rest] = 10 ** (add + tree.root[rest])
        left, s = 0.0, int(state)
        while s:
            left, s = left + tree.spare[s], int(tree.parent[s])
        assert p.sum() + other * 10**left == pytest.approx(1, abs=1e-6)


def test_suffix_tree_empty(empty):
    assert suffix_tree.score(empty, remainder(7) != 2).count() == 0


# --- 7 language ---------------------------------------------------------------------
def test_language(docs, odd, empty):
    got = {r["doc_id"]: r for r in language.identify(docs, docs.where(remainder(5) != 0)).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.9
    strange = {r["doc_id"]: r for r in language.identify(odd, docs).collect()}
    assert {i: (strange[i]["lang_pred"], strange[i]["score"]) for i in (4, 5, 6, 12)} == {i: ("und", 0.0) for i in (4, 5, 6, 12)}
    assert strange[14]["lang_pred"] != "und"
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(empty, docs).count() == 0


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(language.vocabulary())
    rng = np.random.default_rng(5)
    p = rng.random((len(pieces.pieces), 2))
    p /= p.sum(axis=0)
    known = {x: i for i, x in enumerate(pieces.pieces)}

    def total(b, k):
        if not b:
            return 1.0
        return sum(p[known[b[:n]], k] * total(b[n:], k) for n in range(1, language.LONGEST + 1) if b[:n] in known and len(b) >= n)

    text = "wörter the aaa".encode()
    w = language.split_words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    got = language.word_scores(pieces, language._padded(p), w.data, w.start, w.end)
    for i, x in enumerate(text.split()):
        assert got[i] == pytest.approx([np.log(total(b" " + x, k)) for k in (0, 1)])


# --- 1 toxicity ---------------------------------------------------------------------
def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in toxicity._fresh(rng).items()}
    vectors = rng.standard_normal((11, 13))
    vectors[-1] = 0
    tokens = rng.integers(0, 10, (5, toxicity.WINDOW))
    tokens[0, 20:] = 10
    labels = np.array([0, 1, 0, 1, 1.0])
    _, g, d = toxicity.gradients(p, vectors, tokens, labels)
    for name in ("wf", "wb", "uf", "ub", "bf", "a", "v", "w"):
        moved = [dict(p, **{name: p[name] + s * np.eye(1, p[name].size, 3).reshape(p[name].shape)}) for s in (1e-3, -1e-3)]
        slope = (toxicity.gradients(moved[0], vectors, tokens, labels)[0] - toxicity.gradients(moved[1], vectors, tokens, labels)[0]) / 2e-3
        assert g[name].flat[3] == pytest.approx(slope, rel=1e-2, abs=1e-6)
    moved = [vectors + s * np.eye(11, 13, 2) for s in (1e-3, -1e-3)]
    slope = sum(s * toxicity.gradients(p, m, tokens, labels)[0] for s, m in zip((1, -1), moved, strict=True)) / 2e-3
    assert sum(d[i, i + 2] for i in range(11)) == pytest.approx(slope, rel=1e-2, abs=1e-6)


def test_windows_cover_and_overlap():
    per = np.array([0, 5, 32, 33, 100])
    ptr = np.concatenate([[0], np.cumsum(per)])
    place, owner = toxicity.windows(per, ptr)
    assert set(place[place >= 0]) == set(range(170)) and Counter(owner.tolist())[0] == 0
    assert Counter(owner.tolist()) == {1: 1, 2: 1, 3: 2, 4: 6}


def test_toxicity_learns(spark, odd, empty):
    rng = np.random.default_rng(2)
    common = [f"{a}{b}" for a in "ba ko li mu ne ro".split() for b in "ta ser min lo ga".split()]
    rows = []
    for i in range(240):
        w = rng.choice(common, int(rng.integers(5, 150))).tolist()
        if i % 3 == 0:
            for at in rng.integers(0, len(w), 3):
                w.insert(int(at), str(rng.choice(["nastyword", "vileterm", "foulname"])))
        rows.append((" ".join(w).encode(), int(i % 3 == 0)))
    p = toxicity.train(rows[:160])
    df = spark.createDataFrame([(i, t.decode()) for i, (t, _) in enumerate(rows[160:])], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, p).collect()}
    right = [(got[i] >= toxicity.THRESHOLD) == bool(y) for i, (_, y) in enumerate(rows[160:])]
    assert np.mean(right) > 0.9
    strange = toxicity.score(odd, p).collect()
    assert len(strange) == odd.count() and all(0 <= r["score"] <= 1 for r in strange)
    assert {r["score"] for r in strange if r["doc_id"] in (4, 5, 6)} == {0.0}
    assert toxicity.train([(b"a b", 0)]) is None and toxicity.score(empty, p).count() == 0
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (3, 1, 1), (99, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert sorted((r["doc_id"], r["label"]) for r in toxicity.sample(odd, labels).collect()) == [(1, 1), (3, 1)]
    assert toxicity.fit(toxicity.sample(odd, labels)) is None and toxicity.fit(toxicity.sample(empty, labels)) is None
    assert {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}
