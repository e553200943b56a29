import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm._text import HashIndex, split_words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbB \t\n\x0bé日\x00.", max_size=20), max_size=6))
def test_words_are_those_of_bytes_split(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    w = split_words(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    got = [[bytes(w.data[s:e]) for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.ptr[:-1], w.ptr[1:], strict=True)]
    assert got == [x.lower().split() for x in raw]
    by = {}
    for s, e, h in zip(w.start, w.end, w.hash, strict=True):
        assert by.setdefault(int(h), bytes(w.data[s:e])) == bytes(w.data[s:e])


def test_long_texts_are_cut_at_white_space(monkeypatch):
    from orrery.llm import _text

    data = np.frombuffer(b"ab cde " * 50 + b"x" * 200 + b" y", np.uint8)
    bounds = np.array([0, 100, len(data)])
    whole = split_words(data, bounds)
    monkeypatch.setattr(_text, "BLOCK", 32)
    parts = split_words(data, bounds)
    assert np.array_equal(whole.start, parts.start) and np.array_equal(whole.end, parts.end) and np.array_equal(whole.hash, parts.hash)


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_index(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    index = HashIndex(keys)
    assert (index.keys[index.find(keys)] == keys).all() if n else True
    assert (index.find(np.array([5, 7], np.uint64)) == -1).all()
