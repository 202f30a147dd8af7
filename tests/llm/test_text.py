import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import _text as t

from .conftest import thue_morse

texts = st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tabAZé漢\x0b\x1c", max_size=40)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_are_those_of_a_regex(values):
    import re

    w = t.Words(*t.buffer(pa.array(values, pa.string())))
    raw = w.buf.tobytes()
    for i, v in enumerate(values):
        got = [raw[a:b].decode() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", v or "")


def test_equal_words_have_equal_hashes():
    w = t.Words(*t.buffer(pa.array(["aa bb aa", "bb a aa"])))
    h = w.hashes().tolist()
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h)) == 3
    assert t.word_hash("aa") == h[0]


def test_rolling_hashes_agree_with_content():
    h = t.mix(np.random.default_rng(0).integers(0, 2, 300).astype(np.uint64))
    for k in (1, 2, 3, 5, 8, 25, 50):
        r = t.rolling(h, k)
        assert len(r) == 301 - k
        runs = [h[i : i + k].tobytes() for i in range(301 - k)]
        assert len(set(zip(runs, r.tolist(), strict=True))) == len(set(runs)) == len(set(r.tolist()))
    assert len(t.rolling(h[:4], 5)) == 0


@pytest.mark.parametrize("n", [7, 8, 9, 64, 511, 512, 513, 1024, 2048, 4096])
def test_unlike_words_have_unlike_hashes(n):
    """Words that differ in one byte, in the order of bytes, in length, or by the Thue-Morse rule."""
    r = random.Random(n)
    word = "".join(r.choice("ab") for _ in range(n))
    words = {word, word + "a", word + "\0", "\0" + word, word[::-1], word[1:] + word[0], "a" * n, "b" * n, thue_morse(n, "ab"), thue_morse(n, "ba")}
    words |= {word[:i] + "c" + word[i + 1 :] for i in range(0, n, max(1, n // 40))}
    assert len({t.word_hash(w) for w in words}) == len(words)
    h = t.Words(*t.buffer(pa.array(["x " + w + " y" for w in sorted(words)]))).hashes()
    assert h[1::3].tolist() == [t.word_hash(w) for w in sorted(words)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 9))
def test_argmin_takes_the_last_of_the_smallest(values, w):
    got = t.argmin_window(np.array(values, np.uint64), w).tolist()
    want = [max(range(i, i + w), key=lambda j: (-values[j], j)) for i in range(len(values) - w + 1)]
    assert got == want


def test_pieces_keep_every_row_whole():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "", "c" * 3])], ["text"])
    parts = list(t.pieces(iter([b]), "text", 12))
    assert sum((p.column(0).to_pylist() for p in parts), []) == b.column(0).to_pylist()
    assert max(p.num_rows for p in parts) < 5
