import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from motion_tables.llm import words as W

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXT = st.one_of(st.none(), st.text(alphabet=" \n\t\x0b\x0cab1.é漢", max_size=40))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_words_and_shingles_are_those_of_the_pattern(texts):
    column = pa.array(texts, pa.string())
    data, at = W.utf8(column)
    starts, ends, first = W.spans(data, at)
    want = [WORD.findall(t or "") for t in texts]
    got = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert got == [w for ws in want for w in ws]
    assert np.diff(first).tolist() == [len(w) for w in want]
    h = W.hashes(data, starts, ends)
    assert len({*zip(got, h.tolist())}) == len(set(got)) == len(set(h.tolist()))
    s, s_at = W.windows(h, first, 3)
    names = [[tuple(w[i : i + 3]) for i in range(len(w) - 2)] or ([tuple(w)] if w else []) for w in want]
    assert np.diff(s_at).tolist() == [len(n) for n in names]
    flat = [n for ns in names for n in ns]
    assert len({*zip(flat, s.tolist())}) == len(set(flat)) == len(set(s.tolist()))


def test_long_words_and_slices():
    a, b = "x" * 200_000, "x" * 199_999 + "y"
    column = pa.array(["q", a, b, a + " z"]).slice(1)
    data, at = W.utf8(column)
    h = W.hashes(data, *W.spans(data, at)[:2])
    assert h[0] == h[2] != h[1] and len(h) == 4
