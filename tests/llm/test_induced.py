"""Induced sorting against sorting of the suffixes themselves."""

import numpy as np
from hypothesis import given, settings, strategies as st

from gridmosaic.llm.induced import repeated_windows, suffix_order


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.sampled_from([0, 1 << 20]))
def test_order(symbols, held):
    text = np.array([*symbols, 0], dtype=np.uint16)
    got = np.concatenate(list(suffix_order(text, 6, 100, held))).tolist()
    assert got == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), max_size=6), st.sampled_from([2, 5, 9]))
def test_windows(strings, width):
    classes, string, offset = repeated_windows(strings, width)
    got = {}
    for c, s, o in zip(classes, string, offset):
        got.setdefault(c, set()).add((int(s), int(o)))
    want = {}
    for i, x in enumerate(strings):
        for k in range(len(x) - width + 1):
            want.setdefault(x[k: k + width], set()).add((i, k))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
