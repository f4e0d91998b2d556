"""The counts beside a signature may rule out a pair only if its sets are not similar."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from screenlake.llm import near_dedup
from screenlake.llm.shingles import SYMBOLS, mix, similar


def row(shingles):
    return np.concatenate([np.zeros(SYMBOLS, np.uint16), near_dedup.counts(shingles)])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 200), st.integers(0, 200), st.integers(0, 2**32))
def test_no_similar_pair_is_ruled_out(common, only_a, only_b, seed):
    x = mix(np.arange(seed, seed + common + only_a + only_b, dtype=np.uint64))
    a, b = np.unique(x[: common + only_a]), np.unique(np.concatenate([x[:common], x[common + only_a :]]))
    near = near_dedup._near(row(a)[None], row(b), 75)[0]
    assert near or not similar(a, b, 75)


def test_full_counts_say_nothing():
    full = np.full(near_dedup.COUNTS, near_dedup.FULL, np.uint16)
    one = np.concatenate([np.zeros(SYMBOLS, np.uint16), full])
    assert near_dedup._near(one[None], row(mix(np.arange(10, dtype=np.uint64))), 75)[0]


def test_pairs_are_not_dropped_by_their_signatures():
    r = np.random.default_rng(3)
    a, b = (np.concatenate([r.integers(0, 2**16, SYMBOLS), np.full(near_dedup.COUNTS, n)]).astype(np.uint16) for n in (8, 7))
    few = np.concatenate([a[: SYMBOLS], np.full(near_dedup.COUNTS, 5)]).astype(np.uint16)
    assert near_dedup._near(np.stack([a, b, few]), a, 75).tolist() == [True, True, False]
    assert near_dedup._near(np.zeros((0, len(a)), np.uint16), a, 75).tolist() == []
