"""Signatures of shingle sets: what linked sets share, and what a set may leave out."""

import collections

import numpy as np
import pytest

from vernissage.llm import jaccard


def test_empty_segments_are_left_out():
    """Few sets leave more segments empty than they may do without, even the smallest of a band."""
    rng, bands = np.random.default_rng(2), jaccard.Bands(80)
    sizes = np.concatenate([np.arange(150, 420), np.arange(150, 420)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    cls, keys, codes = jaccard.signatures(rng.integers(0, 1 << 63, first[-1]).astype(np.uint64), first, bands)
    key, freq = np.unique(keys, return_counts=True)
    often = np.isin(keys, key[freq > jaccard.COSTLY])
    over = 0
    for c in range(len(sizes)):
        for tag in np.unique(codes[cls == c] // 2):
            own = often & (cls == c) & (codes // 2 == tag)
            over += (1 + codes[own] % 2).sum() > bands.rooms[tag] + bands.spares[tag]
    assert over < 0.1 * len(sizes)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_more_than_they_may_leave_out(percent):
    rng, bands = np.random.default_rng(3), jaccard.Bands(percent)
    sets = []
    for _ in range(100):
        n = int(rng.integers(2, 400))
        common = int(np.ceil(percent * n / 100))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        # Some elements lost, some gained: as many as a link allows.
        lost = int(rng.integers(0, n - common + 1))
        gained = (n - lost) * 100 // percent - n
        sets += [np.sort(a), np.sort(np.concatenate([a[lost:], rng.integers(0, 1 << 63, max(gained, 0)).astype(np.uint64)]))]
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    cls, keys, codes = jaccard.signatures(np.concatenate(sets), first, bands)
    for a in range(0, len(sets), 2):
        if set(sets[a]) == set(sets[a + 1]):
            continue
        worth = collections.Counter()
        both = set(keys[cls == a]) & set(keys[cls == a + 1])
        own = (cls == a) & np.isin(keys, list(both))
        for code in codes[own]:
            worth[int(code) // 2] += 1 + int(code) % 2
        assert any(n > bands.rooms[tag] + bands.spares[tag] for tag, n in worth.items()), (len(sets[a]), len(sets[a + 1]))
