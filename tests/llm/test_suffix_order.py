"""The order that picks an anchor depends on the window alone."""

from __future__ import annotations

import numpy as np

from ridelake.llm import suffixes


def test_close_hashes_have_one_order_in_short_and_long_texts():
    close = np.array([5 << 30 | 9, 5 << 30 | 3], dtype=np.uint64)
    table = {2: close, 500_000: np.concatenate([close, np.full(499_998, 1 << 40, dtype=np.uint64)])}
    first = [int(np.argmin(suffixes._ranked(hashes)[:2])) for hashes in table.values()]
    assert first[0] == first[1]


def test_anchor_places_are_those_of_the_smallest_hashes():
    data = np.random.default_rng(2).integers(0, 256, 3000).astype(np.uint8)
    places, hashes = suffixes._Hasher(64, 16).anchors(data)
    assert all(hashes[p] == hashes[i : i + 49].min() for i, p in enumerate(places))
