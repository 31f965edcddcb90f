"""The majority bits of many hashes, which SimHash fingerprints are made of."""

from __future__ import annotations

import numpy as np

BITS = 64


def majority_bits(hashes: np.ndarray) -> int:
    """The unsigned integer of the bits that are set in over half of the 64-bit hashes; 0 without any."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 100_000):
        counts += np.unpackbits(hashes[i : i + 100_000].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])
