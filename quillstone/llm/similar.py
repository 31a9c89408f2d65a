"""Sets of word shingles: their minhashes, which route near duplicates to groups, and their exact Jaccard similarity."""

from __future__ import annotations

import numpy as np

from .common import WORD, lower_ascii
from .suffixes import Hashes, grams, mixed

SHINGLE = 5
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 40, 5
#: Shingles whose minhashes are taken at once.
BLOCK = 2048
_C = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, word_hashes: Hashes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's shingles, each once; a text of fewer words is one shingle, one of none has none."""
    words = WORD.findall(lower_ascii(text or ""))
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(grams(word_hashes(words), min(shingle, len(words))))


def set_code(shingles: np.ndarray) -> int:
    """A hash of a set, as a signed integer."""
    from xxhash import xxh64_intdigest

    return int(np.array([xxh64_intdigest(shingles.tobytes())], np.uint64).view(np.int64)[0])


class MinHashes:
    """Two sets of similarity s agree on all rows of a band with a chance of s ** rows: at 0.8, on none of 40 bands of 5 with 1e-7."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        rng = np.random.default_rng(42)
        self.bands, self.rows = bands, rows
        self.times = rng.integers(0, 2**63, (bands * rows, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 2**63, (bands * rows, 1), np.uint64)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """A key for each band, as signed integers: its number and its minhashes."""
        least = None
        for lo in range(0, len(shingles), BLOCK):
            part = ((shingles[None, lo : lo + BLOCK] ^ self.plus) * self.times).min(1)
            least = part if least is None else np.minimum(least, part)
        least = least.reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            key = mixed(key * _C + least[:, k])
        return key.view(np.int64)


def alike(sets: list[np.ndarray], least: tuple[int, int] = LEAST, label: np.ndarray | None = None, part: np.ndarray | None = None) -> np.ndarray:
    """For each set the least position in its component; sets as similar as ``least`` are linked.

    All pairs are looked at but those whose ``label`` is equal from the start or has become so, and, if ``part`` is given,
    those within a part: a group in which all are alike takes one step a set.
    """
    n = len(sets)
    label = np.arange(n) if label is None else np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]]
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    own = np.zeros(int(ids.max()) + 1, bool)
    for p in range(n - 1):
        small, large = np.minimum(sizes[p], sizes[p + 1 :]), np.maximum(sizes[p], sizes[p + 1 :])
        wanted = (label[p + 1 :] != label[p]) & (small * least[1] >= large * least[0])
        if part is not None:
            wanted &= part[p + 1 :] != part[p]
        others = p + 1 + np.flatnonzero(wanted)
        if not len(others):
            continue
        own[mine := ids[starts[p] : starts[p] + sizes[p]]] = True
        lo = starts[others[0]]
        both = np.add.reduceat(own[ids[lo:]], starts[others[0] :] - lo, dtype=np.int64)[others - others[0]]
        own[mine] = False
        found = others[both * least[1] >= (sizes[p] + sizes[others] - both) * least[0]]
        if len(found):
            joined = np.unique(np.append(label[found], label[p]))
            label[np.isin(label, joined)] = joined[0]
    return label
