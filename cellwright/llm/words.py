"""Words and shingles of texts as 64-bit hashes, inside tasks."""

from __future__ import annotations

import numpy as np

from cellwright.llm.tokens import Hasher, mixed

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_HASHER = Hasher()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words [^\\x20\\x09-\\x0D]+ of all texts, and how many each text has."""
    data = _SMALL[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    upto = np.searchsorted(starts, np.cumsum(sizes))
    return _HASHER(data, starts, ends), np.diff(upto, prepend=0)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Distinct hashes of ``size`` words in a row, ascending; of all words if there are fewer; empty without words."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    rows = np.zeros(len(words), np.uint64)
    for k in range(min(size, len(words))):
        head = rows[: len(words) - k]
        head[:] = mixed(head * np.uint64(0x9E3779B97F4A7C15) + words[k:] + np.uint64(k + 1))
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rows[a : b - size + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(size + b - a))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
