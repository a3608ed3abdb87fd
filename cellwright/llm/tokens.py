"""Subword ids of whole texts, inside tasks.

Most of a text's words occur again and again, so each worker keeps the ids of the pieces it has met and
asks the tokenizer for new ones only.  Texts are cut where the tokenizer always cuts: before a single
space, around a single line feed, and before a comma or full stop that ends an ASCII word.
Pieces are found and looked up for many texts at once, by 64-bit hashes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

#: A worker forgets its pieces beyond this many (about 25 bytes each).
MAX_PIECES = 1_000_000
#: Bytes of text that are cut and looked up at once; temporary arrays take some 60 times as much.
SLICE_BYTES = 500_000
#: Tables of powers up to this length stay with a worker (16 bytes each); one very long text has its own.
KEPT_POWERS = 1 << 20
_WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
_ENCODERS: dict[str, Encoder] = {}
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer; changes x in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * np.uint64(pow(base, have, 1 << 64))
        have += step
    return out


class Hasher:
    """Hashes of many pieces of one byte string."""

    def __init__(self) -> None:
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        up, down = self.up, self.down
        if n >= len(up):
            up, down = _powers(_BASE, n + n // 4 + 1), _powers(_INVERSE, n + n // 4 + 1)
            if n <= KEPT_POWERS:
                self.up, self.down = up, down
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * up[:n], out=total[1:])
        return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


class Encoder:
    """Ids of texts by a tokenizers file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)).encode()) if added else None
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.hasher = Hasher()
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)  # 16 bits of length below the place of the first id
        self.ids = np.zeros(1 << 18, np.uint16)
        self.used = 0

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and how many each piece has."""
        if len(self.line_feed) != 1:
            return self._each(pieces)
        plain = [" " not in x[1:] and len(x.split()) == 1 and x[-1] not in "\t\n\x0b\x0c\r" and (x[0] == " " or not x[0].isspace()) for x in pieces]
        sizes = np.zeros(len(pieces), np.int64)
        parts = [np.zeros(0, np.uint32)] * len(pieces)
        lines = [x for x, p in zip(pieces, plain, strict=True) if p]
        if lines:  # as lines of one text: the tokenizer cuts around each line feed
            flat = np.asarray(self.tokenizer.encode_batch_fast(["\n".join(lines) + "\n"], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(flat == self.line_feed[0])
            if len(ends) != len(lines):
                return self._each(pieces)
            if len(lines) == len(pieces):
                return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1
            begin = 0
            for k, e in zip(np.flatnonzero(plain), ends, strict=True):
                parts[k], begin = flat[begin:e], e + 1
        odd = [k for k, p in enumerate(plain) if not p]
        for k, x in zip(odd, self.tokenizer.encode_batch_fast([pieces[k] for k in odd], add_special_tokens=False), strict=True):
            parts[k] = np.asarray(x.ids, np.uint32)
        sizes[:] = [len(x) for x in parts]
        return np.concatenate(parts), sizes

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.asarray(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Keys ascending, none of them known."""
        flat, sizes = self._ids(pieces)
        if flat.size and flat.max() > 65535 and self.ids.dtype == np.uint16:
            self.ids = self.ids.astype(np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        place = (self.used + np.cumsum(sizes) - sizes) << 20 | sizes
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.place = np.insert(self.place, at, place)
        self.keys = np.insert(self.keys, at, keys)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        space = (data == 32) | ((data >= 9) & (data <= 13))
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        ends = np.zeros(len(data), bool)  # last byte of a text
        ends[first[1:] - 1] = ends[-1] = True
        after[ends] = False
        cut = (data == 32) & ~before & ~after
        feed = (data == 10) & ~before & ~after
        cut |= feed
        cut[1:] |= feed[:-1]
        low = data | 32
        letter = (low >= 97) & (low <= 122)
        cut[1:] |= ((data[1:] == 44) | (data[1:] == 46)) & letter[:-1] & (after | ends)[1:]
        cut[first] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        hashes = self.hasher(data, begin, end)
        order = np.argsort(hashes)
        hashes = hashes[order]
        head = np.ones(len(order), bool)
        np.not_equal(hashes[1:], hashes[:-1], out=head[1:])
        keys, at = hashes[head], order[head]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(head) - 1
        if len(self.keys) + len(keys) > MAX_PIECES:
            self._forget()
        found = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = found < len(self.keys)
        known[inside] = self.keys[found[inside]] == keys[inside]
        if not known.all():
            new = at[~known]
            raw = data.tobytes()
            self._learn(keys[~known], [raw[a:b].decode() for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
            found = np.searchsorted(self.keys, keys)
        place = self.place[found][which]
        count = place & 0xFFFFF
        upto = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=upto[1:])
        flat = self.ids[np.repeat((place >> 20) - upto[:-1], count) + np.arange(upto[-1])]
        edge = np.searchsorted(begin, np.append(first, len(data)))
        per_text = np.zeros(len(texts), np.int64)
        per_text[sizes > 0] = np.diff(upto[edge])
        return flat.astype(np.uint32), per_text

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encoded(texts: list[bytes], path: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, ids in a row, counts) of slices of a batch.

    A text with white space beyond ASCII, with an added token of the tokenizer, or with over 2**20 ids in a piece, is left to the tokenizer whole.
    """
    own = encoder(path)
    for a, b in slices([len(x) for x in texts], most):
        part = texts[a:b]
        # lead bytes of white space beyond ASCII
        odd = [k for k, x in enumerate(part) if len(x) > 200_000 or (own.added and own.added.search(x)) or (not x.isascii() and _WIDE_SPACE.search(x.decode()))]
        if not odd:
            yield a, b, *own.encode(part)
            continue
        by_hand = {k: own.whole(part[k].decode()) for k in odd}
        flat, counts = own.encode([b"" if k in by_hand else x for k, x in enumerate(part)])
        pieces = np.split(flat, np.cumsum(counts)[:-1])
        for k, ids in by_hand.items():
            pieces[k], counts[k] = ids, len(ids)
        yield a, b, np.concatenate(pieces), counts
