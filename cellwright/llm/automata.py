"""Probabilistic automata learned from examples by merging states of their prefix tree.

The tree of all prefixes of the examples, with counts, is folded into an automaton: a state whose next symbols and whose subtree are
statistically compatible with those of a state that is kept already (Hoeffding's bound on every share) becomes that state.
Strings of one format, whatever their length, end up in a few states with loops.
"""

from __future__ import annotations

import numpy as np

#: Symbols: digits, letters that may be hexadecimal and others by case, and each mark of its own; all else is one class.
CLASSES = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-"]
N_SYMBOLS = len(CLASSES) + 1
_SYMBOL = np.full(256, len(CLASSES), np.uint8)
for _k, _chars in enumerate(CLASSES):
    _SYMBOL[list(_chars.encode())] = _k
#: log of a character's share of its class.
_WITHIN = -np.log(np.array([len(x) for x in CLASSES] + [256 - sum(map(len, CLASSES))], float))
#: What every symbol counts at least in a state.
PRIOR = 0.05


def symbols(text: bytes) -> np.ndarray:
    return _SYMBOL[np.frombuffer(text, np.uint8)]


class Automaton:
    """next (state by symbol, -1: never seen), and log probabilities of symbols and of the end."""

    def __init__(self, next_state: np.ndarray, counts: np.ndarray, ends: np.ndarray):
        total = counts.sum(1) + ends + PRIOR * (N_SYMBOLS + 1)
        self.next = next_state
        self.log = np.log((counts + PRIOR) / total[:, None])
        self.log_end = np.log((ends + PRIOR) / total)

    def __len__(self) -> int:
        return len(self.next)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log probability of each text as a string of characters.

        A symbol that its state never saw costs what the prior gives it, and the text goes on from the first state.
        All texts advance together, the longest first, so that memory is that of the texts.
        """
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        sizes = np.array([len(texts[k]) for k in order], np.int64)
        flat = symbols(b"".join(texts[k] for k in order))
        begin = np.cumsum(sizes) - sizes
        state, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        live = len(texts)
        for at in range(int(sizes[0]) if len(sizes) else 0):
            while live and sizes[live - 1] <= at:
                live -= 1
            s = flat[begin[:live] + at]
            total[:live] += self.log[state[:live], s] + _WITHIN[s]
            state[:live] = np.maximum(self.next[state[:live], s], 0)
        total += self.log_end[state]
        out = np.empty(len(texts))
        out[order] = total
        return out


def prefix_tree(examples: list[tuple[bytes, int]]) -> tuple[list[dict[int, int]], list[dict[int, int]], list[int]]:
    """Children and counts by symbol, and ends, of the states of the prefix tree; state 0 is the empty prefix."""
    children: list[dict[int, int]] = [{}]
    counts: list[dict[int, int]] = [{}]
    ends = [0]
    for text, n in examples:
        at = 0
        for s in symbols(text).tolist():
            counts[at][s] = counts[at].get(s, 0) + n
            if s not in children[at]:
                children[at][s] = len(children)
                children.append({})
                counts.append({})
                ends.append(0)
            at = children[at][s]
        ends[at] += n
    return children, counts, ends


def infer(examples: list[tuple[bytes, int]], alpha: float = 0.01) -> Automaton:
    """Fold the prefix tree: kept states are those compatible with no kept one before them, in order of first reach.

    ``examples`` are texts and how often each was seen; their order doesn't matter.  ``alpha``: the risk of keeping two equal states apart.
    """
    children, counts, ends = prefix_tree(sorted(examples))
    bound = np.sqrt(0.5 * np.log(2 / alpha))

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > bound * (n**-0.5 + m**-0.5)

    def compatible(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = sum(counts[p].values()) + ends[p], sum(counts[q].values()) + ends[q]
            if not n or not m:
                continue
            if differ(ends[p], n, ends[q], m):
                return False
            for s in counts[p].keys() | counts[q].keys():
                if differ(counts[p].get(s, 0), n, counts[q].get(s, 0), m):
                    return False
                if s in children[p] and s in children[q] and children[p][s] != children[q][s]:
                    todo.append((children[p][s], children[q][s]))
        return True

    def fold(p: int, q: int) -> None:
        """Add q, the root of a tree, to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            ends[p] += ends[q]
            for s, n in counts[q].items():
                counts[p][s] = counts[p].get(s, 0) + n
                if s in children[p]:
                    todo.append((children[p][s], children[q][s]))
                else:
                    children[p][s] = children[q][s]

    kept = [0]
    place = {0: 0}
    at = 0
    while at < len(kept):
        p = kept[at]
        for s in sorted(children[p]):
            q = children[p][s]
            if q in place:
                continue
            like = next((k for k in kept if compatible(k, q)), None)
            if like is None:
                place[q] = len(kept)
                kept.append(q)
            else:
                children[p][s] = like
                fold(like, q)
        # a fold may have given p or earlier states new children
        again = next((k for k in range(at + 1) if any(q not in place for q in children[kept[k]].values())), None)
        at = at + 1 if again is None else again
    table, seen = np.full((len(kept), N_SYMBOLS), -1, np.int64), np.zeros((len(kept), N_SYMBOLS))
    for k, p in enumerate(kept):
        for s, q in children[p].items():
            table[k, s], seen[k, s] = place[q], counts[p][s]
    return Automaton(table, seen, np.array([ends[p] for p in kept], float))
