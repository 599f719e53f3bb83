"""A sorted trie in level arrays, walked by Levenshtein automata of many words at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

END = -1
PADDING = -2
FRONTIER = 1_500_000


def matrix(words: Sequence[str], before: int = 0, after: int = 0, fill: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``words``, one row a word, and their lengths; ``fill`` around them."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = np.full((len(words), before + int(lengths.max(initial=0)) + after), fill, np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    rows = np.repeat(np.arange(len(words)), lengths)
    out[rows, before + np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out, lengths


class Trie:
    """Distinct words in order of their code points; nodes of one depth are numbered in that order.

    For each depth: the children of each node (first one and number), and for
    each child its character and the word that ends there, or -1.
    """

    def __init__(self, words: Sequence[str]):
        self.words = sorted(set(words))
        codes, lengths = matrix(self.words)
        n = len(self.words)
        self.root = 0 if n and lengths[0] == 0 else -1
        self.levels = []
        starts = np.zeros(n, bool)
        starts[:1] = True
        parent, parents = np.zeros(n, np.int64), 1
        for depth in range(codes.shape[1]):
            starts[1:] |= codes[1:, depth] != codes[:-1, depth]
            heads = np.flatnonzero(starts & (lengths > depth))
            count = np.bincount(parent[heads], minlength=parents)
            ends = np.where(lengths[heads] == depth + 1, heads, -1)
            self.levels.append((np.cumsum(count) - count, count, codes[heads, depth], ends))
            parent, parents = np.cumsum(starts & (lengths > depth)) - 1, len(heads)

    def within(self, names: Sequence[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, word, distance) of all pairs within ``edits`` edits, as numbers of both.

        The automaton's state is the band of ``2 * edits + 1`` cells around
        the diagonal of the edit matrix; branches whose cells all exceed
        ``edits`` are left. Many open branches are walked in two halves.
        """
        if not len(names) or not self.words:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        found = self._walk(names, edits)
        if found is None:
            half = len(names) // 2
            first, second = self.within(names[:half], edits), self.within(names[half:], edits)
            return tuple(np.concatenate([a, b + (half if i == 0 else 0)]) for i, (a, b) in enumerate(zip(first, second)))
        return found

    def _walk(self, names: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        deepest = max(map(len, names)) + k
        # Column k + j has character j; cells left and right of a name never agree.
        codes, lengths = matrix(names, k + 1, 2 * k + 2 + max(0, len(self.levels)), PADDING)
        width = 2 * k + 1
        over = k + 1
        offsets = np.arange(-k, k + 1)
        name = np.arange(len(names))
        node = np.zeros(len(names), np.int64)
        band = np.where((offsets >= 0) & (offsets <= lengths[:, None]), offsets, over).astype(np.int16)
        out = []
        if self.root >= 0:
            hit = np.flatnonzero(lengths <= k)
            out.append((hit, np.full(len(hit), self.root), lengths[hit]))
        for depth, (first, count, char, ends) in enumerate(self.levels):
            if depth >= deepest:
                break
            n = count[node]
            if len(names) > 1 and int(n.sum()) * width > FRONTIER * 3:
                return None
            child = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            name, band = np.repeat(name, n), np.repeat(band, n, axis=0)
            if not len(child):
                break
            letter = char[child]
            new = np.full((len(child), width), over, np.int16)
            left = np.full(len(child), over, np.int16)
            for b in range(width):
                j = depth + 1 - k + b
                if j < 0:
                    continue
                # Cells of column j: substitute or keep, drop the target's character, insert the name's.
                cell = left + 1
                if b + 1 < width:
                    cell = np.minimum(cell, band[:, b + 1] + 1)
                if j > 0:
                    cell = np.minimum(cell, band[:, b] + (codes[name, k + j] != letter))
                cell = np.where(j <= lengths[name], np.minimum(cell, over), over).astype(np.int16)
                new[:, b] = left = cell
            alive = new.min(axis=1) <= k
            name, node, band = name[alive], child[alive], new[alive]
            word = ends[node]
            at = lengths[name] - (depth + 1) + k
            done = np.flatnonzero((word >= 0) & (at >= 0) & (at < width))
            distance = band[done, at[done]]
            done, distance = done[distance <= k], distance[distance <= k]
            out.append((name[done], word[done], distance.astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))
