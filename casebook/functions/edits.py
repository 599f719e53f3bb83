"""Edit distance with a limit, for use inside tasks.

Bit-parallel (Myers 1999, Hyyrö 2003): one column of the comparison is kept
in the bits of two integers. On texts of some thousand characters this is
about ten times faster than the built-in distance with a limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

# Bits of the integer that holds patterns side by side.
LANE_BITS = 1 << 15


def _positions(text: str) -> dict[str, int]:
    """For each character the bits of the places where it stands."""
    size = (len(text) + 7) // 8
    marks: dict[str, bytearray] = {}
    for i, c in enumerate(text):
        bits = marks.get(c)
        if bits is None:
            bits = marks[c] = bytearray(size)
        bits[i >> 3] |= 1 << (i & 7)
    return {c: int.from_bytes(b, "little") for c, b in marks.items()}


def distance(a: str, b: str) -> int:
    """Edit distance; linear in ``len(b)`` times the words of ``len(a)`` bits."""
    if not a or not b:
        return len(a) + len(b)
    eq = _positions(a)
    full = (1 << len(a)) - 1
    last = 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        same = eq.get(c, 0)
        diagonal = ((((same & up) + up) ^ up) | same) & full
        grow = down | (full ^ (diagonal | up))
        shrink = up & diagonal
        if grow & last:
            score += 1
        elif shrink & last:
            score -= 1
        grow = ((grow << 1) | 1) & full
        shrink = (shrink << 1) & full
        same |= down
        up = shrink | (full ^ (same | grow))
        down = grow & same
    return score


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def within(a: str, b: str, limit: int) -> int:
    """Edit distance, or -1 if it is more than ``limit``.

    Common ends are cut off. Distances never shrink along a diagonal of the
    comparison, so beginnings cut with the texts' own difference in length
    are no further apart than the texts: if those are past the limit, so
    are the texts. That settles unlike texts at a small part of the cost.
    """
    if abs(len(a) - len(b)) > limit:
        return -1
    head = _common(a, b)
    a, b = a[head:], b[head:]
    tail = _common(a[::-1], b[::-1])
    if tail:
        a, b = a[:-tail], b[:-tail]
    if len(a) > len(b):
        a, b = b, a
    first = limit * 3 // 2 + 16
    if first < len(a) * 0.8 and distance(a[:first], b[: first + len(b) - len(a)]) > limit:
        return -1
    d = distance(a, b)
    return d if d <= limit else -1


def indel_within(a: str, b: str, limit: int) -> int:
    """Distance with insertions and deletions only (a change counts two), or -1 past ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return -1
    if not a or not b:
        return len(a) + len(b)
    # Longest common subsequence, bit-parallel: a zero bit marks a step.
    eq = _positions(a)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & eq.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    d = len(a) + len(b) - 2 * (len(a) - row.bit_count())
    return d if d <= limit else -1


class Lanes:
    """Patterns side by side in one integer, compared with one text at a time.

    The same steps as in ``distance``, once a character for all patterns. Each
    has whole words of 64 bits with a spare bit on top, so that no sum reaches
    the next one. Rows past the end of a pattern do not change those before.
    """

    def __init__(self, patterns: Sequence[str]):
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        self.words = int(self.lengths.max(initial=0)) // 64 + 1
        width = 64 * self.words
        self.bytes = len(patterns) * width // 8
        codes = np.full(len(patterns) * width, -1, np.int32)
        flat = np.frombuffer("".join(patterns).encode("utf-32-le", "surrogatepass"), np.int32)
        before = np.cumsum(self.lengths) - self.lengths
        codes[np.repeat(np.arange(len(patterns)) * width - before, self.lengths) + np.arange(len(flat))] = flat
        self.marks = {chr(c): self._integer(codes == c) for c in np.unique(flat).tolist()}
        place = np.arange(width)
        self.full = self._integer(np.tile(place < width - 1, len(patterns)))
        self.low = self._integer(np.tile(place == 0, len(patterns)))
        self.own = np.packbits(place < self.lengths[:, None], axis=1, bitorder="little").view(np.uint64)

    @staticmethod
    def _integer(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def _ones(self, value: int) -> np.ndarray:
        held = np.frombuffer(value.to_bytes(self.bytes, "little"), np.uint64).reshape(-1, self.words)
        return np.bitwise_count(held & self.own).sum(axis=1, dtype=np.int64)

    def distances(self, text: str, ends: np.ndarray) -> np.ndarray:
        """Edit distance of each pattern to the first ``ends`` characters of the text; -1 where ``ends`` is negative."""
        full, low, marks = self.full, self.low, self.marks
        out = np.full(len(ends), -1, np.int64)
        stops = set(ends[ends >= 0].tolist())
        up, down = full, 0
        if 0 in stops:
            out[ends == 0] = self.lengths[ends == 0]
        for j, c in enumerate(text[: max(stops, default=0)], 1):
            same = marks.get(c, 0)
            diagonal = ((((same & up) + up) ^ up) | same) & full
            grow = down | (full ^ (diagonal | up))
            shrink = up & diagonal
            grow = ((grow << 1) | low) & full
            same |= down
            up = ((shrink << 1) & full) | (full ^ (same | grow))
            down = grow & same
            if j in stops:
                here = ends == j
                out[here] = (j + self._ones(up) - self._ones(down))[here]
        return out


class Band:
    """Patterns of any length side by side in columns of 64-bit words, compared with one text at a time near the diagonal.

    The steps of ``distance`` on an array with a row for each 64 characters and
    a column for each pattern. Only rows within ``reach`` of the diagonal are
    kept up: what lies above a row that is left counts one more a character, as
    the first row does, so distances are never understated, and those whose
    path stays in reach are exact.
    """

    def __init__(self, patterns: Sequence[str]):
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        self.rows, self.lanes = int(self.lengths.max(initial=1) + 63) // 64, len(patterns)
        lane = np.repeat(np.arange(self.lanes), self.lengths)
        place = np.arange(len(lane)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        codes = np.frombuffer("".join(patterns).encode("utf-32-le", "surrogatepass"), np.int32)
        order = np.argsort(codes, kind="stable")
        heads = np.flatnonzero(np.diff(codes[order], prepend=-1))
        word, bit = place // 64 * self.lanes + lane, np.uint64(1) << (place % 64).astype(np.uint64)
        self.places = {chr(codes[x[0]]): (word[x], bit[x]) for x in np.split(order, heads[1:]) if len(x)}
        self.own = self._marked((word, bit))
        self.none = np.zeros((self.rows, self.lanes), np.uint64)
        self.marks: dict[str, np.ndarray] = {}

    def _marked(self, places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        held = np.zeros(self.rows * self.lanes, np.uint64)
        np.bitwise_or.at(held, *places)
        return held.reshape(self.rows, self.lanes)

    def _marks(self, c: str) -> np.ndarray:
        found = self.marks.get(c)
        if found is None:
            if len(self.marks) * self.none.nbytes > MARK_BYTES:
                self.marks.clear()
            found = self.marks[c] = self._marked(self.places[c]) if c in self.places else self.none
        return found

    def distances(self, text: str, ends: np.ndarray, reach: int) -> np.ndarray:
        """Distance of each pattern to the first ``ends`` characters of the text; -1 where ``ends`` is negative."""
        out = np.full(self.lanes, -1, np.int64)
        stops = set(ends[ends >= 0].tolist())
        if 0 in stops:
            out[ends == 0] = self.lengths[ends == 0]
        all_up, all_down = np.full_like(self.none, ~np.uint64(0)), np.zeros_like(self.none)
        rooms = [np.empty_like(self.none) for _ in range(4)]
        passed = np.zeros(self.lanes, np.int64)
        one, top = np.uint64(1), np.uint64(63)
        low = high = 0
        for j, c in enumerate(text[: max(stops, default=0)], 1):
            first, last = min(max(0, j - 1 - reach) // 64, self.rows - 1), min(self.rows, (j - 1 + reach) // 64 + 1)
            if (first, last) != (low, high) or j == 1:
                for r in range(low, first):
                    passed += np.bitwise_count(all_up[r]).astype(np.int64) - np.bitwise_count(all_down[r])
                low, high = first, last
                up, down = all_up[low:high], all_down[low:high]
                a, b, g, h = (x[low:high] for x in rooms)
                before, b_after, g_before, g_after, h_before, h_after = a[:-1], b[1:], g[:-1], g[1:], h[:-1], h[1:]
                several = high - low > 1
            same = self._marks(c)[low:high]
            np.bitwise_and(same, up, out=a)
            np.add(a, up, out=b)
            if several:
                over = np.less(b, a)[:-1]
                np.add(b_after, over, out=b_after)
                over &= b_after == 0
                # A word of ones passes the carry on.
                while over.any():
                    over[1:] = over[:-1].copy()
                    over[0] = False
                    np.add(b_after, over, out=b_after)
                    over &= b_after == 0
            np.bitwise_xor(b, up, out=b)
            np.bitwise_or(b, same, out=b)
            np.bitwise_or(b, up, out=g)
            np.invert(g, out=g)
            np.bitwise_or(g, down, out=g)
            np.bitwise_and(up, b, out=h)
            np.bitwise_or(same, down, out=b)
            if several:
                np.right_shift(g_before, top, out=before)
                np.left_shift(g, one, out=g)
                np.bitwise_or(g_after, before, out=g_after)
                np.right_shift(h_before, top, out=before)
                np.left_shift(h, one, out=h)
                np.bitwise_or(h_after, before, out=h_after)
            else:
                np.left_shift(g, one, out=g)
                np.left_shift(h, one, out=h)
            np.bitwise_or(g[0], one, out=g[0])
            np.bitwise_and(g, b, out=down)
            np.bitwise_or(b, g, out=b)
            np.invert(b, out=b)
            np.bitwise_or(b, h, out=up)
            if j in stops:
                here, own = ends == j, self.own[low:high]
                change = np.bitwise_count(up & own).sum(axis=0, dtype=np.int64) - np.bitwise_count(down & own).sum(axis=0, dtype=np.int64)
                out[here] = (j + passed + change)[here]
        return out


# Bytes of marks that a band keeps, words near the diagonal and patterns at most.
MARK_BYTES, BAND_WORDS, BAND_LANES = 1 << 26, 1 << 12, 512
# Fewer texts than ``FEW`` are not worth lanes for their beginnings, fewer than about ``MANY`` not a band for all of them.
FEW, MANY = 4, 16
# Up to here the distance of whole texts is found at once.
SHORT = 127
# Bits of a sketch a character, and at most; texts sketched at once, and rows of sketches met at once, in bytes.
BITS_PER_CHARACTER, MOST_BITS = 16, 1 << 18
SKETCHED, MET_BYTES = 512, 1 << 18


def sketches(texts: Sequence[str], q: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of bits for each text, one for every gram of ``q`` characters and its number among equal ones; how many share a bit."""
    rows, extra = np.zeros((len(texts), bits // 64), np.uint64), np.zeros(len(texts), np.int64)
    shift = np.uint64(64 - bits.bit_length() + 1)
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes) - q + 1
        if n < 1:
            continue
        grams = np.zeros(n, np.uint64)
        for j in range(q):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
        grams.sort()
        heads = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        number = np.arange(n) - np.repeat(heads, np.diff(heads, append=n))
        grams += number.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        held = np.zeros(bits, bool)
        held[(grams >> shift).astype(np.int64)] = True
        rows[i] = np.packbits(held).view(np.uint64)
        extra[i] = n - np.count_nonzero(held)
    return rows, extra


def gram_length(loss: float, indel: bool = False) -> int:
    """Grams of which a pair at its limit keeps about half; under two characters they tell nothing."""
    return min(8, int(0.5 / max(loss * (2 if indel else 1), 1e-3) + 1e-9))


def may_be_within(left: Sequence[str], right: Sequence[str], wanted: np.ndarray, limits: np.ndarray, q: int) -> np.ndarray:
    """``wanted`` without pairs whose texts share too few grams for their limit.

    An edit changes at most ``q`` grams of a text, so the longer one shares all
    but ``q`` times the distance of its grams. Bits that two grams share, or
    that meet by chance, only ever overstate what is shared.
    """
    n, m = (np.array([len(t) for t in side], np.int64) for side in (left, right))
    least = np.maximum(n[:, None], m) - q + 1 - q * limits
    asked = wanted & (least > 0)
    out = wanted.copy()
    order = np.argsort(n, kind="stable")
    order = order[asked[order].any(axis=1)]
    start = 0
    while start < len(order):
        some = order[start : start + SKETCHED]
        some = some[n[some] <= 2 * n[some[0]] + 64]
        start += len(some)
        others = np.flatnonzero(asked[some].any(axis=0))
        longest = int(max(n[some].max(), m[others].max()))
        bits = min(MOST_BITS, 1 << max(10, (BITS_PER_CHARACTER * longest - 1).bit_length()))
        step = max(1, MET_BYTES * 8 // bits)
        mine, own = sketches([left[i] for i in some], q, bits)
        known = {left[i]: k for k, i in enumerate(some.tolist())}
        for first in range(0, len(others), SKETCHED):
            block = others[first : first + SKETCHED]
            same = np.array([known.get(right[j], -1) for j in block.tolist()])
            theirs, foreign = mine[same], own[same]
            theirs[same < 0], foreign[same < 0] = sketches([right[j] for j in block[same < 0].tolist()], q, bits)
            for k, i in enumerate(some.tolist()):
                cols = np.flatnonzero(asked[i, block])
                for at in range(0, len(cols), step):
                    c = cols[at : at + step]
                    shared = np.bitwise_count(theirs[c] & mine[k]).sum(axis=1, dtype=np.int64) + np.minimum(own[k], foreign[c])
                    out[i, block[c]] = shared >= least[i, block[c]]
    return out


def pairs_within(
    left: Sequence[str], right: Sequence[str], wanted: np.ndarray, loss: float, indel: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, distance) of the wanted pairs within their limit, as numbers of both.

    The limit is ``loss`` of the longer length, with ``indel`` of both lengths.
    Pairs of longer texts that share too few grams are settled first. Then
    beginnings are compared for many texts at once as in ``within``; pairs
    that these leave open are compared whole.
    """
    n, m = (np.array([len(t) for t in side], np.int64) for side in (left, right))
    limits = (loss * (n[:, None] + m if indel else np.maximum(n[:, None], m)) + 1e-9).astype(np.int64)
    wanted = wanted & (np.abs(n[:, None] - m) <= limits)
    q = gram_length(loss, indel)
    if q > 1:
        long = np.flatnonzero(n > SHORT)
        wanted[long] = may_be_within([left[i] for i in long], right, wanted[long], limits[long], q)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    open_ = wanted.copy()
    order = np.argsort(n, kind="stable")
    start = 0
    while start < len(order):
        # Lanes of about one length: those of the longest one decide the width.
        head = int(n[order[start]]) + 32
        first = int(loss * (2 * head if indel else head) + 1e-9) * 3 // 2 + 16
        short = head <= SHORT
        rows = head if short else first // 64 * 64 + 63
        size = max(1, LANE_BITS // (64 * (rows // 64 + 1)))
        some = order[start : start + size]
        some = some[n[some] <= head]
        start += len(some)
        settled, lanes = short and not indel, None
        if not short and rows >= 0.8 * head:
            continue
        for j in np.flatnonzero(wanted[some].any(axis=0)).tolist():
            asked = wanted[some, j]
            if not settled and np.count_nonzero(asked) < FEW:
                continue
            if lanes is None:
                lanes = Lanes([left[i] if short else left[i][:rows] for i in some])
            ends = np.full(len(some), m[j]) if short else lanes.lengths + m[j] - n[some]
            d = lanes.distances(right[j], np.where(asked, ends, -1))
            close = asked & (d <= limits[some, j])
            open_[some, j] = close & (not settled)
            if settled:
                found.append((some[close], np.full(np.count_nonzero(close), j), d[close]))
    found.extend(_whole(left, right, open_, limits, n, m, indel))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def _whole(
    left: Sequence[str], right: Sequence[str], open_: np.ndarray, limits: np.ndarray, n: np.ndarray, m: np.ndarray, indel: bool
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, distance) of the open pairs within their limit: whole texts, side by side where many are open."""
    measure = indel_within if indel else within
    order = np.flatnonzero(open_.any(axis=1))
    order = order[np.argsort(n[order], kind="stable")]
    start = 0
    while start < len(order):
        first = order[start]
        some = order[start : start + max(16, min(BAND_LANES, BAND_WORDS // (int(limits[first].max()) // 64 + 2)))]
        some = some[n[some] <= n[first] + 64]
        # Steps of a band cost the same for few patterns as for many; those of a single pair grow with its length.
        many = max(MANY / (1 + n[first] / 16_000), len(some) / 4)
        start += len(some)
        band = None
        for j in np.flatnonzero(open_[some].any(axis=0)).tolist():
            at = some[open_[some, j]]
            if not indel and len(at) >= many:
                band = band or Band([left[i] for i in some])
                reach = int((limits[at, j] + np.abs(n[at] - m[j])).max()) // 2 + 1
                d = band.distances(right[j], np.where(open_[some, j], m[j], -1), reach)[open_[some, j]]
            else:
                d = np.array([measure(left[i], right[j], int(limits[i, j])) for i in at.tolist()], np.int64)
            close = (d >= 0) & (d <= limits[at, j])
            yield at[close], np.full(np.count_nonzero(close), j), d[close]
