"""Periodic runs of words: every maximal repetition of a text, and the text with repetitions collapsed.

A run is a stretch of words with smallest period ``q`` and at least
``max(min_words, 2 q)`` words that no neighbouring word extends. Candidates
come from harmonic grids: for each period ``p`` only places on a grid of
step ``max(p, min_words - p)`` are compared with the places ``p`` further on,
because every run holds such a pair. A pair that agrees is extended both ways
by longest common extensions (LCE).

LCEs use a difference cover. Only suffixes whose place, modulo 31, is in the
cover are sorted; any two places reach sorted ones after the same number of
at most 30 words. Those words are compared one by one, the rest is a range
minimum over the common prefixes of neighbours in the sorted order, answered
by a sparse table. Suffixes are sorted by their first 31 words, then by
doubling. Extensions to the left use the same structure on reversed words.

Work is done over blocks of whole documents; a longer document is a block of
its own. Null and empty texts have no words and no runs. Rows are kept as they
come, repeated ones too; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from casebook.llm.arrays import blocks, coded_words, gather, in_batches, texts_of

MIN_WORDS = 12
MODULUS = 31
# A perfect difference cover: every residue is a difference of two members.
COVER = (1, 5, 11, 24, 25, 27)
BLOCK_ROWS = 4_096
POINTS = 1_000_000

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def shifts(modulus: int = MODULUS, cover: Sequence[int] = COVER) -> np.ndarray:
    """For residues (a, b) the least k with a + k and b + k both in the cover."""
    members = np.zeros(modulus, bool)
    members[list(cover)] = True
    a, b = np.indices((modulus, modulus))
    out = np.full((modulus, modulus), -1, np.int64)
    for k in range(modulus - 1, -1, -1):
        out[members[(a + k) % modulus] & members[(b + k) % modulus]] = k
    return out


SHIFTS = shifts()


class Extensions:
    """Longest common extensions to the right of places in one document.

    ``words`` holds the codes of all documents, each followed by ``MODULUS``
    places of -1; ``ends`` has for each place the end of its document, and for
    places between documents the place itself.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        self.words, self.ends = words, ends
        place = np.arange(len(words))
        sampled = np.zeros(MODULUS, bool)
        sampled[list(COVER)] = True
        at = np.flatnonzero(sampled[place % MODULUS] & (place < ends))
        self.slot = np.full(len(words) + MODULUS, -1, np.int64)
        self.slot[at] = np.arange(len(at))
        self._sort(at)
        self._neighbours(at)

    def _sort(self, at: np.ndarray) -> None:
        """``order``: samples in suffix order, document by document; ``levels``: ranks by 31 * 2^k words."""
        words, n = self.words, len(at)
        limit = self.ends[at]
        bits = max(1, (int(words.max(initial=0)) + 2).bit_length())
        per = max(1, 62 // bits)

        def packed(places: np.ndarray, first: int) -> np.ndarray:
            key = np.zeros(len(places), np.int64)
            for t in range(first, min(first + per, MODULUS)):
                key = (key << bits) | (words[places + t] + 1)
            return key

        key = packed(at, 0)
        order = np.lexsort((key, limit))
        new = np.ones(n, bool)
        new[1:] = (limit[order][1:] != limit[order][:-1]) | (key[order][1:] != key[order][:-1])
        rank = np.empty(n, np.int64)

        def ranked(new: np.ndarray) -> None:
            rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))

        def refined(key_of, new: np.ndarray) -> None:
            """Sorts each group of equal ranks by a further key; groups keep their slots."""
            alone = new.copy()
            alone[:-1] &= new[1:]
            tied = np.flatnonzero(~alone)
            members = order[tied]
            key, group = key_of(members), rank[members]
            perm = np.lexsort((key, group))
            order[tied] = members[perm]
            key, group = key[perm], group[perm]
            new[tied[1:]] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])

        ranked(new)
        for first in range(per, MODULUS, per):
            if new.all():
                break
            refined(lambda m, first=first: packed(at[m], first), new)
            ranked(new)
        self.levels, reach = [rank.copy()], MODULUS
        while not new.all():
            before = self.levels[-1]

            def key_of(members: np.ndarray) -> np.ndarray:
                place = at[members] + reach
                inside = place < limit[members]
                return np.where(inside, before[self.slot[np.where(inside, place, at[members])]], -1)

            refined(key_of, new)
            ranked(new)
            self.levels.append(rank.copy())
            reach *= 2
        self.order, self.rank = order, rank

    def _neighbours(self, at: np.ndarray) -> None:
        """Sparse table of the common prefixes of neighbours in suffix order."""
        a, b = at[self.order[:-1]], at[self.order[1:]]
        same = self.ends[a] == self.ends[b]
        common = np.zeros(len(a), np.int64)
        todo = np.flatnonzero(same)
        for k in range(len(self.levels) - 1, -1, -1):
            reach = MODULUS << k
            x, y = a[todo] + common[todo], b[todo] + common[todo]
            # Equal stretches end inside the document, so both places are sampled or at its end.
            open_ = (x < self.ends[a[todo]]) & (y < self.ends[a[todo]])
            level = self.levels[k]
            equal = open_.copy()
            equal[open_] = level[self.slot[x[open_]]] == level[self.slot[y[open_]]]
            common[todo[equal]] += reach
        for _ in range(MODULUS):
            if not len(todo):
                break
            todo = todo[self._equal(a[todo] + common[todo], b[todo] + common[todo])]
            common[todo] += 1
        self.table = [common]
        width = 1
        while 2 * width <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (self.words[x] == self.words[y]) & (self.words[x] >= 0)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and ``j`` on (i < j, same document) are equal."""
        steps = SHIFTS[i % MODULUS, j % MODULUS]
        out = np.zeros(len(i), np.int64)
        todo = np.arange(len(i))
        reached = []
        for t in range(MODULUS):
            there = steps[todo] == t
            reached.append(todo[there])
            todo = todo[~there]
            if not len(todo):
                break
            todo = todo[self._equal(i[todo] + t, j[todo] + t)]
            out[todo] = t + 1
        hit = np.concatenate(reached)
        x, y = i[hit] + steps[hit], j[hit] + steps[hit]
        inside = np.maximum(x, y) < self.ends[i[hit]]
        hit, x, y = hit[inside], self.rank[self.slot[x[inside]]], self.rank[self.slot[y[inside]]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            own = level == k
            mins = self.table[k]
            out[hit[own]] += np.minimum(mins[low[own]], mins[high[own] - (1 << int(k))])
        return out


def runs_of(codes: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """All runs of the documents of a block: (document, start, length, period), by document, start, period."""
    sizes = np.diff(bounds)
    docs = np.flatnonzero(sizes >= max(min_words, 2))
    empty = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(docs):
        return empty
    sizes = sizes[docs]
    # Padded layout: MODULUS places of -1 before the first document and after each.
    starts = MODULUS + np.cumsum(sizes + MODULUS) - (sizes + MODULUS)
    total = int(starts[-1] + sizes[-1] + MODULUS)
    words = np.full(total, -1, np.int64)
    places = gather(starts, sizes)
    words[places] = codes[gather(bounds[:-1][docs], sizes)]

    # Places that agree with the one a period further on, on the grid of each period.
    periods = sizes // 2
    owner = np.repeat(np.arange(len(docs)), periods)
    period = gather(np.ones(len(docs), np.int64), periods)
    step = np.maximum(period, min_words - period)
    points = -(-(sizes[owner] - period) // step)
    limits = np.searchsorted(np.cumsum(points), np.arange(POINTS, int(points.sum()) + POINTS, POINTS), side="right") + 1
    found, before = [], 0
    for limit in limits.tolist():
        chunk = slice(before, min(limit, len(points)))
        before = limit
        n = points[chunk]
        if not len(n):
            continue
        i = np.repeat(starts[owner[chunk]], n) + gather(np.zeros(len(n), np.int64), n) * np.repeat(step[chunk], n)
        p = np.repeat(period[chunk], n)
        same = np.flatnonzero(words[i] == words[i + p])
        found.append((i[same], p[same], np.repeat(owner[chunk], n)[same]))
    i, p, own = (np.concatenate(x) for x in zip(*found))
    if not len(i):
        return empty

    ends = np.arange(total)
    ends[places] = np.repeat(starts + sizes, sizes)
    right = Extensions(words, ends)(i, i + p)
    # The same places in the reversed block, where documents end at their first word.
    ends = np.arange(total)
    ends[total - 1 - places] = np.repeat(total - starts, sizes)
    left = np.zeros(len(i), np.int64)
    inner = i > starts[own]
    left[inner] = Extensions(words[::-1].copy(), ends)(total - (i + p)[inner], total - i[inner])
    long = right + left >= np.maximum(p, min_words - p)
    own, p, start, length = own[long], p[long], (i - left)[long], (right + left + p)[long]
    # One stretch shows up under multiples of its period and once per grid place: the smallest period counts.
    order = np.lexsort((p, length, start))
    own, p, start, length = own[order], p[order], start[order], length[order]
    first = np.ones(len(own), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    own, p, start, length = own[first], p[first], start[first], length[first]
    order = np.lexsort((p, start))
    own, p, start, length = own[order], p[order], start[order], length[order]
    return docs[own], start - starts[own], length, p


def kept_words(bounds: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words of a block stay: those that no run holds after its first period."""
    change = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(change, bounds[doc] + start + period, 1)
    np.add.at(change, bounds[doc] + start + length, -1)
    return np.cumsum(change)[:-1] == 0


def find_runs(
    docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, keep: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of every row (default: all), with ``runs`` and ``collapsed``.

    ``runs`` are ordered by start, then period; starts and lengths count
    words. ``collapsed`` is the text without the words that a run holds after
    its first period, joined by single blanks.
    """
    kept_columns = [c for c in docs.columns if keep is None or c in keep]
    clash = {"runs", "collapsed"} & set(kept_columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = T.StructType([
        *[docs.schema[c] for c in kept_columns],
        *T.StructType.fromDDL(f"runs {RUN}"),
        T.StructField("collapsed", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, text_col, BLOCK_ROWS):
            bounds, codes, distinct = coded_words(texts_of(table.column(text_col)))
            doc, start, length, period = runs_of(codes, bounds, min_words)
            counts = np.bincount(doc, minlength=table.num_rows)
            items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
            found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), items)
            stays = kept_words(bounds, doc, start, length, period)
            at = np.concatenate([[0], np.cumsum(stays)])[bounds]
            words = pa.array(distinct, pa.large_string()).take(pa.array(codes[stays]))
            lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), words)
            out = table.select(kept_columns)
            out = out.append_column("runs", found.cast(RUN_TYPE))
            out = out.append_column("collapsed", pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()))
            yield from out.to_batches()

    read = list(dict.fromkeys([*kept_columns, text_col]))
    return in_batches(docs.select(*read)).mapInArrow(run, schema)
