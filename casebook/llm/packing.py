"""Lexical retrieval packing: neighbours found by BM25 share a training window.

The rows of a task are cut into shards of bounded length, in order. A shard
has its own inverted index with its own document frequencies, taken over the
whole texts of all its rows. Full windows of a long document stand alone; the
rest of each document is packed: a seed opens a window, its unused neighbours
fill it in the order of their BM25 score, the last one is cut to fit, and what
is left of it waits for a later window. No text is shuffled and nothing but
one shard is held.

Null text is an empty text, an empty text is the closing id alone. Rows that
repeat an id are packed once each. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from casebook.llm.arrays import blocks, coded_words, gather, in_batches, texts_of

WINDOW = 2048
END_ID = 1
SHARD_ROWS = 1024
SHARD_CHARS = 3_000_000
CACHED_WORDS = 150_000
K1, B = 1.2, 0.75
# White space before a blank that white space or the end follows: words can't be cut there.
ODD_BLANKS = r"[\t-\r\x{85}\pZ] ([\t-\r\x{85}\pZ]|\z)"
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
)


def byte_bpe(ranks_path: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids of a text under a byte-level BPE vocabulary given as ranks."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def added_tokens(tokenizer_path: str) -> list[str]:
    """Strings that a tokenizer's file has besides its vocabulary, and that it finds inside texts."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens") or [] if t["content"]]


def by_tokenizer(tokenizer_path: str) -> Callable[[str], list[int]]:
    """Ids of a text by the tokenizer's own file; it is read with the first text."""
    made = None

    def encode(text: str) -> list[int]:
        nonlocal made
        if made is None:
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(tokenizer_path)
        return made.encode(text, add_special_tokens=False).ids

    return encode


class Tokens:
    """Ids of many texts at once.

    A blank before a word always starts a new piece of this vocabulary, so
    texts are cut there and each distinct word is encoded once for a shard.
    Frequent words are kept between shards, up to ``CACHED_WORDS``. Texts in
    which blanks meet other white space are encoded whole, and texts that
    hold one of the ``added`` tokens are left to ``exact``.
    """

    def __init__(
        self, encode: Callable[[str], list[int]], exact: Callable[[str], list[int]] | None = None, added: Sequence[str] = ()
    ):
        self.encode, self.exact, self.added = encode, exact, added
        self.known: dict[str, bytes] = {}
        self.tab = encode("\t")[0]

    def _learn(self, words: list[str]) -> None:
        """Encode words as they stand behind a blank.

        Words without white space at their ends go in one text, between tabs:
        a tab before a blank is a piece of its own, and no word here has one.
        """
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace() and "\t" not in w]
        if plain:
            ids = np.array(self.encode("\t".join([" " + w for w in plain])), "<u4")
            ends = np.append(np.flatnonzero(ids == self.tab), len(ids)) * 4
            raw, start = ids.tobytes(), 0
            for word, end in zip(plain, ends.tolist()):
                self.known[word] = raw[start:end]
                start = end + 4
        for word in words:
            if word not in self.known:
                self.known[word] = array("I", self.encode(" " + word)).tobytes()

    def __call__(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, int]]:
        """Bounds of each text's ids, the ids (without closing ids), and the texts' words as ``Index`` takes them."""
        odd = np.asarray(pc.match_substring_regex(texts, ODD_BLANKS))
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= np.asarray(pc.match_substring(texts, token))
        odd = odd | special
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        lists = pc.split_pattern(plain, " ")
        bounds = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        words = np.asarray(coded.indices)
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        if new := [w for w in distinct if w not in self.known]:
            self._learn(new)
        parts = list(map(self.known.__getitem__, distinct))
        # Words at the head of a text have no blank before them; odd texts take the place of one.
        heads = bounds[:-1]
        first = [distinct[c] for c in words[heads].tolist()]
        own = [array("I", self.encode(w)).tobytes() for w in first]
        for i in np.flatnonzero(odd).tolist():
            encode = self.exact if special[i] else self.encode
            own[i] = array("I", encode(texts[i].as_py())).tobytes()
        ids = np.frombuffer(b"".join([*parts, *own]), "<u4")
        sizes = np.fromiter(map(len, [*parts, *own]), np.int64, len(parts) + len(own)) // 4
        codes = words.astype(np.int64)
        # The same words as of coded_words(texts), but each distinct one is cut at white space only once.
        whole = codes.copy()
        whole[heads[odd]] = len(distinct) + np.arange(int(odd.sum()))
        cut, terms, known = coded_words(pa.concat_arrays([coded.dictionary, texts.filter(pa.array(odd))]))
        runs = np.diff(cut)[whole]
        found = np.concatenate([[0], np.cumsum(runs)])[bounds], terms[gather(cut[whole], runs)], len(known)
        codes[heads] = len(parts) + np.arange(len(own))
        lengths = sizes[codes]
        total = np.concatenate([[0], np.cumsum(lengths)])
        starts = np.cumsum(sizes) - sizes
        return total[bounds], ids[gather(starts[codes], lengths)], found


class Index:
    """Inverted index of one shard with BM25 weights in its postings."""

    def __init__(self, bounds: np.ndarray, codes: np.ndarray, terms: int, max_share: float = 1.0):
        n, v = len(bounds) - 1, max(1, terms)
        lengths = np.diff(bounds)
        rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
        keys, counts = np.unique(rows * v + codes, return_counts=True)
        row, term = keys // v, keys % v
        df = np.bincount(term, minlength=v)
        # A word of one document joins nothing; frequent ones have a low weight and stay.
        useful = (df >= 2) & (df <= max(2, max_share * n))
        keep = useful[term]
        row, term, counts = row[keep], term[keep], counts[keep]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean())) if n else lengths
        weight = idf[term] * counts * (K1 + 1) / (counts + norm[row])
        self.n = n
        self.row_bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        self.row_terms = term
        order = np.argsort(term, kind="stable")
        self.post_rows, self.post_weights = row[order], weight[order]
        self.term_bounds = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=v))])

    @classmethod
    def of(cls, texts: pa.LargeStringArray, max_share: float = 1.0) -> Index:
        bounds, codes, distinct = coded_words(texts)
        return cls(bounds, codes, len(distinct), max_share)

    def neighbours(self, seed: int, free: np.ndarray) -> np.ndarray:
        """Free rows that share a useful word with the seed, best score first, ties by place."""
        terms = self.row_terms[self.row_bounds[seed] : self.row_bounds[seed + 1]]
        starts = self.term_bounds[terms]
        at = gather(starts, self.term_bounds[terms + 1] - starts)
        scores = np.bincount(self.post_rows[at], weights=self.post_weights[at], minlength=self.n)
        found = np.flatnonzero((scores > 0) & free)
        return found[np.argsort(-scores[found], kind="stable")]


def powers(n: int) -> list[int]:
    """The powers of two that ``n`` is the sum of, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_shard(
    lengths: np.ndarray, index: Index, window: int = WINDOW, owners: Sequence | None = None
) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of one shard as lists of (row, start, length).

    ``owners`` names the document of each row: copies of one document share a
    packed window only if nothing else is left to fill it.
    """
    owners = range(len(lengths)) if owners is None else owners
    begin = lengths // window * window
    for row in np.flatnonzero(begin).tolist():
        for start in range(0, int(begin[row]), window):
            yield [(row, start, window)]
    left = lengths - begin
    free = left > 0
    begin, left = begin.tolist(), left.tolist()
    cursor, n = 0, len(left)
    while True:
        while cursor < n and not free[cursor]:
            cursor += 1
        if cursor == n:
            return
        held, inside, room = [], set(), window

        def take(row: int) -> None:
            nonlocal room
            size = min(room, left[row])
            held.append((row, begin[row], size))
            inside.add(owners[row])
            begin[row] += size
            left[row] -= size
            room -= size
            free[row] = left[row] > 0

        def fill(rows, again: bool = False) -> None:
            for row in rows:
                if not room:
                    return
                if free[row] and (again or owners[row] not in inside):
                    take(row)

        take(cursor)
        if room:
            fill(index.neighbours(cursor, free).tolist())
        # Nothing more that is alike: what comes next, and copies at the very end.
        fill(range(cursor, n))
        fill(range(cursor, n), again=True)
        if not room:
            yield held
            continue
        # The end of the shard: parts of exact powers of two need no padding.
        for size in powers(window - room):
            part = []
            while size:
                row, start, length = held[0]
                cut = min(size, length)
                part.append((row, start, cut))
                size -= cut
                if cut == length:
                    held.pop(0)
                else:
                    held[0] = (row, start + cut, length - cut)
            yield part


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    shard_rows: int = SHARD_ROWS,
    shard_chars: int = SHARD_CHARS,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit), see ``PIECES``.

    ``ranks_path`` and ``pattern`` name the vocabulary, which every worker
    must reach. So does ``tokenizer_path``, the file of a tokenizer with the
    same vocabulary: texts that hold one of its added tokens get its ids.
    Without it no string is special. Sequences hold at most ``window`` ids;
    those shorter than a window have a length that is a power of two.
    """
    added = added_tokens(tokenizer_path) if tokenizer_path else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema(
            [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
             ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
        )
        tokens = None
        sequence = TaskContext.get().partitionId() << 33
        for table in blocks(batches, "text", shard_rows, shard_chars):
            tokens = tokens or Tokens(byte_bpe(ranks_path, pattern), tokenizer_path and by_tokenizer(tokenizer_path), added)
            texts = texts_of(table.column("text"))
            doc_ids = table.column("doc_id").to_pylist()
            bounds, ids, words = tokens(texts)
            index = Index(*words)
            lengths = np.diff(bounds) + 1
            # Closing ids go in behind each text's own ids.
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4").tobytes()
            offsets = (bounds[:-1] + np.arange(len(texts))).tolist()
            sizes = lengths.tolist()
            out: list[list] = [[] for _ in schema]
            for pieces in pack_shard(lengths, index, window, doc_ids):
                place = 0
                for row, start, length in pieces:
                    at = 4 * (offsets[row] + start)
                    values = (doc_ids[row], start, length, ids[at : at + 4 * length], sizes[row], sequence, place)
                    for column, value in zip(out, values):
                        column.append(value)
                    place += length
                sequence += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows).mapInArrow(run, PIECES)
