"""Licence scan: fuzzy search for short notices in whole texts.

A notice that occurs with at most ``k`` edits holds one of its ``k + 1``
pieces unchanged. Exact occurrences of the pieces locate candidates; each
candidate is settled in its neighbourhood, first as an exact occurrence, then
by the regex library's matching with a bounded number of errors, which
reports the span and the edits. Numbers in a notice must match exactly, so a
version is never mistaken for another one.

Texts are searched in normal form: A-Z in lower case, words joined by single
blanks. Null text is empty; a text without words has no matches. Rows that
repeat are scanned alike, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casebook.llm.arrays import blocks, in_batches, texts_of

EDITS_PER_CHARS = 16
BLOCK_ROWS = 1_024
# Phrases whose exact places are counted, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Short notices searched with errors; numbers and short parts stay exact.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2", "apache-2"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2", "mpl-2"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("all rights reserved worldwide", "reserved"),
)
MATCH = (
    "label string, notice string, is_base boolean, start bigint, end bigint, first_word bigint, edits int, score double"
)


class Notice(NamedTuple):
    text: str
    label: str
    base: bool
    edits: int
    seeds: list[tuple[int, bytes]]
    pattern: str


def prepared(text: str, label: str, base: bool, edits_per_chars: int = EDITS_PER_CHARS) -> Notice:
    """A notice with its seeds and its pattern; ``base`` notices allow no edits."""
    import regex

    edits = 0 if base else len(text) // edits_per_chars
    # Even pieces: k edits spoil at most k of the k + 1.
    size = len(text)
    bounds = [size * i // (edits + 1) for i in range(edits + 2)]
    seeds = [(a, text[a:b].encode()) for a, b in zip(bounds, bounds[1:])]
    parts, pattern = regex.findall(r"\d+|[^\d]+", text), ""
    longest = max(parts, key=len)
    for part in parts:
        fuzzy = part is longest and edits
        pattern += f"(?:{regex.escape(part, literal_spaces=True)}){{e<={edits}}}" if fuzzy else regex.escape(part, literal_spaces=True)
    # Whole words only: a notice begins and ends where words do.
    return Notice(text, label, base, edits, seeds, rf"(?<![^ ])(?:{pattern})(?![^ ])")


class Scan:
    """Matches of all notices in one text."""

    def __init__(self, notices: Sequence[Notice]):
        import regex

        self.notices = notices
        self.patterns = [regex.compile(n.pattern, regex.BESTMATCH) if n.edits else None for n in notices]
        self.table = bytes(
            b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
        )

    def normal(self, raw: bytes) -> tuple[bytes, int]:
        """Words joined by single blanks, and their number."""
        words = raw.translate(self.table).split()
        return b" ".join(words), len(words)

    def candidates(self, text: bytes, notice: Notice) -> list[int]:
        """Byte places near which the notice may begin, by the exact places of its seeds."""
        found = set()
        for offset, seed in notice.seeds:
            lead = len(notice.text[:offset].encode())
            at = text.find(seed)
            while at >= 0:
                found.add(at - lead)
                at = text.find(seed, at + 1)
        return sorted(found)

    def exact(self, text: bytes, at: int, raw: bytes) -> bool:
        end = at + len(raw)
        return (
            at >= 0 and text.startswith(raw, at) and (at == 0 or text[at - 1] == 32) and (end == len(text) or text[end] == 32)
        )

    def __call__(self, raw: bytes) -> tuple[int, list[dict]]:
        text, n_words = self.normal(raw)
        out = []
        for notice, pattern in zip(self.notices, self.patterns):
            wanted, seen = notice.text.encode(), set()
            for at in self.candidates(text, notice):
                if self.exact(text, at, wanted):
                    span, edits = (at, at + len(wanted)), 0
                elif pattern is None:
                    continue
                else:
                    # Characters of up to four bytes: the neighbourhood is wide enough in bytes.
                    a = max(0, at - 4 * notice.edits - 4)
                    b = min(len(text), at + len(wanted) + 8 * notice.edits + 8)
                    near = text[a:b].decode("utf-8", "ignore")
                    # Characters cut at the borders must not pass for word bounds.
                    near = ("\0" if a and text[a - 1] != 32 else "") + near + ("\0" if b < len(text) and text[b] != 32 else "")
                    match = pattern.search(near)
                    if match is None:
                        continue
                    lead = len(near[: match.start()].replace("\0", "").encode())
                    skipped = 0
                    while a + skipped < b and text[a + skipped] & 0xC0 == 0x80:
                        skipped += 1
                    start = a + skipped + lead
                    span = (start, start + len(match.group().encode()))
                    edits = sum(match.fuzzy_counts)
                if span not in seen:
                    seen.add(span)
                    out.append((notice, span, edits))
        # Characters and words before each border, counted on from the one before.
        chars, words, last, n, m = {}, {}, 0, 0, 0
        for at in sorted({at for _, span, _ in out for at in span}):
            n += len(text[last:at].decode())
            m += text.count(b" ", last, at)
            chars[at], words[at], last = n, m, at
        return n_words, [
            {
                "label": notice.label, "notice": notice.text, "is_base": notice.base, "start": chars[a],
                "end": chars[b], "first_word": words[a], "edits": edits,
                "score": 1.0 - edits / len(notice.text),
            }
            for notice, (a, b), edits in out
        ]


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    base: Sequence[tuple[str, str]] = BASE, notices: Sequence[tuple[str, str]] = NOTICES,
) -> DataFrame:
    """``doc_id``, ``n_words`` and ``matches``: spans in the normal form, edits and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Scan([prepared(t, x, True) for t, x in base] + [prepared(t, x, False) for t, x in notices])
        match = pa.struct(
            [("label", pa.string()), ("notice", pa.string()), ("is_base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()),
             ("first_word", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())]
        )
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("matches", pa.list_(match))])
        for table in blocks(batches, "text", BLOCK_ROWS):
            raw = texts_of(table.column("text")).cast(pa.large_binary())
            found = [search(x.as_py()) for x in raw]
            columns = [
                table.column("doc_id").combine_chunks(),
                pa.array([n for n, _ in found], pa.int64()),
                pa.array([m for _, m in found], schema.field("matches").type),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows).mapInArrow(run, f"doc_id bigint, n_words bigint, matches array<struct<{MATCH}>>")
