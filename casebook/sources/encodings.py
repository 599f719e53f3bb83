"""Which encoding a file is in: each candidate that fits is scored by how usual its characters are.

A byte string is often valid in several encodings, and then only what it
reads as tells them apart. The score of a candidate is the number of bits
that its characters would take if usual ones are short: plain ASCII, the
characters that the two Chinese standards list as frequent, letters of Western
languages beside other letters. What no one would write, such as rare
characters between Latin letters or single accented letters in a row, is
dear. The candidate with the fewest bits is taken; ties go in the order of
``CANDIDATES``.
"""

from __future__ import annotations

import codecs

import numpy as np

# Name, codec, byte order mark. Their order settles ties.
CANDIDATES = [
    ("utf-8", "utf-8", codecs.BOM_UTF8), ("utf-16-le", "utf-16-le", codecs.BOM_UTF16_LE), ("utf-16-be", "utf-16-be", codecs.BOM_UTF16_BE),
    ("gbk", "gbk", b""), ("gb18030", "gb18030", b""), ("big5", "big5", b""), ("latin-1", "latin-1", b""),
]
ASCII_BITS, CONTROL_BITS, RARE_BITS = 5, 24, 26
# Two-byte units without a byte order mark are unusual.
UNMARKED_BITS = 16


def _rows(first: int, last: int, codec: str, trails: range) -> list[int]:
    """Code points of the two-byte characters whose first byte lies in a range."""
    out = []
    for lead in range(first, last + 1):
        for trail in trails:
            try:
                out.append(ord(bytes([lead, trail]).decode(codec)))
            except UnicodeDecodeError:
                continue
    return out


def _bits() -> dict[str, np.ndarray]:
    """Bits of each code point under each kind of encoding; built from the layout of the standards."""
    base = np.full(1 << 16, RARE_BITS, np.uint8)
    base[:128] = ASCII_BITS
    base[:32] = CONTROL_BITS
    base[[9, 10, 13]] = ASCII_BITS
    base[127:160] = CONTROL_BITS
    tables = {}
    trails = {"gb2312": range(0xA1, 0xFF), "big5": [*range(0x40, 0x7F), *range(0xA1, 0xFF)]}
    # Rows of each standard: marks, frequent characters, less frequent ones; the bits of each.
    layout = {
        "gb2312": [(0xD8, 0xF7, 17), (0xB0, 0xD7, 11), (0xA1, 0xA3, 9)],
        "big5": [(0xC9, 0xF9, 17), (0xA4, 0xC6, 11), (0xA1, 0xA3, 9)],
    }
    for standard, rows in layout.items():
        tables[standard] = base.copy()
        for first, last, bits in rows:
            points = [p for p in _rows(first, last, standard, trails[standard]) if p > 159]
            tables[standard][points] = bits
    western = base.copy()
    western[0xA0:0xC0] = 12
    western[0xC0:0x100] = 8
    western[[0xD7, 0xF7]] = 14
    tables["western"] = western
    # Unicode encodings may hold any of these.
    tables["any"] = np.minimum.reduce([tables["gb2312"], tables["big5"], western])
    return tables


KINDS = {"utf-8": "any", "utf-16-le": "any", "utf-16-be": "any", "gbk": "gb2312", "gb18030": "gb2312", "big5": "big5", "latin-1": "western"}


class Sniffer:
    def __init__(self) -> None:
        self.bits = _bits()

    def cost(self, text: str, name: str) -> int:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = points >= 1 << 16
        bits = self.bits[KINDS[name]][np.where(wide, 0, points)].astype(np.int64)
        bits[wide] = RARE_BITS
        if name == "latin-1" and len(points):
            # Accented letters stand alone among plain ones; in a row they are what other encodings look like.
            high = points >= 0xA0
            bits[1:][high[1:] & high[:-1]] += 8
        return int(bits.sum())

    def __call__(self, content: bytes) -> tuple[str, str]:
        """The text and the name of its encoding."""
        best = None
        for name, codec, mark in CANDIDATES:
            marked = bool(mark) and content.startswith(mark)
            try:
                text = (content[len(mark) :] if marked else content).decode(codec)
            except UnicodeDecodeError:
                continue
            if marked:
                return text, name
            cost = self.cost(text, name) + (UNMARKED_BITS if name.startswith("utf-16") else 0)
            if best is None or cost < best[0]:
                best = (cost, text, name)
        return best[1], best[2]
