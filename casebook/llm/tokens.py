"""Words of blocks of texts, cut at single bytes of ASCII; no Python object per word."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_kinds(**groups: str) -> np.ndarray:
    """0 for bytes of words, other numbers for the characters of ``groups``, by their order."""
    kinds = np.zeros(256, np.uint8)
    for number, characters in enumerate(groups.values(), 1):
        kinds[[ord(c) for c in characters]] = number
    return kinds


class Words:
    """The words of a block of texts, lower-cased in A-Z: codes, distinct words, and the text of each word.

    ``breaks`` says for each word how many bytes of kind 2 come before it in the block.
    """

    def __init__(self, texts: pa.LargeStringArray, kinds: np.ndarray):
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        data = LOWER[data]
        kind = kinds[data]
        inside = kind == 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = bounds[:-1][bounds[:-1] < len(data)]
        first[heads] = inside[heads]
        starts = np.flatnonzero(first)
        ends = np.cumsum(inside, dtype=np.int64)[starts] - 1
        offsets = np.append(ends, np.count_nonzero(inside))
        words = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes())
        ).dictionary_encode()
        self.vocabulary = words.dictionary
        self.codes = np.asarray(words.indices).astype(np.int64)
        self.text = np.searchsorted(bounds, starts, side="right") - 1
        self.breaks = np.cumsum(kind == 2, dtype=np.int64)[starts]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over all places."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def longer(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on with a word."""
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + word)
