"""The index of a shard holds every word that two of its texts share."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from casebook.llm import packing
from casebook.llm.arrays import coded_words
from casebook.llm.queries import tokenizer_file, vocabulary


@pytest.fixture(scope="module")
def tokens():
    path = tokenizer_file()
    return packing.Tokens(packing.byte_bpe(*vocabulary()), packing.by_tokenizer(path), packing.added_tokens(path))


def texts(values):
    return pa.array(values, pa.large_string())


def counted(bounds, codes):
    """For each text the sizes of its words' groups over all texts: equal whatever the numbers of the words."""
    return [sorted(np.bincount(codes)[codes[a:b]].tolist()) for a, b in zip(bounds, bounds[1:])]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \t\n\x0b\x85\u2003é", max_size=30) | st.just("a <|endoftext|>\nb"), min_size=1, max_size=6))
def test_words_are_cut_at_all_white_space(tokens, values):
    bounds, codes, n = tokens(texts(values))[2]
    want_bounds, want, _ = coded_words(texts(values))
    assert bounds.tolist() == want_bounds.tolist() and all(codes < n)
    # A one-to-one renaming of the word numbers.
    assert len({*zip(codes.tolist(), want.tolist())}) == len({*codes.tolist()}) == len({*want.tolist()})
    assert counted(bounds, codes) == counted(want_bounds, want)


def test_line_breaks_separate_words(tokens):
    index = packing.Index(*tokens(texts(["red\nfox\tden", "blue sky", "fox\nhole", "sky\nhigh"]))[2])
    assert index.neighbours(0, np.arange(4) > 0).tolist() == [2]


def test_odd_blanks_of_one_text_change_no_neighbours(tokens):
    rnd = random.Random(1)
    values = ["\n".join(" ".join(rnd.choice("abcdefghij") * 2 for _ in range(3)) for _ in range(4)) for _ in range(40)]
    plain, odd = (packing.Index(*tokens(texts([*values, last]))[2]) for last in ("kk ll", "kk \n ll"))
    free = np.ones(41, bool)
    for seed in range(40):
        assert plain.neighbours(seed, free).tolist() == odd.neighbours(seed, free).tolist()


def test_words_of_a_large_group_join_its_texts(tokens):
    """The topic fills a third of the shard and shares only its own words."""
    values = [f"topic{i % 2} subject n{i}" if i % 3 == 0 else f"x{i} y{i}" for i in range(60)]
    index = packing.Index(*tokens(texts(values))[2])
    found = index.neighbours(0, np.arange(60) > 0).tolist()
    assert sorted(found) == list(range(3, 60, 3))
    assert {i % 2 for i in found[:9]} == {0}
