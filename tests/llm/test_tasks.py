"""The code that runs inside tasks, against plain counterparts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from casebook.llm import arrays, language, licences, minhash, nearest, packing, personal
from casebook.llm.queries import vocabulary
from tests.llm import brute

ODD = "aB1 \t\n\x0b\x1c\x85  é公.,'@-+()\U0001f600"


def texts(values):
    return pa.array(values, pa.large_string())


@pytest.fixture(scope="module")
def tokens():
    return packing.Tokens(packing.byte_bpe(*vocabulary()))


@pytest.fixture(scope="module")
def reference_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(ODD, max_size=60), min_size=1, max_size=5))
def test_ids_equal_the_tokenizer(tokens, reference_tokenizer, values):
    bounds, ids, _ = tokens(texts(values))
    for value, a, b in zip(values, bounds, bounds[1:]):
        assert ids[a:b].tolist() == reference_tokenizer.encode(value, add_special_tokens=False).ids


def test_ids_of_special_strings_and_long_words(tokens, reference_tokenizer):
    values = ["<|endoftext|> it's  we'll \n\n x", "a" * 5000, "", " ", "  ", " lead", "trail "]
    bounds, ids, _ = tokens(texts(values))
    for value, a, b in zip(values, bounds, bounds[1:]):
        assert ids[a:b].tolist() == reference_tokenizer.encode(value, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=25), st.randoms(use_true_random=False))
def test_every_id_is_packed_once(lengths, rnd):
    words = [" ".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in lengths]
    window, room = 32, np.array(lengths, np.int64)
    seen = [np.zeros(n, int) for n in lengths]
    for pieces in packing.pack_shard(room, packing.Index.of(texts(words), 1.0), window):
        size = sum(n for _, _, n in pieces)
        assert size == window or size & (size - 1) == 0
        for row, start, n in pieces:
            seen[row][start : start + n] += 1
    assert all((s == 1).all() for s in seen)


def test_copies_meet_last():
    words = texts(["red fox den", "red fox den", "red car fox", "sky", "red fox den"])
    index = packing.Index.of(words, 1.0)
    first, *rest = packing.pack_shard(np.array([8, 8, 4, 4, 8]), index, 16, [7, 7, 1, 2, 7])
    assert first == [(0, 0, 8), (2, 0, 4), (3, 0, 4)]
    assert rest == [[(1, 0, 8), (4, 0, 8)]]


def test_neighbours_are_ranked_by_bm25():
    values = ["red fox den", "blue sky", "red fox den hole", "red car", "fox den den", ""]
    index = packing.Index.of(texts(values), 1.0)
    n, k1, b = len(values), packing.K1, packing.B
    split = [v.split() for v in values]
    mean = sum(map(len, split)) / n

    def score(q, d):
        total = 0.0
        for t in set(split[q]):
            df = sum(t in s for s in split)
            tf = split[d].count(t)
            if df >= 2 and tf:
                idf = np.log1p((n - df + 0.5) / (df + 0.5))
                total += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(split[d]) / mean))
        return total

    free = np.array([False, True, True, True, True, True])
    want = sorted((d for d in range(1, n) if score(0, d) > 0), key=lambda d: (-score(0, d), d))
    assert index.neighbours(0, free).tolist() == want
    free[want[0]] = False
    assert index.neighbours(0, free).tolist() == want[1:]


@settings(max_examples=300, deadline=None)
@given(st.text("aé.@%+-0 1259()" + "٣", max_size=80))
def test_plain_spans(text):
    got = [(k, a, b) for k, a, b, sound in personal.plain_spans(text) if sound]
    assert got == brute.personal(text)


def test_plain_spans_of_hard_texts():
    for text in ("4" * 20000, "a@b" * 3000, "1.2.3.4.5.6.7.8", "0001.2.3.4 1.2.3.256", "4111 1111 1111 1111", "+1 (394) 555-4006",
                 "0" * 6000 + ".1.1.1"):
        if len(text) < 6000:
            assert [(k, a, b) for k, a, b, s in personal.plain_spans(text) if s] == brute.personal(text)
        else:
            list(personal.plain_spans(text))
    found = list(personal.loose_spans("write to jane.roe (at) mail dot example.org now"))
    assert ("email", 9, 43) in found or any(k == "email" for k, _, _ in found)


def scan():
    return licences.Scan([licences.prepared(t, x, True) for t, x in licences.BASE] + [licences.prepared(t, x, False) for t, x in licences.NOTICES])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("under the mit license apache version 2 cc by nc UNDER Apache é , - 22 x".split()), max_size=30), st.sampled_from([" ", ", ", "\n"]))
def test_exact_places(words, glue):
    text = glue.join(words)
    n, matches = scan()(text.encode())
    base = sorted(m["first_word"] for m in matches if m["is_base"])
    labels = ",".join(sorted({m["label"] for m in matches if m["is_base"]}))
    assert (n, base, labels) == brute.licence_base(text, licences.BASE)


def test_fuzzy_notices():
    find = lambda t: {(m["label"], m["edits"]) for m in scan()(t.encode())[1] if not m["is_base"]}
    assert ("mit", 0) in find("Released under the MIT License.")
    assert ("mit", 1) in find("é Releaced under the MIT License é")
    assert ("gpl-3", 2) in find("GNU Generl Public Licence, version 3")
    assert not find("GNU General Public License, version 9")
    assert not find("unreleased undertones of the mitten licenses")
    n, matches = scan()("éé Releaced under the MIT License".encode())
    fuzzy = [m for m in matches if m["edits"] == 1][0]
    assert (fuzzy["start"], fuzzy["end"], fuzzy["first_word"]) == (3, 33, 1)


def test_every_edit_within_the_bound_is_found():
    rnd, search = random.Random(3), scan()
    for text, label in licences.NOTICES:
        edits = len(text) // licences.EDITS_PER_CHARS
        plain = [i for i, c in enumerate(text) if c.isalpha()]
        for _ in range(20):
            changed = list(text)
            for i in rnd.sample(plain, edits):
                changed[i] = "q"
            found = search(("x " + "".join(changed) + " y").encode())[1]
            numbers = len([p for p in text.split() if p.isdigit()])
            assert any(m["label"] == label and m["notice"] == text for m in found), (text, "".join(changed), numbers)


def test_signatures_estimate_similarity():
    rnd, table = np.random.default_rng(1), minhash.borrow_table(minhash.BINS)
    for size in (3, 40, 2000):
        a = np.unique(rnd.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], rnd.integers(0, 2**63, max(1, size // 10), dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = (minhash.signature(a, minhash.BINS, table) == minhash.signature(b, minhash.BINS, table)).mean()
        assert abs(true - same) < (0.5 if size < 10 else 0.2)
        assert (minhash.signature(a, minhash.BINS, table) == minhash.signature(a.copy(), minhash.BINS, table)).all()


def test_shingles_of_short_texts():
    make = minhash.Shingles(2)
    one, same, other, none, two = make(texts(["A", " a ", "b", " \t", "a b"]))
    assert one.tolist() == same.tolist() != other.tolist()
    assert len(none) == 0 and len(two) == 1 and two[0] != one[0]


def test_chi_square():
    for p, m, value in ((0.95, 2, 5.991), (0.99, 12, 26.217), (0.5, 10, 9.342)):
        assert abs(nearest.chi_square_quantile(p, m) - value) < 1e-2


def test_tree_holds_every_point_and_bounds_distances():
    points = np.random.default_rng(2).standard_normal((500, 4))
    points[100:300] = points[0]
    tree = nearest.Tree(points, 16)
    assert sorted(tree.order.tolist()) == list(range(500))
    q = np.ones(4)
    for j, least in enumerate(tree.distances(q)):
        own = points[tree.order[tree.bounds[j] : tree.bounds[j + 1]]]
        assert (((own - q) ** 2).sum(axis=1) >= least - 1e-9).all()


def test_blocks_keep_all_rows_in_order():
    batches = [pa.record_batch({"text": ["a" * n for n in sizes], "i": [10 * k + i for i, _ in enumerate(sizes)]})
               for k, sizes in enumerate([[1, 50, 3], [], [200], [2, 2, 2, 2]]) if sizes]
    out = list(arrays.blocks(iter(batches), "text", 3, 60))
    assert [x for t in out for x in t.column("i").to_pylist()] == [0, 1, 2, 20, 30, 31, 32, 33]
    assert all(t.num_rows <= 3 for t in out)


def test_unseen_words_back_off():
    model = {"langs": ["xx", "yy"], "words": {"the": 0}, "grams": {"ab": 0, "zz": 1, "b": 0}, "max_gram": 2,
             "vectors": np.array([[-1, -5], [-5, -1]], np.float32)}
    found = language.Scorer(model)(texts(["the", "zzz", "aab", "", "123 !", "THE zzz zzz"]))
    assert found[0] == ["xx", "yy", "xx", "und", "und", "yy"]
    assert all(0 <= s <= 1 for s in found[1])
