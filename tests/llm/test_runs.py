"""Periodic runs: the operator and the query against brute force, the extensions on their own."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.llm import queries, runs
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, corpus


def texts(seed=3, n=150):
    """Periodic, nested, Fibonacci and random texts over few words."""
    rnd = random.Random(seed)
    out = [None, "", " \n ", "a", "a " * 11, "a " * 12, "a b " * 6, "x " + "a b " * 6 + "a y", "a " * 5000]
    fib = ["a", "a b"]
    while len(fib[-1]) < 400:
        fib.append(f"{fib[-1]} {fib[-2]}")
    out.append(fib[-1])
    for _ in range(n):
        vocab = "abcdefgh"[: rnd.randint(1, 8)]
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 90))]
        for _ in range(rnd.randint(0, 3)):
            base = words[-rnd.randint(1, len(words)) :]
            words += (base * rnd.randint(1, 5))[: rnd.randint(1, 200)]
            words += [rnd.choice(vocab) for _ in range(rnd.randint(0, 6))]
        out.append(rnd.choice([" ", "\t", " \n"]).join(words))
    return out


def test_cover_reaches_every_pair():
    assert runs.SHIFTS.min() == 0 and runs.SHIFTS.max() < runs.MODULUS


@pytest.mark.parametrize("seed", range(4))
def test_extensions_equal_plain_comparison(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randint(1, 200) for _ in range(4)]
    pad = [-1] * runs.MODULUS
    words, ends, pairs = list(pad), list(range(runs.MODULUS)), []
    for size in sizes:
        base, start = [rnd.randrange(3) for _ in range(rnd.randint(1, 60))], len(words)
        words += (base * size)[:size] + pad
        ends += [start + size] * size + list(range(start + size, start + size + runs.MODULUS))
        pairs += [sorted(rnd.sample(range(start, start + size), 2)) for _ in range(200) if size > 1]
    pairs = np.array(pairs)
    got = runs.Extensions(np.array(words), np.array(ends))(pairs[:, 0], pairs[:, 1])
    for (i, j), n in zip(pairs.tolist(), got.tolist()):
        want = 0
        while j + want < ends[j] and words[i + want] == words[j + want]:
            want += 1
        assert n == want


@pytest.mark.parametrize("points", [runs.POINTS, 50])
def test_runs_equal_brute_force(spark, monkeypatch, points):
    monkeypatch.setattr(runs, "POINTS", points)
    rows = [(i, t, 7, "z") for i, t in enumerate(texts())] + [(3, "a b c " * 9, 7, "z")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, words string").repartition(3)
    got = runs.find_runs(docs).collect()
    assert len(got) == len(rows) and got[0].start == 7
    for r in got:
        words = brute.BLANK_WORDS.findall(r.text or "")
        want = brute.word_runs(words)
        assert [tuple(x) for x in r.runs] == want, r.text
        assert r.collapsed == brute.collapsed(words, want)


def test_empty_table_and_clash(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert runs.find_runs(empty).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(empty.withColumn("runs", F.lit(1)))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_brute_force(spark, tmp_path):
    rows = corpus(n=200) + [(None, "a b " * 20, None, None, 1)]
    spark.createDataFrame([(*r[:5],) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_word_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    changed = 0
    for doc_id, text, *_ in rows:
        words = brute.BLANK_WORDS.findall(text or "")
        n = len(words)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        if n > 5000:
            assert (got[doc_id].n_runs, got[doc_id].length, got[doc_id].period) == (1, n, 1)
            continue
        found = brute.word_runs(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        want = (len(found), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4))
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == digest("".join(f"{s},{m},{p}\n" for s, m, p in found))
        assert r.collapsed_sha256 == digest(brute.collapsed(words, found))
    assert changed > 5
