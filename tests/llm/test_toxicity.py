"""Toxicity: held-out accuracy, repeatable scores, features on their own, odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casebook.llm import queries, toxicity
from casebook.llm.tokens import hashes, longer
from tests.llm.test_operators import SCHEMA


def texts(seed=2, n=1500):
    """Some texts hold a bad word, some a bad pair of harmless words, some that pair the other way round."""
    rnd = random.Random(seed)
    vocab = [a + b + c for a in "klmnprst" for b in "aeiou" for c in "xyz"]
    out = []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(5, 80))]
        kind = rnd.random()
        if kind < 0.15:
            words[rnd.randrange(len(words))] = rnd.choice(["Vile!", "GRUBBY", "röten"])
        elif kind < 0.3:
            words[rnd.randrange(len(words)) : 0] = rnd.choice([["get", "lost"], ["get", rnd.choice(vocab), "lost"]])
        elif kind < 0.45:
            words[rnd.randrange(len(words)) : 0] = ["lost", rnd.choice(vocab), "and", rnd.choice(vocab), "get"]
        out.append((i, " ".join(words), int(kind < 0.3)))
    return out


def test_features_are_words_pairs_and_skips():
    got = toxicity.features(pa.array(["A b, a b", "", "a", "x b a"], pa.large_string()))
    h = dict(zip("abx", hashes(["a", "b", "x"])))
    place = lambda v: int(v >> np.uint64(64 - toxicity.BITS))
    one = lambda w: place(longer(np.zeros(1, np.uint64), h[w])[0])
    two = lambda v, w, gap: place(longer(np.array([h[v] + np.uint64(gap)]), h[w])[0])
    want = [{one("a"), one("b"), two("a", "b", 1), two("b", "a", 1), two("a", "a", 2), two("b", "b", 2), two("a", "b", 3)}, set(), {one("a")},
            {one("x"), one("b"), one("a"), two("x", "b", 1), two("b", "a", 1), two("x", "a", 2)}]
    assert [set(got[1][got[0] == i].tolist()) for i in range(4)] == want


def test_held_out_accuracy_and_repeatability(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (4, None)], "doc_id long, label int")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(7), labels.repartition(3), train).collect()}
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.coalesce(1), labels, train).collect()}
    assert got == again
    held = [(got[i] >= 0.5) == y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 200 and np.mean(held) >= 0.93


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = texts(n=300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    scores = []
    for turn in (lambda i, y: y, lambda i, y: 1 - y if held(i) else y):
        labels = spark.createDataFrame([(i, turn(i, y)) for i, _, y in rows], "doc_id long, label int")
        scores.append({r.doc_id: r.score for r in toxicity.toxicity(docs, labels, train).collect()})
    assert scores[0] == scores[1]


def test_weights_are_sparse(spark):
    rows = spark.createDataFrame([(t, y, i) for i, t, y in texts()], "text string, label int, place long")
    places, weights = toxicity.learn(rows)
    _, seen = toxicity.features(pa.array([t for _, t, _ in texts()], pa.large_string()))
    assert 0 < len(places) < 0.06 * len(np.unique(seen)) and (weights != 0).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "xx"), (2, "", None), (3, " .,! ", "yy"), (None, "word " * 40_000, "zz"), (1, None, "xx")], "doc_id long, text string, place string"
    ).withColumn("weight", F.lit(3))
    model = (np.array([toxicity.INTERCEPT]), np.array([-1.0]))
    got = toxicity.score(docs, model)
    assert got.columns == [*docs.columns, "score"]
    assert [round(r.score, 6) for r in got.collect()] == [0.268941] * 5
    nothing = spark.createDataFrame([], SCHEMA)
    no_labels = spark.createDataFrame([], "doc_id long, label int")
    assert toxicity.toxicity(nothing, no_labels, F.lit(True)).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, no_labels, F.lit(True)).collect()} == {0.0}
    with pytest.raises(ValueError):
        toxicity.score(got, model)


def test_query_covers_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op12_toxicity(spark, folder).collect()
    assert {r.doc_id for r in got} == docs and len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
