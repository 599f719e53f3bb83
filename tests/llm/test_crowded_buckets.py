"""Links in buckets that are crowded with texts which are not linked."""

import pytest

from casebook.llm import minhash
from tests.llm import brute


def pages(n, pairs):
    """Pages of one template, mutually just below the limit; some have a near copy."""
    core = [f"c{i}" for i in range(86)]
    out = [(i, " ".join(core + [f"p{i}x{k}" for k in range(13)])) for i in range(n)]
    for j in range(pairs):
        i = (j * 31) % n
        out.append((n + j, " ".join(core + [f"p{i}x{k}" for k in range(3)] + [f"q{j}x{k}" for k in range(10)])))
    return out


@pytest.fixture(scope="module")
def crowded(spark):
    rows = pages(300, 60)
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string")


def test_links_in_crowded_buckets_are_found(crowded):
    rows, frame = crowded
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame).collect()}
    want = brute.components(rows)
    assert sum(c != i for i, (_, c) in want.items()) == 60
    assert got == want


def test_no_link_depends_on_the_number_of_rounds(crowded, monkeypatch):
    rows, frame = crowded
    monkeypatch.setattr(minhash, "MAX_ROUNDS", 1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame).collect()}
    assert got == brute.components(rows)


def test_rare_shingles_meet_all_pairs_and_few_others(crowded):
    rows, frame = crowded
    sets = minhash.shingle_sets(frame)
    texts = minhash.sketches(frame, "doc_id", "text").selectExpr("doc_id", "n_shingles AS n", "doc_id AS component")
    met = {(r["a"], r["b"]) for r in minhash.rare_edges(texts, sets).collect()}
    want = {((j * 31) % 300, 300 + j) for j in range(60)}
    assert want <= met and len(met) < 2 * len(want)
    assert minhash.rare_edges(texts.withColumn("component", texts["doc_id"] * 0), sets).isEmpty()
