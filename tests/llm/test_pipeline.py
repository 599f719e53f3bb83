"""Registered pipeline queries and the stages of the corpus pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from casebook.llm import line_dedup, queries
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, corpus
from tools.check import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, FOLDER, queries.QUERIES[name], queries.SQL[name])[1] == "ok"


def test_registered():
    names = set(entry.queries())
    assert {q for q in names if q.startswith("op")} == set(queries.QUERIES) and len(queries.QUERIES) == 13
    assert "pipeline" in names and set(queries.SQL) <= set(entry.oracle_sql())


def test_licence_query(spark, documents):
    from casebook.llm.licences import BASE

    for r in queries.op1_licence_scan(spark, FOLDER).collect():
        n, starts, labels = brute.licence_base(documents[r["doc_id"]]["text"], BASE)
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(starts), labels)
        assert (r["first_word"], r["last_word"]) == ((starts[0], starts[-1]) if starts else (None, None))
        assert set(filter(None, labels.split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_personal_query(spark, documents):
    import hashlib

    for r in queries.op3_personal_data(spark, FOLDER).collect():
        spans = brute.personal(documents[r["doc_id"]]["text"])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_packing_query(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4") for k, r in documents.items()}
    total = 0
    for r in queries.op7_lexical_packing(spark, FOLDER).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        total += r["length"]
    assert total == sum(map(len, ids.values()))


def test_language_query(spark, documents):
    rows = queries.op8_language(spark, FOLDER).collect()
    assert len(rows) == len(documents)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.97


def test_cotrained_query(spark, documents):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries.op5_cotrained_quality(spark, FOLDER).collect()
    assert len(rows) == len(documents)
    assert np.mean([r["kept"] == bool(labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]) > 0.9


def test_nearest_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    ids, matrix = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = {}
    for r in queries.op10_nearest(spark, FOLDER).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        scores = matrix @ matrix[ids == q][0]
        want = [i for _, i in sorted(zip(-scores, ids.tolist())) if i != q][:20]
        hits += len(got & set(want))
    assert hits >= 0.9 * 20 * len(found)


@pytest.fixture(scope="module")
def staged(spark):
    """Input and output of every stage on a small corpus with odd rows and extra columns."""
    rows = [(i, t, {"xx": "en", "yy": "fr"}.get(x), s, n, "k", "w", 7, 8, 9) for i, t, x, s, n in corpus(3, 150)]
    docs, out = spark.createDataFrame(rows, SCHEMA), []
    for name, stage in corpus_pipeline.STAGES:
        made = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs, FOLDER).schema)
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_keep_the_columns(staged):
    assert [name for name, *_ in staged] == ["language", "lines", "near_duplicates", "mix", "pack"]
    for _, before, after in staged[:-1]:
        assert after.columns == before.columns


def test_language_stage(staged):
    _, before, after = staged[0]
    gone = {r["doc_id"]: r["text"] for r in before.join(after, "doc_id", "left_anti").collect()}
    assert all(not any(c.isalpha() for c in t or "") for t in gone.values()) and gone
    assert after.filter(F.coalesce(F.col("text"), F.lit("")).rlike("[a-z]{3}")).count() == before.filter(F.col("text").rlike("[a-z]{3}")).count()


def test_line_stage(staged):
    _, before, after = staged[1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    gone = brute.deleted_lines(rows, line_dedup.MIN_LINES, line_dedup.MIN_WORDS)
    want = {}
    for i, t in rows:
        text = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        if not gone[i] or text.strip(line_dedup.BLANKS):
            want[i] = text
    got = {r["doc_id"]: r for r in after.collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for i, r in got.items() if gone[i])


def test_near_duplicate_stage(staged):
    _, before, after = staged[2]
    found = brute.components([(r["doc_id"], r["text"]) for r in before.collect()], size=5)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, c in found.values()})


def test_mix_stage(staged):
    _, before, after = staged[3]
    size = {r["doc_id"]: len(brute.BLANK_WORDS.findall(r["text"] or "")) for r in before.collect()}
    totals, largest = {}, {}
    for r in before.collect():
        totals[r["source"]] = totals.get(r["source"], 0) + size[r["doc_id"]]
        largest[r["source"]] = max(largest.get(r["source"], 0), size[r["doc_id"]])
    taken = dict.fromkeys(totals, 0)
    for r in after.collect():
        taken[r["source"]] += size[r["doc_id"]]
    for source, target in brute.targets(totals).items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1


def test_pack_stage(staged):
    _, before, after = staged[4]
    packed = {}
    for r in after.collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    copies = {r["doc_id"]: r["count"] for r in before.groupBy("doc_id").count().collect()}
    tokens = {r["doc_id"]: r["doc_tokens"] for r in after.select("doc_id", "doc_tokens").distinct().collect()}
    assert packed == {i: n * tokens[i] for i, n in copies.items()}


def test_run_goes_through_all_stages(spark):
    out = entry.queries()["pipeline"](spark, FOLDER)
    assert out.count() > 0 and {"doc_id", "ids", "sequence_id"} <= set(out.columns)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
