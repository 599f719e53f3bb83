"""Texts that hold a token which the tokenizer has besides its vocabulary."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from casebook.llm import packing, queries

TEXTS = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b\n \n<|endoftext|> ", "plain words", "<|endoftext", None]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    made = tmp_path_factory.mktemp("added")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(f"{made}/documents.parquet")
    return str(made)


def test_ids_equal_the_tokenizer_at_its_defaults(reference):
    path = queries.tokenizer_file()
    made = packing.Tokens(packing.byte_bpe(*queries.vocabulary()), packing.by_tokenizer(path), packing.added_tokens(path))
    values = [t or "" for t in TEXTS]
    bounds, ids, _ = made(pa.array(values, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [reference.encode(t, add_special_tokens=False).ids for t in values]
    assert 50256 in ids


def test_query(spark, folder, reference):
    for r in queries.op7_lexical_packing(spark, folder).collect():
        own = np.array(reference.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids + [1], "<u4")
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())


def test_pack_stage(spark, folder, reference):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = {r["doc_id"]: r["doc_tokens"] for r in corpus_pipeline.pack_sequences(spark, docs, folder).collect()}
    assert sizes == {i: len(reference.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(TEXTS)}
