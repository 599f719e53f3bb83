"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and bytes beyond ASCII, lower-cased in A-Z.
Features are the words, pairs of neighbours, and pairs with one or two words
between them, each hashed to one of ``2 ** BITS`` places; a feature counts
once a text, however often it occurs. Every place has its own learning rate,
and the L1 term keeps all but the telling ones at zero, so the learned weights
are a short list that every task gets.

Weights are learned in a random but repeatable order from a sample of at most
about ``SAMPLE_ROWS`` labelled texts, which one task passes over ``EPOCHS``
times. Rows without a label are not learned from; a null text is empty. Texts
without words get the score of the intercept. Without labelled rows every
score is 0. Repeated rows count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from casebook.functions.runtime import cut_lineage, settle
from casebook.llm.arrays import blocks, in_batches, texts_of
from casebook.llm.tokens import Words, byte_kinds, hashes, longer

BITS = 20
SKIPS = (0, 1, 2)
SAMPLE_ROWS = 20_000
EPOCHS = 4
# In texts of hundreds of words only a strong L1 with fast rates keeps chance words at zero.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.1
BLOCK_ROWS = 8_192
# All ASCII characters but digits and letters part words.
KINDS = byte_kinds(other="".join(chr(c) for c in range(128) if not chr(c).isalnum()))
INTERCEPT = 1 << BITS


def features(texts: pa.LargeStringArray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every feature, each once a text; with ``wanted`` only of places marked there."""
    words = Words(texts, KINDS)
    word = hashes(words.vocabulary.to_pylist())[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    shift = np.uint64(64 - BITS)
    found = [(words.text, longer(np.zeros_like(word), word))]
    for skip in SKIPS:
        pair = words.text[: -skip - 1] == words.text[skip + 1 :]
        found.append((words.text[: -skip - 1][pair], longer(word[: -skip - 1] + np.uint64(skip + 1), word[skip + 1 :])[pair]))
    keys = []
    for text, h in found:
        place = (h >> shift).astype(np.int64)
        if wanted is not None:
            marked = wanted[place]
            text, place = text[marked], place[marked]
        keys.append((text.astype(np.int64) << BITS) | place)
    distinct = np.unique(np.concatenate(keys))
    return distinct >> BITS, distinct & (INTERCEPT - 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label, place): about ``rows`` labelled texts, by hashed id, the same ones every time.

    ``labels`` has the id and ``label``. Its sample is small enough to be
    broadcast, so that texts are not shuffled to be drawn.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col("label").cast("int").alias("label")).dropna()
    place = F.xxhash64(F.col("_id").cast("string"), F.lit(12))
    share = rows / max(rows, known.count())
    drawn = settle(known.filter(F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30))), 2 * rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return texts.join(drawn, "_id").select("text", "label", place.alias("place"))


class Learner:
    """FTRL-proximal with per-coordinate rates."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(INTERCEPT + 1), np.zeros(INTERCEPT + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        # The intercept is not held at zero.
        l1 = np.where(at == INTERCEPT, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > l1, w, 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, n = self.weights(at), self.n[at]
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def learn(sample: DataFrame, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) other than zero, learned from ``sample`` (text, label, place)."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "text", BLOCK_ROWS):
            text, place = features(texts_of(table.column("text")))
            bounds = np.searchsorted(text, np.arange(table.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place, pa.int32()))
            yield from pa.table([table.column("place"), table.column("label"), lists], names=["place", "label", "at"]).to_batches(max_chunksize=512)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            lists = batch.column("at")
            for i, label in enumerate(batch.column("label").to_pylist()):
                rows.append((np.append(lists[i].values.to_numpy(), INTERCEPT), label))
        learner = Learner()
        for _ in range(epochs):
            for at, label in rows:
                learner.learn(at, label)
        used = np.flatnonzero(learner.n > 0)
        weights = learner.weights(used)
        real = weights != 0
        yield pa.record_batch([pa.array(used[real], pa.int64()), pa.array(weights[real])], names=["at", "weight"])

    rows = cut_lineage(in_batches(sample).mapInArrow(featured, "place bigint, label int, at array<int>"))
    # One task passes over the bounded sample, in hashed order.
    ordered = rows.repartition(1).sortWithinPartitions("place", "label", F.xxhash64("at"))
    found = ordered.mapInArrow(trained, "at bigint, weight double").collect()
    return np.array([r["at"] for r in found], np.int64), np.array([r["weight"] for r in found])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the probability of the label."""
    if out in docs.columns:
        raise ValueError(f"column exists already: {out}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values = shared.value
        weight = np.zeros(INTERCEPT + 1)
        weight[places] = values
        for table in blocks(batches, text_col, BLOCK_ROWS):
            text, place = features(texts_of(table.column(text_col)), weight != 0)
            sums = weight[INTERCEPT] + np.bincount(text, weight[place], table.num_rows)
            scores = 1 / (1 + np.exp(-sums)) if len(places) else np.zeros(table.num_rows)
            yield from table.append_column(out, pa.array(scores)).to_batches()

    return in_batches(docs).mapInArrow(run, schema)


def toxicity(
    docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep`` and ``score`` of every row of ``docs``; labels of rows that fulfil ``train`` are learned from."""
    sample = labelled_sample(docs, labels.filter(train), id_col, text_col)
    found = score(docs.select(*dict.fromkeys([*keep, text_col])), learn(sample), text_col)
    return found.select(*keep, "score")
