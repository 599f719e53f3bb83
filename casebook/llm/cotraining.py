"""Quality by co-training: a text view and a metadata view teach each other.

The text view sees hashed words and word shapes of the whole text. The
metadata view sees source, language, length and line layout. Both start from
the labelled rows. In each round each view judges all unlabelled rows and
hands the other one the surest ``given`` share of its confident rows of every
source and verdict, so small sources teach too; both are fitted again on the
labelled rows and what they were handed. Each view is calibrated on held-out
labels and their log odds, less the common prior, are added to one score for
every row.

The features of all rows are computed once and written as half-precision
numbers; rounds and scores read them. Only labelled rows are sampled: at most
about ``labelled`` of them, by hashed id. Null text is empty, null metadata is
a value of its own. If one of the two labels is missing among the fitted rows,
every score is the share of good labels (1 without labels). Rows that repeat
get the same score; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from casebook.functions.runtime import cut_lineage, join_on, settle
from casebook.llm.arrays import blocks, coded_words, in_batches, texts_of

WORD_DIMS, SHAPE_DIMS, STATS = 192, 48, 4
SOURCE_DIMS, LANG_DIMS, LAYOUT = 64, 16, 4
LABELLED = 6_000
ROUNDS, GIVEN = 2, 0.05
SURE = 0.9
# Steps of confidence in log odds, and the highest one told apart.
STEPS, HIGHEST = 20, 600
KEEP = 0.5
BLOCK_ROWS = 1_024
CACHED_WORDS = 100_000


class TextView:
    """Feature vectors of whole texts: shares of hashed words and shapes, and repetition."""

    dims = WORD_DIMS + SHAPE_DIMS + STATS

    def __init__(self):
        import regex

        self.known: dict[str, tuple[int, int]] = {}
        upper, lower, digit, mark = (regex.compile(x) for x in (r"\p{Lu}+", r"\p{Ll}+", r"\p{N}+", r"([^Aa0])\1+"))
        self.shape = lambda w: mark.sub(r"\1\1", digit.sub("0", lower.sub("a", upper.sub(lambda m: "A" * min(2, len(m.group())), w))))

    def _places(self, word: str) -> tuple[int, int]:
        return zlib.crc32(word.lower().encode()) % WORD_DIMS, WORD_DIMS + zlib.crc32(self.shape(word).encode()) % SHAPE_DIMS

    def __call__(self, texts: pa.LargeStringArray) -> Iterator[np.ndarray]:
        bounds, codes, distinct = coded_words(texts)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, places = self.known, self._places
        at = np.array([known.get(w) or known.setdefault(w, places(w)) for w in distinct], np.int64).reshape(-1, 2)
        at = at[codes]
        same = np.append(codes[1:] == codes[:-1], False)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            n = b - a
            x = np.bincount(at[a:b].ravel(), minlength=self.dims).astype(np.float32)
            if n:
                x /= n
                x[-4] = same[a : b - 1].sum() / n
                x[-3] = len(np.unique(codes[a:b])) / n
            x[-2] = math.log1p(n) / 10
            x[-1] = 1.0
            yield x


def layout(text: str | None, chars: int | None) -> list[float]:
    """Metadata of a page's layout."""
    lines = (text or "").count("\n") + 1
    n = len(text or "")
    return [math.log1p(chars if chars is not None and chars >= 0 else n) / 12, math.log1p(lines) / 6, math.log1p(n / lines) / 8, 1.0]


def meta_vector(source: str | None, lang: str | None, text: str | None, chars: int | None) -> np.ndarray:
    x = np.zeros(SOURCE_DIMS + LANG_DIMS + LAYOUT, np.float32)
    x[zlib.crc32(repr(source).encode()) % SOURCE_DIMS] = 1
    x[SOURCE_DIMS + zlib.crc32(repr(lang).encode()) % LANG_DIMS] = 1
    x[-LAYOUT:] = layout(text, chars)
    return x


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
        F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
        F.col(chars_col).cast("bigint").alias("chars"),
    )


def features(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``v``, the packed vectors of both views, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = TextView()
        for table in blocks(batches, "text", BLOCK_ROWS):
            meta = zip(*(table.column(c).to_pylist() for c in ("source", "lang", "text", "chars")))
            packed = [
                np.concatenate([a, meta_vector(*m)]).astype(np.float16).tobytes() for a, m in zip(view(texts_of(table.column("text"))), meta)
            ]
            columns = [table.column(c).combine_chunks() for c in ("doc_id", "source")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], names=["doc_id", "source", "v"])

    return in_batches(rows).mapInArrow(run, "doc_id bigint, source string, v binary")


def unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the text view and of the metadata view."""
    v = np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)
    return v[:, : TextView.dims], v[:, TextView.dims :]


def judged(known: DataFrame, weights: dict) -> DataFrame:
    """The rows of ``known`` with the log odds ``la`` and ``lb`` of both views."""
    shared = known.sparkSession.sparkContext.broadcast({v: weights[v] for v in ("a", "b")})
    schema = T.StructType([*known.schema.fields, T.StructField("la", T.DoubleType()), T.StructField("lb", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = zip(unpacked(batch.column("v")), (shared.value[v] for v in ("a", "b")))
                logits = [pa.array(x @ w + c, pa.float64()) for x, (w, c) in parts]
                yield pa.RecordBatch.from_arrays([*batch.columns, *logits], names=[*batch.schema.names, "la", "lb"])

    return known.mapInArrow(run, schema)


def scored(known: DataFrame, weights: dict) -> DataFrame:
    """``doc_id``, log odds of both views and the combined score of every row."""
    a, b = (
        F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(f"l{v}") * float(weights[f"cal_{v}"][0]) + float(weights[f"cal_{v}"][1])))
        for v in ("a", "b")
    )
    rows = judged(known, weights).select("doc_id", a.alias("text_logit"), b.alias("meta_logit"))
    odds = F.col("text_logit") + F.col("meta_logit") - float(weights["prior"])
    return rows.withColumn("score", 1 / (1 + F.exp(-odds)))


def _fit(rows: DataFrame, view: str) -> tuple[np.ndarray, float]:
    """Logistic regression on the rows' vectors; classes weigh alike."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unpacked(batch.column("v"))[0 if view == "a" else 1].astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    vectors = rows.select("label", "v").mapInArrow(run, "label double, x array<double>")
    data = vectors.select("label", array_to_vector("x").alias("features"), weight.alias("weight"))
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=40, standardization=True).fit(data)
    return model.coefficients.toArray(), float(model.intercept)


def surest(pool: DataFrame, logit: str, share: float) -> DataFrame:
    """``label`` and ``v`` of the surest ``share`` of the confident rows of each source and verdict, at least one step.

    Confidence goes in small steps, whose rows are counted; the step at which
    the share is reached is taken whole, so nothing is sorted or ranked by row.
    """
    step = F.least(F.lit(HIGHEST), F.floor(F.abs(logit) * STEPS)).cast("int")
    sure = pool.filter(F.abs(logit) >= math.log(SURE / (1 - SURE))).select(
        "source", (F.col(logit) > 0).cast("double").alias("label"), step.alias("step"), "v"
    )
    counts = sure.groupBy("source", "label", "step").agg(F.count(F.lit(1)).alias("n"))
    down = W.partitionBy("source", "label").orderBy(F.desc("step"))
    reached = counts.withColumn("above", F.sum("n").over(down) - F.col("n")).withColumn(
        "all", F.sum("n").over(W.partitionBy("source", "label"))
    )
    cuts = reached.filter(F.col("above") < F.col("all") * share).groupBy("source", "label").agg(F.min("step").alias("cut"))
    return join_on(sure, settle(cuts), ["source", "label"]).filter("step >= cut").select("label", "v")


def calibrated(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Platt's line: slope and offset of the log odds, by a few Newton steps on held-out labels."""
    slope, offset = 0.1, float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * logits + offset, -30, 30)))
        g = np.array([((p - labels) * logits).sum() + 1e-2 * slope, (p - labels).sum() + 1e-2 * offset])
        v = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(v * logits**2).sum() + 1e-2, (v * logits).sum()], [(v * logits).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - float(np.clip(step[0], -1, 1)), offset - float(np.clip(step[1], -2, 2))
    return max(slope, 0.0), offset


def train(known: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, given: float = GIVEN) -> dict:
    """Weights, calibration and prior, from rows with ``doc_id``, ``source``, ``v`` and ``label`` (null if unlabelled)."""
    marked = known.filter(F.col("label").isNotNull())
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    share = labelled / max(labelled, marked.count())
    sample = cut_lineage(marked.filter(place < int(share * (1 << 30))))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0
    fit, held = sample.filter(~fold), sample.filter(fold)
    counts = {r["label"]: r["n"] for r in fit.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return {"prior": None, "share": 1.0 if not counts or 1.0 in counts else 0.0}
    prior = math.log(counts[1.0] / counts[0.0])
    pool = known.filter(F.col("label").isNull()).select("source", "v")
    own = fit.select("label", "v")
    weights = {v: _fit(own, v) for v in ("a", "b")}
    for _ in range(rounds):
        seen = judged(pool, weights)
        handed = {pupil: cut_lineage(surest(seen, logit, given)) for logit, pupil in (("la", "b"), ("lb", "a"))}
        weights = {v: _fit(own.unionByName(handed[v]), v) for v in ("a", "b")}
    # Bounded by ``labelled``: one number per view and held-out row.
    out = judged(held, weights).select("label", "la", "lb").collect()
    y = np.array([r["label"] for r in out])
    if len(set(y.tolist())) < 2:
        cal = {"cal_a": (1.0, prior), "cal_b": (1.0, prior)}
    else:
        cal = {f"cal_{v}": calibrated(np.array([r[f"l{v}"] for r in out]), y) for v in ("a", "b")}
        prior = math.log(y.mean() / (1 - y.mean()))
    return {**weights, **cal, "prior": prior}


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    lang_col: str = "lang", chars_col: str = "n_chars", **options,
) -> DataFrame:
    """``doc_id``, ``text_logit``, ``meta_logit``, ``score`` (0 to 1) and ``kept`` for every row."""
    rows = _rows(docs, id_col, text_col, source_col, lang_col, chars_col)
    marks = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("label").cast("double")).alias("label")
    )
    known = cut_lineage(features(rows).join(marks, "doc_id", "left"))
    model = train(known, **options)
    if model["prior"] is None:
        out = known.select(
            "doc_id", F.lit(0.0).alias("text_logit"), F.lit(0.0).alias("meta_logit"), F.lit(model["share"]).alias("score")
        )
    else:
        out = scored(known, model)
    return out.withColumn("kept", F.col("score") >= KEEP)
