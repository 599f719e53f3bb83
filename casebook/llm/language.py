"""Word-first backoff: language by word frequencies, by character n-grams for unseen words.

A word that a language model knows is scored by its log frequency in each
language. An unseen word backs off to its character n-grams, longest first:
at each place the longest known n-gram counts.

Null text and text without a letter have the language ``und`` and score 0.
Rows without text or language are not learned from. Ties go to the language
that comes first in order. Without labelled rows every prediction is ``und``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from casebook.llm.arrays import blocks, coded_words, in_batches, texts_of

UNKNOWN = "und"
ROWS_PER_LANGUAGE = 2_000
WORDS_PER_LANGUAGE = 20_000
GRAMS_PER_LANGUAGE = 6_000
MAX_GRAM = 4
FLOOR = 0.5
CACHED_WORDS = 100_000
BLOCK_ROWS = 1_024


def labelled_sample(
    docs: DataFrame, text_col: str, lang_col: str, id_col: str, rows: int = ROWS_PER_LANGUAGE
) -> DataFrame:
    """About ``rows`` labelled texts of each language, chosen by hashed id, the same ones every time."""
    keyed = docs.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"),
        F.col(text_col).alias("text"),
        # Uniform in [0, 1)
        (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(8)), F.lit(1 << 30)) / float(1 << 30)).alias("place"),
    )
    shares = {r["lang"]: rows / r["n"] for r in keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return keyed.select("lang", "text").limit(0)
    # One literal per language: a filter of the scan, no sort and no join with texts.
    share = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])
    return keyed.filter((F.col("place") < F.element_at(share, F.col("lang"))) & F.col("text").isNotNull()).select("lang", "text")


def learn(
    sample: DataFrame,
    words: int = WORDS_PER_LANGUAGE,
    grams: int = GRAMS_PER_LANGUAGE,
    max_gram: int = MAX_GRAM,
) -> dict:
    """Counts of the most frequent words and n-grams of each language, as one small model.

    ``sample`` has ``lang`` and ``text``. What comes to the driver is bounded
    by ``words`` and ``grams`` times ``max_gram`` entries per language.
    """
    found = sample.select(
        "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("item")
    )
    counted = found.groupBy("lang", "item").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit(" "), "item", F.lit(" "))

    def pieces_of(k: int):
        cut = F.transform(F.sequence(F.lit(1), F.length("item") + 3 - k), lambda i: F.substring(padded, i, F.lit(k)))
        return F.when(F.length("item") + 2 >= k, cut).otherwise(F.array())

    pieces = [pieces_of(k) for k in range(1, max_gram + 1)]
    gram = (
        counted.select("lang", "n", F.explode(F.concat(*pieces)).alias("item"))
        .groupBy("lang", "item").agg(F.sum("n").alias("n"))
        .select("lang", F.length("item").alias("size"), "item", "n")
    )
    both = counted.select("lang", F.lit(0).alias("size"), "item", "n").unionByName(gram)
    order = W.partitionBy("lang", "size").orderBy(F.desc("n"), "item")
    # A row per language and size, summed in parts before it is gathered.
    totals = both.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    kept = (
        both.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= F.when(F.col("size") == 0, words).otherwise(grams))
        .join(totals, ["lang", "size"])
        .select("lang", "size", "item", "n", "total")
    )
    rows = kept.collect()
    langs = sorted({r["lang"] for r in rows})
    place = {x: i for i, x in enumerate(langs)}
    totals: dict[int, np.ndarray] = {}
    counts: dict[int, dict[str, dict[int, int]]] = {}
    for r in rows:
        totals.setdefault(r["size"], np.ones(len(langs)))[place[r["lang"]]] = r["total"]
        counts.setdefault(r["size"], {}).setdefault(r["item"], {})[place[r["lang"]]] = r["n"]
    known, grams_known, vectors = {}, {}, []
    for size, items in counts.items():
        floor = np.log(FLOOR / (totals[size] + 1))
        table = grams_known if size else known
        for item, seen in items.items():
            vector = floor.copy()
            for lang, n in seen.items():
                vector[lang] = math.log(n / totals[size][lang])
            table[item] = len(vectors)
            vectors.append(vector)
    return {
        "langs": langs, "words": known, "grams": grams_known, "max_gram": max([s for s in counts if s], default=0),
        "vectors": np.array(vectors, np.float32).reshape(-1, max(1, len(langs))),
    }


class Scorer:
    """Log likelihoods of blank-separated chunks under a model; chunks seen before are kept, up to a bound."""

    def __init__(self, model: dict):
        import regex

        self.model, self.k = model, max(1, len(model["langs"]))
        self.letters = regex.compile(r"\p{L}+").findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.vectors = np.zeros((0, self.k), np.float32)
        self.runs = np.zeros(0, np.int64)

    def _grams(self, word: str) -> list[int]:
        """Rows of the longest known n-gram that ends at each place."""
        grams, longest, text, out = self.model["grams"], self.model["max_gram"], f" {word} ", []
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - longest), end):
                at = grams.get(text[start:end])
                if at is not None:
                    out.append(at)
                    break
        return out

    def _add(self, chunks: list[str]) -> None:
        words, rows, weights, sizes, runs = self.model["words"], [], [], [], []
        for chunk in chunks:
            before, found = len(rows), self.letters(chunk)
            for run in found:
                run = run.lower()
                at = words.get(run)
                if at is not None:
                    rows.append(at)
                    weights.append(1.0)
                elif grams := self._grams(run):
                    # One word weighs as one word, however many n-grams it has.
                    rows += grams
                    weights += [2.0 / len(grams)] * len(grams)
            sizes.append(len(rows) - before)
            runs.append(len(found))
        sums = np.zeros((len(rows) + 1, self.k))
        if rows:
            np.cumsum(self.model["vectors"][rows] * np.array(weights)[:, None], axis=0, out=sums[1:])
        ends = np.cumsum(sizes)
        self.known.update(zip(chunks, range(len(self.runs), len(self.runs) + len(chunks))))
        self.vectors = np.concatenate([self.vectors, (sums[ends] - sums[ends - sizes]).astype(np.float32)])
        self.runs = np.concatenate([self.runs, np.array(runs, np.int64)])

    def __call__(self, texts: pa.LargeStringArray) -> tuple[list[str], list[float]]:
        bounds, codes, distinct = coded_words(texts)
        if len(self.known) > CACHED_WORDS:
            self._forget()
        known = self.known
        if new := [w for w in distinct if w not in known]:
            self._add(new)
        rows = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[codes]
        out_lang, out_score = [], []
        langs = self.model["langs"]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = rows[a:b]
            n = int(self.runs[own].sum())
            if not n or not langs:
                out_lang.append(UNKNOWN)
                out_score.append(0.0)
                continue
            mean = self.vectors[own].sum(axis=0, dtype=np.float64) / n
            best = int(mean.argmax())
            out_lang.append(langs[best])
            # Evidence of a few words counts in full, that of more words no further.
            out_score.append(float(1 / np.exp((mean - mean[best]) * min(n, 20)).sum()))
        return out_lang, out_score


def identify(
    docs: DataFrame, model: dict, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score"
) -> DataFrame:
    """All rows and columns of ``docs`` with the predicted language and its score (0 to 1)."""
    clash = {lang_out, score_out} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for table in blocks(batches, text_col, BLOCK_ROWS):
            scorer = scorer or Scorer(shared.value)
            langs, scores = scorer(texts_of(table.column(text_col)))
            langs = pc.if_else(pc.is_null(table.column(text_col)), UNKNOWN, pa.array(langs, pa.string()))
            table = table.append_column(lang_out, langs)
            table = table.append_column(score_out, pa.array(scores, pa.float64()))
            yield from table.to_batches()

    return in_batches(docs).mapInArrow(run, schema)
