"""Queries of the operators in this folder, each over its whole table, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from casebook.functions.runtime import table
from casebook.llm import (
    collocations, cotraining, language, licences, line_dedup, minhash, mixing, nearest, oracles, packing, personal, quality_rules, runs,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(oracles.SQL)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> tuple[str, str]:
    """Ranks file and pattern of the public byte-level vocabulary of 50 k ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tokenizer_file() -> str:
    """The tokenizer of this vocabulary, with its added tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(table(spark, folder, "documents"))
    base = F.filter("matches", lambda m: m["is_base"])
    starts = F.transform(base, lambda m: m["first_word"])

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")

    spans = F.transform(
        F.filter("matches", lambda m: ~m["is_base"]),
        lambda m: F.concat_ws(":", m["label"], m["start"].cast("string"), m["end"].cast("string"), m["edits"].cast("string")),
    )
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels("matches").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
        F.array_join(F.array_sort(spans), ",").alias("notice_spans"),
    )


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.judged(table(spark, folder, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("passed")).alias("kept"),
    )


@query
def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.find(table(spark, folder, "documents"))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(personal.KINDS) for x in (k, i)])

    def joined(of):
        ordered = F.array_sort(F.transform(of, lambda s: F.struct(F.element_at(order, s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in personal.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query
def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mix(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


@query
def op5_cotrained_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return cotraining.quality(table(spark, folder, "documents"), labels)


@query
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_deleted", F.coalesce("text", F.lit("")).alias("text"))


@query
def op7_lexical_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), *vocabulary(), tokenizer_path=tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.learn(language.labelled_sample(docs.filter(F.coalesce(~held_out, F.lit(True))), "text", "lang", "doc_id"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query
def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(table(spark, folder, "embeddings"), queries=F.col("vec_id") % 20 == 0)


@query
def op11_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def bound(value, body):
        """``body`` of a value that is computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def repeated(words):
        n = F.size(words)
        place = bound(F.struct((g % n).cast("int").alias("a"), n.alias("n")), lambda x: F.struct(
            x["a"].alias("a"), (1 + F.floor((x["n"] - x["a"]) / (3 + g % 8))).cast("int").alias("p")
        ))
        return bound(F.struct(words.alias("w"), place.alias("at")), lambda x: F.array_join(F.transform(x["w"], lambda word, i: F.when(
            i < x["at"]["a"], word
        ).otherwise(F.get(x["w"], x["at"]["a"] + (i - x["at"]["a"]) % x["at"]["p"]))), " "))

    # A tenth of the documents becomes periodic from some word on.
    periodic = (h % 10 == 0) & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    planted = bound(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), repeated)
    found = runs.find_runs(docs.withColumn("text", F.when(periodic, planted).otherwise(F.col("text"))), keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = toxicity.toxicity(docs, labels, ~held_out)
    return found.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
