"""A corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on what the stage before it
kept; all but the last return the columns of ``documents``. ``run`` writes
each stage to the shared folder and goes on from the written copy, so a lost
executor never costs more than one stage.

1. language: documents without a recognisable language go.
2. lines: runs of lines that occur earlier are cut out; a document of which
   nothing with a word is left goes. ``n_chars`` follows the text.
3. near duplicates: one document of each group stays.
4. mix: documents come as often as their source's target asks for.
5. pack: token pieces of training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casebook.functions.runtime import cut_lineage, table
from casebook.llm import language, line_dedup, minhash, mixing, packing
from casebook.llm.queries import tokenizer_file, vocabulary

MIN_LANGUAGE_SCORE = 0.4
# Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones teach, if the score is sure enough."""
    model = language.learn(language.labelled_sample(docs, "text", "lang", "doc_id"))
    found = language.identify(docs, model, lang_out="__lang", score_out="__score")
    return found.filter((F.col("__lang") != language.UNKNOWN) & (F.col("__score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines."""
    cut = line_dedup.dedup_lines(docs)
    left = (F.col("n_deleted") == 0) | (F.length(F.btrim("text", F.lit(line_dedup.BLANKS))) > 0)
    chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.filter(left).withColumn("n_chars", chars).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of each group with the least id."""
    kept = minhash.near_duplicates(docs, shingle=SHINGLE).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources come near their targets."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their ids."""
    return packing.pack(docs, *vocabulary(), tokenizer_path=tokenizer_file())


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", dedup_near),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]
# Language scores, MinHash buckets and tokens have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
