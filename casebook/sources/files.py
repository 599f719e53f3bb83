"""Folders of record files: scans that keep provenance, and partitioned sinks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from casebook.functions.ranking import numbered
from casebook.operators.sampling import label_codes
from casebook.sources.encodings import Sniffer

SHEET_ROWS = 1_048_570
CSV = {"header": "true", "escape": '"', "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def scan_folder(
    spark: SparkSession, path: str, schema: T.StructType | str, glob: str | None = None, multi_line: bool = True
) -> DataFrame:
    """All CSV files of a folder as one table; names starting with ``.`` or ``_`` are skipped.

    Quoted line ends need whole files; without them (``multi_line=False``) large files are split over tasks.
    """
    reader = spark.read.schema(schema).options(**CSV).option("multiLine", multi_line)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.csv(path)


def scan_months(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Rows of the months ``yyyyMM`` from first to last; other months are not read."""
    y, m = F.col("year"), F.col("month")
    after = (y > int(first[:4])) | ((y == int(first[:4])) & (m >= int(first[4:])))
    before = (y < int(last[:4])) | ((y == int(last[:4])) & (m <= int(last[4:])))
    return spark.read.parquet(path).filter(after & before)


def with_file_name(df: DataFrame, name: str = "file") -> DataFrame:
    return df.withColumn(name, F.col("_metadata.file_name"))


def keys_from_file_name(df: DataFrame, pattern: str, names: Sequence[str]) -> DataFrame:
    """Columns from the groups of a pattern on the file name; null where it does not fit."""
    for i, n in enumerate(names, 1):
        df = df.withColumn(n, F.nullif(F.regexp_extract("_metadata.file_name", pattern, i), F.lit("")))
    return df


def drop_files(df: DataFrame, pattern: str) -> DataFrame:
    """Leave out the files whose name fits the pattern."""
    return df.filter(~F.col("_metadata.file_name").rlike(pattern))


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, text, encoding) per file, in UTF-8, UTF-16, GBK, GB18030, Big5 or Latin-1.

    Valid UTF-8 without zero bytes is decided and decoded by built-ins; only
    the other files reach Python, where ``encodings`` sniffs what they are in.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    raw = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    plain = F.when(~F.contains(text, F.lit("\0")) & ~F.startswith(text, F.lit("\ufeff")), text)
    # One pass: valid files send an empty cell to Python.
    marked = raw.withColumn("_plain", plain).withColumn("_d", _decode(F.when(F.col("_plain").isNull(), F.col("content"))))
    return marked.select(
        "file", F.coalesce("_plain", "_d.text").alias("text"),
        F.when(F.col("_plain").isNotNull(), "utf-8").otherwise(F.col("_d.encoding")).alias("encoding"),
    )


_DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())])


@F.pandas_udf(_DECODED)
def _decode(content: pd.Series) -> pd.DataFrame:
    sniff = Sniffer()

    def one(b: bytes | None) -> tuple[str | None, str | None]:
        return (None, None) if b is None else sniff(b)

    return pd.DataFrame([one(b) for b in content], columns=["text", "encoding"])


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a folder of CSV files; each file has one header."""
    df.write.mode("append").options(**CSV).csv(path)


def write_months(df: DataFrame, when: str, path: str, mode: str = "overwrite") -> None:
    """One folder per year and month; the time column stays in the files.

    The rebalance hint gathers small months and splits large ones, so that
    neither many tiny files nor one huge task results.
    """
    dated = df.withColumn("year", F.year(when)).withColumn("month", F.month(when))
    dated.hint("rebalance", "year", "month").write.mode(mode).partitionBy("year", "month").parquet(path)


def rewrite_months(df: DataFrame, when: str, path: str, cutoff: str) -> None:
    """Sort rows into the month of ``when`` and leave out months before ``cutoff`` (yyyyMM)."""
    dated = df.withColumn("ym", F.date_format(when, "yyyyMM")).filter(F.col("ym") >= cutoff)
    dated.hint("rebalance", "ym").write.mode("overwrite").partitionBy("ym").parquet(path)


def write_capped(df: DataFrame, path: str, rows: int = SHEET_ROWS) -> None:
    """At most ``rows`` rows per file."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).options(**CSV).csv(path)


def sheet_number(df: DataFrame, order: Sequence[str], rows: int = SHEET_ROWS, name: str = "sheet") -> DataFrame:
    """The 0-based sheet each row falls on when sheets are filled in ``order``."""
    out = numbered(df, order, "_rn")
    return out.withColumn(name, F.floor((F.col("_rn") - 1) / rows).cast("bigint")).drop("_rn")


def write_by_category(df: DataFrame, category: str, path: str) -> None:
    df.hint("rebalance", category).write.mode("overwrite").partitionBy(category).parquet(path)


def write_both(df: DataFrame, test: Column, kept_path: str, rejected_path: str) -> None:
    """Two outputs of one test; a null test is a rejection."""
    ok = F.coalesce(test, F.lit(False))
    df.filter(ok).write.mode("overwrite").parquet(kept_path)
    df.filter(~ok).write.mode("overwrite").parquet(rejected_path)


def write_tokens(df: DataFrame, tokens: str, path: str) -> None:
    """JSON lines, one array of tokens per document."""
    df.write.mode("overwrite").json(path)


def label_mapping(df: DataFrame, label: str) -> DataFrame:
    """(code, label, n): codes from 0 in label order."""
    codes = label_codes(df, label)
    return codes.join(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label).select("code", F.col(label).alias("label"), "n")
