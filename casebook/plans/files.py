"""Round trips through written folders, and file-level operators."""

from pyspark.sql import functions as F

from casebook.functions.runtime import scratch_path, table
from casebook.functions.text import first_keyword_category, kept_tokens
from casebook.operators.ordering import contiguous_parts
from casebook.plans.filters import LEXICON
from casebook.plans.registry import query
from casebook.sources import files as S

EVENT_CSV = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("folder_union_scan", "IO1", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(spark, folder):
    path = scratch_path(spark, "events-csv")
    S.append_rows(table(spark, folder, "events"), path)
    return S.scan_folder(spark, path, EVENT_CSV, "*.csv")


@query("column_pruned_scan", "IO2", "SELECT doc_id, source FROM documents")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "source")


@query(
    "month_range_scan",
    "IO3 IO9",
    """SELECT o_orderkey, o_orderdate, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders
       WHERE strftime(o_orderdate, '%Y%m') BETWEEN '199611' AND '199702'""",
)
def _(spark, folder):
    path = scratch_path(spark, "orders-months")
    S.write_months(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", path)
    return S.scan_months(spark, path, "199611", "199702")


@query(
    "split_by_month",
    "IO9",
    """SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS n, round(sum(o_totalprice), 2) AS amount
       FROM orders GROUP BY 1, 2""",
)
def _(spark, folder):
    path = scratch_path(spark, "orders-split")
    S.write_months(table(spark, folder, "orders"), "o_orderdate", path)
    return spark.read.parquet(path).groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount")
    )


@query(
    "rows_with_file_name",
    "IO4",
    "SELECT 'events.parquet' AS file, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def _(spark, folder):
    events = S.with_file_name(table(spark, folder, "events"))
    return events.groupBy("file", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "keys_from_file_name",
    "IO5",
    "SELECT 'events' AS stem, 'parquet' AS kind, count(*) AS n FROM events",
)
def _(spark, folder):
    keyed = S.keys_from_file_name(table(spark, folder, "events"), r"^(\w+)\.(\w+)$", ["stem", "kind"])
    return keyed.groupBy("stem", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("files_by_name_rule", "IO6", "SELECT s_suppkey AS key, s_nationkey AS nation FROM supplier")
def _(spark, folder):
    both = spark.read.schema("s_suppkey bigint, s_nationkey int").option("pathGlobFilter", "{supplier,part}.parquet").parquet(folder)
    return S.drop_files(both, "^part").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))


@query(
    "mixed_encoding_texts",
    "IO7",
    "SELECT lang IS DISTINCT FROM 'fr' AS utf8, count(*) AS lines FROM documents WHERE text IS NOT NULL GROUP BY 1",
)
def _(spark, folder):
    # French rows are written in Latin-1, which is not valid UTF-8, all others in UTF-8.
    path = scratch_path(spark, "mixed")
    docs = table(spark, folder, "documents").filter(F.col("text").isNotNull())
    french = F.coalesce(F.col("lang") == "fr", F.lit(False))
    for charset, rows in (("ISO-8859-1", docs.filter(french)), ("UTF-8", docs.filter(~french))):
        value = rows.select(F.regexp_replace("text", r"[\r\n]", " ").alias("value"))
        value.write.option("encoding", charset).option("maxRecordsPerFile", 20_000).csv(f"{path}/{charset}")
    raw = S.read_texts(spark, f"{path}/*/*.csv")
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x != ""))
    return raw.groupBy((F.col("encoding") == "utf-8").alias("utf8")).agg(F.sum(lines).alias("lines"))


@query(
    "sniffed_encodings",
    "IO7",
    """SELECT CASE lang WHEN 'fr' THEN 'latin-1' WHEN 'es' THEN 'utf-16-le' WHEN 'de' THEN 'utf-16-be' ELSE 'utf-8' END AS encoding,
         count(*) AS lines, sum(length(translate(text, chr(13) || chr(10), '  ')))::BIGINT AS chars FROM documents WHERE trim(text) <> '' GROUP BY 1""",
)
def _(spark, folder):
    # Each language in an encoding of its own; the text is read back without being told which.
    path = scratch_path(spark, "sniffed")
    docs = table(spark, folder, "documents").filter(F.trim("text") != "")
    charsets = {"fr": "ISO-8859-1", "es": "UTF-16LE", "de": "UTF-16BE"}
    for lang, charset in [*charsets.items(), (None, "UTF-8")]:
        rows = docs.filter(F.col("lang") == lang if lang else F.coalesce(~F.col("lang").isin(list(charsets)), F.lit(True)))
        value = rows.select(F.translate("text", "\r\n", "  ").alias("value"))
        plain = value.write.option("encoding", charset).option("quote", "").option("maxRecordsPerFile", 2_000)
        # A separator that no text holds: lines are written as they are.
        plain.option("sep", "\x01").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{charset}")
    raw = S.read_texts(spark, f"{path}/*/*.csv")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    chars = F.aggregate(lines, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))
    return raw.groupBy("encoding").agg(F.sum(F.size(lines)).alias("lines"), F.sum(chars).alias("chars"))


@query("append_with_header_once", "IO8", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def _(spark, folder):
    path = scratch_path(spark, "appended")
    S.append_rows(table(spark, folder, "supplier").select("s_suppkey", "s_name"), path)
    S.append_rows(table(spark, folder, "customer").selectExpr("c_custkey AS s_suppkey", "c_name AS s_name"), path)
    return S.scan_folder(spark, path, "s_suppkey bigint, s_name string")


@query(
    "months_from_cutoff",
    "IO10",
    """SELECT strftime(o_orderdate, '%Y%m')::INT AS ym, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y%m') >= '199801' GROUP BY 1""",
)
def _(spark, folder):
    path = scratch_path(spark, "orders-ym")
    S.rewrite_months(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", path, "199801")
    return spark.read.parquet(path).groupBy("ym").agg(F.count(F.lit(1)).alias("n"))


@query(
    "contiguous_parts",
    "IO11",
    """SELECT o_orderkey, 1 + (rn - 1) // ((total + 6) // 7) AS part FROM (SELECT o_orderkey,
         row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS total FROM orders)""",
)
def _(spark, folder):
    return contiguous_parts(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 7)


SHEET_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(
    "rows_per_sheet",
    "IO12",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, (rn - 1) // 7000 AS sheet FROM (SELECT *, row_number() OVER (ORDER BY {SHEET_ORDER}) AS rn FROM lineitem)""",
)
def _(spark, folder):
    order = SHEET_ORDER.split(", ")
    rows = S.sheet_number(table(spark, folder, "lineitem").select(*order), order, 7000)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "sheet")


@query("capped_files", "IO12", "SELECT true AS within_cap, count(*) AS n FROM lineitem")
def _(spark, folder):
    path = scratch_path(spark, "capped")
    S.write_capped(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), path, 7000)
    files = S.with_file_name(S.scan_folder(spark, path, "l_orderkey bigint, l_linenumber int")).groupBy("file").agg(F.count(F.lit(1)).alias("c"))
    return files.groupBy((F.col("c") <= 7000).alias("within_cap")).agg(F.sum("c").alias("n"))


@query(
    "one_output_per_category",
    "IO13",
    """SELECT CASE WHEN contains(text, 'License') OR contains(text, 'Copyright') THEN 'rights'
         WHEN contains(text, 'with') OR contains(text, 'from') THEN 'link'
         WHEN contains(text, 'nicht') OR contains(text, 'pas ') OR contains(text, 'not ') THEN 'negation'
         ELSE 'other' END AS category, doc_id FROM documents""",
)
def _(spark, folder):
    path = scratch_path(spark, "categories")
    docs = table(spark, folder, "documents").select("doc_id", first_keyword_category("text", LEXICON, "other").alias("category"))
    S.write_by_category(docs, "category", path)
    return spark.read.parquet(path)


@query(
    "token_corpus",
    "IO15",
    r"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '\p{L}+'),
          lambda w: length(w) >= 2 AND w NOT IN ('the', 'of')))::INT AS tokens FROM documents""",
)
def _(spark, folder):
    path = scratch_path(spark, "corpus")
    docs = table(spark, folder, "documents").select("doc_id", kept_tokens(F.col("text"), ["the", "of"]).alias("tokens"))
    S.write_tokens(docs, "tokens", path)
    back = spark.read.schema("doc_id bigint, tokens array<string>").json(path)
    return back.select("doc_id", F.size("tokens").alias("tokens"))


@query(
    "label_mapping",
    "IO16",
    """SELECT (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::BIGINT AS code, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY o_orderpriority""",
)
def _(spark, folder):
    return S.label_mapping(table(spark, folder, "orders"), "o_orderpriority")
