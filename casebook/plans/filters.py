"""Projections, filters and conditional columns over the test tables."""

from pyspark.sql import functions as F

from casebook.functions.dates import in_years, quarter_of
from casebook.functions.runtime import scratch_path, table
from casebook.functions.text import contains_any, first_keyword_category, matches_any
from casebook.operators import predicates as P
from casebook.plans.registry import query
from casebook.sources.files import write_both

LICENSE_WORDS = ["license", "apache", "copyright"]
COMMON_WORDS = ["that", "pour", "nicht"]


@query("select_rename_reorder", "P1", "SELECT c_mktsegment AS segment, c_name AS firm, c_custkey AS firm_id FROM customer")
def _(spark, folder):
    return (
        table(spark, folder, "customer")
        .withColumnsRenamed({"c_custkey": "firm_id", "c_name": "firm", "c_mktsegment": "segment"})
        .select("segment", "firm", "firm_id")
    )


@query(
    "keyword_filter",
    "P2",
    "SELECT doc_id, source, n_chars FROM documents WHERE regexp_matches(text, '(?i)(license|apache|copyright)')",
)
def _(spark, folder):
    return P.keyword_filter(table(spark, folder, "documents"), "text", LICENSE_WORDS).select("doc_id", "source", "n_chars")


@query(
    "literal_keyword_filter",
    "P3",
    "SELECT doc_id, lang FROM documents WHERE contains(text, 'License') OR contains(text, ' nicht ') OR contains(text, 'Apache')",
)
def _(spark, folder):
    docs = table(spark, folder, "documents")
    return P.literal_filter(docs, "text", ["License", " nicht ", "Apache"]).select("doc_id", "lang")


@query(
    "guarded_keyword_filter",
    "P4",
    """SELECT doc_id, source FROM documents
       WHERE NOT ((contains(text, 'that') OR contains(text, 'nicht')) AND NOT (contains(text, 'License') OR contains(text, 'with')))""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents")
    return P.guarded_filter(docs, "text", ["that", "nicht"], ["License", "with"]).select("doc_id", "source")


@query(
    "name_or_text_route",
    "P5",
    """WITH r AS (SELECT doc_id, source, regexp_matches(source, '(?i)(src7|src19)')
                   OR (source = 'src1' AND regexp_matches(text, '(?i)(that|pour|nicht)')) AS routed FROM documents)
       SELECT doc_id, CASE WHEN routed THEN '' ELSE source END AS source, routed FROM r""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents")
    out = P.name_or_text_route(docs, "source", "text", ["src7", "src19"], "src1", COMMON_WORDS)
    return out.select("doc_id", "source", "routed")


@query(
    "tiered_relevance",
    "P6",
    """WITH t AS (SELECT doc_id,
          CASE WHEN contains(text, 'MIT License') OR contains(text, 'Apache License') THEN 'precise'
               WHEN (contains(text, 'that') OR contains(text, 'this'))::INT
                  + (contains(text, 'from') OR contains(text, 'with'))::INT
                  + (contains(text, 'was ') OR contains(text, 'were '))::INT >= 2 THEN 'context'
               WHEN regexp_matches(text, 'pour[^.]*dans') OR regexp_matches(text, 'nicht[^.]*sich') THEN 'pattern' END AS reason
          FROM documents)
       SELECT doc_id, reason FROM t WHERE reason IS NOT NULL""",
)
def _(spark, folder):
    reason = P.tiered_relevance(
        "text",
        ["MIT License", "Apache License"],
        {"pointing": ["that", "this"], "linking": ["from", "with"], "past": ["was ", "were "]},
        ["pour[^.]*dans", "nicht[^.]*sich"],
        ["precise", "context", "pattern"],
    )
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", reason.alias("reason")).filter("reason is not null")


@query(
    "date_range_closed",
    "P7",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01 00:00:00' AND TIMESTAMP '1997-09-30 00:00:00'""",
)
def _(spark, folder):
    low, high = F.expr("timestamp_ntz'1996-03-01 00:00:00'"), F.expr("timestamp_ntz'1997-09-30 00:00:00'")
    return table(spark, folder, "orders").filter(P.closed_range("o_orderdate", low, high)).select("o_orderkey", "o_totalprice")


@query(
    "date_range_open",
    "P7",
    """SELECT o_orderkey FROM orders
       WHERE o_orderdate > TIMESTAMP '1996-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-09-30 00:00:00'""",
)
def _(spark, folder):
    low, high = F.expr("timestamp_ntz'1996-03-01 00:00:00'"), F.expr("timestamp_ntz'1997-09-30 00:00:00'")
    return table(spark, folder, "orders").filter(P.open_range("o_orderdate", low, high)).select("o_orderkey")


@query(
    "year_filter",
    "P8",
    "SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1998",
)
def _(spark, folder):
    return table(spark, folder, "orders").filter(in_years("o_orderdate", 1997, 1998)).select("o_orderkey", "o_custkey")


@query(
    "years_and_first_quarter",
    "P9",
    """SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q FROM orders
       WHERE (year(o_orderdate) BETWEEN 1996 AND 1998) OR (year(o_orderdate) = 1999 AND quarter(o_orderdate) <= 1)""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").filter(in_years("o_orderdate", 1996, 1999))
    rows = orders.select("o_orderkey", F.year("o_orderdate").alias("y"), quarter_of(F.month("o_orderdate")).alias("q"))
    return rows.filter(P.years_and_part(F.col("y"), F.col("q"), 1996, 1999, 1))


@query(
    "null_and_blank_handling",
    "P10",
    """WITH p AS (SELECT page_id, nullif(regexp_extract(url, 'ref=([a-z]*)', 1), '') AS ref,
                         nullif(regexp_extract(url, '#([a-z]+)', 1), '') AS part FROM pages)
       SELECT page_id, coalesce(ref, 'none') AS ref, coalesce(part, 'none') AS part FROM p
       WHERE NOT (ref IS NULL AND part IS NULL)""",
)
def _(spark, folder):
    pages = table(spark, folder, "pages").select(
        "page_id",
        F.nullif(F.regexp_extract("url", "ref=([a-z]*)", 1), F.lit("")).alias("ref"),
        F.nullif(F.regexp_extract("url", "#([a-z]+)", 1), F.lit("")).alias("part"),
    )
    return pages.dropna(how="all", subset=["ref", "part"]).fillna("none", subset=["ref", "part"])


@query("negative_balances", "P11", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def _(spark, folder):
    return table(spark, folder, "customer").filter(F.col("c_acctbal") < 0).select("c_custkey", "c_acctbal")


@query(
    "prefix_equality_in_list",
    "P12",
    """SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red') AND p_type <> 'ECONOMY'
       AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')""",
)
def _(spark, folder):
    part = table(spark, folder, "part")
    test = F.col("p_name").startswith("red") & (F.col("p_type") != "ECONOMY")
    return part.filter(test & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).select("p_partkey", "p_name")


@query(
    "name_hygiene",
    "P13",
    r"""SELECT p_partkey, regexp_matches(p_name, '^[a-zA-Z\s]+$') AS latin_only, contains(p_brand, '#') AS marked
        FROM part WHERE NOT contains(p_type, ',')""",
)
def _(spark, folder):
    part = table(spark, folder, "part").filter(~F.col("p_type").contains(","))
    return part.select(
        "p_partkey", F.col("p_name").rlike(r"^[a-zA-Z\s]+$").alias("latin_only"), F.col("p_brand").contains("#").alias("marked")
    )


@query("first_present_column", "P14 P15", "SELECT s_name AS entity, count(*) AS n FROM supplier GROUP BY 1")
def _(spark, folder):
    supplier = P.require_columns(table(spark, folder, "supplier"), ["s_suppkey"])
    name = P.first_present(supplier, ["company", "firm_name", "s_name", "c_name"])
    return supplier.groupBy(name.alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "consistency_repair",
    "P16",
    "SELECT doc_id, quality, CASE WHEN quality = 0 THEN 0 ELSE toxic END AS toxic, toxic AS toxic_before FROM labels",
)
def _(spark, folder):
    labels = table(spark, folder, "labels")
    return labels.withColumn("toxic_before", F.col("toxic")).withColumn(
        "toxic", F.when(F.col("quality") == 0, F.lit(0)).otherwise(F.col("toxic"))
    )


LEXICON = [("rights", ["License", "Copyright"]), ("link", ["with", "from"]), ("negation", ["nicht", "pas ", "not "])]


@query(
    "first_keyword_category",
    "P17",
    """SELECT doc_id, CASE WHEN contains(text, 'License') OR contains(text, 'Copyright') THEN 'rights'
         WHEN contains(text, 'with') OR contains(text, 'from') THEN 'link'
         WHEN contains(text, 'nicht') OR contains(text, 'pas ') OR contains(text, 'not ') THEN 'negation'
         ELSE 'other' END AS category FROM documents""",
)
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", first_keyword_category("text", LEXICON, "other").alias("category"))


@query(
    "label_group_map",
    "P18",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast'
         WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'slow' END AS grp
       FROM orders WHERE o_orderpriority <> '3-MEDIUM'""",
)
def _(spark, folder):
    groups = {"1-URGENT": "fast", "2-HIGH": "fast", "4-NOT SPECIFIED": "slow", "5-LOW": "slow"}
    out = P.relabel(table(spark, folder, "orders"), "o_orderpriority", groups, "grp")
    return out.filter("grp is not null").select("o_orderkey", "grp")


@query(
    "code_remap",
    "P19",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS code,
         CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS label FROM orders""",
)
def _(spark, folder):
    coded = P.relabel(table(spark, folder, "orders"), "o_orderstatus", {"O": 0, "F": 1}, "code", F.lit(2))
    named = P.relabel(coded, "code", {0: "open", 1: "filled"}, "label", F.lit("other"))
    return named.select("o_orderkey", "code", "label")


@query(
    "monthly_keyword_share",
    "A6 A7 A20 P2",
    """WITH d AS (SELECT strftime(DATE '2020-01-01' + (doc_id % 730)::INT, '%Y-%m') AS month, source,
                         regexp_matches(text, '(?i)(that|pour|nicht)') AS hit FROM documents),
            c AS (SELECT month, source, count(*) FILTER (hit) AS hits, count(*) AS total FROM d GROUP BY 1, 2)
       SELECT month, source, hits, total, round(100.0 * hits / total, 6) AS percent FROM c""",
)
def _(spark, folder):
    # Documents have no date: their day follows from the id.
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 730).cast("int"))
    docs = table(spark, folder, "documents").select(
        F.date_format(day, "yyyy-MM").alias("month"), "source", matches_any("text", COMMON_WORDS).alias("hit")
    )
    counts = docs.groupBy("month", "source").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("percent", F.round(100.0 * F.col("hits") / F.col("total"), 6))


@query(
    "kept_and_rejected",
    "IO14",
    """SELECT lang, contains(text, 'that') OR contains(text, 'sich') AS kept, count(*) AS n FROM documents GROUP BY 1, 2""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents")
    kept, rejected = P.kept_and_rejected(docs, contains_any("text", ["that", "sich"]))
    both = kept.select("lang", F.lit(True).alias("kept")).union(rejected.select("lang", F.lit(False).alias("kept")))
    return both.groupBy("lang", "kept").agg(F.count(F.lit(1)).alias("n"))


@query(
    "kept_and_rejected_files",
    "IO14",
    """SELECT CASE WHEN contains(text, 'that') OR contains(text, 'sich') THEN 'kept' ELSE 'rejected' END AS output, doc_id FROM documents""",
)
def _(spark, folder):
    path = scratch_path(spark, "two-outputs")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    write_both(docs, contains_any("text", ["that", "sich"]), f"{path}/kept", f"{path}/rejected")
    outputs = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("output"), "doc_id") for name in ("kept", "rejected")]
    return outputs[0].unionByName(outputs[1])
