"""De-duplication, numbering, slices, windows and set operations."""

from pyspark.sql import functions as F

from casebook.functions.runtime import table
from casebook.operators import ordering as O
from casebook.plans.registry import query


@query(
    "keep_first_text",
    "W1",
    """SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
       WHERE rn = 1""",
)
def _(spark, folder):
    return O.keep_first(table(spark, folder, "documents"), ["text"], ["doc_id"], digest=True).select("doc_id", "source")


@query(
    "keep_first_composite_key",
    "W1",
    """SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (
         PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def _(spark, folder):
    first = O.keep_first(table(spark, folder, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderpriority", "o_orderkey")


@query(
    "multi_key_sort",
    "W2",
    "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return orders.orderBy("o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey")


@query("largest_orders", "W3", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return O.top_k(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100)


@query(
    "sequence_number",
    "W4",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderdate", "o_orderkey")
    return O.sequence_number(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "seq")


@query(
    "contiguous_slice",
    "W5",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (
         ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn > 1000 AND rn <= 5000""",
)
def _(spark, folder):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = O.slice_rows(table(spark, folder, "lineitem").select(*order), order, 1000, 5000)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "balanced_blocks",
    "W6",
    """WITH s AS (SELECT source, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, source) - 1) % 12 AS turn
         FROM documents WHERE source IS NOT NULL GROUP BY source)
       SELECT source, (CASE WHEN turn < 6 THEN turn ELSE 11 - turn END)::INT AS bin, n FROM s""",
)
def _(spark, folder):
    docs = O.pack_blocks(table(spark, folder, "documents").select("doc_id", "source"), "source", 6)
    return docs.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "least_loaded_blocks",
    "W6",
    """WITH RECURSIVE s AS (SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY o_custkey) AS i FROM orders GROUP BY 1),
        d AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS o_custkey, 0 AS bin, 0::BIGINT AS n, list_resize([]::BIGINT[], 20, 0) AS loads
              UNION ALL
              SELECT s.i, s.o_custkey, list_position(d.loads, list_min(d.loads)) - 1, s.n, list_transform(d.loads, lambda x, k:
                CASE WHEN k = list_position(d.loads, list_min(d.loads)) THEN x + s.n ELSE x END)
              FROM d JOIN s ON s.i = d.i + 1)
       SELECT o_custkey, bin::INT AS bin, n FROM d WHERE i > 0""",
)
def _(spark, folder):
    orders = O.least_loaded_blocks(table(spark, folder, "orders").select("o_custkey"), "o_custkey")
    return orders.groupBy("o_custkey", "bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "first_and_last_date",
    "W8 A11",
    """SELECT o_custkey, min(o_orderdate)::DATE AS first_date, max(o_orderdate)::DATE AS last_date,
         (max(o_orderdate)::DATE - min(o_orderdate)::DATE)::INT AS days FROM orders GROUP BY 1""",
)
def _(spark, folder):
    dates = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").cast("date").alias("first_date"), F.max("o_orderdate").cast("date").alias("last_date")
    )
    return dates.withColumn("days", F.date_diff("last_date", "first_date"))


@query(
    "aligned_union",
    "U1",
    """SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, NULL::VARCHAR AS segment FROM supplier
       UNION ALL SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer""",
)
def _(spark, folder):
    s = table(spark, folder, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_nationkey AS nation")
    c = table(spark, folder, "customer").selectExpr(
        "c_mktsegment AS segment", "c_custkey AS id", "c_name AS name", "c_nationkey AS nation"
    )
    return O.align_union([s, c])


@query(
    "id_intersection",
    "U2",
    "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").filter("lang = 'en'").select("doc_id")
    return docs.intersect(table(spark, folder, "labels").filter("quality = 1").select("doc_id"))


@query("id_difference", "U3", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id").exceptAll(table(spark, folder, "labels").select("doc_id"))


@query(
    "first_seen_word_union",
    "U4",
    """SELECT word, min(list_no) AS list_no FROM (SELECT unnest(string_split(p_name, ' ')) AS word, 0 AS list_no FROM part
         UNION ALL SELECT lower(p_type), 1 FROM part UNION ALL SELECT event_type, 2 FROM events) GROUP BY 1""",
)
def _(spark, folder):
    part, events = table(spark, folder, "part"), table(spark, folder, "events")
    lists = [
        part.select(F.explode(F.split("p_name", " ")).alias("word")),
        part.select(F.lower("p_type").alias("word")),
        events.select(F.col("event_type").alias("word")),
    ]
    return O.first_seen_union(lists, "word").withColumn("list_no", F.col("list_no").cast("int"))
