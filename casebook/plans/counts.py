"""Counts, shares, panels, trends and joined texts over the test tables."""

from pyspark.sql import functions as F

from casebook.functions.runtime import table
from casebook.functions.text import contains_any, matches_any
from casebook.operators import stats as A
from casebook.operators.ordering import top_k
from casebook.plans.registry import query

ORDER_KEY_YEAR = "date_format(o_orderdate, 'yyyy')"


@query(
    "frequency_table",
    "A1",
    """SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, o_custkey) AS rank
       FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""",
)
def _(spark, folder):
    return A.frequency_table(table(spark, folder, "orders"), "o_custkey")


@query(
    "count_of_counts",
    "A2",
    "SELECT times, count(*) AS keys FROM (SELECT o_custkey, count(*) AS times FROM orders GROUP BY 1) GROUP BY 1",
)
def _(spark, folder):
    return A.count_of_counts(table(spark, folder, "orders"), "o_custkey")


@query(
    "distinct_counts",
    "A3",
    """SELECT o_orderstatus, count(DISTINCT o_custkey) AS firms, count(DISTINCT date_trunc('month', o_orderdate)) AS months
       FROM orders GROUP BY 1""",
)
def _(spark, folder):
    return table(spark, folder, "orders").groupBy("o_orderstatus").agg(
        F.countDistinct("o_custkey").alias("firms"), F.countDistinct(F.date_trunc("month", "o_orderdate")).alias("months")
    )


@query(
    "distinct_counts_from_sketches",
    "A3",
    """WITH o AS (SELECT o_custkey, o_orderkey, year(o_orderdate)::INT AS y FROM orders)
       SELECT y::VARCHAR AS period, count(DISTINCT o_custkey) AS firms, count(DISTINCT o_orderkey) AS orders, true AS close FROM o GROUP BY 1
       UNION ALL SELECT 'all', count(DISTINCT o_custkey), count(DISTINCT o_orderkey), true FROM o""",
)
def _(spark, folder):
    # Sketches per month, merged over years and over all; the exact counts stand beside them.
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    cols = ["o_custkey", "o_orderkey"]
    monthly = A.distinct_sketches(orders, ["month"], cols).withColumn("period", F.explode(F.array(F.left("month", F.lit(4)), F.lit("all"))))
    merged = A.merged_distinct_counts(monthly, ["period"], cols)
    exact = orders.withColumn("period", F.explode(F.array(F.left("month", F.lit(4)), F.lit("all")))).groupBy("period").agg(
        F.countDistinct("o_custkey").alias("firms"), F.countDistinct("o_orderkey").alias("orders")
    )
    # Four times the stated error.
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(2), 0.052 * F.col(b))
    return exact.join(merged, "period").select("period", "firms", "orders", (near("o_custkey", "firms") & near("o_orderkey", "orders")).alias("close"))


@query(
    "mean_per_group_and_year",
    "A4",
    """SELECT n_regionkey, year(o_orderdate)::INT AS y, round(avg(o_totalprice), 4) AS mean_price FROM orders
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.groupBy("n_regionkey", F.year("o_orderdate").alias("y")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query(
    "conditional_counts",
    "A5",
    """SELECT source, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic,
         count(*) FILTER (quality = 1 AND toxic = 1) AS both_ FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return A.conditional_counts(docs, ["source"], {"good": good, "toxic": toxic, "both_": good & toxic})


@query(
    "subset_and_total",
    "A6",
    """SELECT source, count(*) FILTER (regexp_matches(text, '(?i)(license|apache)')) AS hits, count(*) AS total
       FROM documents GROUP BY 1 HAVING hits > 0""",
)
def _(spark, folder):
    return A.subset_and_total(table(spark, folder, "documents"), "source", matches_any("text", ["license", "apache"]))


@query(
    "hits_per_year_and_total",
    "A7",
    """WITH h AS (SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders WHERE o_orderpriority ILIKE '%urgent%' GROUP BY 1)
       SELECT year, n FROM h UNION ALL SELECT 'all', sum(n)::BIGINT FROM h""",
)
def _(spark, folder):
    return A.hits_per_period(table(spark, folder, "orders"), F.year("o_orderdate"), matches_any("o_orderpriority", ["urgent"]))


@query(
    "missing_per_year",
    "A8",
    """SELECT year(o_orderdate)::INT AS year, count(*) FILTER (doc_id IS NULL) AS missing,
         round(100.0 * count(*) FILTER (doc_id IS NULL) / count(*), 6) AS percent
       FROM orders LEFT JOIN labels ON o_orderkey = doc_id GROUP BY 1""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    joined = orders.join(table(spark, folder, "labels").select("doc_id"), F.col("o_orderkey") == F.col("doc_id"), "left")
    return A.missing_share(joined, F.year("o_orderdate"), "doc_id")


@query(
    "filled_cells_per_row",
    "A9",
    """SELECT page_id, (nullif(regexp_extract(url, 'ref=([a-z]+)', 1), '') IS NOT NULL)::INT
         + (nullif(regexp_extract(url, 'page=([0-9]+)', 1), '') IS NOT NULL)::INT
         + (nullif(regexp_extract(url, '#([a-z]+)', 1), '') IS NOT NULL)::INT AS filled FROM pages""",
)
def _(spark, folder):
    parts = {"ref": "ref=([a-z]+)", "page": "page=([0-9]+)", "part": "#([a-z]+)"}
    cols = [F.nullif(F.regexp_extract("url", p, 1), F.lit("")).alias(c) for c, p in parts.items()]
    pages = table(spark, folder, "pages").select("page_id", *cols)
    return pages.select("page_id", A.filled_cells(list(parts)).alias("filled"))


@query(
    "column_profile",
    "A10",
    """SELECT 'doc_id' AS "column", count(doc_id) AS filled FROM documents LEFT JOIN labels USING (doc_id)
       UNION ALL SELECT 'lang', count(lang) FROM documents
       UNION ALL SELECT 'quality', count(quality) FROM documents LEFT JOIN labels USING (doc_id)
       UNION ALL SELECT 'toxic', count(toxic) FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return A.column_profile(docs.join(table(spark, folder, "labels"), "doc_id", "left"))


@query(
    "firm_year_documents",
    "A12",
    """SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS pieces
       FROM conversations GROUP BY 1, 2""",
)
def _(spark, folder):
    return A.concat_texts(table(spark, folder, "conversations"), ["conv_id", "role"], ["turn"], "text")


@query(
    "firm_year_pieces",
    "A12",
    """SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS piece_no, text
       FROM conversations WHERE text IS NOT NULL""",
)
def _(spark, folder):
    return A.ordered_pieces(table(spark, folder, "conversations"), ["conv_id", "role"], ["turn"], "text")


@query(
    "joined_distinct_values",
    "A13 J8",
    """WITH v AS (SELECT DISTINCT o_custkey, trim(o_orderpriority) AS p FROM orders WHERE trim(o_orderpriority) <> ''),
            j AS (SELECT o_custkey, string_agg(p, '; ' ORDER BY p) AS priorities FROM v GROUP BY 1)
       SELECT c_custkey, coalesce(priorities, '') AS priorities FROM customer LEFT JOIN j ON c_custkey = o_custkey""",
)
def _(spark, folder):
    joined = A.joined_values(table(spark, folder, "orders"), "o_custkey", "o_orderpriority", "priorities")
    customer = table(spark, folder, "customer").select("c_custkey")
    out = customer.join(joined, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("priorities", F.lit("")).alias("priorities"))


PANEL_SQL = """SELECT c_name AS entity, strftime(o_orderdate, '%Y%m') AS ym, year(o_orderdate)::INT AS year,
         month(o_orderdate)::INT AS month, count(*) AS n, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS sources
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4"""


def _panel(spark, folder):
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return A.entity_month_panel(orders, F.col("c_name"), "o_orderdate", F.col("o_orderstatus"))


@query("entity_month_panel", "A14", PANEL_SQL)
def _(spark, folder):
    return _panel(spark, folder)


PANEL_YEARS = range(1995, 2002)
PANEL_COLUMNS = ", ".join(f"""coalesce(sum(n) FILTER (year = {y}), 0)::BIGINT AS "{y}\"""" for y in PANEL_YEARS)


@query("wide_panel", "A15", f"WITH p AS ({PANEL_SQL}) SELECT entity, {PANEL_COLUMNS} FROM p GROUP BY 1")
def _(spark, folder):
    return A.wide_panel(_panel(spark, folder), "entity", "year", "n")


@query(
    "trend_year_quarter_month",
    "A16",
    """SELECT 'year' AS grain, strftime(o_orderdate, '%Y') AS period, count(*) AS n FROM orders GROUP BY 1, 2
       UNION ALL SELECT 'quarter', strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate), count(*) FROM orders GROUP BY 1, 2
       UNION ALL SELECT 'month', strftime(o_orderdate, '%Y-%m'), count(*) FROM orders GROUP BY 1, 2""",
)
def _(spark, folder):
    return A.trend_set(table(spark, folder, "orders"), "o_orderdate")


@query(
    "latest_24_months",
    "A17",
    """SELECT period, n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders GROUP BY 1
         ORDER BY period DESC LIMIT 24) ORDER BY period""",
)
def _(spark, folder):
    return A.latest_periods(A.trend(table(spark, folder, "orders"), "o_orderdate", "month"), "period")


@query("month_of_year_total", "A18", "SELECT month(o_orderdate)::INT AS month, count(*) AS n FROM orders GROUP BY 1")
def _(spark, folder):
    return table(spark, folder, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "listed_entities_per_year",
    "A19",
    """SELECT year(o_orderdate)::INT AS year, count(DISTINCT o_custkey) AS entities FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""",
)
def _(spark, folder):
    listed = table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS o_custkey")
    kept = table(spark, folder, "orders").join(listed, "o_custkey", "left_semi")
    return kept.groupBy(F.year("o_orderdate").alias("year")).agg(F.countDistinct("o_custkey").alias("entities"))


@query(
    "category_share",
    "A20",
    """SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM orders GROUP BY 1""",
)
def _(spark, folder):
    return A.shares(table(spark, folder, "orders"), "o_orderpriority")


@query(
    "match_coverage",
    "A21",
    """SELECT count(*) AS total, count(*) FILTER (f) AS matched, count(*) FILTER (NOT f) AS unmatched,
         round(100.0 * count(*) FILTER (f) / count(*), 6) AS percent
       FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders) AS f FROM customer)""",
)
def _(spark, folder):
    seen = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_in", F.lit(True))
    customer = table(spark, folder, "customer").select("c_custkey").join(seen, "c_custkey", "left")
    return A.coverage(customer, F.col("_in").isNotNull())


@query(
    "new_entities_by_keyword",
    "A22",
    """WITH n AS (SELECT trim(p_name) AS entity, count(*) AS n FROM part GROUP BY 1),
            f AS (SELECT * FROM n WHERE entity NOT IN (SELECT p_name FROM part WHERE p_size = 1 AND p_type = 'PROMO')),
            k AS (SELECT entity, n, contains(entity, 'ring')::INT + contains(entity, 'red')::INT + contains(entity, 'gear')::INT AS k FROM f)
       SELECT entity, n, n * k AS hits, CASE WHEN contains(entity, 'ring') THEN 'ring' WHEN contains(entity, 'red') THEN 'red'
         ELSE 'gear' END AS category FROM k WHERE k > 0""",
)
def _(spark, folder):
    part = table(spark, folder, "part")
    licensed = part.filter("p_size = 1 AND p_type = 'PROMO'").select(F.col("p_name").alias("entity"))
    return A.new_entities(part, "p_name", ["ring", "red", "gear"], licensed, "other")


@query(
    "documents_with_both_lists",
    "A23",
    """SELECT strftime(DATE '2020-01-01' + (doc_id % 730)::INT, '%Y-%m') AS month, count(*) AS n FROM documents
       WHERE regexp_matches(text, '\\b(that|this)\\b') AND regexp_matches(text, '\\bfrom\\b') GROUP BY 1""",
)
def _(spark, folder):
    # Documents have no date: their day follows from the id.
    docs = table(spark, folder, "documents")
    both = F.col("text").rlike(r"\b(that|this)\b") & F.col("text").rlike(r"\bfrom\b")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 730).cast("int"))
    return docs.filter(both).groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "month_consistency",
    "A24",
    """SELECT o_custkey, count(DISTINCT strftime(o_orderdate, '%Y%m')) AS months, min(strftime(o_orderdate, '%Y%m')) AS first_month,
         count(DISTINCT strftime(o_orderdate, '%Y%m')) = 1 AND max(strftime(o_orderdate, '%Y%m')) = '199607' AS consistent
       FROM orders GROUP BY 1""",
)
def _(spark, folder):
    return A.month_consistency(table(spark, folder, "orders"), "o_custkey", "o_orderdate", F.lit("199607"))


@query(
    "annotator_agreement",
    "A25",
    """SELECT source, sum((quality IS NOT DISTINCT FROM toxic)::INT)::BIGINT AS same, count(*) AS n,
         round(avg((quality IS NOT DISTINCT FROM toxic)::INT), 6) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id", "left")
    same = F.col("quality").eqNullSafe(F.col("toxic")).cast("int")
    return docs.groupBy("source").agg(
        F.sum(same).alias("same"), F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 6).alias("rate")
    )


@query(
    "cause_list",
    "A26",
    """SELECT event_type AS cause, count(DISTINCT ts::DATE) AS files, count(*) AS "rows" FROM events GROUP BY 1""",
)
def _(spark, folder):
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("cause")).agg(
        F.countDistinct(F.col("ts").cast("date")).alias("files"), F.count(F.lit(1)).alias("rows")
    )


@query(
    "object_counts_with_example",
    "A27",
    "SELECT source, count(*) AS n, arg_min(text, doc_id) AS text FROM documents GROUP BY 1",
)
def _(spark, folder):
    return A.object_counts(table(spark, folder, "documents"), "source", "doc_id", "text")


@query("text_length_histogram", "A28", "SELECT length(text)::INT AS chars, count(*) AS n FROM documents GROUP BY 1")
def _(spark, folder):
    return table(spark, folder, "documents").groupBy(F.length("text").alias("chars")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "mode_fill",
    "A29",
    """WITH j AS (SELECT o_orderkey, nullif(year(o_orderdate), 1996)::INT AS y FROM orders),
            m AS (SELECT y FROM j WHERE y IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, y LIMIT 1)
       SELECT o_orderkey, coalesce(y, (SELECT y FROM m)) AS y FROM j""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.nullif(F.year("o_orderdate"), F.lit(1996)).alias("y"))
    return A.fill_with_mode(orders, "y")


@query(
    "url_station_tally",
    "A30",
    """SELECT coalesce(nullif(regexp_extract(url, '^https?://[^/]*\\.([a-z]+)\\.[a-z]+/', 1), ''), 'N/A') AS station,
         coalesce(nullif(regexp_extract(url, '/([a-z]{2})/[0-9]+', 1), ''), 'N/A') AS province, count(*) AS n FROM pages GROUP BY 1, 2""",
)
def _(spark, folder):
    def part(pattern):
        return F.coalesce(F.nullif(F.regexp_extract("url", pattern, 1), F.lit("")), F.lit("N/A"))

    station = part(r"^https?://[^/]*\.([a-z]+)\.[a-z]+/")
    return table(spark, folder, "pages").groupBy(
        station.alias("station"), part("/([a-z]{2})/[0-9]+").alias("province")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "object_screening",
    "A31",
    """WITH s AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '|42')) AS rn FROM documents),
            h AS (SELECT *, sum((contains(text, 'License') OR contains(text, 'nicht'))::INT) OVER (PARTITION BY source) AS hits FROM s WHERE rn <= 10)
       SELECT source, doc_id FROM h WHERE hits >= 2""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents")
    return A.screen_objects(docs, "source", "doc_id", contains_any("text", ["License", "nicht"])).select("source", "doc_id")


@query(
    "top_expense_firms",
    "W3 A1",
    """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1
       ORDER BY n DESC, o_custkey LIMIT 20""",
)
def _(spark, folder):
    firms = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount")
    )
    return top_k(firms, [F.col("n").desc(), F.col("o_custkey")], 20)
