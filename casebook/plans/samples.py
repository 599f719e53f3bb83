"""Samples, balances and splits over the test tables."""

from pyspark.sql import functions as F

from casebook.functions.ranking import seeded_key
from casebook.functions.runtime import cut_lineage, table
from casebook.operators import sampling as S
from casebook.operators.matching import not_in_earlier
from casebook.operators.ordering import keep_first
from casebook.plans.registry import query

ORDERS = """o AS (SELECT o_orderkey, o_custkey, year(o_orderdate)::INT AS y, strftime(o_orderdate, '%Y%m') AS ym,
         o_orderpriority AS p, md5(o_orderkey::VARCHAR || '|42') AS k FROM orders)"""
DOCS = "d AS (SELECT doc_id, source, lang, text, md5(doc_id::VARCHAR || '|42') AS k FROM documents)"


def _orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"),
        F.date_format("o_orderdate", "yyyyMM").alias("ym"), F.col("o_orderpriority").alias("p"),
    )


def _drawn(by, quota_sql, cols="o_orderkey, y, p"):
    """SQL that takes the first ``quota`` rows of each stratum; ``quota_sql`` ends in table ``f``."""
    return f"""WITH {ORDERS}, {quota_sql},
        r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY k) AS rn FROM o)
        SELECT {cols} FROM r JOIN f USING ({by}) WHERE rn <= quota"""


def _shares(by, n):
    return f"""c AS (SELECT {by}, count(*) AS n FROM o GROUP BY ALL),
        q AS (SELECT *, round_even(n / sum(n) OVER () * {n}, 0)::BIGINT AS q FROM c)"""


@query(
    "simple_sample",
    "S1",
    "SELECT doc_id, source FROM documents ORDER BY md5(doc_id::VARCHAR || '|42') LIMIT 150",
)
def _(spark, folder):
    return S.simple_sample(table(spark, folder, "documents").select("doc_id", "source"), "doc_id", 150)


@query(
    "yearly_quota_sample",
    "S2",
    _drawn("y", "f AS (SELECT DISTINCT y, CASE WHEN y IN (1995, 1996) THEN 50 ELSE 100 END AS quota FROM o)", "o_orderkey, y"),
)
def _(spark, folder):
    return S.yearly_quota_sample(_orders(spark, folder), "o_orderkey", "y", {1995: 50, 1996: 50}, 100).select("o_orderkey", "y")


SPREAD = """g AS (SELECT *, {n} - sum(q) OVER () AS gap, row_number() OVER (ORDER BY n DESC, {by}) AS big,
          row_number() OVER (ORDER BY n, {by}) AS small FROM q),
        f AS (SELECT {by}, q + CASE WHEN big <= gap THEN 1 WHEN small <= -gap AND q > 1 THEN -1 ELSE 0 END AS quota FROM g)"""


@query("stratified_sample_spread", "S3", _drawn("y, p", _shares("y, p", 1000) + "," + SPREAD.format(n=1000, by="y, p")))
def _(spark, folder):
    return S.stratified_sample(_orders(spark, folder), "o_orderkey", ["y", "p"], 1000).select("o_orderkey", "y", "p")


@query(
    "stratified_sample_stepwise",
    "S4",
    _drawn(
        "ym, p",
        _shares("ym, p", 1010)
        + """, x AS (SELECT sum(q)::BIGINT - 1010 AS excess FROM q),
        u AS (SELECT ym, p, count(*) AS less FROM (SELECT ym, p, unnest(range(0, q)) AS v FROM q ORDER BY v DESC, ym, p
              LIMIT (SELECT greatest(excess, 0) FROM x)) GROUP BY 1, 2),
        b AS (SELECT ym, p FROM q ORDER BY q DESC, ym, p LIMIT 1),
        f AS (SELECT q.ym, q.p, q.q - coalesce(less, 0) + CASE WHEN b.ym IS NOT NULL AND (SELECT excess FROM x) < 0
              THEN -(SELECT excess FROM x) ELSE 0 END AS quota
              FROM q LEFT JOIN u ON q.ym = u.ym AND q.p = u.p LEFT JOIN b ON q.ym = b.ym AND q.p = b.p)""",
        "o_orderkey, ym, p",
    ),
)
def _(spark, folder):
    return S.stratified_sample(_orders(spark, folder), "o_orderkey", ["ym", "p"], 1010, "stepwise").select("o_orderkey", "ym", "p")


@query(
    "stratified_sample_topped_up",
    "S4",
    """WITH k AS (SELECT o_orderkey, o_custkey AS c, md5(o_orderkey::VARCHAR || '|42') AS key FROM orders),
        q AS (SELECT c, count(*) AS n, round_even(count(*) / sum(count(*)) OVER () * 300, 0)::BIGINT AS q FROM k GROUP BY c),
        x AS (SELECT sum(q)::BIGINT - 300 AS excess FROM q),
        u AS (SELECT c, count(*) AS less FROM (SELECT c, unnest(range(0, q)) AS v FROM q ORDER BY v DESC, c
              LIMIT (SELECT greatest(excess, 0) FROM x)) GROUP BY 1),
        b AS (SELECT c FROM q ORDER BY q DESC, c LIMIT 1),
        f AS (SELECT q.c, q.q - coalesce(less, 0) + CASE WHEN b.c IS NOT NULL AND (SELECT excess FROM x) < 0
              THEN -(SELECT excess FROM x) ELSE 0 END AS quota FROM q LEFT JOIN u ON q.c = u.c LEFT JOIN b ON q.c = b.c),
        r AS (SELECT k.*, row_number() OVER (PARTITION BY k.c ORDER BY key) <= quota AS kept FROM k JOIN f ON k.c = f.c),
        t AS (SELECT *, row_number() OVER (PARTITION BY kept ORDER BY key) AS place FROM r)
       SELECT o_orderkey, c AS o_custkey FROM t WHERE kept OR place <= 300 - (SELECT count(*) FROM r WHERE kept)""",
)
def _(spark, folder):
    # Most customers round to no row at all and the largest has too few: the rest is drawn from all others.
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return S.stratified_sample(orders, "o_orderkey", ["o_custkey"], 300, "stepwise", top_up=True)


@query(
    "stratified_sample_largest",
    "S5",
    _drawn(
        "ym, p",
        _shares("ym, p", 1010)
        + """, f AS (SELECT ym, p, q + CASE WHEN row_number() OVER (ORDER BY n DESC, ym, p) = 1
              THEN 1010 - sum(q) OVER () ELSE 0 END AS quota FROM q)""",
        "o_orderkey, ym, p",
    ),
)
def _(spark, folder):
    return S.stratified_sample(_orders(spark, folder), "o_orderkey", ["ym", "p"], 1010, "largest").select("o_orderkey", "ym", "p")


@query(
    "equal_quota_sample",
    "S6",
    f"""WITH {ORDERS}, c AS (SELECT ym, p, count(*) AS n, count(*) OVER () AS strata FROM o GROUP BY 1, 2),
        e AS (SELECT *, greatest(1, least(1000 // strata, 100)) AS s FROM c),
        f AS (SELECT ym, p, CASE WHEN s * strata < 1000 THEN least(1000 // strata + 1, 100) ELSE s END AS quota FROM e),
        r AS (SELECT *, row_number() OVER (PARTITION BY ym, p ORDER BY k) AS rn FROM o),
        t AS (SELECT o_orderkey, ym, p, k FROM r JOIN f USING (ym, p) WHERE rn <= quota)
        SELECT o_orderkey, ym, p FROM t ORDER BY k LIMIT 1000""",
)
def _(spark, folder):
    return S.equal_sample(_orders(spark, folder), "o_orderkey", ["ym", "p"], 1000).select("o_orderkey", "ym", "p")


@query(
    "equal_quota_topped_up",
    "S7",
    f"""WITH {ORDERS}, c AS (SELECT y, p, 1020 // count(*) OVER () AS quota FROM o GROUP BY 1, 2),
        r AS (SELECT o.*, row_number() OVER (PARTITION BY y, p ORDER BY k) AS rn FROM o),
        t AS (SELECT r.*, rn <= quota AS kept FROM r JOIN c USING (y, p)),
        m AS (SELECT *, row_number() OVER (PARTITION BY kept ORDER BY k) AS place, count(*) FILTER (kept) OVER () AS held FROM t)
        SELECT o_orderkey, y, p FROM m WHERE kept OR place <= 1020 - held""",
)
def _(spark, folder):
    return S.equal_sample_topped_up(_orders(spark, folder), "o_orderkey", ["y", "p"], 1020).select("o_orderkey", "y", "p")


FLOOR = """c AS (SELECT y, p, count(*) AS n FROM o GROUP BY 1, 2),
        a AS (SELECT *, greatest(1, round_even(n / sum(n) OVER () * 1000, 0))::BIGINT AS q FROM c),
        b AS (SELECT * EXCLUDE q, CASE WHEN sum(q) OVER () = 1000 THEN q
              ELSE greatest(1, round_even(q * 1000 / sum(q) OVER (), 0))::BIGINT END AS q FROM a),
        f AS (SELECT y, p, n, (q + CASE WHEN row_number() OVER (ORDER BY q DESC, y, p) = 1 THEN 1000 - sum(q) OVER () ELSE 0 END)::BIGINT AS quota FROM b)"""


@query("floor_of_one_quotas", "S8", f"WITH {ORDERS}, {FLOOR} SELECT y, p, n, quota FROM f")
def _(spark, folder):
    return S.floor_of_one_quota(S.strata_sizes(_orders(spark, folder), ["y", "p"]), ["y", "p"], 1000)


@query(
    "entity_weighted_sample",
    "S8",
    f"""WITH {ORDERS}, {FLOOR},
        w AS (SELECT *, -ln((('0x' || substr(k, 1, 13))::BIGINT + 1.0::DOUBLE) / 4503599627370496.0::DOUBLE)
                * count(*) OVER (PARTITION BY y, p, o_custkey) AS e FROM o),
        r AS (SELECT *, row_number() OVER (PARTITION BY y, p ORDER BY e) AS rn FROM w)
        SELECT o_orderkey, y, p FROM r JOIN f USING (y, p) WHERE rn <= quota""",
)
def _(spark, folder):
    out = S.entity_weighted_sample(_orders(spark, folder), "o_orderkey", ["y", "p"], "o_custkey", 1000)
    return out.select("o_orderkey", "y", "p")


@query(
    "one_per_entity_sample",
    "S9",
    f"""WITH {ORDERS}, c AS (SELECT o_custkey, count(*) AS n FROM o GROUP BY 1),
        e AS (SELECT *, floor(n / sum(n) OVER () * (4000 - count(*) OVER ())) AS extra FROM c),
        f AS (SELECT o_custkey, 1 + CASE WHEN n - 1 >= extra THEN extra ELSE 0 END AS quota FROM e),
        r AS (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY k) <= quota AS kept FROM o JOIN f USING (o_custkey)),
        m AS (SELECT *, row_number() OVER (PARTITION BY kept ORDER BY k) AS place, count(*) FILTER (kept) OVER () AS held FROM r)
        SELECT o_orderkey, o_custkey FROM m WHERE kept OR place <= 4000 - held""",
)
def _(spark, folder):
    return S.one_per_entity_sample(_orders(spark, folder), "o_orderkey", "o_custkey", 4000).select("o_orderkey", "o_custkey")


@query(
    "capped_entity_sample",
    "S10",
    f"""WITH {ORDERS}, c AS (SELECT o_custkey, count(*) AS n FROM o GROUP BY 1),
        a AS (SELECT *, row_number() OVER (ORDER BY n, o_custkey) - 1 AS r, count(*) OVER () AS total FROM c),
        m AS (SELECT *, row_number() OVER (ORDER BY md5(o_custkey::VARCHAR || '|42')) AS d FROM a
              WHERE r >= floor(total * 0.2::DOUBLE) AND r < floor(total * 0.8::DOUBLE)),
        s AS (SELECT * FROM m WHERE d <= least(greatest(30, floor(total * 0.6::DOUBLE)), total)),
        b AS (SELECT *, 1 + least(floor(n / sum(n) OVER () * (9000 - count(*) OVER ())), least(12, n) - 1) AS q FROM s),
        g AS (SELECT *, least(12, n) - q AS spare, greatest(9000 - sum(q) OVER (), 0) AS open_ FROM b),
        f AS (SELECT o_custkey, n, q + greatest(0, least(spare, open_ - coalesce(sum(spare) OVER (ORDER BY n DESC, o_custkey
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM g),
        i AS (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS rn, quota FROM o JOIN f USING (o_custkey)),
        x AS (SELECT o.*, row_number() OVER (ORDER BY k) AS place FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM f)),
        t AS (SELECT o_orderkey, o_custkey, k FROM i WHERE rn <= quota UNION ALL SELECT o_orderkey, o_custkey, k FROM x
              WHERE place <= 9000 - (SELECT sum(least(quota, n)) FROM f))
        SELECT o_orderkey, o_custkey FROM t ORDER BY k LIMIT 9000""",
)
def _(spark, folder):
    out = S.capped_entity_sample(_orders(spark, folder), "o_orderkey", "o_custkey", 9000, cap=12)
    return out.select("o_orderkey", "o_custkey")


@query(
    "important_class_sample",
    "S11",
    _drawn(
        "ym",
        """c AS (SELECT ym, count(*) AS n FROM o GROUP BY 1),
        f AS (SELECT ym, 3 + CASE WHEN row_number() OVER (ORDER BY n DESC, ym) <= 5
              THEN greatest(0, floor((600 - 3 * count(*) OVER ()) / 5)) ELSE 0 END AS quota FROM c)""",
        "o_orderkey, ym",
    ),
)
def _(spark, folder):
    return S.important_class_sample(_orders(spark, folder), "o_orderkey", "ym", 600, 3, 5).select("o_orderkey", "ym")


@query(
    "nested_balance",
    "S12",
    """WITH o AS (SELECT o_orderkey, o_orderpriority AS p, c_mktsegment AS s, year(o_orderdate)::INT AS y,
              md5(o_orderkey::VARCHAR || '|42') AS k FROM orders JOIN customer ON o_custkey = c_custkey),
        t(p, goal) AS (VALUES ('1-URGENT', 200), ('2-HIGH', 151)),
        c AS (SELECT p, s, y, count(*) AS n FROM o GROUP BY 1, 2, 3),
        fm AS (SELECT p, s, sum(n) AS n FROM c GROUP BY 1, 2),
        fg AS (SELECT fm.*, goal, sum(n) OVER (PARTITION BY p) <= coalesce(goal, 9e15) AS whole,
               round_even(n / sum(n) OVER (PARTITION BY p) * goal, 0) AS q FROM fm LEFT JOIN t USING (p)),
        fq AS (SELECT p, s, n AS firm_n, whole, q + CASE WHEN row_number() OVER (PARTITION BY p ORDER BY q DESC, n DESC, s) = 1
               THEN goal - sum(q) OVER (PARTITION BY p) ELSE 0 END AS firm FROM fg),
        yq AS (SELECT c.*, firm_n, whole, firm, round_even(n / sum(n) OVER (PARTITION BY p, s) * firm, 0) AS q FROM c JOIN fq USING (p, s)),
        yz AS (SELECT *, q + CASE WHEN row_number() OVER (PARTITION BY p, s ORDER BY q DESC, n DESC, y) = 1
               THEN firm - sum(q) OVER (PARTITION BY p, s) ELSE 0 END AS cell FROM yq),
        f AS (SELECT p, s, y, CASE WHEN whole OR firm_n <= firm THEN n ELSE greatest(0, least(cell, n)) END AS quota FROM yz),
        r AS (SELECT *, row_number() OVER (PARTITION BY p, s, y ORDER BY k) AS rn FROM o)
        SELECT o_orderkey, p, s, y FROM r JOIN f USING (p, s, y) WHERE rn <= quota""",
)
def _(spark, folder):
    firms = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("s"))
    orders = _orders(spark, folder).join(firms, "o_custkey").select("o_orderkey", "p", "s", "y")
    return S.nested_balance(orders, "o_orderkey", "p", "s", "y", {"1-URGENT": 200, "2-HIGH": 151})


@query(
    "downsample_to_smallest",
    "S13",
    """WITH l AS (SELECT doc_id, toxic, md5(doc_id::VARCHAR || '|42') AS k FROM labels),
        f AS (SELECT toxic, floor(min(count(*)) OVER () * 2.5::DOUBLE) AS quota FROM l GROUP BY 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY k) AS rn FROM l)
        SELECT doc_id, toxic FROM r JOIN f USING (toxic) WHERE rn <= quota""",
)
def _(spark, folder):
    return S.downsample_to_smallest(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 2.5)


CAPPED_BASE = f"""{DOCS}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM d WHERE lang = 'en') WHERE rn = 1),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) AS place FROM e)
              WHERE place <= CASE source WHEN 'src1' THEN 5 WHEN 'src2' THEN 8 ELSE 1000000000 END)"""


@query(
    "capped_and_refilled",
    "S14",
    f"""WITH {CAPPED_BASE},
        need AS (SELECT 800 - count(*) AS v FROM b),
        x AS (SELECT * FROM d WHERE source NOT IN ('src1', 'src2') AND text NOT IN (SELECT text FROM b)),
        xq AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) <=
                 greatest(1, (SELECT v FROM need) // (SELECT count(DISTINCT source) FROM x)) AS kept FROM x),
        xm AS (SELECT *, row_number() OVER (PARTITION BY kept ORDER BY k) AS place, count(*) FILTER (kept) OVER () AS held FROM xq)
        SELECT doc_id, source FROM b UNION ALL SELECT doc_id, source FROM xm WHERE (kept AND place <= (SELECT v FROM need))
          OR (NOT kept AND place <= (SELECT v FROM need) - held)""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text")
    english = keep_first(docs.filter("lang = 'en'"), ["text"], ["doc_id"], digest=True).drop("lang")
    base = S.cap_entities(english, "doc_id", "source", {"src1": 5, "src2": 8})
    full = S.refill(base, docs, "doc_id", "source", "text", ["src1", "src2"], 800)
    return S.shuffled(full, "doc_id").select("doc_id", "source")


@query(
    "supplement_new_entities",
    "S15",
    f"""WITH {DOCS}, m AS (SELECT d.* FROM d JOIN labels USING (doc_id) WHERE toxic = 1),
        x AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND text NOT IN (SELECT text FROM m)),
        u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM x) WHERE rn = 1),
        r AS (SELECT *, row_number() OVER (ORDER BY k) AS place FROM u)
        SELECT doc_id, source FROM m UNION ALL SELECT doc_id, source FROM r WHERE place <= 60 - (SELECT count(*) FROM m)""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    labels = table(spark, folder, "labels")
    matched = docs.join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    pool = docs.join(labels.select("doc_id"), "doc_id", "left_anti")
    return S.supplement_new_entities(matched, pool, "doc_id", "source", "text", 60).select("doc_id", "source")


USED = [(0, 60), (60, 100)]


def _primary(spark, folder):
    return cut_lineage(S.with_row_no(S.simple_sample(table(spark, folder, "documents").select("doc_id", "source"), "doc_id", 180), "doc_id"))


@query(
    "ledgered_batch",
    "S16 W5",
    """SELECT doc_id, row_no FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|42')) - 1 AS row_no FROM documents)
       WHERE row_no >= 100 AND row_no < 150""",
)
def _(spark, folder):
    primary = _primary(spark, folder)
    ledger = spark.createDataFrame(USED, "start bigint, end bigint")
    start, end = S.next_range(ledger, primary.count(), 50)
    return S.take_range(primary, start, end).select("doc_id", "row_no")


@query("ledger_status", "S16", "SELECT least(count(*), 180) AS total, 100::BIGINT AS used, least(count(*), 180) - 100 AS remaining, 100::BIGINT AS next_start FROM documents")
def _(spark, folder):
    ledger = spark.createDataFrame(USED, "start bigint, end bigint")
    return S.ledger_status(_primary(spark, folder).count(), ledger)


@query(
    "random_split",
    "S17",
    f"""WITH {ORDERS} SELECT o_orderkey, CASE WHEN rn <= 500 THEN 'test' WHEN rn <= 1000 THEN 'dev' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (ORDER BY k) AS rn FROM o)""",
)
def _(spark, folder):
    return S.random_split(_orders(spark, folder), "o_orderkey", 500, 500).select("o_orderkey", "split")


def _split_sql(head, source, key, cls):
    return f"""WITH {head},
        r AS (SELECT *, row_number() OVER (PARTITION BY {cls} ORDER BY k) AS rn FROM {source})
        SELECT {key}, {cls}, CASE WHEN rn <= test THEN 'test' WHEN rn <= test + dev THEN 'dev' ELSE 'train' END AS split
        FROM r JOIN f USING ({cls})"""


@query(
    "stratified_split_fixed",
    "S18",
    _split_sql(
        ORDERS
        + """, c AS (SELECT p, count(*) AS n FROM o GROUP BY 1),
        q AS (SELECT *, round_even(n / sum(n) OVER () * 500, 0)::BIGINT AS q FROM c),
        g AS (SELECT *, 500 - sum(q) OVER () AS gap, row_number() OVER (ORDER BY n DESC, p) AS big, row_number() OVER (ORDER BY n, p) AS small FROM q),
        t AS (SELECT p, n AS full_, least(n, q + CASE WHEN big <= gap THEN 1 WHEN small <= -gap AND q > 1 THEN -1 ELSE 0 END) AS test FROM g),
        q2 AS (SELECT p, test, full_ - test AS n, round_even((full_ - test) / sum(full_ - test) OVER () * 500, 0)::BIGINT AS q FROM t),
        g2 AS (SELECT *, 500 - sum(q) OVER () AS gap, row_number() OVER (ORDER BY n DESC, p) AS big, row_number() OVER (ORDER BY n, p) AS small FROM q2),
        f AS (SELECT p, test, least(n, q + CASE WHEN big <= gap THEN 1 WHEN small <= -gap AND q > 1 THEN -1 ELSE 0 END) AS dev FROM g2)""",
        "o", "o_orderkey", "p",
    ),
)
def _(spark, folder):
    return S.stratified_split(_orders(spark, folder), "o_orderkey", "p", 500, 500).select("o_orderkey", "p", "split")


@query(
    "stratified_split_80_10_10",
    "S19",
    _split_sql(
        ORDERS
        + """, c AS (SELECT ym, round_even(count(*) * 0.2::DOUBLE, 0)::BIGINT AS held FROM o GROUP BY 1),
        f AS (SELECT ym, held - ceil(held / 2) AS test, ceil(held / 2) AS dev FROM c)""",
        "o", "o_orderkey", "ym",
    ),
)
def _(spark, folder):
    return S.ratio_split(_orders(spark, folder), "o_orderkey", "ym").select("o_orderkey", "ym", "split")


@query(
    "split_with_every_class",
    "S20 S17",
    f"""WITH {DOCS}, s AS (SELECT *, row_number() OVER (ORDER BY k) AS rn FROM d),
        t AS (SELECT doc_id, source, k, CASE WHEN rn <= 20 THEN 'test' WHEN rn <= 40 THEN 'dev' ELSE 'train' END AS split FROM s),
        w AS (SELECT source, split FROM (SELECT DISTINCT source FROM t), (VALUES ('train'), ('dev'), ('test')) v(split)),
        m AS (SELECT * FROM w EXCEPT SELECT source, split FROM t),
        f AS (SELECT source, arg_min(doc_id, k) AS doc_id FROM t GROUP BY 1)
        SELECT doc_id, source, split FROM t UNION ALL SELECT f.doc_id, m.source, m.split FROM m JOIN f USING (source)""",
)
def _(spark, folder):
    split = S.random_split(table(spark, folder, "documents").select("doc_id", "source"), "doc_id", 20, 20)
    return S.cover_classes(split, "doc_id", "source")


@query(
    "merge_rare_classes",
    "S21",
    """SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) < 8 THEN 'other' ELSE o_custkey::VARCHAR END AS merged FROM orders""",
)
def _(spark, folder):
    return S.merge_rare(_orders(spark, folder), "o_custkey", 8).select("o_orderkey", "merged")


@query(
    "label_encoding",
    "S22",
    "SELECT doc_id, (dense_rank() OVER (ORDER BY source) - 1)::BIGINT AS code FROM documents",
)
def _(spark, folder):
    return S.encode_labels(table(spark, folder, "documents").select("doc_id", "source"), "source").select("doc_id", "code")


@query(
    "balanced_class_weights",
    "S23",
    """SELECT o_orderpriority AS label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6)::DOUBLE AS weight
       FROM orders GROUP BY 1""",
)
def _(spark, folder):
    return S.class_weights(table(spark, folder, "orders").select(F.col("o_orderpriority").alias("label")), "label")


@query(
    "oversample_small_classes",
    "S24",
    """WITH c AS (SELECT *, count(*) OVER (PARTITION BY quality) < 150 AS small FROM labels)
       SELECT doc_id, quality, unnest(range(0, CASE WHEN small THEN 6 ELSE 1 END))::INT AS copy_no FROM c""",
)
def _(spark, folder):
    return S.oversample(table(spark, folder, "labels").select("doc_id", "quality"), "quality")


@query(
    "sample_unseen_rows",
    "J5 S1",
    f"""WITH {DOCS} SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
        AND doc_id NOT IN (SELECT item_id FROM benchmark) ORDER BY k LIMIT 120""",
)
def _(spark, folder):
    earlier = [
        table(spark, folder, "labels").filter("quality = 0").select("doc_id"),
        table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id")),
    ]
    return S.simple_sample(not_in_earlier(table(spark, folder, "documents").select("doc_id"), earlier, ["doc_id"]), "doc_id", 120)


@query("seeded_order", "W2 S14", "SELECT doc_id, md5(doc_id::VARCHAR || '|42') AS key FROM documents ORDER BY key")
def _(spark, folder):
    return S.shuffled(table(spark, folder, "documents").select("doc_id", seeded_key("doc_id").alias("key")), "doc_id")
