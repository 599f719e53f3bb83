import random

from pyspark.sql import functions as F

from casebook.functions import ranking as R


def _rows(n=600, seed=3):
    rnd = random.Random(seed)
    out = [(i, rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, *range(40)])) for i in range(n)]
    rnd.shuffle(out)
    return out


def _key(r):
    return (r[2] is not None, r[2] or 0, r[0])


def test_numbers_in_many_buckets_match_a_plain_sort(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id bigint, g string, v int").repartition(7)
    got = {r["id"]: r["rn"] for r in R.numbered(df, ["v", "id"], rows_per_bucket=20).collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=_key))}


def test_numbers_within_groups_including_the_null_group(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id bigint, g string, v int").repartition(5)
    got = {r["id"]: r["rn"] for r in R.numbered(df, ["v", "id"], groups=["g"], rows_per_bucket=20).collect()}
    want = {}
    for g in ("a", "b", None):
        for i, r in enumerate(sorted((r for r in rows if r[1] == g), key=_key)):
            want[r[0]] = i + 1
    assert got == want


def test_running_totals_are_exact(spark):
    rows = [(i, "ab"[i % 2], (i * 7) % 13) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, g string, v int").repartition(6)
    got = {r["id"]: r["t"] for r in R.running_total(df, ["g"], ["id"], F.col("v"), "t", rows_per_bucket=16).collect()}
    for i, g, _ in rows:
        assert got[i] == sum(v for j, h, v in rows if h == g and j < i)


def test_values_at_ranks_past_the_end_are_left_out(spark):
    df = spark.range(100).repartition(9)
    bucket = R.range_bucket(df, ["id"], rows_per_bucket=10)
    assert R.values_at_ranks(df, ["id"], [0, 1, 50, 100, 101], bucket) == {1: (0,), 50: (49,), 100: (99,)}


def test_cutoffs_in_one_hot_group(spark):
    df = spark.range(3000).select(F.lit("hot").alias("g"), R.seeded_key("id").alias("k"))
    targets = spark.createDataFrame([("hot", 0, 1), ("hot", 1, 1700), ("hot", 2, 3000), ("hot", 3, 4000)], "g string, _step int, _upto bigint")
    got = {r["_step"]: r["_cut"] for r in R.cutoffs(df, ["g"], targets, "k").collect()}
    keys = sorted(r["k"] for r in df.collect())
    assert got == {0: keys[0], 1: keys[1699], 2: keys[-1], 3: None}


def test_bounds_are_searched_by_halves(spark):
    """Many bounds, equal ones and nulls among them: right buckets, and no filter over all bounds for each row."""
    rows = _rows(400)
    df = spark.createDataFrame(rows, "id bigint, g string, v int").repartition(3)
    for order in (["v", "id"], ["v"]):
        bucket = R.range_bucket(df, order, rows_per_bucket=3)
        held = df.select("id", "v", bucket.alias("b"))
        assert "filter(" not in held._jdf.queryExecution().analyzed().toString()
        placed = sorted(((r["v"] is not None, r["v"] or 0) + ((r["id"],) if len(order) == 2 else ()), r["b"]) for r in held.collect())
        assert [b for _, b in placed] == sorted(b for _, b in placed) and len({b for _, b in placed}) > 30
        bounds = sorted((v is not None, v or 0) + tuple(rest) for v, *rest in R._bounds(df, order, 134))
        assert all(b == sum(x <= key for x in bounds) for key, b in placed)
