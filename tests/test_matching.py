import random

import pytest
from pyspark.sql import functions as F

from casebook.operators import matching as J
from casebook.operators import predicates as P
from casebook.operators import ordering as O
from casebook.operators.resolve import resolve_names


def test_anti_join_keeps_null_keys_and_ignores_null_partners(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    keys = spark.createDataFrame([(2,), (None,)], "k int")
    assert sorted((r["k"] is None, r["k"]) for r in J.not_in(df, keys, ["k"]).collect()) == [(False, 1), (True, None)]


def test_overwrite_uses_the_last_update_even_if_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, None, 1)], "k int, v string, o int")
    got = {r["k"]: r["v"] for r in J.overwrite(df, new, "k", ["v"], [F.col("o")]).collect()}
    assert got == {1: "y", 2: "b", 3: None}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_scan_is_cut_to_about_the_wanted_ids(spark, tmp_path, kind):
    """Every wanted id passes, few others do, the range is pushed down, and the whole test is built-in."""
    facts = spark.range(200_000).select(F.col("id").cast(kind).alias("k"), (F.col("id") % 7).alias("v"))
    facts.write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    wanted = spark.range(50_000, 150_000, 97).select(F.col("id").cast(kind).alias("k")).unionByName(spark.createDataFrame([(None,), ("-5",)], "k string").select(F.col("k").cast(kind)))
    passed = facts.filter(J.maybe_wanted(wanted, "k"))
    n = wanted.filter("k IS NOT NULL").count() - 1
    assert passed.join(wanted, "k", "left_semi").count() == n
    assert passed.count() <= n + 0.05 * 200_000
    plan = passed._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(k" in plan and "Python" not in plan
    crowded = facts.filter(J.maybe_wanted(wanted, "k", 15))
    assert crowded.join(wanted, "k", "left_semi").count() == n
    got = J.lookup_features(wanted, facts, "k", ["v"], ["v"])
    assert got.count() == n + 2 and got.filter("v IS NULL").count() == 2
    none = wanted.limit(0)
    assert J.lookup_features(none, facts, "k", ["v"], ["v"]).count() == 0


def test_brackets_in_both_widths(spark):
    names = spark.createDataFrame([("甲公司（北京）",), ("乙 (x)  公司",), ("丙",), ("丁",), (None,)], "n string")
    targets = spark.createDataFrame([("甲公司",), ("乙 公司",), ("丙",), (None,)], "t string")
    got = {r["n"]: r["stage"] for r in J.two_stage_match(names, "n", targets, "t").collect()}
    assert got == {"甲公司（北京）": "brackets", "乙 (x)  公司": "brackets", "丙": "exact", "丁": None}


def test_containment(spark):
    rnd = random.Random(2)
    texts = [(i, "".join(rnd.choice("ab公") for _ in range(30))) for i in range(40)] + [(99, None)]
    names = ["ab", "公a", "aab公", "bbb", "zz", "", None, "ab", "b", "abaabb", "aabab公a", "ab公ab公ab"]
    df = spark.createDataFrame(texts, "id int, t string").repartition(3)
    listed = spark.createDataFrame([(n,) for n in names], "n string")
    got = sorted((r["id"], r["n"]) for r in J.containment_join(df, "t", listed, "n").collect())
    assert got == sorted((i, n) for i, t in texts if t for n in set(filter(None, names)) if n in t)


@pytest.mark.parametrize(("shard_chars", "part_chars"), [(J.SHARD_CHARS, J.PART_CHARS), (40, J.PART_CHARS), (7, 200)])
def test_containment_over_shards_and_parts(spark, shard_chars, part_chars):
    """One broadcast automaton, several shards, several shards and parts: the same rows, columns and copies."""
    rnd = random.Random(9)
    texts = [(i // 2, "".join(rnd.choice("ab公\U0001f600 ") for _ in range(rnd.randint(0, 60))), i) for i in range(60)] + [(1, None, 0), (2, "ab" * 4000, 1)]
    names = {"".join(rnd.choice("ab公\U0001f600") for _ in range(rnd.randint(1, 4))) for _ in range(40)}
    df = spark.createDataFrame(texts + texts[:9], "id int, t string, k int").repartition(3)
    listed = spark.createDataFrame([(n,) for n in [*names, *names, "", None]], "n string")
    found = J.containment_join(df, "t", listed, "n", shard_chars, part_chars)
    assert found.columns == ["id", "t", "k", "n"]
    assert sorted(map(tuple, found.collect())) == sorted((i, t, k, n) for i, t, k in texts + texts[:9] if t for n in names if n in t)
    none = spark.createDataFrame([], "n string")
    assert J.containment_join(df, "t", none, "n", shard_chars, part_chars).count() == 0
    assert J.containment_join(df.limit(0), "t", listed, "n", shard_chars, part_chars).count() == 0


@pytest.mark.parametrize(("threshold", "cells", "per_task"), [(0.75, J.TRIE_CELLS, J.NAMES_PER_TASK), (0.6, 40, 3), (0.34, 500, 20), (0.9, 100, 7)])
def test_fuzzy_best_match_in_small_tries(spark, threshold, cells, per_task):
    from tests.test_near_dup import slow

    rnd = random.Random(int(threshold * 100))
    base = ["".join(rnd.choice("abc公") for _ in range(rnd.choice([1, 2, 5, 9, 17, 30]))) for _ in range(45)]
    words = base + ["".join(c for c in b if rnd.random() > 0.15) + rnd.choice(["", "x"]) for b in base] + [f"firm {i:03d}" for i in range(30)]
    targets = rnd.sample(words, 90) + [None, ""]
    best = {}
    for n in {w for w in words if w}:
        scored = [(round(slow(n, t) / max(len(n), len(t)), 9), t) for t in set(targets) - {None, "", n}]
        scored = [x for x in scored if 1 - x[0] >= threshold - 1e-9]
        if scored:
            best[n] = min(scored)[1]
    a = spark.createDataFrame([(n,) for n in words + [None, ""]], "n string")
    b = spark.createDataFrame([(t,) for t in targets], "t string")
    got = J.fuzzy_best_match(a, "n", b, "t", threshold, cells, per_task).collect()
    assert {r["n"]: r["t"] for r in got} == best and len(got) == len(best)


def test_fuzzy_best_match_equals_brute_force(spark):
    from tests.test_near_dup import slow

    rnd = random.Random(4)
    base = ["".join(rnd.choice("abc公司") for _ in range(rnd.randint(1, 14))) for _ in range(60)]
    names = base[:40] + [b[:-1] + "x" for b in base[20:]]
    targets = base[20:] + [b + "z" for b in base[:15]]
    want = {}
    for n in set(names):
        scored = [(1 - slow(n, t) / max(len(n), len(t)), t) for t in set(targets) if t != n]
        scored = [(s, t) for s, t in scored if s >= 0.75 - 1e-9]
        if scored:
            best = max(s for s, _ in scored)
            want[n] = min(t for s, t in scored if abs(s - best) < 1e-9)
    a = spark.createDataFrame([(n,) for n in names], "n string")
    b = spark.createDataFrame([(t,) for t in targets], "t string")
    assert {r["n"]: r["t"] for r in J.fuzzy_best_match(a, "n", b, "t").collect()} == want


def test_names_one_edit_away_need_no_trie(spark, monkeypatch):
    """Changed, added and dropped characters at any place, copies of the name itself, and long and empty names."""

    def refuse(*args):
        raise AssertionError("a trie was walked")

    monkeypatch.setattr(J, "_best_in_trie", refuse)
    firms = [f"Customer#{i:06d}" for i in range(0, 300)]
    names = firms + ["abcdefgh", "bcdefghij", "公司甲乙丙丁", "", None, "aaaaaaaa"]
    targets = firms + ["abcdefghi", "xabcdefgh", "abcdefzh", "bcdefghi", "公司乙丙丁", "aaaaaaa", "aaaaaaaaa", None, ""]
    a, b = (spark.createDataFrame([(w,) for w in words], "w string") for words in (names, targets))
    got = {r["n"]: (r["t"], r["score"]) for r in J.fuzzy_best_match(a.toDF("n"), "n", b.toDF("t"), "t").collect()}
    want = {f: (next(t for t in firms if sum(x != y for x, y in zip(f, t)) == 1), round(1 - 1 / 15, 6)) for f in firms}
    want |= {"abcdefgh": ("abcdefghi", 0.888889), "bcdefghij": ("bcdefghi", 0.888889), "公司甲乙丙丁": ("公司乙丙丁", 0.833333), "aaaaaaaa": ("aaaaaaaaa", 0.888889)}
    assert got == want


def test_long_names_walk_tries(spark):
    long = "ab" * 40
    a, b = spark.createDataFrame([(long,), ("ab" * 32,)], "n string"), spark.createDataFrame([(long[1:],), (long,), ("ab" * 32 + "c",)], "t string")
    got = {r["n"]: r["t"] for r in J.fuzzy_best_match(a, "n", b, "t").collect()}
    assert got == {long: long[1:], "ab" * 32: "ab" * 32 + "c"}


def test_texts_are_not_copied_for_each_name(spark, monkeypatch):
    """What a task of the containment join hands back has one row a text."""
    seen = []

    def spy(texts, text, words, find, schema, *sizes):
        out = over(texts, text, words, find, schema, *sizes)
        seen.append(out[0])
        return out

    over = J.over_automata
    monkeypatch.setattr(J, "over_automata", spy)
    texts = spark.createDataFrame([(1, "abcdef"), (2, "xyz"), (2, "abc"), (3, None)], "id int, t string")
    names = spark.createDataFrame([(n,) for n in ("a", "b", "c", "abc", "q")], "n string")
    got = J.containment_join(texts, "t", names, "n")
    assert sorted((r["id"], r["n"]) for r in got.collect()) == sorted((i, n) for i in (1, 2) for n in ("a", "b", "c", "abc"))
    assert seen[0].count() == 2


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.9])
def test_rare_grams_lose_no_pair(spark, threshold):
    from tests.test_near_dup import slow

    rnd = random.Random(7)
    base = ["firm#" + "".join(rnd.choice("0123") for _ in range(rnd.randint(0, 9))) for _ in range(50)] + ["a", "ab", "b", "firm"]
    words = sorted(set(base + [b[:2] + "x" + b[3:] for b in base]))
    frame = spark.createDataFrame([(w,) for w in words], "n string")
    pairs = {(r["n"], r["t"]) for r in J._rare_gram_pairs(frame, "n", frame.withColumnRenamed("n", "t"), "t", threshold).collect()}
    want = {(x, y) for x in words for y in words if 1 - slow(x, y) / max(len(x), len(y)) >= threshold - 1e-9}
    assert want <= pairs


def test_cascade_rules(spark):
    dictionary = spark.createDataFrame(
        [("中国建设银行", 1, 1), ("美团借钱", 2, 2), ("招联消费金融", 3, 3), ("招联", 4, 4), ("花呗", 5, 5)], "entry string, code int, ord int"
    )
    aliases = spark.createDataFrame([("蚂蚁", "花呗"), ("借呗", "花呗")], "alias string, canonical string")
    rows = [
        ("alias", "蚂蚁", "x", "处理中"), ("bank", "建行信用卡", "x", None), ("brand", "美团", "催收电话", ""),
        ("brand_other", "美团外卖店", "送餐慢", ""), ("part_of_entry", "联消费", None, ""), ("holds_entry", "招联好期贷", "", ""),
        ("desk", "借呗客服", "", ""), ("none", "某店", "", ""), ("note", "蚂蚁 商家只有匹配成功后", "", ""),
        ("open", "某店", "", "待分配商家"), ("empty", "", "", ""), ("null", None, "", ""),
    ]
    df = spark.createDataFrame(rows, "id string, name string, text string, progress string")
    out = resolve_names(df, "name", "text", "progress", dictionary, aliases)
    got = {r["id"]: (r["canonical"], r["code"], r["status"]) for r in out.collect()}
    assert got == {
        "alias": ("花呗", 5, 2), "bank": ("中国建设银行", 1, 2), "brand": ("美团借钱", 2, 2), "brand_other": ("美团外卖店", -1, 1),
        "part_of_entry": ("联消费", 3, 2), "holds_entry": ("招联", 4, 2), "desk": ("花呗", 5, 2), "none": ("某店", -1, 1),
        "note": ("花呗", 5, 3), "open": ("某店", -2, 0), "empty": ("", -1, 1), "null": ("", -1, 1),
    }


def test_null_is_false_in_predicates(spark):
    df = spark.createDataFrame([(1, "a.c"), (2, "abc"), (3, None)], "id int, t string")
    assert [r["id"] for r in P.keyword_filter(df, "t", ["A.C"]).collect()] == [1]
    kept, rejected = P.kept_and_rejected(df, F.col("t").contains("b"))
    assert [r["id"] for r in kept.collect()] == [2] and {r["id"] for r in rejected.collect()} == {1, 3}
    with pytest.raises(ValueError):
        P.require_columns(df, ["id", "missing"])


def test_blocks_are_dealt_by_size(spark):
    rows = [(b,) for b, n in (("a", 9), ("b", 5), ("c", 4), ("d", 1), ("e", 7)) for _ in range(n)]
    got = {r["b"]: r["bin"] for r in O.pack_blocks(spark.createDataFrame(rows, "b string"), "b", 2).collect()}
    assert got == {"a": 0, "e": 1, "b": 1, "c": 0, "d": 0}


@pytest.mark.parametrize("bins", [1, 3, 20])
def test_blocks_go_to_the_least_loaded_bin(spark, bins):
    """The rule in plain Python: names in order, always the first of the emptiest bins."""
    rnd = random.Random(bins)
    names = [rnd.choice("abé公") + str(i) for i in range(70)]
    sizes = {n: rnd.choice([1, 1, 2, 5, 400]) for n in names}
    rows = [(n, i) for n, size in sizes.items() for i in range(size)] + [(None, 1)] * 30
    rnd.shuffle(rows)
    loads, want = [0] * bins, {}
    for n in sorted(sizes):
        want[n] = loads.index(min(loads))
        loads[want[n]] += sizes[n]
    got = O.least_loaded_blocks(spark.createDataFrame(rows, "b string, v int").repartition(5), "b", bins).collect()
    assert len(got) == sum(sizes.values()) and {(r["b"], r["bin"]) for r in got} == set(want.items())
    empty = spark.createDataFrame([], "b string")
    assert O.least_loaded_blocks(empty, "b", bins).count() == 0


def test_parts_have_the_exact_ceiling_size(spark):
    df = spark.range(10).repartition(4)
    sizes = {r["part"]: r["count"] for r in O.contiguous_parts(df, ["id"], 4).groupBy("part").count().collect()}
    assert sizes == {1: 3, 2: 3, 3: 3, 4: 1}
    assert [r["id"] for r in O.slice_rows(df, ["id"], 8, 50).orderBy("id").collect()] == [8, 9]
    assert O.slice_rows(df, ["id"], 10, 12).count() == 0
