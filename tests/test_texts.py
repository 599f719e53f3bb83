import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from casebook.functions import dates as D
from casebook.functions import text as X
from casebook.operators import answers as M
from casebook.operators import clauses as C
from casebook.operators import lexicon as L
from casebook.operators import stats as A


def column(spark, expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["o"] for r in df.select("i", expr(F.col("c")).alias("o")).orderBy("i").collect()]


def test_names_and_numbers(spark):
    assert column(spark, X.chinese_number, ["十", "二十一", "二〇二三", "12", "三十", "x", None]) == [10, 21, 2023, 12, 30, None, None]
    assert column(spark, lambda c: X.pad_code(c), ["1", "1234567", None]) == ["000001", "1234567", None]
    assert column(spark, X.drop_salutations, ["请问董事长 您，你好", "请问好"]) == ["，你好", "请问好"]
    assert column(spark, X.drop_greetings, ["董事长您好，请问 A", "您好！", "问题好吗"]) == ["请问 A", "", "问题好吗"]
    assert column(spark, lambda c: X.id_from_url(c), ["http://a/12345678901/x", "http://b"]) == ["12345678901", "N/A"]


def test_dates(spark):
    day = datetime.date(2020, 3, 7)
    got = column(spark, D.parse_any_date, ["2020-03-07", "2020/03/07", "2020年03月07日", "2020.03.07", "20200307", "x", "", None])
    assert got == [day] * 5 + [None] * 3
    near = ["公司董事会于 2020 年 3 月 7 日召开", "2020年3月7日公司董事会", "董事会二〇二〇年三月七日", "股东 2020年3月7日"]
    assert column(spark, D.meeting_date, near) == [day, day, day, None]
    assert column(spark, D.year_in_text, ["2021-1-1", "1999/1/1", "2031-1-1", "abc"]) == [2021, None, None, None]
    clock = column(spark, D.parse_clock, ["2020年01月02日 03:04", "bad"])
    assert clock == [datetime.datetime(2020, 1, 2, 3, 4), None]


def test_answers(spark):
    verdict = lambda c: M.yes_no_answer(c)["verdict"]
    reason = lambda c: M.yes_no_answer(c)["reason"]
    texts = [" 是，理由：甲", "否。乙", "不清楚", ""]
    assert column(spark, verdict, texts) == ["是", "否", "", ""]
    assert column(spark, reason, texts) == ["甲", "乙", "不清楚", ""]
    shapes = ['{"f": true, "r": "x"}', '```json\n{"f": false, "r": "y"}\n```', "说明 {'f': true, 'r': 'z',} 完", "是的", "{broken", None, '{"f": 1}']
    assert column(spark, lambda c: M.json_answer(c, "f", "r")["flag"], shapes) == [True, False, True, True, False, False, True]
    assert column(spark, lambda c: M.json_answer(c, "f", "r")["reason"], shapes) == ["x", "y", "z", "是的", "{broken", "API调用失败", "无理由提供"]
    assert column(spark, M.verdict_by_words, ["不是。理由：是", "有关，理由：无关", "看情况"]) == ["否", "是", "未完全识别"]
    blocks = ["**分类序号：** 1、23 **理由：** 第100条", "分类：4，56 因为", "见 7 和 890"]
    assert column(spark, lambda c: M.code_lists(c)["one_digit"], blocks) == ["1", "4", "7"]
    assert column(spark, lambda c: M.code_lists(c)["two_digit"], blocks) == ["23", "56", ""]
    assert column(spark, lambda c: M.code_lists(c)["three_digit"], blocks) == ["", "", "890"]
    assert column(spark, lambda c: M.code_lists(c)["reason"], blocks) == ["第100条", "因为", "见 7 和 890"]


def test_revision_titles(spark):
    titles = ["章程（2020年修订）", "章程(修正稿)", "章程修订稿", "章程修订案", "章程", "修订说明"]
    assert column(spark, C.is_revision_draft, titles) == [True, True, True, True, False, False]


def test_clauses_in_sequence(spark):
    text = "\n".join([
        "公告", "第一条 公司住所为北京市朝阳区", "邮编一", "第一条 公司住所为上海市浦东新区某路一号",
        "修改后增加如下新的条款内容请见以下文字说明", "第二条 公司的经营范围为软件开发", "（修订稿）", "第三条 不再读取的内容文字",
    ])
    df = spark.createDataFrame([(1, text), (2, None)], "id int, t string")
    got = [(r["original"], r["modified"], r["category"]) for r in C.clause_changes_in_sequence(df, "id", "t").orderBy("change_no").collect()]
    assert got[0] == ("第一条 公司住所为北京市朝阳区邮编一", "", "")
    assert got[1] == ("", "第一条 公司住所为上海市浦东新区某路一号", "公司基本信息变更")
    assert not any("第三条" in (o + m) for o, m, _ in got)


def test_two_column_table(spark):
    rows = [
        (1, 0, ["公告", None]), (1, 1, ["序号", "", "修订前", "修订后"]), (1, 2, ["1", "旧文字很长的内容说明一二三四", "新文字很长的内容说明一二三四"]),
        (1, 3, ["2", "2021", "2022"]), (1, 4, ["3", "旧", None]),
    ]
    df = spark.createDataFrame(rows, "id int, n int, cells array<string>")
    got = [(r["n"], r["original"], r["modified"]) for r in C.two_column_pairs(df, "id", "n", "cells").collect()]
    assert got == [(2, "旧文字很长的内容说明一二三四", "新文字很长的内容说明一二三四")]


def test_scores_do_not_depend_on_chunks_or_rows(spark):
    words = ["risk", "topic", "aa", "bb", "cc"]
    stream = [words[(i * i + 3 * i) % 5] for i in range(200)]
    whole = spark.createDataFrame([(1, 0, " ".join(stream)), (2, 0, "1 2")], "d int, o int, t string")
    cut = spark.createDataFrame([(1, i, " ".join(stream[i * 7 : i * 7 + 7])) for i in range(29)] + [(2, 0, None)], "d int, o int, t string")
    near = sum(
        stream.count("topic") / 200 * sum(w == "risk" for w in stream[max(0, i - 10) : i + 11])
        for i, w in enumerate(stream) if w == "topic"
    )
    for df in (whole, cut.repartition(5)):
        for chunk in (1000, 15):
            got = {r["d"]: r for r in L.lexicon_scores(df, ["d"], ["o"], "t", ["topic"], ["risk"], chunk=chunk).collect()}
            assert got[1]["tokens"] == 200 and abs(got[1]["joint_score"] - near) < 1e-8
            assert (got[2]["topic_score"], got[2]["joint_score"]) == (0.0, 0.0)


def test_joined_texts_and_their_pieces(spark):
    df = spark.createDataFrame([("a", i, f"w{i:03d}") for i in range(50)] + [("b", 0, None), ("c", 0, "x")], "k string, o int, t string")
    words = [f"w{i:03d}" for i in range(50)]
    got = {r["k"]: (r["t"], r["pieces"]) for r in A.concat_texts(df, ["k"], ["o"], "t").collect()}
    assert got == {"a": (" ".join(words), 50), "c": ("x", 1)}
    rows = A.ordered_pieces(df, ["k"], ["o"], "t").orderBy("k", "piece_no").collect()
    assert [(r["k"], r["piece_no"], r["t"]) for r in rows] == [("a", i + 1, w) for i, w in enumerate(words)] + [("c", 1, "x")]


def test_longest_match_in_chinese(spark):
    df = spark.createDataFrame([(1, "供应链风险管理ABC1 高"), (2, None), (3, "xyAB风险1"), (4, "ABab"), (5, "")], "id int, t string")
    words = spark.createDataFrame([(w,) for w in ("供应", "供应链", "风险", "管理层", "AB", "", None)], "w string")
    got = {r["id"]: r["tokens"] for r in L.dictionary_tokens(df, "t", words, "w").collect()}
    assert got == {
        1: ["供应链", "风险", "管", "理", "AB", "C1", "高"], 2: None, 3: ["xyAB", "风险", "1"], 4: ["AB", "ab"], 5: [],
    }
    none = L.dictionary_tokens(df, "t", words.limit(0), "w")
    assert {r["id"]: r["tokens"] for r in none.collect()}[1] == ["供", "应", "链", "风", "险", "管", "理", "ABC1", "高"]


def test_sketches_merge_to_the_counts_of_the_whole(spark):
    """Merged parts give what one sketch of all rows gives, within the stated error; nulls do not count."""
    rows = spark.range(40_000).select(
        (F.col("id") % 13_000).alias("a"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("d"),
        F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("s"), (F.col("id") % 24).alias("month"),
    )
    cols = ["a", "d", "s"]
    merged = A.merged_distinct_counts(A.distinct_sketches(rows, ["month"], cols), [], cols).first()
    whole = A.merged_distinct_counts(A.distinct_sketches(rows, [], cols), [], cols).first()
    for got in (merged, whole):
        assert all(abs(got[c] - n) <= 0.052 * n for c, n in (("a", 13_000), ("d", 700), ("s", 20_000)))
    empty = A.merged_distinct_counts(A.distinct_sketches(rows.limit(0), ["month"], cols), ["month"], cols)
    assert empty.count() == 0


def test_best_path_where_the_longest_word_is_wrong(spark):
    """研究|生命|起源, not 研究生|命|起源; and 南京市|长江大桥, not 南京|市长|江大桥."""
    counts = {"研究": 900, "研究生": 150, "生命": 800, "命": 60, "起源": 300, "南京": 500, "南京市": 400, "市长": 450, "长江大桥": 200, "江": 90, "大桥": 300, "AB": 5}
    words = spark.createDataFrame([*counts.items(), ("起", 0), ("", 5), (None, 5)], "w string, c long")
    df = spark.createDataFrame([(1, "研究生命起源"), (2, "南京市长江大桥"), (3, None), (4, "ABxy1 起 AB"), (5, ""), (1, "研究生命起源")], "id int, t string")
    got = [(r["id"], r["tokens"]) for r in L.best_path_tokens(df, "t", words, "w", "c").orderBy("id").collect()]
    assert got == [
        (1, ["研究", "生命", "起源"]), (1, ["研究", "生命", "起源"]), (2, ["南京市", "长江大桥"]), (3, None), (4, ["ABxy1", "起", "AB"]), (5, []),
    ]
    none = {r["id"]: r["tokens"] for r in L.best_path_tokens(df, "t", words.limit(0), "w", "c").collect()}
    assert none[1] == list("研究生命起源") and none[4] == ["ABxy1", "起", "AB"] and none[3] is None


@pytest.mark.parametrize(("shard_chars", "part_chars"), [(10**6, 10**6), (9, 40)])
def test_best_path_equals_all_paths(spark, shard_chars, part_chars):
    """Against every way to cut short texts, with one automaton and with several over parts of the texts."""
    rnd = random.Random(8)
    counts = {"".join(rnd.choice("甲乙丙aB1") for _ in range(rnd.randint(1, 4))): rnd.randint(1, 60) for _ in range(40)}
    texts = ["".join(rnd.choice("甲乙丙丁aB1 ") for _ in range(rnd.randint(0, 11))) for _ in range(60)]
    total = sum(counts.values())
    unknown = round(1e6 * math.log(total))
    cost = {w: round(1e6 * (math.log(total) - math.log(c))) for w, c in counts.items()}

    def paths(t, i):
        if i == len(t):
            yield 0, (), ()
            return
        end = re.compile("[A-Za-z0-9]*").match(t, i).end()
        steps = {(t[i:end] if end > i else t[i], 0 if t[i] == " " else unknown)} | {(w, c) for w, c in cost.items() if t.startswith(w, i)}
        for w, c in steps:
            for rest, sizes, found in paths(t, i + len(w)):
                yield c + rest, (-len(w), *sizes), (w, *found)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    words = spark.createDataFrame(list(counts.items()), "w string, c long")
    got = {r["id"]: r["tokens"] for r in L.best_path_tokens(df, "t", words, "w", "c", "tokens", shard_chars, part_chars).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [w for w in min(paths(t, 0))[2] if w.strip()], t


def test_section_skips_titles_in_running_text(spark):
    text = "见董事会报告。\n董事会报告\n经营良好 董事会报告\n重要事项\n无"
    assert column(spark, lambda c: L.section_between(c, ["董事会报告"], ["重要事项"]), [text, "无标题"]) == ["\n经营良好 \n", None]
