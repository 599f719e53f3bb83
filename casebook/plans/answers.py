"""Stored answers. The test tables hold none, so turns and events are worded as answers first."""

from pyspark.sql import functions as F

from casebook.functions.runtime import table
from casebook.operators import answers as M
from casebook.plans.registry import query

TURN_ANSWER = """a AS (SELECT conv_id, turn, role, CASE role WHEN 'user' THEN '是，理由：' || text WHEN 'assistant' THEN '否。 ' || text ELSE text END AS ans FROM conversations)"""


def _turns(spark, folder, yes="是，理由：", no="否。 "):
    role, text = F.col("role"), F.col("text")
    worded = F.when(role == "user", F.concat(F.lit(yes), text)).when(role == "assistant", F.concat(F.lit(no), text)).otherwise(text)
    return table(spark, folder, "conversations").select("conv_id", "turn", "role", "text", worded.alias("ans"))


@query(
    "yes_no_answers",
    "M1",
    rf"""WITH {TURN_ANSWER}, t AS (SELECT conv_id, turn, regexp_replace(ans, '^\s+|\s+$', '', 'g') AS s FROM a)
         SELECT conv_id, turn, regexp_extract(s, '^(是|否)', 1) AS verdict,
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^(是|否)', ''), '^\s+', ''), '^[，。：；、\s]+', ''), '^[^：]+：', '') AS reason FROM t""",
)
def _(spark, folder):
    return _turns(spark, folder).select("conv_id", "turn", M.yes_no_answer(F.col("ans")).alias("a")).select("conv_id", "turn", "a.*")


@query(
    "bold_yes_no_answers",
    "M1",
    r"""WITH t AS (SELECT conv_id, turn, regexp_replace(CASE role WHEN 'user' THEN '**是** 理由：' ELSE '是 ' END || text, '^\s+|\s+$', '', 'g') AS s FROM conversations)
        SELECT conv_id, turn, regexp_extract(s, '^\*\*(是|否)\*\*', 1) AS verdict, regexp_replace(regexp_replace(regexp_replace(
          regexp_replace(s, '^\*\*(是|否)\*\*', ''), '^\s+', ''), '^[，。：；、\s]+', ''), '^[^：]+：', '') AS reason FROM t""",
)
def _(spark, folder):
    lead = F.when(F.col("role") == "user", "**是** 理由：").otherwise("是 ")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.concat(lead, F.col("text")).alias("ans"))
    return rows.select("conv_id", "turn", M.yes_no_answer(F.col("ans"), bold=True).alias("a")).select("conv_id", "turn", "a.*")


@query(
    "short_answers",
    "M1",
    r"""WITH t AS (SELECT conv_id, turn, regexp_replace(CASE role WHEN 'user' THEN '是：' WHEN 'assistant' THEN '否， ' ELSE '' END || text, '^\s+|\s+$', '', 'g') AS s FROM conversations),
        m AS (SELECT *, nullif(regexp_extract(s, '^(是|否)[：:，、\s]\s*([^\n]*)$', 1), '') AS v,
              regexp_replace(regexp_extract(s, '^(是|否)[：:，、\s]\s*([^\n]*)$', 2), '\s+$', '') AS r FROM t)
        SELECT conv_id, turn, coalesce(v, '未知') AS verdict, CASE WHEN v IS NULL THEN substr(s, 1, 30)
          WHEN length(r) > 30 THEN substr(r, 1, 27) || '...' ELSE r END AS reason FROM m""",
)
def _(spark, folder):
    rows = _turns(spark, folder, "是：", "否， ")
    return rows.select("conv_id", "turn", M.short_answer(F.col("ans")).alias("a")).select("conv_id", "turn", "a.*")


@query(
    "early_answers",
    "M1",
    r"""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '判断：是。' WHEN 'assistant' THEN '否：' ELSE '' END || text AS s FROM conversations),
        m AS (SELECT *, nullif(regexp_extract(s, '^(是|否)[：:]\s*([^\n]+)$', 1), '') AS v, substr(s, 1, 10) AS h FROM t)
        SELECT conv_id, turn, coalesce(v, CASE WHEN contains(h, '是') THEN '是' WHEN contains(h, '否') THEN '否' END) AS verdict,
          CASE WHEN v IS NOT NULL THEN regexp_extract(s, '^(是|否)[：:]\s*([^\n]+)$', 2)
               WHEN contains(h, '是') THEN trim(substr(s, instr(s, '是') + 1), ' ') WHEN contains(h, '否') THEN trim(substr(s, instr(s, '否') + 1), ' ') ELSE s END AS reason FROM m""",
)
def _(spark, folder):
    rows = _turns(spark, folder, "判断：是。", "否：")
    return rows.select("conv_id", "turn", M.early_answer(F.col("ans")).alias("a")).select("conv_id", "turn", "a.*")


@query(
    "exact_flags",
    "M1",
    "SELECT conv_id, turn, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 ELSE -1 END AS flag FROM conversations",
)
def _(spark, folder):
    answer = F.when(F.col("role") == "user", " 是").when(F.col("role") == "assistant", "否 ").otherwise("是的")
    return table(spark, folder, "conversations").select("conv_id", "turn", M.exact_flag(answer).alias("flag"))


def _events(spark, folder):
    """Answers in every shape: plain, fenced, wrapped, repairable and without JSON."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    flag = F.when(k.cast("int") > 50, "true").otherwise("false")
    plain = F.concat(F.lit('{"is_related": '), flag, F.lit(', "reason": "k'), k, F.lit('"}'))
    shaped = (
        F.when(kind == "view", plain)
        .when(kind == "click", F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(kind == "error", F.concat(F.lit("Answer: "), plain, F.lit(" done")))
        .when(kind == "signup", F.concat(F.lit("{is_related: "), flag, F.lit(", 'reason': 'k"), k, F.lit("',}")))
        .otherwise(F.concat(F.lit("是 k"), k))
    )
    return table(spark, folder, "events").select("event_id", "event_type", "props", shaped.alias("ans"))


EVENT_KEY = "k AS (SELECT event_id, event_type, (props->>'$.k')::INT AS k FROM events)"


@query(
    "json_answers",
    "M2",
    f"""WITH {EVENT_KEY} SELECT event_id, event_type = 'purchase' OR k > 50 AS flag,
        CASE WHEN event_type = 'purchase' THEN '是 k' || k ELSE 'k' || k END AS reason FROM k""",
)
def _(spark, folder):
    rows = _events(spark, folder)
    return rows.select("event_id", M.json_answer(F.col("ans"), "is_related", "reason").alias("a")).select("event_id", "a.*")


@query(
    "rescued_answers",
    "M2",
    f"""WITH {EVENT_KEY} SELECT event_id, CASE WHEN k > 50 THEN true WHEN k > 20 THEN false END AS related,
        CASE WHEN k % 7 > 0 THEN 'ads ' || k % 7 END AS category, 'k' || k AS reason,
        CASE k % 4 WHEN 0 THEN '高' WHEN 1 THEN '中' WHEN 2 THEN '低' END AS confidence FROM k""",
)
def _(spark, folder):
    # Answers cut off in the middle of their JSON.
    k = F.get_json_object("props", "$.k").cast("int")
    flag = F.when(k > 50, "true").when(k > 20, "false").otherwise("maybe")
    category = F.when(k % 7 > 0, F.concat(F.lit(', "Category": "ads '), (k % 7).cast("string"), F.lit('"'))).otherwise("")
    level = F.when(k % 4 == 0, "高").when(k % 4 == 1, "中").when(k % 4 == 2, "低").otherwise("?")
    answer = F.concat(
        F.lit('{"related": '), flag, category, F.lit(", reason: k"), k.cast("string"), F.lit(", 'confidence': '"), level, F.lit("', ["),
    )
    rows = table(spark, folder, "events").select("event_id", M.rescued_fields(answer).alias("a"))
    return rows.select("event_id", "a.*")


@query(
    "validated_classes",
    "M3",
    f"""WITH {EVENT_KEY} SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'Skip' WHEN event_type = 'signup' THEN 'Error'
        WHEN k % 3 = 0 THEN 'A' WHEN k % 3 = 1 THEN 'B' ELSE 'Error' END AS class FROM k""",
)
def _(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    letter = F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("C")
    answer = F.when(F.col("event_type") == "signup", F.lit("no json")).otherwise(
        F.concat(F.lit('x {"classification": "'), letter, F.lit('", "reason": "r"} y'))
    )
    source = F.when(F.col("event_type") == "purchase", "  ").otherwise("fact")
    value = M.validated_class(answer, source, "classification", "reason", ["A", "B"])
    return table(spark, folder, "events").select("event_id", value.alias("class"))


@query(
    "code_list_answers",
    "M4",
    """WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_custkey % 1000 AS c, o_orderkey % 90 + 10 AS d FROM orders)
       SELECT o_orderkey, concat_ws(',', CASE WHEN s <> 'P' THEN '3' END, CASE WHEN c < 10 THEN c END) AS one_digit,
         concat_ws(',', d, CASE WHEN c BETWEEN 10 AND 99 THEN c END) AS two_digit,
         CASE WHEN c >= 100 THEN c::VARCHAR ELSE '' END AS three_digit FROM o""",
)
def _(spark, folder):
    status = F.col("o_orderstatus")
    c = (F.col("o_custkey") % 1000).cast("string")
    d = (F.col("o_orderkey") % 90 + 10).cast("string")
    marked = F.concat(F.lit("**分类序号：** 3、"), d, F.lit("，"), c, F.lit(" **理由：** 见第12条"))
    headed = F.concat(F.lit("分类：3, "), d, F.lit("，"), c, F.lit(" 理由充分"))
    loose = F.concat(F.lit("属于 "), d, F.lit(" 和 "), c, F.lit(" 类"))
    answer = F.when(status == "O", marked).when(status == "F", headed).otherwise(loose)
    rows = table(spark, folder, "orders").select("o_orderkey", M.code_lists(answer).alias("a"))
    return rows.select("o_orderkey", "a.one_digit", "a.two_digit", "a.three_digit")


@query(
    "labelled_fields",
    "M5",
    """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN '是' WHEN 'SMALL' THEN '否' ELSE '不确定' END AS involved,
         CASE WHEN p_size > 25 THEN p_name ELSE '无' END AS company, p_brand AS reason FROM part""",
)
def _(spark, folder):
    kind = F.when(F.col("p_type") == "PROMO", "【是】").when(F.col("p_type") == "SMALL", "否").otherwise("?")
    firm = F.when(F.col("p_size") > 25, F.concat(F.lit("外包公司: ["), F.col("p_name"), F.lit(" ]\n"))).otherwise("")
    answer = F.concat(F.lit("是否涉及外包业务： "), kind, F.lit("\n"), firm, F.lit("关键理由："), F.col("p_brand"), F.lit(" \n完"))
    return table(spark, folder, "part").select("p_partkey", answer.alias("a")).select(
        "p_partkey",
        M.choice_field(F.col("a"), "是否涉及外包业务", ["是", "否", "不确定"], "不确定").alias("involved"),
        M.bracket_field(F.col("a"), "外包公司", "无").alias("company"),
        M.line_field(F.col("a"), "关键理由", "未能解析结果").alias("reason"),
    )


@query(
    "verdicts_by_words",
    "M6",
    """SELECT conv_id, turn, CASE WHEN contains(text, 'that') THEN '否' WHEN role = 'system' THEN '未完全识别' ELSE '是' END AS verdict FROM conversations""",
)
def _(spark, folder):
    lead = F.when(F.col("role") == "system", "").otherwise("相关 ")
    negative = F.when(F.col("text").contains("that"), "并非 ").otherwise("")
    answer = F.concat(lead, negative, F.lit("理由：不属于 是"), F.col("text"))
    return table(spark, folder, "conversations").select("conv_id", "turn", M.verdict_by_words(answer).alias("verdict"))


@query(
    "labels_and_reasons",
    "M7",
    f"""WITH {EVENT_KEY} SELECT event_id, CASE WHEN event_type = 'error' THEN '分类失败' ELSE event_type || ', k' || k END AS labels,
        CASE WHEN event_type = 'error' THEN 'bad' ELSE '{{"' || event_type || '":"r' || k || '"}}' END AS reasons FROM k""",
)
def _(spark, folder):
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    good = F.concat(F.lit('{"labels": ["'), kind, F.lit('", "k'), k, F.lit('"], "reasons": {"'), kind, F.lit('": "r'), k, F.lit('"}}'))
    answer = F.when(kind == "error", F.lit('{"error": "bad"}')).otherwise(good)
    return table(spark, folder, "events").select("event_id", M.labels_and_reasons(answer).alias("a")).select("event_id", "a.*")


@query(
    "pending_rows",
    "M8",
    """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE NOT (quality = 0 AND toxic = 0))""",
)
def _(spark, folder):
    state = F.when((F.col("quality") == 0) & (F.col("toxic") == 0), "Error").otherwise("done")
    answers = table(spark, folder, "labels").select("doc_id", state.alias("state"))
    return M.pending(table(spark, folder, "documents").select("doc_id"), answers, "doc_id", "state")


@query(
    "answer_statistics",
    "M9 A20",
    """WITH p AS (SELECT 'quality' AS field, quality::VARCHAR AS value FROM labels UNION ALL SELECT 'toxic', toxic::VARCHAR FROM labels)
       SELECT field, value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY field), 6) AS percent FROM p GROUP BY 1, 2""",
)
def _(spark, folder):
    return M.answer_statistics(table(spark, folder, "labels"), ["quality", "toxic"])
