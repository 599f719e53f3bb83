"""Tokens, lexicon scores, sections, clauses and scalar text functions."""

from pyspark.sql import functions as F

from casebook.functions import dates as D
from casebook.functions import text as X
from casebook.functions.runtime import table
from casebook.operators import clauses as C
from casebook.operators import lexicon as L
from casebook.plans.registry import query

STOPS = ["the", "of", "and", "de", "la", "der"]
STOP_SQL = "('the', 'of', 'and', 'de', 'la', 'der')"
TOPIC = ["that", "from", "dans", "nicht", "thion"]
RISK = ["with", "this", "pour", "sich", "anin", "tion"]
TOPIC_SQL = "('that', 'from', 'dans', 'nicht', 'thion')"
RISK_SQL = "('with', 'this', 'pour', 'sich', 'anin', 'tion')"
DOC_TOKENS = rf"""t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\p{{L}}+'),
          lambda w: length(w) >= 2 AND w NOT IN {STOP_SQL}) AS toks FROM documents)"""
CONV_TOKENS = rf"""c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1),
        t AS (SELECT conv_id, list_filter(regexp_extract_all(lower(text), '\p{{L}}+'),
          lambda w: length(w) >= 2 AND w NOT IN {STOP_SQL}) AS toks FROM c),
        w AS (SELECT conv_id, unnest(toks) AS word, generate_subscripts(toks, 1) - 1 AS pos FROM t)"""


@query(
    "kept_tokens",
    "T1",
    rf"WITH {DOC_TOKENS} SELECT doc_id, len(toks)::INT AS tokens, array_to_string(toks, ' ') AS words FROM t",
)
def _(spark, folder):
    tokens = X.kept_tokens(F.col("text"), STOPS)
    docs = table(spark, folder, "documents").select("doc_id", tokens.alias("toks"))
    return docs.select("doc_id", F.size("toks").alias("tokens"), F.array_join("toks", " ").alias("words"))


@query("longest_match_tokens", "T1", "SELECT p_partkey, p_name FROM part")
def _(spark, folder):
    words = table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    glued = table(spark, folder, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("name"))
    out = L.dictionary_tokens(glued, "name", words, "w")
    return out.select("p_partkey", F.array_join("tokens", " ").alias("p_name"))


# Glued names with a dictionary in which the longest word is often wrong: the
# words of the names, and pieces across two of them.
@query(
    "best_path_tokens",
    "T1",
    """WITH RECURSIVE n AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS ws FROM part),
        d AS (SELECT w, sum(c)::BIGINT AS c FROM (
                SELECT unnest(ws) AS w, 3 AS c FROM n
                UNION ALL SELECT ws[1] || left(ws[2], 2), 1 FROM n WHERE len(ws) > 1 AND p_partkey % 3 = 0
                UNION ALL SELECT right(ws[1], 2) || left(ws[2], 3), 4 FROM n WHERE len(ws) > 1 AND p_partkey % 5 = 0) GROUP BY w),
        m AS (SELECT map_from_entries(list((w, round(1e6 * (ln((SELECT sum(c) FROM d)) - ln(c)))::BIGINT))) AS costs,
                round(1e6 * ln((SELECT sum(c) FROM d)))::BIGINT AS unknown FROM d),
        t AS (SELECT DISTINCT replace(p_name, ' ', '') AS t FROM n),
        -- from the end of the text: least cost and best first word of each rest
        b AS (SELECT t, length(t) AS i, [0::BIGINT] AS best, []::VARCHAR[] AS words FROM t
              UNION ALL
              SELECT t, i - 1, list_prepend(way.cost, best), list_prepend(way.word, words)
              FROM (SELECT b.t, b.i, b.best, b.words, (SELECT list_min(list_transform(range(1, length(b.t) - b.i + 2), lambda k: {'cost': coalesce(
                        CASE WHEN k = length(b.t) - b.i + 1 THEN least(unknown, costs[substr(b.t, b.i, k)]) ELSE costs[substr(b.t, b.i, k)] END,
                        CASE WHEN k = length(b.t) - b.i + 1 THEN unknown ELSE 1000000000000 END) + b.best[k], 'size': -k, 'word': substr(b.t, b.i, k)}))
                      FROM m) AS way
                    FROM b WHERE b.i > 0)),
        p AS (SELECT t, words, 1 AS spot, []::VARCHAR[] AS found FROM b WHERE i = 0
              UNION ALL
              SELECT t, words, spot + length(words[spot]), list_append(found, words[spot]) FROM p WHERE spot <= length(t))
       SELECT p_partkey, array_to_string(found, ' ') AS p_name FROM n JOIN p ON p.t = replace(p_name, ' ', '') WHERE spot > length(t)""",
)
def _(spark, folder):
    part = table(spark, folder, "part").withColumn("ws", F.split("p_name", " "))
    first, second, two = F.element_at("ws", 1), F.try_element_at("ws", F.lit(2)), F.size("ws") > 1
    words = part.select(F.explode("ws").alias("w"), F.lit(3).alias("c"))
    words = words.unionByName(part.filter(two & (F.col("p_partkey") % 3 == 0)).select(F.concat(first, F.left(second, F.lit(2))).alias("w"), F.lit(1).alias("c")))
    words = words.unionByName(
        part.filter(two & (F.col("p_partkey") % 5 == 0)).select(F.concat(F.right(first, F.lit(2)), F.left(second, F.lit(3))).alias("w"), F.lit(4).alias("c"))
    )
    glued = part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("name"))
    out = L.best_path_tokens(glued, "name", words, "w", "c")
    return out.select("p_partkey", F.array_join("tokens", " ").alias("p_name"))


@query(
    "word_frequency",
    "T2",
    rf"WITH {DOC_TOKENS}, w AS (SELECT unnest(toks) AS word FROM t) SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING n >= 5",
)
def _(spark, folder):
    return L.word_frequency(table(spark, folder, "documents"), "text", STOPS)


LISTED = ["that", "risk", "nicht", "tion", "supply"]


@query(
    "listed_word_counts",
    "T3",
    rf"""WITH {DOC_TOKENS}, w AS (SELECT unnest(toks) AS word FROM t), f AS (SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING n >= 5)
         SELECT place::INT AS place, word, n FROM (VALUES (0, 'that'), (1, 'risk'), (2, 'nicht'), (3, 'tion'), (4, 'supply')) l(place, word)
         LEFT JOIN f USING (word)""",
)
def _(spark, folder):
    counted = L.word_frequency(table(spark, folder, "documents"), "text", STOPS)
    return L.list_counts(counted, LISTED).select("place", "word", "n")


@query(
    "lexicon_share",
    "T4",
    rf"""WITH {DOC_TOKENS} SELECT doc_id, CASE WHEN len(toks) = 0 THEN 0.0::DOUBLE
         ELSE round(len(list_filter(toks, lambda w: w IN {RISK_SQL})) / len(toks), 9) END AS share FROM t""",
)
def _(spark, folder):
    tokens = table(spark, folder, "documents").select("doc_id", X.kept_tokens(F.col("text"), STOPS).alias("t"))
    hits = F.size(F.filter("t", lambda w: w.isin(RISK)))
    return tokens.select("doc_id", F.round(F.coalesce(F.try_divide(hits, F.size("t")), F.lit(0.0)), 9).alias("share"))


@query(
    "word_neighbourhoods",
    "W7",
    rf"""WITH {CONV_TOKENS}, n AS (SELECT *, sum((word IN {RISK_SQL})::INT) OVER (PARTITION BY conv_id ORDER BY pos
             ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)::BIGINT AS near FROM w)
         SELECT conv_id, pos, word, near FROM n WHERE word IN {TOPIC_SQL}""",
)
def _(spark, folder):
    talks = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return L.neighbourhoods(L.document_positions(talks, ["conv_id"], ["turn"], "text", STOPS), ["conv_id"], TOPIC, RISK)


@query(
    "lexicon_scores",
    "T5 T6",
    rf"""WITH {CONV_TOKENS}, n AS (SELECT *, sum((word IN {RISK_SQL})::INT) OVER (PARTITION BY conv_id ORDER BY pos
             ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near, count(*) OVER (PARTITION BY conv_id, word) AS freq FROM w),
         s AS (SELECT conv_id, count(*) AS tokens, count(*) FILTER (word IN {TOPIC_SQL}) AS topic, count(*) FILTER (word IN {RISK_SQL}) AS risk,
               coalesce(sum(freq * near) FILTER (word IN {TOPIC_SQL}), 0) AS joint FROM n GROUP BY 1)
         SELECT t.conv_id, coalesce(tokens, 0) AS tokens, round(coalesce(topic / tokens, 0), 9) AS topic_score,
           round(coalesce(risk / tokens, 0), 9) AS risk_score, round(coalesce(joint / tokens, 0), 9) AS joint_score
         FROM t LEFT JOIN s USING (conv_id)""",
)
def _(spark, folder):
    talks = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return L.lexicon_scores(talks, ["conv_id"], ["turn"], "text", TOPIC, RISK, STOPS)


@query(
    "lexicon_reconciliation",
    "T9",
    """WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part), l(w) AS (VALUES ('ring'), ('gear'), ('wheel'), ('bolt'))
       SELECT w AS similar_word, CASE WHEN w IN (SELECT w FROM n) THEN 'matched' ELSE 'unmatched' END AS state FROM l
       UNION ALL SELECT w, 'extra' FROM n WHERE w NOT IN (SELECT w FROM l)""",
)
def _(spark, folder):
    pairs = table(spark, folder, "part").select(
        F.split("p_name", " ")[0].alias("original_word"), F.split("p_name", " ")[1].alias("similar_word")
    )
    return L.reconcile_lexicon(["ring", "gear", "wheel", "bolt"], pairs)


TFIDF_SQL = r"""g AS (SELECT doc_id, text, md5(doc_id::VARCHAR || '|42') AS k FROM documents WHERE source = 'src3'),
        gt AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda w: length(w) >= 2) AS toks FROM g),
        idf AS (SELECT word, ln((1.0::DOUBLE + (SELECT count(*) FROM g)) / (1.0::DOUBLE + count(*))) + 1 AS idf
                FROM (SELECT unnest(list_distinct(toks)) AS word FROM gt) GROUP BY 1),
        dr AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '|42')) AS r FROM documents),
        ot AS (SELECT source, r, list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda w: length(w) >= 2) AS toks FROM dr WHERE r <= 300),
        ow AS (SELECT source, r, word, count(*) * any_value(idf) AS w FROM (SELECT source, r, unnest(toks) AS word FROM ot) JOIN idf USING (word) GROUP BY 1, 2, 3),
        o AS (SELECT source, r, word, w / sqrt(sum(w * w) OVER (PARTITION BY source, r)) AS w FROM ow),
        gw AS (SELECT doc_id, word, count(*) * any_value(idf) AS w FROM (SELECT doc_id, unnest(toks) AS word FROM gt) JOIN idf USING (word) GROUP BY 1, 2),
        gn AS (SELECT doc_id, word, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM gw),
        n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)"""


def _similarity(spark, folder, pairing):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return L.group_similarity(docs.filter("source = 'src3'"), docs, "doc_id", "source", "text", pairing=pairing)


@query(
    "group_similarity_by_rank",
    "T10",
    f"""WITH {TFIDF_SQL}, gr AS (SELECT doc_id, row_number() OVER (ORDER BY k) AS r FROM g),
        d AS (SELECT source, sum(o.w * gn.w) AS dot FROM o JOIN gr ON gr.r = o.r JOIN gn ON gn.doc_id = gr.doc_id AND gn.word = o.word GROUP BY 1),
        p AS (SELECT source, count(*) AS pairs FROM dr WHERE r <= least(300, (SELECT count(*) FROM g)) GROUP BY 1)
        SELECT source, n, round(coalesce(dot, 0) / pairs, 6) AS similarity FROM n JOIN p USING (source) LEFT JOIN d USING (source)""",
)
def _(spark, folder):
    return _similarity(spark, folder, "rank")


@query(
    "group_similarity_full",
    "T10",
    f"""WITH {TFIDF_SQL}, a AS (SELECT word, sum(w) AS w FROM gn GROUP BY 1), b AS (SELECT source, word, sum(w) AS w FROM o GROUP BY 1, 2),
        d AS (SELECT source, sum(a.w * b.w) AS dot FROM a JOIN b USING (word) GROUP BY 1),
        p AS (SELECT source, count(*) * (SELECT count(*) FROM g) AS pairs FROM dr WHERE r <= 300 GROUP BY 1)
        SELECT source, n, round(coalesce(dot, 0) / pairs, 6) AS similarity FROM n JOIN p USING (source) LEFT JOIN d USING (source)""",
)
def _(spark, folder):
    return _similarity(spark, folder, "full")


HEADS, NEXT = ["<!-- ad", "<div", "<h1"], ["</article>", "</body>", "<footer"]


@query(
    "section_between_headings",
    "T11",
    r"""WITH t AS (SELECT page_id, html, nullif(regexp_extract(html, '(<!-- ad|<div|<h1)(?:[^>"]|\z)', 1), '') AS topic FROM pages),
        b AS (SELECT page_id, replace(CASE topic WHEN '<!-- ad' THEN nullif(regexp_extract(html, '(?s)<!-- ad([\n\t ].*)', 1), '')
                WHEN '<div' THEN nullif(regexp_extract(html, '(?s)<div([\n\t ].*)', 1), '')
                WHEN '<h1' THEN nullif(regexp_extract(html, '(?s)<h1([\n\t ].*)', 1), '') END, topic, '') AS body FROM t)
        SELECT page_id, regexp_extract(body, '(?s)^(.*?)(?:</article>|</body>|<footer|\z)', 1) AS section FROM b""",
)
def _(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", L.section_between(F.col("html"), HEADS, NEXT, '>"').alias("section"))


@query(
    "normalised_documents",
    "T12",
    r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(?m)^(The|In|Thth)', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents",
)
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.normalise_document(F.col("text"), ["The", "In", "Thth"]).alias("text"))


@query(
    "clause_changes",
    "T13 P17",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        s AS (SELECT *, regexp_matches(line, '^(The|In|Der|La)\b') AS open_,
              CASE WHEN contains(line, 'that') OR contains(line, 'nicht') THEN 'o' WHEN contains(line, 'with') OR contains(line, 'sich') THEN 'm' END AS own FROM l),
        n AS (SELECT *, coalesce(own, lag(own) OVER (PARTITION BY doc_id ORDER BY i)) AS side,
              sum(open_::INT) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS clause_no FROM s),
        g AS (SELECT doc_id, clause_no, max(CASE WHEN open_ THEN side END) AS side, string_agg(trim(line), ' ' ORDER BY i) AS t
              FROM n WHERE clause_no > 0 GROUP BY 1, 2)
        SELECT doc_id, clause_no, CASE WHEN side = 'o' THEN t END AS original, CASE WHEN side = 'm' THEN t END AS modified FROM g WHERE side IS NOT NULL""",
)
def _(spark, folder):
    docs = table(spark, folder, "documents")
    return C.clause_changes(docs, "doc_id", "text", r"^(The|In|Der|La)\b", ["that", "nicht"], ["with", "sich"])


@query("clause_changes_in_sequence", "T13")
def _(spark, folder):
    return C.clause_changes_in_sequence(
        table(spark, folder, "documents"), "doc_id", "text", r"\b([A-Z]\w{1,2})\b", ["Thth", "Erth"], ["Anin"], ["Inth", "Onth"],
        ["Released under"], [("rights", ["License"]), ("link", ["with", "from"])], "other",
    )


@query("two_column_pairs", "T14")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    rows = docs.select("doc_id", "row_no", F.split("line", "[ ,.]+").alias("cells"))
    return C.two_column_pairs(rows, "doc_id", "row_no", "cells", ["the", "The"], ["of", "and"], ["that"])


# Scalar functions


@query(
    "name_functions",
    "2.7 string",
    r"""SELECT p_partkey, lower(trim(p_name)) AS low, p_brand || '_' || p_size AS key, lpad(p_size::VARCHAR, 6, '0') AS code,
          split_part(p_brand, '#', 1) AS stem, CASE WHEN length(p_name) > 9 THEN substr(p_name, 1, 6) || '...' ELSE p_name END AS short,
          length(regexp_replace(p_name || '(' || p_type || ')', '\([^)]*\)', '', 'g'))::INT AS bare,
          regexp_matches(p_size::VARCHAR, '^\d+(\.\d+)?$') AS digits, regexp_replace(p_brand, '[#]', '-', 'g') AS file FROM part""",
)
def _(spark, folder):
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    return table(spark, folder, "part").select(
        "p_partkey", F.lower(F.trim(name)).alias("low"), X.composite_key("p_brand", "p_size").alias("key"),
        X.pad_code(F.col("p_size")).alias("code"), X.before_marker(F.col("p_brand"), "#").alias("stem"),
        X.ellipsis(name, 9, 6).alias("short"),
        X.length_without_brackets(F.concat(name, F.lit("("), "p_type", F.lit(")"))).alias("bare"),
        X.is_number_text(size).alias("digits"), F.regexp_replace("p_brand", "[#]", "-").alias("file"),
    )


@query(
    "clean_page_titles",
    "2.7 string",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 0), '<[^>]+>', '', 'g'),
          '[\\/:*?"<>|]', '', 'g'), '\s+', '', 'g') AS title FROM pages""",
)
def _(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", X.clean_title(F.regexp_extract("html", "<title>(.*?)</title>", 0)).alias("title")
    )


@query(
    "ids_from_urls",
    "2.7 regex A30",
    r"SELECT page_id, coalesce(nullif(regexp_extract(url, '(\d{3})', 1), ''), 'N/A') AS id FROM pages",
)
def _(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.id_from_url(F.col("url"), 3).alias("id"))


@query(
    "address_phrases_removed",
    "2.7 regex",
    r"""SELECT conv_id, turn, regexp_replace('请问董事长' || CASE WHEN role = 'user' THEN '，' ELSE ' ' END || text, '请问[\x{4e00}-\x{9fa5}\s]+?([，、：])', '\1', 'g') AS text
        FROM conversations""",
)
def _(spark, folder):
    mark = F.when(F.col("role") == "user", "，").otherwise(" ")
    asked = F.concat(F.lit("请问董事长"), mark, F.col("text"))
    return table(spark, folder, "conversations").select("conv_id", "turn", X.drop_salutations(asked).alias("text"))


@query(
    "sentences_with_words",
    "2.7 regex",
    r"""WITH s AS (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(text, '[。？！.?!]+')), '^\s+|\s+$', '', 'g') AS sentence FROM documents)
        SELECT doc_id, sentence FROM s WHERE contains(sentence, 'that') OR contains(sentence, 'License')""",
)
def _(spark, folder):
    found = X.sentences_with(F.col("text"), ["that", "License"])
    return table(spark, folder, "documents").select("doc_id", F.explode(found).alias("sentence"))


@query(
    "date_functions",
    "2.7 date",
    """WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'F' THEN strftime(o_orderdate, '%Y年%m月%d日')
              ELSE strftime(o_orderdate, '%Y.%m.%d') END AS d, o_orderdate AS t FROM orders)
       SELECT o_orderkey, t::DATE AS day, nullif(regexp_extract(d, '(\\d{4})年', 1), '')::INT AS year_cn, strftime(t, '%Y%m') AS ym,
         strftime(t, '%Y') || 'Q' || quarter(t) AS quarter,
         CASE WHEN d LIKE '%-%' AND year(t) >= 2000 THEN year(t)::INT END AS year_text FROM s""",
)
def _(spark, folder):
    t = F.col("o_orderdate")
    written = (
        F.when(F.col("o_orderstatus") == "O", F.date_format(t, "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "F", F.date_format(t, "yyyy年MM月dd日"))
        .otherwise(F.date_format(t, "yyyy.MM.dd"))
    )
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", written.alias("d"))
    return rows.select(
        "o_orderkey", D.parse_any_date(F.col("d")).alias("day"), D.year_before(F.col("d")).alias("year_cn"),
        F.date_format(t, "yyyyMM").alias("ym"),
        F.concat(F.year(t).cast("string"), F.lit("Q"), D.quarter_of(F.month(t)).cast("string")).alias("quarter"),
        D.year_in_text(F.col("d")).alias("year_text"),
    )


@query(
    "whole_day_gaps",
    "2.7 date J16",
    """SELECT e.event_id, floor((epoch_us(e.ts) - epoch_us(f.ts)) / 86400000000)::BIGINT AS days FROM events e
       JOIN (SELECT event_type, arg_min(ts, event_id) AS ts FROM events WHERE value > 20 GROUP BY 1) f USING (event_type)""",
)
def _(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    first = events.filter("value > 20").groupBy("event_type").agg(F.min_by("ts", "event_id").alias("first"))
    return events.join(first, "event_type").select("event_id", D.whole_days(F.col("first"), F.col("ts")).alias("days"))


@query(
    "meeting_dates",
    "2.7 date",
    """SELECT o_orderkey, o_orderdate::DATE AS met, year(o_orderdate)::INT AS general FROM orders""",
)
def _(spark, folder):
    t = F.col("o_orderdate")
    cjk = F.translate(F.date_format(t, "yyyy"), "0123456789", "〇一二三四五六七八九")
    tens = F.element_at(F.array(*[F.lit(x) for x in ("", "十", "二十", "三十")]), (F.floor(F.dayofmonth(t) / 10) + 1).cast("int"))
    ones = F.element_at(F.array(*[F.lit(x) for x in ("", *"一二三四五六七八九")]), (F.dayofmonth(t) % 10 + 1).cast("int"))
    months = F.element_at(F.array(*[F.lit(x) for x in (*"一二三四五六七八九十", "十一", "十二")]), F.month(t))
    plain = F.concat(F.lit("第三届董事会于 "), F.date_format(t, "yyyy 年 M 月 d 日"), F.lit("召开"))
    before = F.concat(F.date_format(t, "yyyy年MM月dd日"), F.lit("公司董事会召开"))
    written = F.concat(F.lit("董事会 "), cjk, F.lit("年"), months, F.lit("月"), tens, ones, F.lit("日"))
    board = F.when(F.col("o_orderstatus") == "O", plain).when(F.col("o_orderstatus") == "F", before).otherwise(written)
    general = F.when(F.col("o_orderstatus") == "P", F.concat(cjk, F.lit("年第一次股东大会"))).otherwise(
        F.concat(F.date_format(t, "yyyy"), F.lit(" 年度股东大会"))
    )
    rows = table(spark, folder, "orders").select("o_orderkey", board.alias("board"), general.alias("general"))
    return rows.select("o_orderkey", D.meeting_date(F.col("board")).alias("met"), D.meeting_year(F.col("general")).alias("general"))


@query(
    "revision_drafts",
    "2.7 regex",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN true WHEN p_size < 20 THEN true WHEN p_size < 30 THEN true ELSE false END AS draft FROM part""",
)
def _(spark, folder):
    size, name = F.col("p_size"), F.col("p_name")
    title = (
        F.when(size < 10, F.concat(name, F.lit("章程（2019年修订）")))
        .when(size < 20, F.concat(name, F.lit("章程(修正稿)")))
        .when(size < 30, F.concat(name, F.lit("章程修订稿")))
        .otherwise(F.concat(name, F.lit("章程修订说明")))
    )
    return table(spark, folder, "part").select("p_partkey", C.is_revision_draft(title).alias("draft"))


@query(
    "complaint_times",
    "2.7 date",
    "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN date_trunc('minute', ts)::TIMESTAMP END AS at FROM events",
)
def _(spark, folder):
    stamp = F.date_format("ts", "yyyy年MM月dd日 HH:mm")
    written = F.when(F.col("event_id") % 5 > 0, stamp).otherwise(F.concat(stamp, F.lit(" ?")))
    return table(spark, folder, "events").select("event_id", D.parse_clock(written).alias("at"))


@query(
    "questions_without_greeting",
    "2.7 regex",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE '请问 ' || text END AS question FROM conversations""",
)
def _(spark, folder):
    opening = F.when(F.col("turn") % 2 == 0, "尊敬的董秘您好，").otherwise("董秘你好！请问 ")
    rows = table(spark, folder, "conversations")
    return rows.select("conv_id", "turn", X.drop_greetings(F.concat(opening, F.col("text"))).alias("question"))


@query(
    "sections_to_blank_line",
    "T11",
    r"""WITH t AS (SELECT doc_id, 'Summary:' || chr(10) || text || chr(10) || chr(10) || 'x Outlook:  ' || chr(10) || text AS t FROM documents),
        s AS (SELECT doc_id, regexp_extract_all(t, '(?s)((?:Summary|Outlook):[^\S\n]*\n.{300}.*?)(?:\n\n|\z)', 1) AS s FROM t)
        SELECT doc_id, len(s)::INT AS sections, array_to_string(s, '|') AS text FROM s""",
)
def _(spark, folder):
    report = F.concat(F.lit("Summary:\n"), F.col("text"), F.lit("\n\nx Outlook:  \n"), F.col("text"))
    found = table(spark, folder, "documents").select("doc_id", L.sections_to_blank_line(report, ["Summary", "Outlook"]).alias("s"))
    return found.select("doc_id", F.size("s").alias("sections"), F.array_join("s", "|").alias("text"))
