"""Reading stored model answers: verdicts, JSON, codes and labelled fields."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from casebook.functions import fixed
from casebook.functions.text import contains_any, ellipsis, first_group


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out a single time per row."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def clean_reason(col: Column) -> Column:
    """Drop leading marks, then a lead-in up to the first full-width colon."""
    return F.regexp_replace(F.regexp_replace(col, r"^[，。：；、\s]+", ""), "^[^：]+：", "")


def yes_no_answer(col: Column, yes: str = fixed.YES, no: str = fixed.NO, bold: bool = False) -> Column:
    """struct(verdict, reason): the verdict the answer starts with, '' if none."""
    text = F.trim(F.regexp_replace(col, r"^\s+|\s+$", ""))
    word = f"({yes}|{no})"
    pattern = rf"^\*\*{word}\*\*" if bold else f"^{word}"
    verdict = F.regexp_extract(text, pattern, 1)
    rest = F.regexp_replace(F.regexp_replace(text, pattern, ""), r"^\s+", "")
    return F.struct(verdict.alias("verdict"), clean_reason(rest).alias("reason"))


def short_answer(col: Column, yes: str = fixed.YES, no: str = fixed.NO, unknown: str = "未知", limit: int = 30) -> Column:
    """Verdict, a separator and a reason cut to ``limit``; otherwise unknown and the start of the answer."""
    text = F.regexp_replace(col, r"^\s+|\s+$", "")
    pattern = rf"^({yes}|{no})[：:，、\s]\s*([^\n]*)$"
    verdict = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    reason = ellipsis(F.regexp_replace(F.regexp_extract(text, pattern, 2), r"\s+$", ""), limit, limit - 3)
    return F.struct(
        F.coalesce(verdict, F.lit(unknown)).alias("verdict"),
        F.when(verdict.isNotNull(), reason).otherwise(F.substring(text, 1, limit)).alias("reason"),
    )


def early_answer(col: Column, yes: str = fixed.YES, no: str = fixed.NO, within: int = 10) -> Column:
    """Verdict with a colon, else the first verdict word among the first characters, yes before no."""
    pattern = f"^({yes}|{no})[：:]\\s*([^\\n]+)$"
    strict = F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))
    head = F.substring(col, 1, within)

    def after(word: str) -> Column:
        return F.trim(F.substring(col, F.instr(col, word) + len(word), F.length(col)))

    verdict = F.coalesce(strict, F.when(head.contains(yes), F.lit(yes)).when(head.contains(no), F.lit(no)))
    reason = F.when(strict.isNotNull(), F.regexp_extract(col, pattern, 2)).when(
        head.contains(yes), after(yes)
    ).when(head.contains(no), after(no)).otherwise(col)
    return F.struct(verdict.alias("verdict"), reason.alias("reason"))


def exact_flag(col: Column, yes: str = fixed.YES, no: str = fixed.NO) -> Column:
    return F.when(F.trim(col) == yes, 1).when(F.trim(col) == no, 0).otherwise(-1)


def json_body(col: Column) -> Column:
    """From the first ``{`` to the last ``}``; null if there is none."""
    return F.nullif(F.regexp_extract(col, r"(?s)\{.*\}", 0), F.lit(""))


def unfence(col: Column) -> Column:
    return F.regexp_replace(col, r"(?i)^```json\s*|\s*```$", "")


def repair_json(col: Column) -> Column:
    """Single quotes, bare keys and trailing commas made valid."""
    quoted = F.regexp_replace(col, r"(?<!\\)'", '"')
    keyed = F.regexp_replace(quoted, r'([{,]\s*)(\w+)\s*:', '$1"$2":')
    return F.regexp_replace(keyed, r",\s*([}\]])", "$1")


def parse_json(col: Column, schema: str) -> Column:
    """First of: the whole answer, without code fence, its JSON part, the repaired part.

    Every field of a value that is no JSON object is null; such a value
    counts as unparsed and the next form is tried.
    """
    whole, bare = _object(col, schema), unfence(col)
    inner = _once(json_body(bare), lambda body: F.coalesce(_object(body, schema), _object(repair_json(body), schema)))
    return F.coalesce(whole, F.when(bare != col, _object(bare, schema)), inner)


def _object(col: Column, schema: str) -> Column:
    is_object = F.get_json_object(col, "$").startswith("{")
    return F.when(is_object, F.from_json(col, schema))


def json_answer(
    col: Column, field: str, reason: str, yes_words: Sequence[str] = (fixed.YES, "true"),
    failed: str = "API调用失败", no_reason: str = "无理由提供",
) -> Column:
    """struct(flag, reason) from a JSON answer, or from words in the text if it holds none."""
    blank = F.coalesce(F.trim(col), F.lit("")) == ""

    def read(parsed: Column) -> Column:
        stated = F.lower(parsed.getField(field)).isin("true", "1")
        guessed = contains_any(F.lower(col), [w.lower() for w in yes_words])
        flag = F.when(parsed.isNotNull(), F.coalesce(stated, F.lit(False))).otherwise(guessed)
        why = F.when(parsed.isNotNull(), F.coalesce(parsed.getField(reason), F.lit(no_reason))).otherwise(col)
        return F.struct(
            F.when(blank, F.lit(False)).otherwise(flag).alias("flag"),
            F.when(blank, F.lit(failed)).otherwise(why).alias("reason"),
        )

    return _once(parse_json(col, f"`{field}` string, `{reason}` string"), read)


def rescued_fields(
    col: Column, fields: Sequence[str] = ("category", "reason", "confidence"), level: str = "confidence"
) -> Column:
    """struct(related, fields...) from an answer whose JSON no repair makes valid.

    The flag follows the words for yes, then those for no, else it is null.
    Each field is what stands behind its name up to the next quote, comma,
    brace or line; ``level`` counts only if it is a known level.
    """
    lower = F.lower(col)
    related = F.when(contains_any(lower, fixed.RELATED_WORDS), F.lit(True)).when(
        contains_any(lower, fixed.UNRELATED_WORDS), F.lit(False)
    )
    found = []
    for name in fields:
        value = F.nullif(F.trim(F.regexp_extract(col, f"(?i){name}{fixed.RESCUED_VALUE}", 1)), F.lit(""))
        found.append((F.when(value.isin(fixed.CONFIDENCE_LEVELS), value) if name == level else value).alias(name))
    return F.struct(related.alias("related"), *found)


def validated_class(col: Column, source: Column, field: str, reason: str, allowed: Sequence[str]) -> Column:
    """The class a JSON answer states if it is an allowed one, else ``Error``; ``Skip`` for blank sources."""
    parsed = F.from_json(json_body(col), f"`{field}` string, `{reason}` string")
    value, why = parsed.getField(field), parsed.getField(reason)
    ok = value.isin(list(allowed)) & why.isNotNull()
    blank = F.coalesce(F.trim(source), F.lit("")) == ""
    return F.when(blank, F.lit("Skip")).when(F.coalesce(ok, F.lit(False)), value).otherwise(F.lit("Error"))


def code_lists(col: Column) -> Column:
    """struct(one_digit, two_digit, three_digit, reason): codes by length.

    Taken from a marked block, else from a header line, else from the whole text.
    """
    block, header = fixed.CODE_BLOCK, fixed.CODE_HEADER
    marked = F.regexp_count(col, F.lit(block)) > 0
    headed = F.regexp_count(col, F.lit(header)) > 0
    words = F.lit(fixed.CODE_WORD)
    codes = (
        F.when(marked, F.regexp_extract_all(F.regexp_extract(col, block, 1), words, F.lit(1)))
        .when(headed, F.regexp_extract_all(F.regexp_extract(col, header, 1), F.lit(r"(\d{1,3})"), F.lit(1)))
        .otherwise(F.regexp_extract_all(col, words, F.lit(1)))
    )
    after_block = F.regexp_extract(col, fixed.CODE_REASON, 1)
    after_header = F.regexp_replace(F.regexp_replace(col, header, ""), r"^[：:，、\s-]+", "")
    reason = F.when(marked, F.trim(after_block)).when(headed, after_header).otherwise(col)

    def by_length(found: Column) -> Column:
        def of_length(k: int) -> Column:
            return F.array_join(F.filter(found, lambda c: F.length(c) == k), ",")

        return F.struct(
            of_length(1).alias("one_digit"), of_length(2).alias("two_digit"), of_length(3).alias("three_digit"),
            reason.alias("reason"),
        )

    return _once(codes, by_length)


def choice_field(col: Column, label: str, choices: Sequence[str], default: str) -> Column:
    """Value of ``label：value`` (brackets allowed) if it is one of the choices."""
    return F.coalesce(first_group(col, f"{label}[：:]\\s*【?({'|'.join(choices)})】?"), F.lit(default))


def bracket_field(col: Column, label: str, default: str) -> Column:
    return F.coalesce(F.trim(first_group(col, rf"{label}[：:]\s*\[([^\]]+)\]")), F.lit(default))


def line_field(col: Column, label: str, default: str) -> Column:
    return F.coalesce(F.trim(first_group(col, f"{label}[：:]\\s*([^\\n]+)")), F.lit(default))


def verdict_by_words(
    col: Column,
    negative: Sequence[str] = tuple(fixed.NEGATIVE_VERDICTS),
    positive: Sequence[str] = tuple(fixed.POSITIVE_VERDICTS),
    before: str = "理由如下：|理由：",
    yes: str = fixed.YES, no: str = fixed.NO, unclear: str = fixed.UNCLEAR_VERDICT,
) -> Column:
    """Negative words win over positive ones; only the part before the reasons counts."""
    judged = F.when(col.rlike(before), F.regexp_extract(col, f"(?s)^(.*?)(?:{before})", 1)).otherwise(col)
    return F.when(contains_any(judged, negative), F.lit(no)).when(contains_any(judged, positive), F.lit(yes)).otherwise(F.lit(unclear))


def labels_and_reasons(col: Column, failed: str = "分类失败") -> Column:
    """struct(labels, reasons): labels joined, reasons as a map in text form."""
    parsed = F.from_json(col, "labels array<string>, reasons map<string,string>, error string")
    complete = parsed.getField("labels").isNotNull() & parsed.getField("reasons").isNotNull()
    return F.struct(
        F.when(complete, F.array_join(parsed.getField("labels"), ", ")).otherwise(F.lit(failed)).alias("labels"),
        F.when(complete, F.to_json(parsed.getField("reasons"))).otherwise(parsed.getField("error")).alias("reasons"),
    )


def pending(df: DataFrame, answers: DataFrame, id_col: str, state: str, retry: Sequence[str] = ("Error",)) -> DataFrame:
    """Rows without an answer, or whose every answer so far is one to retry."""
    done = answers.filter(F.col(state).isNotNull() & ~F.col(state).isin(list(retry))).select(id_col)
    return df.join(done, id_col, "left_anti")


def answer_statistics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(field, value, n, percent) for each of the columns, from one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("field").agg(F.sum("n").alias("_all"))
    return counts.join(totals, "field").select(
        "field", "value", "n", F.round(100.0 * F.col("n") / F.col("_all"), 6).alias("percent")
    )
