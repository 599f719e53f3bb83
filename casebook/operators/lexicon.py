"""Tokens, word frequencies, lexicon scores and text similarity."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from casebook.functions.ranking import running_total, seeded_key
from casebook.functions.runtime import join_on
from casebook.functions.text import kept_tokens, quote_words
from casebook.operators.automata import PART_CHARS, SHARD_CHARS, over_automata

CHUNK = 100_000


def tokens_of(df: DataFrame, text: str, stop_words: Sequence[str] = (), min_len: int = 2) -> DataFrame:
    """``df`` without its text, one row per kept token: ``pos`` (from 0) and ``word``."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(kept_tokens(F.col(text), stop_words, min_len)).alias("pos", "word"))


def dictionary_tokens(df: DataFrame, text: str, words: DataFrame, word: str, out: str = "tokens") -> DataFrame:
    """Longest-match segmentation for scripts without blanks.

    At each place the longest dictionary word is taken; elsewhere a run of
    Latin letters or digits, or a single character. The pieces of the texts
    that are as long as some word meet the dictionary in an equi-join, so it
    may have any size; the places found are then walked once per text. Equal
    texts are cut once; null text has null tokens.
    """
    listed = words.select(F.col(word).alias("_piece")).filter(F.col(word) != "").distinct()
    # The lengths that occur: as many numbers as the longest word has characters.
    sizes = sorted(r[0] for r in listed.select(F.length("_piece")).distinct().collect())
    rows = df.withColumn("_key", F.sha2(text, 256))
    texts = rows.filter(F.col(text).isNotNull()).select("_key", F.col(text).alias("_text")).dropDuplicates(["_key"])

    def cuts(size: int) -> Column:
        pieces = F.transform(
            F.sequence(F.lit(1), F.length("_text") - size + 1),
            lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.substring("_text", i, F.lit(size)).alias("piece")),
        )
        return F.when(F.length("_text") >= size, pieces)

    places = texts.select("_key", F.lit(None).cast("array<struct<at:int,size:int>>").alias("_hits")).limit(0)
    if sizes:
        cut = texts.select("_key", F.explode(F.flatten(F.array_compact(F.array(*[cuts(n) for n in sizes])))).alias("c"))
        hits = cut.select("_key", F.col("c.at").alias("at"), F.col("c.size").alias("size"), F.col("c.piece").alias("_piece"))
        # Exploded pieces are more than Spark estimates: never broadcast.
        longest = hits.join(listed.hint("merge"), "_piece", "left_semi").groupBy("_key", "at").agg(F.max("size").alias("size"))
        places = longest.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("at", "size"))).alias("_hits"))
    run = "[A-Za-z0-9]"

    def rest(start: Column, end: Column) -> Column:
        """Runs and single characters from ``start`` up to before ``end``."""
        return F.regexp_extract_all(F.substring("_text", start, end - start), F.lit(f"(?sU)({run}+|\\S)"), F.lit(1))

    def step(state: Column, hit: Column) -> Column:
        at, size = hit["at"], hit["size"]
        # A run that began before the place goes on over it.
        inside = (at > state["next"]) & F.substring("_text", at - 1, F.lit(2)).rlike(f"^{run}{run}$")
        taken = F.struct(
            (at + size).alias("next"),
            F.concat(state["found"], rest(state["next"], at), F.array(F.substring("_text", at, size))).alias("found"),
        )
        return F.when((at >= state["next"]) & ~inside, taken).otherwise(state)

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("found"))
    walked = F.aggregate(F.coalesce("_hits", F.array().cast("array<struct<at:int,size:int>>")), start, step)
    done = texts.join(places, "_key", "left").select("_key", "_text", walked.alias("_w"))
    tokens = done.select(
        "_key",
        F.filter(F.concat("_w.found", rest(F.col("_w.next"), F.length("_text") + 1)), lambda t: F.length(F.btrim(t)) > 0).alias(out),
    )
    return rows.join(tokens, "_key", "left").select(*[c for c in df.columns if c != text], out)


def _best_path(text: str, hits: Iterable[tuple[int, int, int]], unknown: int, run: re.Pattern) -> list[str]:
    """The words of the cheapest way through a text; of equally cheap ways the one whose first other word is longer."""
    n = len(text)
    starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for at, size, cost in hits:
        starts[at].append((size, cost))
    ends = [0] * n
    for m in run.finditer(text):
        ends[m.start() : m.end()] = [m.end()] * (m.end() - m.start())
    best, step = [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        if text[i].isspace() and not starts[i]:
            best[i] = best[i + 1]
            continue
        size = (ends[i] or i + 1) - i
        ways = [(unknown + best[i + size], -size)] + [(cost + best[i + k], -k) for k, cost in starts[i]]
        best[i], least = min(ways)
        step[i] = -least
    out, i = [], 0
    while i < n:
        out.append(text[i : i + step[i]])
        i += step[i]
    return [w for w in out if not w.isspace()]


def best_path_tokens(
    df: DataFrame, text: str, words: DataFrame, word: str, count: str, out: str = "tokens", shard_chars: int = SHARD_CHARS, part_chars: int = PART_CHARS
) -> DataFrame:
    """Segmentation for scripts without blanks by the most probable path of the word graph.

    Every dictionary word found in a text is an edge that costs the negative
    log of its share of all counts, in millionths and rounded, so that sums
    are exact. A character that no word covers, or a run of Latin letters and
    digits from its start or from where a word ends in it, costs as much as a
    word counted once. Blanks part words unless a dictionary word holds them.
    Among equally probable paths the one with the longer word at the first
    difference is taken. Equal texts are cut once; null text has null tokens;
    words without a positive count are not listed.
    """
    listed = words.filter((F.col(word) != "") & (F.col(count) > 0)).groupBy(F.col(word).alias("_w")).agg(F.sum(count).alias("_n"))
    total = listed.agg(F.sum("_n")).first()[0] or 1
    unknown = round(1e6 * math.log(total))
    cost = F.round(1e6 * (math.log(total) - F.log("_n"))).cast("bigint")
    valued = listed.select("_w", F.struct(F.length("_w").cast("bigint").alias("size"), cost.alias("cost")).alias("_v"))
    rows = df.withColumn("_key", F.sha2(text, 256))
    texts = rows.filter(F.col(text).isNotNull()).select("_key", F.col(text).alias("_text")).dropDuplicates(["_key"])
    edge = pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64()), ("cost", pa.int64())]))

    def find(table: pa.Table, automaton) -> pa.Table:
        hits = []
        for value in table.column("_text").to_pylist():
            found = automaton.iter(value) if value else ()
            hits.append([{"at": end + 1 - v["size"], "size": v["size"], "cost": v["cost"]} for end, v in found])
        return table.append_column("_hits", pa.array(hits, edge))

    schema = T.StructType([*texts.schema.fields, *T.StructType.fromDDL("_hits array<struct<at:bigint,size:bigint,cost:bigint>>")])
    found, met = over_automata(texts, "_text", valued, find, schema, shard_chars, part_chars)
    if total == 1 and found.isEmpty():
        found = texts.withColumn("_hits", F.array().cast(schema["_hits"].dataType))
    if met > 1:
        found = found.groupBy("_key").agg(F.first("_text").alias("_text"), F.flatten(F.collect_list("_hits")).alias("_hits"))
    run = "[A-Za-z0-9]+"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(run)
        for batch in batches:
            tokens = [
                _best_path(value, [(h["at"], h["size"], h["cost"]) for h in hits], unknown, pattern)
                for value, hits in zip(batch.column("_text").to_pylist(), batch.column("_hits").to_pylist())
            ]
            yield pa.record_batch([batch.column("_key"), pa.array(tokens, pa.list_(pa.string()))], names=["_key", out])

    tokens = found.select("_key", "_text", "_hits").mapInArrow(cut, f"_key string, `{out}` array<string>")
    return rows.join(tokens, "_key", "left").select(*[c for c in df.columns if c != text], out)


def word_frequency(df: DataFrame, text: str, stop_words: Sequence[str] = (), min_freq: int = 5) -> DataFrame:
    words = df.select(F.explode(kept_tokens(F.col(text), stop_words)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_freq)


def list_counts(frequency: DataFrame, words: Sequence[str]) -> DataFrame:
    """Counts of the listed words in list order; null for a word that never occurs."""
    listed = frequency.sparkSession.createDataFrame(list(enumerate(words)), "place int, word string")
    found = frequency.filter(F.col("word").isin(list(words)))
    return listed.join(found, "word", "left").orderBy("place")


def document_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, stop_words: Sequence[str] = ()
) -> DataFrame:
    """Rows of a document as token arrays with the number of tokens before each row: (keys, base, tokens)."""
    rows = df.select(*keys, *order, kept_tokens(F.col(text), stop_words).alias("tokens"))
    return running_total(rows, keys, order, F.size("tokens"), "base").select(*keys, "base", "tokens")


def neighbourhoods(
    rows: DataFrame, keys: Sequence[str], topic: Sequence[str], risk: Sequence[str], reach: int = 10, chunk: int = CHUNK
) -> DataFrame:
    """Topic tokens with the number of risk tokens up to ``reach`` places away: (keys, pos, word, near).

    Only tokens of the two lists leave the scan, as all others do not count.
    Documents are cut into chunks of positions that overlap by ``reach``, so
    a document of any length is spread over many tasks.
    """
    lists = sorted(set(topic) | set(risk))
    hits = rows.select(*keys, "base", F.posexplode("tokens").alias("i", "word")).filter(F.col("word").isin(lists))
    pos = F.col("pos")
    placed = hits.withColumn("pos", F.col("base") + F.col("i")).withColumn("_own", F.floor(pos / chunk))
    around = F.array_distinct(F.array(F.floor((pos - reach) / chunk), F.col("_own"), F.floor((pos + reach) / chunk)))
    spread = placed.withColumn("_chunk", F.explode(around))
    w = W.partitionBy(*keys, "_chunk").orderBy("pos").rangeBetween(-reach, reach)
    counted = spread.withColumn("near", F.sum(F.col("word").isin(list(risk)).cast("int")).over(w))
    own = counted.filter((F.col("_chunk") == F.col("_own")) & F.col("word").isin(list(topic)))
    return own.select(*keys, "pos", "word", "near")


def lexicon_scores(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    topic: Sequence[str],
    risk: Sequence[str],
    stop_words: Sequence[str] = (),
    reach: int = 10,
    chunk: int = CHUNK,
) -> DataFrame:
    """Per document: topic share, risk share, and the co-occurrence score
    (frequency of a topic word times the risk words near it, summed over its occurrences).

    The texts of a document are read in ``order`` as if joined, without
    joining them. All sums are of whole numbers until the last division.
    """
    keys = list(keys)
    rows = document_positions(df, keys, order, text, stop_words)
    plain = df.select(*keys, kept_tokens(F.col(text), stop_words).alias("tokens"))
    totals = plain.groupBy(*keys).agg(
        F.sum(F.size("tokens")).alias("tokens"),
        F.sum(F.size(F.filter("tokens", lambda t: t.isin(list(topic))))).alias("_topic"),
        F.sum(F.size(F.filter("tokens", lambda t: t.isin(list(risk))))).alias("_risk"),
    )
    near = neighbourhoods(rows, keys, topic, risk, reach, chunk)
    words = near.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("_n"), F.sum("near").alias("_s"))
    joint = words.groupBy(*keys).agg(F.sum(F.col("_n") * F.col("_s")).alias("_joint"))

    def share(c: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(c, F.col("tokens")), F.lit(0.0)), 9)

    return join_on(totals, joint, keys, "left").select(
        *keys, "tokens", share(F.col("_topic")).alias("topic_score"), share(F.col("_risk")).alias("risk_score"),
        share(F.coalesce("_joint", F.lit(0))).alias("joint_score"),
    )


def reconcile_lexicon(words: Sequence[str], neighbours: DataFrame, word: str = "similar_word") -> DataFrame:
    """State of every word of a list against a neighbour table: matched, unmatched, or extra there."""
    spark = neighbours.sparkSession
    listed = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], f"{word} string")
    known = neighbours.select(word).distinct()
    return (
        listed.join(known, word, "left_semi").withColumn("state", F.lit("matched"))
        .unionByName(listed.join(known, word, "left_anti").withColumn("state", F.lit("unmatched")))
        .unionByName(known.join(F.broadcast(listed), word, "left_anti").withColumn("state", F.lit("extra")))
    )


# Similarity of groups of texts


def _term_weights(df: DataFrame, keys: Sequence[str], text: str, idf: DataFrame) -> DataFrame:
    """(keys, word, weight): term frequency times idf, scaled to length 1 per key."""
    terms = df.select(*keys, F.explode(kept_tokens(F.col(text))).alias("word"))
    tf = terms.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("_tf"))
    weighed = tf.join(idf, "word").withColumn("_w", F.col("_tf") * F.col("idf"))
    norms = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return weighed.join(norms, list(keys)).select(*keys, "word", (F.col("_w") / F.col("_norm")).alias("weight"))


def smooth_idf(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """ln((1 + documents) / (1 + documents with the word)) + 1."""
    total = df.count()
    words = df.select(id_col, F.explode(F.array_distinct(kept_tokens(F.col(text)))).alias("word"))
    used = words.groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
    return used.select("word", (F.ln((1.0 + total) / (1.0 + F.col("_df"))) + 1.0).alias("idf"))


def group_similarity(
    group: DataFrame,
    others: DataFrame,
    id_col: str,
    by: str,
    text: str,
    per_object: int = 300,
    pairing: str = "rank",
    seed: int = 42,
) -> DataFrame:
    """Mean TF-IDF cosine between a group of texts and a sample of each object's texts.

    ``rank`` pairs the i-th text of the group with the i-th of the object.
    ``full`` is the mean over all pairs; as the mean of products is the
    product of mean vectors, no pair is formed for it. Objects without any
    text keep their count and a null similarity.
    """
    texts = group.filter(F.col(text).isNotNull()).select(id_col, text)
    idf = smooth_idf(texts, id_col, text)
    w = W.partitionBy(by).orderBy(seeded_key(id_col, seed))
    drawn = (
        others.filter(F.col(text).isNotNull()).select(by, id_col, text)
        .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_object)
    )
    counts = others.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    theirs = _term_weights(drawn, [by, "_r"], text, idf)
    if pairing == "rank":
        first = texts.orderBy(seeded_key(id_col, seed)).limit(per_object)
        first = first.withColumn("_r", F.row_number().over(W.partitionBy().orderBy(seeded_key(id_col, seed))))
        ours = _term_weights(first, ["_r"], text, idf).withColumnRenamed("weight", "_ours")
        dots = theirs.join(ours, ["_r", "word"]).groupBy(by).agg(F.sum(F.col("weight") * F.col("_ours")).alias("_dot"))
        size = first.count()
        pairs = drawn.filter(F.col("_r") <= size).groupBy(by).agg(F.count(F.lit(1)).alias("_pairs"))
    else:
        ours = _term_weights(texts, [id_col], text, idf).groupBy("word").agg(F.sum("weight").alias("_ours"))
        sums = theirs.groupBy(by, "word").agg(F.sum("weight").alias("_theirs"))
        dots = sums.join(ours, "word").groupBy(by).agg(F.sum(F.col("_theirs") * F.col("_ours")).alias("_dot"))
        size = texts.count()
        pairs = drawn.groupBy(by).agg((F.count(F.lit(1)) * size).alias("_pairs"))
    out = counts.join(pairs, by, "left").join(dots, by, "left")
    mean = F.when(F.col("_pairs") > 0, F.coalesce("_dot", F.lit(0.0)) / F.col("_pairs"))
    return out.select(by, "n", F.round(mean, 6).alias("similarity")).orderBy(F.col("similarity").desc_nulls_last(), by)


# Sections of long texts


def section_between(
    col: Column, titles: Sequence[str], next_titles: Sequence[str], not_before: str = "“。分一中关之》\"—”第."
) -> Column:
    """Text after the earliest title up to the first following heading.

    A title counts if none of ``not_before`` follows it. The section starts
    behind its first occurrence that is followed by white space; null if
    there is none. Further occurrences of the title are left out.
    """
    barred = "".join("\\" + c if c in "\\]^-" else c for c in not_before)
    topic = F.nullif(F.regexp_extract(col, "(" + quote_words(titles) + f")(?:[^{barred}]|\\z)", 1), F.lit(""))
    bodies = [
        F.when(topic == t, F.nullif(F.regexp_extract(col, "(?s)" + quote_words([t]) + "([\\n\\t ].*)", 1), F.lit("")))
        for t in titles
    ]
    body = F.replace(F.coalesce(*bodies), topic, F.lit(""))
    return F.regexp_extract(body, "(?s)^(.*?)(?:" + quote_words(next_titles) + "|\\z)", 1)


def sections_to_blank_line(col: Column, titles: Sequence[str], at_least: int = 300) -> Column:
    """All sections from a title line ``title:`` to the first blank line past ``at_least`` characters."""
    pattern = f"(?s)((?:{quote_words(titles)}):[^\\S\\n]*\\n.{{{at_least}}}.*?)(?:\\n\\n|\\z)"
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(1))
