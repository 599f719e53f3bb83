"""Texts searched for all words of a list at once: automata of bounded size, dealt over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Words of one automaton: about 60 bytes of memory a character.
SHARD_CHARS = 2_000_000
# Texts that one task of a sharded search holds.
PART_CHARS = 32_000_000


def _automaton(words: list[str], values: list):
    """A trie of the words with failure links: one pass over a text finds all that it holds."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, value in zip(words, values):
        automaton.add_word(word, value)
    automaton.make_automaton()
    return automaton


def over_automata(
    texts: DataFrame,
    text: str,
    words: DataFrame,
    find: Callable[[pa.Table, object], pa.Table],
    schema: T.StructType,
    shard_chars: int = SHARD_CHARS,
    part_chars: int = PART_CHARS,
) -> tuple[DataFrame, int]:
    """``find(rows, automaton)`` for all texts and all words, and the number of automata that a text met.

    ``words`` has distinct ``_w`` and a value ``_v`` that a hit yields. Words
    of up to ``shard_chars`` characters in all, counted first, are one
    automaton that is broadcast, and texts are not shuffled. More words are
    dealt over shards of that size, texts over parts of about ``part_chars``
    characters, and each shard meets each part. Nothing is found without words.
    """
    columns, value_type = texts.columns, words.schema["_v"].dataType
    empty = texts.sparkSession.createDataFrame([], schema)
    shards = -(-int(words.agg(F.sum(F.length("_w"))).first()[0] or 0) // shard_chars)
    if not shards:
        return empty, 1
    if shards == 1:
        rows = words.select("_w", "_v").collect()
        shared = texts.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(*shared.value)
            for batch in batches:
                yield from find(pa.Table.from_batches([batch]), automaton).to_batches()

        return texts.mapInArrow(scan, schema), 1

    parts = max(1, -(-int(texts.agg(F.sum(F.length(text))).first()[0] or 0) // part_chars))
    key = ["_shard", "_part"]
    listed = words.select(
        "_w", F.col("_v").cast(value_type), F.pmod(F.xxhash64("_w"), F.lit(shards)).cast("int").alias("_shard"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"),
    )
    # Dealt by text and what tells equal texts apart, so that no key is crowded.
    own = F.pmod(F.xxhash64(text, *[c for c in columns if c != text]), F.lit(parts)).cast("int")
    dealt = texts.withColumn("_part", own).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def meet(known: pa.Table, held: pa.Table) -> pa.Table:
        held = held.select(columns)
        if not known.num_rows or not held.num_rows:
            return find(held.slice(0, 0), None)
        return find(held, _automaton(known.column("_w").to_pylist(), known.column("_v").to_pylist()))

    return listed.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(meet, schema), shards
