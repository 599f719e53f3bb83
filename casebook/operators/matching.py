"""Joins: enrichment, membership, repair, name matching and containment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from casebook.functions.runtime import cut_lineage, join_on
from casebook.functions.text import strip_all_spaces, strip_brackets
from casebook.functions.tries import Trie
from casebook.operators.automata import PART_CHARS, SHARD_CHARS, over_automata
from casebook.operators.ordering import align_union, keep_first


def enrich(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str = "_right") -> DataFrame:
    """Left join that keeps every left row; clashing right columns get a suffix."""
    clash = [c for c in right.columns if c in left.columns and c not in on]
    for c in clash:
        right = right.withColumnRenamed(c, c + suffix)
    return left.join(right, list(on), "left")


def only_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def not_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner; null keys have none, so they stay."""
    return df.join(keys.select(*on), list(on), "left_anti")


def not_in_earlier(df: DataFrame, earlier: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Rows not yet drawn by any earlier sample."""
    return not_in(df, align_union([e.select(*on) for e in earlier]).distinct(), on)


def overwrite(df: DataFrame, updates: DataFrame, on: str, cols: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Replace ``cols`` in matched rows; of several updates of a key the last in ``order`` counts."""
    newest = updates.groupBy(on).agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("_new"),
    )
    joined = df.join(newest, on, "left")
    for c in cols:
        joined = joined.withColumn(c, F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)))
    return joined.drop("_new")


def fill_missing(df: DataFrame, other: DataFrame, on: str, cols: Sequence[str]) -> DataFrame:
    """Own value first, the joined one where it is null."""
    renamed = other.select(on, *[F.col(c).alias(f"_o_{c}") for c in cols])
    joined = df.join(renamed, on, "left")
    for c in cols:
        joined = joined.withColumn(c, F.coalesce(F.col(c), F.col(f"_o_{c}"))).drop(f"_o_{c}")
    return joined


def expand_names(df: DataFrame, short: str, pairs: DataFrame) -> DataFrame:
    """One row per distinct full name of the row's abbreviation."""
    return df.withColumn(short, F.trim(short)).join(pairs.filter(F.col(short).isNotNull()).distinct(), short)


def normalised_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Inner join on names that are equal after trimming and lower-casing."""
    keyed = right.withColumn("_k", F.lower(F.trim(right_col)))
    return left.withColumn("_k", F.lower(F.trim(left_col))).join(keyed, "_k").drop("_k")


def two_stage_match(names: DataFrame, name: str, targets: DataFrame, target: str) -> DataFrame:
    """Exact match first, then with bracketed parts removed; ``stage`` is null when unmatched."""
    wanted = names.select(name).filter(F.col(name).isNotNull()).distinct()
    known = targets.select(F.col(target).alias("_t")).filter(F.col("_t").isNotNull()).distinct()
    exact = wanted.join(known, F.col(name) == F.col("_t"), "left_semi").withColumn("stage", F.lit("exact"))
    rest = wanted.join(known, F.col(name) == F.col("_t"), "left_anti").withColumn("_k", strip_brackets(F.col(name)))
    bare = known.select(strip_brackets(F.col("_t")).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    second = rest.join(bare, "_k", "left").select(
        name, F.when(F.col("_hit"), F.lit("brackets")).alias("stage")
    )
    return exact.unionByName(second)


def spacing_rule_match(names: DataFrame, name: str, targets: DataFrame, target: str) -> DataFrame:
    """Which rule finds the name: same, same without blanks, same without any white space."""
    known = targets.select(F.col(target).alias("_t")).filter(F.col("_t").isNotNull()).distinct()
    rules = [
        ("same", lambda c: c),
        ("no_blanks", lambda c: F.replace(c, F.lit(" "), F.lit(""))),
        ("no_space", strip_all_spaces),
    ]
    out = names.select(name).distinct()
    for label, change in rules:
        keys = known.select(change(F.col("_t")).alias("_k")).distinct().withColumn(f"_{label}", F.lit(True))
        out = out.withColumn("_k", change(F.col(name))).join(keys, "_k", "left").drop("_k")
    rule = F.coalesce(*[F.when(F.col(f"_{label}"), F.lit(label)) for label, _ in rules])
    return out.select(name, rule.alias("rule"))


def containment_join(
    texts: DataFrame, text: str, names: DataFrame, name: str, shard_chars: int = SHARD_CHARS, part_chars: int = PART_CHARS
) -> DataFrame:
    """One row per (text row, name) whose text holds the name.

    An automaton finds all names in one pass over a text, whatever their
    number; ``over_automata`` says how long lists are dealt. A task hands back
    each text once with the list of its names, which is exploded after it, so
    that no task holds a copy of the text per name. Equal names count once;
    null and empty names and null texts match nothing.
    """
    words = names.select(F.col(name).alias("_w")).filter(F.coalesce(name, F.lit("")) != "").distinct()
    schema = T.StructType([*texts.schema.fields, T.StructField("_found", T.ArrayType(T.StringType()))])

    def find(table: pa.Table, automaton) -> pa.Table:
        rows, sizes, found = [], [0], []
        for i, value in enumerate(table.column(text)):
            hits = {word for _, word in automaton.iter(value.as_py())}
            if hits:
                rows.append(i)
                found += sorted(hits)
                sizes.append(len(found))
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(found, pa.string()))
        return table.take(pa.array(rows, pa.int64())).append_column("_found", lists)

    usable = texts.filter(F.col(text).isNotNull())
    met = over_automata(usable, text, words.withColumn("_v", F.col("_w")), find, schema, shard_chars, part_chars)[0]
    return met.select(*texts.columns, F.explode("_found").alias(name))


def keyword_lookup(df: DataFrame, col: str, word: str, limit: int = 100) -> DataFrame:
    return df.select(col).distinct().filter(F.col(col).contains(word)).orderBy(col).limit(limit)


def resolve_existence(df: DataFrame, name: str, present: DataFrame, out: str, missing: str) -> DataFrame:
    """Use the name itself if it is known, else ``missing``; a value already set stays."""
    known = present.select(F.col(name)).filter(F.col(name).isNotNull()).distinct().withColumn("_known", F.lit(True))
    joined = df.join(known, name, "left")
    settled = F.col(out).isNotNull() & (F.col(out) != missing) & (F.col(out) != "")
    value = F.when(settled, F.col(out)).when(F.col("_known"), F.col(name)).otherwise(F.lit(missing))
    return joined.withColumn(out, value).drop("_known")


def membership_flag(df: DataFrame, keys: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    marked = keys.select(*on).distinct().withColumn("_in", F.lit(1))
    return df.join(marked, list(on), "left").withColumn(flag, F.coalesce("_in", F.lit(0))).drop("_in")


MAX_FILTER_BITS = 20
PROBES = (1, 2)


def maybe_wanted(wanted: DataFrame, key: str, max_bits: int = MAX_FILTER_BITS) -> Column:
    """A test that holds for every id in ``wanted`` and for few others: a range and a Bloom filter.

    The filter is built where the ids are, in pieces of fixed size, and has
    16 bits an id, at most ``2 ** max_bits`` in all (128 KiB): more ids only
    let more others through. Both parts are built-in expressions, so the test
    is part of the scan, and files outside the range are skipped.
    """
    n, low, high = wanted.agg(F.count(key), F.min(key), F.max(key)).first()
    if not n:
        return F.lit(False)
    bits = min(max_bits, max(15, (16 * n).bit_length()))

    def place(probe: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key), F.lit(probe)), F.lit(1 << bits))

    placed = wanted.filter(F.col(key).isNotNull()).select(F.explode(F.array(*[place(p) for p in PROBES])).alias("_p"))
    pieces = placed.groupBy(F.shiftright("_p", 15).alias("_at")).agg(F.bitmap_construct_agg(F.col("_p").bitwiseAND(F.lit((1 << 15) - 1))).alias("_b"))
    bitmap = bytearray(1 << (bits - 3))
    # At most 2 ** (max_bits - 15) pieces of 4 KiB.
    for r in pieces.collect():
        bitmap[r["_at"] << 12 : (r["_at"] + 1) << 12] = r["_b"]
    held = F.lit(bitmap)

    def hit(probe: int) -> Column:
        byte = F.substring(held, (F.shiftright(place(probe), 3) + 1).cast("int"), F.lit(1))
        return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), place(probe).bitwiseAND(F.lit(7)).cast("int")) == 1

    test = F.col(key).between(F.lit(low), F.lit(high))
    for probe in PROBES:
        test = test & hit(probe)
    return test


def lookup_features(targets: DataFrame, facts: DataFrame, key: str, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Every target id with the features of its first fact row.

    The facts are cut to the wanted ids before anything else is done with
    them: in the scan to about those, then by a semi join to exactly those.
    """
    likely = facts.filter(maybe_wanted(targets.select(key), key))
    wanted = likely.select(key, *cols, *[o for o in order if o not in cols]).join(targets.select(key), key, "left_semi")
    return targets.join(keep_first(wanted, [key], order).select(key, *cols), key, "left")


def name_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(1.0))


def _rare_gram_pairs(a: DataFrame, name: str, b: DataFrame, target: str, threshold: float) -> DataFrame:
    """Pairs that include all at or above ``threshold``.

    ``k`` edits spoil at most ``q * k`` q-grams, so similar words share a
    known number of them. With all grams in one order, rare ones first, two
    such words then share a gram among the first ones of each; only those are
    joined. Words whose longer one is short use single characters.
    """
    loss = 1.0 - threshold
    bound = 2 * loss
    # The longer word of a pair on single characters has at most this length.
    short = int(2 / (1 - bound)) + 2 if bound < 1 else None

    def tokens(df: DataFrame, col: str) -> DataFrame:
        n = F.length(col)
        single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(col, i, F.lit(1)))
        need = F.greatest(F.lit(1), F.ceil(n * threshold - 1e-9))
        kinds = [df.filter(n <= short if short else F.lit(True)).select(col, F.lit(1).alias("_q"), need.alias("_need"), F.explode(single).alias("_g"))]
        if short:
            double = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(col, i, F.lit(2)))
            need = F.greatest(F.lit(1), F.ceil(F.greatest(n, F.lit(short + 1)) * (1 - bound) - 1 - 1e-9))
            long = df.filter((n >= 2) & (n > short * threshold - 1e-9))
            kinds.append(long.select(col, F.lit(2).alias("_q"), need.alias("_need"), F.explode(double).alias("_g")))
        every = kinds[0] if len(kinds) == 1 else kinds[0].unionByName(kinds[1])
        # The n-th occurrence of a gram counts as a gram of its own.
        counted = every.groupBy(col, "_q", "_need", "_g").agg(F.count(F.lit(1)).cast("int").alias("_t"))
        return counted.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_t")))).drop("_t")

    left, right = tokens(a, name), tokens(b, target)
    key = ["_q", "_g", "_nth"]
    use = left.select(*key).unionByName(right.select(*key)).groupBy(*key).agg(F.count(F.lit(1)).alias("_use"))

    def prefix(tokened: DataFrame, col: str) -> DataFrame:
        own = W.partitionBy(col, "_q")
        ranked = tokened.join(use.hint("merge"), key).withColumn("_rn", F.row_number().over(own.orderBy("_use", "_g", "_nth"))).withColumn(
            "_all", F.count(F.lit(1)).over(own)
        )
        return ranked.filter(F.col("_rn") <= F.col("_all") - F.col("_need") + 1).select(col, *key)

    # Exploded grams are more than Spark estimates: never broadcast.
    return prefix(left, name).join(prefix(right, target).hint("merge"), key).select(name, target).distinct()


# Targets of one trie, in cells of its matrix, and names that one task walks through it at a time.
TRIE_CELLS = 4_000_000
NAMES_PER_TASK = 500
# Names up to this length are compared with one edit by their shortened forms, one for each character.
SHORT_NAME = 64
# Pairs of a trie and a task for each shuffle partition, in a band of lengths with few tries.
TASKS_PER_PARTITION = 4


def _one_edit(wanted: DataFrame, name: str, known: DataFrame, target: str) -> DataFrame:
    """(name, _d, _best) for each wanted name: its best target one edit away and 1 - its score, else nulls.

    Words one edit apart agree once a character is left out: at one place of
    both, or of the longer one only. All words meet under these forms, and a
    form passes on no pairs but the first targets it has, so the work grows
    with the lengths of the words alone. Longer names than ``SHORT_NAME``
    come out with nulls.
    """

    def forms(rows: DataFrame, col: str, longest: int, own: Column, other: Column) -> DataFrame:
        short = rows.filter(F.length(col) <= longest)
        cut = short.select(col, F.explode(F.sequence(F.lit(0), F.length(col))).alias("_at"))
        form = F.when(F.col("_at") == 0, F.col(col)).otherwise(
            F.concat(F.substring(col, F.lit(1), F.col("_at") - 1), F.substring(col, F.col("_at") + 1, F.length(col)))
        )
        return cut.select(form.alias("_form"), "_at", own.alias(name), other.alias("_t"))

    null = F.lit(None).cast("string")
    both = forms(wanted, name, SHORT_NAME, F.col(name), null).unionByName(forms(known, target, SHORT_NAME + 1, null, F.col(target)))
    same, placed = W.partitionBy("_form"), W.partitionBy("_form", "_at")
    # The target itself without the name's character, targets with one more, and the first two that differ at this place.
    met = both.withColumn("_whole", F.min(F.when(F.col("_at") == 0, F.col("_t"))).over(same)).withColumn(
        "_longer", F.min(F.when(F.col("_at") > 0, F.col("_t"))).over(same)
    ).withColumn("_first", F.min("_t").over(placed)).withColumn("_second", F.min(F.when(F.col("_t") != F.col("_first"), F.col("_t"))).over(placed))
    changed = F.when(F.col("_first") == F.col(name), F.col("_second")).otherwise(F.col("_first"))
    best = F.when(F.col("_at") == 0, F.col("_longer")).otherwise(F.least(changed, F.col("_whole")))
    d = F.lit(1.0) / (F.length(name) + F.when(F.col("_at") == 0, F.lit(1)).otherwise(F.lit(0)))
    offered = met.filter(F.col(name).isNotNull()).select(name, F.when(best.isNotNull(), F.struct(d.alias("_d"), best.alias("_best"))).alias("_o"))
    # Longer names offer nothing.
    beyond = wanted.filter(F.length(name) > SHORT_NAME).select(name, F.lit(None).cast("double").alias("_d"), null.alias("_best"))
    return offered.groupBy(name).agg(F.min("_o").alias("_o")).select(name, "_o._d", "_o._best").unionByName(beyond)


def _best_in_trie(names: list[str], targets: list[str], threshold: float, at_once: int = NAMES_PER_TASK) -> tuple[list[int], list[str], list[float]]:
    """For each name that has one the best target in a trie: number of the name, target, score."""
    trie = Trie(targets)
    rows, best, score = [], [], []
    for first in range(0, len(names), at_once):
        own, found, reached = _walked(names[first : first + at_once], trie, threshold)
        rows += [first + i for i in own]
        best += found
        score += reached
    return rows, best, score


def _walked(names: list[str], trie: Trie, threshold: float) -> tuple[list[int], list[str], list[float]]:
    """``_best_in_trie`` for a few names.

    Names walk the trie with one edit allowed, then two, four and so on. A
    name is settled once no target with more edits can beat what it has, or
    could reach the threshold.
    """
    sizes = np.array([len(w) for w in trie.words], np.int64)
    lengths = np.array([len(n) for n in names], np.int64)
    most = np.floor((1 - threshold) * lengths / threshold + 1e-9)
    score, word = np.full(len(names), -1.0), np.full(len(names), -1, np.int64)
    left, edits = np.flatnonzero(most >= 1), 1
    while len(left):
        own, hit, d = trie.within([names[i] for i in left], edits)
        real = d > 0
        own, hit, d = left[own[real]], hit[real], d[real]
        reached = 1 - d / np.maximum(lengths[own], sizes[hit])
        enough = reached >= threshold - 1e-9
        own, hit, reached = own[enough], hit[enough], reached[enough]
        order = np.lexsort((hit, -reached, own))
        own, hit, reached = own[order], hit[order], reached[order]
        first = np.ones(len(own), bool)
        first[1:] = own[1:] != own[:-1]
        score[own[first]], word[own[first]] = reached[first], hit[first]
        # The best score with more edits: the longer word is as long as it can be.
        beyond = 1 - (edits + 1) / (lengths[left] + edits + 1)
        left = left[(most[left] > edits) & (score[left] <= beyond + 1e-9)]
        edits *= 2
    found = np.flatnonzero(word >= 0)
    return found.tolist(), [trie.words[i] for i in word[found]], score[found].tolist()


def fuzzy_best_match(
    names: DataFrame, name: str, targets: DataFrame, target: str, threshold: float = 0.75,
    trie_cells: int = TRIE_CELLS, names_per_task: int = NAMES_PER_TASK,
) -> DataFrame:
    """For each distinct name the most similar other target at or above ``threshold``.

    Similarity is 1 - edit distance / longer length; ties go to the target
    first in order. Names that a target one edit away settles meet it under
    their shortened forms. For the others targets are dealt by length into
    tries of bounded size, which Levenshtein automata of the names walk. A
    name visits the tries whose lengths can reach the threshold, and names are
    dealt over tasks, so neither list has to fit anywhere whole. A band of
    lengths has few more pairs of trie and task than the session has shuffle
    partitions, unless its tries alone are more: copies of targets do not
    grow with the names. No pair is lost. Null and empty names match nothing.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    every = names.select(F.col(name)).filter(F.col(name) != "").distinct()
    known = targets.select(F.col(target)).filter(F.col(target) != "").distinct()
    near = cut_lineage(_one_edit(every, name, known, target))
    # As in the walk of a trie: more edits cannot beat it, or none are allowed.
    n = F.length(name)
    most = F.floor((1 - threshold) * n / threshold + 1e-9)
    open_ = (n > SHORT_NAME) | ((most > 1) & (F.coalesce(1 - F.col("_d"), F.lit(-1.0)) <= 1 - 2 / (n + 2) + 1e-9))
    good = F.col("_best").isNotNull() & (1 - F.col("_d") >= threshold - 1e-9)
    settled = near.filter(~open_ & good).select(name, F.col("_best").alias(target), F.round(1 - F.col("_d"), 6).alias("score"))
    wanted = near.filter(open_).select(name)

    def band(length: Column) -> Column:
        return F.floor(F.log2(length.cast("double")) + 1e-9).cast("int")

    n = F.length(name)
    low, high = F.ceil(n * threshold - 1e-9), F.floor(n / threshold + 1e-9)
    visits = wanted.withColumn("_band", F.explode(F.sequence(band(F.greatest(low, F.lit(1))), band(high))))
    shelved = known.withColumn("_band", band(F.length(target)))
    # One row a band, and bands are powers of two.
    cells = {r["_band"]: r["c"] for r in shelved.groupBy("_band").agg((F.count(F.lit(1)) * F.max(F.length(target))).alias("c")).collect()}
    callers = {r["_band"]: r["count"] for r in visits.groupBy("_band").count().collect()}
    used = sorted(set(cells) & set(callers))
    schema = T.StructType([wanted.schema[name], known.schema[target], T.StructField("score", T.DoubleType())])
    if not used:
        return settled

    def number(sizes: dict) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for b in used for x in (b, sizes[b])]), F.col("_band"))

    def dealt(rows: DataFrame, column: str, own: str, own_n: Column, other: str, other_n: Column) -> DataFrame:
        rows = rows.filter(F.col("_band").isin(used)).withColumn(own, F.pmod(F.xxhash64(column), own_n.cast("bigint")).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), (other_n - 1).cast("int"))))

    # The number of partitions is fixed: few bytes here mean much work.
    fan = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shelves = {b: -(-cells[b] // trie_cells) for b in used}
    tries = number(shelves)
    tasks = number({b: min(-(-callers[b] // names_per_task), -(-TASKS_PER_PARTITION * fan // shelves[b])) for b in used})
    key = ["_band", "_trie", "_task"]
    left = dealt(visits, name, "_task", tasks, "_trie", tries).repartition(fan, *key)
    right = dealt(shelved, target, "_trie", tries, "_task", tasks).repartition(fan, *key)

    def walk(own: pa.Table, listed: pa.Table) -> pa.Table:
        asked = own.column(name).to_pylist()
        rows, best, score = _best_in_trie(asked, listed.column(target).to_pylist(), threshold, names_per_task)
        return pa.table([pa.array([asked[i] for i in rows], pa.string()), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=[name, target, "score"])

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(walk, schema)
    best = found.groupBy(name).agg(F.min_by(F.struct(target, "score"), F.struct((-F.col("score")).alias("s"), F.col(target))).alias("_b"))
    return settled.unionByName(best.select(name, F.col(f"_b.{target}").alias(target), F.round("_b.score", 6).alias("score")))
