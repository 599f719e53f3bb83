"""Near duplicates by one-permutation MinHash with optimal densification.

Each text becomes the set of its distinct word shingles. One hash function
deals the shingles over bins, the least hash of a bin is its value, and an
empty bin borrows from a bin that a hash of its own number points to
(optimal densification). Bands of bin values are bucket keys.

Texts with equal sets are one class and go on as one representative. A bucket
links each member to the bucket's centre only, so candidate edges are stars
and their number stays in proportion to the rows, however full a bucket is.
Every candidate is confirmed on the full sets. A round takes a quarter of the
bands; the first one differs in how it chooses centres, and in the later ones
only buckets that still hold several components are looked at, and their
centres are chosen among these. Texts of buckets that hold several
components after that are joined on their rarest shingles, which meets every
pair of different components that is similar enough, so no bucket keeps a
pair that is neither confirmed nor ruled out.

Text without words and null text have an empty set, are linked with nothing
and stay. Rows that repeat an id count as one document for links. Null ids
are never linked. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from casebook.functions.runtime import cut_lineage
from casebook.llm.arrays import blocks, coded_words, in_batches, texts_of

SHINGLE = 2
BINS, ROWS_PER_BAND = 128, 4
PERCENT = 80
BLOCK_ROWS = 1_024
CACHED_WORDS = 100_000
CENTRES = 4
# Rounds go through all bands, some at a time, twice.
BANDS_A_ROUND, MAX_ROUNDS = 8, 8
# Sizes of one step differ by less than this factor.
SIZE_FACTOR = 1.06
SKETCH = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"
MIX1, MIX2, MIX3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit shingle hashes of each text."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[str, int] = {}

    @staticmethod
    def _word(word: str) -> int:
        return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")

    def __call__(self, texts: pa.LargeStringArray) -> Iterator[np.ndarray]:
        bounds, codes, distinct = coded_words(pc.ascii_lower(texts))
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, word = self.known, self._word
        hashes = np.array([known.get(w) or known.setdefault(w, word(w)) for w in distinct], np.uint64)
        rolled, size = hashes[codes], self.size
        with np.errstate(over="ignore"):
            all_n = rolled[: max(0, len(rolled) - size + 1)].copy()
            for k in range(1, size):
                all_n = mixed(all_n * MIX3 + rolled[k : k + len(all_n)])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a >= size:
                    yield np.unique(all_n[a : b - size + 1])
                elif b > a:
                    whole = rolled[a : a + 1].copy()
                    for k in range(a + 1, b):
                        whole = mixed(whole * MIX3 + rolled[k])
                    # The length goes in: a short sequence never equals a shingle.
                    yield mixed(whole ^ np.uint64(b - a))
                else:
                    yield rolled[:0]


def borrow_table(bins: int) -> np.ndarray:
    """For each bin and attempt, the bin it borrows from when both are empty so far."""
    grid = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(1, 64 * bins // 8, dtype=np.uint64)
    return (mixed(grid + MIX3) % np.uint64(bins)).astype(np.int64)


def signature(shingles: np.ndarray, bins: int, borrow: np.ndarray) -> np.ndarray:
    """Least hash of each bin; sets are sorted, so a bin's first hash is its least."""
    edges = (np.arange(bins + 1, dtype=object) * (2**64 // bins)).tolist()
    starts = np.searchsorted(shingles, np.array(edges[:-1], np.uint64))
    ends = np.append(starts[1:], len(shingles))
    full = ends > starts
    values = shingles[np.minimum(starts, len(shingles) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        tries = borrow[empty]
        good = full[tries]
        first = good.argmax(axis=1)
        first_full = int(np.flatnonzero(full)[0])
        source = np.where(good.any(axis=1), tries[np.arange(len(empty)), first], first_full)
        values[empty] = values[source]
    return values


def band_keys(values: np.ndarray, rows_per_band: int) -> np.ndarray:
    """One 64-bit key per band, with the band's number in it."""
    grid = values.reshape(-1, rows_per_band)
    with np.errstate(over="ignore"):
        key = mixed(np.arange(len(grid), dtype=np.uint64) + MIX3)
        for k in range(rows_per_band):
            key = mixed(key * MIX3 + grid[:, k])
    return key.view(np.int64)


def sketches(
    docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, bins: int = BINS, rows_per_band: int = ROWS_PER_BAND
) -> DataFrame:
    """Per row: set size, a digest that equals for equal sets, and the band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, borrow = Shingles(shingle), borrow_table(bins)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))]
        )
        for table in blocks(batches, "text", BLOCK_ROWS):
            sizes, digests, bands = [], [], []
            for own in make(texts_of(table.column("text"))):
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                bands.append(band_keys(signature(own, bins, borrow), rows_per_band) if len(own) else None)
            ids = table.column("doc_id").combine_chunks()
            columns = [ids, *(pa.array(c, f.type) for c, f in zip((sizes, digests, bands), list(schema)[1:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows).mapInArrow(run, SKETCH)


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` with its whole shingle set as packed sorted 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(shingle)
        for table in blocks(batches, "text", BLOCK_ROWS):
            sets = [own.tobytes() for own in make(texts_of(table.column("text")))]
            ids = table.column("doc_id").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return in_batches(docs).mapInArrow(run, "doc_id bigint, shingles binary")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[at] == a).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    return edges.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(
        run, "a bigint, b bigint"
    )


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the least node it is connected with, for every node that has an edge.

    Alternates large stars and small stars over edges on disk, so depth
    falls by a factor each round and no component is gathered anywhere. The
    edges stay as they are once they are stars; a count and a sum of hashes
    tell whether they did.
    """
    pair = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    current = edges.select(pair.alias("e")).select("e.*").filter("u <> v").distinct()
    state = None
    while True:
        current = cut_lineage(current)
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        now = tuple(current.agg(F.count(F.lit(1)), mark).first())
        if now == state:
            break
        state = now
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        down = F.struct(F.col("u"), F.col("m").alias("v"))
        across = F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        current = (
            large.join(below, "u").select(F.explode(F.array(down, across)).alias("e")).select("e.*").filter("u <> v").distinct()
        )
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def joined_up(grouped: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: only the components that the links touch are grouped again."""
    if grouped is None:
        return components(links)
    name = grouped.select("node", "component")
    a = links.join(name.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left")
    ends = a.join(name.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")
    )
    merged = cut_lineage(components(ends)).select(F.col("node").alias("component"), F.col("component").alias("least"))
    # Nodes without an earlier link come in under their own name.
    old = grouped.join(merged, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    new = merged.join(grouped.select("node"), F.col("component") == F.col("node"), "left_anti").select(
        F.col("component").alias("node"), F.col("least").alias("component")
    )
    return old.unionByName(new)


def named(members: DataFrame, grouped: DataFrame | None) -> DataFrame:
    """Bucket members with their ``component`` so far."""
    if grouped is None:
        return members.withColumn("component", F.col("doc_id"))
    found = grouped.select(F.col("node").alias("doc_id"), "component")
    return members.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def unsettled(members: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    several = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    return members.join(several.select("key"), "key", "left_semi")


def centres(members: DataFrame, turn: int) -> DataFrame:
    """``key`` and ``c``, the centre of each bucket in this turn.

    ``members`` has ``key``, ``doc_id``, ``n`` (set size) and ``component``.
    The centre is the member least in a hash of ``turn`` and the band key's
    class, so bands choose different centres.
    """
    lot = F.pmod(F.col("key"), F.lit(CENTRES)) if turn == 0 else F.lit(turn * CENTRES)
    rank = F.xxhash64(F.lit(turn), lot, F.col("component") if turn else F.col("doc_id"))
    return members.withColumn("rank", rank).groupBy("key").agg(F.min(F.struct("rank", "doc_id", "n", "component")).alias("c"))


def star_edges(members: DataFrame, centre: DataFrame) -> DataFrame:
    """Edges from bucket members to their bucket's centre.

    Members of the centre's own component and pairs whose sizes rule the
    similarity out give no edge.
    """
    return (
        members.join(centre, "key")
        .filter(F.col("component") != F.col("c.component"))
        .filter(F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * PERCENT)
        .select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b"))
        .distinct()
    )


def shingle_rows(sets: DataFrame) -> DataFrame:
    """A row for each shingle of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id"), batch.column("shingles")):
                tokens = np.frombuffer(own.as_buffer(), np.int64)
                ids = np.full(len(tokens), doc_id.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tokens)], names=["doc_id", "token"])

    return in_batches(sets.select("doc_id", "shingles")).mapInArrow(run, "doc_id bigint, token bigint")


def rare_edges(texts: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges between different components that hold every pair that is similar enough.

    ``texts`` has ``doc_id``, ``n`` and ``component``. In one order of all
    shingles, the first shingle that two sets with ``k`` in common share
    stands among the first ``n - k + 1`` of each. The order puts shingles
    that only one component has first: they take up places and join nothing.
    Rare ones follow. How many two sets must share depends on both sizes, so
    sizes go in steps, and a shingle meets another step only if its place
    still allows what the sizes of both ask for. Pairs within a component are
    never formed.
    """
    rows = cut_lineage(shingle_rows(sets.join(texts.select("doc_id"), "doc_id", "left_semi")).join(texts, "doc_id"))
    use = (
        rows.groupBy("token")
        .agg(F.count(F.lit(1)).alias("use"), F.min("component").alias("x"), F.max("component").alias("y"))
        .filter("x <> y").select("token", "use")
    )
    ordered = rows.join(use.hint("merge"), "token").groupBy("doc_id", "n", "component").agg(F.array_sort(F.collect_list(F.struct("use", "token"))).alias("own"))
    held = ordered.withColumn("alone", F.col("n") - F.size("own"))
    # The larger set of a pair shares at least ``percent`` of its size.
    first = F.slice("own", 1, F.greatest(F.floor(F.col("n") * (100 - percent) / 100) + 1 - F.col("alone"), F.lit(0)).cast("int"))
    placed = held.select("doc_id", "n", "component", "alone", F.posexplode(first).alias("i", "t"))
    step = F.floor(F.log("n") / math.log(SIZE_FACTOR) + 1e-9).cast("int")
    placed = cut_lineage(placed.select(
        "doc_id", "n", "component", F.col("t.token").alias("token"), (F.col("alone") + F.col("i") + 1).alias("place"), step.alias("step")
    ))
    steps = F.sequence(F.lit(0), F.lit(math.ceil(math.log(100 / percent) / math.log(SIZE_FACTOR))))

    def least_size(of: Column) -> Column:
        return F.floor(F.pow(F.lit(SIZE_FACTOR), of) * (1 - 1e-6))

    def allows(other: Column) -> Column:
        """Whether what comes from this place on is enough for a pair with a set of size ``other``."""
        return (F.col("n") - F.col("place") + 1) * (100 + percent) >= (F.col("n") + other) * percent

    far = F.filter(steps, lambda d: allows(F.greatest(F.col("n"), least_size(F.col("step") + d))))
    smaller = placed.withColumn("apart", F.explode(far)).withColumn("low", F.col("step"))
    near = F.filter(steps, lambda d: allows(F.greatest(F.ceil(F.col("n") * percent / 100 - 1e-9), least_size(F.col("step") - d))))
    larger = placed.withColumn("apart", F.explode(near)).withColumn("low", F.col("step") - F.col("apart"))
    key = ["token", "low", "apart"]

    def side(of: DataFrame, name: str) -> DataFrame:
        return of.select(*key, *[F.col(c).alias(c + name) for c in ("doc_id", "n", "component", "place")])

    def bounds(of: DataFrame, name: str) -> DataFrame:
        """Per shingle and component: how much can come from it on at most, and the least size."""
        return of.groupBy(*key, F.col("component").alias("component" + name)).agg(
            F.max(F.col("n") - F.col("place")).alias("rest" + name), F.min("n").alias("least" + name)
        )

    def enough(rest: Column, one: Column, other: Column) -> Column:
        return (rest + 1) * (100 + percent) >= (one + other) * percent

    # Components first, so that pairs within one are never formed; what no member can reach goes.
    met = (
        bounds(smaller, "_s").join(bounds(larger, "_l").hint("merge"), key)
        .filter("component_s <> component_l")
        .filter(enough(F.least("rest_s", "rest_l"), F.col("least_s"), F.greatest("least_s", "least_l")))
    )
    # Then the members of one side that some member of the other may be a partner of.
    half = met.join(side(smaller, "_s").hint("merge"), [*key, "component_s"]).filter(
        enough(F.least(F.col("n_s") - F.col("place_s"), F.col("rest_l")), F.col("n_s"), F.greatest("n_s", "least_l"))
        & (F.col("n_s") * 100 >= F.col("least_l") * percent)
    )
    pairs = half.join(side(larger, "_l").hint("merge"), [*key, "component_l"])
    common = F.least(F.col("n_s") - F.col("place_s"), F.col("n_l") - F.col("place_l")) + 1
    return (
        pairs.filter(F.struct("n_s", "doc_id_s") < F.struct("n_l", "doc_id_l"))
        .filter(F.col("n_s") * 100 >= F.col("n_l") * percent)
        .filter(enough(common - 1, F.col("n_s"), F.col("n_l")))
        .select(F.least("doc_id_s", "doc_id_l").alias("a"), F.greatest("doc_id_s", "doc_id_l").alias("b"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    rows = cut_lineage(sketches(docs, id_col, text_col, shingle))
    classes = (
        rows.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r"))
        .select("r.*", "digest")
    )
    members = classes.select(
        F.posexplode("bands").alias("band", "key"), "doc_id", F.col("n_shingles").alias("n")
    )
    full = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    members = cut_lineage(members.join(full, "key"))
    involved = members.select("doc_id").distinct()
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = texts.join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = cut_lineage(shingle_sets(wanted, shingle))
    grouped, tried, bands = None, None, BINS // ROWS_PER_BAND

    def linked(edges: DataFrame) -> bool:
        """Confirms edges and joins their ends up; whether there were links."""
        nonlocal grouped, tried
        edges = cut_lineage(edges if tried is None else edges.join(tried, ["a", "b"], "left_anti"))
        if edges.isEmpty():
            return False
        tried = edges if tried is None else tried.unionByName(edges)
        new = cut_lineage(confirmed(edges, sets, percent))
        if new.isEmpty():
            return False
        grouped = cut_lineage(joined_up(grouped, new))
        return True

    for turn in range(MAX_ROUNDS):
        current = named(members.filter(F.floor(F.col("band") / BANDS_A_ROUND) == turn % -(-bands // BANDS_A_ROUND)), grouped)
        if turn:
            current = cut_lineage(unsettled(current))
        if not current.isEmpty():
            linked(star_edges(current, centres(current, turn)))
    rest = cut_lineage(unsettled(named(members, grouped)).select("doc_id", "n", "component").distinct())
    if not rest.isEmpty():
        linked(rare_edges(rest, sets, percent))
    found = classes.select("digest", F.col("doc_id").alias("node"))
    if grouped is not None:
        found = found.join(grouped, "node", "left")
    else:
        found = found.withColumn("component", F.lit(None).cast("bigint"))
    found = found.select("digest", F.coalesce("component", "node").alias("component_id"))
    return (
        rows.select("doc_id", "n_shingles", "digest")
        .join(found, "digest", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
