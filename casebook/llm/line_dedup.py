"""Line deduplication by winnowing over line hashes.

The lines of a text that hold a word, in order, are its sequence. A window is
a run of consecutive lines that reaches ``min_lines`` lines or ``min_words``
words, whichever is sooner, counted on from its first line or back from its
last one; the line with the least hash in a window is selected, so any two
texts that share a whole window select the same line in it. Only windows whose
selected line was selected at several places go on: positions are joined by
the content of the window, each with the first place it occurs at (by id, then
place). Windows that begin at each line extend a match to the left as far as
it goes, windows that end at each line to the right, so together they are
exactly the repeated runs: a line goes if it lies in a run of at least
``min_lines`` lines or ``min_words`` words that occurs at an earlier place.
The first place of a run is never touched, and runs shorter than a window
stay. Links are to first places only, so a line that half of all texts hold
gives no more links than rows.

Lines are compared without blanks around them. Null text and text without
words have no windows and stay as they are. Rows with equal id and text count
as one document. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casebook.functions.runtime import cut_lineage

MIN_LINES = 3
MIN_WORDS = 50
BLANKS = " \t\n\x0b\f\r"
N, H, P = "n", "h", "p"


def split_lines(text: Column) -> Column:
    """Array of (n words, h hash, p place among all lines) for the lines with a word."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda x, i: F.struct(
            F.btrim(x, F.lit(BLANKS)).alias("x"), i.cast("int").alias(P)
        ),
    )
    held = F.filter(lines, lambda x: F.length(x["x"]) > 0)
    return F.transform(
        held,
        lambda x: F.struct(
            F.size(F.split(x["x"], f"[{BLANKS}]+")).alias(N), F.xxhash64(x["x"]).alias(H), x[P].alias(P)
        ),
    )


def windows(lines: Column, min_lines: int, min_words: int) -> Column:
    """Each full window that begins or ends at a line: place, length, selected line and content."""

    def size(i: Column, step: int, k: int = 1) -> Column:
        """Lines from ``i`` on, or back from ``i``, until the window is full."""
        if k == min_lines:
            return F.lit(k)
        enough = sum((F.get(lines, i + step * j)[N] for j in range(1, k)), F.get(lines, i)[N])
        return F.when(enough >= min_words, F.lit(k)).otherwise(size(i, step, k + 1))

    def ending(i: Column) -> Column:
        n = size(i, -1)
        return F.struct((i - n + 1).alias("at"), n.alias("len"))

    # A window that the text is too short for is left out; one that both begins and ends so comes once.
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    forward = F.filter(
        F.transform(every, lambda i: F.struct(i.alias("at"), size(i, 1).alias("len"))), lambda w: w["at"] + w["len"] <= F.size(lines)
    )
    backward = F.filter(F.transform(every, ending), lambda w: (w["at"] >= 0) & (size(w["at"], 1) != w["len"]))

    def described(w: Column) -> Column:
        hashes = F.transform(F.slice(lines, w["at"] + 1, w["len"]), lambda x: x[H])
        least = F.array_min(hashes)
        return F.struct(
            w["at"].alias("at"), w["len"].alias("len"), least.alias("selected"),
            (w["at"] + F.array_position(hashes, least).cast("int") - 1).alias("selected_at"),
            F.xxhash64(hashes).alias("content"),
        )

    return F.transform(F.concat(forward, backward) if min_lines > 1 else forward, described)


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS
) -> DataFrame:
    """``id``, ``mark`` (hash of the text) and ``places``: the lines to delete, counted from 0 among all lines."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), split_lines(F.col(text_col)).alias("lines")
    )
    rows = rows.filter(F.size("lines") > 0).withColumn("w", windows(F.col("lines"), min_lines, min_words))
    selected = rows.withColumn("s", F.transform("w", lambda w: w["selected_at"]))
    # The outer form keeps the optimizer from computing the windows once more in a filter below.
    placed = selected.select("id", "mark", "lines", "s", F.posexplode_outer("w").alias("i", "w")).filter("w IS NOT NULL")
    described = placed.select(
        "id", "mark", "w.*",
        # Whether another line is selected than by the window before: counts a selection of windows in a row once.
        F.coalesce(F.get("s", F.col("i") - 1) != F.col("w.selected_at"), F.lit(True)).alias("new"),
        F.transform(F.slice("lines", F.col("w.at") + 1, F.col("w.len")), lambda x: x[P]).alias("held"),
    )
    found = cut_lineage(described)
    chosen = found.groupBy("selected").agg(F.sum(F.col("new").cast("int")).alias("k")).filter("k > 1").select("selected")
    likely = found.join(chosen, "selected", "left_semi")
    first = (
        likely.groupBy("content").agg(F.min(F.struct("id", "mark", "at")).alias("first"), F.count(F.lit(1)).alias("k"))
        .filter("k > 1").select("content", "first")
    )
    later = likely.join(first, "content").filter(~F.struct("id", "mark", "at").eqNullSafe(F.col("first")))
    # A place per line, so that overlapping windows join up to one run.
    return later.select("id", "mark", F.explode("held").alias("place")).groupBy("id", "mark").agg(
        F.array_sort(F.collect_set("place")).alias("places")
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS
) -> DataFrame:
    """All rows and columns of ``docs`` with the text after deletion; ``n_deleted`` lines went."""
    if "n_deleted" in docs.columns:
        raise ValueError("columns exist already: ['n_deleted']")
    found = repeated_lines(docs, id_col, text_col, min_lines, min_words).select(
        F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("places").alias("__places")
    )
    joined = docs.join(
        found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__mark")), "left"
    )
    kept = F.array_join(
        F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("__places", i.cast("int"))), "\n"
    )
    return joined.select(
        *[F.when(F.col("__places").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.size("__places"), F.lit(0)).alias("n_deleted"),
    )
