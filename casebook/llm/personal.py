"""Personal data: candidates from high-recall generators, chosen by boosted trees.

Generators propose spans that may overlap: the four plain formats (email,
ip, card, phone) without their checks, and loose variants of them (spelt-out
addresses, grouped digit runs, national phone numbers). Spans of a plain
format that pass its check are kept in any case. The other candidates are
scored by gradient-boosted trees over format and context features; a kind's
threshold is the lowest score at which enough of the held-out candidates
above it are sound, and overlaps go to the higher score.

The trees learn from all candidates of the plain formats: those that a format
with its check confirms are positive, those that it refutes are negative. The
checks themselves are no features.

Null text is empty and has no spans. Rows that repeat get the same spans, an
empty table gives an empty result and needs no model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from casebook.functions.runtime import cut_lineage
from casebook.llm.arrays import blocks, in_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
BLOCK_ROWS = 1_024
SCORE_STEPS = 10_000
MIN_PRECISION = 0.95
TREES, DEPTH = 10, 3
CONTEXT = 24
FEATURES = 22
CANDIDATE = "kind string, start bigint, end bigint, plain boolean, sound boolean, features array<float>"

AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# The look-behind only skips starts inside a run of digits that has failed from its beginning.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELT = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at |@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{2,24})+"
)
SPELT_HINTS = ("(at)", "[at]", " at ")
GROUPED = re.compile(r"(?<![0-9A-Za-z])[0-9]{3,4}(?:[ ./-][0-9]{3,6}){1,4}(?![0-9A-Za-z])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}\)|00?[0-9]{2,4})[ /.-]?[0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9A-Za-z])")
DIGIT = re.compile(r"[0-9]")
HINTS = ("mail", "phone", "tel", "call", "card", "visa", "ip", "host", "server", "contact")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at-signs in linear time."""
    free = 0
    for m in AT.finditer(text):
        at = m.start()
        begin = at
        while begin > free and LOCAL.match(text[begin - 1]):
            begin -= 1
        if begin < at:
            yield begin, m.end()
            free = m.end()


def plain_spans(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether the format's check passes) of the plain formats."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b, True
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        yield "ip", m.start(), m.end(), all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split(".")))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() >= 16 else ""
        yield "card", m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in PHONE.finditer(text):
            yield "phone", m.start(), m.end(), 8 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15


def loose_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Variants that the plain formats leave out."""
    if any(h in text for h in SPELT_HINTS):
        for m in re.finditer(r"\(at\)|\[at\]| at (?=[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]|dot ))", text):
            near = SPELT.search(text, max(0, m.start() - 65), min(len(text), m.end() + 160))
            if near and near.start() < m.start() < near.end():
                yield "email", near.start(), near.end()
    for m in GROUPED.finditer(text):
        yield "card" if sum(map(str.isdigit, m.group())) >= 13 else "phone", m.start(), m.end()
    for m in NATIONAL.finditer(text):
        yield "phone", m.start(), m.end()


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format of the span and its neighbourhood; no checksum and no range test among them."""
    span, left, right = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    digits = sum(c in "0123456789" for c in span)
    letters = sum(c.isalpha() for c in span)
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    around = (left + " " + right).lower()
    return [
        *[float(kind == k) for k in KINDS],
        float(len(span)), float(digits), float(letters), digits / max(1, len(span)),
        float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(span.count(".")), float(span.count(" ")), float(span.count("-")), float(span.count("@")), float(span.startswith("+")),
        float("(" in span), float(left[-1:].isalnum()), float(right[:1].isalnum()),
        float(sum(c.isdigit() for c in left)), float(sum(c.isdigit() for c in right)),
        float(sum(h in around for h in HINTS)),
    ]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``row`` (one number per input row) and its candidate spans in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct(
            [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_()), ("sound", pa.bool_()),
             ("features", pa.list_(pa.float32()))]
        )
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("spans", pa.list_(span))])
        for table in blocks(batches, "text", BLOCK_ROWS):
            texts = texts_of(table.column("text"))
            hints = np.asarray(pc.match_substring_regex(texts, r"[0-9@]|[(\[ ]at[)\] ]"))
            out: list[list[dict]] = [[] for _ in range(len(texts))]
            for i in np.flatnonzero(hints).tolist():
                text = texts[i].as_py()
                seen = set()
                for kind, a, b, sound in plain_spans(text):
                    seen.add((a, b))
                    # Single digit runs that are far too short are no candidates.
                    if sound or b - a >= 7:
                        out[i].append((kind, a, b, True, sound))
                for kind, a, b in loose_spans(text):
                    if (a, b) not in seen:
                        seen.add((a, b))
                        out[i].append((kind, a, b, False, False))
                out[i] = [
                    {"kind": k, "start": a, "end": b, "plain": p, "sound": s, "features": features(text, k, a, b)}
                    for k, a, b, p, s in out[i]
                ]
            columns = [table.column("doc_id").combine_chunks(), table.column("row").combine_chunks(), pa.array(out, schema.field("spans").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")
    )
    return in_batches(rows).mapInArrow(run, f"doc_id bigint, row bigint, spans array<struct<{CANDIDATE}>>")


def exploded(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "row", F.explode("spans").alias("s")).select("doc_id", "row", "s.*")


def learn(found: DataFrame, trees: int = TREES, depth: int = DEPTH):
    """Boosted trees and a threshold per kind, from all candidates of a plain format; None if they are all alike.

    Either class weighs half of all, so that rare refutations are seen. A
    fifth is held out for the thresholds: the lowest score (in steps of
    ``1 / SCORE_STEPS``, so that the counts stay few) from which at least
    ``MIN_PRECISION`` of the weight of held-out candidates is sound. A kind
    with fewer than 20 held-out candidates takes the overall one.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    usable = exploded(found).filter("plain").select(
        "kind", F.col("sound").cast("double").alias("label"), (F.xxhash64("row", "start", "kind") % 5 != 0).alias("fit"),
        array_to_vector(F.col("features").cast("array<double>")).alias("features"),
    )
    n = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if min(n.get(0.0, 0), n.get(1.0, 0)) < 5:
        return None
    weight = F.when(F.col("label") == 1, sum(n.values()) / (2.0 * n[1.0])).otherwise(sum(n.values()) / (2.0 * n[0.0]))
    usable = usable.withColumn("weight", weight)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=1, cacheNodeIds=False, weightCol="weight").fit(usable.filter("fit"))
    p = (F.floor(vector_to_array("probability")[1] * SCORE_STEPS) / SCORE_STEPS).alias("p")
    scored = (
        model.transform(usable.filter("NOT fit")).groupBy("kind", "label", p)
        .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).toPandas()
    )
    return model, {k: threshold(scored[scored.kind == k] if scored.n[scored.kind == k].sum() >= 20 else scored) for k in KINDS}


def threshold(scored, precision: float = MIN_PRECISION) -> float:
    """Lowest score at which precision holds for everything from there up; above 1 if nowhere. Rows may have a ``weight``."""
    ordered = scored.sort_values("p", ascending=False)
    weight = ordered.weight.to_numpy() if "weight" in ordered else np.ones(len(ordered))
    share = (ordered.label.to_numpy() * weight).cumsum() / weight.cumsum()
    p = ordered.p.to_numpy()
    # Equal scores stand or fall together.
    last = np.append(p[1:] != p[:-1], True) if len(p) else np.zeros(0, bool)
    good = np.flatnonzero((share >= precision) & last)
    return float(p[good[-1]]) if len(good) else 2.0


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model=None) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, base, score), one row per input row.

    ``model`` as given by ``learn``; trained on the same rows if left out.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    found = cut_lineage(candidates(docs, id_col, text_col))
    model = model or learn(found)
    base = F.transform(
        F.filter("spans", lambda s: s["sound"]),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("base"), F.lit(1.0).alias("score")),
    )
    if model is None:
        return found.select("doc_id", base.alias("spans"))
    trees, limits = model
    rest = exploded(found.filter(F.exists("spans", lambda s: ~s["sound"]))).filter("NOT sound")
    # Refuted spans of a plain format are no personal data of that format.
    rest = rest.filter("NOT plain").withColumn("features", array_to_vector(F.col("features").cast("array<double>")))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("kind"))
    chosen = trees.transform(rest).withColumn("score", vector_to_array("probability")[1]).filter(F.col("score") >= limit)
    added = chosen.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "start", "end", "kind", "score"))).alias("added")
    )

    def apart(taken, s):
        return ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))

    merged = F.aggregate(
        F.coalesce("added", F.expr("array()")),
        base,
        lambda taken, s: F.when(
            apart(taken, s),
            F.array_append(taken, F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("base"), s["score"].alias("score"))),
        ).otherwise(taken),
    )
    plain = found.join(added, "row", "left")
    return plain.select("doc_id", F.when(F.col("added").isNull(), base).otherwise(merged).alias("spans"))
