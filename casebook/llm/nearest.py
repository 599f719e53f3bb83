"""Nearest neighbours by inner product over low-dimensional stable projections.

A Gaussian matrix projects the vectors to a few dimensions, where the squared
distance of a pair is its true squared distance times a chi-square variable.
Vectors are dealt over shards of bounded size; each shard keeps its projected
points in a kd-tree. A query walks over the leaves in the order of their
projected distance and verifies their vectors by the true inner product. It
stops when a vector as near as the k-th best would lie that far out in the
projection with a probability below ``miss``.

Largest inner products are turned into least distances by one more dimension
that fills every vector up to the greatest length. Queries meet shards in
blocks of bounded size. Vectors that are null, zero, or hold null or
non-finite components take no part; vectors only meet those of their own
length. A query finds all candidates if there are fewer than k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from casebook.functions.runtime import cut_lineage

K = 20
PROJECTED = 12
MISS = 0.02
SHARD_ROWS = 8_192
QUERY_ROWS = 1_024
LEAF = 64
STEP = 6
SEED = 10


def usable(vector: Column) -> Column:
    """Whether a vector may take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def chi_square_quantile(p: float, m: int) -> float:
    """Value below which a chi-square variable of ``m`` (even) degrees of freedom falls with probability ``p``."""
    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Tree:
    """kd-tree: median splits along the widest side down to small leaves with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        parts, todo = [], [np.arange(len(points))]
        while todo:
            own = todo.pop()
            if len(own) <= leaf:
                parts.append(own)
                continue
            box = points[own]
            side = int((box.max(axis=0) - box.min(axis=0)).argmax())
            half = len(own) // 2
            order = np.argpartition(box[:, side], half)
            todo += [own[order[half:]], own[order[:half]]]
        self.order = np.concatenate(parts)
        self.bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.low = np.array([points[p].min(axis=0) for p in parts])
        self.high = np.array([points[p].max(axis=0) for p in parts])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Least squared projected distance from ``q`` to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)


def search(ids, vectors, query_ids, queries, k, longest, limit, seed, projected) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the best of one shard; ``limit`` is the chi-square bound."""
    dims = vectors.shape[1]
    matrix = np.random.default_rng(seed).standard_normal((dims + 1, projected))
    fill = np.sqrt(np.maximum(0.0, longest**2 - np.einsum("ij,ij->i", vectors, vectors)))
    points = vectors @ matrix[:-1] + fill[:, None] * matrix[-1]
    tree = Tree(points)
    vectors, ids = vectors[tree.order], ids[tree.order]
    sizes = np.einsum("ij,ij->i", queries, queries)
    for query_id, q, size, p in zip(query_ids.tolist(), queries, sizes.tolist(), queries @ matrix[:-1]):
        far = tree.distances(p)
        order = np.argsort(far, kind="stable")
        best_scores, best_ids = np.zeros(0), np.zeros(0, np.int64)
        for at in range(0, len(order), STEP):
            if len(best_scores) == k:
                # True squared distance of the k-th best, filled-up dimension included.
                reach = max(0.0, longest**2 + size - 2 * best_scores[-1])
                if far[order[at]] > limit * reach:
                    break
            rows = np.concatenate([np.arange(tree.bounds[j], tree.bounds[j + 1]) for j in order[at : at + STEP]])
            scores, own = vectors[rows] @ q, ids[rows]
            if len(best_scores) == k:
                better = scores >= best_scores[-1]
                scores, own = scores[better], own[better]
            keep = own != query_id
            scores, own = np.concatenate([best_scores, scores[keep]]), np.concatenate([best_ids, own[keep]])
            top = np.lexsort((own, -scores))[:k]
            best_scores, best_ids = scores[top], own[top]
        yield query_id, best_ids, best_scores


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None, k: int = K,
    miss: float = MISS, projected: int = PROJECTED, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, seed: int = SEED,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest found per query.

    ``queries`` is the condition on ``id_col`` that makes a row a query (all
    rows if left out). Rows that repeat an id count once, with the least of
    their vectors. A null id takes no part.
    """
    is_query = F.lit(True) if queries is None else queries
    rows = (
        vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
        # Of different vectors of one id the least in order counts.
        .groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
        .withColumn("dim", F.size("v"))
    )
    rows = cut_lineage(rows)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = rows.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("int")).alias("nq"), F.sqrt(F.max(square)).alias("longest")
    )
    # One row per vector length: how many shards and query blocks it is cut into.
    plan = sizes.select(
        "dim", "longest",
        F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.col("nq") / query_rows)).cast("int").alias("blocks"),
    )
    planned = rows.join(plan, "dim")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    points = planned.select(
        "dim", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("shards")).cast("int").alias("shard"),
        F.explode(every).alias("block"), F.lit(False).alias("q"), "vec_id", "v", "longest",
    )
    asked = planned.filter("q").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("q"),
        "vec_id", "v", "longest",
    )
    limit = chi_square_quantile(1 - miss, projected)

    def run(table: pa.Table) -> pa.Table:
        q = np.asarray(table.column("q").to_numpy())
        ids = np.asarray(table.column("vec_id").to_numpy())
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        longest = table.column("longest")[0].as_py()
        out: list[list] = [[], [], []]
        if (~q).any():
            for query, found, scores in search(ids[~q], v[~q], ids[q], v[q], k, longest, limit, seed, projected):
                out[0] += [query] * len(found)
                out[1] += found.tolist()
                out[2] += scores.tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    # A task for each shard and block: few bytes mean much work here, so tasks are not merged by size.
    groups = plan.agg(F.sum(F.col("shards") * F.col("blocks"))).first()[0] or 1
    tasks = max(2 * groups, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = (
        points.unionByName(asked).repartition(tasks, "dim", "shard", "block").groupBy("dim", "shard", "block")
        .applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    )
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
