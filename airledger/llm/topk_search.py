"""Operator 5: exact top-k inner-product search by cover trees over queries and data.

The upper level is a set of pivots from a bounded sample: every vector belongs to its
nearest pivot's node, large nodes are split by a hash of the id, and grouped
aggregates give covering radii. A first pass searches each query node in the data
node whose pivot is nearest and yields a worst k-th score for the node; the second
visits only the node pairs whose bound reaches it. A pair of nodes is one task group of
bounded size; inside it both sides are indexed by cover trees, and pairs of tree nodes
are pruned by their covering radii against the group's worst k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Vectors of a data node and queries of a query node, about; pivots at most (the sample of the upper level).
DATA_NODE, QUERY_NODE, PIVOTS = 4096, 1024, 256
#: Points of a leaf, children of a tree node at most, and by how much a level's radius shrinks.
LEAF, FANOUT, SHRINK = 96, 12, 1.5


class Tree:
    """A batch-built cover tree.

    Every node has a pivot, one of its points, and a reach: all its points lie within it.
    Its children's pivots are picked farthest first, the node's own pivot first, until
    they cover it within reach / SHRINK or there are FANOUT; what they cover it within is
    the children's reach. So reaches fall from level to level, siblings' pivots are at
    least their reach apart, and a pivot stays one below. For pruning, a node also has
    the center and the radius of the ball of its points, which is tighter.
    """

    def __init__(self, points: np.ndarray, members: np.ndarray | None = None, pivot: int | None = None, reach: float | None = None) -> None:
        members = np.arange(len(points)) if members is None else members
        own = points[members]
        self.members, self.children = members, []
        self.center = own.mean(axis=0)
        away = np.sqrt(((own - self.center) ** 2).sum(axis=1))
        self.radius, self.norm = float(away.max()), float(np.sqrt((self.center**2).sum()))
        self.pivot = int(members[away.argmin()]) if pivot is None else pivot
        nearest = np.sqrt(((own - points[self.pivot]) ** 2).sum(axis=1))
        self.reach = float(nearest.max()) if reach is None else reach
        if len(members) <= LEAF or self.radius == 0:
            return
        pivots, part = [self.pivot], np.zeros(len(members), int)
        while len(pivots) < FANOUT and (len(pivots) < 2 or nearest.max() > self.reach / SHRINK):
            pick = int(nearest.argmax())
            gap = np.sqrt(((own - own[pick]) ** 2).sum(axis=1))
            closer = gap < nearest
            nearest[closer], part[closer] = gap[closer], len(pivots)
            pivots.append(int(members[pick]))
        below = float(nearest.max())
        self.children = [Tree(points, members[part == i], p, below) for i, p in enumerate(pivots)]


def bound(a: Tree, b: Tree) -> float:
    """No inner product of a point of ``a`` and one of ``b`` is larger."""
    most = float(a.center @ b.center) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
    return most + 1e-9 * (abs(most) + (a.norm + a.radius) * (b.norm + b.radius)) + 1e-6


class Search:
    """Top-k of each query among the data; equal scores go to the smaller id; a query's own id is no candidate."""

    def __init__(self, queries, query_ids, data, data_ids, k: int, floors=None) -> None:
        self.q, self.qi, self.d, self.di, self.k = queries, query_ids, data, data_ids, k
        # sums below 2**53 are exact in doubles, others are taken in integers
        self.exact = bool(len(queries)) and float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, queries.shape[1]) >= 2**53
        self.scores = np.full((len(queries), k), -np.inf if not self.exact else -(2**62), dtype=float if not self.exact else np.int64)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(queries), -np.inf) if floors is None else np.asarray(floors, float)

    def run(self) -> None:
        if len(self.q) and len(self.d):
            self.visit(Tree(self.q.astype(float)), Tree(self.d.astype(float)))

    def worst(self, node: Tree) -> float:
        return float(np.maximum(self.scores[node.members, -1].astype(float), self.floor[node.members]).min())

    def visit(self, a: Tree, b: Tree) -> None:
        if bound(a, b) < self.worst(a):
            return
        if not a.children and not b.children:
            return self.leaves(a.members, b.members)
        if b.children and (not a.children or b.radius >= a.radius):
            for child in sorted(b.children, key=lambda c: -bound(a, c)):
                self.visit(a, child)
        else:
            for child in a.children:
                self.visit(child, b)

    def leaves(self, mine: np.ndarray, theirs: np.ndarray) -> None:
        if self.exact:
            products = self.q[mine].astype(np.int64) @ self.d[theirs].astype(np.int64).T
        else:
            products = self.q[mine].astype(float) @ self.d[theirs].astype(float).T
        products[self.qi[mine][:, None] == self.di[theirs][None, :]] = self.scores.dtype.type(-np.inf if not self.exact else -(2**62))
        reach = (products >= np.maximum(self.scores[mine, -1].astype(float), self.floor[mine])[:, None]).any(axis=1)
        for row in np.flatnonzero(reach):
            i = mine[row]
            scores = np.concatenate([self.scores[i], products[row]])
            ids = np.concatenate([self.ids[i], np.where(products[row] <= (-np.inf if not self.exact else -(2**62)), np.iinfo(np.int64).max, self.di[theirs])])
            best = np.lexsort((ids, -scores))[: self.k]
            self.scores[i], self.ids[i] = scores[best], ids[best]

    def rows(self) -> pd.DataFrame:
        query, place = np.nonzero(self.ids != np.iinfo(np.int64).max)
        return pd.DataFrame({"query_id": self.qi[query], "vec_id": self.ids[query, place], "score": self.scores[query, place].astype(np.int64)})


def _search(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queries, data = pdf[pdf.is_query], pdf[~pdf.is_query]
        if not len(queries) or not len(data):
            return pd.DataFrame({c: np.array([], np.int64) for c in ("query_id", "vec_id", "score")})
        stack = lambda f: np.stack([np.asarray(x, np.int64) for x in f.v])
        search = Search(stack(queries), queries.id.to_numpy(), stack(data), data.id.to_numpy(), k, queries.floor.fillna(-np.inf))
        search.run()
        return search.rows()

    return run


def quantized(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``id, v array<long>``: floor(scale * x) of each component. Vectors or ids that are null, and vectors with null or non-finite components, are left out; rows of one id count once, with the smallest vector."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & sound)
        .select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))
        .groupBy("id").agg(F.min("v").alias("v"))
    )


def _nearest(pivots: dict[int, np.ndarray]):
    """(number of the nearest pivot of the vector's length, distance)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            number, away = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
            sizes = vectors.map(len).to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                centers = pivots.get(int(size))
                if centers is None or not size:
                    centers = np.zeros((1, int(size)))
                points = np.stack([np.asarray(vectors.iloc[i], float) for i in rows])
                gaps = np.sqrt(np.maximum(0, (points**2).sum(1)[:, None] - 2 * points @ centers.T + (centers**2).sum(1)[None]))
                number[rows], away[rows] = gaps.argmin(1), gaps.min(1)
            yield pd.DataFrame({"pivot": number, "away": away})

    return F.pandas_udf(run, "pivot long, away double")


def _nodes(rows: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """Adds ``dim, pivot, part, away``; parts split a pivot's rows by a hash of the id into about ``size``."""
    placed = rows.withColumn("dim", F.size("v")).withColumn("at", _nearest(pivots)("v")).select("id", "v", "dim", "at.pivot", "at.away")
    counts = placed.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / size).alias("parts"))
    return durable(placed.join(counts, ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts"))


def _summary(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.groupBy("dim", F.col("pivot").alias(f"{prefix}_pivot"), F.col("part").alias(f"{prefix}_part")).agg(F.max("away").alias(f"{prefix}_radius"))


def _visit(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    unit = ["dim", "q_pivot", "q_part", "d_pivot", "d_part"]
    left = pairs.join(queries.withColumnsRenamed({"pivot": "q_pivot", "part": "q_part"}), ["dim", "q_pivot", "q_part"]).select(*unit, F.lit(True).alias("is_query"), "id", "v", "floor")
    right = pairs.join(data.withColumnsRenamed({"pivot": "d_pivot", "part": "d_part"}), ["dim", "d_pivot", "d_part"]).select(*unit, F.lit(False).alias("is_query"), "id", "v", F.lit(None).cast("double").alias("floor"))
    return left.unionByName(right).groupBy(*unit).applyInPandas(_search(k), "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k largest integer inner products, ties to the smaller id.

    ``is_query`` is a condition on ``id``. Vectors are only compared with vectors of
    their length. Fewer candidates give fewer rows; an empty table gives none. Extra
    columns are ignored. See quantized() for nulls and repeated rows.
    """
    rows = durable(quantized(vectors, scale))
    queries = rows.where(is_query)
    n, m = rows.count(), queries.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()  # PIVOTS rows at most
    by_size: dict[int, list] = {}
    for v in sample.v:
        by_size.setdefault(len(v), []).append(np.asarray(v, float))
    wide = {s: np.stack(x[: max(1, min(pivots, n // DATA_NODE))]) for s, x in by_size.items() if s}
    narrow = {s: x[: max(1, min(len(x), m // QUERY_NODE))] for s, x in wide.items()}
    data = _nodes(rows, wide, DATA_NODE)
    asked = _nodes(queries, narrow, QUERY_NODE)

    spark = rows.sparkSession
    between = [
        (s, i, j, float(a @ b), float(np.sqrt(a @ a)), float(np.sqrt(b @ b)), float(np.sqrt(((a - b) ** 2).sum())))
        for s in wide for i, a in enumerate(narrow[s]) for j, b in enumerate(wide[s])
    ] + [(s, 0, 0, 0.0, 0.0, 0.0, 0.0) for s in by_size if not s]
    kinds = "dim int, q_pivot long, d_pivot long, dot double, q_norm double, d_norm double, gap double"
    others = data.select("dim").distinct().join(spark.createDataFrame([(s,) for s in by_size], "dim int"), "dim", "left_anti")
    known = spark.createDataFrame(between, kinds).unionByName(
        others.select("dim", *[F.lit(0).cast("long").alias(c) for c in ("q_pivot", "d_pivot")], *[F.lit(0.0).alias(c) for c in ("dot", "q_norm", "d_norm", "gap")])
    )
    most = F.col("dot") + F.col("q_radius") * F.col("d_norm") + F.col("d_radius") * F.col("q_norm") + F.col("q_radius") * F.col("d_radius")
    pairs = (
        _summary(asked, "q").join(known, ["dim", "q_pivot"]).join(_summary(data, "d"), ["dim", "d_pivot"])
        .withColumn("most", most + F.abs(most) * 1e-9 + 1e-6)
        .withColumn("turn", F.row_number().over(Window.partitionBy("dim", "q_pivot", "q_part").orderBy("gap", "d_pivot", "d_part")))
    )
    pairs = durable(pairs.select("dim", "q_pivot", "q_part", "d_pivot", "d_part", "most", "turn"))
    plain = asked.withColumn("floor", F.lit(None).cast("double"))
    first = durable(_visit(pairs.where("turn = 1"), plain, data, k))
    floors = _best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    asked = durable(asked.join(floors, "id", "left"))
    worst = asked.groupBy("dim", F.col("pivot").alias("q_pivot"), F.col("part").alias("q_part")).agg(F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("worst"))
    open_pairs = pairs.where("turn > 1").join(worst, ["dim", "q_pivot", "q_part"]).where("most >= worst").drop("worst", "most", "turn")
    found = first.unionByName(_visit(open_pairs, asked, data, k))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
