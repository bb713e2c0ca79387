"""Approximate nearest neighbours by vantage-point trees per shard.

Inner products become distances: with one more coordinate that lifts every vector to the largest norm, the largest inner product is
the nearest point. A small tree of vantage points, fitted on a bounded sample, deals all vectors to shards; each shard builds
its own tree. A query first searches its home shard, which bounds the distance of its k-th neighbour, and then the
shards and branches whose lower bound by the triangle inequality, times ``factor``, is below that bound. Factor one prunes only what
cannot hold a neighbour and is exact; larger factors prune more. Unless it is given, the factor is tuned to the vectors: the
largest that finds ``TARGET`` of the neighbours within a bounded sample, as brute force over the sample knows them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from risklattice.session import cut_lineage

K = 20
FACTORS, TARGET = (4.0, 3.0, 2.5, 2.0, 1.5, 1.2), 0.99  # tried in this order; one where none reaches the target
TUNING_ROWS, TUNING_BYTES, TUNING_QUERIES = 4000, 1 << 25, 100  # the factor is tuned on at most so many vectors, bytes and queries
SHARD_ROWS, LEAF_ROWS = 8192, 128
SAMPLE_PER_SHARD, MOST_SHARDS = 64, 4096  # the router is fitted on at most 64 * 4,096 sampled vectors
QUERY_ROWS = 4096  # queries that meet a shard in one task
SEED = 5


class Tree:
    """Vantage-point tree over rows of ``points``, as arrays. Leaves hold runs of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int, seed: int = SEED):
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # (vantage row, inner low, inner high, outer low, outer high, inner node, outer node) or (start, end)
        draw = np.random.RandomState(seed)
        self._build(0, len(points), draw)

    def _build(self, start: int, end: int, draw) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        rows = self.order[start:end]
        if end - start <= self.leaf:
            self.nodes[me] = (start, end)
            return me
        tried = draw.choice(rows, min(8, len(rows)), replace=False)
        probe = self.points[draw.choice(rows, min(64, len(rows)), replace=False)]
        vantage = int(max(tried, key=lambda r: float(np.var(distances(self.points[r][None, :], probe)))))
        d = distances(self.points[vantage][None, :], self.points[rows])[0]
        middle = (end - start) // 2
        split = np.argpartition(d, middle)
        self.order[start:end] = rows[split]
        d = d[split]
        bounds = (d[:middle].min(), d[:middle].max(), d[middle:].min(), d[middle:].max())
        inner = self._build(start, start + middle, draw)
        outer = self._build(start + middle, end, draw)
        self.nodes[me] = (vantage, *bounds, inner, outer)
        return me


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def beyond(d: np.ndarray, low: float, high: float) -> np.ndarray:
    """Lower bound of the distance to points whose distance to the vantage point lies between low and high."""
    return np.maximum(np.maximum(low - d, d - high), 0)


def search(tree: Tree, queries: np.ndarray, limit: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(distances, rows) of the k nearest points of each query, unfilled places infinite.

    All queries go through the tree together: first each to its nearest leaf, then through every branch whose lower bound times
    ``factor`` does not pass ``limit`` or the k-th distance found so far.
    """
    best = np.full((len(queries), k), np.inf)
    rows = np.full((len(queries), k), -1)
    home = np.full(len(queries), -1)

    def merge(active: np.ndarray, start: int, end: int) -> None:
        own = tree.order[start:end]
        d = np.concatenate([best[active], distances(queries[active], tree.points[own])], axis=1)
        r = np.concatenate([rows[active], np.broadcast_to(own, (len(active), len(own)))], axis=1)
        pick = np.argpartition(d, k - 1, axis=1)[:, :k]
        best[active], rows[active] = np.take_along_axis(d, pick, 1), np.take_along_axis(r, pick, 1)

    todo = [(0, np.arange(len(queries)))]
    while todo:
        node, active = todo.pop()
        if not len(active):
            continue
        if len(tree.nodes[node]) == 2:
            merge(active, *tree.nodes[node])
            home[active] = node
            continue
        vantage, il, ih, ol, oh, inner, outer = tree.nodes[node]
        d = distances(queries[active], tree.points[vantage][None, :])[:, 0]
        near = beyond(d, il, ih) <= beyond(d, ol, oh)
        todo += [(inner, active[near]), (outer, active[~near])]
    todo = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
    while todo:
        node, active, bound = todo.pop()
        open_ = bound * factor <= np.minimum(limit[active], best[active].max(axis=1)) + 1e-9
        active, bound = active[open_], bound[open_]
        if not len(active):
            continue
        if len(tree.nodes[node]) == 2:
            merge(active[home[active] != node], *tree.nodes[node])
            continue
        vantage, il, ih, ol, oh, inner, outer = tree.nodes[node]
        d = distances(queries[active], tree.points[vantage][None, :])[:, 0]
        todo += [(outer, active, np.maximum(bound, beyond(d, ol, oh))), (inner, active, np.maximum(bound, beyond(d, il, ih)))]
    return best, rows


def tuned_factor(sample: np.ndarray, k: int = K, target: float = TARGET) -> float:
    """The largest factor at which a tree over the sample finds the share ``target`` of the neighbours of some of its points."""
    queries = sample[: min(TUNING_QUERIES, len(sample))]
    take = min(k + 1, len(sample))  # a point is its own nearest
    if take <= 1:
        return 1.0
    kth = np.partition(distances(queries, sample), take - 1, axis=1)[:, take - 1]
    tree = Tree(sample, min(LEAF_ROWS, max(1, len(sample) // 32)))
    for factor in FACTORS:
        found, _ = search(tree, queries, np.full(len(queries), np.inf), take, factor)
        if (found <= kth[:, None] + 1e-9).mean() >= target:
            return factor
    return 1.0


class Router:
    """Deals vectors to shards by a small tree of vantage points; a shard is a leaf."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.cuts: list[tuple] = []  # (vantage, middle, inner, outer); negative children are shards
        self.shards = 0
        if shards <= 1 or len(sample) < 2:
            self.shards = 1
            self.root = -1
            return
        tree = Tree(sample, max(1, -(-len(sample) // shards)))
        self.root = self._take(tree, 0)

    def _take(self, tree: Tree, node: int) -> int:
        if len(tree.nodes[node]) == 2:
            self.shards += 1
            return -self.shards
        vantage, _, ih, ol, _, inner, outer = tree.nodes[node]
        me = len(self.cuts)
        self.cuts.append(())
        self.cuts[me] = (tree.points[vantage], (ih + ol) / 2, self._take(tree, inner), self._take(tree, outer))
        return me

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """Lower bound of each point's distance to what each shard may hold."""
        out = np.zeros((len(points), self.shards))
        todo = [(self.root, np.zeros(len(points)))]
        while todo:
            node, bound = todo.pop()
            if node < 0:
                out[:, -node - 1] = bound
                continue
            vantage, middle, inner, outer = self.cuts[node]
            d = distances(points, vantage[None, :])[:, 0]
            todo += [(inner, np.maximum(bound, d - middle)), (outer, np.maximum(bound, middle - d))]
        return out

    def shard(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, active = todo.pop()
            if not len(active):
                continue
            if node < 0:
                out[active] = -node - 1
                continue
            vantage, middle, inner, outer = self.cuts[node]
            near = distances(points[active], vantage[None, :])[:, 0] <= middle
            todo += [(inner, active[near]), (outer, active[~near])]
        return out


def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the coordinate that brings each to the norm ``norm``."""
    return np.column_stack([vectors, np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(1), 0))])


def stacked(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False) if len(column) else np.zeros((0, dim))


def distinct_points(vectors: DataFrame, keep: int) -> DataFrame:
    """uid, ids, v: distinct usable vectors (doubles) with their ``keep`` smallest ids; no row beyond these can be among a query's nearest."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall("v", lambda x: x == 0)
    usable = vectors.filter("vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad)
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    first = usable.distinct().withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= keep)
    grouped = first.groupBy(F.xxhash64("v").alias("_h"), "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return grouped.select(F.col("ids")[0].alias("uid"), "ids", "v")


def nearest(vectors: DataFrame, is_query: F.Column, k: int = K, factor: float | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of every query row by inner product, ties to the smaller id, itself left out.

    Vectors that are null, empty, zero, or hold null or non-finite components, rows with a null id, and vectors of another length than
    the commonest take no part. Repeated rows count once. With fewer than k candidates all are returned; an empty table gives no rows. Equal
    vectors are one point that carries the ids that can matter, so a common vector is no hot group. Every row is indexed. Without a
    ``factor`` it is tuned on a bounded sample; a given one of 1 makes the search exact.
    """
    spark = vectors.sparkSession
    lengths = vectors.groupBy(F.size("embedding").alias("n")).count().filter("n > 0").orderBy(F.desc("count"), "n").limit(1)
    top = lengths.first()
    dim = top[0] if top else 1
    sized = vectors.filter(F.size("embedding") == dim)
    points = cut_lineage(distinct_points(sized, k + 1))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    count, norm = points.agg(F.count(F.lit(1)), F.sqrt(F.max(square))).first()
    norm = (norm or 0.0) * (1 + 1e-12)
    shards = min(MOST_SHARDS, -(-count // shard_rows)) or 1
    sample = points.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE_PER_SHARD * shards).select("uid", "v").collect() if shards > 1 else []
    if factor is None:
        some = min(TUNING_ROWS, max(TUNING_QUERIES, TUNING_BYTES // (8 * dim)))
        tuning = points.orderBy(F.xxhash64("uid", F.lit(1)), "uid").limit(some).select("v").collect()
        factor = tuned_factor(lifted(np.array([r.v for r in tuning], float).reshape(-1, dim), norm), k)
    router = spark.sparkContext.broadcast(Router(lifted(np.array([r.v for r in sorted(sample)], float).reshape(-1, dim), norm), shards))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["shard"] = router.value.shard(lifted(stacked(rows["v"], dim), norm))
            yield rows

    dealt = cut_lineage(points.mapInPandas(deal, "uid long, ids array<long>, v array<double>, shard long"))
    asked = sized.filter(is_query & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("v")).distinct()
    named = cut_lineage(asked.withColumn("_h", F.xxhash64("v")).join(dealt.select(F.xxhash64("v").alias("_h"), "v", "uid", "shard"), ["_h", "v"]).select("query_id", "uid"))
    wanted = named.select("uid").distinct()
    queries = dealt.join(wanted, "uid", "left_semi").select("uid", "v", "shard").toDF("uid", "v", "shard")
    take = k + 4

    def hits_of(points: pd.DataFrame, queries: pd.DataFrame, limit: np.ndarray):
        p, q = stacked(points["v"], dim), stacked(queries["v"], dim)
        lift = np.column_stack([q, np.zeros(len(q))])
        d, rows = search(Tree(lifted(p, norm), LEAF_ROWS), lift, limit, min(take, len(p)), factor)
        scores = np.einsum("ijk,ik->ij", p[rows], q)
        ok = np.isfinite(d)
        return lift, d, ok, scores, rows

    def at_home(key, points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["uid", "v", "limit", "others", "near"]
        if not len(queries):
            return pd.DataFrame(columns=columns)
        lift, d, ok, scores, rows = hits_of(points, queries, np.full(len(queries), np.inf))
        bound = np.where(ok.sum(1) >= min(take, k + 1), np.sort(d, axis=1)[:, min(k, d.shape[1] - 1)], np.inf)
        if d.shape[1] < k + 1:
            bound[:] = np.inf
        open_ = router.value.bounds(lift) * factor <= bound[:, None] + 1e-9
        open_[:, key[0]] = False
        ids = points["ids"].to_numpy()
        near = [[(float(s), ids[r].tolist()) for s, r, o in zip(*x) if o] for x in zip(scores, rows, ok)]
        return pd.DataFrame({"uid": queries["uid"].to_numpy(), "v": queries["v"].to_numpy(), "limit": bound, "others": [np.flatnonzero(o).tolist() for o in open_], "near": near})

    def elsewhere(key, points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame(columns=["uid", "near"])
        _, _, ok, scores, rows = hits_of(points, queries, queries["limit"].to_numpy())
        ids = points["ids"].to_numpy()
        near = [[(float(s), ids[r].tolist()) for s, r, o in zip(*x) if o] for x in zip(scores, rows, ok)]
        return pd.DataFrame({"uid": queries["uid"].to_numpy(), "near": near})

    found = "near array<struct<score:double,ids:array<long>>>"
    home = cut_lineage(dealt.groupBy("shard").cogroup(queries.groupBy("shard")).applyInPandas(at_home, f"uid long, v array<double>, limit double, others array<long>, {found}"))
    near = home.select("uid", "near")
    if shards > 1:
        parts = max(1, -(-wanted.count() // QUERY_ROWS))
        visits = home.select("uid", "v", "limit", F.explode("others").alias("shard"), F.pmod(F.xxhash64("uid"), F.lit(parts)).alias("part"))
        copies = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        near = near.unionByName(copies.groupBy("shard", "part").cogroup(visits.groupBy("shard", "part")).applyInPandas(elsewhere, f"uid long, {found}"))
    flat = near.select("uid", F.explode("near").alias("n")).select("uid", F.col("n.score").alias("score"), F.explode("n.ids").alias("vec_id"))
    best = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    few = cut_lineage(flat.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = named.join(few, "uid").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(own))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
