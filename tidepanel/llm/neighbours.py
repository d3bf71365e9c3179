"""Approximate nearest neighbours of exposure vectors by balanced posting lists.

Vectors get one more component so that the largest inner product is the smallest distance. A
balanced clustering of a bounded sample gives centroids; a vector joins the list of its nearest
centroid, and, near a boundary, lists of a few others too. The centroids form a graph that is
searched in memory; a query visits the lists whose centroids are within a factor of the nearest
one's distance. That factor is calibrated on the sample against brute force. Long lists and many
queries of a list are compared in chunks, each pair of chunks in a task of its own; the sample's
part of the visited lists bounds what a chunk needs to return.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .vectors import bucket, finite_vectors, matrix, sampled

#: Vectors that the index is fitted on, at most; vectors of a list on average; centroids, at most.
FIT_VECTORS, LIST_VECTORS, MOST_LISTS = 20_000, 1024, 2048
#: Vectors and queries compared in one go.
CHUNK_VECTORS, CHUNK_QUERIES = 512, 2048
#: Vectors that are handled at once while the index is fitted, and numbers of a temporary there.
FIT_BLOCK, FIT_VALUES = 1000, 1 << 20
#: A vector joins further lists whose centroids are within this factor of its nearest one's distance, up to so many lists.
BOUNDARY, REPLICAS = 1.03, 3
#: Share of true neighbours that the calibrated factor must reach on the sample.
TARGET_RECALL = 0.96


@dataclass
class ListIndex:
    """Centroids, their graph and the pruning factor."""

    centroids: np.ndarray
    graph: np.ndarray
    ratio: float
    longest: float
    keys: np.ndarray
    sample: np.ndarray
    home: np.ndarray

    def floors(self, keys: np.ndarray, queries: np.ndarray, visited: np.ndarray, k: int) -> np.ndarray:
        """What the k-th score found is at least: the k-th best of the sample's vectors, other codes
        only, whose own list the query visits (``visited``, a row per query)."""
        if len(self.keys) <= k:
            return np.full(len(queries), -np.inf)
        scores = queries @ self.sample.T
        scores[(keys[:, None] == self.keys[None, :]) | ~visited[:, self.home]] = -np.inf
        return np.partition(scores, -k, axis=1)[:, -k]

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that makes all equally long."""
        rest = np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(axis=1), 0.0))
        return np.hstack([x, rest[:, None]])

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of the centroid graph: for each query the ``width`` nearest centroids found
        and their distances, nearest first."""
        k, rows = len(self.centroids), np.arange(len(queries))
        distance = lambda ids: np.sqrt(((queries[:, None, :] - self.centroids[ids]) ** 2).sum(axis=2))
        width = min(width, k)
        seen = np.zeros((len(queries), k), dtype=bool)
        beam = np.tile(np.arange(0, k, max(1, k // 8))[:8], (len(queries), 1))
        seen[rows[:, None], beam] = True
        far, done = distance(beam), np.zeros(beam.shape, dtype=bool)
        while True:
            masked = np.where(done, np.inf, far)
            pick = masked.argmin(axis=1)
            open_ = np.isfinite(masked[rows, pick])
            if not open_.any():
                return beam, far
            done[rows, pick] = True
            near = self.graph[beam[rows, pick]]
            fresh = ~seen[rows[:, None], near] & open_[:, None]
            seen[rows[:, None], near] |= fresh
            far = np.hstack([far, np.where(fresh, distance(near), np.inf)])
            beam, done = np.hstack([beam, near]), np.hstack([done, ~fresh])
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            beam, far, done = (np.take_along_axis(x, order, 1) for x in (beam, far, done))

    def lists_of_queries(self, queries: np.ndarray):
        """(query, list) pairs that the distance ratio lets through."""
        lifted = np.hstack([queries, np.zeros((len(queries), 1))])
        beam, far = self.search(lifted, len(self.centroids))
        near = (far <= self.ratio * far[:, :1]) | (np.arange(far.shape[1]) < 2)  # two lists at least
        return np.nonzero(np.isfinite(far) & near), beam

    def lists_of_vectors(self, vectors: np.ndarray):
        """(vector, list) pairs: the nearest list, and boundary lists not hidden behind a chosen one."""
        lifted = self.lift(vectors)
        beam, far = self.search(lifted, 8 * REPLICAS)
        rows, lists = [], []
        for i in range(len(vectors)):
            chosen: list[int] = []
            for c, d in zip(beam[i], far[i]):
                if d > BOUNDARY * far[i, 0] and chosen or len(chosen) == REPLICAS or not np.isfinite(d):
                    break
                if all(np.linalg.norm(self.centroids[c] - self.centroids[o]) >= d for o in chosen):
                    chosen.append(int(c))
            rows += [i] * len(chosen)
            lists += chosen
        return np.array(rows), np.array(lists)


def _blocks(x: np.ndarray, rows: int = FIT_BLOCK):
    return (x[lo:lo + rows] for lo in range(0, len(x), rows))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between rows; the differences stand in memory for a few rows at a time."""
    return np.concatenate([((part[:, None, :] - y) ** 2).sum(axis=2) for part in _blocks(x, max(1, FIT_VALUES // y.size))])


def _nearest(x: np.ndarray, centroids: np.ndarray, pay: np.ndarray | float = 0.0) -> np.ndarray:
    """The nearest centroid of each row, where being in a cluster costs ``pay``."""
    own = (centroids ** 2).sum(axis=1) + pay
    return np.concatenate([(own - 2 * part @ centroids.T).argmin(axis=1) for part in _blocks(x)])


def _balanced(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of k clusters of like size: assignment pays for a cluster's surplus."""
    rng = np.random.default_rng(3)
    centroids = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    pay = np.zeros(k)
    for _ in range(rounds):
        near = _nearest(x, centroids, pay)
        sizes = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
        pay += 0.02 * (sizes - len(x) / k) / (len(x) / k)
    return centroids


def fit_index(keys: np.ndarray, sample: np.ndarray, lists: int, longest: float, k: int) -> ListIndex:
    """Cluster the sample, link the centroids and calibrate the pruning factor."""
    once = np.unique(keys, return_index=True)[1]
    index = ListIndex(np.empty(0), np.empty(0), 1.0, longest, keys[once], sample[once], np.empty(0))
    lifted = index.lift(sample)
    index.centroids = _balanced(lifted, max(1, min(lists, len(sample))))
    n = len(index.centroids)
    apart = _apart(index.centroids, index.centroids)
    near = np.argsort(apart, axis=1, kind="stable")[:, :min(n, 16)]
    ring = np.stack([np.roll(np.arange(n), s) for s in (1, 7)], axis=1) % n  # a few far links keep the graph in one piece
    index.graph = np.hstack([near, ring])
    rng = np.random.default_rng(5)
    # a vector of each code, as a code takes one place
    queries = index.sample[rng.choice(len(once), min(200, len(once)), replace=False)]
    top = np.concatenate([np.argpartition(-(part @ index.sample.T), min(k, len(once) - 1), axis=1)[:, :k + 1] for part in _blocks(queries, 50)])
    home = _nearest(lifted[once], index.centroids)
    far = np.sqrt(_apart(np.hstack([queries, np.zeros((len(queries), 1))]), index.centroids))
    needed = np.take_along_axis(far, home[top], 1) / far.min(axis=1, keepdims=True)
    index.ratio = float(np.quantile(needed, TARGET_RECALL)) + 1e-9
    index.home = np.concatenate([index.search(index.lift(part), 8 * REPLICAS)[0][:, 0] for part in _blocks(index.sample)])  # as lists_of_vectors has it first
    return index


def nearest_stocks(exposures: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "ts_code", features_col: str = "features") -> DataFrame:
    """The ``k`` rows of ``exposures`` found with the largest inner product for each row of ``queries`` (same
    columns): ``query_code``, ``rank`` from 1, ``ts_code``, ``score`` in double precision; ties to the smaller code.

    A row is no neighbour of a query with its own code. Vectors that are null, empty, zero, of an uncommon
    length or hold a null or non-finite component take no part, nor do null codes; a code that occurs
    repeatedly counts once, with its best score. Queries with fewer candidates get all; empty tables give no
    rows. Further columns are ignored. The index is fitted on about ``FIT_VECTORS`` rows and holds every row.
    """
    rows = cut_lineage(finite_vectors(exposures, id_col, features_col, nonzero=True).distinct())
    asked = finite_vectors(queries, id_col, features_col, nonzero=True).distinct()
    kind = rows.schema["key"].dataType
    out = T.StructType([T.StructField("query", kind), T.StructField("key", kind), T.StructField("score", T.DoubleType())])
    total, longest, size = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.size("vec"))).first()
    empty = rows.sparkSession.createDataFrame([], out)
    if total:
        fitted = sampled(rows, total, FIT_VECTORS, "key", "vec").orderBy("key", "vec").toArrow()
        fitted = fitted if fitted.num_rows else rows.limit(1).toArrow()
        vectors = fitted["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(fitted.num_rows, -1)
        index = fit_index(np.array(fitted["key"].to_pylist()), vectors, min(MOST_LISTS, -(-total // LIST_VECTORS)), float(np.sqrt(longest)), k)
        shared = rows.sparkSession.sparkContext.broadcast(index)  # MOST_LISTS centroids and about FIT_VECTORS vectors at any size
        found = _scored(rows, asked.where(F.size("vec") == size), shared, out, k)
    else:
        found = empty
    best = found.groupBy("query", "key").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_code"), "rank", F.col("key").alias("ts_code"), "score")


def _kth_of_codes(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each row (the least if there are fewer), where a code counts once, with its best."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    best = scores if len(starts) == len(keys) else np.maximum.reduceat(scores[:, order], starts, axis=1)
    k = min(k, len(starts))
    return np.partition(best, -k, axis=1)[:, -k]


def _scored(rows, asked, shared, out, k):
    schema = T.StructType([T.StructField("list", T.IntegerType()), rows.schema["key"], T.StructField("vec", T.BinaryType()), T.StructField("floor", T.DoubleType())])

    def placed(which):
        def run(batches):
            index = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    part = batch.slice(lo, 1000)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    floors = np.zeros(len(x))
                    if which == "queries":
                        (at, slot), beam = index.lists_of_queries(x)
                        lists, visited = beam[at, slot], np.zeros((len(x), len(index.centroids)), dtype=bool)
                        visited[at, lists] = True
                        floors = index.floors(np.array(part.column(0).to_pylist()), x, visited, k)
                    else:
                        at, lists = index.lists_of_vectors(x)
                    yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), part.column(0).take(pa.array(at)), pa.array([x[i].tobytes() for i in at], pa.binary()),
                                                      pa.array(floors[at])], schema.names)

        return run

    vectors = cut_lineage(rows.mapInArrow(placed("vectors"), schema))
    visits = cut_lineage(asked.mapInArrow(placed("queries"), schema))
    sizes = (vectors.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK_VECTORS)).cast("int").alias("chunks"))
             .join(visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK_QUERIES)).cast("int").alias("groups")), "list"))
    sizes = F.broadcast(sizes)  # a row per list: MOST_LISTS at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = vectors.join(sizes, "list").withColumn("chunk", bucket(F.col("chunks"), "key", "vec")).select("list", "chunk", every("groups").alias("group"), F.lit(0).alias("side"), "key", "vec", "floor")
    q = visits.join(sizes, "list").withColumn("group", bucket(F.col("groups"), "key", "vec")).select("list", every("chunks").alias("chunk"), "group", F.lit(1).alias("side"), "key", "vec", "floor")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if mine.empty or theirs.empty:
            return pd.DataFrame({"query": pdf["key"].iloc[:0], "key": pdf["key"].iloc[:0], "score": np.empty(0)})
        x, y = matrix(mine["vec"]), matrix(theirs["vec"])
        keys, queries = mine["key"].to_numpy(), theirs["key"].to_numpy()
        scores = y @ x.T
        scores[queries[:, None] == keys[None, :]] = -np.inf
        kth = _kth_of_codes(scores, keys, k)
        kth = np.maximum(kth, theirs["floor"].to_numpy())  # what is below is none of the k nearest
        slack = 1e-9 * np.linalg.norm(y, axis=1) * np.linalg.norm(x, axis=1).max()
        i, j = np.nonzero((scores >= (kth - slack)[:, None]) & np.isfinite(scores))
        exact = np.einsum("ij,ij->i", y[i], x[j])  # the same sum for equal vectors, wherever they stand
        pairs = pd.DataFrame({"query": queries[i], "key": keys[j], "score": exact})
        pairs = pairs.sort_values(["query", "score", "key"], ascending=[True, False, True]).drop_duplicates(["query", "key"])
        return pairs.groupby("query").head(k)

    return v.unionAll(q).groupBy("list", "chunk", "group").applyInPandas(compare, out)
