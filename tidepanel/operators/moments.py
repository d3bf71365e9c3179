"""Pairwise second moments, VIF and correlation pruning, neighbour graphs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_corr
from ..session import cut_lineage
from . import tiles

#: Nodes of a block in all-against-all products.
BLOCK_NODES = 1024


def column_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, all in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[safe_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    packed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
                       for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(packed).alias("p")).select("p.*")


def crowded_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.7) -> DataFrame:
    return column_pairs(df, cols).where(F.abs("corr") > threshold)


def gram_matrix(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(sum of products, sums, rows) of complete rows: one k x k aggregate to the driver."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    k = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    r = rows.agg(*aggs).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = r[f"p{i}_{j}"] or 0.0
    return g, np.array([r[f"s{i}"] or 0.0 for i in range(k)]), int(r["n"])


def vif(g: np.ndarray) -> np.ndarray:
    """Uncentred variance inflation: VIF_j = G_jj * (G^-1)_jj."""
    return np.diag(g) * np.diag(np.linalg.pinv(g, hermitian=True))


def select_orthogonal(df: DataFrame, cols: Sequence[str], max_vif: float = 5.0, max_factors: int = 30,
                      essential: Sequence[str] = ()) -> list[str]:
    """Drop the removable column with the largest VIF (ties by name) until all are within
    ``max_vif`` and at most ``max_factors`` remain; stops below five columns."""
    if len(cols) < 5:
        return list(cols)
    g, s, n = gram_matrix(df, cols)
    var = (np.diag(g) - s * s / max(n, 1)) / max(n - 1, 1)
    keep = [i for i in range(len(cols)) if var[i] > 1e-18]
    if len(keep) < 5:
        return [cols[i] for i in keep]
    while len(keep) >= 5:
        score = dict(zip(keep, vif(g[np.ix_(keep, keep)])))
        removable = [i for i in keep if cols[i] not in essential]
        if not removable:
            break
        worst = max(removable, key=lambda i: (round(score[i], 9), cols[i]))
        if score[worst] <= max_vif and len(keep) <= max_factors:
            break
        keep.remove(worst)
    return [cols[i] for i in keep]


def prune_correlated(df: DataFrame, cols: Sequence[str], limit: float = 0.85) -> list[str]:
    """Keep columns by falling variance unless |corr| with a kept one reaches ``limit``."""
    if len(cols) <= 5:
        return list(cols)
    g, s, n = gram_matrix(df, cols)
    cov = (g - np.outer(s, s) / n) / (n - 1)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = np.abs(cov / np.outer(sd, sd))
    kept: list[int] = []
    for i in sorted(range(len(cols)), key=lambda i: (-cov[i, i], cols[i])):
        if not kept or np.nanmax(corr[i, kept]) < limit:
            kept.append(i)
    return [cols[i] for i in kept] if len(kept) >= 3 else list(cols)


KEY_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _products(x: np.ndarray, y: np.ndarray, before: int):
    fx, fy, x, y = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float), np.nan_to_num(x), np.nan_to_num(y)
    yield 0, [fx.T @ fy, x.T @ fy, fx.T @ y, (x * x).T @ fy, fx.T @ (y * y), x.T @ y]


def key_covariance(df: DataFrame, day: str, key: str, value: str, tile: int = tiles.TILE_KEYS) -> DataFrame:
    """Covariance and correlation of the value series of every key pair (both present), a tile of ``tile`` x ``tile``
    keys at a time; the caller bounds the keys by the number of pairs that are wanted. Of rows with equal key and
    date one counts."""
    panel = df.join(F.broadcast(tiles.dense_steps(df, day)), day).select(key, "t", value)  # a row per calendar date
    s = tiles.pair_sums(panel, key, value, _products, KEY_SUMS, ordered=False, tile=tile).where(F.col("n") >= 2)
    swap = F.col("source") > F.col("target")  # tiles are not in the order of names
    s = s.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "n", "sxy", *(
        F.when(swap, F.col(d)).otherwise(F.col(c)).alias(c) for c, d in (("sx", "sy"), ("sy", "sx"), ("sxx", "syy"), ("syy", "sxx"))))
    centred = lambda p, x, y: F.col(p) - F.col(x) * F.col(y) / F.col("n")
    cov = centred("sxy", "sx", "sy") / (F.col("n") - 1)
    den = F.sqrt(centred("sxx", "sx", "sx") * centred("syy", "sy", "sy"))
    return s.select("a", "b", F.col("n").cast("long").alias("n"), cov.alias("cov"),
                    F.try_divide(centred("sxy", "sx", "sy"), den).alias("corr"))


#: Directions that nodes gather around at most, and clusters whose bounds are compared at once.
MOST_PIVOTS, BOUND_CLUSTERS = 1024, 512
#: Nodes of the sample per pivot.
PIVOT_SAMPLE = 8
#: Rounding that bounds allow for.
ROOM = 1e-9


def _directions(rows: pd.Series) -> np.ndarray:
    """Centred rows of unit length; rows without spread are zero."""
    m = np.stack(rows.to_numpy())
    m = m - m.mean(axis=1, keepdims=True)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _spread(m: np.ndarray, wanted: int) -> np.ndarray:
    """Directions chosen one by one, each the one least like those before, signs aside."""
    chosen, near = [0], np.abs(m @ m[0])
    while len(chosen) < min(wanted, len(m)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, np.abs(m @ m[chosen[-1]]))
    return m[chosen]


def _vectors(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


def node_clusters(nodes: DataFrame, key: str, features: Sequence[str], threshold: float, k: int, block: int) -> DataFrame:
    """Clusters of at most about ``block`` nodes of like direction: ``cluster``, ``names``, ``vectors``, ``centre``,
    ``radius`` (largest angle of a node to the centre, signs aside), ``floors`` (what a node's k-th correlation is at
    least, from its own cluster) and ``floor`` (the least of them)."""
    x = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    stats = nodes.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x(c)).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(x(c)).alias(f"s{i}") for i, c in enumerate(features)]).first()
    z = F.array(*[(x(c) - F.lit(stats[f"m{i}"] or 0.0)) / F.lit((stats[f"s{i}"] or 0.0) + 1e-8) for i, c in enumerate(features)])
    rows = cut_lineage(nodes.select(F.col(key).cast("string").alias("node"), z.alias("z")).where("node is not null"))
    wanted = min(MOST_PIVOTS, -(-stats["n"] // block))
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < -(-PIVOT_SAMPLE * wanted * (1 << 20) // max(stats["n"], 1)) + 1
    sample = [r["z"] for r in rows.where(share).orderBy("node").select("z").limit(PIVOT_SAMPLE * MOST_PIVOTS).collect()]  # only where clusters lie depends on it
    pivots = rows.sparkSession.sparkContext.broadcast(_spread(_directions(pd.Series(sample)), wanted) if sample else np.zeros((1, len(features))))

    def place(batches):
        for pdf in batches:
            if len(pdf):
                m = _directions(pdf["z"])
                if threshold > 0:  # what has no direction correlates with nothing
                    pdf, m = pdf[m.any(axis=1)], m[m.any(axis=1)]
                yield pd.DataFrame({"near": np.abs(m @ pivots.value.T).argmax(axis=1), "node": pdf["node"].to_numpy(), "vector": [v.tobytes() for v in m]})

    placed = cut_lineage(rows.mapInPandas(place, "near int, node string, vector binary"))
    parts = placed.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias("parts"))
    split = placed.join(F.broadcast(parts), "near")  # a row per pivot
    split = split.withColumn("cluster", F.col("near").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("node"), F.col("parts")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m, names = _vectors(pdf["vector"]), pdf["node"].to_numpy()
        c = np.abs(np.round(m @ m.T, 12))
        c[names[:, None] == names[None, :]] = -1.0
        floors = np.maximum(threshold, np.partition(c, -k, axis=1)[:, -k] if len(m) > k else -1.0) * np.ones(len(m))
        centre = (np.where(m @ m[0] < 0, -1.0, 1.0)[:, None] * m).sum(axis=0)
        centre = centre / (np.linalg.norm(centre) or 1.0)
        radius = float(np.arccos(np.clip(np.abs(m @ centre), 0, 1)).max()) if threshold > 0 else np.pi
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[:1].to_numpy(), "names": [names.tolist()], "vectors": [m.tobytes()], "centre": [centre.tobytes()], "radius": [radius],
                             "floors": [floors.tolist()], "floor": [floors.min()]})

    return cut_lineage(split.groupBy("cluster").applyInPandas(
        pack, "cluster long, names array<string>, vectors binary, centre binary, radius double, floors array<double>, floor double"))


def cluster_pairs(clusters: DataFrame) -> DataFrame:
    """Pairs (``low``, ``high``) of clusters that can hold neighbours of each other: by the triangle inequality two
    nodes are no closer than their centres less both radii, and a pair is left out where the correlation
    of that angle is below what every node of both already has."""
    slim = clusters.select("cluster", "centre", "radius", "floor")
    parts = max(1, -(-slim.count() // BOUND_CLUSTERS))
    slim = slim.withColumn("part", F.pmod(F.xxhash64("cluster"), F.lit(parts)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    slim = slim.select(F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), (F.col("part") <= F.col("other")).alias("left"), "cluster", "centre", "radius", "floor")

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf[pdf["left"]]
        two = pdf[~pdf["left"]] if (~pdf["left"]).any() else one
        if one.empty or two.empty or (pdf["x"].iloc[0] != pdf["y"].iloc[0] and two is one):
            return pd.DataFrame({"low": [], "high": []})
        angle = np.arccos(np.clip(np.abs(_vectors(one["centre"]) @ _vectors(two["centre"]).T), 0, 1))
        angle = np.clip(angle - one["radius"].to_numpy()[:, None] - two["radius"].to_numpy()[None, :], 0, None)
        least = np.minimum(one["floor"].to_numpy()[:, None], two["floor"].to_numpy()[None, :])
        i, j = np.nonzero(np.cos(angle) >= least - ROOM)
        a, b = one["cluster"].to_numpy()[i], two["cluster"].to_numpy()[j]
        return pd.DataFrame({"low": np.minimum(a, b), "high": np.maximum(a, b)}).drop_duplicates()

    return slim.groupBy("x", "y").applyInPandas(bound, "low long, high long")


def neighbour_graph(nodes: DataFrame, key: str, features: Sequence[str], threshold: float = 0.6, k: int = 20, block: int = BLOCK_NODES) -> DataFrame:
    """Undirected edges (a, b, corr) between nodes whose standardised feature rows correlate: for each
    node its ``k`` largest absolute correlations (ties by name) of at least ``threshold``.

    Nodes gather in clusters of like direction (:func:`node_clusters`), and only pairs of clusters whose bounds
    allow a neighbour are compared (:func:`cluster_pairs`), each in a task of its own that keeps at most ``k``
    partners per node. The pruning is exact; rows without any direction leave nothing to prune.
    """
    clusters = node_clusters(nodes, key, features, threshold, k, block)
    pairs = cluster_pairs(clusters)
    held = clusters.select(F.col("cluster").alias("own"), "names", "vectors", "floors")
    meets = pairs.join(held, F.col("low") == F.col("own")).withColumn("left", F.lit(True)).unionAll(
        pairs.where("low <> high").join(held, F.col("high") == F.col("own")).withColumn("left", F.lit(False)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for row in pdf.sort_values("left", ascending=False).itertuples():
            names = np.array(list(row.names), dtype=object)
            order = np.argsort(names)
            sides.append((names[order], np.frombuffer(row.vectors).reshape(len(names), -1)[order], np.array(list(row.floors))[order]))
        found = []
        for mine, theirs in [(sides[0], sides[-1]), (sides[-1], sides[0])][:len(sides)]:
            c = np.round(mine[1] @ theirs[1].T, 12)
            c[mine[0][:, None] == theirs[0][None, :]] = 0.0
            best = np.argsort(-np.abs(c), axis=1, kind="stable")[:, :k]
            near = np.abs(np.take_along_axis(c, best, 1))
            i, j = np.nonzero((near >= threshold) & (near >= mine[2][:, None]))
            j = best[i, j]
            found.append(pd.DataFrame({"node": mine[0][i], "near": theirs[0][j], "corr": c[i, j]}))
        return pd.concat(found)

    pairs = meets.groupBy("low", "high").applyInPandas(compare, "node string, near string, corr double").where("node <> near")
    ranked = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("node").orderBy(F.abs("corr").desc(), "near"))).where(F.col("_k") <= k)
    return ranked.groupBy(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).agg(F.max("corr").alias("corr"))
