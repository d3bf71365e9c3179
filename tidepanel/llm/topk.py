"""Exact top-k inner products of integer exposure vectors, a block at a time.

Components are whole units. Vectors are laid out in document ranges of similar vectors (nearest
of a bounded set of pivots, then by a hash); a block keeps its vectors as a forward index and the
greatest and least value of every component. A query sums the component maxima into a bound for
each block, takes blocks in the order of their bounds and scores them through the forward index
until the bounds fall below its k-th score. Its own block gives the first k-th score, so groups of
blocks can be searched in tasks of their own and still leave most blocks out.

Sums are worked out in doubles. Where they may pass 2**53 a bound on their rounding widens every
comparison, and pairs that come through are scored anew in whole numbers of any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .vectors import bucket, finite_vectors, matrix, sampled

#: Pivots at most; vectors of a block and of a pivot on average; blocks and queries that meet in a task.
MOST_PIVOTS, BLOCK_VECTORS, PIVOT_VECTORS = 1024, 128, 512
CELL_BLOCKS, CELL_QUERIES = 256, 1024
#: Products below this are exact in doubles.
EXACT = 2.0 ** 53


def whole_units(vec, scale: int):
    """``floor(scale * x)`` of each component as a double; doubles from 2**53 on are whole anyway."""
    def unit(x):
        y = x * F.lit(float(scale))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vec, unit)


def _slack(x: np.ndarray, y: np.ndarray) -> np.ndarray | float:
    """How far a computed inner product of each row of x and each row of y may be off; nothing while all are below 2**53."""
    x, y = np.abs(x), np.abs(y)
    if not x.size or not y.size or x.max() * y.max() * x.shape[1] < EXACT:
        return 0.0
    return (x @ y.T) * (x.shape[1] + 2) * 2.0 ** -50


def _scores(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Exact inner products of the rows of x with the rows of y, pair by pair."""
    return [sum(int(a) * int(b) for a, b in zip(u, v)) for u, v in zip(x.tolist(), y.tolist())]


def _places(scores: pd.Series) -> np.ndarray:
    """Numbers that rise as the scores fall."""
    if scores.dtype != object:
        return -scores.to_numpy()
    place = {s: i for i, s in enumerate(sorted(set(scores), reverse=True))}
    return np.array([place[s] for s in scores], dtype=np.int64)


def _below(score: int) -> float:
    """A double that is not above the score."""
    if abs(score) < EXACT:
        return float(score)
    try:
        return float(np.nextafter(float(score), -np.inf))
    except OverflowError:
        return np.finfo(float).max if score > 0 else -np.inf


def _digits(score: int) -> bytes | None:
    """Bytes that order scores of one sign beyond longs; null for a long."""
    if -(1 << 63) <= score < 1 << 63:
        return None
    raw = abs(score).to_bytes((score.bit_length() + 7) // 8)
    raw = len(raw).to_bytes(4) + raw
    return raw if score > 0 else bytes(255 - b for b in raw)


def top_exposures(exposures: DataFrame, query: str, *, k: int = 20, scale: int = 64, id_col: str = "ts_code", features_col: str = "features") -> DataFrame:
    """The ``k`` rows with the largest integer inner product for each query: ``query_code``, ``rank`` from 1,
    ``ts_code``, ``score``; ties to the smaller code. Queries are the rows of ``exposures`` that satisfy the SQL
    condition ``query`` on ``ts_code``; a component x counts as ``floor(scale * x)``.

    A row is no result of its own query. Vectors that are null, empty, of an uncommon length or hold a null or
    non-finite component take no part, nor do null codes; zero vectors do. A code that occurs repeatedly counts
    once, with its best score. Queries with fewer candidates get all; an empty table gives no rows; further
    columns are ignored. Scores of any size are ranked exactly; one that is no long is null in ``score``. A
    component whose ``scale``-fold is no finite double counts as non-finite.
    """
    rows = finite_vectors(exposures, id_col, features_col, nonzero=False).select("key", whole_units(F.col("vec"), scale).alias("vec"))
    rows = rows.where(F.forall("vec", lambda x: F.abs(x) < float("inf")))
    rows = cut_lineage(rows.withColumn("asked", F.expr(f"exists(array(key), {id_col} -> {query})")))
    kind = rows.schema["key"].dataType
    total = rows.count()
    pivots = np.array([r.vec for r in sampled(rows, total, min(MOST_PIVOTS, -(-total // PIVOT_VECTORS))).orderBy("key").collect()][:MOST_PIVOTS], dtype=np.float64)
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # MOST_PIVOTS vectors at most
    schema = T.StructType([T.StructField("pivot", T.IntegerType()), rows.schema["key"], T.StructField("asked", T.BooleanType()), T.StructField("vec", T.BinaryType())])

    def place(batches):
        ends = shared.value
        with np.errstate(over="ignore"):
            half = 0.5 * (ends ** 2).sum(axis=1) if len(ends) else None
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1))
            with np.errstate(over="ignore", invalid="ignore"):  # any pivot is right, a near one is better
                near = (x @ ends.T - half).argmax(axis=1) if len(ends) else np.zeros(len(x), dtype=int)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], schema.names)

    placed = cut_lineage(rows.mapInArrow(place, schema))
    parts = placed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_VECTORS)).cast("int").alias("parts"))
    ranges = placed.join(F.broadcast(parts), "pivot").withColumn("part", bucket(F.col("parts"), "key"))  # a row per pivot
    block_schema = T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)),
                                 T.StructField("asked", T.ArrayType(T.BooleanType())), T.StructField("forward", T.BinaryType()),
                                 T.StructField("most", T.BinaryType()), T.StructField("least", T.BinaryType())])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = matrix(pdf["vec"])
        return pd.DataFrame({"pivot": pdf["pivot"].iloc[:1].to_numpy(), "part": pdf["part"].iloc[:1].to_numpy(), "keys": [pdf["key"].tolist()], "asked": [pdf["asked"].tolist()],
                             "forward": [x.tobytes()], "most": [x.max(axis=0).tobytes()], "least": [x.min(axis=0).tobytes()]})

    blocks = cut_lineage(ranges.groupBy("pivot", "part").applyInPandas(build, block_schema))
    query_schema = T.StructType([T.StructField("key", kind), T.StructField("vec", T.BinaryType()), T.StructField("floor", T.DoubleType())])

    def own_block(batches):
        for batch in batches:
            for keys, asked, forward in zip(*(batch.column(c).to_pylist() for c in ("keys", "asked", "forward"))):
                picked = np.flatnonzero(asked)
                if len(picked):
                    x, names = np.frombuffer(forward).reshape(len(keys), -1), np.array(keys)
                    with np.errstate(over="ignore", invalid="ignore"):
                        scores = x[picked] @ x.T - _slack(x[picked], x)
                    scores = np.where(np.isfinite(scores), scores, -np.inf)
                    # each other code counts once, so a repeated code cannot raise the floor
                    floors = [np.sort(pd.Series(s).groupby(names).max().drop(names[i]).to_numpy())[::-1] for i, s in zip(picked, scores)]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in picked], batch.schema.field("keys").type.value_type), pa.array([x[i].tobytes() for i in picked], pa.binary()),
                                                      pa.array([float(f[k - 1]) if len(f) >= k else float("-inf") for f in floors], pa.float64())], query_schema.names)

    queries = blocks.select("keys", "asked", "forward").mapInArrow(own_block, query_schema)
    counted = blocks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.filter("asked", lambda a: a))).alias("m")).first()
    groups, cells = max(1, -(-(counted.m or 0) // CELL_QUERIES)), max(1, -(-counted.n // CELL_BLOCKS))
    none = lambda t: F.lit(None).cast(t)
    b = blocks.select(F.pmod(F.xxhash64("pivot", "part"), F.lit(cells)).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "keys", "forward", "most", "least",
                      none(kind).alias("key"), none("double").alias("floor"))
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), bucket(F.lit(groups), "key").alias("group"), none(T.ArrayType(kind)).alias("keys"), F.col("vec").alias("forward"),
                       none("binary").alias("most"), none("binary").alias("least"), "key", "floor")
    out = T.StructType([T.StructField("query", kind), T.StructField("key", kind), T.StructField("side", T.IntegerType()),
                        T.StructField("score", T.LongType()), T.StructField("digits", T.BinaryType())])
    found = b.unionAll(q).groupBy("cell", "group").applyInPandas(lambda pdf: _search(pdf, k), out)
    best = found.groupBy("query", "key").agg(F.max(F.struct("side", "score", "digits")).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_code"), "rank", F.col("key").alias("ts_code"), "score.score")


def _search(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best pairs of the queries with the blocks of one cell. A score beyond longs is told by its ``side``
    (-1, 1; 0 for a long) and ``digits``."""
    is_query = pdf["floor"].notna().to_numpy()
    blocks, queries = pdf[~is_query], pdf[is_query]
    nothing = pd.DataFrame({"query": pdf["key"].iloc[:0], "key": pdf["key"].iloc[:0], "side": np.empty(0, dtype=np.int32), "score": np.empty(0, dtype=np.int64), "digits": []})
    if blocks.empty or queries.empty:
        return nothing
    y, most, least = matrix(queries["forward"]), matrix(blocks["most"]), matrix(blocks["least"])
    keys = [np.asarray(x) for x in blocks["keys"]]
    forward = [np.frombuffer(f).reshape(len(x), -1) for f, x in zip(blocks["forward"], keys)]
    names, kth = queries["key"].to_numpy(), queries["floor"].to_numpy().copy()
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = np.maximum(y, 0) @ most.T + np.minimum(y, 0) @ least.T + _slack(y, np.maximum(np.abs(most), np.abs(least)))
    bounds[~np.isfinite(bounds)] = np.inf
    order = np.argsort(-bounds, axis=1, kind="stable")
    found = []
    lo, hi = 0, 1
    while lo < len(keys):  # waves of blocks in each query's own order
        wave = order[:, lo:hi]
        at, slot = np.nonzero(np.take_along_axis(bounds, wave, 1) >= kth[:, None])
        if not len(at):
            break
        which = wave[at, slot]
        for block in np.unique(which):
            rows = at[which == block]
            rows = rows[bounds[rows, block] >= kth[rows]]
            with np.errstate(over="ignore", invalid="ignore"):
                slack = _slack(y[rows], forward[block])
                scores = y[rows] @ forward[block].T
                reach = scores + slack
            rounded = np.ndim(slack) > 0
            if rounded:
                reach[~np.isfinite(reach)] = np.inf
            i, j = np.nonzero((reach >= kth[rows][:, None]) & (names[rows][:, None] != keys[block][None, :]))
            exact = _scores(y[rows[i]], forward[block][j]) if rounded else scores[i, j].astype(np.int64)
            found.append(pd.DataFrame({"at": rows[i], "key": keys[block][j], "score": pd.Series(exact, dtype=object if rounded else np.int64)}))
        held = pd.concat(found)
        held = held.assign(place=_places(held["score"])).sort_values(["at", "place", "key"])
        held = held.drop_duplicates(["at", "key"])  # a code takes one place, with its best score
        held = held[held.groupby("at").cumcount() < k]
        found = [held.drop(columns="place")]
        last = held[held.groupby("at").cumcount() == k - 1]
        kth[last["at"]] = np.maximum(kth[last["at"]], [_below(s) for s in last["score"]])
        lo, hi = hi, min(len(keys), 2 * hi + 1)
    if not found:
        return nothing
    held = pd.concat(found)
    base = {"query": names[held["at"]], "key": held["key"].to_numpy()}
    if held["score"].dtype != object:
        return pd.DataFrame({**base, "side": np.int32(0), "score": held["score"].to_numpy(), "digits": None})
    digits = [_digits(s) for s in held["score"]]
    return pd.DataFrame({**base, "side": [0 if d is None else 1 if s > 0 else -1 for s, d in zip(held["score"], digits)],
                         "score": pd.array([int(s) if d is None else None for s, d in zip(held["score"], digits)], dtype="Int64"), "digits": digits})
