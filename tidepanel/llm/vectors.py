"""Preparation of exposure vectors shared by the searches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash resolution of samples.
PARTS = 1 << 20


def finite_vectors(exposures: DataFrame, id_col: str, features_col: str, *, nonzero: bool) -> DataFrame:
    """``key``, ``vec`` (array of doubles) of the rows whose vectors take part: not null, finite in every
    component, of the most common length (the shorter one of a tie) and, if asked, not zero."""
    vec = F.transform(exposures[features_col], lambda x: x.cast("double"))
    rows = exposures.select(exposures[id_col].alias("key"), vec.alias("vec")).where("key is not null and vec is not null and size(vec) > 0")
    rows = rows.where(F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))  # NaN is the largest double
    if nonzero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(lengths.select("n")), F.size("vec") == F.col("n")).select("key", "vec")


def taking_part(rows: DataFrame) -> DataFrame:
    """The rows whose ``vec`` (array of doubles) is not null, finite in every entry and of the most common length
    (the shorter one of a tie), whatever their other columns hold."""
    rows = rows.where("vec is not null and size(vec) > 0").where(F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    lengths = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").limit(1)
    return rows.join(F.broadcast(lengths.select("width")), F.size("vec") == F.col("width")).drop("width")


def sampled(rows: DataFrame, total: int, most: int, *columns: str) -> DataFrame:
    """About ``most`` rows by a hash of the columns (the key, if none is named), all if there are fewer."""
    return rows.where(F.pmod(F.xxhash64(*(columns or ("key",))), F.lit(PARTS)) < min(PARTS, -(-most * PARTS // max(total, 1))))


def bucket(parts: Column, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*map(F.col, columns), F.lit(11)), parts).cast("int")


def matrix(column) -> np.ndarray:
    """Rows packed as doubles."""
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact as longs whatever their size."""
    if not len(x):
        return np.empty(0, dtype=np.int64)
    if np.abs(x).max() * np.abs(y).max() * x.shape[1] < 2.0 ** 53:
        return np.einsum("ij,ij->i", x, y).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(u, v)) for u, v in zip(x, y)], dtype=np.int64)
