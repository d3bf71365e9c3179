"""Products of all pairs of series, a tile of pairs and a range of steps at a time.

Keys fall into tiles by a hash, steps (dense numbers of dates) into spans. A block is one tile over
one span with the steps before it that lags need. Two blocks of a span meet in one task, which
multiplies them as matrices; what a pair of tiles gives in its spans is summed as matrices too, and
only sums of whole series become rows. No task holds more than two blocks or one tile of sums, so
the number of keys is bounded by the number of pairs that are wanted, not by memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Keys of a tile on average and steps of a span.
TILE_KEYS, SPAN_STEPS = 128, 512


def dense_steps(panel: DataFrame, day: str) -> DataFrame:
    """``day`` and its 0-based number ``t``; a row per calendar date."""
    days = panel.select(day).distinct().withColumn("_one", F.lit(1))
    return days.select(day, (F.row_number().over(Window.partitionBy("_one").orderBy(day)) - 1).alias("t"))


def blocks(panel: DataFrame, key: str, value: str, depth: int, tile: int, span: int) -> tuple[DataFrame, int, int]:
    """(blocks, number of tiles, number of spans) of a panel (``key``, ``t``, ``value``): ``tile``, ``span``, ``names``
    (sorted), ``from_`` (step of the first row) and ``data`` (steps x names doubles, missing as NaN). Every tile has
    a block in every span, also where it holds no value."""
    sized = panel.agg(F.countDistinct(key).alias("keys"), F.max("t").alias("last")).first()
    tiles, steps = max(1, -(-sized["keys"] // tile)), (sized["last"] or 0) + 1
    spans = -(-steps // span)
    rows = panel.select(F.pmod(F.xxhash64(key), F.lit(tiles)).cast("int").alias("tile"), F.col(key).alias("name"), "t", F.col(value).cast("double").alias("value"))
    members = rows.select("tile", "name").distinct().groupBy("tile").agg(F.array_sort(F.collect_list("name")).alias("names"))  # a tile of names
    own, later = F.floor(F.col("t") / span).cast("int"), F.floor((F.col("t") + depth) / span).cast("int")
    spread = rows.withColumn("span", F.explode(F.sequence(own, F.least(later, F.lit(spans - 1)))))  # lags reach into the span before
    cells = spread.groupBy("tile", "span").agg(F.collect_list(F.struct("name", "t", "value")).alias("cells"))  # tile x span values at most
    grid = members.withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))

    def dense(batches):
        for pdf in batches:
            out = []
            for number, names, entries in zip(pdf["span"], pdf["names"], pdf["cells"]):
                lo, hi = max(0, number * span - depth), min(steps, (number + 1) * span)
                data = np.full((hi - lo, len(names)), np.nan)
                if entries is not None and len(entries):
                    at = {n: i for i, n in enumerate(names)}
                    data[[e["t"] - lo for e in entries], [at[e["name"]] for e in entries]] = [np.nan if e["value"] is None else e["value"] for e in entries]
                out.append((lo, data.tobytes()))
            yield pdf[["tile", "span", "names"]].assign(from_=[o[0] for o in out], data=[o[1] for o in out])

    name = panel.schema[key].dataType.simpleString()
    packed = grid.join(cells, ["tile", "span"], "left").mapInPandas(dense, f"tile int, span int, names array<{name}>, from_ int, data binary")
    return cut_lineage(packed), tiles, spans


def pair_sums(panel: DataFrame, key: str, value: str, terms: Callable, columns: Sequence[str], *, depth: int = 0, ordered: bool = True,
              tile: int = TILE_KEYS, span: int = SPAN_STEPS) -> DataFrame:
    """``source``, ``target``, ``lag`` and the sums ``columns`` of every pair of keys of a panel (``key``, ``t``, ``value``).

    ``terms(x, y, first)`` gets the source's and the target's block of a span (steps x keys, NaN where missing; the
    first ``first`` steps belong to the span before) and yields (lag, matrices in the order of ``columns``), each of
    source keys x target keys. With ``ordered`` both directions of a pair are there, else only the one with
    ``source <= target``, pairs of a key with itself included.
    """
    packed, tiles, spans = blocks(panel, key, value, depth, tile, span)
    every = F.sequence(F.lit(0), F.lit(tiles - 1))
    source = packed.withColumn("other", F.explode(every if ordered else F.sequence(F.col("tile"), F.lit(tiles - 1))))
    target = packed.withColumn("other", F.explode(every if ordered else F.sequence(F.lit(0), F.col("tile"))))
    meets = source.select(F.col("tile").alias("i"), F.col("other").alias("j"), "span", F.lit(0).alias("side"), "names", "from_", "data").unionAll(
        target.select(F.col("other").alias("i"), F.col("tile").alias("j"), "span", F.lit(1).alias("side"), "names", "from_", "data"))
    name = panel.schema[key].dataType.simpleString()
    part = f"i int, j int, lag int, sources array<{name}>, targets array<{name}>, sums binary"

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = (pdf[pdf["side"] == s].iloc[0] for s in (0, 1))
        x, y = (np.frombuffer(r["data"]).reshape(-1, len(r["names"])) for r in (one, two))
        found = [(lag, np.stack(matrices).tobytes()) for lag, matrices in terms(x, y, int(one["span"] * span - one["from_"]))]
        return pd.DataFrame({"i": one["i"], "j": one["j"], "lag": [f[0] for f in found], "sources": [list(one["names"])] * len(found),
                             "targets": [list(two["names"])] * len(found), "sums": [f[1] for f in found]})

    fields = ", ".join(f"{c} double" for c in columns)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        sources, targets = (np.array(list(pdf[c].iloc[0]), dtype=object) for c in ("sources", "targets"))
        sums = np.zeros((len(columns), len(sources), len(targets)))
        for data in pdf["sums"]:
            sums += np.frombuffer(data).reshape(sums.shape)
        a, b = (m.ravel() for m in np.meshgrid(np.arange(len(sources)), np.arange(len(targets)), indexing="ij"))
        flat = sums.reshape(len(columns), -1)
        if ordered:
            keep = sources[a] != targets[b]
        else:  # tiles are not in the order of names
            keep = (pdf["i"].iloc[0] != pdf["j"].iloc[0]) | (a <= b)
        return pd.DataFrame({"source": sources[a[keep]], "target": targets[b[keep]], "lag": int(pdf["lag"].iloc[0]), **{c: s[keep] for c, s in zip(columns, flat)}})

    partial = meets.groupBy("i", "j", "span").applyInPandas(multiply, part)
    return partial.groupBy("i", "j", "lag").applyInPandas(total, f"source {name}, target {name}, lag int, {fields}")
