"""Ordered per-series windows with pandas-like null rules.

A series is one entity of a deduplicated panel, so its length is bounded by the
trading calendar; the cross-section (all entities of one date) is not bounded and is
handled in ``ranks.py``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


class Series:
    """Window factory for ``keys`` ordered by ``order`` (total order within a key)."""

    def __init__(self, keys: Sequence[str] | str, order: Sequence[str] | str):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.order = [order] if isinstance(order, str) else list(order)

    @property
    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def frame(self, lo: int, hi: int = 0):
        return self.window.rowsBetween(lo, hi)

    @property
    def past(self):
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, col, n: int = 1) -> Column:
        return F.lag(col, n).over(self.window)

    def lead(self, col, n: int = 1) -> Column:
        return F.lead(col, n).over(self.window)

    def row_index(self) -> Column:
        return F.row_number().over(self.window) - 1

    def roll(self, agg, col, n: int, min_rows: int = 1) -> Column:
        """Aggregate the last ``n`` rows; null unless ``min_rows`` values are present."""
        col = F.col(col) if isinstance(col, str) else col
        w = self.frame(-(n - 1))
        return F.when(F.count(col).over(w) >= min_rows, agg(col).over(w))

    def roll_prev(self, agg, col, n: int, min_rows: int = 1) -> Column:
        """Like ``roll`` over the ``n`` rows that end just before the current row."""
        col = F.col(col) if isinstance(col, str) else col
        w = self.frame(-n, -1)
        return F.when(F.count(col).over(w) >= min_rows, agg(col).over(w))

    def pct_change(self, col, n: int = 1) -> Column:
        return F.try_divide(F.col(col), self.lag(col, n)) - 1

    def forward_return(self, col, n: int) -> Column:
        return F.try_divide(self.lead(col, n), F.col(col)) - 1

    def ffill(self, col) -> Column:
        return F.last(col, ignorenulls=True).over(self.past)

    def bfill(self, col) -> Column:
        return F.first(col, ignorenulls=True).over(
            self.window.rowsBetween(0, Window.unboundedFollowing)
        )

    def ffill_bfill(self, col) -> Column:
        return F.coalesce(self.ffill(col), self.bfill(col))


PANEL = Series("ts_code", "trade_date")


def clip(col: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp that keeps nulls (``least``/``greatest`` alone would skip them)."""
    out = col
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(col.isNotNull(), out)


def flag(cond: Column) -> Column:
    """Boolean to 1.0/0.0, null counts as false."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


#: Fixed value: more than the share of two averages of up to 60 values that rounding can make up.
ROUNDING = 2e-14


def above(a: Column, b: Column) -> Column:
    """Whether average ``a`` is above ``b``; equal averages of different rows may differ in their
    last bits, by the order of addition alone, and are not above each other."""
    return (a > b) & (a - b > ROUNDING * F.least(F.abs(a), F.abs(b)))


#: Natural logs of decay that a segment of a recursive mean spans, and beyond which nothing shows in a double.
SEGMENT_DECAY, LOST_DECAY = 400.0, 42.0


def ewm(
    df: DataFrame,
    series: Series,
    specs: dict[str, tuple[str, float]],
    alike: dict[str, str] | None = None,
    segment: float = SEGMENT_DECAY,
) -> DataFrame:
    """Recursive mean ``y0=x0, y=a*x+(1-a)*y`` for several columns in O(rows).

    ``specs`` maps output name to (input column, a). At an inner null the mean stays, and the
    next value counts more: after ``g`` nulls the old mean weighs ``(1-a)**(g+1)`` against
    ``a``. ``alike`` names for an input another one that is null in the same rows, so both
    share a sort. A series is cut into segments in which the old mean decays by
    ``exp(segment)``: inside one, ``y`` is a scaled running sum, and of the past only the
    value before the segment still shows.
    """
    slope = lambda a: -math.log(1 - a)
    groups: dict[tuple, dict] = {}
    for out, (c, a) in specs.items():
        src = (alike or {}).get(c, c)
        near = next((k for k in groups if k[0] == src and min(slope(a), slope(k[1])) * segment >= LOST_DECAY * max(slope(a), slope(k[1]))), (src, a))
        groups.setdefault(near, {})[out] = (c, a)
    index, past, before = F.col("_ewm_i"), series.past, series.window.rowsBetween(Window.unboundedPreceding, -1)
    counts, cuts, carried, final = {}, {}, {}, {}
    inner: list[tuple[dict, dict]] = []
    for j, ((src, _), outs) in enumerate(groups.items()):
        n, gap, seg, there = F.col(f"_ewm_n{j}"), F.col(f"_ewm_g{j}"), F.col(f"_ewm_s{j}"), F.col(src).isNotNull()

        def old(a, gap=gap):
            """Weight of the old mean; a gap after which it is lost counts as just that gap."""
            return F.pow(F.lit(1.0 - a), F.least(gap, F.lit(math.ceil(2 * LOST_DECAY / slope(a)))))

        def decay(a, n=n, there=there, old=old):
            return F.when(there & (n > 1), F.log(1.0 + a / old(a))).otherwise(0.0)

        counts |= {f"_ewm_n{j}": F.count(src).over(past), f"_ewm_g{j}": (index - F.last(F.when(there, index), ignorenulls=True).over(before)).cast("double")}
        cuts[f"_ewm_s{j}"] = F.floor(F.sum(decay(max(a for _, a in outs.values()))).over(past) / segment)
        inside = Window.partitionBy(*series.keys, f"_ewm_s{j}").orderBy(*series.order).rowsBetween(Window.unboundedPreceding, 0)
        steps, sums = {}, {}
        new_segment = seg != series.lag(seg)
        for o, (c, a) in outs.items():
            y, f = F.col(f"_ewm_y_{o}"), F.col(f"_ewm_f_{o}")
            steps[f"_ewm_f_{o}"] = F.sum(decay(a)).over(inside)
            term = F.when(~there, 0.0).when(n == 1, F.col(c)).otherwise(a * F.col(c) / (old(a) + a))
            sums[f"_ewm_y_{o}"] = F.exp(-f) * F.sum(term * F.exp(f)).over(inside)
            carried[f"_ewm_c_{o}"] = F.when(new_segment, series.lag(y))
            final[o] = F.when(n > 0, y + F.exp(-f) * F.coalesce(F.last(f"_ewm_c_{o}", ignorenulls=True).over(past), F.lit(0.0)))
        inner.append((steps, sums))
    # windows of one sort order follow each other: the series, each segmentation, the series again
    df = df.withColumn("_ewm_i", series.row_index()).withColumns(counts).withColumns(cuts)
    for steps, sums in inner:
        df = df.withColumns(steps).withColumns(sums)
    helpers = ["_ewm_i", *counts, *cuts, *(c for pair in inner for d in pair for c in d), *carried]
    return df.withColumns(carried).withColumns(final).drop(*helpers)


def run_lengths(df: DataFrame, series: Series, sign: Column, out: str = "run") -> DataFrame:
    """Length of the current run of equal ``sign`` values (gaps and islands)."""
    df = df.withColumn("_sg", sign)
    df = df.withColumn(
        "_brk",
        F.when(F.col("_sg") == F.lag("_sg").over(series.window), 0).otherwise(1),
    )
    df = df.withColumn("_blk", F.sum("_brk").over(series.past))
    inside = Window.partitionBy(*series.keys, "_blk").orderBy(*series.order)
    return df.withColumn(out, F.row_number().over(inside)).drop("_brk", "_blk", "_sg")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] | None = None) -> DataFrame:
    """Newest row per key through a mergeable ``max_by``: partial aggregation on the map
    side, so a hot key never travels as a whole. Ties go by ``ties``, by default the other columns."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ties = [c for c in rest if c != order] if ties is None else ties
    best = F.max_by(F.struct(*rest), F.struct(order, *ties))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Union of old and new rows, one row per key: the highest ``version`` wins."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != version]
    return latest_per_key(both, keys, version, rest)


def topk_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Top-k rows per group; Spark trims each partition to k before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    values: Sequence[str],
    bucket: str = "month",
    backfill: bool = False,
) -> DataFrame:
    """Backward as-of join: newest ``right`` row at or before each ``left`` row.

    Both sides are cut into (key, bucket) cells, so one hot key spreads over many tasks.
    A cell's first rows take the value carried from earlier cells; the carry table has one
    row per (key, bucket). Of rows with equal times the one with the greatest values counts.
    """
    cell = lambda c: F.date_trunc(bucket, F.col(c))
    packed = right.where(F.col(right_time).isNotNull()).select(
        F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.struct(*values).alias("_v")
    ).withColumn("_b", F.date_trunc(bucket, F.col("_t")))
    lcols = left.columns
    lrows = left.withColumn("_b", cell(left_time))
    probe = lrows.select(
        F.col(key).alias("_k"), F.col("_b"), F.col(left_time).alias("_t"),
        F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in lcols]).alias("_l"),
        F.lit(None).cast(packed.schema["_v"].dataType).alias("_v"),
    )
    feed = packed.select(
        "_k", "_b", "_t", F.lit(0).alias("_side"),
        F.lit(None).cast(probe.schema["_l"].dataType).alias("_l"), "_v",
    )
    w = (
        Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = (
        probe.unionByName(feed)
        .withColumn("_near", F.last("_v", ignorenulls=True).over(w))
        .where(F.col("_side") == 1)
        .select("_k", "_b", "_l", "_near")
    )
    ends = packed.groupBy("_k", "_b").agg(
        F.max_by("_v", F.struct("_t", "_v")).alias("_end"), F.min_by("_v", F.struct("_t", "_v")).alias("_start")
    )
    cells = lrows.select(F.col(key).alias("_k"), "_b").distinct().join(ends, ["_k", "_b"], "full_outer")
    over_cells = Window.partitionBy("_k").orderBy("_b")
    cells = cells.withColumn(
        "_carry",
        F.last("_end", ignorenulls=True).over(over_cells.rowsBetween(Window.unboundedPreceding, -1)),
    )
    pick = [F.col("_near"), F.col("_carry")]
    cols = ["_k", "_b", "_carry"]
    if backfill:
        cells = cells.withColumn(
            "_first",
            F.first("_start", ignorenulls=True).over(
                over_cells.rowsBetween(0, Window.unboundedFollowing)
            ),
        )
        pick.append(F.col("_first"))
        cols.append("_first")
    joined = inside.join(cells.select(*cols), ["_k", "_b"], "left")
    value = F.coalesce(*pick)
    return joined.select(
        *[F.col("_l")[c].alias(c) for c in lcols], *[value[v].alias(v) for v in values]
    )


def cumulative(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    bucket: str,
    specs: dict[str, tuple[str, str]],
    group_rows: int | None = None,
    limit: int = 2_000_000,
) -> DataFrame:
    """Running sums and maxima per group.

    ``specs`` maps output to (column, kind); kinds are ``sum``, ``max`` and their exclusive
    forms ``sum_before``, ``max_before``. Groups measured to be small take one window. Long
    or unmeasured groups are split into (keys, bucket) cells, where ``bucket`` must not fall
    along ``order``: a cell is scanned on its own and one row per cell carries the totals of
    the earlier cells.
    """
    if group_rows is not None and group_rows <= limit:
        whole = Window.partitionBy(*keys).orderBy(order)
        plain = {}
        for out, (c, kind) in specs.items():
            f = {"sum": F.sum, "max": F.max}[kind.split("_")[0]]
            plain[out] = f(c).over(whole.rowsBetween(Window.unboundedPreceding, -1 if kind.endswith("_before") else 0))
        return df.withColumns(plain)
    df = cut_lineage(df)
    inside = Window.partitionBy(*keys, bucket).orderBy(order)
    agg = {"sum": F.sum, "max": F.max}
    local, totals, carried, final = {}, [], {}, {}
    for out, (c, kind) in specs.items():
        f = agg[kind.split("_")[0]]
        hi = -1 if kind.endswith("_before") else 0
        local[f"_in_{out}"] = f(c).over(inside.rowsBetween(Window.unboundedPreceding, hi))
        totals.append(f(c).alias(f"_t_{out}"))
        earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        carried[f"_c_{out}"] = f(f"_t_{out}").over(earlier)
        a, b = F.col(f"_in_{out}"), F.col(f"_c_{out}")
        if kind.startswith("sum"):
            final[out] = F.coalesce(a + b, a, b)
        else:
            final[out] = F.greatest(a, b)
    cells = df.groupBy(*keys, bucket).agg(*totals).withColumns(carried).select(*keys, bucket, *carried)
    df = df.withColumns(local).join(cells, [*keys, bucket])
    return df.withColumns(final).drop(*local, *carried)
