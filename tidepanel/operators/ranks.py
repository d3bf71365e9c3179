"""Cross-sectional ranks and quantiles for groups of any size.

One date may hold a third of all rows, so a plain window per date would put them into
one task. Every function takes the size of the widest group. Up to ``WINDOW_ROWS`` a
window is the cheapest exact plan; beyond it the group is split by value:

* groups are counted, and those beyond ``CELL_ROWS`` rows are cut into cells at approximate
  quantiles of their own values; the cuts are stored first, so every pass uses the same ones;
* a value that is itself a cut has a cell of its own, so ties cannot form a hot cell;
* a running count over the (few) cells of a group gives each cell its offset, and the
  local rank inside a cell completes the exact rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WINDOW_ROWS = 2_000_000
#: Cuts of a group that is split, and the rows beyond which a group is.
CELLS, CELL_ROWS = 256, 200_000


def widest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group: one aggregate with map-side combine."""
    row = df.groupBy(*by).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def _same(by: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of the group columns with their copies ``<prefix>0``, ``<prefix>1``, ..."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{prefix}{i}")) for i, c in enumerate(by)])


def _renamed(by: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{i}") for i, c in enumerate(by)]


def _large_groups(df: DataFrame, by: Sequence[str]) -> DataFrame | None:
    """Groups beyond ``CELL_ROWS`` rows (at most a row per so many rows of the table), stored; none: None."""
    large = cut_lineage(df.groupBy(*_renamed(by, "_g")).count().where(F.col("count") > CELL_ROWS).drop("count"))
    return None if large.isEmpty() else large


def _bounds(values: DataFrame, by: Sequence[str], large: DataFrame) -> DataFrame:
    """Cuts of the large groups, stored: approximate quantiles depend on the order in which parts
    are merged, so a second computation could give others."""
    rows = values.join(F.broadcast(large), _same(by, "_g")).drop(*by)
    cuts = F.percentile_approx("_x", [i / CELLS for i in range(1, CELLS)], 20 * CELLS)
    return cut_lineage(rows.groupBy(*large.columns).agg(F.array_distinct(cuts).alias("_bounds")))


def _to_cells(values: DataFrame, by: Sequence[str], bounds: DataFrame | None) -> DataFrame:
    """``_cell`` grows with ``_x``: even between two cuts, odd for a value that is a cut; 0 without cuts."""
    if bounds is None:
        return values.withColumn("_cell", F.lit(0))
    out = values.join(F.broadcast(bounds), _same(by, "_g"), "left").withColumn("_k", F.lit(0))
    step = 1 << (CELLS - 1).bit_length() - 1
    while step:  # binary search of the number of cuts below the value
        below = F.get("_bounds", F.col("_k") + (step - 1)) < F.col("_x")
        out = out.withColumn("_k", F.when(below, F.col("_k") + step).otherwise(F.col("_k")))
        step //= 2
    own = (F.get("_bounds", F.col("_k")) == F.col("_x")).cast("int")
    cell = 2 * F.col("_k") + F.coalesce(own, F.lit(0))
    return out.withColumn("_cell", cell).drop("_k", "_bounds", *[f"_g{i}" for i in range(len(by))])


def _with_cells(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Values (``_x``) with a cell number that grows with the value: cells are cut at
    approximate quantiles of the group's values, so they are even whatever the range."""
    large = _large_groups(values, by)
    return _to_cells(values, by, None if large is None else _bounds(values, by, large))


def _offsets(placed: DataFrame, by: Sequence[str], large: DataFrame) -> DataFrame:
    """Rows, rows before and rows in the group of each cell of the large groups, stored."""
    names = large.columns
    cells = placed.join(F.broadcast(large), _same(by, "_g")).where(F.col("_x").isNotNull())
    cells = cells.groupBy(*names, F.col("_cell").alias("_c")).agg(F.count(F.lit(1)).alias("_in_cell"))
    group = Window.partitionBy(*names)
    upto = F.sum("_in_cell").over(group.orderBy("_c").rowsBetween(Window.unboundedPreceding, 0))
    return cut_lineage(cells.select("*", (upto - F.col("_in_cell")).alias("_offset"), F.sum("_in_cell").over(group).alias("_total")))


def _one_value(cell: Column) -> Column:
    return cell % 2 == 1


def _clean(col: str) -> Column:
    c = F.col(col).cast("double")
    return F.when(~F.isnan(c), c + F.lit(0.0))


def _positions(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """(by, value) -> copies, rows before, rows in group; one row per distinct value."""
    values = df.select(*by, _clean(col).alias("_x")).where(F.col("_x").isNotNull())
    values = values.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_copies"))
    values = _with_cells(values, by)
    cells = values.groupBy(*_renamed(by, "_h"), F.col("_cell").alias("_c")).agg(F.sum("_copies").alias("_in_cell"))
    names = [f"_h{i}" for i in range(len(by))]
    run = Window.partitionBy(*names).orderBy("_c")
    cells = cells.select(
        *names, "_c",
        (F.sum("_in_cell").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in_cell")).alias("_offset"),
        F.sum("_in_cell").over(Window.partitionBy(*names)).alias("_total"),
    )
    inside = Window.partitionBy(*by, "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    return (
        values.withColumn("_upto", F.sum("_copies").over(inside))
        .join(cells, _same(by, "_h") & (F.col("_cell") == F.col("_c")))
        .select(*by, "_x", "_copies", "_total",
                (F.col("_offset") + F.col("_upto") - F.col("_copies")).alias("_before"))
    )


def average_ranks(
    df: DataFrame,
    by: Sequence[str],
    cols: dict[str, str],
    group_rows: int | None = None,
    pct: bool = True,
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Add average ranks (ties share their mean rank; null stays null).

    ``cols`` maps output to input column; ``pct`` divides by the non-null count.
    """
    by = list(by)
    if group_rows is None:
        group_rows = widest_group(df, by)
    large = None if group_rows <= limit else _large_groups(df, by)
    if large is None:
        staged = df.withColumns({f"_x_{o}": _clean(c) for o, c in cols.items()})
        out = {}
        for o in cols:
            x = F.col(f"_x_{o}")
            w = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
            upto = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, 0))
            total = F.count(x).over(Window.partitionBy(*by))
            value = (F.rank().over(w) + upto) / F.lit(2.0)
            out[o] = F.when(x.isNotNull(), value / total if pct else value)
        return staged.withColumns(out).drop(*[f"_x_{o}" for o in cols])
    names = large.columns
    for o, c in cols.items():
        rows = df.withColumn("_x", _clean(c))
        rows = _to_cells(rows, by, _bounds(rows.select(*by, "_x"), by, large))
        cells = _offsets(rows.select(*by, "_x", "_cell"), by, large)
        # one value, or none, to a cell: no row of it needs the others, so they are dealt over the input's parts
        x, known = F.col("_x"), _one_value(F.col("_cell")) | F.col("_x").isNull()
        rows = rows.withColumn("_salt", F.when(known, F.spark_partition_id()).otherwise(-1))
        rows = rows.join(F.broadcast(cells), _same(by, "_g") & (F.col("_cell") == F.col("_c")), "left")
        cell = Window.partitionBy(*by, "_cell", "_salt")
        w = cell.orderBy(x.asc_nulls_last())
        upto = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, 0))
        inside = F.when(_one_value(F.col("_cell")), (F.col("_in_cell") + 1) / F.lit(2.0)).otherwise((F.rank().over(w) + upto) / F.lit(2.0))
        value = inside + F.coalesce("_offset", F.lit(0))
        total = F.coalesce("_total", F.count(x).over(cell))  # a group that is not split is one cell
        df = rows.withColumn(o, F.when(x.isNotNull(), value / total if pct else value)).drop("_x", "_cell", "_salt", "_c", "_in_cell", "_offset", "_total", *names)
    return df


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    specs: dict[str, tuple[str, float]],
    group_rows: int | None = None,
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group: ``specs`` maps output -> (col, q).

    Beyond ``limit`` rows per group the cells that hold the two order statistics are found by
    counts, and only their values are sorted, in place of one in-memory histogram per group.
    """
    by = list(by)
    if group_rows is None:
        group_rows = widest_group(df, by)
    large = None if group_rows <= limit else _large_groups(df, by)
    whole = lambda rows: rows.groupBy(*by).agg(
        *[F.expr(f"percentile(`{c}`, {q})").alias(o) for o, (c, q) in specs.items()])
    if large is None:
        return whole(df)
    names, result = large.columns, large
    for n, c in enumerate(sorted({c for c, _ in specs.values()})):
        asked = {o: q for o, (col, q) in specs.items() if col == c}
        at = lambda q: (F.col("_total") - 1) * F.lit(float(q))
        values = df.select(*by, _clean(c).alias("_x")).where(F.col("_x").isNotNull())
        placed = _to_cells(values, by, _bounds(values, by, large))
        holds = lambda k: (F.col("_offset") <= k) & (k < F.col("_offset") + F.col("_in_cell"))
        needed = reduce(lambda a, b: a | b, [holds(end(at(q))) for q in asked.values() for end in (F.floor, F.ceil)])
        cells = _offsets(placed, by, large).where(needed)
        pos = placed.join(F.broadcast(cells), _same(by, "_g") & (F.col("_cell") == F.col("_c")))
        pos = pos.groupBy(*names, "_c", "_offset", "_total", "_x").agg(F.count(F.lit(1)).alias("_copies"))
        inside = Window.partitionBy(*names, "_c").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
        pos = pos.withColumn("_before", F.col("_offset") + F.sum("_copies").over(inside) - F.col("_copies"))
        covers = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_copies"))
        aggs = []
        for o, q in asked.items():
            vlo, vhi = (F.max(F.when(covers(end(at(q))), F.col("_x"))) for end in (F.floor, F.ceil))
            aggs.append((vlo + (vhi - vlo) * F.max(at(q) - F.floor(at(q)))).alias(o))
        part = pos.groupBy(*[F.col(g).alias(f"_q{n}_{i}") for i, g in enumerate(names)]).agg(*aggs)
        result = result.join(part, _same(names, f"_q{n}_"), "left").drop(*[f"_q{n}_{i}" for i in range(len(by))])
    result = result.select(*[F.col(g).alias(c) for g, c in zip(names, by)], *specs)
    return whole(df.join(F.broadcast(large), _same(by, "_g"), "left_anti")).select(*by, *specs).unionAll(result)


def order_statistics(df: DataFrame, by: Sequence[str], specs: dict[str, tuple[str, float]], group_rows: int | None = None, limit: int = WINDOW_ROWS) -> DataFrame:
    """Values by position per group: ``specs`` maps output -> (col, q), the value at place ``min(floor(n * q), n - 1)``
    of the n sorted non-null values; nothing is interpolated. Groups beyond ``limit`` rows are read from the value
    positions, others from one sort per column; no list of a group's values is built."""
    by = list(by)
    if group_rows is None:
        group_rows = widest_group(df, by)
    cols = sorted({c for c, _ in specs.values()})
    place = lambda total, q: F.least(F.floor(total * F.lit(float(q))), total - 1)
    if group_rows <= limit:
        staged = df
        for c in cols:
            w = Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last())
            staged = staged.withColumns({f"_at_{c}": F.row_number().over(w) - 1, f"_n_{c}": F.count(c).over(Window.partitionBy(*by))})
        return staged.groupBy(*by).agg(*[F.max(F.when(F.col(f"_at_{c}") == place(F.col(f"_n_{c}"), q), F.col(c))).alias(o) for o, (c, q) in specs.items()])
    result = df.select(*by).distinct()
    for c in cols:
        covers = lambda q: (F.col("_before") <= place(F.col("_total"), q)) & (place(F.col("_total"), q) < F.col("_before") + F.col("_copies"))
        part = _positions(df, by, c).groupBy(*by).agg(*[F.max(F.when(covers(q), F.col("_x"))).alias(o) for o, (k, q) in specs.items() if k == c])
        result = result.join(part, by, "left")
    return result.select(*by, *specs)


PRE_TRIM_LIMIT = 1000
SALTS = 64


#: Rows of the sample that stand among the first n of a group, and groups whose cuts are sent to the tasks.
CUT_SAMPLE, CUT_GROUPS = 256, 100_000


def threshold_cut(df: DataFrame, by: Sequence[str], value: Column, n: int, key: str, descending: bool = True) -> DataFrame:
    """The rows that can be among the first ``n`` of their group by ``value`` (largest first, or least first), and few
    others: a group is cut at a value that a hash sample of it suggests and a count over all its rows confirms; a
    group where the count is below ``n`` is not cut. Rows of equal value stay together; null values stay where
    they sort first (least first). Nothing of a group moves before the cut but its sample's own first rows."""
    by = list(by)
    v = value.cast("double")
    groups = cut_lineage(df.select(*[F.col(b).alias(f"_{i}") for i, b in enumerate(by)]).distinct())
    if groups.count() > CUT_GROUPS:
        return df
    share = min(1.0, CUT_SAMPLE / n)
    place = int(n * share + 6 * (n * share) ** 0.5 + 8)
    first = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20))).where(v.isNotNull()).select(*by, v.alias("_v"))
    order = F.col("_v").desc() if descending else F.col("_v").asc()
    first = first.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_at") <= place)
    edge = F.min("_v") if descending else F.max("_v")
    cuts = first.groupBy(*by).agg(F.when(F.count(F.lit(1)) == place, edge).alias("_cut")).where("_cut is not null")
    named = [f"_{i}" for i in range(len(by))]
    cuts = cut_lineage(cuts.select(*[F.col(b).alias(x) for b, x in zip(by, named)], "_cut"))
    match = None
    for b, x in zip(by, named):
        same = F.col(b).eqNullSafe(F.col(x))
        match = same if match is None else match & same
    inside = (v >= F.col("_cut")) if descending else (v <= F.col("_cut"))
    counted = df.join(F.broadcast(cuts), match).where(inside).groupBy(*named).agg(F.count(F.lit(1)).alias("_k"), F.max("_cut").alias("_cut")).where(F.col("_k") >= n)
    sure = cut_lineage(counted.select(*named, "_cut"))
    stays = F.col("_cut").isNull() | inside if descending else F.col("_cut").isNull() | inside | v.isNull()
    return df.join(F.broadcast(sure), match, "left").where(stays).drop(*named, "_cut")


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, key: str, out: str = "pick_rank", value: Column | None = None, descending: bool = True) -> DataFrame:
    """First ``n`` rows per group in ``order`` (must be total), numbered from 1.

    Up to 1000 rows Spark trims every partition before the shuffle. For larger cuts whose order starts with a
    number, ``value`` (and ``descending``) lets :func:`threshold_cut` leave little more than ``n`` rows to shuffle;
    without it they first run inside salted sub-groups, so no task sees a whole hot group.
    """
    if n > PRE_TRIM_LIMIT and value is not None:
        df = threshold_cut(df, by, value, n, key, descending)
    elif n > PRE_TRIM_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
        part = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = salted.withColumn("_pos", F.row_number().over(part)).where(F.col("_pos") <= n).drop("_pos", "_salt")
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
