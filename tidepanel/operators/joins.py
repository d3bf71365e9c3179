"""Enrichment joins: dimensions, membership flags, month snapshots, fallbacks, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bare_code, is_blank
from ..session import cut_lineage
from .windows import latest_per_key


def merge_keyed(daily: DataFrame, basic: DataFrame, info: DataFrame, keys=("ts_code", "trade_date")) -> DataFrame:
    """Inner join on both keys, left join of static fields, rows with null keys dropped."""
    return daily.join(basic, list(keys)).join(info, keys[0], "left").dropna(subset=list(keys))


def attach_snapshot(daily: DataFrame, snap: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Dimension by code for all rows (constant over history, as the snapshot is)."""
    return daily.drop(*[c for c in cols if c in daily.columns]).join(snap.select("ts_code", *cols), "ts_code", "left")


def month_snapshot(daily: DataFrame, basic: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Daily rows take the first snapshot of their month."""
    m = F.trunc("trade_date", "month")
    first = basic.withColumn("_m", m).groupBy("ts_code", "_m").agg(F.min_by(F.struct(*cols), "trade_date").alias("_s"))
    j = daily.withColumn("_m", m).join(first, ["ts_code", "_m"], "left")
    return j.select(*daily.columns, *[F.col(f"_s.{c}").alias(c) for c in cols])


def membership_flag(df: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    m = members.select(key).distinct().withColumn(out, F.lit(1.0))
    return df.join(m, key, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def candidates_history(df: DataFrame, snap: DataFrame, score: str, n: int) -> DataFrame:
    """Full history of the n best codes of the newest section."""
    best = snap.orderBy(F.col(score).desc(), "ts_code").limit(n).select("ts_code")
    return df.join(F.broadcast(best) if n <= 10_000 else best, "ts_code", "left_semi")


def skip_existing(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Drop rows whose (source, external_id) or (source, title, report_date) is stored."""
    a = fresh.join(stored.select("source", "external_id").distinct(), ["source", "external_id"], "left_anti")
    b = a.join(stored.select("source", "title", "report_date").distinct(), ["source", "title", "report_date"], "left_anti")
    return b.where(F.coalesce("title", F.lit("")) != "")


def map_back(df: DataFrame, snap: DataFrame, col: str, default: float) -> DataFrame:
    """Value of the newest section on every row of its code."""
    j = df.join(snap.select("ts_code", F.col(col).alias("_v")), "ts_code", "left")
    return j.withColumn(col, F.coalesce("_v", F.lit(default))).drop("_v")


def fill_basic(df: DataFrame, info: DataFrame) -> DataFrame:
    """Fill blank industries and names (or names equal to the code) from the dimension."""
    i = info.select("ts_code", F.col("name").alias("_n"), F.col("industry").alias("_i"))
    j = df.join(i, "ts_code", "left")
    bad_name = is_blank("name") | (F.trim("name") == F.col("ts_code")) | (F.trim("name") == F.split_part("ts_code", F.lit("."), F.lit(1)))
    return j.withColumns({
        "name": F.when(bad_name & ~is_blank("_n"), F.col("_n")).otherwise(F.col("name")),
        "industry": F.when(is_blank("industry", True) & ~is_blank("_i"), F.col("_i")).otherwise(F.col("industry"))}).drop("_n", "_i")


def fill_limit_pool(df: DataFrame, pool: DataFrame, numeric: Sequence[str], text: Sequence[str], on=("ts_code", "trade_date")) -> DataFrame:
    """Pool fields where the base is null or zero (numbers) or blank (texts)."""
    one = latest_per_key(pool.select(*on, *numeric, *text, F.lit(0).alias("_v")), list(on), "_v", [*numeric, *text]).drop("_v")
    one = one.select(*on, *[F.col(c).alias(f"_p_{c}") for c in (*numeric, *text)])
    j = df.join(one, list(on), "left")
    out = {}
    for c in numeric:
        base = F.nullif(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(None).cast("double")
        out[c] = F.coalesce(base, F.col(f"_p_{c}"), F.col(c) if c in df.columns else F.lit(None).cast("double"))
    for c in text:
        base = F.when(~is_blank(c), F.col(c)) if c in df.columns else F.lit(None).cast("string")
        out[c] = F.coalesce(base, F.col(f"_p_{c}"))
    return j.withColumns(out).drop(*[f"_p_{c}" for c in (*numeric, *text)])


def sentinel_valuation(df: DataFrame, cols: Sequence[str] = ("pe", "pb"), sentinel: float = 999.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(sentinel)) for c in cols})


def estimate_missing(df: DataFrame) -> DataFrame:
    """Turnover and market value estimates, only where the whole column is empty."""
    void = lambda c: (F.coalesce(F.max(F.abs(c)), F.lit(0.0)) == 0).alias(c)
    empty = df.agg(F.struct(void("turnover_rate"), void("total_mv")).alias("empty"))
    j = df.withColumn("_e", empty.scalar())
    turn = F.try_divide(F.col("vol"), F.col("circ_mv") * 1e4)
    j = j.withColumn("turnover_rate", F.when(F.col("_e.turnover_rate"), turn).otherwise(F.col("turnover_rate")))
    mv = F.try_divide(F.col("close") * F.col("vol"), F.nullif("turnover_rate", F.lit(0.0)))
    return j.withColumn("total_mv", F.when(F.col("_e.total_mv"), mv).otherwise(F.col("total_mv"))).drop("_e")


def _grams(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: text.substr(i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


#: Characters of the longest piece by which names and texts meet.
PIECE = 8


def contained_pairs(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """Every pair (``text``, ``name``) of distinct values where the text contains the name.

    A posting join: a name of up to ``PIECE`` characters meets the texts that hold it, so nothing else is paired; a
    longer one meets those that hold the rarest of its pieces of so many characters, counted over the texts, and is
    then compared. A name with a piece that no text holds meets none; an empty name is its own piece, in every text.
    Neither side is gathered in one row or sent whole to the tasks.
    """
    held = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    asked = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    sizes = [r[0] for r in asked.select(F.least(F.length("name"), F.lit(PIECE))).distinct().collect()] or [0]  # PIECE + 1 rows at most
    postings = held.select("text", F.explode(F.concat(*[_grams(F.col("text"), size) if size else F.array(F.lit("")) for size in sizes])).alias("piece"))
    pairs = asked.where(F.length("name") <= PIECE).join(postings, F.col("name") == F.col("piece")).select("text", "name")
    if PIECE not in sizes:
        return pairs
    postings = postings.where(F.length("piece") == PIECE)
    found = postings.groupBy("piece").agg(F.count(F.lit(1)).alias("texts"))
    pieces = asked.where(F.length("name") > PIECE).select("name", F.explode(_grams(F.col("name"), PIECE)).alias("piece")).join(found, "piece", "left")
    rarest = pieces.groupBy("name").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "piece")).alias("p")).where("p.texts > 0")
    longer = rarest.select("name", F.col("p.piece").alias("piece")).join(postings, "piece").where(F.col("text").contains(F.col("name")))
    return pairs.unionAll(longer.select("text", "name"))


def alias_match(df: DataFrame, col: str, aliases: DataFrame, out: str) -> DataFrame:
    """Alias table lookup: exact first, else the first alias contained, else the text itself.

    aliases: (alias, target, prio); the first one has the least prio, then the least alias and target.
    """
    t = F.trim(F.col(col))
    first = F.min(F.struct("prio", "alias", "target"))
    # The first row of every alias, stored: a text then meets an alias once, however many rows the alias has.
    aliases = cut_lineage(aliases.groupBy("alias").agg(first.alias("_a")).select("_a.*"))
    exact = aliases.groupBy(F.trim("alias").alias("_k")).agg(first["target"].alias("_exact"))
    keys = df.select(t.alias("_k")).distinct()
    pairs = contained_pairs(keys, "_k", aliases, "alias").withColumnsRenamed({"text": "_k", "name": "alias"})
    part = pairs.join(aliases, "alias").groupBy("_k").agg(first["target"].alias("_part"))
    j = df.withColumn("_k", t).join(exact, "_k", "left").join(part, "_k", "left")
    return j.withColumn(out, F.coalesce("_exact", "_part", "_k")).drop("_k", "_exact", "_part")


def first_names(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """``text`` and ``hit``: the first name (sorted) that contains the text or is contained in it, where there is one."""
    inside = contained_pairs(texts, text, names, name)
    around = contained_pairs(names, name, texts, text).select(F.col("name").alias("text"), F.col("text").alias("name"))
    return inside.unionAll(around).groupBy("text").agg(F.min("name").alias("hit"))


def fuzzy_match(df: DataFrame, col: str, names: DataFrame, name: str, out: str) -> DataFrame:
    """First name (sorted) that contains the text or is contained in it."""
    hits = first_names(df, col, names, name).select(F.col("text").alias("_k"), F.col("hit").alias("_hit"))
    return df.join(hits, F.col(col) == F.col("_k"), "left").withColumn(out, F.col("_hit")).drop("_k", "_hit")


def merge_rankings(today: DataFrame, five: DataFrame, ten: DataFrame, key: str) -> DataFrame:
    """Five- and ten-period rankings outer-joined, then attached to today's rows."""
    return today.join(five.join(ten, key, "full_outer"), key, "left")


def attach_flow(df: DataFrame, flow: DataFrame) -> DataFrame:
    j = df.join(flow.select("date", "sector_name", F.col("main_force_net").alias("_f")), ["date", "sector_name"], "left")
    return j.withColumn("main_force_net", F.coalesce("_f", F.lit(0.0))).drop("_f")


def close_map(primary: DataFrame, fallback: DataFrame, least: int = 10) -> DataFrame:
    """Closes of the primary source; codes with fewer than ``least`` bars add the fallback,
    which wins on equal dates."""
    n = primary.groupBy("ts_code").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("ts_code")
    extra = fallback.join(n, "ts_code", "left_anti").select("ts_code", "trade_date", "close", F.lit(1).alias("_v"))
    both = primary.select("ts_code", "trade_date", "close", F.lit(0).alias("_v")).unionByName(extra)
    return latest_per_key(both, ["ts_code", "trade_date"], "_v", ["close"]).drop("_v")


def latest_price(prices: DataFrame, fallback: DataFrame) -> DataFrame:
    """Newest close per code, else the last recorded pick price."""
    p = prices.groupBy(bare_code("ts_code").alias("code")).agg(F.max_by("close", "trade_date").alias("_p"))
    f = fallback.groupBy("code").agg(F.max_by("price_at_pick", "pick_date").alias("_f"))
    return p.join(f, "code", "full_outer").select("code", F.coalesce("_p", "_f").alias("price"))


def snapshot_change(prices: DataFrame, back: int = 20) -> DataFrame:
    """Change of the newest close against the previous and the ``back``-th bar (clamped)."""
    w = Window.partitionBy("ts_code").orderBy(F.col("trade_date").desc())
    d = prices.select("ts_code", "trade_date", "close").withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= back + 1)
    at = lambda k: F.max(F.when(F.col("_b") == k, F.col("close")))
    a = d.groupBy("ts_code").agg(at(1).alias("last"), at(2).alias("_p"), at(back + 1).alias("_k"), F.max_by("close", "_b").alias("_o"))
    pct = lambda base: F.round((F.try_divide(F.col("last"), base) - 1) * 100, 2)
    return a.select("ts_code", "last", pct(F.coalesce("_p", "_o")).alias("chg_1d"), pct(F.coalesce("_k", "_o")).alias(f"chg_{back}d"))


def best_constituents(files: DataFrame, least: int) -> DataFrame:
    """Codes of the newest snapshot that has at least ``least`` distinct codes."""
    ok = files.groupBy("snapshot").agg(F.count_distinct("con_code").alias("_n")).where(F.col("_n") >= least).agg(F.max("snapshot").alias("newest"))
    return files.where(F.col("snapshot") == ok.scalar()).select("snapshot", "con_code").distinct()


def as_of_slice(df: DataFrame, as_of: Column, last: int, key: str = "ts_code", day: str = "trade_date") -> DataFrame:
    """Rows up to a date, the last n per key: nothing later can be seen."""
    w = Window.partitionBy(key).orderBy(F.col(day).desc())
    return df.where(F.col(day) <= as_of).withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= last).drop("_b")


def latest_or_last(df: DataFrame, least: int) -> DataFrame:
    """Newest section when large enough, else the newest row of every code."""
    sizes = df.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    newest = sizes.agg(F.max(F.struct("trade_date", "n")).alias("newest"))
    last = latest_per_key(df, ["ts_code"], "trade_date").withColumn("_s", newest.scalar())
    return last.where((F.col("_s.n") < least) | (F.col("trade_date") == F.col("_s.trade_date"))).select(*df.columns)


def ends(df: DataFrame, col: str, key: str, head: int, tail: int) -> DataFrame:
    """Largest ``head`` rows and smallest ``tail`` rows by one column, each row once."""
    first = df.orderBy(F.col(col).desc(), key).limit(head).withColumn("side", F.lit("head"))
    last = df.orderBy(F.col(col).asc(), key).limit(tail).withColumn("side", F.lit("tail"))
    return first.unionByName(last.join(F.broadcast(first.select(key)), key, "left_anti"))
