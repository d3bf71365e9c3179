"""Panel sources and sinks: scans, unions, monthly layout, gaps, upserts, calendars, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_blank
from ..operators.windows import latest_per_key, upsert_latest

PANEL_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("ts_code", "trade_date", "name", "industry")]
    + [T.StructField(c, T.DoubleType()) for c in (
        "open", "high", "low", "close", "vol", "amount", "turnover_rate", "volume_ratio", "pe", "pb", "ps", "total_mv", "circ_mv")])


def scan(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; only the named columns leave the files."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


def parse_dates(df: DataFrame, col: str = "trade_date") -> DataFrame:
    """``yyyyMMdd`` or ISO text to a date, once, at ingest; bad dates become null."""
    text = F.regexp_replace(F.col(col).cast("string"), "-", "")
    return df.withColumn(col, F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))


def ingest(df: DataFrame, version: str | None = None) -> DataFrame:
    """Clean panel: NaN to null, rows without key or close dropped, one row per (code, date):
    the newest ``version``, ties (or no version) by the greatest other columns.

    The unique key bounds a series by the trading calendar; the window operators rely on it.
    """
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})
    df = df.dropna(subset=["ts_code", "trade_date", "close"])
    if version is None:
        df, version = df.withColumn("_v", F.lit(0)), "_v"
    return latest_per_key(df, ["ts_code", "trade_date"], version).drop("_v")


def union_common(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union on the common columns; later frames win on equal keys."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    out = None
    for i, f in enumerate(frames):
        part = f.select(*common).withColumn("_version", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return latest_per_key(out, list(keys), "_version", [c for c in common if c not in keys]).drop("_version")


def pick_largest_source(spark: SparkSession, paths: Sequence[str], favourite: str = "all", factor: float = 2.0) -> DataFrame:
    """Source with the largest size (a file or folder); names that contain ``favourite`` count double. Only the
    store's listing is read, so schemas may differ; ties go to the first name."""
    conf, Path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    sizes = [(p, Path(p).getFileSystem(conf).getContentSummary(Path(p)).getLength()) for p in paths]
    files = spark.createDataFrame(sizes, "file_path string, file_size long")
    weight = F.when(F.col("file_path").contains(favourite), F.col("file_size") * factor).otherwise(F.col("file_size") * 1.0)
    return files.withColumn("weight", weight).orderBy(F.col("weight").desc(), "file_path").limit(1)


def write_monthly(df: DataFrame, path: str, day: str = "trade_date") -> None:
    """Partitioned by month; only the months present in ``df`` are replaced."""
    out = df.withColumn("month", F.date_format(day, "yyyyMM"))
    out.repartition("month").sortWithinPartitions("ts_code", day).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Weekdays between two dates."""
    one = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("cal_date"))
    return one.where(F.weekday("cal_date") < 5)


def missing_dates(cal: DataFrame, stored: DataFrame, day: str = "trade_date") -> DataFrame:
    return cal.join(stored.select(F.col(day).alias("cal_date")).distinct(), "cal_date", "left_anti")


def newer_than_stored(fresh: DataFrame, stored: DataFrame, day: str = "trade_date") -> DataFrame:
    """Rows past the stored high-water mark (all rows when nothing is stored)."""
    mark = stored.agg(F.max(day).alias("mark")).scalar()
    return fresh.where(F.coalesce(F.col(day) > mark, F.col(day).isNotNull()))


def merge_snapshot(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("date", "sector_name"), version: str = "version") -> DataFrame:
    return upsert_latest(old, new, list(keys), version)


def span(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(day).alias("start_date"), F.max(day).alias("end_date"))


def last_completed_day(now: Column, close_hour: int = 16) -> Column:
    """Latest weekday whose session is over at ``now`` (a timestamp)."""
    d = F.when(F.hour(now) < close_hour, F.date_sub(F.to_date(now), 1)).otherwise(F.to_date(now))
    back = F.when(F.weekday(d) == 5, 1).when(F.weekday(d) == 6, 2).otherwise(0)
    return F.date_sub(d, back)


def is_fresh(df: DataFrame, day: str, now: Column) -> DataFrame:
    return df.agg(F.max(day).alias("end_date")).withColumn("fresh", F.col("end_date") >= last_completed_day(now))


# Accepted number of codes of each pool on its newest date.
POOL_BOUNDS = {"csi1000": (None, 1500), "csi2000": (None, 2600), "all": (2800, None)}


def quality_issues(df: DataFrame, pool: str | None = None) -> DataFrame:
    """Issues of the newest section: code count, name equal to code, missing industries."""
    from ..operators.factors import latest_section

    snap = latest_section(df, df.select("trade_date"))
    head = F.split_part("ts_code", F.lit("."), F.lit(1))
    same = (F.trim(F.coalesce("name", F.lit(""))) == F.col("ts_code")) | (F.trim(F.coalesce("name", F.lit(""))) == head)
    a = snap.agg(F.count_distinct("ts_code").alias("codes"), F.avg(same.cast("double")).alias("same"),
                 F.avg(is_blank("industry", unknown_too=True).cast("double")).alias("bad"))
    lo, hi = POOL_BOUNDS.get(pool or "", (None, None))
    rules = [F.when(F.col("codes") == 0, "empty"), F.when(F.col("same") > 0.05, "name_equals_code"), F.when(F.col("bad") > 0.20, "industry_missing")]
    if lo:
        rules.append(F.when(F.col("codes") < lo, "too_few_codes"))
    if hi:
        rules.append(F.when(F.col("codes") > hi, "too_many_codes"))
    return a.select("codes", F.round("same", 6).alias("name_equals_code"), F.round("bad", 6).alias("industry_missing"), F.array_compact(F.array(*rules)).alias("issues"))


def set_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only; empty means equal sets."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(True))
    a = actual.select(key).distinct().withColumn("_a", F.lit(True))
    j = e.join(a, key, "full_outer").where(F.col("_e").isNull() | F.col("_a").isNull())
    return j.select(key, F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("side"))


def profile_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of non-zero and of null values per column in one pass."""
    aggs = []
    for c in cols:
        aggs += [F.avg((F.coalesce(F.abs(c), F.lit(0.0)) > 0).cast("double")).alias(f"z_{c}"), F.avg(F.col(c).isNull().cast("double")).alias(f"n_{c}")]
    row = df.agg(*aggs)
    packed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"z_{c}").alias("nonzero_rate"), F.col(f"n_{c}").alias("null_rate")) for c in cols])
    return row.select(F.explode(packed).alias("p")).select("p.*")


def shift_days(days: DataFrame, cal: DataFrame, n: int, day: str = "day") -> DataFrame:
    """The n-th next (n > 0) or previous (n < 0) trading day of each date.

    Every calendar day knows the rank of the trading day at or before it; the target is an
    equi-join on rank + n. Days outside the calendar count from its ends; no day is lost.
    """
    from pyspark.sql import Window

    one = Window.partitionBy(F.lit(1)).orderBy("cal_date")
    ranked = cal.select("cal_date", F.row_number().over(one).alias("rk"), F.lead("cal_date").over(one).alias("_nx"))
    stretch = ranked.withColumn("_d", F.explode(F.sequence("cal_date", F.coalesce(F.date_sub("_nx", 1), F.date_add("cal_date", 10)))))
    base = stretch.select(F.col("_d").alias(day), (F.col("_d") == F.col("cal_date")).alias("_open"), "rk")
    goal = ranked.select(F.col("rk").alias("_goal"), F.col("cal_date").alias("target"))
    edge = ranked.agg(F.struct(F.min("cal_date").alias("first"), F.max("rk").alias("last")).alias("edge")).scalar()
    j = days.join(base, day, "left").withColumn("_edge", edge)
    outside = F.when(F.col(day) < F.col("_edge.first"), 0).when(F.col(day).isNotNull(), F.col("_edge.last"))
    j = j.withColumns({"rk": F.coalesce("rk", outside), "_open": F.coalesce("_open", F.lit(False))})
    step = F.when(~F.col("_open") & (F.lit(n) < 0), n + 1).otherwise(n)
    return j.withColumn("_goal", F.col("rk") + step).join(goal, "_goal", "left").select(*days.columns, "target")


def latest_valid_date(counts: DataFrame, anchor: Column, look_back: int = 30, day: str = "trade_date") -> DataFrame:
    ok = (F.col("rows") > 0) & (F.col(day) <= anchor) & (F.col(day) >= F.date_sub(anchor, look_back))
    return counts.where(ok).agg(F.max(day).alias("valid_date"))


def back_fill_plan(cal: DataFrame, stored: DataFrame, limit: int, day: str = "trade_date") -> DataFrame:
    """Newest ``limit`` calendar dates that are not stored yet."""
    return missing_dates(cal, stored, day).orderBy(F.col("cal_date").desc()).limit(limit)


def back_fill(source: DataFrame, cal: DataFrame, stored: DataFrame, limit: int, day: str = "trade_date") -> DataFrame:
    plan = back_fill_plan(cal, stored, limit, day).withColumnRenamed("cal_date", day)
    return source.join(F.broadcast(plan), day, "left_semi")


def exposures_wide(df: DataFrame, cols: Sequence[str], dates: Sequence[str], day: str = "trade_date") -> DataFrame:
    """symbol x factor_date columns for a known, short list of dates."""
    named = df.withColumn("_d", F.date_format(day, "yyyyMMdd"))
    return named.groupBy("ts_code").pivot("_d", list(dates)).agg(*[F.max(c).alias(c) for c in cols])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def status_counts(tables: dict[str, DataFrame], status_of: str, status: str = "status") -> DataFrame:
    """Rows per table and per status of one table."""
    out = tables[status_of].groupBy(F.col(status).alias("item")).count().withColumn("kind", F.lit("status"))
    for name, t in tables.items():
        out = out.unionByName(t.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("item"), "count", F.lit("table").alias("kind")))
    return out.select("kind", "item", "count")


def import_legacy(legacy: DataFrame, parents: DataFrame, stored: DataFrame, natural: Sequence[str], parent_key: str, json_cols: Sequence[str] = ()) -> DataFrame:
    """Rows of an old store with remapped parent ids and parsed JSON lists, absent ones only.

    parents: (old_id, new_id). JSON text that does not parse becomes an empty list.
    """
    j = legacy.join(parents.select(F.col("old_id").alias(parent_key), "new_id"), parent_key).drop(parent_key).withColumnRenamed("new_id", parent_key)
    empty = F.array().cast("array<string>")
    j = j.withColumns({c: F.coalesce(F.from_json(c, "array<string>"), empty) for c in json_cols})
    return j.join(stored.select(*natural).distinct(), list(natural), "left_anti")


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """JDBC read, split by key range when bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def tolerant_json(col: str, schema: str) -> Column:
    """Parse the outermost ``{...}`` of a text; null when there is none."""
    return F.from_json(F.nullif(F.regexp_extract(col, r"(?s)\{.*\}", 0), F.lit("")), schema)
