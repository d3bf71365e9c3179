"""Compaction of an upsert log into levels of key-ranged runs with a manifest.

A log is a folder of batches as ``jobs.upsert_log`` writes them. Compaction merges batches that are
not absorbed yet with the runs of the next level whose key bounds they touch, keeps the newest row
per key and writes runs of disjoint bounds; a level that has grown beyond its share is merged into
the next one the same way. A manifest names the live runs with their bounds and the batches they
absorb, and is replaced in one step, so readers see the state before or after, and a lost
compaction leaves only files that no manifest names. Bounds are those of the first key column.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import latest_per_key

#: Batches that start a merge, growth from a level to the next, rows of a run.
FAN, RUN_ROWS = 4, 2_000_000


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    at, fs = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest: ``version``, ``absorbed`` (last batch inside runs), ``runs`` (folder, level, low, high, rows)."""
    versions = sorted(int(n[1:-5]) for n in _names(spark, f"{path}/_manifest") if n.startswith("v") and n.endswith(".json"))
    if not versions:
        return {"version": 0, "absorbed": -1, "runs": []}
    rows = spark.read.text(f"{path}/_manifest/v{versions[-1]}.json", wholetext=True).first()
    return json.loads(rows["value"])


def _publish(spark: SparkSession, path: str, new: dict) -> None:
    at, fs = _folder(spark, f"{path}/_manifest/tmp-{uuid.uuid4().hex}")
    out = fs.create(at)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if not fs.rename(at, _folder(spark, f"{path}/_manifest/v{new['version']}.json")[0]):
        raise RuntimeError("another compaction published this version")


def batches(spark: SparkSession, path: str) -> list[int]:
    """Ids of the batches in the log."""
    return sorted(int(n.split("=")[1]) for n in _names(spark, path) if n.startswith("batch="))


def _newest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c != order]
    return latest_per_key(rows, list(keys), order, ["batch", *(c for c in rest if c != "batch")])


def _touches(run: dict, low, high) -> bool:
    return not (low is not None and run["high"] < low or high is not None and run["low"] > high)


def _read(spark: SparkSession, path: str, ids: Sequence[int], runs: Sequence[dict]) -> DataFrame | None:
    parts = []
    if ids:
        parts.append(spark.read.option("basePath", path).parquet(*(f"{path}/batch={i}" for i in ids)).withColumn("batch", F.col("batch").cast("long")))
    if runs:
        parts.append(spark.read.parquet(*(f"{path}/{r['folder']}" for r in runs)))
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None


def _as_bound(value):
    return value if isinstance(value, (int, float, str, bool)) or value is None else str(value)


def _merge(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], order: str, level: int, run_rows: int) -> list[dict]:
    """Runs of disjoint bounds with the newest row per key."""
    merged, folder = _newest(rows, keys, order), f"_runs/{uuid.uuid4().hex}"
    count = max(1, -(-merged.count() // run_rows))
    ranged = merged.repartitionByRange(count, keys[0]).withColumn("_run", F.spark_partition_id()).sortWithinPartitions(*keys)
    ranged.write.partitionBy("_run").parquet(f"{path}/{folder}")
    stored = spark.read.parquet(f"{path}/{folder}").groupBy("_run").agg(F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high"), F.count(F.lit(1)).alias("rows"))
    return [{"folder": f"{folder}/_run={r['_run']}", "level": level, "low": _as_bound(r["low"]), "high": _as_bound(r["high"]), "rows": r["rows"]} for r in stored.collect()]  # a row per run


def compact(spark: SparkSession, path: str, keys: Sequence[str], order: str, *, fan: int = FAN, run_rows: int = RUN_ROWS) -> dict:
    """Merge the log where ``fan`` batches wait, and levels that hold more than ``fan`` times the runs of the level
    above; the new manifest (the old one, if there is nothing to do). The first key is a number or a string, and null
    keys are not allowed. One compaction of a log runs at a time."""
    old = manifest(spark, path)
    waiting = [b for b in batches(spark, path) if b > old["absorbed"]]
    if len(waiting) < fan:
        return old
    runs, level, ids, source = list(old["runs"]), 1, waiting, []
    while True:
        rows = _read(spark, path, ids, source)
        bounds = rows.agg(F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high")).first()
        low, high = _as_bound(bounds["low"]), _as_bound(bounds["high"])
        touched = [r for r in runs if r["level"] == level and _touches(r, low, high)]
        new = _merge(spark, path, _read(spark, path, ids, source + touched), keys, order, level, run_rows)
        runs = [r for r in runs if r not in source and r not in touched] + new
        full = [r for r in runs if r["level"] == level]
        if sum(r["rows"] for r in full) <= run_rows * fan ** level:
            break
        level, ids, source = level + 1, [], full
    published = {"version": old["version"] + 1, "absorbed": waiting[-1], "runs": runs}
    _publish(spark, path, published)
    return published


def read(spark: SparkSession, path: str, keys: Sequence[str], order: str, low=None, high=None) -> DataFrame:
    """Newest row per key; with bounds on the first key only runs that can hold it are opened."""
    now = manifest(spark, path)
    rows = _read(spark, path, [b for b in batches(spark, path) if b > now["absorbed"]], [r for r in now["runs"] if _touches(r, low, high)])
    if rows is None:  # every run is out of bounds
        rows = _read(spark, path, [], now["runs"][:1]).limit(0)
    if low is not None:
        rows = rows.where(F.col(keys[0]) >= F.lit(low))
    if high is not None:
        rows = rows.where(F.col(keys[0]) <= F.lit(high))
    return _newest(rows, keys, order).drop("batch")


def clear_old(spark: SparkSession, path: str) -> int:
    """Delete absorbed batches and runs that the newest manifest does not name, when no reader holds an older one;
    the number of folders deleted. A batch that is replayed later stays absorbed."""
    now, gone = manifest(spark, path), []
    gone += [f"batch={b}" for b in batches(spark, path) if b <= now["absorbed"]]
    live = {r["folder"] for r in now["runs"]}
    for folder in _names(spark, f"{path}/_runs"):
        gone += [f"_runs/{folder}/{n}" for n in _names(spark, f"{path}/_runs/{folder}") if n.startswith("_run=") and f"_runs/{folder}/{n}" not in live]
    for name in gone:
        at, fs = _folder(spark, f"{path}/{name}")
        fs.delete(at, True)
    return len(gone)
