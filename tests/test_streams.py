"""Ordered state over micro-batches, and compaction of the upsert log."""

import datetime as dt
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.streaming import jobs, levels, ordered

T0 = dt.datetime(2024, 1, 1)


def files(spark, folder, rows, schema, batches):
    """One file, and so one micro-batch, per part, in order."""
    for i, part in enumerate(batches):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.parquet(f"{folder}/p{i}")
        src = next(p for p in (folder / f"p{i}").iterdir() if p.suffix == ".parquet")
        (folder / "in").mkdir(exist_ok=True)
        src.rename(folder / "in" / f"f{i:02d}.parquet")


def drained(stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out"), q


@pytest.mark.parametrize("kind", ["peaks", "ics"])
def test_order_of_arrival_does_not_matter(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    rows = [(f"c{i % 3}", T0 + dt.timedelta(minutes=i), float(rng.uniform(5, 20))) for i in range(120)]
    rows += [("c0", None, 1.0), (None, T0, 1.0), ("c1", T0, None)]
    end = [("c9", T0 + dt.timedelta(days=3000 + i), 1.0) for i in range(3)]  # time goes on: all is due, then all has expired
    name, value = ("code", "close") if kind == "peaks" else ("factor", "ic")
    schema = f"{name} string, ts timestamp, {value} double"
    shuffled = rng.permutation(len(rows)).tolist()
    found = {}
    for label, parts in {"one": [list(range(len(rows)))], "many": [shuffled[:50], shuffled[50:90], shuffled[90:]]}.items():
        folder = tmp_path / label
        folder.mkdir()
        every = rows + end
        files(spark, folder, every, schema, [*parts, *([len(rows) + i] for i in range(3))])
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        job = (jobs.trailing_peaks if kind == "peaks" else jobs.ic_monitor)(stream, late="1 day", idle_days=30)
        out, q = drained(job, folder)
        found[label] = sorted(map(str, out.where(f"{name} <> 'c9'").collect()))
        if label == "many":
            state = q.recentProgress[-1].stateOperators[0]
            assert state.numRowsTotal <= 3  # what is left belongs to the last rows of c9
    assert len(found["one"]) == 120 and found["one"] == found["many"]


def log(spark, folder, batches):
    keys = ["k", "part"]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k long, part string, v double, ts long").withColumn("batch", F.lit(i)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)
    return keys


def test_compaction_keeps_the_newest_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    made = [[(int(rng.integers(0, 100)) + 100 * (i % 2), "ab"[int(rng.integers(2))], float(rng.normal()), 1000 * i + j) for j in range(60)] for i in range(9)]
    made = [list({(r[0], r[1]): r for r in rows}.values()) for rows in made]
    want = {}
    for rows in made:
        want |= {(r[0], r[1]): r[2] for r in rows}
    keys = log(spark, folder, made[:5])
    assert levels.compact(spark, folder, keys, "ts", fan=6, run_rows=40)["version"] == 0  # too few batches wait
    first = levels.compact(spark, folder, keys, "ts", fan=4, run_rows=40)
    assert first["version"] == 1 and first["absorbed"] == 4 and len(first["runs"]) > 3
    bounds = sorted((r["level"], r["low"], r["high"]) for r in first["runs"])
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(bounds, bounds[1:]))  # disjoint in a level
    for i, rows in enumerate(made[5:], 5):
        spark.createDataFrame(rows, "k long, part string, v double, ts long").withColumn("batch", F.lit(i)).write.mode("append").partitionBy("batch").parquet(folder)
    before = len(levels.read(spark, folder, keys, "ts").inputFiles())
    second = levels.compact(spark, folder, keys, "ts", fan=4, run_rows=40)
    assert second["version"] == 2 and second["absorbed"] == 8
    got = {(r.k, r.part): r.v for r in levels.read(spark, folder, keys, "ts").collect()}
    assert got == want
    part = levels.read(spark, folder, keys, "ts", low=150, high=160)
    assert {(r.k, r.part): r.v for r in part.collect()} == {k: v for k, v in want.items() if 150 <= k[0] <= 160}
    assert len(part.inputFiles()) < len(levels.read(spark, folder, keys, "ts").inputFiles()) and before > 0
    assert levels.read(spark, folder, keys, "ts", low=900).count() == 0
    # A replayed batch that is absorbed already changes nothing, nor does clearing what is no longer named.
    spark.createDataFrame(made[3], "k long, part string, v double, ts long").withColumn("batch", F.lit(3)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)
    assert {(r.k, r.part): r.v for r in levels.read(spark, folder, keys, "ts").collect()} == want
    assert levels.clear_old(spark, folder) > 0
    assert {(r.k, r.part): r.v for r in levels.read(spark, folder, keys, "ts").collect()} == want
    spread = levels.manifest(spark, folder)["runs"]
    assert max(r["level"] for r in spread) >= 2 or sum(r["rows"] for r in spread) <= 160


def test_waiting_rows_are_packed_and_leave_in_pieces(monkeypatch):
    """A key's waiting rows are numbers in bytes, not Python objects, and its output comes in frames of bounded size."""
    monkeypatch.setattr(ordered, "PIECE_ROWS", 7)

    class List:
        def __init__(self):
            self.rows = []

        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)
        appendList = lambda self, rows: self.rows.extend(rows)
        put = lambda self, rows: self.rows.__init__(rows)
        clear = lambda self: self.rows.clear()

    class Value(List):
        get = lambda self: self.rows[0]
        update = lambda self, row: self.put([row])

    class Handle:
        getListState = lambda self, *a: List()
        getValueState = lambda self, *a: Value()
        registerTimer = lambda self, ms: None

    class Time:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    at = np.random.default_rng(4).permutation(100)
    job = ordered.TrailingPeaks(10**9, 0.12, 1.05)
    job.init(Handle())
    list(job.handleInputRows(("k",), iter([pd.DataFrame({"at": at[i:i + 30] * 1000, "value": at[i:i + 30] + 1.0}) for i in (0, 30, 60, 90)]), Time(0)))
    assert all(isinstance(r[0], bytes) and len(r[0]) <= 7 * 16 for r in job.held.rows)
    early, late = list(job.handleExpiredTimer(("k",), Time(49), None)), list(job.handleExpiredTimer(("k",), Time(99), None))
    assert max(map(len, early + late)) <= 7 and sum(map(len, early)) == 50
    out = pd.concat(early + late)
    assert out["at"].tolist() == [1000 * i for i in range(100)] and out["peak"].tolist() == [i + 1.0 for i in range(100)]
    assert not job.held.rows
