"""Counting tables of a fixed number of slots over all rows, summed across tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least and most slots of a table (powers of two) and slots of one of its blocks.
LEAST_SLOTS, MOST_SLOTS, BLOCK = 1 << 18, 1 << 26, 1 << 18
#: Tables that are summed in one go; more are summed in levels.
FAN = 64
SCHEMA = "part int, block int, counts binary"


def slots_for(tokens: int) -> int:
    """About a slot per sixteen tokens, within the bounds."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << max(0, (tokens // 16).bit_length())))


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)


def block_rows(table: np.ndarray) -> pa.RecordBatch:
    """One task's table as rows of (task, block, counts up to 255), empty blocks left out."""
    parts = table.reshape(-1, BLOCK)
    used = [i for i, p in enumerate(parts) if p.any()]
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([task] * len(used), pa.int32()), pa.array(used, pa.int32()),
                                       pa.array([_packed(parts[i]) for i in used], pa.binary())], ["part", "block", "counts"])


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, dtype=np.uint32)
    for data in pdf["counts"]:
        total += np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "block": pdf["block"].iloc[:1], "counts": [_packed(total)]})


def summed(blocks: DataFrame, slots: int, tasks: int) -> np.ndarray:
    """The table summed over all tasks, counts up to 255. What reaches the driver is a byte per slot."""
    while True:
        tasks = -(-tasks // FAN)
        blocks = blocks.withColumn("part", F.col("part") % max(tasks, 1)).groupBy("part", "block").applyInPandas(_sum, SCHEMA)
        if tasks <= 1:
            break
    out = np.zeros(slots, dtype=np.uint8)
    for row in blocks.collect():
        out[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(zstandard.decompress(row["counts"]), dtype=np.uint8)
    return out
