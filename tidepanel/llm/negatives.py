"""Hard negatives of anchor stocks by rotated one-bit codes with exact intervals.

Every vector is rotated and kept as the signs of its components with its alignment, the inner
product with that code; what the code leaves over is coded again after a further rotation, a few
times, and the length of the last rest is stored. An anchor's components are cut into bit planes,
so an inner product is estimated by popcounts; by Cauchy and Schwarz the truth lies within the
length of the rest times what the anchor has outside the code, plus the rounding of the planes.
These intervals are certain: a pair is left out only where its upper end is below what others
surely reach, and the surviving pairs are scored as integers.

A stated set of anchors meets all rows in blocks: one task compares a block of rows with a group
of anchors. What a block holds of a label or an industry doesn't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .vectors import bucket, exact_products, taking_part

#: Codes of a vector, bit planes of an anchor.
LAYERS, PLANES = 4, 6
#: Rows of a block and anchors of a group, at most; rows and anchors whose intervals are held at once.
BLOCK_ROWS, GROUP_ANCHORS, HELD_ROWS, HELD_ANCHORS = 16_384, 2048, 4096, 128
#: Blocks of small tables hold so many rows, so that several tasks share them.
LEAST_ROWS = 1024
#: Rounding of the intervals, of the product of both lengths.
SLACK = 1e-9


def rotations(size: int) -> list[np.ndarray]:
    """Fixed random rotations, one per layer."""
    rng = np.random.default_rng(29)
    return [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(LAYERS)]


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint64)


def encode(x: np.ndarray, turns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (layer, row, word), alignments (layer, row) and lengths of the rests (row)."""
    codes, aligned, root = [], [], np.sqrt(x.shape[1])
    for turn in turns:
        x = x @ turn
        ones = x >= 0
        along = np.abs(x).sum(axis=1) / root
        x = x - (along / root)[:, None] * np.where(ones, 1.0, -1.0)
        codes.append(_words(ones))
        aligned.append(along)
    return np.array(codes), np.array(aligned), np.linalg.norm(x, axis=1)


class AnchorPlanes:
    """Bit planes of anchors under every rotation."""

    def __init__(self, q: np.ndarray, turns: list[np.ndarray]):
        self.length, self.root, self.layers = np.linalg.norm(q, axis=1), np.sqrt(q.shape[1]), []
        for turn in turns:
            q = q @ turn
            low = q.min(axis=1)
            step = np.maximum((q.max(axis=1) - low) / (2 ** PLANES - 1), 1e-300)
            level = np.rint((q - low[:, None]) / step[:, None]).astype(np.int64)
            kept = low[:, None] + step[:, None] * level
            self.layers.append((low, step, [_words((level >> p) & 1 == 1) for p in range(PLANES)], kept.sum(axis=1), np.linalg.norm(q - kept, axis=1)))

    def intervals(self, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of all inner products (anchor, row)."""
        near = np.zeros((len(self.length), codes.shape[1]))
        off = np.zeros_like(near)
        for code, along, (low, step, planes, total, rounding) in zip(codes, aligned, self.layers):
            ones = np.bitwise_count(code).sum(axis=1, dtype=np.int32)
            met = np.zeros(near.shape, dtype=np.int32)
            for p, plane in enumerate(planes):
                for word in range(code.shape[1]):
                    met += np.bitwise_count(plane[:, word, None] & code[None, :, word]).astype(np.int32) << p
            inner = (2 * (low[:, None] * ones + step[:, None] * met) - total[:, None]) / self.root
            near += inner * along
            off += rounding[:, None] * along
        outside = np.sqrt(np.maximum(self.length[:, None] ** 2 - np.maximum(np.abs(inner) - rounding[:, None], 0) ** 2, 0))
        longest = np.sqrt((aligned ** 2).sum(axis=0) + rest ** 2)
        off += outside * rest + SLACK * self.length[:, None] * longest
        return near - off, near + off


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf where there are fewer."""
    return np.partition(values, -k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def score_range(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole n with ``low * score <= 100 * n <= high * score``."""
    q, r = divmod(score, 100)
    return low * q - (-low * r) // 100, high * q + high * r // 100


def _best(found: list[pd.DataFrame], by: list[str], k: int) -> pd.DataFrame:
    both = pd.concat(found).sort_values([*by, "score", "code"], ascending=[*(True for _ in by), False, True])
    return both[both.groupby(by).cumcount() < k]


class Cell:
    """A block of rows and a group of anchors that meet in a task."""

    def __init__(self, pdf: pd.DataFrame, turns: list[np.ndarray]):
        is_block = pdf["offers"].isna() if "offers" in pdf else pdf["side"] == 0
        block, group = pdf[is_block.to_numpy()], pdf[~is_block.to_numpy()]
        self.open = bool(len(block) and len(group))
        if not self.open:
            return
        self.marks, self.codes = np.array(group["marks"].iloc[0]), pd.Series(list(block["codes"].iloc[0]))
        self.names, labels = pd.Series(list(group["codes"].iloc[0])), list(group["labels"].iloc[0])
        kinds = pd.factorize(pd.Series([*block["labels"].iloc[0], *labels]))[0]
        owners = pd.factorize(pd.concat([self.codes, self.names]))[0]
        n = len(self.codes)
        self.kinds, self.own_kinds, self.owners, self.own = kinds[:n], kinds[n:], owners[:n], owners[n:]
        self.x = np.frombuffer(block["units"].iloc[0]).reshape(n, -1)
        self.y = np.frombuffer(group["units"].iloc[0]).reshape(len(labels), -1)
        self.offers = [list(o) for o in group["offers"].iloc[0]]
        self.turns = turns

    def parts(self):
        """(anchors, rows, lower ends, upper ends, same label) of parts of bounded size."""
        coded = [encode(self.x[lo:lo + HELD_ROWS], self.turns) for lo in range(0, len(self.x), HELD_ROWS)]
        for lo in range(0, len(self.y), HELD_ANCHORS):
            planes = AnchorPlanes(self.y[lo:lo + HELD_ANCHORS], self.turns)
            ask = np.arange(lo, min(lo + HELD_ANCHORS, len(self.y)))
            for i, code in enumerate(coded):
                rows = np.arange(i * HELD_ROWS, i * HELD_ROWS + code[0].shape[1])
                least, most = planes.intervals(*code)
                yield ask, rows, least, most, self.own_kinds[ask][:, None] == self.kinds[rows][None, :]

    def scored(self, ask: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return exact_products(self.y[ask], self.x[rows])

    def positives(self, k: int) -> pd.DataFrame:
        found = []
        for ask, rows, least, most, same in self.parts():
            fits = same & (self.own[ask][:, None] != self.owners[rows][None, :])
            floor = _kth(np.where(fits, least, -np.inf), k)
            i, j = np.nonzero(fits & (most >= floor[:, None]))
            found.append(_best([pd.DataFrame({"mark": self.marks[ask[i]], "code": self.codes.to_numpy()[rows[j]], "score": self.scored(ask[i], rows[j])})], ["mark"], k))
        return _best(found, ["mark"], k)

    def negatives(self, k: int, low: int, high: int) -> pd.DataFrame:
        found = []
        for ask, rows, least, most, same in self.parts():
            survives, wanted = np.zeros(same.shape, dtype=bool), []
            other = ~same & (self.own[ask][:, None] != self.owners[rows][None, :])
            for place in range(max((len(self.offers[a]) for a in ask), default=0)):
                ranges = [score_range(self.offers[a][place], low, high) if place < len(self.offers[a]) else (1, 0) for a in ask]
                bottom, top = (np.array([r[s] for r in ranges], dtype=np.float64)[:, None] for s in (0, 1))
                room = SLACK * (np.abs(bottom) + np.abs(top))
                fits = other & (most >= bottom - room) & (least <= top + room) & (bottom <= top)
                floor = _kth(np.where(fits & (least >= bottom + room) & (most <= top - room), least, -np.inf), k)
                survives |= fits & (most >= floor[:, None])
                wanted.append(ranges)
            i, j = np.nonzero(survives)
            scores, codes = self.scored(ask[i], rows[j]), self.codes.to_numpy()[rows[j]]
            for place, ranges in enumerate(wanted):
                bottom, top = (np.array([r[s] for r in ranges], dtype=np.int64)[i] for s in (0, 1))
                inside = (scores >= bottom) & (scores <= top)
                found.append(_best([pd.DataFrame({"mark": self.marks[ask[i[inside]]], "place": place, "code": codes[inside], "score": scores[inside]})], ["mark", "place"], k))
        return _best(found, ["mark", "place"], k) if found else pd.DataFrame({"mark": [], "place": [], "code": [], "score": []})


def hard_negatives(exposures: DataFrame, anchors: str, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
                   id_col: str = "ts_code", label_col: str = "industry", features_col: str = "features") -> DataFrame:
    """Stocks of other industries that come close to an anchor's best peers: ``anchor_code``, ``positive_code``,
    ``rank`` from 1, ``negative_code``, ``positive_score``, ``negative_score``.

    Anchors are the rows of ``exposures`` that satisfy the SQL condition ``anchors`` on ``ts_code``. A feature x
    counts as ``floor(scale * x)``; a score is the integer inner product with the anchor, higher scores come
    first, ties by smaller code. An anchor's positives are its first ``positives`` rows of the same industry;
    for each, the first ``negatives`` rows of other industries with ``low * positive_score <= 100 *
    negative_score <= high * positive_score`` are returned, all if there are fewer.

    Rows with a null code, a null industry or features that are null, empty, of an uncommon length or hold a
    null or non-finite entry take no part. Rows equal in code, industry and features count once; rows with the
    anchor's own code are none of its positives or negatives. Anchors without a positive, and positives
    without a fitting negative (those with a negative score, say), give no rows, nor does an empty table.
    Further columns are ignored, whatever their names. Scores must be longs.
    """
    vec = F.transform(exposures[features_col], lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    finite = F.transform(exposures[features_col], lambda x: x.cast("double"))
    rows = taking_part(exposures.select(exposures[id_col].alias("code"), exposures[label_col].alias("label"), finite.alias("vec"), vec.alias("units")))
    rows = rows.where("code is not null and label is not null").select("code", "label", "units").distinct()
    rows = rows.select("code", "label", "units", F.monotonically_increasing_id().alias("mark"), F.expr(f"exists(array(code), {id_col} -> {anchors})").alias("asked"))
    rows = cut_lineage(rows)  # stored, so that a row keeps its mark
    spark, kind, label = rows.sparkSession, rows.schema["code"].dataType, rows.schema["label"].dataType
    total, asked, size = rows.agg(F.count(F.lit(1)), F.count_if("asked"), F.max(F.size("units"))).first()
    blocks_n = max(1, -(-total // BLOCK_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-total // LEAST_ROWS)))
    groups_n = max(1, -(-asked // GROUP_ANCHORS))
    turns = spark.sparkContext.broadcast(rotations(size or 1))  # LAYERS matrices of the features' size
    packed = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("marks", T.ArrayType(T.LongType())), T.StructField("codes", T.ArrayType(kind)),
                           T.StructField("labels", T.ArrayType(label)), T.StructField("units", T.BinaryType()), T.StructField("offers", T.ArrayType(T.ArrayType(T.LongType())))])

    def pack(offered: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            units = np.array(pdf["units"].tolist(), dtype=np.float64)
            return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "marks": [pdf["mark"].tolist()], "codes": [pdf["code"].tolist()], "labels": [pdf["label"].tolist()],
                                 "units": [units.tobytes()], "offers": [[list(o) for o in pdf["offers"]] if offered else None]})

        return run

    blocks = cut_lineage(rows.withColumn("part", bucket(F.lit(blocks_n), "mark")).groupBy("part").applyInPandas(pack(False), packed))
    grouped = rows.where("asked").withColumn("part", bucket(F.lit(groups_n), "mark"))

    def met(asking: DataFrame, run, schema: T.StructType) -> DataFrame:
        """``run`` of every cell: each block of rows with each group of anchors."""
        group = asking.groupBy("part").applyInPandas(pack(True), packed)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        sides = blocks.withColumn("group", every(groups_n)).withColumnRenamed("part", "block").select("block", "group", *packed.names[1:])
        other = group.withColumn("block", every(blocks_n)).withColumnRenamed("part", "group").select("block", "group", *packed.names[1:])

        def cell(pdf: pd.DataFrame) -> pd.DataFrame:
            c = Cell(pdf, turns.value)
            return (run(c) if c.open else pd.DataFrame({n: [] for n in schema.names}))[schema.names]

        return sides.unionAll(other).groupBy("block", "group").applyInPandas(cell, schema)

    found = T.StructType([T.StructField("mark", T.LongType()), T.StructField("code", kind), T.StructField("score", T.LongType())])
    none = F.array().cast("array<bigint>")
    order = (F.desc("score"), "code")
    best = met(grouped.withColumn("offers", none), lambda c: c.positives(positives), found)
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("mark").orderBy(*order)) - 1).where(F.col("place") < positives)
    best = cut_lineage(best)
    offers = best.groupBy("mark").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("offers"))  # a few per anchor
    asking = grouped.join(offers, "mark")
    negative = T.StructType([found["mark"], T.StructField("place", T.IntegerType()), found["code"], found["score"]])
    hits = met(asking, lambda c: c.negatives(negatives, low, high), negative)
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("mark", "place").orderBy(*order))).where(F.col("rank") <= negatives)
    named = grouped.select("mark", F.col("code").alias("anchor_code")).join(best.select("mark", "place", F.col("code").alias("positive_code"), F.col("score").alias("positive_score")), "mark")
    return hits.join(named, ["mark", "place"]).select("anchor_code", "positive_code", "rank", F.col("code").alias("negative_code"), "positive_score", F.col("score").alias("negative_score"))
