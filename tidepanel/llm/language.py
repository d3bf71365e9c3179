"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is the product of its letters'
vectors, each rotated by its place; a text is the sum of its n-grams' vectors, a language the sum
of its texts' unit vectors, less what all languages share. A text gets the language with the
largest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tasks import text_slices

UNKNOWN = "und"
DIMENSIONS = 1024
#: Labelled reports per language that a profile is learnt from, at most (a hash sample beyond that).
PROFILE_REPORTS = 20_000
#: Letters below this code point have a vector each; those above share the others by remainder.
OWN_LETTERS, SYMBOLS = 0x250, 1024
#: Characters bundled at once, n-gram vectors made at once and n-grams looked up by table: bounds of a task's memory.
SLICE, GRAMS, TABLE = 300_000, 4096, 1_000_000


class Bundler:
    """Letter vectors and the bundling of texts; the same in every process."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        self.dimensions = dimensions
        letters = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * 2 - 1
        self.rotated = [np.roll(letters, shift, axis=1) for shift in (2, 1, 0)]
        self.symbol = np.zeros(0x110000, dtype=np.int32)
        codes = np.array([c for c in range(0x110000) if chr(c).isalpha()])
        self.symbol[codes] = np.where(codes < OWN_LETTERS, codes, OWN_LETTERS + codes % (SYMBOLS - OWN_LETTERS))

    def bundle(self, texts: list[str]) -> np.ndarray:
        """Unit vectors of the texts (rows); zero for a text without letters."""
        joined = "\0".join(t.lower().replace("\0", " ") for t in texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = codes == 0
        sym = self.symbol[codes]
        keep = (sym > 0) | ends
        keep[1:] |= sym[:-1] > 0  # one blank per run of other characters
        owner = np.cumsum(ends) - ends
        sym, owner = sym[keep], owner[keep]
        sym, owner = np.concatenate([[0], sym]), np.concatenate([[0], owner])
        seen = np.flatnonzero(np.bincount(sym, minlength=SYMBOLS))
        local = np.zeros(SYMBOLS, dtype=np.int64)
        local[seen] = np.arange(len(seen))
        m, x = len(seen), local[sym]
        gram, who = (x[:-2] * m + x[1:-1]) * m + x[2:], owner[1:-1]
        inside = (sym[1:-1] > 0) & (owner[2:] == who) | (sym[1:-1] > 0) & (sym[2:] == 0)
        gram, who = gram[inside], who[inside]
        if not len(gram):
            return np.zeros((len(texts), self.dimensions), dtype=np.float32)
        if m ** 3 <= TABLE:
            present = np.flatnonzero(np.bincount(gram, minlength=m ** 3))
            place = np.zeros(m ** 3, dtype=np.int32)
            place[present] = np.arange(len(present))
            index = place[gram]
        else:
            present, index = np.unique(gram, return_inverse=True)
        a, b, c = seen[present // (m * m)], seen[present // m % m], seen[present % m]
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        for lo in range(0, len(present), GRAMS):  # n-gram vectors, a block at a time
            hi = min(lo + GRAMS, len(present))
            block = (self.rotated[0][a[lo:hi]] * self.rotated[1][b[lo:hi]] * self.rotated[2][c[lo:hi]]).astype(np.float32)
            part = (index >= lo) & (index < hi) if len(present) > GRAMS else slice(None)
            width = hi - lo
            counts = np.bincount(who[part] * width + index[part] - lo, minlength=len(texts) * width).reshape(len(texts), width)
            out += counts.astype(np.float32) @ block
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)

    def small_slices(self, texts: list[str]):
        """Runs of texts of bounded size, so that the count table stays small."""
        start = held = 0
        for i, t in enumerate(texts):
            if i > start and (held + len(t) > SLICE or i - start >= 200):
                yield start, i
                start, held = i, 0
            held += len(t)
        if start < len(texts):
            yield start, len(texts)



def language_profiles(reports: DataFrame, *, language_col: str = "language", id_col: str = "external_id", text_col: str = "content_text",
                      most: int = PROFILE_REPORTS, dimensions: int = DIMENSIONS) -> DataFrame:
    """Learn one profile per language from labelled reports: ``language``, ``profile`` (array of
    doubles), ``n_reports``.

    Rows without language or without text do not count. A language with more than ``most`` reports is
    learnt from a sample by a hash of the id of about that size; the bound is the only limit. A table
    without labelled rows gives no profiles.
    """
    labelled = reports.select(reports[language_col].cast("string").alias("language"), reports[id_col].alias("external_id"),
                              reports[text_col].cast("string").alias("content_text")).where("language is not null and content_text is not null")
    sizes = labelled.groupBy("language").agg(F.count(F.lit(1)).alias("size"))
    # a row per language, as the profiles are: texts stay where they are
    part = F.pmod(F.xxhash64("external_id"), F.lit(1 << 20)) < F.ceil(F.lit(float(most)) / F.col("size") * (1 << 20))
    chosen = labelled.join(F.broadcast(sizes), "language").where(part).select("language", "content_text")
    schema = "language string, at int, value double, n long"

    def run(batches):
        bundler, sums, counts = Bundler(dimensions), {}, {}
        for batch in batches:
            for rows, texts in text_slices(batch, 1):
                names = rows.column(0).to_pylist()
                for lo, hi in bundler.small_slices(texts):
                    vectors = bundler.bundle(texts[lo:hi])
                    for name in set(names[lo:hi]):
                        own = np.array([x == name for x in names[lo:hi]])
                        sums[name] = sums.get(name, 0) + vectors[own].sum(axis=0, dtype=np.float64)
                        counts[name] = counts.get(name, 0) + int(own.sum())
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(total, pa.float64()),
                                              pa.array([counts[name]] * dimensions, pa.int64())], ["language", "at", "value", "n"])

    cells = chosen.mapInArrow(run, schema).groupBy("language", "at").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    rows = cells.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("cells"), F.max("n").alias("n_reports"))
    return rows.select("language", F.col("cells.value").alias("profile"), "n_reports")


def predict_language(reports: DataFrame, profiles: DataFrame, *, id_col: str = "external_id", text_col: str = "content_text",
                     keep: list[str] | None = None) -> DataFrame:
    """Language of every whole ``content_text``: ``external_id``, ``language`` and ``similarity`` (cosine
    with the profile, 0 to 1); with ``keep``, the named columns of ``reports`` in place of the id.

    A null text, or one without a letter, is ``und`` with similarity 0, as is every text if there are
    no profiles; equal cosines go to the first language by name. Repeated rows are predicted each; an
    empty table gives no rows. The profiles (one row per language) are sent to all tasks.
    """
    learnt = sorted((r.language, r.profile) for r in profiles.select("language", "profile").collect())  # languages x dimensions
    names = [n for n, _ in learnt]
    matrix = np.array([p for _, p in learnt], dtype=np.float64)
    if learnt:
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        if len(learnt) > 1:
            matrix -= matrix.mean(axis=0)
            matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    kept = [F.col(f"`{c}`") for c in keep] if keep else [reports[id_col].alias("external_id")]
    source = reports.select(reports[text_col].cast("string").alias("_text"), *kept)
    fields = [f for f in source.schema if f.name != "_text"]
    if clash := {"language", "similarity"} & {f.name for f in fields}:
        raise ValueError(f"columns {sorted(clash)} are named like the result's")
    schema = T.StructType([*fields, T.StructField("language", T.StringType()), T.StructField("similarity", T.DoubleType())])
    dimensions = matrix.shape[1] if learnt else DIMENSIONS

    def run(batches):
        bundler = Bundler(dimensions)
        for batch in batches:
            for rows, texts in text_slices(batch, 0):
                found, scores = [], []
                for lo, hi in bundler.small_slices(texts):
                    vectors = bundler.bundle(texts[lo:hi])
                    if not names:
                        found += [UNKNOWN] * (hi - lo)
                        scores += [0.0] * (hi - lo)
                        continue
                    cosines = vectors.astype(np.float64) @ matrix.T
                    best = cosines.argmax(axis=1)
                    empty = ~vectors.any(axis=1)
                    found += [UNKNOWN if e else names[b] for e, b in zip(empty, best)]
                    scores += [0.0 if e else s for e, s in zip(empty, np.clip(cosines.max(axis=1), 0.0, 1.0).tolist())]
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(found), pa.array(scores, pa.float64())], schema.names)

    return source.mapInArrow(run, schema)
