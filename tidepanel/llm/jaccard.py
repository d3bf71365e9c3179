"""Exact n-gram Jaccard join of report texts by several token orders.

A report is the set of its word n-grams (tokens). Under any one order of all tokens two linked
sets share a token among their first ``n - ceil(t n) + 1``: their prefixes. The first order puts
rare tokens first, by a fixed-size count table over all reports, and finds candidates by a join
on prefix tokens; a pair must then also share enough tokens of somewhat longer prefixes under
further, independent orders, and have like parity bitmaps, before its sets are compared.

Equal sets are one node from the start. Pairs within a group are not spelled out: every node is
paired with a partner in its own class of sizes and in both next to it, the least node there that it
shares most prefix tokens with; partners that pass the filters form families, and the best one of a
node is compared. Candidates of different families are compared pair by pair. A family whose
links leave it in several components is compared in blocks of its nodes, with the same filters as
matrix products. No link between components is lost, and a large family never meets in one task.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import sketch
from .components import components
from .tasks import text_slices

#: An odd base of the word hash with its inverse, the weight of a word's place, and bytes hashed in one go.
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = np.uint64(0x9E3779B97F4A7C15)
PIECE_BYTES = 1 << 20
#: Orders besides the first one that a pair must pass.
FILTER_ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Columns of a set's parity bitmap: bit i says whether the number of tokens of remainder i is odd.
PARITY = ("p0", "p1", "p2", "p3")
#: Ids that may be sent to every task at once.
SENT_IDS = 500_000
#: Nodes of a block and tokens handled at once when blocks are compared.
BLOCK_NODES, COLUMNS = 64, 1 << 14


def _mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads all bits."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokens:
    """Token sets of texts: 64-bit hashes of n consecutive words, worked out for many texts at once.

    A word's hash is a polynomial over its bytes; as the base is odd, it has an inverse, and one
    running sum over all bytes gives the hash of every word wherever it stands.
    """

    def __init__(self, words: int):
        self.words = words
        rng = np.random.default_rng(11)
        values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        values[65:91] = values[97:123]  # A-Z count as a-z
        self.values = values
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, *range(9, 14)]] = True
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def _powers(self, n: int):
        if len(self.up) < n:
            size = max(n, PIECE_BYTES + 1)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, base, dtype=np.uint64)])) for base in (BASE, INVERSE))
        return self.up[:n], self.down[:n]

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(byte position, hash) of every word; the data ends with a blank."""
        raw = np.frombuffer(data, dtype=np.uint8)
        space = self.space[raw]
        before = np.concatenate([[True], space[:-1]])
        starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
        up, down = self._powers(len(raw))
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.values[raw] * up, dtype=np.uint64)])
        return starts, _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * PLACE)

    def _pieces(self, data: bytes):
        """Parts of bounded size that end between words; a longer word is a part of its own."""
        at = 0
        while at < len(data):
            end = len(data)
            if end - at > PIECE_BYTES:
                cut = max(data.rfind(c, at, at + PIECE_BYTES) for c in (b" ", b"\n"))
                later = [x for c in (b" ", b"\n") if (x := data.find(c, at + PIECE_BYTES)) >= 0]
                end = cut + 1 if cut >= at else min(later) + 1
            yield at, data[at:end]
            at = end

    def sets_of(self, texts: list[str]) -> list[np.ndarray]:
        """Sorted distinct tokens of each text; a text of fewer words is one token as a whole."""
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join([*encoded, b""])
        found = [(start + at, hashed) for at, piece in self._pieces(data) for start, hashed in [self._words(piece)]]
        starts, h = (np.concatenate(x) for x in zip(*found))
        offsets = np.cumsum([0, *(len(e) + 1 for e in encoded)])
        edges = np.searchsorted(starts, offsets)
        whole = self._joined(h, self.words)
        out = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo >= self.words:
                s = np.sort(whole[lo:hi - self.words + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            else:
                out.append(self._joined(h[lo:hi], int(hi - lo)) if hi > lo else np.empty(0, dtype=np.uint64))
        return out

    @staticmethod
    def _joined(h: np.ndarray, n: int) -> np.ndarray:
        """Hash of every n words in a row."""
        if len(h) < n:
            return np.empty(0, dtype=np.uint64)
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            out *= PLACE  # words weigh by their place; their hashes are uniform already
            out += h[i:len(h) - n + 1 + i]
        return _mixed(out)


@lru_cache(maxsize=2)
def _tokens(words: int) -> Tokens:
    """One per worker process; its tables take longer to make than a small block to compare."""
    return Tokens(words)


def _prefix(n: int, percent: int, shared: int = 1) -> int:
    """Length of the prefixes that linked sets share ``shared`` tokens of."""
    return min(n, n - (percent * n + 99) // 100 + shared)


def _asked(n: int) -> int:
    """Tokens that a pair must share in the prefixes of a further order, by the smaller set's size."""
    return 1 + n // 12


#: Prefixes of further orders hold so many tokens more, as tokens that fold to equal 32 bits count once.
FOLDED = 8


def _signatures(texts: DataFrame, words: int, percent: int, rarity) -> DataFrame:
    """Per row: ``size``, the digest of the set, and the prefixes of all orders."""
    long = T.LongType()
    schema = T.StructType([texts.schema["report"], T.StructField("text_key", T.BinaryType()), T.StructField("size", long), T.StructField("digest", T.BinaryType()),
                           T.StructField("prefix", T.ArrayType(long)), *(T.StructField(f"further{i}", T.ArrayType(T.IntegerType())) for i in range(len(FILTER_ORDERS))),
                           *(T.StructField(p, long) for p in PARITY)])

    def lists(parts, kind):
        offsets = np.zeros(len(parts) + 1, dtype=np.int32)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(kind)))

    def run(batches):
        tokens, rank = _tokens(words), np.frombuffer(rarity.value, dtype=np.uint8)
        shift = np.uint64(65 - len(rank).bit_length())
        for batch in batches:
            for rows, texts_ in text_slices(batch, 2, PIECE_BYTES):
                sizes, digests, prefixes, parity = [], [], [], np.zeros((len(texts_), 4), dtype=np.int64)
                further: list[list] = [[] for _ in FILTER_ORDERS]
                for at, s in enumerate(tokens.sets_of(texts_)):
                    n = len(s)
                    sizes.append(n)
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    p, q = (_prefix(n, percent), _prefix(n, percent, _asked(n) + FOLDED)) if n else (0, 0)
                    own = _mixed(s)
                    if p < n:
                        key = (rank[(own >> shift).view(np.int64)].astype(np.uint64) << np.uint64(56)) | (own >> np.uint64(8))
                        prefixes.append(own[np.argpartition(key, p - 1)[:p]])
                    else:
                        prefixes.append(own)
                    for out, seed in zip(further, FILTER_ORDERS):
                        o = _mixed(s, seed)
                        out.append((np.partition(o, q - 1)[:q] if q < n else o).astype(np.uint32))
                    bits = np.bincount((own & np.uint64(255)).view(np.int64), minlength=256) & 1
                    parity[at] = np.packbits(bits.astype(np.uint8)).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists(prefixes, np.int64),
                                                  *(lists(f, np.int32) for f in further), *(pa.array(np.ascontiguousarray(c)) for c in parity.T)], schema.names)

    return texts.mapInArrow(run, schema)


def _rarity(texts: DataFrame, words: int):
    """Magnitude of the number of reports per slot of tokens, over all reports."""
    total = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    slots = sketch.slots_for(total // 6)  # about a token per six bytes
    shift = np.uint64(65 - slots.bit_length())

    def run(batches):
        tokens, table = _tokens(words), np.zeros(slots, dtype=np.uint32)
        for batch in batches:
            for _, part in text_slices(batch, 2, PIECE_BYTES):
                found = np.concatenate(tokens.sets_of(part))
                np.add.at(table, (_mixed(found) >> shift).view(np.int64), np.uint32(1))
        yield sketch.block_rows(table)

    counts = sketch.summed(texts.mapInArrow(run, sketch.SCHEMA), slots, texts.rdd.getNumPartitions())
    magnitude = np.floor(np.log2(np.maximum(counts, 1))).astype(np.uint8)
    return texts.sparkSession.sparkContext.broadcast(magnitude.tobytes())  # a byte per slot, MOST_SLOTS at most


def _alike(percent: int) -> str:
    """Condition on pairs: sizes allow a link, and so do the parity bitmaps, whose differing bits
    are at most the tokens that only one of the sets holds."""
    differing = " + ".join(f"bit_count(x.{p} ^ y.{p})" for p in PARITY)
    return f"100 * least(x.size, y.size) >= {percent} * greatest(x.size, y.size) and ({differing}) * {100 + percent} <= (x.size + y.size) * {100 - percent}"


def _few(ids: DataFrame) -> DataFrame:
    """A stored table of ids, sent to all tasks if it is counted to be small; else joins move both sides."""
    ids = cut_lineage(ids)
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()


def _passing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (``a``, ``b``) whose sizes allow a link and that share enough prefix tokens under every further order."""
    pairs = cut_lineage(pairs)
    side = nodes.select("node", "size", *(f"further{i}" for i in range(len(FILTER_ORDERS)))).join(_few(_ends(pairs)), "node", "left_semi")
    x, y = (side.select(F.col("node").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in side.columns[1:])) for n in "ab")
    fit = f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"
    joined = pairs.join(x, "a").join(y, "b").where(fit)
    for i in range(len(FILTER_ORDERS)):
        joined = joined.where(f"size(array_intersect(further{i}_a, further{i}_b)) >= least(size_a, size_b) div 12 + 1")
    return joined.select("a", "b")


def _verified(passed: DataFrame, bodies: DataFrame, words: int, percent: int) -> DataFrame:
    """The links among pairs (``a``, ``b``) that passed the filters, by their sets."""
    both = (passed.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("tb")), "b")
            .join(bodies.select(F.col("node").alias("a"), F.col("body").alias("ta")), "a").select("a", "b", "ta", "tb"))

    def run(batches):
        tokens = _tokens(words)
        for batch in batches:
            for rows, ones in text_slices(batch, 2, PIECE_BYTES):
                keep = []
                for one, other in zip(tokens.sets_of(ones), tokens.sets_of(rows.column(3).to_pylist())):
                    common = len(np.intersect1d(one, other, assume_unique=True))
                    keep.append(100 * common >= percent * (len(one) + len(other) - common))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, a block of tokens at a time."""
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    sides = [(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])) for sets in (left, right)]
    vocabulary = np.intersect1d(sides[0][0], sides[1][0])
    if not len(vocabulary):
        return out.astype(np.int64)
    places = []
    for values, owner in sides:
        at = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
        known = vocabulary[at] == values
        places.append((at[known], owner[known]))
    for lo in range(0, len(vocabulary), COLUMNS):
        planes = []
        for sets, (at, owner) in zip((left, right), places):
            part = (at >= lo) & (at < lo + COLUMNS)
            plane = np.zeros((len(sets), min(COLUMNS, len(vocabulary) - lo)), dtype=np.float32)
            plane[owner[part], at[part] - lo] = 1
            planes.append(plane)
        out += planes[0] @ planes[1].T
    return out.astype(np.int64)


def _block_links(pdf: pd.DataFrame, words: int, percent: int) -> pd.DataFrame:
    """Links between two blocks of nodes that join different components: a spanning forest of them."""
    tokens = _tokens(words)
    left = pdf["side"].to_numpy() == 0
    right = ~left if (~left).any() else left
    roots, ids = pdf["root"].to_numpy(), pdf["node"].to_numpy()
    sets = tokens.sets_of(pdf["body"].tolist())
    xs, ys = np.flatnonzero(left), np.flatnonzero(right)
    sizes = np.array([len(s) for s in sets])
    nx, ny = sizes[xs][:, None], sizes[ys][None, :]
    open_ = (roots[xs][:, None] != roots[ys][None, :]) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
    for seed in FILTER_ORDERS:
        if open_.any():
            cut = [np.sort(_mixed(s, seed))[:_prefix(len(s), percent, _asked(len(s)))] for s in sets]
            open_ &= _common([cut[i] for i in xs], [cut[i] for i in ys]) >= _asked(np.minimum(nx, ny))
    found = []
    if open_.any():
        common = _common([sets[i] for i in xs], [sets[i] for i in ys])
        open_ &= 100 * common >= percent * (nx + ny - common)
        parent: dict[int, int] = {}

        def top(r):
            while parent.get(r, r) != r:
                r = parent[r]
            return r

        for i, j in zip(*np.nonzero(open_)):
            ra, rb = top(roots[xs[i]]), top(roots[ys[j]])
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                found.append((ids[xs[i]], ids[ys[j]]))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _shared(postings: DataFrame) -> DataFrame:
    """The postings (``token``, ``node``, ...) of tokens that stand in several nodes; all postings are shuffled once."""
    return postings.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("_n > 1").drop("_n")


def near_duplicates(reports: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "external_id", text_col: str = "content_text") -> DataFrame:
    """Groups of near-equal reports: ``external_id``, ``n_tokens`` (size of the set) and ``group_id``, the
    least ``external_id`` reachable over links, itself included.

    Two reports link when ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct ``words``-grams;
    words are runs other than blank and tab to carriage return, with A-Z in lower case. A text of fewer
    words is one token. Null, empty and blank texts have the empty set and stay alone (``group_id`` is their
    own id). Null ids are carried: they get the least other id of their group, or null. Rows with equal ids
    are compared by their texts like any others. Further columns are ignored; an empty table gives no rows.
    """
    base = reports.select(reports[id_col].alias("report"), F.coalesce(reports[text_col].cast("string"), F.lit("")).alias("body"))
    texts = base.select("report", F.unhex(F.md5("body")).alias("text_key"), "body")
    rows = cut_lineage(_signatures(texts, words, percent, _rarity(texts, words)).withColumn("row", F.monotonically_increasing_id()))
    sets = rows.where("size > 0")
    first = cut_lineage(sets.groupBy("digest").agg(F.min("row").alias("row"), F.min("report").alias("least")))
    nodes = sets.withColumnRenamed("row", "node")
    # Sets that can link are of the same class of sizes or of neighbouring ones.
    step = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent) + 1e-9).cast("int").alias("step")
    postings = nodes.select(F.explode("prefix").alias("token"), "node", step)
    # The least row of a token is the first of its set, so copies can go once only shared tokens are left.
    shared = _shared(postings).join(first.select(F.col("row").alias("node")), "node", "left_semi")
    slim = nodes.select("node", "size", *PARITY)
    shared = cut_lineage(shared.select("token", "node", "step"))
    leaders = shared.groupBy("token", "step").agg(F.min("node").alias("leader")).select("token", F.col("step").alias("near"), "leader")
    votes = shared.join(leaders, "token").where("node > leader and abs(step - near) <= 1")
    votes = votes.groupBy(F.col("leader").alias("a"), F.col("node").alias("b"), (F.col("near") - F.col("step")).alias("side")).agg(F.count(F.lit(1)).alias("votes"))
    partner = votes.groupBy("b", "side").agg(F.max_by(F.struct("a", "votes"), F.struct("votes", -F.col("a"))).alias("best"))
    partner = cut_lineage(partner.select("best.a", "b", "best.votes"))  # three of a node at most
    kin = cut_lineage(_passing(partner.select("a", "b"), nodes, percent))
    family = cut_lineage(components(kin).select("node", F.col("root").alias("family")))
    partner = cut_lineage(kin.join(partner, ["a", "b"]).groupBy("b").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a")).select("a", "b"))
    placed = cut_lineage(shared.select("token", "node").join(family, "node", "left").select("token", "node", F.coalesce("family", "node").alias("family")))

    # Pairs of different families that pass all filters; few, as members of a family share what is rare.
    mixed = placed.groupBy("token").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo < hi").select("token")
    open_ = placed.join(mixed, "token")
    open_ = open_.join(slim, "node")
    met = open_.alias("x").join(open_.alias("y"), F.expr(f"x.token = y.token and x.node < y.node and x.family <> y.family and {_alike(percent)}"))
    across = cut_lineage(_passing(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), nodes, percent))
    pairs = partner.unionAll(across)
    held = _few(nodes.select("node", "text_key").join(_few(_ends(pairs.unionAll(kin))), "node", "left_semi"))
    bodies = cut_lineage(texts.select("text_key", "body").join(held, "text_key").dropDuplicates(["node"]).select("node", "body"))
    first_links = cut_lineage(_verified(pairs, bodies, words, percent))
    roots = components(first_links)

    # Families that are still in several components: their nodes meet block by block.
    member = family.join(roots, "node", "left").select("node", "family", F.coalesce("root", "node").alias("root"))
    unsettled = member.groupBy("family").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_NODES)).cast("int").alias("parts")).where("lo < hi")
    member = member.join(unsettled.select("family", "parts"), "family").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    meets = member.join(bodies, "node").select("family", "node", "root", "body", "part", F.explode(every).alias("other"))
    meets = meets.select("family", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"),
                         "node", "root", "body")
    links = cut_lineage(meets.groupBy("family", "low", "high").applyInPandas(lambda pdf: _block_links(pdf, words, percent), "a long, b long"))
    label = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    label_b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    lifted = links.join(label, "a", "left").join(label_b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    merged = components(lifted)
    final = roots.unionAll(lifted.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    final = final.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    digests = cut_lineage(first.join(final, F.col("row") == F.col("node"), "left").select("digest", "least", F.coalesce("root", "row").alias("root")))
    groups = cut_lineage(digests.groupBy("root").agg(F.min("least").alias("group_id")))
    # Stored, so that the joins that spread the answer stand alone and a hot group's rows can be split.
    named = cut_lineage(digests.join(groups, "root").select("digest", "group_id"))
    out = sets.select("report", "size", "digest").join(named, "digest").select(F.col("report").alias("external_id"), F.col("size").alias("n_tokens"), "group_id")
    alone = rows.where("size = 0").select(F.col("report").alias("external_id"), F.col("size").alias("n_tokens"), F.col("report").alias("group_id"))
    return out.unionAll(alone)
