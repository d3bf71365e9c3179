"""Removal of passages that stand earlier, byte for byte, by sorting suffixes bucket by bucket.

Every start of a passage of ``length`` bytes is a suffix to be sorted by its first ``length``
bytes. Suffixes meet in buckets: the least hash of the short byte runs inside a passage names its
bucket, so equal passages always meet, and successive starts with one such run are one piece of
text. Runs and prints of pieces meet before any text moves: pieces whose run occurs once in the
whole table are dropped, and of equal pieces only the first goes on. A bucket is sorted with a
difference cover: positions whose remainder lies in the cover are ranked first, by doubling; then
one block of suffixes at a time is sorted by first bytes, and two suffixes that agree there are
told apart by the ranks at the offset at which both stand on the cover. A task holds one bucket of
bounded text. Where very many different pieces share a run, each passage is a piece of its own and
its bucket is named by all its bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: A perfect difference cover: every remainder of the period is a difference of two of its members.
COVER, PERIOD = (0, 1, 3, 9), 13
#: Bytes of the run that names a bucket, and bits of a position inside a part that is scanned at once.
RUN_BYTES, PART_BITS = 28, 18
#: Text of a bucket on average and of a run that has its passages met one by one; suffixes of a block.
BUCKET_BYTES, HOT_BYTES, BLOCK_SUFFIXES = 2 << 20, 2 << 20, 1 << 19
LEAST_LENGTH = 64
#: Pieces that meet in a task on average, when repeated runs are looked for.
MET_PIECES = 1 << 19
#: What a piece of a text is: a repeat of an earlier one, to be sorted, or of a frequent run.
REPEAT, SORT, HOT = 0, 1, 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _words(raw: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from every position on as a number; zeros follow the text."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(16, dtype=np.uint8)])
    out = np.empty(n + 8, dtype=np.uint64)
    for at in range(8):
        part = np.frombuffer(padded, dtype=f"{order}u8", count=(n + 16 - at) // 8, offset=at)
        into = out[at::8]
        into[:] = part[:len(into)]
    return out[:n]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    return np.minimum(values[:span - width], values[width - span:]) if span < width else values


def _part_pieces(raw: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, run) of the pieces of a part; ``valid`` marks the starts that count."""
    words = _words(raw, "<")
    n = len(raw) - RUN_BYTES + 1
    runs = np.zeros(n, dtype=np.uint64)
    for at in (*range(0, RUN_BYTES - 8, 8), RUN_BYTES - 8):
        runs = _mixed((runs ^ words[at:at + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at))
    mask = np.uint64((1 << PART_BITS) - 1)
    least = _least((runs & ~mask) | np.arange(n, dtype=np.uint64), length - RUN_BYTES + 1)  # the first of equal runs
    differs = least[1:] != least[:-1]
    first = np.flatnonzero(valid & np.concatenate([[True], differs | ~valid[:-1]]))
    final = np.flatnonzero(valid & np.concatenate([differs | ~valid[1:], [True]]))
    return first, final - first + 1, runs[(least[first] & mask).astype(np.int64)].view(np.int64)


def pieces(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, number of starts, run) of all pieces: every start of ``length`` bytes lies in one piece,
    and starts of equal passages lie in pieces of equal run."""
    found, held, size = [], [], 0
    limit = 1 << PART_BITS

    def flush():
        if held:
            raw = np.frombuffer(b"".join(t for _, _, t in held), dtype=np.uint8)
            sizes = np.array([len(t) for _, _, t in held])
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(held)), sizes)[:len(raw) - length + 1]
            valid = np.arange(len(owner)) + length <= ends[owner]
            first, count, run = _part_pieces(raw, valid, length)
            of = owner[first]
            base = np.array([at for _, at, _ in held]) - (ends - sizes)
            found.append((np.array([i for i, _, _ in held])[of], first + base[of], count, run))
            held.clear()

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        for lo in range(0, len(text) - length + 1, limit - length + 1):  # parts of a very long text share length - 1 bytes
            part = text[lo:lo + limit]
            if held and size + len(part) > limit:
                flush()
                size = 0
            held.append((i, lo, part))
            size += len(part)
    flush()
    if not found:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def _pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)


@lru_cache(maxsize=1)
def _slots() -> np.ndarray:
    """Place of a remainder in the cover, or -1."""
    out = np.full(PERIOD, -1)
    out[list(COVER)] = np.arange(len(COVER))
    return out


class CoverRanks:
    """Ranks of the suffixes on the cover by their first multiples of the period, equal ones alike."""

    def __init__(self, words: np.ndarray, multiples: set[int]):
        at = (np.arange(0, len(words), PERIOD)[:, None] + np.array(COVER)).ravel()
        at = at[at < len(words) - PERIOD]
        self.by = {1: _dense(_pairs(_dense(words[at]), _dense(words[at + PERIOD - 8])))}
        m = 1
        while 2 * m <= max(multiples):
            self.by[2 * m] = self._joined(m, m)
            m *= 2
        for wanted in multiples - set(self.by):
            half = 1 << (wanted.bit_length() - 1)
            self.by[wanted] = self._joined(half, wanted - half)

    def _joined(self, m: int, later: int) -> np.ndarray:
        rank, shift = self.by[m], later * len(COVER)
        follow = np.zeros_like(rank)
        follow[:len(rank) - shift] = rank[shift:] + 1
        return _dense(_pairs(rank, follow))

    def at(self, positions: np.ndarray, multiple: int) -> np.ndarray:
        return self.by[multiple][positions // PERIOD * len(COVER) + _slots()[positions % PERIOD]]


def repeated_starts(bodies: list[bytes], reports: np.ndarray, firsts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, which of its starts begin a passage that also starts earlier; ``reports`` and ``firsts`` are
    the place of a piece's report and of its first start in it."""
    text = np.frombuffer(b"".join([*bodies, bytes(2 * length)]), dtype=np.uint8)
    words = _words(text, ">")
    counts = np.array([len(b) - length + 1 for b in bodies])
    before = np.cumsum(counts) - counts
    within = np.arange(counts.sum()) - np.repeat(before, counts)
    starts = within + np.repeat(np.cumsum([0, *(len(b) for b in bodies[:-1])]), counts)
    places = _pairs(np.repeat(reports, counts), within + np.repeat(firsts, counts))
    multiples = [(length - offset) // PERIOD for offset in range(PERIOD)]
    ranks = CoverRanks(words, set(multiples))
    slots, repeated = _slots(), np.zeros(len(starts), dtype=bool)

    def sort_block(block: np.ndarray) -> None:
        """Finds repeats among suffixes that hold all with the same first bytes."""
        s = starts[block]
        group = _dense(_pairs(_dense(words[s]), _dense(words[s + 8])))
        tied = np.bincount(group)[group] > 1
        block, s, group = block[tied], s[tied], group[tied]
        for offset, multiple in enumerate(multiples):
            left = ~repeated[block]  # the earliest of equal suffixes is always left
            block, s, group = block[left], s[left], group[left]
            on = np.flatnonzero(slots[(s + offset) % PERIOD] >= 0)
            if len(on) < 2:
                continue
            key = _pairs(group[on], ranks.at(s[on] + offset, multiple))
            order = np.argsort(key)
            run = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            tied = np.bincount(run)[run] > 1
            on, run = on[order[tied]], run[tied]
            ends = [words[s[on] + length - 8], words[s[on] + length - 16]]
            order = np.lexsort((places[block[on]], *ends, run))
            same = run[order][1:] == run[order][:-1]
            for end in ends:
                same &= end[order][1:] == end[order][:-1]
            repeated[block[on[order[1:][same]]]] = True

    order = np.argsort(words[starts])
    edges = np.concatenate([[0], np.flatnonzero(words[starts[order[1:]]] != words[starts[order[:-1]]]) + 1, [len(order)]])
    lo = 0
    while lo < len(order):  # one block of suffixes at a time, cut between different first bytes
        hi = edges[max(np.searchsorted(edges, lo + BLOCK_SUFFIXES, "right") - 1, np.searchsorted(edges, lo, "right"))]
        sort_block(order[lo:hi])
        lo = hi
    return np.split(repeated, before[1:])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _lists(order: np.ndarray, key: np.ndarray, columns: list[pa.Array]) -> tuple[np.ndarray, list[pa.Array]]:
    """Values of ``columns`` (already in ``order``) as one list per distinct ``key`` in a row, with those keys."""
    sorted_ = key[order]
    edges = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(order)]]).astype(np.int32) if len(order) else np.zeros(1, dtype=np.int32)
    return sorted_[edges[:-1]] if len(order) else sorted_[:0], [pa.ListArray.from_arrays(pa.array(edges), c) for c in columns]


def _flat(column) -> pa.Array:
    flat = pc.list_flatten(column)
    return flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat


def _per_report(ids: pa.Array, texts: np.ndarray, values: list[np.ndarray], names: list[str], schema: list[str]) -> pa.Table:
    """A row per report with a list of its values."""
    code = np.asarray(ids.dictionary_encode().indices.fill_null(-1))
    order = np.lexsort((texts, code))
    changed = np.concatenate([[True], (code[order][1:] != code[order][:-1]) | (texts[order][1:] != texts[order][:-1])])[:len(order)]
    of = np.flatnonzero(changed)
    edges = pa.array(np.append(of, len(order)).astype(np.int32))
    inner = pa.StructArray.from_arrays([pa.array(v[order]) for v in values], names)
    return pa.Table.from_arrays([ids.take(pa.array(order[of])), pa.array(texts[order[of]]), pa.ListArray.from_arrays(edges, inner)], schema)


def _ranked(ids: pa.Array) -> np.ndarray:
    """Place of every id in the order of ids, nulls last."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)


def _copies(run: np.ndarray, prints: np.ndarray, *place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of pieces by run, print and place; which of them, in that order, equal the one before, and which stand
    at its very place (a report that is there twice)."""
    order = np.lexsort((*place[::-1], prints, run))
    as_before = lambda x: np.concatenate([[False], x[order][1:] == x[order][:-1]])[:len(order)]
    copy = as_before(run) & as_before(prints)
    equal = copy.copy()
    for x in place:
        equal &= as_before(x)
    return order, copy, equal


def _packed_pieces(bucket: np.ndarray, ids: pa.Array, texts: np.ndarray, starts: np.ndarray, bodies: list[bytes]) -> pa.RecordBatch:
    """Pieces as a row per bucket."""
    order = np.argsort(bucket, kind="stable")
    keys, lists = _lists(order, bucket, [ids.take(pa.array(order)), pa.array(texts[order]), pa.array(starts[order].astype(np.int32)), pa.array([len(bodies[i]) for i in order], pa.int32())])
    edges = lists[0].offsets.to_numpy()
    data = [zstandard.compress(b"".join(bodies[i] for i in order[lo:hi]), 1) for lo, hi in zip(edges[:-1], edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *lists, pa.array(data, pa.binary())], ["bucket", "ids", "texts", "starts", "sizes", "data"])


def drop_earlier_passages(reports: DataFrame, *, length: int = 100, id_col: str = "external_id", text_col: str = "content_text") -> DataFrame:
    """Reports without the bytes of every passage of ``length`` bytes (64 at least) that also starts earlier:
    ``external_id``, ``content_bytes`` (what is left of the UTF-8 text), ``n_bytes`` before, ``n_removed`` and
    ``n_spans`` (maximal runs of removed bytes).

    Earlier is in a report of smaller id (null ids last), or in the same report at an earlier start; passages may
    overlap, are judged on the texts as given and never cross reports. Rows that agree in id and text are one
    report: each gets its result. Rows that agree in id alone are ordered by a hash of their texts. Null texts
    are empty, and empty and short texts stay as they are; further columns are ignored, whatever their names;
    an empty table gives no rows.
    """
    if length < LEAST_LENGTH:
        raise ValueError(f"passages have {LEAST_LENGTH} bytes at least")
    body = F.coalesce(reports[text_col].cast("string"), F.lit("")).cast("binary")
    docs = reports.select(reports[id_col].alias("id"), F.xxhash64(body).alias("text"), body.alias("body"))
    long_enough, kind = F.length("body") >= length, docs.schema["id"]
    total = docs.agg(F.sum(F.length("body"))).first()[0] or 0
    buckets = max(1, total // (MET_PIECES * (length - RUN_BYTES) // 2))
    integer, long, binary, many = T.IntegerType(), T.LongType(), T.BinaryType(), T.ArrayType
    met = T.StructType([T.StructField("bucket", integer), T.StructField("ids", many(kind.dataType)), T.StructField("texts", many(long)), T.StructField("starts", many(integer)),
                        T.StructField("counts", many(integer)), T.StructField("runs", many(long)), T.StructField("prints", many(long))])
    cut_type = T.StructType([T.StructField("start", integer), T.StructField("n", integer), T.StructField("what", integer), T.StructField("run", long)])
    found = T.StructType([kind, T.StructField("text", long), T.StructField("cuts", many(cut_type))])

    def scan(batches):
        """Runs, prints and places of all pieces, a row per bucket; of equal pieces in a batch all but the first are repeats already (no run)."""
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            of, first, count, run = pieces(bodies, length)
            if not len(of):
                continue
            prints = np.array([xxhash.xxh3_64_intdigest(memoryview(bodies[i])[a:a + n + length - 1]) for i, a, n in zip(of.tolist(), first.tolist(), count.tolist())], dtype=np.uint64).view(np.int64)
            texts = batch.column(1).to_numpy()[of]
            order, copy, equal = _copies(run, prints, _ranked(batch.column(0))[of], texts, first)
            later, twice = np.zeros((2, len(of)), dtype=bool)
            later[order[copy]], twice[order[equal]] = True, True
            of, first, count, run, prints, texts, later = (x[~twice] for x in (of, first, count, run, prints, texts, later))
            bucket = (_mixed(run.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            bucket[later] = (_mixed(texts[later].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(2 * bucket + later, kind="stable")
            of = of[order]
            gone = pa.array(later[order])
            keys, lists = _lists(order, 2 * bucket + later, [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(first[order].astype(np.int32)), pa.array(count[order].astype(np.int32)),
                                                             pc.if_else(gone, None, pa.array(run[order])), pa.array(prints[order])])
            yield pa.RecordBatch.from_arrays([pa.array((keys // 2).astype(np.int32)), *lists], met.names)

    def meet(table: pa.Table) -> pa.Table:
        """What each piece of a bucket is."""
        ids, runs = _flat(table.column("ids")), _flat(table.column("runs"))
        texts, starts, counts, prints = (_flat(table.column(c)).to_numpy() for c in ("texts", "starts", "counts", "prints"))
        what = np.full(len(starts), REPEAT, dtype=np.int32)
        open_ = np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False))
        run = runs.fill_null(0).to_numpy()
        what[open_] = -1
        order = open_[np.argsort(run[open_])]
        number = np.concatenate([[0], np.cumsum(run[order][1:] != run[order][:-1])])[:len(order)]
        again = np.bincount(number)[number] > 1 if len(order) else np.zeros(0, dtype=bool)
        at, number = order[again], number[again]
        if len(at):
            order, copy, equal = _copies(number, prints[at], _ranked(ids.take(pa.array(at))), texts[at], starts[at])
            at, number, new = at[order][~equal], number[order][~equal], ~copy[~equal]
            size = np.bincount(number, weights=np.where(new, counts[at] + length - 1, 0))
            distinct = np.bincount(number, weights=new)
            what[at] = np.where(~new, REPEAT, np.where(distinct[number] < 2, -1, np.where(size[number] > HOT_BYTES, HOT, SORT)))
        keep = np.flatnonzero(what >= 0)
        return _per_report(ids.take(pa.array(keep)), texts[keep], [starts[keep], counts[keep], what[keep], run[keep]], cut_type.names, found.names)

    parts = docs.where(long_enough).mapInArrow(scan, met).groupBy("bucket").applyInArrow(meet, found)
    owned = cut_lineage(parts.groupBy("id", "text").agg(F.flatten(F.collect_list("cuts")).alias("cuts")))  # no more than the text is long
    sorts = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + F.when(c["what"] == SORT, c["n"] + length - 1).when(c["what"] == HOT, c["n"] * length).otherwise(0))
    work = owned.agg(F.sum(sorts)).first()[0] or 0
    sort_buckets = max(1, -(-work // BUCKET_BYTES))
    piece_schema = T.StructType([met["bucket"], met["ids"], met["texts"], met["starts"], T.StructField("sizes", many(integer)), T.StructField("data", binary)])

    def packed(batches):
        """Texts travel compressed."""
        for batch in batches:
            press = zstandard.ZstdCompressor(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press.compress(t) for t in batch.column(2).to_pylist()], pa.binary())], ["id", "text", "body"])

    small = T.StructType([kind, T.StructField("text", long), T.StructField("body", binary)])
    moved = docs.mapInArrow(packed, small)
    same = F.col("d.id").eqNullSafe(F.col("o.id")) & (F.col("d.text") == F.col("o.text"))

    def cut(batches):
        """Pieces to be sorted, a row per bucket."""
        for batch in batches:
            of, starts, key, bodies = [], [], [], []
            for i, (body_, cuts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                text = zstandard.decompress(body_)
                for c in cuts:
                    whole = c["what"] == SORT
                    for a in (c["start"],) if whole else range(c["start"], c["start"] + c["n"]):
                        piece = text[a:a + (c["n"] if whole else 1) + length - 1]
                        of.append(i)
                        starts.append(a)
                        bodies.append(piece)
                        key.append(c["run"] if whole else xxhash.xxh3_64_intdigest(piece) - (1 << 63))
            if of:
                bucket = _mixed(np.array(key, dtype=np.int64).view(np.uint64)) % np.uint64(sort_buckets)
                at = np.array(of)
                yield _packed_pieces(bucket.astype(np.int64), batch.column(0).take(pa.array(at)), batch.column(1).to_numpy()[at], np.array(starts), bodies)

    texts_ = moved.alias("d").join(owned.where(F.exists("cuts", lambda c: c["what"] != REPEAT)).alias("o"), same)
    open_cuts = F.filter("cuts", lambda c: c["what"] != REPEAT)
    cuts = texts_.select("d.id", "d.text", "body", open_cuts.alias("cuts")).mapInArrow(cut, piece_schema)
    span_type = T.StructType([T.StructField("first", integer), T.StructField("final", integer)])
    span_schema = T.StructType([kind, T.StructField("text", long), T.StructField("spans", many(span_type))])

    def sort_bucket(table: pa.Table) -> pa.Table:
        ids, (texts, starts, sizes) = _flat(table.column("ids")), (_flat(table.column(c)).to_numpy() for c in ("texts", "starts", "sizes"))
        data = b"".join(zstandard.decompress(d) for d in table.column("data").to_pylist())
        ends = np.cumsum(sizes, dtype=np.int64)
        bodies = [data[b - n:b] for b, n in zip(ends.tolist(), sizes.tolist())]
        rank = _ranked(ids)
        order = np.lexsort((starts, texts, rank))
        other = np.concatenate([[1], (rank[order][1:] != rank[order][:-1]) | (texts[order][1:] != texts[order][:-1])])
        once = (other == 1) | np.concatenate([[True], starts[order][1:] != starts[order][:-1]])  # a report that is there twice is one
        order, report = order[once], np.cumsum(other)[once]
        of, first, final = [], [], []
        for i, flag in zip(order, repeated_starts([bodies[i] for i in order], report, starts[order], length)):
            if flag.any():
                for a, b in zip(*_runs(flag)):
                    of.append(i)
                    first.append(starts[i] + a)
                    final.append(starts[i] + b - 1 + length)
        at = np.array(of, dtype=np.int64)
        return _per_report(ids.take(pa.array(at)), texts[at], [np.array(first, dtype=np.int32), np.array(final, dtype=np.int32)], span_type.names, span_schema.names)

    repeats = F.transform(F.filter("cuts", lambda c: c["what"] == REPEAT), lambda c: F.struct(c["start"].alias("first"), (c["start"] + c["n"] + (length - 1)).cast("int").alias("final")))
    spans = owned.select("id", "text", repeats.alias("spans")).unionAll(cuts.groupBy("bucket").applyInArrow(sort_bucket, span_schema))
    gone = cut_lineage(spans.groupBy("id", "text").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).where("size(spans) > 0"))
    out = T.StructType([T.StructField(id_col, kind.dataType), T.StructField("content_bytes", binary), T.StructField("n_bytes", long), T.StructField("n_removed", long), T.StructField("n_spans", long)])

    def remove(batches):
        for batch in batches:
            rows = []
            for body_, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text, parts_, n, at = zstandard.decompress(body_), [], 0, -1
                for span in spans_ or ():
                    if span["first"] > at:  # not even touching the run before
                        parts_.append(text[max(at, 0):span["first"]])
                        n += 1
                    at = max(at, span["final"])
                rest = b"".join([*parts_, text[max(at, 0):]])
                rows.append((rest, len(text), len(text) - len(rest), n))
            kept, *numbers = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in numbers)], out.names)

    return moved.alias("d").join(gone.alias("o"), same, "left").select("d.id", "body", "spans").mapInArrow(remove, out)
