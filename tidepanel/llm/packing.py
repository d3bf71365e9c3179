"""Harmonic packing of tokenised reports into fixed-length sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of which k fill a sequence.
A report is cut into whole sequences and a rest; the rest stays one piece if k of its kind leave
at most ``slack`` tokens free, else a piece of the next smaller class's full share is cut off
and what is left is classed again. Each class fills its own sequence with exactly k pieces, in
every task by itself, so workers need not talk. The few pieces in open sequences at a task's
end are laid end to end and cut at the sequence length.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tasks import text_slices

#: Fixed value: the expression by which the byte-level pre-tokenizer cuts a text.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters outside printable ASCII, line ends and Latin letters, on which libraries' tables may differ.
UNUSUAL = re.compile("[^\\t\\n\\r\x20-\x7e\xa1-\u024f]").search


def byte_ranks(model: bytes) -> dict[bytes, int] | None:
    """Bytes of each token by id, if the file is a plain byte-level BPE whose merges follow the ids, else None."""
    told = json.loads(model)
    bpe, cut = told["model"], told["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not told["normalizer"] and not told["post_processor"]
    if bpe["type"] != "BPE" or bpe.get("dropout") or bpe.get("ignore_merges") or bpe.get("byte_fallback") or not plain:
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {t["content"] for t in told["added_tokens"]}
    vocabulary = {t: i for t, i in bpe["vocab"].items() if t not in added}
    made = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in bpe["merges"]]
    if None in made or any(a >= b for a, b in zip(made, made[1:])) or len(made) + 256 != len(vocabulary) or made and made[0] < 256:
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()}


class ReportTokenizer:
    """A tokenizer file. Where it is a plain byte-level BPE, usual texts go through a faster encoder with
    the same vocabulary and merges; all others, and texts that hold the string of an added token, through
    the file's own library."""

    def __init__(self, model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken

        self.model = model
        ranks = byte_ranks(model)
        added = [re.escape(t["content"]) for t in json.loads(model)["added_tokens"]]
        self.holds_added = re.compile("|".join(added) or "(?!)").search
        self.fast = ranks and tiktoken.Encoding("report", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def tokenizer(self):
        """The library's own tokenizer, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_buffer(self.model)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, little-endian unsigned 32-bit."""
        if self.fast and not UNUSUAL(text) and not self.holds_added(text):
            return array("I", self.fast(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(1)
def report_tokenizer(model: bytes) -> ReportTokenizer:
    """The tokenizer of a file, built once in each worker."""
    return ReportTokenizer(model)


def cut_lengths(total: int, capacity: int, slack: int) -> list[int]:
    """Lengths of a report's pieces in order: whole sequences, then the classed pieces of the rest."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack:
            out.append(rest)
            break
        share = capacity // (k + 1)
        out.append(share)
        rest -= share
    return out


def pack_reports(reports: DataFrame, tokenizer_path: str, *, capacity: int = 1024, slack: int = 24, end_id: int = 0,
                 id_col: str = "external_id", text_col: str = "content_text") -> DataFrame:
    """Pack all reports into sequences of at most ``capacity`` tokens; one row per piece:
    ``external_id``, ``start`` and ``length`` in the report's ids, ``token_ids`` (binary, little-endian
    unsigned 32-bit), ``report_tokens`` (with the closing ``end_id``), ``sequence_id`` and ``offset``.

    A null text counts as empty and becomes the closing id alone; null ids, repeated rows and further
    columns are carried or ignored as they are; an empty table gives no rows; long texts are tokenised
    whole. The string of an added token in a text becomes that token, as the file's library has it by default. ``sequence_id`` is unique, not dense: the task's number and a counter. Per task at most one
    sequence is filled by the end-to-end rule's last piece. Needs no shuffle.
    """
    with open(tokenizer_path, "rb") as f:
        shared = reports.sparkSession.sparkContext.broadcast(f.read())  # about a MB whatever the data
    source = reports.select(reports[id_col].alias("external_id"), reports[text_col].cast("string").alias("content_text"))
    head = source.schema["external_id"]
    long = T.LongType()
    schema = T.StructType([head, T.StructField("start", long), T.StructField("length", long), T.StructField("token_ids", T.BinaryType()),
                           T.StructField("report_tokens", long), T.StructField("sequence_id", long), T.StructField("offset", long)])
    closing = array("I", [end_id]).tobytes()

    def run(batches):
        tokenizer = report_tokenizer(shared.value)
        base, used = TaskContext.get().partitionId() << 33, 0
        open_bins: dict[int, list] = {}
        kind = None

        def table(rows):
            ids, starts, lengths, data, totals, bins, offsets = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(x, pa.int64()) for x in (starts, lengths)), pa.array(data, pa.binary()),
                                               *(pa.array(x, pa.int64()) for x in (totals, bins, offsets))], schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for part, texts in text_slices(batch, 1):
                rows = []
                for key, text in zip(part.column(0).to_pylist(), texts):
                    ids = tokenizer.encode(text) + closing
                    total, start = len(ids) // 4, 0
                    for n in cut_lengths(total, capacity, slack):
                        k = capacity // n
                        held = open_bins.setdefault(k, [])
                        held.append((key, start, n, ids[4 * start:4 * (start + n)], total))
                        start += n
                        if len(held) == k:
                            at = 0
                            for piece in held:
                                rows.append((*piece, base + used, at))
                                at += piece[2]
                            used += 1
                            held.clear()
                if rows:
                    yield table(rows)
        rows, at = [], 0
        for k in sorted(open_bins):
            for key, start, n, ids, total in open_bins[k]:
                while n:
                    m = min(n, capacity - at)
                    rows.append((key, start, m, ids[:4 * m], total, base + used, at))
                    start, n, ids, at = start + m, n - m, ids[4 * m:], at + m
                    if at == capacity:
                        used, at = used + 1, 0
                if len(rows) >= 10_000:
                    yield table(rows)
                    rows = []
        if rows:
            yield table(rows)

    return source.mapInArrow(run, schema)
