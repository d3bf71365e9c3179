"""Byte-level BPE over report texts: encode to ids, decode to bytes.

A piece of text is encoded without replaying merges. An automaton over the vocabulary (bytes
mapped to Latin-1) gives the longest token at every position; from there the encoder walks
left to right, takes the longest token that is compatible with the one before, and backs up
over positions that turned out dead. Two neighbours are compatible if no merge across their
border would have come first; that answer is memoised. Every position dies at most once, so
the walk is linear in the piece, and the ids are those of the merge procedure.
"""

from __future__ import annotations

import base64
from array import array

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tasks import Memo, text_slices

NONE = -1


class BytePairCoder:
    """Vocabulary of a rank file with the tables of the backtracking encoder."""

    def __init__(self, rank_file: bytes, pattern: str, entries: int = 300_000):
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(t) for t in self.tokens]
        self.shorter = [NONE] * size
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), NONE)
        self._learn_halves(sorted(ranks.items(), key=lambda x: x[1]))
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.compatible = Memo(self._compatible, 250_000)
        self.memo = Memo(self._packed, entries)

    def _learn_halves(self, ordered):
        """The last merge behind each token: its two halves, found among earlier tokens."""
        size = len(self.tokens)
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in ordered:
            if len(token) == 1:
                continue
            a = self.shorter[rank]
            while a != NONE:
                b = self.ranks.get(token[self.lengths[a]:], NONE)
                if NONE < a < rank and NONE < b < rank and self._compatible((a, b)):
                    self.merged[a, b] = rank
                    self.left[rank], self.right[rank] = a, b
                    break
                a = self.shorter[a]
            else:
                raise ValueError(f"token {rank} can't be reached by merges of earlier tokens")

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether both tokens survive next to each other: undo their merges from the latest on
        and look for a merge across the border that would have come before."""
        a, b = pair
        before = len(self.tokens)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                return False
            leaf_a, leaf_b = self.right[a] == a, self.left[b] == b
            if leaf_a and leaf_b:
                return True
            if leaf_b or (a > b and not leaf_a):
                before, a = a, self.right[a]
            else:
                before, b = b + 1, self.left[b]

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, lengths, shorter, compatible = len(data), self.lengths, self.shorter, self.compatible
        longest = [NONE] * n
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - lengths[token]] = token  # a later end at the same start is longer
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            while token != NONE and (dead[at + lengths[token]] or out and not compatible[out[-1], token]):
                token = shorter[token]
            if token != NONE:
                out.append(token)
                at += lengths[token]
                if at == n:
                    return out
                token = longest[at]
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]
            else:
                raise ValueError("vocabulary lacks a byte of the text")

    def _packed(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I")))


_CODERS: dict[tuple, BytePairCoder] = {}


def _coder(shared, pattern: str) -> BytePairCoder:
    """One coder per vocabulary and worker process."""
    key = (hash(shared.value), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = BytePairCoder(shared.value, pattern)
    return _CODERS[key]


def _shared_file(spark, path: str):
    """A vocabulary file (about a MB whatever the data) for all workers."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_reports(reports: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "external_id",
                   text_col: str = "content_text") -> DataFrame:
    """Encode every whole ``content_text``: ``external_id``, ``n_tokens``, ``token_ids`` (binary,
    little-endian unsigned 32-bit ids).

    ``ranks_path`` is a rank file (base64 token, blank, rank per line) and ``pattern`` the regular
    expression whose matches are encoded one by one. Special tokens are ordinary text.

    A null text counts as empty and has no tokens; a null id stays null; repeated rows are encoded
    each; an empty table gives no rows; further columns are ignored, whatever their names. A text
    of any length is encoded whole. Needs no shuffle.
    """
    shared = _shared_file(reports.sparkSession, ranks_path)
    source = reports.select(reports[id_col].alias("external_id"), reports[text_col].cast("string").alias("content_text"))
    schema = T.StructType([source.schema["external_id"], T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())])

    def run(batches):
        coder = _coder(shared, pattern)
        for batch in batches:
            for rows, texts in text_slices(batch, 1, 2_000_000):
                packed = [coder.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())],
                                                 ["external_id", "n_tokens", "token_ids"])

    return source.mapInArrow(run, schema)


def decode_reports(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Add ``content_bytes`` (the decoded bytes) to the rows of :func:`encode_reports`.

    Null ``token_ids`` decode to no bytes; an id outside the vocabulary is an error."""
    shared = _shared_file(tokens.sparkSession, ranks_path)
    schema = T.StructType([*[f for f in tokens.schema if f.name != "content_bytes"], T.StructField("content_bytes", T.BinaryType())])
    source = tokens.drop("content_bytes")
    at = source.columns.index("token_ids")

    def run(batches):
        coder = _coder(shared, pattern)
        for batch in batches:
            out = [coder.decode(b or b"") for b in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], schema.names)

    return source.mapInArrow(run, schema)
