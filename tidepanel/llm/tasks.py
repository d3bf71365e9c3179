"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Characters handled at once inside a task; a single longer text is handled alone.
SLICE_CHARS = 4_000_000


def text_slices(batch: pa.RecordBatch, text: int | str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut a batch into runs of rows of about ``chars`` characters; null texts become empty."""
    column = batch.column(text)
    sizes = pa.compute.binary_length(column).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > chars:
            part = batch.slice(start, i - start)
            yield part, [t or "" for t in part.column(text).to_pylist()]
            start, held = i, 0
        held += n or 0
    if start < len(sizes):
        part = batch.slice(start)
        yield part, [t or "" for t in part.column(text).to_pylist()]


class Memo(dict):
    """Bounded memory of a pure function; emptied when full, so results never depend on it."""

    def __init__(self, fn, entries: int = 400_000):
        super().__init__()
        self.fn, self.entries = fn, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.fn(key)
        return value
