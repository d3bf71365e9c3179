"""Removal of passages of several lines that reports share, with content-defined chunks.

A rolling hash over the hashes of a line and the one before it decides whether a chunk ends
there; so the same passage is cut alike wherever it stands, but for its edges. Chunks whose
fingerprint occurs more than once are compared byte for byte, and all but the first go. A repeated
passage is found that way between two chunk ends within it; it is then extended over what the
chunks left: every two successive lines that are not both in one chunk that goes are looked up and
compared alike, so that no part of a repeated passage stays. Chunks spare most of these lookups, as
copies consist of chunks that go. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A line ends a chunk with one chance in this many.
DIVISOR = 4


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _line_hash(line: Column) -> Column:
    """32 bits of the line's MD5, which other engines can state too."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _print(body: Column) -> Column:
    """128 bits of the SHA-256."""
    return F.substring(F.unhex(F.sha2(body, 256)), 1, 16)


def chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """Array of content-defined chunks over the lines that are not blank, blank lines between them included:
    ``start`` line, ``size`` in lines, ``print`` of the bytes (null for a single line), ``inner`` (its pairs of
    successive lines: start, size, print) and ``seam`` (the pair of its last line and the next chunk's first; null
    at the end). Null for null."""
    def of_lines(lines):
        body = lambda start, n: F.array_join(F.slice(lines, start + 1, n), "\n")

        def of_full(full):
            def pair(start, k):
                return let(F.get(full, k + 1) - start + 1, lambda n: F.struct(start.alias("start"), n.alias("size"), _print(body(start, n)).alias("print")))

            def of_pairs(h, pairs):
                hit = lambda k: (F.get(h, k) * 31 + F.when(k > 0, F.get(h, k - 1)).otherwise(F.lit(0))) % divisor == 0
                ends = F.filter(F.sequence(F.lit(0), F.size(full) - 1), lambda k: (k == F.size(full) - 1) | hit(k))

                def of_ends(e):
                    def chunk(last, k):
                        one = F.when(k > 0, F.get(e, k - 1) + 1).otherwise(F.lit(0))

                        def of_start(start, n):
                            return F.struct(start.alias("start"), n.alias("size"), F.when(last > one, _print(body(start, n))).alias("print"),
                                            F.slice(pairs, one + 1, last - one).alias("inner"), F.get(pairs, last).alias("seam"))

                        return let(F.get(full, one), lambda start: of_start(start, F.get(full, last) - start + 1))

                    return F.transform(e, chunk)

                return let(ends, of_ends)

            pairs = F.transform(F.slice(full, 1, F.greatest(F.size(full) - 1, F.lit(0))), pair)
            hashes = F.transform(full, lambda i: _line_hash(F.get(lines, i)))
            return F.when(F.size(full) > 0, let(hashes, lambda h: let(pairs, lambda p: of_pairs(h, p))))

        return let(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"\S")), of_full)

    return F.when(text.isNotNull(), let(F.split(text, "\n", -1), of_lines))


#: Columns that the operators add or replace.
COUNTS = ("n_lines", "n_removed")


def _carried(reports: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``given`` (all further columns in one struct, so that none clashes), ``text``, ``_row`` (what tells reports
    apart, in their order) and its ``_hash``."""
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    given = [F.col(f"`{c}`") for c in reports.columns if c not in (*COUNTS, text_col)] or [F.lit(None).alias("none")]
    row = F.struct(key.isNull().alias("last"), key.alias("id"), F.xxhash64(text).alias("text"))
    docs = reports.select(F.struct(*given).alias("given"), text.alias("text"), row.alias("_row"))
    return docs.withColumn("_hash", F.xxhash64("_row"))


def _with_text(result: DataFrame, reports: DataFrame, text_col: str, text: Column) -> DataFrame:
    """The given columns in their order with the new text, and the counts of ``_done``."""
    own = [c for c in reports.columns if c not in COUNTS]
    out = [(text if c == text_col else F.col("given").getField(c)).alias(c) for c in own]
    return result.select(*out, F.col("_done.lines").alias(COUNTS[0]), F.col("_done.removed").alias(COUNTS[1]))


def _told_apart(docs: DataFrame, places: DataFrame, again: DataFrame) -> DataFrame:
    """The places, whose bytes are compared where their print is in ``again``: a print that stands for different
    bytes gets the number of each after it. Their other columns stay."""
    def bodies(prints):
        wanted = places.join(prints.select("print"), "print").groupBy("_hash", "_row").agg(F.collect_set(F.struct("start", "size", "print")).alias("places"))
        held = let(F.split("text", "\n", -1), lambda lines: F.transform("places", lambda p: F.struct(
            p["print"].alias("print"), p["start"].alias("start"), F.array_join(F.slice(lines, p["start"] + 1, p["size"]), "\n").alias("body"))))
        return docs.join(wanted, ["_hash", "_row"]).select("_hash", "_row", F.explode(held).alias("b")).select("_hash", "_row", "b.*")

    mixed = cut_lineage(bodies(again).groupBy("print", "body").agg(F.lit(1).alias("one")).groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if mixed.isEmpty():
        return places
    held = bodies(mixed)
    number = held.select("print", "body").distinct().withColumn("n", F.row_number().over(Window.partitionBy("print").orderBy("body")))
    own = held.join(number, ["print", "body"]).select("_hash", "_row", "start", "print", F.concat("print", F.to_binary(F.col("n").cast("string"), F.lit("utf-8"))).alias("_own")).distinct()
    told = places.join(cut_lineage(own), ["_hash", "_row", "start", "print"], "left")
    return told.withColumn("print", F.coalesce("_own", "print")).select(*places.columns)


def drop_repeated_passages(reports: DataFrame, *, compare_bytes: bool = True, divisor: int = DIVISOR, id_col: str = "external_id",
                           text_col: str = "content_text") -> DataFrame:
    """The reports with every repeated passage of two lines or more cut out of ``content_text``; all columns
    stay, and ``n_lines`` and ``n_removed`` (lines before, and lines cut) are added or replaced.

    A line goes if it is one of two successive lines (none of them blank; blank lines between belong to
    them) that stand at an earlier place: in a report with a smaller id (null ids last), or
    before them in the same text without a line in common. So a run of equal lines goes from its first line
    to its last wherever it stands, and every line that goes stays at some earlier place; single repeated
    lines stay. Repeated chunks, and repeated pairs of lines at their edges, are compared byte for byte unless
    ``compare_bytes`` is false, which saves two shuffles of their texts; then 128 bits of their SHA-256 stand
    for the bytes. ``divisor`` is the mean number of lines in a chunk and changes no result.

    Rows that agree in id and text are one report: what is first in it stays in each. Null
    texts stay null with null counts; a text whose every line goes is empty. An empty table gives no rows.
    """
    docs, text = _carried(reports, id_col, text_col), F.col("text")
    cut = docs.select("_hash", "_row", F.explode(chunks(text, divisor)).alias("c")).select("_hash", "_row", "c.*")
    firsts = lambda places: (places.where("print is not null").groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_row", "start")).alias("first"))
                             .where("n > 1").select("print", "first"))
    # Stored, as are the further ones, so that the joins with them stand alone and a hot passage's rows can be split.
    def repeated(places):
        again = cut_lineage(firsts(places))
        told = _told_apart(docs, places, again) if compare_bytes else places
        return told, again if told is places else cut_lineage(firsts(told))

    cut, again = repeated(cut)
    later = F.coalesce(F.struct("_row", "start") != F.col("first"), F.lit(False))
    whole = F.array(F.struct("start", "size", F.lit(None).cast("binary").alias("print")))
    # A chunk that goes, or the pairs of one that does not; two lines in a chunk that goes are never the first of their kind.
    places = F.concat(F.when(later, whole).otherwise(F.col("inner")), F.when(F.col("seam").isNotNull(), F.array("seam")).otherwise(F.slice("inner", 1, 0)))
    places = cut_lineage(cut.join(again, "print", "left").select("_hash", "_row", F.explode(places).alias("p")).select("_hash", "_row", "p.*"))
    pairs, again = repeated(places.where("print is not null"))
    pairs = pairs.join(again, "print")
    pairs = pairs.where((F.col("_row") != F.col("first._row")) | (F.col("start") >= F.col("first.start") + F.col("size")))
    gone = places.where("print is null").select("_hash", "_row", "start", "size").unionAll(pairs.select("_hash", "_row", "start", "size"))
    gone = gone.groupBy("_hash", "_row").agg(F.collect_set(F.struct("start", "size")).alias("_gone"))
    cut = F.flatten(F.transform("_gone", lambda p: F.sequence(p["start"], p["start"] + p["size"] - 1)))

    def of_lines(lines):
        return let(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(cut, F.array().cast("array<int>"))), lambda kept: F.struct(
            F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"), F.size(lines).cast("long").alias("lines"),
            (F.size(lines) - F.size(kept)).cast("long").alias("removed")))

    result = docs.join(gone, ["_hash", "_row"], "left").withColumn("_done", F.when(text.isNotNull(), let(F.split(text, "\n", -1), of_lines)))
    return _with_text(result, reports, text_col, F.when(F.col("_gone").isNotNull(), F.col("_done.text")).otherwise(text))
