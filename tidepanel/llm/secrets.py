"""Secret scan over report texts with a trigram index.

Each rule is a regular expression. From its parse tree the trigrams that any match must hold
are derived as a Boolean query (AND along a sequence, OR over alternatives). Every task keeps
an inverted index of the queried trigrams over its own block of reports, intersects and unites
the postings and verifies only the candidates with the expression. Rules without a mandatory
trigram scan all reports of the block. Reports never move.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tasks import text_slices

#: Strings kept while spelling out a part of an expression; beyond that the part is not spelt out.
MOST_SPELLINGS = 64
ALL = True


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int
    group: int = 0


#: The kinds in their order, with pattern and least length.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)


def both(queries):
    parts = [q for q in queries if q is not ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def either(queries):
    queries = tuple(dict.fromkeys(queries))
    if ALL in queries:
        return ALL
    terms = {q: set(q[1]) if q[0] == "and" else {q} for q in queries}
    queries = tuple(q for q in queries if not any(terms[p] < terms[q] for p in queries))  # A or (A and B) is A
    return queries[0] if len(queries) == 1 else ("or", queries)


def _held(strings: set[str]):
    """Query of a text that holds one of the strings."""
    return either(both(("tri", s[i:i + 3]) for i in range(len(s) - 2)) for s in sorted(strings)) if strings else ALL


def _spelt(op, arg) -> set[str] | None:
    """All strings of a node in lower case, or None if there are too many."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
        return {chr(c).lower() for _, c in arg}
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}
    if name == "SUBPATTERN":
        return _spelt_all(arg[3])
    if name == "BRANCH":
        parts = [_spelt_all(p) for p in arg[1]]
        out = None if None in parts else set().union(*parts)
    elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 4:
        one, out = _spelt_all(arg[2]), None
        if one is not None and len(one) ** int(arg[1]) <= MOST_SPELLINGS:
            out = {"".join(x) for n in range(arg[0], int(arg[1]) + 1) for x in product(sorted(one), repeat=n)}
    else:
        return None
    return out if out is not None and len(out) <= MOST_SPELLINGS else None


def _spelt_all(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        part = _spelt(op, arg)
        if part is None or len(part) * len(out) > MOST_SPELLINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _query(nodes):
    """Boolean trigram query of a sequence of nodes."""
    found, run = [], {""}
    for op, arg in nodes:
        part = _spelt(op, arg)
        if part is not None and len(part) * len(run) <= MOST_SPELLINGS:
            run = {a + b for a in run for b in part}
            continue
        found.append(_held(run))
        run = part if part is not None else {""}
        name = str(op)
        if part is None and name == "SUBPATTERN":
            found.append(_query(arg[3]))
        elif part is None and name == "BRANCH":
            found.append(either(_query(p) for p in arg[1]))
        elif part is None and name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            found.append(_query(arg[2]))
    return both([*found, _held(run)])


def trigram_query(pattern: str):
    """Boolean query over lower-case trigrams that every text with a match satisfies; ``ALL`` if
    the expression has no mandatory trigram."""
    return _query(_parser.parse(pattern))


def trigrams(query) -> set[str]:
    if query is ALL:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


def candidates(query, postings: dict[str, set[int]], everyone: range):
    """Ordinals of the block that satisfy the query."""
    if query is ALL:
        return everyone
    if query[0] == "tri":
        return postings[query[1]]
    parts = [set(candidates(q, postings, everyone)) for q in query[1]]
    return set.intersection(*sorted(parts, key=len)) if query[0] == "and" else set.union(*parts)


def find(rule: Rule, expression: re.Pattern, text: str):
    for m in expression.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.start(), m.end()


def inverted_index(texts: list[str], wanted: set[str]) -> dict[str, set[int]]:
    """Postings of the queried trigrams: the trigrams of each text, in lower case, are listed once and looked up."""
    letters = {tuple(g): g for g in wanted}
    queried = frozenset(letters)
    postings = {g: set() for g in wanted}
    for i, text in enumerate(texts):
        low = text.lower()
        for g in queried.intersection(zip(low, low[1:], low[2:])):
            postings[letters[g]].add(i)
    return postings


class BlockScanner:
    """The rules with their expressions and trigram queries, applied to a block of texts at a time."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.plans = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.wanted = set().union(*(trigrams(query) for *_, query in self.plans))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, order of the rule, end) of each text's secrets, by start and then by order."""
        postings = inverted_index(texts, self.wanted)
        out: list[list] = [[] for _ in texts]
        for order, (rule, expression, query) in enumerate(self.plans):
            for i in candidates(query, postings, range(len(texts))):
                out[i] += [(start, order, end) for start, end in find(rule, expression, texts[i])]
        return [sorted(x) for x in out]


def scan_reports(reports: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "external_id", text_col: str = "content_text") -> DataFrame:
    """Secrets of every whole ``content_text``: ``external_id`` and ``spans``, an array of
    (kind, start, end) in code points, end exclusive, by start and then by the order of ``rules``.

    Matches of a rule are leftmost and do not overlap; those too short are dropped after matching.
    A null text counts as empty; every row gives one row, repeated rows and null ids included;
    further columns are ignored; an empty table gives no rows. Needs no shuffle.
    """
    source = reports.select(reports[id_col].alias("external_id"), reports[text_col].cast("string").alias("content_text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([source.schema["external_id"], T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        scanner = BlockScanner(rules)
        for batch in batches:
            for rows, texts in text_slices(batch, 1):
                out = [[{"kind": rules[o].kind, "start": s, "end": e} for s, o, e in x] for x in scanner.spans(texts)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, kind)], ["external_id", "spans"])

    return source.mapInArrow(run, schema)


def redact_reports(reports: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "external_id", text_col: str = "content_text") -> DataFrame:
    """The reports with each character run covered by a secret replaced by ``[kind]`` (of the span that begins first).

    All columns stay, in order; null texts stay null. Rows are rewritten in place without a shuffle.
    """
    at, schema = reports.columns.index(text_col), reports.schema

    def run(batches):
        scanner = BlockScanner(rules)
        for batch in batches:
            for rows, texts in text_slices(batch, at):
                null = rows.column(at).is_null().to_pylist()
                clean = [None if gone else _masked(t, spans, rules) if spans else t for gone, t, spans in zip(null, texts, scanner.spans(texts))]
                columns = list(rows.columns)
                columns[at] = pa.array(clean, rows.column(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return reports.mapInArrow(run, schema)


def _masked(text: str, spans, rules) -> str:
    out, done = [], 0
    for start, order, end in spans:
        if start >= done:
            out += [text[done:start], f"[{rules[order].kind}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])
