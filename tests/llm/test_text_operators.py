"""Byte BPE, secret scan, line dedup, language profiles and packing against the libraries and brute force."""

import base64
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers as vocabularies
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidepanel.llm import bpe, language, lines, packing, secrets

RANKS = vocabularies.path("byte_bpe_multi_50k.tiktoken")
MODEL = vocabularies.path("byte_bpe_50k.json")
SCHEMA = "external_id long, source string, content_text string, language string, n_tokens int, spans string, row int"
ODD = [None, "", " ", "\n", "a", "ab\nab\nab", "é" * 300, "x" * 60_000, "  two  blanks \t\n\n ", "\x00\x1c\x85 中文 😀", "it's 12,5 %"]


def reports(spark, texts, ids=None, langs=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, None, t, (langs or [None] * len(texts))[n], 7, "clash", 1) for n, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


@pytest.fixture(scope="module")
def coder():
    return bpe.BytePairCoder(open(RANKS, "rb").read(), vocabularies.PATTERN)


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abehint .,\n'sé中😀09\x85\xa0") | st.characters(codec="utf-8"), max_size=60))
def test_bpe_ids_equal_the_merge_procedure(coder, oracle, text):
    packed = coder.encode(text)
    assert list(memoryview(packed).cast("I")) == oracle.encode_ordinary(text)
    assert coder.decode(packed) == text.encode()


def test_bpe_long_pieces_take_linear_time(coder, oracle):
    text = "ab" * 3000 + "a" * 4001 + "!" * 999
    assert list(memoryview(coder.encode(text)).cast("I")) == oracle.encode_ordinary(text)
    assert coder.decode(coder.encode("a" * 400_000)) == b"a" * 400_000


def test_bpe_reports(spark, oracle):
    table = reports(spark, ODD + ODD[5:6], ids=[None, *range(1, len(ODD)), 5])
    tokens = bpe.encode_reports(table, RANKS, vocabularies.PATTERN)
    rows = bpe.decode_reports(tokens, RANKS, vocabularies.PATTERN).collect()
    assert tokens.columns == ["external_id", "n_tokens", "token_ids"] and len(rows) == len(ODD) + 1
    got = Counter((r.external_id, tuple(memoryview(bytes(r.token_ids)).cast("I")), bytes(r.content_bytes)) for r in rows)
    want = Counter((i, tuple(oracle.encode_ordinary(t or "")), (t or "").encode()) for i, t in zip([None, *range(1, len(ODD)), 5], ODD + ODD[5:6]))
    assert got == want
    assert bpe.encode_reports(table.limit(0), RANKS, vocabularies.PATTERN).collect() == []


SECRETS = ["password=hunter2secret", "my API-key apikey : 'abc' token=\"0123456789abcdef0123456789\"", "AKIA" + "Z" * 16 + " AKIA1 AKIA", "deadbeef" * 4, "Password = short",
           "pas swd=xxxxxxx", "PASSWD:aaaaaa,secret=bbbbbbb", "toKen='" + "f" * 30, "é" * 10 + "secret: abcdef", "ſecret=abcdefg paſſword=abcdefg"]


def brute_spans(text):
    out = []
    for order, (expression, least, group) in enumerate([
            (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), (r"AKIA[A-Z0-9]+", 20, 0), (r"[0-9a-f]+", 24, 0)]):
        flags = re.A | re.I if order == 0 else re.A
        out += [(m.start(), order, m.end()) for m in re.finditer(expression, text or "", flags) if len(m[group]) >= least]
    return [(("assign", "access", "hex")[o], s, e) for s, o, e in sorted(out)]


def test_secrets_equal_brute_force(spark):
    texts = SECRETS + ODD
    rows = secrets.scan_reports(reports(spark, texts)).collect()
    assert {r.external_id: [tuple(s) for s in r.spans] for r in rows} == {i: brute_spans(t) for i, t in enumerate(texts)}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = secrets.scan_reports(docs, id_col="doc_id", text_col="text").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.external_id: [tuple(s) for s in r.spans] for r in found} == {i: brute_spans(t) for i, t in texts.items()} and any(r.spans for r in found)
    assert secrets.scan_reports(docs.limit(0), id_col="doc_id", text_col="text").collect() == []


def test_trigram_queries_hold_for_every_match():
    query = secrets.trigram_query(secrets.RULES[0].pattern)
    assert query is not secrets.ALL and secrets.trigram_query(r"[0-9a-f]+") is secrets.ALL
    assert secrets.trigram_query("abcd|xyz") == ("or", (("and", (("tri", "abc"), ("tri", "bcd"))), ("tri", "xyz")))
    for text in SECRETS:
        postings = {g: {0} if g in text.lower() else set() for g in secrets.trigrams(query)}
        if any(k == "assign" for k, *_ in brute_spans(text)):
            assert 0 in secrets.candidates(query, postings, range(1))


def test_index_holds_the_queried_trigrams():
    texts = SECRETS + ["", "to", "tok", "xTOKen", "İtoken", "aaa" * 50]
    wanted = {"tok", "oke", "aaa", "kia"}
    got = secrets.inverted_index(texts, wanted)
    assert got == {g: {i for i, t in enumerate(texts) if g in t.lower()} for g in wanted}


def test_redaction_masks_spans_only(spark):
    table = reports(spark, SECRETS + [None, "clean text"])
    out = {r.external_id: r for r in secrets.redact_reports(table).collect()}
    assert out[len(SECRETS)].content_text is None and out[len(SECRETS) + 1].content_text == "clean text"
    assert out[0].content_text == "[assign]" and out[0].spans == "clash" and not any(brute_spans(r.content_text) for r in out.values())


def brute_passages(rows):
    places = defaultdict(list)
    for i, text in set(rows):
        split = (text or "").split("\n")
        full = [n for n, x in enumerate(split) if x.strip()]
        for a, b in zip(full, full[1:]):
            places["\n".join(split[a:b + 1])].append(((i is None, i or 0), text, a, b))
    cut = defaultdict(set)
    for found in places.values():
        first = min(found, key=lambda p: (p[0], p[2]))
        for row, text, a, b in found:
            if (row, text) != first[:2] or a > first[3]:
                cut[row, text] |= set(range(a, b + 1))
    return Counter((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in cut[(i is None, i or 0), t]), None if t is None else len(cut[(i is None, i or 0), t])) for i, t in rows)


def passage_counts(spark, rows, **options):
    got = lines.drop_repeated_passages(spark.createDataFrame(rows, "external_id long, content_text string"), **options)
    return Counter(map(tuple, got.select("external_id", "content_text", "n_removed").collect()))


def test_planted_passages_go_whole(spark):
    planted = ["\n".join(f"passage {p} line {n} " + " ".join(f"w{p}x{n}x{k}" for k in range(30)) for n in range(p)) for p in range(2, 9)]
    rows = [(p, f"before {p}\n{x}\nafter {p}") for p, x in enumerate(planted)]
    rows += [(100 + 10 * p + c, f"one {p} {c}\ntwo {p} {c}\n{x}\nthree {p} {c}") for p, x in enumerate(planted) for c in range(3)]
    want = Counter({(i, t, 0): 1 for i, t in rows[:7]}) + Counter((100 + 10 * p + c, f"one {p} {c}\ntwo {p} {c}\nthree {p} {c}", p + 2) for p in range(7) for c in range(3))
    assert passage_counts(spark, rows) == want


def test_passages_equal_brute_force(spark, sf):
    rows = [(3, "a\n\nb\nc"), (None, "a\n\nb\nc"), (1, "x\na\n\nb\n"), (1, "x\na\n\nb\n"), (2, "a\nb"), (4, "r\nr\nr"), (5, "s\ns\ns\ns"), (6, "a\n\n"), (7, None), (8, ""), (9, "\n \n")]
    assert passage_counts(spark, rows) == brute_passages(rows)
    passage = "\n".join(f"shared line {n}" for n in range(40))
    texts = [passage, "own\n" + passage + "\ntail", None, "one line", "a\n\n\nb", passage + "\n" + passage, "one line", passage, "\n".join(["x"] * 3000), passage.replace("line 7", "word 7")]
    for ids in (list(range(len(texts))), [3, None, 2, 1, 0, 9, 8, 3, 6, None]):
        for options in ({}, {"compare_bytes": False}, {"divisor": 2}, {"divisor": 1000}):
            assert passage_counts(spark, list(zip(ids, texts)), **options) == brute_passages(list(zip(ids, texts))), options
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_passages(docs)
    assert passage_counts(spark, docs) == want == passage_counts(spark, docs, compare_bytes=False) and sum(n or 0 for _, _, n in want) > 0
    plan = lines.drop_repeated_passages(reports(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and lines.drop_repeated_passages(reports(spark, ODD).limit(0)).collect() == []


def test_equal_fingerprints_of_different_chunks_cut_nothing_wrong(spark, monkeypatch):
    """Chunks whose fingerprints collide are told apart by their bytes; their pairs of lines still go where they repeat."""
    whole = lines._print
    def weak(body):
        return lines.F.when(lines.F.regexp_count(body, lines.F.lit("\n")) > 1, lines.F.lit(b"same")).otherwise(whole(body))
    monkeypatch.setattr(lines, "_print", weak)
    rows = [(i, "\n".join(f"text {i % 5} line {n}" for n in range(30))) for i in range(10)]
    assert passage_counts(spark, rows) == brute_passages(rows)


@pytest.mark.parametrize("weak", [lambda body: lines.F.when(body.isNotNull(), lines.F.lit(b"same")), lambda body: lines.F.substring(body, -1, 1).cast("binary")])
def test_equal_fingerprints_of_different_pairs_of_lines_cut_nothing_wrong(spark, monkeypatch, weak):
    """Pairs of lines whose fingerprints collide are compared as chunks are: only equal bytes go."""
    monkeypatch.setattr(lines, "_print", weak)
    passage = "\n".join(f"shared line {n}" for n in range(12))
    rows = [(1, "a\nb\n\nc"), (2, "a\nb\nc"), (3, "x\nb\n\nc\ny"), (4, passage), (5, "own\n" + passage + "\ntail"), (6, passage.replace("line 7", "word 7")), (7, "r\nr\nr\nr\nr"), (8, None), (9, "one")]
    assert passage_counts(spark, rows) == brute_passages(rows)


def test_pieces_cover_the_lines_and_end_alike_in_shifted_copies(spark):
    passage = "\n".join(f"line {n} of a passage" for n in range(60))
    table = spark.createDataFrame([(0, passage), (1, "x\n\ny\n" + passage + "\nz")], "id int, t string").select(lines.chunks(lines.F.col("t")).alias("c"), "id")
    one, two = (r.c for r in table.orderBy("id").collect())
    assert [c.start for c in one] == [0] + [c.start + c.size for c in one][:-1] and one[-1].start + one[-1].size == 60 and one[-1].seam is None
    assert all(len(c.inner) == c.size - 1 for c in one) and sum(c.size > 1 for c in one) > 5
    assert {(c.start + 3, c.print and bytes(c.print)) for c in one[1:-1]} <= {(c.start, c.print and bytes(c.print)) for c in two}


def test_line_dedup_keeps_clashing_columns(spark):
    passage = "\n".join(f"line {n} of a passage" for n in range(40))
    names = ["_row", "_hash", "given", "text", "external_id", "_gone", "content_text", "_done", "start", "print", "a.b", "n_lines"]
    rows = [tuple({"external_id": i, "content_text": t, "n_lines": "old"}.get(c, f"{c} {i}") for c in names) for i, t in enumerate([passage, "x\n" + passage, None])]
    got = lines.drop_repeated_passages(spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'external_id' else 'string'}" for c in names)))
    assert got.columns == names[:-1] + ["n_lines", "n_removed"]
    found = sorted(got.collect(), key=lambda r: r.external_id)
    assert [r.n_lines for r in found] == [40, 41, None] and found[0].n_removed == 0 and found[1].n_removed >= 30
    for i, r in enumerate(found):
        assert all(r[c] == f"{c} {i}" for c in names[:-1] if c not in ("external_id", "content_text"))



def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs.collect()]
    table = spark.createDataFrame(rows, "external_id long, content_text string, given string, held boolean")
    profiles = language.language_profiles(table.where("not held"), language_col="given")
    got = language.predict_language(table, profiles, keep=["given", "held"]).where("held").collect()
    assert len(got) > 200 and sum(r.language == r.given for r in got) / len(got) > 0.97 and all(0 <= r.similarity <= 1 for r in got)


def test_language_odd_rows(spark):
    table = reports(spark, ["the cat and the hat", "le chat et la souris", *ODD, "123 $$"], langs=["en", "fr"] + [None] * (len(ODD) + 1))
    profiles = language.language_profiles(table)
    out = {r.external_id: r for r in language.predict_language(table, profiles).collect()}
    assert len(out) == len(ODD) + 3 and out[0].language == "en" and out[1].language == "fr"
    assert [out[i].language for i in (2, 3, 4, 5, len(ODD) + 2)] == ["und"] * 5 and out[2].similarity == 0
    assert language.language_profiles(table.where("language is null")).collect() == []
    assert {r.language for r in language.predict_language(table, profiles.limit(0)).collect()} == {"und"}
    assert language.predict_language(table.limit(0), profiles).collect() == []
    small = language.language_profiles(reports(spark, ["abc def"] * 400, langs=["en"] * 400), most=50).first()
    assert 10 < small.n_reports < 150


def test_packing_is_gapless_and_exact(spark, sf):
    tokenizer = Tokenizer.from_file(MODEL)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = docs + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (20_000, "<|endoftext|> as text"), (20_001, "é<|endoftext|>中"), (20_002, "hello <|endoftext|> world")]
    assert tokenizer.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    got = packing.pack_reports(spark.createDataFrame(rows, "external_id long, content_text string").repartition(3), MODEL).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        ids = list(memoryview(bytes(r.token_ids)).cast("I"))
        assert ids == want[r.external_id][r.start:r.start + r.length] and r.report_tokens == len(want[r.external_id])
        pieces[r.external_id].append((r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for held, totals in ((pieces, {k: len(v) for k, v in want.items()}), (bins, None)):
        for key, parts in held.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at and n > 0
                at += n
            assert at == totals[key] if totals else at <= 1024
    assert sum(map(len, want.values())) / (1024 * len(bins)) > 0.98
    assert packing.pack_reports(reports(spark, ODD).limit(0), MODEL).collect() == []


@given(st.integers(1, 5000), st.sampled_from([8, 24, 64]))
def test_cut_lengths_fill_their_class(total, slack):
    parts = packing.cut_lengths(total, 1024, slack)
    assert sum(parts) == total and all(1024 - 1024 // n * n <= max(slack, 1024 // n) for n in parts)


def test_repeated_rows_are_packed_each(spark):
    got = packing.pack_reports(reports(spark, ["same text"] * 5, ids=[1] * 5), MODEL).collect()
    assert len(got) == 5 and struct.unpack("<I", bytes(got[0].token_ids)[-4:]) == (0,)
