"""WARC archives by round trip and page wrappers on hand-made templates."""

import hashlib
import io
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm import archive, wrappers

FIELDS = "external_id long, source_url string, html string, payload string, digest int, host string"
BIG = "<html><body><p>" + "text " * 300 + "</p></body></html>"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], FIELDS)


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a.example/x y", BIG), (2, None, BIG), (7, "http://b.example/é\r\nWARC-Type: x", BIG), (3, "http://a.example/", "short"), (4, "http://a.example/a%20b?c=%C3%A9", "short"), (40, "", "short"),
            (5, "u", None), (6, "u", ""), (None, "u", BIG), (8, "u", "é😀\r\n\r\nWARC/1.1\r\n" * 200), (9, "u", "é😀\r\n\r\nWARC/1.1\r\n" * 200), (7, "again", BIG)]
    listed = archive.write_archives(pages(spark, rows).repartition(3), f"file://{tmp_path}/archives")
    got = archive.read_archives(listed, T.LongType()).collect()
    assert len(got) == len(rows) and sum(r.n_records for r in listed.collect()) == len(rows)
    for key, _, html in rows:
        data = (html or "").encode()
        last = {BIG.encode(): 7, rows[-2][2].encode(): 9}.get(data)
        for r in (r for r in got if r.external_id == key):
            assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
            assert (r.record_type, r.refers_to) == (("response", None) if last in (None, key) else ("revisit", last))
            assert (bytes(r.payload) == data) if r.record_type == "response" else r.payload is None
    assert {r.source_url for r in got} == {u for _, u, _ in rows}


def test_archives_of_null_ids_and_nothing(spark):
    listed = archive.write_archives(pages(spark, [(None, "u", BIG), (None, "u", BIG)]))
    assert [r.record_type for r in archive.read_archives(listed, T.LongType()).collect()] == ["response"] * 2
    listed = archive.write_archives(pages(spark, [(1, "u", "x")]).limit(0))
    assert listed.collect() == [] and archive.read_archives(listed, T.LongType()).collect() == []


def test_each_archive_is_read_by_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(archive, "ARCHIVE_BYTES", 1)
    listed = archive.write_archives(pages(spark, [(i, "u", f"page {i}") for i in range(40)]).repartition(4))
    assert listed.count() == 40
    got = archive.read_archives(listed, T.LongType())
    held = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(held) >= 35 and max(held) <= 2 and sum(held) == 40


def test_records_are_frames_under_an_embedded_dictionary():
    records = [archive.warc_record(i, "u", (BIG + str(i)).encode(), hashlib.sha1((BIG + str(i)).encode()).hexdigest(), None, False, "1970-01-01T00:00:00Z") for i in range(900)]

    class Kept(io.BytesIO):
        def close(self):
            self.data = self.getvalue()

    stream = Kept()
    writer = archive.ArchiveWriter(stream)
    for r in records:
        writer.add(r)
    writer.close()
    assert stream.data[:4] == b"\x5d\x2a\x4d\x18" and int.from_bytes(stream.data[4:8], "little") > 0
    assert stream.data.count(b"\x28\xb5\x2f\xfd") >= 900 and len(stream.data) < sum(map(len, records)) / 4
    assert [f["WARC-Record-ID"] for f, _ in archive.archive_records(io.BytesIO(stream.data))] == [archive.record_urn(i) for i in range(900)]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class="has-sidebar"><header><a href=/>Logo</a></header>
<div id="cookie-notice">We use cookies</div><nav><ul><li>Home<li>News</ul></nav><div class="content"><div class="post-header"><h1>Title &amp; {n}</h1><span>by x</span></div>
<p>First  {n}<br>line &eacute;.</p><div class="ad-slot">buy {n}</div>{extra}<form><input>Mail</form><ul><li>one {n}<li>two</ul><p><b>Last {n} &lt;end&gt;
<section id="comments"><h3>Comments</h3><p>nice {n}</p></section></div><aside>side {n}</aside><footer>&copy; {n}</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_wrapper_has_slots_repeats_and_optionals():
    sources = [PAGE.format(n=i, extra="<blockquote>said</blockquote>" if i % 2 else "") for i in range(6)]
    wrapper = wrappers.infer(sources)
    text = str(wrapper)
    assert "(<blockquote>'said'</>)?" in text and "(<li>#</>)+" in text and "'Logo'" in text
    assert wrappers.article_path(wrapper)[-1] == "div class=content"
    assert wrappers.extract(sources[1], wrapper) == "Title & 1\n\nFirst 1 line é.\n\nsaid\n\none 1\n\ntwo\n\nLast 1 <end>"


def test_all_pages_of_a_host_form_its_wrapper(spark):
    """The block that stands alike on most pages differs on a few, so it is text of the page: no twelve pages tell."""
    page = "<div class=x><p>{long}</p></div><div class=y><p>no {n}</p></div>{rare}"
    sources = [page.format(n=i, long="one and the same long text " * 4 + ("x" * i if i % 100 == 7 else ""), rare="<dl><dd>rare</dl>" if i == 250 else "") for i in range(400)]
    rows = [(i, f"http://h.example/{i}", text) for i, text in enumerate(sources)] + [(1000 + i, f"http://h.example/c{i}", sources[0]) for i in range(50)]
    found = [{tuple(r) for r in wrappers.host_wrappers(pages(spark, dealt), part_pages=5).select("host", "wrapper", "path").collect()}
             for dealt in (rows, rows[::-1])]
    assert found[0] == found[1] and len(found[0]) == 1
    (_, plain, path), = found[0]
    whole = wrappers.Pattern.of(json.loads(plain))
    assert whole.size == len(set(sources)) == 400 and "dl" in str(whole) and json.loads(path)[0] == "div class=x"
    texts = {r.external_id: r.content_text for r in wrappers.extract_articles(pages(spark, rows)).collect()}
    assert len(texts) == len(rows) and all(texts[i] == " ".join(("one and the same long text " * 4 + ("x" * i if i % 100 == 7 else "")).split()) for i in range(400))


def test_articles_of_a_table(spark):
    article = "<nav>menu</nav><article><h1>A {n}</h1><p>b {n}<p>c &amp d<article class='comment'>reader</article><footer>f</footer></article><div class=ad>x</div>"
    rows = [(i, f"http://h.example/{i}", article.format(n=i)) for i in range(30)]
    rows += [(100, "http://odd.example/", None), (101, None, ""), (None, "not a url", "<p>only <i>this</i> text</p>"), (103, "http://h.example/z", "<div><p>no article here"), (5, "http://h.example/5", article.format(n=5)),
             (104, "http://long.example", "<article>" + "<p>word</p>" * 10_000 + "<div>x</div><p>word</p>" * 10_000 + "<div>" * 3000), (105, "http://x.example", "<p title='unclosed"), (106, "http://x.example", "1 < 2 &am")]
    got = wrappers.extract_articles(pages(spark, rows))
    assert got.columns == ["external_id", "source_url", "content_text"]
    out = got.collect()
    texts = {r.external_id: r.content_text for r in out}
    assert len(out) == len(rows) and texts[3] == "A 3\n\nb 3\n\nc & d" and texts[100] == texts[101] == "" and texts[None] == "only this text"
    assert texts[103] == "no article here" and texts[104].count("word") == 20_000 and texts[106] == "1 < 2 &am"
    assert wrappers.extract_articles(pages(spark, rows).limit(0)).collect() == []


def test_given_pages_keep_their_articles(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id as external_id", "url as source_url", "html")
    html = {r.external_id: r.html for r in table.collect()}
    for r in wrappers.extract_articles(table).collect():
        inner = (html[r.external_id] or "").partition("<article>")[2].partition("</article>")[0].partition("<footer")[0]
        assert bool(r.content_text) == bool(inner) and all(word in inner for word in r.content_text.replace("&", " ").split()[:3])
