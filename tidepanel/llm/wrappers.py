"""Main text of report pages by wrappers inferred per host.

A page is a stream of block tokens: opening and closing block elements (with id, class and role)
and text slots. The pages of a host come from one template, so their streams are aligned one
after the other into a union-free regular expression: an element that only some pages have
becomes optional, neighbours of equal shape become one repeated group, and texts that differ
become slots, texts that never differ stay constants. The wrapper tells where the article
stands; a page is matched against its host's wrapper and gives the article's slots in order.
All different pages of a host form its wrapper: they are dealt into parts by their hash, each part
is folded in a task, and the parts' wrappers are merged, some at a time, until one is left.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Pages and bytes of html of a part that one task folds, and wrappers of parts that it merges.
PART_PAGES, PART_BYTES, MERGED_PARTS = 128, 8 << 20, 64
#: Hosts of several parts that may be sent to every task; beyond that joins move both sides.
SENT_HOSTS = 200_000
#: Constant texts of more characters stand in stored wrappers by a digest, which is shorter.
STORED_TEXT = 40
#: Elements that begin a block, elements without end, elements whose content is not text.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|title|noscript|template|textarea|iframe|noframes|svg|math|select|button|object|audio|video|canvas"
#: An open element that the start of another of the set ends.
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"},
            "th": {"td", "th", "tr", "tbody", "tfoot"}}
#: Elements, roles and words of id or class that are not part of an article.
ASIDE_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies
    disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination
    pager paywall popup promo promotion recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored
    subscribe subscription tags toolbar widget widgets""".split())
#: Of those words, the ones that say so of an article element too.
STRONG_WORDS = frozenset("ad ads advert advertisement comment comments promo related sponsored".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Bytes of paths that may be sent to every task; beyond that pages and paths are joined by a shuffle.
SENT_BYTES = 16 << 20
#: Open elements below which further ones stand side by side; neighbours that a pattern keeps apart.
DEEPEST, MOST_KIDS = 200, 200

TOKEN = re.compile(rf"""<!--(?:.*?-->|.*)|<(?P<raw>{RAW})(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*+>?(?:.*?</(?P=raw)\s*+>|.*)|<[!?][^>]*+>?
    |<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)""", re.I | re.S | re.X)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(id|class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+|\d+")


class Node:
    """A block element or (``sig`` empty) a text slot of a page."""

    __slots__ = ("sig", "kids", "text")

    def __init__(self, sig: str, text: str = ""):
        self.sig, self.kids, self.text = sig, [], text


def _signature(tag: str, attributes: str) -> str:
    found = sorted((k.lower(), " ".join(sorted(html.unescape(a or b or c).lower().split()))) for k, a, b, c in ATTRIBUTE.findall(attributes)) if "=" in attributes else ()
    return tag + "".join(f" {k}={v}" for k, v in found)


def parse(page: str) -> Node:
    """Tree of block elements; texts have their references decoded and white space folded."""
    root = Node("page")
    stack, run, at = [root], [], 0

    def flush():
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                stack[-1].kids.append(Node("", text))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            run.append(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() in ("button", "select", "textarea", "iframe", "svg", "object", "video", "audio", "canvas"):
                run.append(" ")
            continue
        tag = tag.lower()
        if tag not in BLOCKS:
            if tag == "br":
                run.append(" ")
            continue
        flush()
        names = [n.sig.split(" ", 1)[0] for n in stack]
        if m["end"]:
            if tag in names:
                del stack[len(names) - 1 - names[::-1].index(tag):]
                stack = stack or [root]
            continue
        while names[-1] in ENDED_BY and tag in ENDED_BY[names[-1]]:
            names.pop()
            stack.pop()
        node = Node(_signature(tag, m["attrs"]))
        stack[-1].kids.append(node)
        if tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)
    run.append(page[at:])
    flush()
    return root


class Pattern:
    """A wrapper's part: an element or slot, maybe optional or repeated. ``text`` is a slot's constant or None."""

    __slots__ = ("sig", "kids", "optional", "many", "text", "size")

    def __init__(self, sig, kids=(), optional=False, many=False, text=None, size=0):
        self.sig, self.kids, self.optional, self.many, self.text, self.size = sig, list(kids), optional, many, text, size

    def plain(self):
        text = self.text
        if text is not None and len(text) > STORED_TEXT:
            text = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        return [self.sig, [k.plain() for k in self.kids], self.optional, self.many, text, self.size]

    @classmethod
    def of(cls, plain):
        sig, kids, optional, many, text, size = plain
        return cls(sig, map(cls.of, kids), optional, many, text, size)

    def __str__(self):
        inner = "".join(map(str, self.kids))
        own = f"<{self.sig}>{inner}</>" if self.sig else "#" if self.text is None else repr(self.text)
        return f"({own})" + ("*" if self.optional and self.many else "+" if self.many else "?") if self.optional or self.many else own


def generalise(node: Node) -> Pattern:
    """The pattern of one page's element, equal neighbours folded."""
    if not node.sig:
        return Pattern("", text=node.text, size=len(node.text))
    return Pattern(node.sig, _folded([generalise(k) for k in node.kids]), size=1)


def _folded(kids: list[Pattern]) -> list[Pattern]:
    """Neighbours of equal signature become one repeated pattern; of a very long mixed run, all of equal signature."""
    out: list[Pattern] = []
    for kid in kids:
        if out and out[-1].sig == kid.sig:
            out[-1] = _merged(out[-1], kid)
            out[-1].many = True
        else:
            out.append(kid)
    if len(out) <= MOST_KIDS:
        return out
    by_sig: dict[str, Pattern] = {}
    for kid in out:
        held = by_sig.get(kid.sig)
        by_sig[kid.sig] = kid if held is None else _merged(held, kid)
        by_sig[kid.sig].many |= held is not None
    return list(by_sig.values())


def _merged(a: Pattern, b: Pattern) -> Pattern:
    text = a.text if a.text == b.text else None
    return Pattern(a.sig, align(a.kids, b.kids), a.optional or b.optional, a.many or b.many, text, a.size + b.size)


def align(wrapper: list[Pattern], other: list[Pattern]) -> list[Pattern]:
    """Align two sequences by their signatures: what both have is merged, a mismatch becomes optional."""
    n, m = len(wrapper), len(other)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if wrapper[i].sig == other[j].sig else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and wrapper[i].sig == other[j].sig:
            out.append(_merged(wrapper[i], other[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            wrapper[i].optional = True
            out.append(wrapper[i])
            i += 1
        else:
            other[j].optional = True
            out.append(other[j])
            j += 1
    return _folded(out)


def infer(pages: list[str]) -> Pattern:
    """The wrapper of a host's pages, aligned one after the other."""
    wrapper = None
    for page in dict.fromkeys(pages):
        other = generalise(parse(page))
        wrapper = other if wrapper is None else _merged(wrapper, other)
    return wrapper


def _words(sig: str):
    """(attribute kind, value, words) of a signature."""
    for attribute in re.split(r" (?=(?:id|class|role)=)", sig)[1:]:
        kind, _, value = attribute.partition("=")
        yield kind, value, {w for name in value.split() for w in WORD.findall(name)}


def aside(sig: str, in_article: bool) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or comment section.
    A header within the article is none: its headings belong to the article."""
    tag = sig.split(" ", 1)[0]
    if tag in ASIDE_TAGS or tag == "header" and not in_article:
        return True
    if tag in ("body", "html", "main", *HEADINGS):
        return False
    banned = STRONG_WORDS if tag == "article" else ASIDE_WORDS - {"header"} if in_article else ASIDE_WORDS
    return any(value in ASIDE_ROLES if kind == "role" else bool(words & banned) for kind, value, words in _words(sig))


def _header(sig: str) -> bool:
    return sig.split(" ", 1)[0] == "header" or any("header" in words for _, _, words in _words(sig))


def _is_article(sig: str) -> bool:
    return re.match(r"article\b|main\b", sig) is not None or "role=main" in sig or "role=article" in sig


def article_path(wrapper: Pattern) -> tuple[str, ...] | None:
    """Signatures down to the element that holds the article: an article or main element, else the
    element whose own blocks have most text that differs between pages."""
    found: list[tuple[int, int, tuple[str, ...]]] = []

    def walk(node, path, depth):
        own = 0
        for kid in node.kids:
            if not kid.sig:
                own += kid.size if kid.text is None or wrapper.size < 3 else 0  # constants of three pages or more are the template's
            elif not aside(kid.sig, False):
                size = walk(kid, (*path, kid.sig), depth + 1)
                own += size if kid.sig.split(" ", 1)[0] in ("p", "pre", "blockquote", "ul", "ol", "li", *HEADINGS) else 0
        if node.sig and aside(node.sig, True):
            return own
        found.append((2 if node.sig.startswith("article") or "role=article" in node.sig else 1 if _is_article(node.sig) else 0, own, path))
        return own

    walk(wrapper, (), 0)
    marked = [f for f in found if f[0]]
    if marked:
        top = max(f[0] for f in marked)
        return max((f for f in marked if f[0] == top), key=lambda f: f[1])[2]
    best = max(found, key=lambda f: f[1])
    return best[2] if best[1] else None


def extract(page: str, wrapper: Pattern) -> str:
    """Main text of a page under its host's wrapper: the article's blocks joined by blank lines."""
    return extract_at(page, article_path(wrapper))


def extract_at(page: str, path: tuple[str, ...] | None) -> str:
    """Main text of a page whose host has its articles at ``path``; where that does not fit, at the page's own."""
    tree = parse(page)
    if path is None or not _reach(tree, path):
        path = article_path(generalise(tree)) or ()
    blocks: list[str] = []

    def take(node, in_header):
        for kid in node.kids:
            if not kid.sig:
                if not in_header or node.sig.split(" ", 1)[0] in HEADINGS:
                    blocks.append(kid.text)
            elif not aside(kid.sig, True):
                take(kid, in_header or kid.sig.split(" ", 1)[0] not in HEADINGS and _header(kid.sig))

    for node in _reach(tree, path):
        take(node, False)
    return "\n\n".join(blocks)


def _reach(tree: Node, path: tuple[str, ...]) -> list[Node]:
    """All elements of a page at a path of signatures."""
    level = [tree]
    for sig in path:
        level = [kid for node in level for kid in node.kids if kid.sig == sig]
    return level


def host_wrappers(pages: DataFrame, *, id_col: str = "external_id", url_col: str = "source_url", html_col: str = "html", part_pages: int = PART_PAGES) -> DataFrame:
    """``host``, ``wrapper`` and ``path`` (JSON) of every host, from all its different pages. Pages without a
    url share the empty host. Parts and their order come from the pages alone, so the wrapper of a host does
    not depend on how its rows are dealt."""
    rows = _with_host(pages, id_col, url_col, html_col).where("html is not null").select("host", "html")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / part_pages), F.ceil(F.sum(F.octet_length("html")) / PART_BYTES)).cast("int")
    large = cut_lineage(rows.groupBy("host").agg(parts.alias("parts")).where("parts > 1"))
    hosts, left = large.agg(F.count(F.lit(1)), F.coalesce(F.max("parts"), F.lit(1))).first()
    large = F.broadcast(large) if hosts <= SENT_HOSTS else large

    def generalised(batches):
        for batch in batches:
            found = [json.dumps(generalise(parse(page)).plain()) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["host", "page", "wrapper"])

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for plain in pdf.sort_values("page")["wrapper"]:
            one = Pattern.of(json.loads(plain))
            whole = one if whole is None else _merged(whole, one)
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "part": pdf["part"].iloc[:1], "wrapper": [json.dumps(whole.plain())]})

    def with_path(batches):
        for batch in batches:
            paths = [json.dumps(article_path(Pattern.of(json.loads(plain)))) for plain in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.string())], ["host", "wrapper", "path"])

    schema = "host string, part int, wrapper string"
    each = rows.select("host", F.md5("html").alias("page"), "html").mapInArrow(generalised, "host string, page string, wrapper string").distinct()  # copies count once
    part = F.pmod(F.xxhash64("page"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    found = each.join(large, "host", "left").select("host", part, "page", "wrapper").groupBy("host", "part").applyInPandas(folded, schema)
    while left > 1:
        found = cut_lineage(found).select("host", F.floor(F.col("part") / MERGED_PARTS).cast("int").alias("part"), F.col("part").alias("page"), "wrapper")
        found = found.groupBy("host", "part").applyInPandas(folded, schema)
        left = -(-left // MERGED_PARTS)
    return found.select("host", "wrapper").mapInArrow(with_path, "host string, wrapper string, path string")


def _with_host(pages, id_col, url_col, html_col):
    url = pages[url_col].cast("string")
    host = F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    return pages.select(pages[id_col].alias("key"), url.alias("url"), pages[html_col].cast("string").alias("html"), host.alias("host"))


def extract_articles(pages: DataFrame, *, id_col: str = "external_id", url_col: str = "source_url", html_col: str = "html") -> DataFrame:
    """Main text of every whole page: ``external_id``, ``source_url``, ``content_text``.

    Null html is empty and gives an empty text, as does a page without an article. Null ids and urls
    are carried; repeated pages give a row each; further columns are ignored; an empty table gives no
    rows. A page that its host's wrapper does not fit is extracted by its own pattern.
    """
    rows = _with_host(pages, id_col, url_col, html_col)
    found = cut_lineage(host_wrappers(pages, id_col=id_col, url_col=url_col, html_col=html_col).select("host", "path"))
    size = found.agg(F.sum(F.octet_length("path") + F.octet_length("host"))).first()[0] or 0
    found = F.broadcast(found) if size <= SENT_BYTES else found  # pages stay where they are while the paths are few
    joined = rows.join(found, "host", "left").select("key", "url", "html", "path")
    schema = T.StructType([T.StructField("external_id", rows.schema["key"].dataType), T.StructField("source_url", T.StringType()), T.StructField("content_text", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = ["" if path is None else extract_at(page or "", json.loads(path)) for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema.names)

    return joined.mapInArrow(run, schema)
