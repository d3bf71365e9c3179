"""Registered queries of the numbered operators: thin steps from the given tables to the operators
and from their results to the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive, bpe, jaccard, language, lines, negatives, neighbours, packing, secrets, suffixes, topk, whitening, wrappers

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as research reports."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select(F.col("doc_id").alias("external_id"), "source", F.col("text").alias("content_text"), F.col("lang").alias("language"))


@query
def op1_byte_bpe(spark, sf):
    """Ids and decoded bytes of every report under the many-language vocabulary."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.decode_reports(bpe.encode_reports(reports(spark, sf), path, pattern), path, pattern)
    return tokens.select(F.col("external_id").alias("doc_id"), "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                         F.sha2("content_bytes", 256).alias("decoded_sha256"))


@query
def op2_secret_scan(spark, sf):
    """Secrets of every report: counts per kind and spans."""
    found = secrets.scan_reports(reports(spark, sf))
    texts = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("external_id").alias("doc_id"), count("assign"), count("access"), count("hex"),
                        F.sha2(texts, 256).alias("base_sha256"), texts.alias("spans"))


@query
def op4_line_dedup(spark, sf):
    """Reports without the multi-line passages that an earlier report holds."""
    out = lines.drop_repeated_passages(reports(spark, sf).select("external_id", "content_text"))
    return out.select(F.col("external_id").alias("doc_id"), F.col("content_text").alias("text"), "n_lines", "n_removed")


@query
def op5_language_id(spark, sf):
    """Language of every report, learnt from the reports that are not held out."""
    held = F.coalesce(F.crc32(F.col("external_id").cast("string")) % 4 == 2, F.lit(False))
    docs = reports(spark, sf).withColumn("held_out", held)
    profiles = language.language_profiles(docs.where("not held_out"))
    out = language.predict_language(docs.withColumnRenamed("language", "given"), profiles, keep=["external_id", "held_out"])
    return out.select(F.col("external_id").alias("doc_id"), "held_out", F.col("language").alias("lang_pred"), F.col("similarity").alias("score"))


@query
def op6_ngram_jaccard(spark, sf):
    """Groups of reports whose sets of four-word shingles have a similarity of 0.85 or more."""
    out = jaccard.near_duplicates(reports(spark, sf), words=4, percent=85)
    return out.select(F.col("external_id").alias("doc_id"), F.col("n_tokens").alias("n_shingles"), F.col("group_id").alias("component_id"))


@query
def op9_harmonic_packing(spark, sf):
    """All reports packed into sequences of 1024 tokens."""
    out = packing.pack_reports(reports(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("external_id").alias("doc_id"), "start", "length", F.crc32("token_ids").alias("ids_crc32"),
                      F.col("report_tokens").alias("doc_tokens"), "sequence_id", "offset")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages as crawled report pages."""
    table = spark.read.parquet(f"{sf}/pages.parquet")
    return table.select(F.col("page_id").alias("external_id"), F.col("url").alias("source_url"), "html")


@query
def op7_warc(spark, sf):
    """A record per page, written to archives and read back."""
    source = pages(spark, sf)
    found = archive.read_archives(archive.write_archives(source), source.schema["external_id"].dataType, payloads=False)
    return found.select(F.col("external_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_html_extraction(spark, sf):
    """Main text of every page."""
    found = wrappers.extract_articles(pages(spark, sf))
    return found.select(F.col("external_id").alias("page_id"), F.col("source_url").alias("url"), F.col("content_text").alias("text"),
                        F.length("content_text").cast("long").alias("n_chars"))


def exposures(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as exposure vectors."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    return table.select(F.col("vec_id").alias("ts_code"), F.col("embedding").alias("features"))


def _as_hits(found: DataFrame) -> DataFrame:
    return found.select(F.col("query_code").alias("query_id"), "rank", F.col("ts_code").alias("vec_id"), "score")


@query
def op3_neighbours(spark, sf):
    """Twenty near neighbours of every twentieth vector among all others."""
    rows = exposures(spark, sf)
    return _as_hits(neighbours.nearest_stocks(rows, rows.where("ts_code % 20 = 0"), k=20))


@query
def op10_exact_topk(spark, sf):
    """Twenty highest integer inner products of every twentieth vector among all others."""
    return _as_hits(topk.top_exposures(exposures(spark, sf), "ts_code % 20 = 0", k=20, scale=64))


@query
def op11_whitening(spark, sf):
    """All vectors on the components of their covariance, with unit variance."""
    out = whitening.whitened_exposures(exposures(spark, sf), components=32, scale=64)
    return out.select(F.col("ts_code").alias("vec_id"), "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error",
                      F.col("deviation").alias("deviation_exact"))  # the same where it is no long


@query
def op12_hard_negatives(spark, sf):
    """Ten vectors of other labels that come close to each of an anchor's five best ones."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select(F.col("vec_id").alias("ts_code"), label.alias("industry"), F.col("embedding").alias("features"))
    found = negatives.hard_negatives(rows, "ts_code % 100 = 0", positives=5, negatives=10, low=30, high=90, scale=256)
    return found.select(F.col("anchor_code").alias("anchor_id"), F.col("positive_code").alias("positive_id"), "rank", F.col("negative_code").alias("negative_id"),
                        "positive_score", "negative_score")


@query
def op13_suffix_dedup(spark, sf):
    """Bytes left of every document without its passages of 100 bytes that start earlier."""
    out = suffixes.drop_earlier_passages(reports(spark, sf), length=100)
    return out.select(F.col("external_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("content_bytes", 256).alias("kept_sha256"))


ORACLES["op10_exact_topk"] = """
WITH units AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM units q JOIN units c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLES["op12_hard_negatives"] = """
WITH units AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM units a JOIN units c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLES["op13_suffix_dedup"] = """
WITH docs AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, unnest(range(0, len(h) // 2 - 99)) AS i, h FROM docs WHERE len(h) >= 200
), windows AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS w FROM starts
), later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1
), marked AS (
  SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 100 AS opens FROM later
), numbered AS (
  SELECT doc_id, i, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked
), runs AS (
  SELECT doc_id, k, min(i) AS a, max(i) + 100 AS z FROM numbered GROUP BY doc_id, k
), gaps AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs
), cut AS (
  SELECT g.doc_id, sum(z - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS rest
  FROM gaps g JOIN docs d ON d.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN removed IS NULL THEN b ELSE unhex(rest) END) AS kept_sha256
FROM docs d LEFT JOIN cut c ON c.doc_id = d.doc_id
"""

ORACLES["op2_secret_scan"] = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matched AS (
  SELECT doc_id, t, 0 AS k, 6 AS least, regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m,
    regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g FROM docs
  UNION ALL SELECT doc_id, t, 1, 20, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL SELECT doc_id, t, 2, 24, regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM docs
), found AS (  -- the place of a match is the first occurrence of its text after the match before
  SELECT doc_id, k, list_reduce(list_concat([{'p': 0::BIGINT, 'm': '', 'n': 0::BIGINT, 's': []::STRUCT(a BIGINT, k INTEGER, b BIGINT)[]}],
      list_transform(list_zip(m, g), lambda z: {'p': 0::BIGINT, 'm': z[1], 'n': len(z[2]), 's': []::STRUCT(a BIGINT, k INTEGER, b BIGINT)[]})),
    lambda acc, x: {'p': acc.p + strpos(substr(t, acc.p + 1), x.m) - 1 + len(x.m), 'm': '', 'n': 0::BIGINT,
      's': CASE WHEN x.n >= least THEN list_append(acc.s, {'a': acc.p + strpos(substr(t, acc.p + 1), x.m) - 1, 'k': k, 'b': acc.p + strpos(substr(t, acc.p + 1), x.m) - 1 + len(x.m)}) ELSE acc.s END}).s AS s
  FROM matched
), spans AS (
  SELECT doc_id, list_sort(flatten(list(s))) AS s FROM found GROUP BY doc_id
), told AS (
  SELECT doc_id, s, array_to_string(list_transform(s, lambda x: ['assign', 'access', 'hex'][x.k + 1] || ':' || x.a || ':' || x.b), ',') AS spans FROM spans
)
SELECT doc_id, len(list_filter(s, lambda x: x.k = 0)) AS n_assign, len(list_filter(s, lambda x: x.k = 1)) AS n_access, len(list_filter(s, lambda x: x.k = 2)) AS n_hex,
  sha256(spans) AS base_sha256, spans FROM told
"""

ORACLES["op4_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), filled AS (
  SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '[^\x09-\x0D\x20]')) AS f FROM split
), numbered AS (
  SELECT doc_id, l, f, unnest(range(1, len(f))) AS k FROM filled
), pairs AS (
  SELECT doc_id, f[k] AS a, f[k + 1] AS b, array_to_string(l[f[k]:f[k + 1]], chr(10)) AS body FROM numbered
), earliest AS (
  SELECT body, min({'d': doc_id, 'a': a}) AS place FROM pairs GROUP BY body
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM pairs JOIN earliest USING (body) WHERE doc_id <> place.d OR a > place.a + b - a
), kept AS (
  SELECT doc_id, i, line, g.i IS NULL AS stays FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM split) LEFT JOIN gone g USING (doc_id, i)
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '') AS text, count(*) AS n_lines,
  count(*) FILTER (NOT stays) AS n_removed FROM kept GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE text IS NULL
"""

ORACLES["op6_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), sets AS (
  SELECT s, min(doc_id) AS node, any_value(len(s)) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM shingles WHERE len(s) > 0) GROUP BY s
), tokens AS (
  SELECT node, n, unnest(s) AS token FROM sets
), links AS (
  SELECT a.node AS a, b.node AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.node < b.node
  GROUP BY a.node, b.node HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT node AS a, node AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b
), least_of AS (
  SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM shingles d LEFT JOIN sets x ON x.s = list_sort(d.s) AND len(d.s) > 0 LEFT JOIN least_of c ON c.node = x.node
"""

ORACLES["op7_warc"] = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS p FROM pages
), grouped AS (
  SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, sha1(p) AS payload_digest, max(page_id) OVER (PARTITION BY p) AS top FROM payloads
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM grouped
"""
