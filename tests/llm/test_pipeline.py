"""Pipeline stages against their contracts, and the registration of the queries."""

import re
from pathlib import Path

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tidepanel.llm import queries

COLUMNS = list(pipeline.COLUMNS)


def test_all_operators_and_the_pipeline_are_registered():
    numbers = sorted(int(m[1]) for name in queries.QUERIES if (m := re.match(r"op(\d+)_", name)))
    assert numbers == list(range(1, 14)) and {*queries.QUERIES, "pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


def test_stages_keep_clean_documents(spark, sf, tmp_path):
    texts = [(1, "the quick brown fox jumps over the lazy dog again and again", "en", "s"), (2, None, "en", "s"), (3, "12 34 $$", None, "s"), (4, "key password=abcdefgh12 in this small text of a few words", "en", None),
             (5, "the quick brown fox jumps over the lazy dog again and again", "en", "s")]
    extra = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in texts], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", pipeline.F.col("doc_id") + 1000).unionByName(extra)
    kept = docs
    for n, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r for r in kept.collect()}
        stage(spark, kept, sf).write.parquet(f"{tmp_path}/{n}")
        kept = spark.read.parquet(f"{tmp_path}/{n}")
        after = {r.doc_id: r for r in kept.collect()}
        if n < 4:
            assert kept.columns == COLUMNS and all(r.n_chars == len(r.text) for r in after.values())
        if name == "language_id":
            assert before.keys() - after.keys() == {2, 3} and all(before[i].text == after[i].text for i in after)
        if name == "ngram_jaccard":
            assert 1 in after and 5 not in after
        if name == "secret_scan":
            assert after.keys() == before.keys() and after[4].text == "key [assign] in this small text of a few words"
        if name == "packing":
            assert after.keys() == before.keys()


def test_run_applies_all_stages(spark, sf):
    root = Path(pipeline.checkpoint_dir(spark).removeprefix("file:"))
    earlier = set(root.glob("pipeline-*"))
    out = pipeline.run(spark, sf)
    assert [p.name for f in set(root.glob("pipeline-*")) - earlier for p in f.iterdir()] == ["packing"]
    assert out.columns == ["doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"] and out.count() > 100


def staged(spark, stage, rows):
    table = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in stage(spark, table, "").collect()), key=str)


def test_one_row_of_each_group_stays(spark):
    copy, other = " ".join(f"w{n}" for n in range(40)), " ".join(f"x{n}" for n in range(40))
    near = copy + " tail"
    rows = [(1, copy, "en", "a"), (1, copy, "en", "a"), (None, near, "en", "a"), (None, copy, "en", "b"), (3, near, "en", "c"),  # one group
            (3, other, "en", "d"), (None, "y y z", "en", "e"), (None, "y y z", "en", "e"), (9, None, "en", "f"), (9, None, "en", "f")]
    want = [(1, copy, "en", "a"), (3, other, "en", "d"), (None, "y y z", "en", "e"), (9, None, "en", "f"), (9, None, "en", "f")]
    assert staged(spark, pipeline.one_of_each_group, rows) == sorted(want, key=str)


def test_documents_without_labels_stay(spark):
    texts = [(1, "some words of a text", "s"), (2, None, "s"), (3, "12 34 $$", "s"), (4, "é", None), (5, "", "s")]
    assert staged(spark, pipeline.identify_language, [(i, t, None, s) for i, t, s in texts]) == [(1, "some words of a text", None, "s"), (4, "é", None, None)]
    labelled_blank = [(1, "some words", None, "s"), (2, None, "en", "s")]  # a label without a text teaches nothing
    assert staged(spark, pipeline.identify_language, labelled_blank) == [(1, "some words", None, "s")]
    assert staged(spark, pipeline.identify_language, [(1, "some words", None, "s"), (2, "more words", "en", "s")]) == [(1, "some words", "en", "s"), (2, "more words", "en", "s")]
    assert staged(spark, pipeline.identify_language, [(1, "some words", "und", "s"), (2, "3", "und", "s")]) == [(1, "some words", "und", "s")]
