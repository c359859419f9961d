"""Empty tables, repeated rows, very long texts and clashing columns where other tests have none."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from cadentia.llm.decontaminate import decontaminate
from cadentia.llm.language import language_report
from cadentia.llm.pii import pseudonymise
from cadentia.session import materialise

from .helpers import documents

NAMES = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH, GERMAN = "the cat and the dog were in the house with that man ", "der hund und die katze sind mit dem mann in das haus gegangen "


def test_language_report_on_awkward_tables(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    empty = spark.createDataFrame([], NAMES)
    assert language_report(empty, path).count() == 0
    rows = [(i, t * (1 + i % 3), lang, "s", 1) for i, (t, lang) in enumerate([(ENGLISH, "en"), (GERMAN, "de")] * 30)]
    rows += [(100, ENGLISH * 20_000, None, "s", 1), (101, None, "en", None, None), (102, "123 !", "de", None, None)]
    rows += [(103, ENGLISH, "en", "s", 1)] * 3 + [(None, GERMAN, None, None, None)]
    frame = spark.createDataFrame([(*r, "x", 0.5) for r in rows], NAMES + ", lang_pred string, score double")
    found = language_report(materialise(frame, "docs"), path).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append(r.lang_pred)
        assert 0 <= r.score <= 1
    assert len(found) == len(rows) and got[103] == ["en"] * 3
    assert got[100] == ["en"] and got[101] == got[102] == ["und"] and got[None] == ["de"]


def test_decontamination_of_no_rows_and_of_a_very_long_text(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage, 5)], "item_id long, text string, doc_id long")
    assert decontaminate(documents(spark, []), items).count() == 0
    long = "x y z " * 100_000 + passage + " x" * 100_000
    rows = {r.doc_id: r for r in decontaminate(materialise(documents(spark, [(1, long), (2, passage)]), "docs"), items).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1].n_items, rows[1].contaminated) == (400_020, 20, 1, False)
    assert rows[2].contaminated


def test_surrogates_in_a_very_long_text(spark):
    text = "x y z " * 50_000 + "write to anna.schmidt@example.org today " + "x y z " * 50_000
    (row,) = pseudonymise(materialise(documents(spark, [(1, text)]), "docs"), b"key").collect()
    out = next(v for v in row if isinstance(v, str) and len(v) > 100_000)
    assert "anna.schmidt@example.org" not in out and out.startswith("x y z ") and out.endswith("x y z ") and out.count("@") == 1


def test_pipeline_of_no_rows_and_with_other_columns(spark, tmp_path):
    """Every stage takes an empty table, and documents with columns named like those the stages make."""
    folder = str(tmp_path)
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(i, f"{ENGLISH} {i} {'and more of it ' * (i % 5)}", "en", "s", 9) for i in range(40)]
    for name, some in (("none", []), ("some", rows)):
        docs = spark.createDataFrame(some, NAMES)
        for column in ("row", "language", "simhash_row", "judged_row", "spans"):
            docs = docs.withColumn(column, F.lit(1))
        docs = materialise(docs, name)
        for stage, function in corpus_pipeline.STAGES:
            docs = materialise(function(spark, docs, folder), stage)
            if stage != "best_fit_packing":
                assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert docs.count() >= len(some) // 8 and (some or docs.count() == 0)
