"""Every operator on nulls in any column, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from gridlode.llm import decontaminate, fill_in_middle, html_extract, language_model, licenses, line_dedup, mixing, near_duplicates, quality_rules, sentence_pieces, toxicity, url_filters

LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(40_000))
ROWS = [
    (1, "some plain words of a text that is here", "en", "a", 3), (1, "some plain words of a text that is here", "en", "a", 3), (2, None, None, None, None), (3, "", "xx", "b", 0),
    (None, "no id but text of some words", "de", None, None), (None, None, None, None, None), (4, LONG, "en", "a", 9), (5, " \n\t\r\n ", "fr", "b", 1), (6, "é中\U0001f600 \u0000 x", "fr", "", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
CLASHES = [
    "score", "n_words", "labels", "kept", "spans", "items", "id", "text_key", "n_shingles", "component_id", "size", "key", "bucket", "target", "taken", "row", "word", "words", "line", "number", "place", "halves", "band", "node", "n", "hits", "order", "label",
    "n_lines", "n_removed", "source_size", "host", "path", "rule", "verdict", "template", "segments", "n_base", "features", "held_out", "cut", "one", "before", "rare",
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("was here") for c in CLASHES})


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, 1), (None, 1, 1), (4, 0, None), (99, 0, 1), (5, 0, 0)], LABELS)


def benchmark(spark):
    return spark.createDataFrame([(1, "words of a text that is here"), (None, None), (2, ""), (1, "some plain words of a text that is here")], "item_id long, text string")


def pages(spark, rows=ROWS):
    return docs(spark, rows).select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *CLASHES)


JOBS = {
    "html": lambda s, r: html_extract.main_text(pages(s, r)),
    "licenses": lambda s, r: licenses.scan(docs(s, r)),
    "near": lambda s, r: near_duplicates.near_duplicates(docs(s, r)),
    "decontaminate": lambda s, r: decontaminate.find_overlap(docs(s, r), benchmark(s)),
    "toxicity": lambda s, r: toxicity.score(docs(s, r), toxicity.fit(docs(s, r), labels(s))),
    "language model": lambda s, r: language_model.score(docs(s, r)),
    "mixing": lambda s, r: mixing.mix(docs(s, r)),
    "quality": lambda s, r: quality_rules.judge(docs(s, r)),
    "lines": lambda s, r: line_dedup.remove_repeated_lines(docs(s, r)),
    "urls": lambda s, r: url_filters.judge(pages(s, r)),
    "fill in middle": lambda s, r: fill_in_middle.fill_in_middle(docs(s, r)),
    "pieces": lambda s, r: sentence_pieces.decode(sentence_pieces.encode(docs(s, r))),
}


@pytest.mark.parametrize("name", JOBS)
def test_odd_rows_stay_whole(spark, name):
    out = JOBS[name](spark, ROWS)
    assert len(set(out.columns)) == len(out.columns)
    assert out.count() == len(ROWS) and len(out.collect()) == len(ROWS)


@pytest.mark.parametrize("name", JOBS)
def test_empty_tables(spark, name):
    assert JOBS[name](spark, []).count() == 0


@pytest.mark.parametrize("name", JOBS)
def test_only_nulls(spark, name):
    assert len(JOBS[name](spark, [(None,) * 5] * 3).collect()) == 3


def test_one_of_each_group_stays(spark):
    kept = near_duplicates.deduplicate(docs(spark)).select("doc_id", "text").collect()
    assert sum(r.doc_id == 1 for r in kept) == 1 and {r.doc_id for r in kept} == {r[0] for r in ROWS}
