"""Columns of any name pass through operators and stages, and both sides of every bound give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from gridlode.llm import decontaminate, fill_in_middle, html_extract, licenses, line_dedup, mixing, near_duplicates, quality_rules, sentence_pieces, skew, toxicity, url_filters
from tests.llm.test_edge_cases import LABELS, ROWS, SCHEMA, benchmark, labels
from tests.llm.test_operators import PAGE, corpus

NAMES = [
    "_id", "_key", "_own", "_host", "_of", "_path", "_html", "_source", "_at", "_cut", "_epochs", "_part", "_keep", "_words", "_hits", "_chars", "_rule", "_segments", "_deal", "_deals", "_n", "_lang", "_place0", "_share0", "c0", "c1", "c3", "winner", "host", "of", "at",
    "keep", "own_key", "k1", "k2", "words", "hits", "place0", "share0", "classes", "commons", "near", "ruled", "rejected", "cut", "epochs", "part", "key", "id", "row", "late", "number", "said", "start", "n", "band", "node",
]
RESULTS = {
    "html": ["text", "n_chars"], "licenses": licenses.RESULTS, "decontaminate": decontaminate.RESULTS, "toxicity": ["score"], "mixing": ["size", "source_size", "target", "taken"], "quality": quality_rules.RESULTS, "lines": ["n_lines", "n_removed"], "urls": [*url_filters.RESULTS, "template"], "near": [],
    "fill in middle": fill_in_middle.RESULTS, "pieces": ["ids", "decoded"],
}


def wide(spark, rows=ROWS, names=()):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("was here") for c in (*NAMES, *names) if c not in ("doc_id", "text", "lang", "source", "n_chars")})


def job(name, spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *[c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")])
    return {
        "html": lambda: html_extract.main_text(pages), "licenses": lambda: licenses.scan(docs), "decontaminate": lambda: decontaminate.find_overlap(docs, benchmark(spark)), "toxicity": lambda: toxicity.score(docs, toxicity.fit(docs, labels(spark))),
        "mixing": lambda: mixing.mix(docs), "quality": lambda: quality_rules.judge(docs), "lines": lambda: line_dedup.remove_repeated_lines(docs), "urls": lambda: url_filters.judge(pages), "near": lambda: near_duplicates.deduplicate(docs),
        "fill in middle": lambda: fill_in_middle.fill_in_middle(docs), "pieces": lambda: sentence_pieces.decode(sentence_pieces.encode(docs)),
    }[name]()


@pytest.mark.parametrize("name", RESULTS)
def test_columns_of_any_name(spark, name):
    results = RESULTS[name]
    docs = wide(spark, names=results)
    out = job(name, spark, docs)
    assert sorted(out.columns) == sorted({*job(name, spark, docs).columns}) and set(results) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == (len({r[:2] for r in ROWS}) if name == "near" else len(ROWS))
    for c in NAMES:
        if c not in results:
            assert {r[c] for r in rows} == {"was here"}, c


STAGES = [toxicity.stage, line_dedup.stage, near_duplicates.stage, decontaminate.stage, mixing.stage]


@pytest.mark.parametrize("stage", STAGES, ids=lambda s: s.__module__.rpartition(".")[2])
def test_stages_on_odd_rows(spark, tmp_path, stage):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of these documents, at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["score", "n_words", "spans", "items", "n_lines", "n_removed", "component_id"]
    docs = wide(spark, names=names)
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    added = ["size", "source_size", "target", "taken"] if stage is mixing.stage else []
    assert out.columns == [*docs.columns, *added]
    assert all(r[c] == "was here" for r in rows for c in (*NAMES, *names) if c not in added)
    given = {(r[0], r[1]) for r in ROWS}
    got = [(r.doc_id, r.text) for r in rows]
    if stage is not line_dedup.stage:
        assert set(got) <= given
    if stage is decontaminate.stage:
        assert sorted(got, key=str) == sorted(((r[0], r[1]) for r in ROWS), key=str)
    if stage is near_duplicates.stage:
        assert sorted(got, key=str) == sorted(given, key=str)
    if stage is mixing.stage:
        assert all(0 < r.taken <= 2 * r.size for r in rows)
    if stage is line_dedup.stage:
        assert len(rows) == len(ROWS) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    assert stage(spark, wide(spark, [], names), str(tmp_path)).count() == 0
    assert LABELS


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_both_sides_of_the_bounds(spark, monkeypatch):
    rows = corpus(11)
    docs = spark.createDataFrame([(i, t, "en", "ab"[(i or 0) % 2]) for i, t in rows], "doc_id long, text string, lang string, source string")
    items = spark.createDataFrame([(k, " ".join(t.split()[1:13])) for k, (_, t) in enumerate(rows) if t and k % 3 == 0], "item_id long, text string")
    pages = spark.createDataFrame([(i, f"http://{'ab'[i % 2]}.net/{('es', 'x', 'y')[i % 3]}/{i}", PAGE % i) for i in range(30)], "page_id long, url string, html string")
    jobs = [lambda: decontaminate.find_overlap(docs, items), lambda: quality_rules.judge(docs), lambda: html_extract.main_text(pages), lambda: url_filters.judge(pages.drop("html")), lambda: mixing.mix(docs)]
    few = [j().toPandas() for j in jobs]
    for module, name in ((decontaminate, "MAX_BROADCAST_BYTES"), (quality_rules, "FEW_WINDOWS"), (html_extract, "MAX_BROADCAST_HOSTS"), (url_filters, "MAX_BROADCAST_SHAPES"), (mixing, "MAX_BROADCAST_SOURCES")):
        monkeypatch.setattr(module, name, -1 if name == "MAX_BROADCAST_BYTES" else 0)
    monkeypatch.setattr(skew, "LEAST", 2)
    for before, j in zip(few, jobs, strict=True):
        assert sorted(map(str, before.values.tolist())) == sorted(map(str, j().toPandas().values.tolist()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_are_joined_whole(spark, monkeypatch, how):
    rng = random.Random(5)
    big = spark.createDataFrame([(rng.choice([1, 1, 1, 1, 2, 3, None]), i) for i in range(400)], "k long, v long")
    small = spark.createDataFrame([(1, "a"), (2, "b"), (2, "bb"), (9, "z")], "k long, w string")
    want = big.join(small, ["k"], how)
    monkeypatch.setattr(skew, "LEAST", 10)
    dealt = skew.Dealt(big, ["k"], F.col("v"))
    assert dealt.table is not None
    assert same(dealt.join(small, how).select(want.columns), want)


def test_near_duplicates_with_dealt_keys(spark, monkeypatch):
    rows = [(i, " ".join([*(f"w{j}" for j in range(60)), f"own{i}"])) for i in range(60)] + [(100 + i, "quite another text of some words") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(skew, "LEAST", 2)
    assert {(r.component_id, r.n_shingles) for r in near_duplicates.near_duplicates(docs).collect()} == {(0, 57), (100, 2)}
    lines = line_dedup.remove_repeated_lines(spark.createDataFrame([(i, f"one two three four five six seven {i}") for i in range(50)], "doc_id long, text string"))
    assert {r.doc_id for r in lines.collect() if r.text} == {0}
