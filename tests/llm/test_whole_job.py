"""Whole jobs: what earlier versions left out."""

from pyspark.sql import functions as F

from gridlode.llm import html_extract, line_dedup, url_filters
from tests.llm.test_line_dedup import random_rows, within_one

HALF, MORE = "The first half of the text tells of rivers and of stones, at length.", "The other half of it tells of houses and of roads, as long as that."


def test_wrappers_and_siblings_keep_their_text():
    for name in ("has-sidebar", "no-comments", "content-with-ads", "post-share-wrap"):
        page = f"<body><p>Top</p><div class='{name}'><article><p>{HALF}</p><p>{MORE}</p></article></div><div class='side-links'>Else</div></body>"
        assert html_extract.extract(page, None) == f"{HALF} {MORE}"
    assert html_extract.extract(f"<body><div class='intro-text'>{HALF}</div><div class='more-text'>{MORE}</div></body>", None) == f"{HALF} {MORE}"
    assert html_extract.extract(f"<body><div class='sidebar'><p>{HALF}</p></div></body>", None) == HALF
    assert html_extract.extract(f"<body><div class='a'>{HALF}</div><div class='b'>{MORE}</div></body>", "/body/div.a") == f"{HALF} {MORE}"


def test_small_marked_parts_stay_out():
    page = f"<body><div class='post'><p>{HALF}</p><p>{MORE}</p></div><div class='ad-box'>Buy</div><div><a href=x>One more page of this site that is only a link to it, and long</a></div></body>"
    assert html_extract.extract(page, None) == f"{HALF} {MORE}"


def test_small_unlabelled_branches_keep_the_prior(spark):
    for n in (5, 40):
        urls = [f"http://a.net/{lang}/{k}" for lang in ("es", "fr", "de", "en") for k in range(n)]
        got = url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
        assert len(got) == 4 * n
        assert all(r.verdict == ("block" if r.url[13:15] in ("es", "fr") else "allow") for r in got)


def test_small_branches_with_other_labels_stay_apart(spark):
    rules = [("block", "a.net/bad/1"), ("allow", "a.net/ok/1")]
    urls = [*(f"http://a.net/bad/{k}" for k in range(10, 20)), *(f"http://a.net/ok/{k}" for k in range(10, 20)), "http://a.net/bad/2", "http://a.net/ok/2"]
    got = {r.url: r.verdict for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()}
    assert (got["http://a.net/bad/2"], got["http://a.net/ok/2"]) == ("block", "allow")


def brute_lines(rows):
    """Text left of each document: every equal line goes, and near ones of five words or more."""
    lines = sorted((i, n, tuple(x.lower().split())) for i, t in rows for n, x in enumerate(t.split("\n")) if x.split())
    gone = {(i, n) for j, (i, n, w) in enumerate(lines) if any(w == o or min(len(w), len(o)) >= 5 and within_one(w, o) for _, _, o in lines[:j])}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def test_short_lines_go_by_equality(spark, tmp_path):
    rows = [*random_rows(7), (100, "all rights reserved.\nof, edti oner.\nALL rights  reserved."), (101, "x\nall rights reserved.\nall rights kept.\n\n\nx"), (102, "one two three four five"), (103, "one two three four")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_lines(rows)
    assert {r.doc_id: r.text for r in line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: (r.text, r.n_chars) for r in line_dedup.stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()} == {i: (t, len(t)) for i, t in want.items()}
