"""Fill-in-the-middle against a plain version, and exact round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from gridlode.llm import fill_in_middle as fim

UNIT = re.compile(fim.UNIT)


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["a", "word", " ", "  ", "\n", "\t\t", "\r\n", "\x0b", "\x0c", "é", "中文", "\U0001f600", " ", " ", "<", "<P", "P>", "<S>", "\x00", "#", "\x1c", "\x85"]
    return ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 12, 60]))) for _ in range(n)]


def plain(doc_id, text, seed=42, percent=50, first=80, markers=("<P>", "<S>", "<M>")):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in markers) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    a, b, c = markers
    return (n, "spm", len(p), len(m), b + s + a + p + c + m) if h4 % 100 < first else (n, "psm", len(p), len(m), a + p + b + s + c + m)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("settings", [{}, {"seed": 7, "percent": 100, "first": 30, "markers": ("[[pre]]", "[[suf]]", "[[mid]]")}])
def test_as_the_plain_version(spark, settings):
    rows = [(i, t) for i, t in enumerate(texts(3, 400))] + [(None, "an id is missing here"), (5, None), (6, None), (8, "one"), (8, "one"), (9, "x" * 50)]
    names = {"first": "suffix_first_percent"}
    out = fim.fill_in_middle(frame(spark, rows), **{names.get(k, k): v for k, v in settings.items()})
    back = fim.restored(F.col("output"), F.col("form"), settings.get("markers", fim.MARKERS))
    got = out.withColumn("back", back).collect()
    want = sorted(((i, t, *plain(i, t, **settings)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == want
    assert all(r.back == (r.text or "") for r in got)
    assert len({r.form for r in got}) == 3


def test_slices_give_the_same_units():
    split = pre_tokenizers.Split(Regex(fim.UNIT), "isolated")
    for text in [*texts(5, 200), "w" * 40 + " x", " " * 40, "a " * 30]:
        want = [m.end() for m in UNIT.finditer(text)]
        for limit in (1, 2, 7, 1000):
            assert fim.unit_ends(split, text, limit).tolist() == want
            assert "".join(part for _, part in fim.slices(text, limit)) == text


def test_markers_that_overlap_are_refused(spark):
    for markers in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d"), ("<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(frame(spark, [(1, "x")]), markers=markers)


def test_the_query_and_very_long_texts(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(120_000))
    frame(spark, [(i, long) for i in range(3)] + [(10 + i, "y" * 600_000) for i in range(3)]).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in fim.op11_fill_in_middle(spark, str(tmp_path)).collect():
        text = long if r.doc_id < 10 else "y" * 600_000
        n, form, p, m, out = plain(r.doc_id, text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, p, m, sha(out), sha(text))
