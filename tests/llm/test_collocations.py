"""Phrases against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from gridlode.llm import collocations as col


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, longest=4, least=30, covered=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = [p for p, a in counts.items() if len(p) > 1 and a >= least]
        inside = Counter()
        for p in found:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], counts[p])
        ranked = []
        for p in found:
            a = counts[p]
            if p in inside and 100 * inside[p] >= covered * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def rows(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "New", "york", "city", "é", "É", "中", "a-b", "x y", "\x00", "rare", "\U0001f600"]
    made = []
    for _ in range(n):
        words = []
        for _ in range(rng.choice([0, 1, 5, 40])):
            words += rng.choice([["new", "york", "city"], ["in", "the", "middle", "of"], ["Of", "the"], [rng.choice(vocabulary)], ["in", "the", "middle", "of", "it"]])
            words.append(rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r", "\x0b", "!? "]))
        made.append((rng.choice(["en", "en", "en", "de", "und", None]), " ".join(words)))
    return made


@pytest.mark.parametrize("settings", [{}, {"longest": 3, "min_count": 4, "covered_percent": 50, "top": 5}, {"min_count": 300, "longest": 2}])
def test_as_plain_counting(spark, settings):
    data = [*rows(1, 500), ("fr", None), (None, None), ("it", "")]
    docs = spark.createDataFrame(data, "lang string, text string").repartition(5)
    names = {"min_count": "least", "covered_percent": "covered"}
    want = plain(data, **{names.get(k, k): v for k, v in settings.items()})
    assert sorted(tuple(r) for r in col.collocations(docs, **settings).collect()) == want
    assert want


def test_a_hot_language_and_one_long_text(spark):
    data = [("en", "one long text of words and of words " * 4000)] + [("en", "one long text")] * 300 + [("de", "ein wort")] * 40
    docs = spark.createDataFrame(data, "lang string, text string")
    assert sorted(tuple(r) for r in col.collocations(docs).collect()) == plain(data)


def test_nothing_to_find(spark):
    for data in ([], [(None, None)], [("en", "a b c")]):
        assert col.collocations(spark.createDataFrame(data, "lang string, text string")).collect() == []


def test_ties_of_a_cut_take_the_first(spark):
    data = [("en", "a b c")] * 30
    got = col.collocations(spark.createDataFrame(data, "lang string, text string")).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b c", 30, 30, 30, 90, 1_000_000)]
