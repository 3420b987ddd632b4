"""Operators against brute-force versions on small fixtures, and their defined cases."""

import random
import re
import zlib
from math import log10

import pytest
from pyspark.sql import functions as F

from gridlode.llm import decontaminate, html_extract, language_model, licenses, mixing, near_duplicates, quality_rules, toxicity, url_filters

SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=1, groups=12):
    """Texts with exact and near copies, nulls, empty texts, repeated rows and one long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    rows = [(900, None), (901, ""), (902, " \n "), (903, "One two"), (904, "one  TWO"), (905, " ".join(word() for _ in range(30_000))), (None, "a b c d e f g")]
    for g in range(groups):
        base = [word() for _ in range(rng.randint(4, 60))]
        for k in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                text[rng.randrange(len(text))] = word()
            rows.append((g * 10 + k, " ".join(text)))
    return [*rows, rows[-1]]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def shingles(text):
    w = re.findall(SPACED, lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                at[root(i)] = root(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[root(i)] = min(ids.get(root(i), doc), doc)
    return sorted((doc is None, doc or 0, len(sets[i]), ids.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    got = near_duplicates.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.id is None, r.id or 0, r.n_shingles, r.component_id) for r in got) == brute_groups(rows)
    kept = [r.doc_id for r in near_duplicates.deduplicate(frame(spark, [(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")).collect()]
    assert sorted(kept, key=str) == sorted({doc for doc, t in rows if doc is None or (False, doc, len(shingles(t)), doc) in brute_groups(rows)}, key=str)
    assert near_duplicates.near_duplicates(frame(spark, [])).count() == 0


def test_chain_of_copies(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join([*words[2 * k :], *(f"x{j}" for j in range(2 * k))])) for k in range(40)]
    assert {r.component_id for r in near_duplicates.near_duplicates(frame(spark, rows)).collect()} == {0}


def test_signatures_estimate_similarity():
    import numpy as np

    from gridlode.llm.textcols import stream

    pool, errors = stream(5, 40_000), []
    for k in range(60):
        a, b = pool[k * 500 : k * 500 + 400], pool[k * 500 + 100 : k * 500 + 500]
        s = near_duplicates.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 400), 2)
        errors.append((s[0] == s[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.02


def test_decontamination(spark):
    rows, rng = corpus(3), random.Random(3)
    texts = [t for _, t in rows if t and len(t.split()) > 14]
    items = [(1, " ".join(texts[0].split()[2:14])), (2, "b c d"), (3, None), (4, "..."), (5, " ".join(texts[5].split()[:10]) + " zz"), (None, " ".join(texts[7].split()[1:12])), (1, "one two")]
    items += [(10 + k, " ".join(rng.choice(texts).split()[:12])) for k in range(5)]
    windows = set()
    for item, t in items:
        w = re.findall(ALNUM, lower(t))
        n = min(10, len(w))
        windows |= {(tuple(w[i : i + n]), item) for i in range(len(w) - n + 1) if n}
    got = {(r.doc_id, r.text): r for r in decontaminate.find_overlap(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()}
    for doc, text in rows:
        w, hit, found = re.findall(ALNUM, lower(text)), set(), set()
        for window, item in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found |= {str(item)} - {"None"}
        r = got[doc, text]
        assert (r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) == (len(w), len(hit), sorted(found))
    assert decontaminate.find_overlap(frame(spark, rows), frame(spark, [], "item_id long, text string")).where(F.size("spans") > 0).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(200)] + [(7, None, "a"), (None, "x y", "b")]
    out = mixing.mix(frame(spark, rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mixing.mix(frame(spark, rows[::-1], "doc_id long, text string, source string")).collect()))
    total = sum(r.size for r in out)
    for source in {r.source for r in out}:
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and own[0].target <= 2 * own[0].source_size + 1e-9
        assert own[0].source_size == sum(r.size for r in own) and all(0 <= r.taken <= 2 * r.size for r in own)
    assert sum({r.source: r.target for r in out}.values()) == pytest.approx(1.5 * total)
    assert mixing.mix(frame(spark, [], "doc_id long, text string, source string")).count() == 0


def test_quality_counts(spark):
    rows = [*corpus(5), (1000, "a b c\n\na b c\n #$ x a b c a b c\nx"), (1001, " ".join(["spam and eggs"] * 40)), (1002, "tab\tsep\r\n\r\nx")]
    got = quality_rules.judge(frame(spark, [(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")).collect()
    for r in got:
        text = r.text or ""
        w = re.findall(SPACED, text)
        seen, dup = set(), 0
        for line in (x for x in text.split("\n") if re.search(SPACED, x)):
            dup += line in seen
            seen.add(line)
        count = {}
        for i in range(len(w) - 2):
            count.setdefault(tuple(w[i : i + 3]), []).append(i)
        repeated = {j for at in count.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_divergence_rejects_junk(spark):
    rng = random.Random(6)
    prose = lambda: " ".join(rng.choice(["the", "of", "and", "river", "stone", "house", "to", "in"]) + rng.choice(["", "", ".", ","]) for _ in range(120))
    rows = [(i, prose(), "en") for i in range(60)] + [(99, " ".join("###$$$%%%" for _ in range(30)) + " " + " ".join(str(i) for i in range(90)), "en")]
    got = {r.doc_id: r.kept for r in quality_rules.judge(frame(spark, rows, "doc_id long, text string, lang string")).collect()}
    assert not got.pop(99) and all(got.values())


def test_licenses(spark):
    rows = [(1, "Code under the MIT License. And under the mit-license, under the MIT License"), (2, None), (3, "under the mit"), (4, "x This work is licensed under the GNU General Public License, version 3.")]
    rows += [(5, "Licensed under CC BY-NC 4.0 and the Apache License, Version 2.0"), (5, "GNU General Public license for version 3 is licensed"), (6, "")]
    got = sorted(licenses.scan(frame(spark, [(i, t, "z") for i, t in rows], "doc_id long, text string, labels string")).collect(), key=lambda r: (r.doc_id, r.n_words))
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got] == [
        (1, 14, 3, 1, 10, "mit", "mit"), (2, 0, 0, None, None, "", ""), (3, 3, 0, None, None, "", ""), (4, 13, 0, None, None, "", "gpl-3"),
        (5, 9, 0, None, None, "", ""), (5, 14, 2, 2, 9, "apache-2,cc-by-nc", "apache-2,cc-by-nc"), (6, 0, 0, None, None, "", ""),
    ]
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 1
        words = [rng.choice(["tree", "lake", "sun", "road", "bread", "stone"]) for _ in range(40)]
        if bad:
            words[rng.randrange(40)] = rng.choice(["vile", "rotten"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs += [(1000, None), (1001, ""), (None, "vile")]
    data = frame(spark, docs)
    model = toxicity.fit(data, frame(spark, [*labels, (5000, 1), (None, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(data, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 5 == 1) for i in held) and got[None] >= 0.5 and 0 < got[1000] < 0.5 and got[1000] == got[1001]
    none = toxicity.fit(data, frame(spark, [], "doc_id long, toxic int"))
    assert {round(r.score, 3) for r in toxicity.score(data, none).collect()} == {0.5}


def test_language_model(spark):
    rows = [*corpus(9), *((2000 + i, "ab cd " * 30) for i in range(50))]
    got = language_model.score(frame(spark, rows)).collect()
    train = [re.findall(SPACED, lower(t)) + ["\n"] for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    count = {}
    for tokens in train:
        for t in tokens:
            count[t] = count.get(t, 0) + 1
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        w = re.findall(SPACED, lower(t)) + ["\n"]
        want.append((i is None, i or 0, len(w), sum(x in count for x in w), n, round(sum(log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), 3)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert language_model.score(frame(spark, [])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) "</p>"</script></head><body class="no-sidebar"><header><h1>Site</h1></header>
<div class="cookie-notice">We use</div><div id="wrap"><div class="sidebar">Links <a href=x>foo</a></div><div class="post-12"><h1>Ti&amp;tle</h1><p>Para <b>bo</b>ld&#33; text<br>
more <!-- x > y -->done.<p>Second &lt;b&gt; para %s with quite some text.<ul><li>one<li>two</ul><form><input>Name</form><div class="ad-box">Buy</div><section id="comments"><p>Nice!</p></section></div></div><footer>(c)</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"http://a.com/{i}", PAGE % i) for i in range(5)] + [(10, None, None), (11, "http://b.com/", ""), (12, "x", "plain &amp; simple"), (13, "http://c.com", "<article><p>" + "long words " * 50_000)]
    got = {r.page_id: r for r in html_extract.main_text(frame(spark, [(*r, 3) for r in rows], "page_id long, url string, html string, n_chars int")).collect()}
    assert [got[i].text for i in range(5)] == [f"Ti&tle Para bold! text more done. Second <b> para {i} with quite some text. one two" for i in range(5)]
    assert [got[i].text for i in (10, 11, 12)] == ["", "", "plain & simple"] and got[13].n_chars == 50_000 * 11 - 1
    assert html_extract.main_text(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_url_rules_and_templates(spark):
    urls = ["http://Shop.example.COM/en/1?x", "https://www.example.com/en/2", "http://a.net/es/1#t", "http://a.net/en/9", "http://com", "ftp://xcom/", None, "nothing", "http://u.com?a://b/c"]
    rows = [*enumerate(urls), *((100 + i, f"http://big.net/{'es' if i % 2 else 'spam'}/{i}") for i in range(80))]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(frame(spark, [(*r, "k") for r in rows], "page_id long, url string, rule string")).collect()}
    assert [got[i] for i in range(9)] == [
        ("shop.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/2", "www.example.com/en/", "allow"), ("a.net", "/es/1", "net/es/", "block"),
        ("a.net", "/en/9", None, got[3][3]), ("com", "", None, "allow"), ("xcom", "/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("u.com", "", None, "allow"),
    ]
    assert all(got[100 + i][3] == ("block" if i % 2 else "allow") for i in range(80))
    assert url_filters.judge(frame(spark, [], "page_id long, url string")).count() == 0
