import random

from gridlode.llm.line_dedup import remove_repeated_lines


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    m = 0
    while m < min(len(a), len(b)) and a[-1 - m] == b[-1 - m]:
        m += 1
    return n + m >= max(len(a), len(b)) - 1


def brute(rows):
    lines = sorted({((i is None, i if i is not None else 0), n, tuple(x.lower().split())) for i, t in rows for n, x in enumerate((t or "").split("\n"))})
    lines = [x for x in lines if len(x[2]) >= 5]
    gone = {(k, n) for j, (k, n, w) in enumerate(lines) if any(within_one(w, o[2]) for o in lines[:j])}
    return {(i, "\n".join(x for n, x in enumerate((t or "").split("\n")) if ((i is None, i if i is not None else 0), n) not in gone)) for i, t in rows}


def random_rows(seed, docs=40):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "Ccc", "d", "é", "ff", "g", "hh"])
    pool = [[word() for _ in range(rng.randint(3, 9))] for _ in range(25)]
    rows = []
    for i in range(docs):
        text = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(line) + 1)
                line[k : k + rng.randint(0, 1)] = [word()] if rng.random() < 0.7 else []
            text.append(" ".join(line))
        rows.append((i, "\n".join(text)))
    return rows


def test_against_brute_force(spark):
    for seed in range(3):
        rows = [*random_rows(seed), (None, "one two three four five"), (100, "one two three four"), (101, None), (102, "")]
        got = {(r.doc_id, r.text or "") for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute(rows)


def test_defined_cases(spark):
    rows = [(1, "one two three four five\nx", "a"), (1, "one two three four five\nx", "a"), (2, "ONE two three four  five", None), (3, None, "b"), (4, "", "b")]
    out = remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines string"))
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect() if r.text is not None)
    assert got == [(1, "one two three four five\nx", 2, 0), (1, "one two three four five\nx", 2, 0), (2, "", 1, 1), (4, "", 0, 0)]
    assert remove_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text(spark):
    text = "\n".join(f"line {i} has some more words {i * 7}" for i in range(20_000))
    out = remove_repeated_lines(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))
    got = {r.doc_id: r.n_removed for r in out.collect()}
    assert got == {1: 0, 2: 20_000}
