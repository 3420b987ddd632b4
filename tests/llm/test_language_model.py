"""The language model against loops over its own definition, and what it gains on held-out texts."""

import random
from math import exp, log, log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlode.llm import language_model as lm
from gridlode.llm.textcols import _BYTE, as_long, hash_words, mix


def trained(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = frame.mapInArrow(lm._count, "word long, ending long, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))
    of = lm.vocabulary(counts)
    return of, lm.train(lm.read(frame.select(F.lit(0).alias("id"), "text"), of), of)


def prose(seed, n):
    rng = random.Random(seed)
    words = {lang: ["".join(rng.choice(lang) for _ in range(rng.randint(1, 4))) for _ in range(60)] for lang in ("abcd", "wxyz")}
    return [" ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 60))) for lang in (rng.choice(list(words)) for _ in range(n))]


def dot(a, b):
    return sum(float(x) * float(y) for x, y in zip(a, b, strict=True))


def test_score_by_its_definition(spark):
    texts = prose(1, 200)
    of, model = trained(spark, texts)
    w = lm.WIDTH
    before = [3, *[of.units] * (lm.CONTEXT - 1)]
    h = [sum(float(model.context[u, i]) * float(model.distance[k, i]) for k, u in enumerate(before)) for i in range(w)]
    kinds = [exp(dot(h, row[:w]) + float(row[w])) for row in model.kind]
    want = []
    for k, (a, b) in enumerate(zip(of.first[:-1], of.first[1:], strict=True)):
        inside = [exp(dot(h, model.target[u, :w]) + float(model.target[u, w])) for u in range(a, b)]
        want += [log(kinds[k] / sum(kinds) * x / sum(inside)) for x in inside]
    assert sum(map(exp, want)) == pytest.approx(1, abs=1e-6)
    after_three = np.stack([np.full(of.units, 3), np.arange(of.units)], axis=1).ravel()  # texts of two tokens
    got = lm.log_chances(model, of, after_three, np.tile([0, 1], of.units))[1::2]
    assert np.allclose(got, want, atol=1e-3)
    # a text's score is the sum over its tokens, rare words by their share of their ending's unit
    texts = [texts[0] + " neverseen", ""]
    of_text = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts)], names=["id", "text"])
    read = next(lm._read(of)(iter([of_text])))
    unit, ahead, n = lm.read_units(read.column(6))
    assert ahead.tolist() == [k for t in texts for k in range(len(t.split()) + 1)] and n.tolist() == [len(t.split()) + 1 for t in texts]
    words = [w for t in texts for w in [*t.split(), None]]
    hashes = [lm.END if w is None else int(as_long(hash_words(pa.array([w])).hash)[0]) for w in words]
    counts = dict(zip(of.word.tolist(), of.n.tolist(), strict=True))
    own = set(of.unit[of.unit >= 0].tolist()) | {of.end}
    chances = lm.log_chances(model, of, unit, ahead) / log(10)
    total, row = [0.0, 0.0], np.repeat([0, 1], n)
    for i in range(len(row)):
        total[row[i]] += chances[i] + (0 if int(unit[i]) in own else log10(counts.get(hashes[i], 0) + 0.5) - log10(of.mass[unit[i]]))
    batch = next(lm._score(of, model.rows)(iter([read.append_column("row", pa.array([0, 1]))])))
    rare = read.column(5).to_pylist()
    assert [s + len(r) * log10(0.5) for s, r in zip(batch.column(5).to_pylist(), rare, strict=True)] == pytest.approx(total, abs=1e-4)


def test_known_and_unknown_words_sum_to_one(spark):
    of, _ = trained(spark, prose(2, 100))
    own = of.unit[of.unit >= 0]
    shared = np.setdiff1d(np.arange(of.units), np.append(own, of.end))
    rare = {}
    for word, n, unit in zip(of.word, of.n, of.unit, strict=True):
        if unit < 0:
            rare[word] = n
    # over all endings: counts of rare words, and one unknown word each, make up the units' mass
    assert sum(n + 0.5 for n in rare.values()) + 0.5 * len(shared) == pytest.approx(of.mass[shared].sum())
    assert of.prior.sum() == pytest.approx(1) and of.first[-1] == of.units and max(np.diff(of.first)) <= lm.CLASS_UNITS


def test_least_count_bounds_the_words():
    sizes = {0: 1000, 1: 300, 2: 100, 3: 30, 4: 7}
    assert [lm.least_count(sizes, most, 1) for most in (2000, 437, 137, 36, 6)] == [1, 2, 4, 16, 32]


def test_gain_does_not_depend_on_partitions(spark):
    rows = list(enumerate(prose(3, 3000)))
    found = []
    for n in (1, 16):
        held = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(n, "doc_id")).where("held_out")
        found.append(held.agg((F.sum("score") / F.sum("n_tokens")).alias("s"), (F.sum("base_score") / F.sum("n_tokens")).alias("b")).first())
    assert all(r.s > r.b + 0.1 for r in found)
    assert abs(found[0].s - found[1].s) < 0.05


def test_units_are_drawn_by_their_mass(spark):
    of, _ = trained(spark, prose(4, 100))
    stay, other = lm.aliases(of)
    got = stay + np.bincount(other, 1 - stay, of.units)
    size = np.repeat(np.diff(of.first), np.diff(of.first))
    assert np.allclose(got / size, of.prior / np.repeat(np.add.reduceat(of.prior, of.first[:-1]), np.diff(of.first)))
    kind_of = np.repeat(np.arange(len(of.first) - 1), np.diff(of.first))
    kinds = np.repeat(np.arange(len(of.first) - 1), 50)
    assert (kind_of[lm.Trainer(of, lm.Model.start(of), 0).noise_within(kinds)] == kinds).all()


def test_class_noise_is_one_gradient_a_draw(spark):
    """Classes drawn several times count as often; every NOISE_TOKENS tokens have draws of their own."""
    of, _ = trained(spark, prose(5, 100))
    trainer, kinds, n = lm.Trainer(of, lm.Model.start(of), 0), len(of.first) - 1, lm.NOISE_TOKENS + 10
    h = np.random.default_rng(1).normal(size=(lm.WIDTH + 1, n)).astype(np.float32)
    h[lm.WIDTH] = 1
    of_h, of_kinds, times = np.zeros_like(h), np.zeros((lm.WIDTH + 1, kinds)), np.zeros(kinds, np.int64)
    trainer.class_noise(h, of_h, of_kinds, times)
    drawn = np.searchsorted(trainer.below, np.random.default_rng([lm.SEED, 0]).random((2, lm.CLASS_NOISE)), side="right")
    want_h, want_kinds = np.zeros((lm.WIDTH + 1, n)), np.zeros((lm.WIDTH + 1, kinds))
    for part, at in enumerate((slice(0, lm.NOISE_TOKENS), slice(lm.NOISE_TOKENS, n))):
        for k in drawn[part]:
            q = trainer.model.kind[k, : lm.WIDTH + 1].astype(float)
            other = 1 / (1 + np.exp(trainer.log_class[k] - q @ h[:, at]))
            want_h[:, at] += q[:, None] * other
            want_kinds[:, k] += h[:, at] @ other
    assert np.allclose(of_h, want_h, rtol=1e-3, atol=1e-3) and np.allclose(of_kinds, want_kinds, rtol=1e-3, atol=1e-2)
    assert times.tolist() == np.bincount(drawn.ravel(), minlength=kinds).tolist()


def test_exponentials_of_classes_are_units_not_tokens(spark, monkeypatch):
    of, model = trained(spark, prose(6, 100))
    size, worked = np.diff(of.first), []
    kind_of = np.repeat(np.arange(len(size)), size)
    unit = np.random.default_rng(2).integers(0, of.units, 100_000)
    factors, exp_ = lm.Factors(model), np.exp
    monkeypatch.setattr(np, "exp", lambda z, *a, **b: (worked.append(np.size(z)), exp_(z, *a, **b))[1])
    lm.log_chances(model, of, unit, np.arange(len(unit)), factors)
    own = size[kind_of[unit]]
    assert 0 < sum(worked) <= own[own > 1].sum()  # none of the classes is worked out for a token


def test_class_chances_by_products_where_cells_do_not_reach(spark, monkeypatch):
    """Vectors too long for the exponentials of single distances give the same chances, by their products, cut off."""
    of, model = trained(spark, prose(7, 100))
    unit = np.random.default_rng(3).integers(0, of.units, 5000)
    place = np.tile(np.arange(50), 100)
    few = unit[17]
    for left_out in (False, True):
        if left_out:
            model.context[few, : lm.WIDTH] *= 300 / np.abs(model.kind[:, : lm.WIDTH] @ model.context[few, : lm.WIDTH]).max()
        factors = lm.Factors(model)
        before = factors.before(unit, place, 0, len(unit))
        for k in range(1, lm.CONTEXT + 1):
            assert before[k - 1].tolist() == [of.units if p < k else unit[i - k] for i, p in enumerate(place)]
        h = sum(model.context[at, : lm.WIDTH].astype(float) * model.distance[k, : lm.WIDTH] for k, at in enumerate(before))
        assert np.allclose(factors.contexts(before), np.append(h, np.ones((len(h), 1)), axis=1), rtol=1e-4, atol=1e-4)
        logits = np.minimum(h @ model.kind[:, : lm.WIDTH].T + model.kind[:, lm.WIDTH], lm.MOST_LOGIT)
        kind_of = np.repeat(np.arange(len(of.first) - 1), np.diff(of.first))
        kind = kind_of[unit]
        got, far = factors.log_kinds(before, kind)
        assert (len(far) > 0) == left_out and set(far) <= set(np.flatnonzero((before == few).any(axis=0)))
        near, want = np.setdiff1d(np.arange(len(unit)), far), logits[np.arange(len(unit)), kind] - np.log(np.exp(logits).sum(axis=1))
        assert np.allclose(got[near], want[near], atol=1e-3)
        inside = np.zeros(len(unit))
        for i, (u, k) in enumerate(zip(unit, kind, strict=True)):
            a, b = of.first[k], of.first[k + 1]
            z = np.minimum(model.target[a:b, : lm.WIDTH].astype(float) @ h[i] + model.target[a:b, lm.WIDTH], lm.MOST_LOGIT)
            inside[i] = z[u - a] - np.log(np.exp(z).sum())
        assert np.allclose(lm.log_chances(model, of, unit, place), want + inside, rtol=1e-3, atol=1e-2)
    monkeypatch.setattr(lm, "CELL_UNITS", of.units // 2)
    got, far = lm.Factors(model).log_kinds(before, kind)
    seldom = ((before >= of.units // 2) & (before < of.units)).any(axis=0)
    near = np.setdiff1d(np.arange(len(unit)), far)
    assert np.flatnonzero(seldom).tolist() == np.intersect1d(far, np.flatnonzero(seldom)).tolist() and len(near) and np.allclose(got[near], want[near], atol=1e-3)
    assert np.allclose(lm.log_chances(model, of, unit, place), want + inside, rtol=1e-3, atol=1e-2)


def test_hashes_do_not_depend_on_what_stands_beside():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcXYZé中") for _ in range(rng.choice([1, 2, 7, 8, 23, 24, 25, 26, 80]))) for _ in range(300)] + ["q" * 5000]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(1000)] + ["", " ".join(words)]  # more words than are taken at once
    got = hash_words(pa.array(texts))
    alone = dict(zip(words, (hash_words(pa.array([w])).hash[0] for w in words), strict=True))
    assert got.hash.tolist() == [alone[w] for t in texts for w in t.split()]
    power, total = 0x9DDFEA08EB382D69, 0
    for k, b in enumerate("word".encode() * 20):
        total += int(_BYTE[b]) * pow(power, k, 2**64)
    assert hash_words(pa.array(["WORD" * 20])).hash[0] == mix(np.array([(total + 80) % 2**64], np.uint64))[0]
