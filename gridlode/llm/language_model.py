"""Language-model scores from a class-factored log-bilinear model trained with noise-contrastive estimation.

Tokens are words and one end per text. Every frequent word is a unit of its own; all rarer words
share units by their last letters. Units are dealt to classes of like mass. A context is the sum of
the preceding units' vectors, each weighted by its distance. The probability of a word is that of
its class, times that of its unit within the class, both softmaxes of products with the context,
times the word's share of its unit by counts. The first two are normalised by matrix products over all classes
and over the units of the class, so all known words and one unknown word of every ending sum to one.

The vocabulary of units grows with the corpus: a word has its own vectors from LEAST_COUNT
occurrences on, as long as there are no more than OWN_UNITS such words, which bounds a task's
memory; beyond that the least count doubles. Counts cover all training texts. The most
frequent words' counts are broadcast, at most HEAD; all other words are looked up by a join.

Training goes over all training texts ROUNDS times. How many tasks share a round depends on the
number of tokens, not on how the input is split: every task has about TASK_TOKENS, if the
input's partitions are smaller than that. A task starts at the average of the round before, and
every vector is averaged by how often each task met it. Only one set of parameters comes to the driver.

Texts are read once into units, written as a table: four bytes a token. The rounds and the scores read that.

Defined cases: a null or empty text is its end alone; a very long text is scored whole, in pieces
of bounded size; rows without an id are neither held out nor trained on; rows that repeat count
each; words of equal counts are in the order of their hashes; without training texts every word is
unknown; an empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlode.llm.storage import written
from gridlode.llm.textcols import Words, as_long, column_of, hash_words, mix, pieces, stream

FOLDS, HELD_OUT = 5, 1
#: Words with own units, endings that rarer words share, and counts that are broadcast.
LEAST_COUNT, OWN_UNITS, ENDINGS, HEAD = 8, 49_152, 4096, 262_144
#: Units of a class at most, and classes that would have like mass.
CLASS_UNITS, CLASSES = 512, 128
WIDTH, CONTEXT = 16, 3
ROUNDS, TASK_TOKENS, BATCH, NOISE, CLASS_NOISE, RATE, SEED = 2, 4_000_000, 8192, 1, 64, 0.2, 17
#: Tokens of a step that share drawn classes.
NOISE_TOKENS = 2048
#: Rows summed or turned to columns at a time, which stay in the cache.
TURNED = 1024
#: Tokens scored at a time, and those of them whose classes are.
CHUNK, PART = 65_536, 512
#: Units with exponentials for all classes, which bounds a task's memory.
CELL_UNITS = 32_768
#: Logits are cut off here, so their exponentials stay finite; a part of the model, normalised like all else.
MOST_LOGIT = 80.0
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 1_000_000
#: Parameter sets that one task averages.
FAN_IN = 16
END = -1
LETTERS = 3
KEPT = ("id", "row", "n_tokens", "n_known", "base")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def endings(words: Words, of: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Number of the ending of each word, or of those at the places given, by its last LETTERS bytes."""
    start, end = words.start[of], words.end[of]
    value = np.zeros(len(end), np.uint64)
    for k in range(1, LETTERS + 1):
        at = end - k
        inside = at >= start
        byte = np.where(inside, words.buf[np.maximum(at, 0)], 0) if len(words.buf) else np.zeros(len(at), np.uint8)
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)  # A-Z count as a-z
        value = value * np.uint64(256) + byte.astype(np.uint64)
    return (mix(value) % np.uint64(ENDINGS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word, first, at = np.unique(np.concatenate([h for h, _, _ in held]), return_index=True, return_inverse=True)
        return word, np.concatenate([e for _, e, _ in held])[first], np.bincount(at, np.concatenate([n for _, _, n in held])).astype(np.int64)

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["word", "ending", "n"])

    for batch in batches:
        for piece in pieces(batch, "text"):
            words = hash_words(column_of(piece, "text"))
            coded = pa.array(as_long(words.hash)).dictionary_encode()
            at, word = coded.indices.to_numpy(), coded.dictionary.to_numpy()
            some = np.empty(len(word), np.int64)
            some[at] = np.arange(len(at))  # one place of each word, whichever
            held.append((word, endings(words, some), np.bincount(at, minlength=len(word))))
            held.append((np.array([END]), np.array([0]), np.array([piece.num_rows])))
            size += len(word) + 1
        if size > HELD_WORDS:
            held = [merged()]
            size = len(held[0][0])
            if size > HELD_WORDS // 2:
                yield passed()
                held, size = [], 0
    if held:
        held = [merged()]
        yield passed()


@dataclass
class Vocabulary:
    """Frequent words in order of their hashes with count and unit (-1: its ending's), units in order of their classes, and totals."""

    word: np.ndarray
    n: np.ndarray
    unit: np.ndarray
    ending: np.ndarray
    end: int
    first: np.ndarray
    prior: np.ndarray
    mass: np.ndarray
    tokens: int
    types: int

    def __post_init__(self) -> None:
        """Hashes are spread evenly, so their leading bits tell nearly where they stand in the order."""
        self.bits = max(1, len(self.word).bit_length() + 1)
        slots = np.searchsorted(self._slot(self.word), np.arange((1 << self.bits) + 1))
        self.slot, self.longest = slots, int(np.diff(slots).max()) if len(self.word) else 0

    def _slot(self, words: np.ndarray) -> np.ndarray:
        return (words >> (64 - self.bits)) + (1 << (self.bits - 1))

    @property
    def units(self) -> int:
        return len(self.prior)

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word stands, and whether it does."""
        last = len(self.word) - 1
        at = np.minimum(self.slot.take(self._slot(words)), last)
        found = self.word.take(at)
        less = np.flatnonzero(found < words)  # stand further on, or nowhere
        for _ in range(self.longest):
            if not len(less):
                break
            at[less] = np.minimum(at[less] + 1, last)
            found[less] = self.word.take(at[less])
            less = less[found[less] < words[less]]
        return at, found == words

    def look_up(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit of each word, given its ending, where it stands, and whether it does."""
        if not len(self.word):
            return self.ending[ends], np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at, known = self.places(words)
        unit = np.where(known, self.unit.take(at), -1)
        return np.where(unit < 0, self.ending.take(ends), unit), at, known


def least_count(sizes: dict[int, int], most: int, least: int) -> int:
    """The least power of two, or `least`, such that no more than `most` words occur so often; sizes holds words by the power of two below their counts."""
    while sum(k for p, k in sizes.items() if 2 ** (p + 1) > least) > most:
        least = 1 << least.bit_length()
    return least


def vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: word (hash), ending and n. At most HEAD words, and one row per ending, come to the driver."""
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).first()
    by_power = counts.groupBy(F.floor(F.log2(F.col("n"))).alias("p")).count().collect()  # 64 rows at most
    sizes = {int(r["p"]): r["count"] for r in by_power}
    head_count, own_count = least_count(sizes, HEAD, 1), least_count(sizes, OWN_UNITS, LEAST_COUNT)
    head = counts.where((F.col("n") >= head_count) | (F.col("word") == END)).toArrow().sort_by("word")
    word, n, ending = (head[c].to_numpy() for c in ("word", "n", "ending"))
    own = (n >= own_count) | (word == END)
    shared = np.full(ENDINGS, 0.5)  # one unknown word of each ending
    for r in counts.where((F.col("n") < own_count) & (F.col("word") != END)).groupBy("ending").agg(F.sum(F.col("n") + 0.5).alias("n")).collect():
        shared[r["ending"]] += r["n"]
    mass = np.concatenate([n[own] + 0.5, shared])
    order = np.lexsort((np.arange(len(mass)), -mass))
    mass = mass[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    share = np.sqrt(mass)
    share = np.cumsum(share) / share.sum()
    group = np.minimum((share * CLASSES).astype(np.int64), CLASSES - 1)
    starts = [0]
    for at in np.flatnonzero(np.diff(group)) + 1:
        starts.append(int(at))
    starts.append(len(mass))
    first = np.unique(np.concatenate([np.append(np.arange(a, b, CLASS_UNITS), b) for a, b in zip(starts, starts[1:], strict=False)]))
    unit = np.full(len(word), -1)
    unit[own] = place[: int(own.sum())]
    at_end = place[: int(own.sum())][word[own] == END]
    end = int(at_end[0]) if len(at_end) else int(place[-1])
    return Vocabulary(word, n, unit, place[int(own.sum()) :], end, first, mass / mass.sum(), mass, int(total["n"] or 0), int(total["types"]))


class Model:
    """Vectors and biases of contexts, units and classes, weights of the distances, and sums of squared steps by row."""

    def __init__(self, rows: dict[str, np.ndarray]) -> None:
        self.rows = rows
        self.context, self.target, self.kind = rows["context"], rows["target"], rows["kind"]
        self.distance = rows["distance"]

    @classmethod
    def start(cls, of: Vocabulary) -> Model:
        """The last two columns of a row are its bias and its sum of squares."""
        rows = {"context": of.units + 1, "target": of.units, "kind": len(of.first) - 1, "distance": CONTEXT}
        made = {}
        for salt, (name, n) in enumerate(rows.items()):
            uniform = (stream(SEED + salt, n * WIDTH) >> np.uint64(11)).astype(np.float64) / 2.0**53 - 0.5
            made[name] = np.concatenate([(uniform * 0.2).reshape(n, WIDTH), np.zeros((n, 2))], axis=1).astype(np.float32)
            made[name][:, -1] = 1e-3
        made["distance"][:, :WIDTH] = 1.0 / np.arange(1, CONTEXT + 1)[:, None]
        in_class = np.add.reduceat(of.prior, of.first[:-1])
        made["kind"][:, WIDTH] = np.log(in_class)
        made["target"][:, WIDTH] = np.log(of.prior / np.repeat(in_class, np.diff(of.first)))
        return cls(made)

    def contexts(self, unit: np.ndarray, place: np.ndarray, lo: int, hi: int) -> Contexts:
        return Contexts(self, unit, place, lo, hi)


class Contexts:
    """Units before the tokens lo:hi. A token is the context of the next ones, so its vector is read, and moved, once. Vectors are columns."""

    def __init__(self, model: Model, unit: np.ndarray, place: np.ndarray, lo: int, hi: int) -> None:
        self.model, self.n = model, hi - lo
        start = len(model.context) - 1
        self.unit = np.concatenate([np.full(max(0, CONTEXT - lo), start), unit[max(0, lo - CONTEXT) : hi]])
        self.lacks = [np.flatnonzero(place[lo:hi] < k) for k in range(1, CONTEXT + 1)]
        columns, none = columns_of(model.context, self.unit)[:WIDTH], model.context[start, :WIDTH, None]
        #: Vectors of the units k places before, from k = 1 on.
        self.vectors = [columns[:, CONTEXT - k : CONTEXT - k + self.n].copy() for k in range(1, CONTEXT + 1)]
        for vectors, lacks in zip(self.vectors, self.lacks, strict=True):
            vectors[:, lacks] = none

    def sum(self) -> np.ndarray:
        """Weighted sums of the vectors, and a last row of ones, by which a bias counts as one more product."""
        out = np.ones((WIDTH + 1, self.n), np.float32)
        np.multiply(self.vectors[0], self.model.distance[0, :WIDTH, None], out=out[:WIDTH])
        for k in range(2, CONTEXT + 1):
            out[:WIDTH] += self.vectors[k - 1] * self.model.distance[k - 1, :WIDTH, None]
        return out

    def gradients(self, of_sum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units and gradients of their vectors, and gradients of the distances."""
        out = np.zeros((WIDTH + 1, len(self.unit) + 1), np.float32)
        distances = np.zeros((WIDTH + 1, CONTEXT), np.float32)
        for k in range(1, CONTEXT + 1):
            weighed = of_sum * self.model.distance[k - 1, :WIDTH, None]
            lacks = self.lacks[k - 1]
            out[:WIDTH, -1] += weighed[:, lacks].sum(axis=1)
            weighed[:, lacks] = 0
            out[:WIDTH, CONTEXT - k : CONTEXT - k + self.n] += weighed
            distances[:WIDTH, k - 1] = np.einsum("wb,wb->w", of_sum, self.vectors[k - 1])
        return np.append(self.unit, len(self.model.context) - 1), out, distances


def columns_of(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows at, without the sums of squares, as columns: steps over many tokens then run along memory."""
    out = np.empty((WIDTH + 1, len(at)), np.float32)
    for a in range(0, len(at), TURNED):
        out[:, a : a + TURNED] = table.take(at[a : a + TURNED], axis=0).T[: WIDTH + 1]
    return out


def read_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit and place in its text of every token, and the tokens of each text, from a column of units."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 4
    unit = np.frombuffer(data, np.int32)[offsets[0] : offsets[-1]]
    n = np.diff(offsets)
    return unit, np.arange(len(unit), dtype=np.int32) - np.repeat(offsets[:-1] - offsets[0], n), n


def chance_against(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(z)), in the place of z; of a z so large that its exponential is infinite, nothing."""
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def aliases(of: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Walker's tables: a unit drawn evenly from its class stays with its chance of the first, else it becomes that of the second."""
    stay, other = np.ones(of.units), np.arange(of.units)
    for a, b in zip(of.first[:-1].tolist(), of.first[1:].tolist(), strict=True):
        mass = of.prior[a:b] * ((b - a) / of.prior[a:b].sum())
        less, more = np.flatnonzero(mass < 1).tolist(), np.flatnonzero(mass >= 1).tolist()
        mass = mass.tolist()
        while less and more:
            lack, give = less.pop(), more[-1]
            stay[a + lack], other[a + lack] = mass[lack], a + give
            mass[give] -= 1 - mass[lack]
            if mass[give] < 1:
                less.append(more.pop())
    return stay, other


class Trainer:
    """Steps of one task from given parameters; every row that it meets is counted."""

    def __init__(self, of: Vocabulary, model: Model, round_: int) -> None:
        self.of, self.model, self.random = of, model, np.random.default_rng([SEED, round_])
        self.met = {name: np.zeros(len(rows), np.float32) for name, rows in model.rows.items()}
        self.kind_of = np.repeat(np.arange(len(of.first) - 1), np.diff(of.first))
        self.in_class = np.add.reduceat(of.prior, of.first[:-1])
        self.below = np.cumsum(self.in_class)[:-1]
        self.log_within = np.log(NOISE * of.prior / self.in_class[self.kind_of]).astype(np.float32)
        self.log_class = np.log(CLASS_NOISE * self.in_class).astype(np.float32)
        self.alone = np.diff(of.first) == 1
        self.any_alone = bool(self.alone.any())
        self.size = np.diff(of.first)
        self.stay, self.alias = aliases(of)
        #: Room for the place that each row has in a step, and the tables with a row as one value, which is written at once.
        self.place = {name: np.zeros(len(rows), np.int64) for name, rows in model.rows.items()}
        self.whole = {name: rows.view(f"V{rows.itemsize * rows.shape[1]}")[:, 0] for name, rows in model.rows.items()}

    def move(self, name: str, at: np.ndarray, gradient: np.ndarray) -> None:
        """One step of the rows at; gradient's columns hold vectors and biases, rows that repeat are summed."""
        times = np.bincount(at, minlength=len(self.place[name]))
        rows = np.flatnonzero(times)
        self.place[name][rows] = np.arange(len(rows))
        at = self.place[name].take(at)
        total = np.empty((WIDTH + 1, len(rows)), np.float32)
        for w in range(WIDTH + 1):
            total[w] = np.bincount(at, gradient[w], len(rows))
        self.move_once(name, rows, total, times.take(rows))

    def move_once(self, name: str, rows: np.ndarray, total: np.ndarray, times: np.ndarray) -> None:
        """One step of rows that differ, met so many times."""
        moved = self.model.rows[name].take(rows, axis=0)
        squares = moved[:, -1] + np.einsum("wr,wr->r", total, total) / (WIDTH + 1)
        total *= RATE / np.sqrt(squares)
        moved[:, :-1] -= total.T
        moved[:, -1] = squares
        self.whole[name][rows] = moved.view(self.whole[name].dtype)[:, 0]
        self.met[name][rows] += times

    def class_noise(self, h: np.ndarray, of_h: np.ndarray, of_kinds: np.ndarray, times: np.ndarray) -> None:
        """Adds the gradients of drawn classes, which NOISE_TOKENS tokens share; a class drawn several times is worked out once."""
        parts, kinds = -(-h.shape[1] // NOISE_TOKENS), len(self.size)
        drawn = np.searchsorted(self.below, self.random.random((parts, CLASS_NOISE)), side="right") + kinds * np.arange(parts)[:, None]
        for part, often in enumerate(np.bincount(drawn.ravel(), minlength=parts * kinds).reshape(parts, kinds)):
            at, noise = slice(part * NOISE_TOKENS, (part + 1) * NOISE_TOKENS), np.flatnonzero(often)
            q, n = columns_of(self.model.kind, noise), often[noise].astype(np.float32)
            less = -q
            less[WIDTH] += self.log_class[noise]
            other = chance_against(less.T @ h[:, at])
            of_h[:, at] += (q * n)[: len(of_h)] @ other
            of_kinds[:, noise] += (other @ h[:, at].T).T * n
            times += often

    def noise_within(self, kind: np.ndarray) -> np.ndarray:
        """A unit of each class, by mass."""
        at = self.random.random(len(kind)) * self.size.take(kind)
        whole = at.astype(np.int64)
        drawn = self.of.first.take(kind) + whole
        return np.where(at - whole < self.stay.take(drawn), drawn, self.alias.take(drawn))

    def step(self, units: np.ndarray, place: np.ndarray, lo: int, hi: int) -> None:
        """One step over the tokens lo:hi."""
        model, unit = self.model, units[lo:hi]
        kind = self.kind_of.take(unit)
        contexts = model.contexts(units, place, lo, hi)
        h = contexts.sum()
        q = columns_of(model.kind, kind)
        sure = -chance_against(np.einsum("wb,wb->b", h, q) - self.log_class.take(kind))
        gh, own = sure * q[:WIDTH], sure * h
        of_kinds = np.stack([np.bincount(kind, own[w], len(self.size)) for w in range(WIDTH + 1)])
        times = np.bincount(kind, minlength=len(self.size))
        self.class_noise(h, gh, of_kinds, times)
        several = slice(None) if not self.any_alone else np.flatnonzero(~self.alone[kind])
        u, k, hs = unit[several], kind[several], h[:, several]
        moves, at_moves = [u], []
        q = columns_of(model.target, u)
        sure = -chance_against(np.einsum("wb,wb->b", hs, q) - self.log_within.take(u))
        more = sure * q[:WIDTH]
        at_moves.append(sure * hs)
        for _ in range(NOISE):
            drawn = self.noise_within(k)
            qn = columns_of(model.target, drawn)
            other = chance_against(self.log_within.take(drawn) - np.einsum("wb,wb->b", hs, qn))
            more += other * qn[:WIDTH]
            moves.append(drawn)
            at_moves.append(other * hs)
        gh[:, several] += more
        at, columns, distances = contexts.gradients(gh)
        met = np.flatnonzero(times)
        self.move_once("kind", met, of_kinds[:, met].astype(np.float32), times[met])
        if len(u):
            self.move("target", np.concatenate(moves), np.concatenate(at_moves, axis=1))
        self.move("context", at, columns)
        self.move_once("distance", np.arange(CONTEXT), distances / np.float32(len(unit)), np.ones(CONTEXT))


def _packed(rows: dict[str, np.ndarray], met: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The rows that were met, of every table, with how often."""
    names = sorted(rows)
    at = [np.flatnonzero(met[n]) for n in names]
    cells = [
        pa.array(names), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()), pa.array([met[n][a].astype(np.float32).tobytes() for n, a in zip(names, at, strict=True)], pa.binary()),
        pa.array([rows[n][a].astype(np.float32).tobytes() for n, a in zip(names, at, strict=True)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cells, names=["name", "at", "met", "rows"])


def _added(total: dict[str, np.ndarray], met: dict[str, np.ndarray], name: str, at: bytes, often: bytes, rows: bytes) -> None:
    """Adds one packed table to weighted sums."""
    at, often = np.frombuffer(at, np.int32), np.frombuffer(often, np.float32)
    total[name][at] += np.frombuffer(rows, np.float32).reshape(len(at), -1) * often[:, None]
    met[name][at] += often


def _train(of: Vocabulary, tables, round_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(of, Model({n: t.copy() for n, t in tables.items()}), round_)
        seen = False
        for batch in batches:
            for piece in pieces(batch, "units"):
                unit, place, _ = read_units(column_of(piece, "units"))
                for lo in range(0, len(unit), BATCH):
                    trainer.step(unit, place, lo, min(len(unit), lo + BATCH))
                    seen = True
        if seen:
            yield _packed(trainer.model.rows, trainer.met)

    return run


def _average(shapes: dict[str, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = {n: np.zeros(s) for n, s in shapes.items()}, {n: np.zeros(s[0]) for n, s in shapes.items()}
        for batch in batches:
            for cells in zip(*(column_of(batch, c).to_pylist() for c in ("name", "at", "met", "rows")), strict=True):
                _added(total, met, *cells)
        if any(m.any() for m in met.values()):
            yield _packed({n: t / np.maximum(met[n], 1e-30)[:, None] for n, t in total.items()}, met)

    return run


def train(tokens: DataFrame, of: Vocabulary) -> Model:
    """One model of all texts, given by their units."""
    schema = "name string, at binary, met binary, rows binary"
    model = Model.start(of)
    tasks = max(1, -(-of.tokens // TASK_TOKENS))
    for round_ in range(ROUNDS):
        made = written(tokens.select("units").coalesce(tasks).mapInArrow(_train(of, model.rows, round_), schema), "models")
        left = made.count() // len(model.rows)
        shapes = {n: t.shape for n, t in model.rows.items()}
        while left > 1:
            left = -(-left // FAN_IN)
            made = written(made.repartition(left).mapInArrow(_average(shapes), schema), "models")
        for cells in made.collect():  # one set of parameters
            at = np.frombuffer(cells["at"], np.int32)
            model.rows[cells["name"]][at] = np.frombuffer(cells["rows"], np.float32).reshape(len(at), -1)
    return model


class Choice:
    """Classes, or the units of one: vectors and biases as columns, and what bounds their products."""

    def __init__(self, rows: np.ndarray) -> None:
        self.table = np.ascontiguousarray(rows[:, : WIDTH + 1].T)
        self.longest, self.bias = lengths(rows).max(), rows[:, WIDTH].max()

    def log_chances(self, h: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logarithms of the chances of the columns at, after the contexts h."""
        logits = h @ self.table
        if self.longest * length.max() + self.bias > MOST_LOGIT:  # else no product can reach it
            np.minimum(logits, MOST_LOGIT, out=logits)
        own = logits[np.arange(len(at)), at]
        np.exp(logits, out=logits)
        return own - np.log(logits @ np.ones(logits.shape[1], np.float32))


def lengths(rows: np.ndarray) -> np.ndarray:
    """Lengths of vectors, without their biases."""
    return np.sqrt(np.einsum("bw,bw->b", rows[:, :WIDTH], rows[:, :WIDTH]))


class Factors:
    """What every unit brings to a context at every distance: its weighted vector, and the exponentials of that vector's products with all classes.

    A context is a sum, so the exponential of its product with a class is a product of one cell for each distance,
    and a task works out exponentials for the most frequent units, not for tokens. Tokens after other units, or whose products
    may be too large for that, are left to the products themselves.
    """

    def __init__(self, model: Model) -> None:
        bias, kinds = model.kind[:, WIDTH], model.kind[:, :WIDTH].T
        self.vectors = [model.context[:, :WIDTH] * row[:WIDTH] for row in model.distance]
        self.cells, self.reach = [], []
        start = len(model.context) - 1
        rows = np.append(np.arange(min(CELL_UNITS, start)), start)  # the most frequent units
        for vectors in self.vectors:
            cells, reach = vectors.take(rows, axis=0) @ kinds, np.full(start + 1, np.inf, np.float32)
            reach[rows] = np.maximum(cells.max(axis=1), -cells.min(axis=1))
            self.reach.append(reach)
            self.cells.append(np.exp(np.clip(cells, -MOST_LOGIT, MOST_LOGIT, out=cells), out=cells))
        self.weight = np.exp(np.clip(bias, -MOST_LOGIT, MOST_LOGIT))
        self.most = MOST_LOGIT - np.abs(bias).max()

    def before(self, unit: np.ndarray, place: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Units before the tokens lo:hi, a row for each distance."""
        out = np.full((CONTEXT, hi - lo), len(self.vectors[0]) - 1)
        for k in range(1, CONTEXT + 1):
            a = max(lo, k)
            if a < hi:
                np.copyto(out[k - 1, a - lo :], unit[a - k : hi - k], where=place[a:hi] >= k)
        return out

    def contexts(self, before: np.ndarray) -> np.ndarray:
        """Sums of the weighted vectors, and a last column of ones, by which a bias counts as one more product."""
        out = np.ones((before.shape[1], WIDTH + 1), np.float32)
        for a in range(0, len(out), TURNED):
            part = slice(a, a + TURNED)
            total = self.vectors[0].take(before[0, part], axis=0)
            for vectors, at in zip(self.vectors[1:], before[1:], strict=True):
                total += vectors.take(at[part], axis=0)
            out[part, :WIDTH] = total
        return out

    def log_kinds(self, before: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the chances of the tokens' classes, and the tokens that are left out."""
        out, own = np.empty(len(kind)), self.weight.take(kind)
        room = np.empty((2, PART // 2, len(self.weight)), np.float32)
        for a in range(0, len(kind), PART // 2):
            part = slice(a, min(a + PART // 2, len(kind)))
            product, factor = room[:, : part.stop - a]
            self.cells[0].take(before[0, part], axis=0, out=product, mode="clip")  # the start is the last row
            for cells, at in zip(self.cells[1:], before[1:], strict=True):
                product *= cells.take(at[part], axis=0, out=factor, mode="clip")
            out[part] = product[np.arange(part.stop - a), kind[part]] * own[part] / (product @ self.weight)
        far = np.flatnonzero(sum(r.take(at) for r, at in zip(self.reach, before, strict=True)) >= self.most)
        out[far] = 1
        return np.log(out), far


def log_chances(model: Model, of: Vocabulary, unit: np.ndarray, place: np.ndarray, factors: Factors | None = None) -> np.ndarray:
    """Natural logarithms of the units' probabilities after those before them in their texts; factors: of this model, where they are at hand."""
    factors = factors or Factors(model)
    kinds, units = Choice(model.kind), [Choice(model.target[a:b]) for a, b in zip(of.first[:-1], of.first[1:], strict=True)]
    kind_of = np.repeat(np.arange(len(of.first) - 1, dtype=np.int16), np.diff(of.first))  # sorted by digits; units are few
    out = np.empty(len(unit), np.float64)

    for lo in range(0, len(unit), CHUNK):
        hi = min(len(unit), lo + CHUNK)
        kind = kind_of.take(unit[lo:hi])
        order = np.argsort(kind, kind="stable")
        u, kind, before = unit[lo:hi].take(order), kind.take(order), factors.before(unit, place, lo, hi).take(order, axis=1)
        h = factors.contexts(before)
        length = lengths(h)
        got, far = factors.log_kinds(before, kind)
        for a in range(0, len(far), PART):
            part = far[a : a + PART]
            got[part] = kinds.log_chances(h[part], length[part], kind[part])
        starts = np.searchsorted(kind, np.arange(len(of.first)))
        for k in np.flatnonzero((np.diff(starts) > 0) & (np.diff(of.first) > 1)):
            for a in range(starts[k], starts[k + 1], PART):
                part = slice(a, min(a + PART, starts[k + 1]))
                got[part] += units[k].log_chances(h[part], length[part], u[part] - of.first[k])
        out[lo + order] = got
    return out


def _read(of: Vocabulary):
    """Texts as their units, with all parts of the scores that don't depend on the model, and the words whose counts aren't at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_mass, log_count = np.log10(of.mass), np.log10(of.n + 0.5)
        own = np.zeros(of.units, bool)
        own[of.unit[of.unit >= 0]] = True
        own[of.end] = True
        at_end = np.flatnonzero(of.word == END)
        end_score = log_count[at_end[0]] if len(at_end) else np.log10(0.5)  # without an end nothing was trained on
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = hash_words(column_of(piece, "text"))
                word, row, rows = as_long(words.hash), words.row, piece.num_rows
                unit, at, known = of.look_up(word, endings(words))
                counted = log_count.take(at) * known if len(log_count) else np.zeros(len(word))
                shared = ~own.take(unit)
                fixed = np.where(shared, counted - log_mass.take(unit), 0.0)
                units = np.full(len(word) + rows, of.end, np.int32)
                units[np.arange(len(word)) + row] = unit
                offsets = pa.py_buffer((4 * (words.first + np.arange(rows + 1))).astype(np.int32))
                rare = np.flatnonzero(~known)
                rare = rare[np.lexsort((word[rare], row[rare]))]
                first = np.flatnonzero(np.concatenate([[True], (word[rare][1:] != word[rare][:-1]) | (row[rare][1:] != row[rare][:-1])])) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate([first, [len(rare)]]))
                lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[rare[first]], minlength=rows))]).astype(np.int32))
                struct = pa.StructArray.from_arrays([pa.array(word[rare[first]]), pa.array(times.astype(np.int32))], names=["word", "times"])
                summed = lambda values: np.bincount(row, values, rows).astype(np.float64)  # noqa: E731, B023  of nothing, bincount gives integers
                yield pa.RecordBatch.from_arrays(
                    [
                        column_of(piece, "id"),
                        pa.array(words.count + 1),
                        pa.array(np.bincount(row[known], minlength=rows).astype(np.int64) + len(at_end)),
                        pa.array(summed(counted) + end_score),
                        pa.array(summed(fixed)),
                        pa.ListArray.from_arrays(lists, struct),
                        pa.Array.from_buffers(pa.binary(), rows, [None, offsets, pa.py_buffer(units)]),
                    ],
                    names=["id", "n_tokens", "n_known", "base", "fixed", "rare", "units"],
                )

    return run


def read(rows: DataFrame, of: Vocabulary) -> DataFrame:
    """rows: id and text. Their units, counts and fixed parts of the scores."""
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_read(of), f"id {kind}, n_tokens long, n_known long, base double, fixed double, rare array<struct<word:long,times:int>>, units binary")


def _score(of: Vocabulary, tables):
    """Adds the logarithms of the units' probabilities to the fixed part of the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, factors = Model(tables), None
        for batch in batches:
            for piece in pieces(batch, "units"):
                factors = factors or Factors(model)
                unit, place, n = read_units(column_of(piece, "units"))
                logs = np.bincount(np.repeat(np.arange(len(n)), n), log_chances(model, of, unit, place, factors), len(n))
                score = column_of(piece, "fixed").to_numpy() + logs / np.log(10.0)
                yield pa.RecordBatch.from_arrays([*(column_of(piece, c) for c in KEPT), pa.array(score)], names=[*KEPT, "score"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    # a task has one core; waiting threads of the matrix products would only take others'
    docs.sparkSession.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = rows.where(fold(F.col("id")) != HELD_OUT).select("text")
    counts = texts.mapInArrow(_count, "word long, ending long, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))
    counts = written(counts, "counts")
    of = vocabulary(counts)
    kind = docs.schema[id_col].dataType.simpleString()
    tokens = written(read(rows, of).withColumn("row", F.monotonically_increasing_id()), "tokens")
    model = train(tokens.where(fold(F.col("id")) != HELD_OUT), of)
    scored = written(tokens.select(*KEPT, "fixed", "units").mapInArrow(_score(of, model.rows), f"id {kind}, row long, n_tokens long, n_known long, base double, score double"), "scored")
    rare = tokens.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    looked_up = rare.join(counts, "word", "left")
    known = F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)
    more = looked_up.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)).alias("more"), F.sum(known).alias("more_known"))
    out = scored.join(more, "row", "left").na.fill(0, ["more", "more_known"])
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(fold(F.col("id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(of.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * F.lit(float(np.log10(of.tokens + 0.5 * (of.types + 1))))).alias("base_score"),
        (F.col("score") + F.col("more")).alias("score"),
    )


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
