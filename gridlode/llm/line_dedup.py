"""Removal of repeated lines by a deletion-neighbourhood join.

A line is the words between line ends. A line goes if an earlier one, by document id and line
number, is equal or within one word of it: one word changed, added or left out. Lines of fewer
than LEAST_WORDS words go for equal ones only, and only with short_lines, as in the query and
the pipeline; else they stay. Equal lines form a class with its earliest place first, so very
common lines cost one row per task.

Lines within one word share their first or their last half, so only classes with a half in
common are expanded: every variant with one word deleted in the other half becomes a hashed
key, with the place of the deletion where a changed word is meant. Equal keys then stand for
lines within the bound, and the earliest of each key is enough; keys are never expanded into
pairs. The word edit distance of every match is verified before a line goes.

Defined cases: a null or empty text has no lines and stays as it is; documents without an id
come last; rows that repeat in id and text are one document and are treated alike; a document
whose lines all go stays with the text that is left, which may be empty; a very long text is read
whole; an empty table gives an empty result; further columns pass through whatever their names,
and those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlode.llm.columns import Held
from gridlode.llm.skew import join_hot
from gridlode.llm.storage import written
from gridlode.llm.textcols import Words, as_long, byte_column, column_of, hash_words, mix, pieces

#: Lines of fewer words have no variants.
LEAST_WORDS = 5
U64 = np.uint64
_BASE = 0x9DDFEA08EB382D69
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = U64(0x2545F4914F6CDD1D)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, U64), np.cumprod(np.full(max(n, 1), base, dtype=U64))])


class Lines:
    """Lines with enough words: row, number within the text, first word and number of words; hashes of parts of lines."""

    def __init__(self, column: pa.Array, least: int = LEAST_WORDS) -> None:
        words: Words = hash_words(column)
        buf, offsets = byte_column(column)
        ends = np.flatnonzero(buf == 10)
        line = np.searchsorted(ends, words.start)
        first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (words.row[1:] != words.row[:-1])])) if len(line) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([first, [len(line)]]))
        self.n_lines = np.searchsorted(ends, offsets[1:]) - np.searchsorted(ends, offsets[:-1]) + 1
        enough = count >= least
        self.first, self.count = first[enough], count[enough]
        self.row = words.row[self.first] if len(self.first) else np.zeros(0, np.int32)
        self.number = line[self.first] - np.searchsorted(ends, offsets[self.row]) if len(self.first) else np.zeros(0, np.int64)
        self.words = words
        local = np.arange(len(line)) - np.repeat(first, count)
        longest = int(count.max()) if len(count) else 0
        self.inverse = _powers(_INVERSE, longest + 1)
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(words.hash * _powers(_BASE, longest + 1)[local], dtype=U64)])

    def part(self, i: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hash sums of the words start:start + size of lines i."""
        at = self.first[i] + start
        return (self.sums[at + size] - self.sums[at]) * self.inverse[start]

    def whole(self) -> np.ndarray:
        i = np.arange(len(self.first))
        return closed(self.part(i, np.zeros(len(i), np.int64), self.count), self.count)

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of first and last halves, and their lines, of those with LEAST_WORDS; the lowest bit tells last halves."""
        i = np.flatnonzero(self.count >= LEAST_WORDS)
        found, lines = [], []
        for size, of in ((self.count // 2, i), ((self.count - 1) // 2, i[self.count[i] % 2 == 0])):
            size = size[of]
            for side, start in ((0, np.zeros(len(of), np.int64)), (1, self.count[of] - size)):
                found.append(closed(self.part(of, start, size), size) & ~U64(1) | U64(side))
                lines.append(of)
        return np.concatenate(found), np.concatenate(lines)

    def variants(self, of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, place of the deleted word, and hash, of lines `of` without each of their words lo:hi."""
        n = hi - lo
        line = np.repeat(of, n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        rest = self.count[line] - place - 1
        before = self.part(line, np.zeros(len(line), np.int64), place)
        after = self.sums[self.first[line] + self.count[line]] - self.sums[self.first[line] + place + 1]
        return line, place, closed(before + after * U64(_INVERSE), place + rest)


def closed(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(sums + size.astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def _list(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for piece in pieces(batch, "text"):
                    lines = Lines(column_of(piece, "text"), least)
                    half, of = lines.halves()
                    order = np.argsort(of, kind="stable")
                    halves = _list(pa.array(as_long(half[order])), np.bincount(of, minlength=len(lines.first)))
                    row = pa.array(lines.row)
                    yield pa.RecordBatch.from_arrays(
                        [column_of(piece, "id").take(row), column_of(piece, "text_key").take(row), pa.array(lines.number, pa.int64()), pa.array(as_long(lines.whole())), halves],
                        names=["id", "text_key", "number", "line", "halves"],
                    )

    return run


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the wanted lines of each text; kind 0: the line itself, 1: with a word left out, 2: with a word changed."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for piece in pieces(batch, "text"):
                lines = Lines(column_of(piece, "text"))
                wanted = {(r, w["number"]): w for r, ws in enumerate(column_of(piece, "wanted").to_pylist()) for w in ws}
                own = [wanted.get(k) for k in zip(lines.row.tolist(), lines.number.tolist(), strict=True)]
                of = np.array([i for i, w in enumerate(own) if w], dtype=np.int64)
                count = lines.count[of]
                lo = np.array([0 if own[i]["last"] else (lines.count[i] - 1) // 2 for i in of], dtype=np.int64)
                hi = np.array([lines.count[i] if own[i]["first"] else lines.count[i] - (lines.count[i] - 1) // 2 for i in of], dtype=np.int64)
                at, place, key = lines.variants(of, lo, hi)
                changed = mix(key ^ ((place + 1).astype(U64) * _PLACE))
                at = np.concatenate([of, at, at])
                key = np.concatenate([lines.whole()[of], key, changed])
                kind = np.repeat(np.arange(3, dtype=np.int32), [len(of), len(place), len(place)])
                row = pa.array(lines.row[at])
                words = [lines.words.hash[lines.first[i] : lines.first[i] + lines.count[i]] for i in of]
                held = _list(pa.array(as_long(np.concatenate([np.zeros(0, U64), *words]))), count)
                held = pa.concat_arrays([held, pa.nulls(2 * len(place), held.type)])
                yield pa.RecordBatch.from_arrays(
                    [column_of(piece, "id").take(row), column_of(piece, "text_key").take(row), pa.array(lines.number[at], pa.int64()), pa.array(as_long(lines.whole()[at])), pa.array(as_long(key)), pa.array(kind), held],
                    names=["id", "text_key", "number", "line", "key", "kind", "words"],
                )


def _rebuilt(own: list[str], text_col: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col):
                lines = Lines(column_of(piece, text_col), least)
                texts, keep = column_of(piece, text_col).to_pylist(), column_of(piece, "keep").to_pylist()
                cut = np.searchsorted(lines.row, np.arange(piece.num_rows + 1))
                removed = []
                for r, text in enumerate(texts):
                    kept = set(keep[r] or ())
                    go = {int(k) for k in lines.number[cut[r] : cut[r + 1]] if k not in kept}
                    removed.append(len(go))
                    if go:
                        texts[r] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in go)
                n_lines = np.array([0 if not t else n for t, n in zip(column_of(piece, text_col).to_pylist(), lines.n_lines, strict=True)], dtype=np.int64)
                columns = [pa.array(texts, pa.string()) if c == text_col else column_of(piece, c) for c in own]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(removed, pa.int64())], names=[*own, "n_lines", "n_removed"])

    return run


def _within_one_word(a: str, b: str):
    """Whether word lists a and b differ by one word at most: their common ends cover all but one word."""
    both = lambda x, y: F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    lead = lambda x, y: F.when(F.array_position(both(x, y), False) == 0, least).otherwise(F.array_position(both(x, y), False) - 1)
    return lead(F.col(a), F.col(b)) + lead(F.reverse(a), F.reverse(b)) >= most - 1


def near_lines(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines (hashes) of which an earlier line is within one word."""
    half = classes.select("line", F.explode("halves").alias("half"))
    met = half.groupBy("half").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo < hi").select("half")
    side = F.pmod("half", F.lit(2))
    open_lines = join_hot(half, met, ["half"], F.col("line")).groupBy("line").agg(F.max(side == 0).alias("first"), F.max(side == 1).alias("last"))
    wanted = classes.join(open_lines, "line").select("place.id", "place.text_key", F.struct("place.number", "first", "last").alias("w"))
    wanted = wanted.groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list("w").alias("wanted"))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("id", "text_key", "text", "wanted")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("text_key long, number long, line long, key long, kind int, words array<long>").fields])
    keys = written(texts.mapInArrow(_expanded, schema), "variants")
    at = F.struct(F.col("id").isNull().alias("late"), "id", "text_key", "number", "line")
    keys = keys.withColumn("at", at)
    kinds = [F.min(F.when(F.col("kind") == k, F.col("at"))).alias(f"k{k}") for k in range(3)]
    least = keys.groupBy("key").agg(*kinds, F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo < hi").select("key", "k0", "k1", "k2")
    joined = join_hot(keys.select("line", "key", "kind", "at"), least, ["key"], F.col("line"))
    earlier = F.when(F.col("kind") == 0, F.col("k1")).when(F.col("kind") == 1, F.col("k0")).otherwise(F.col("k2"))
    pairs = joined.withColumn("earlier", earlier).where("earlier < at").select("line", F.col("earlier.line").alias("other")).distinct()
    words = keys.where("kind = 0").select("line", "words")
    checked = join_hot(written(pairs, "line_pairs"), words.select(F.col("line").alias("other"), F.col("words").alias("wb")), ["other"], F.col("line"))
    checked = checked.join(words.withColumnRenamed("words", "wa"), "line")
    return checked.where(_within_one_word("wa", "wb")).select("line").distinct()


def without_repeats(held: Held, short_lines: bool) -> DataFrame:
    """The held rows with the text that is left, n_lines and n_removed."""
    least = 1 if short_lines else LEAST_WORDS
    id_col, text_col = held["id"], held["text"]
    docs = held.rows
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("text_key long, number long, line long, halves array<long>").fields])
    place = F.struct(F.col("id").isNull().alias("late"), "id", "text_key", "number")
    classes = rows.mapInArrow(_lines(least), schema).groupBy("line").agg(F.min(place).alias("place"), F.first("halves").alias("halves"))
    classes = written(classes, "lines")
    near = written(near_lines(docs, classes, id_col, text_col), "near_lines")
    kept = classes.join(near, "line", "left_anti").groupBy(F.col("place.id").alias("id"), F.col("place.text_key").alias("key")).agg(F.collect_list("place.number").alias("keep"))
    joined = docs.withColumn("own_key", F.xxhash64(F.col(text_col))).join(kept, F.col(id_col).eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left")
    schema = held.fields(T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()))
    return joined.select(*held.columns, "keep").mapInArrow(_rebuilt(held.columns, text_col, least), schema)


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_lines: bool = False) -> DataFrame:
    """The rows of docs with the text that is left, n_lines before and n_removed; with short_lines, equal lines of fewer than LEAST_WORDS words go too."""
    held = Held(docs, id=id_col, text=text_col)
    return held.given(without_repeats(held, short_lines), "n_lines", "n_removed")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeated_lines(docs, short_lines=True)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), "text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go; every document stays, with its n_chars brought up to date.

    All other columns stay as they are, whatever their names; null, empty, repeated and very long
    texts and an empty table are treated as by the operator.
    """
    held = Held(docs, id="doc_id", text="text")
    out = without_repeats(held, short_lines=True)
    if "n_chars" in docs.columns:
        at = held.columns[docs.columns.index("n_chars")]
        out = out.withColumn(at, F.length(held["text"]).cast(docs.schema["n_chars"].dataType))
    return held.given(out)
