"""Benchmark decontamination by winnowing.

Of every six consecutive five-word hashes the least is a fingerprint, on both sides. Any
shared span of ten words holds six such hashes, so the same one is least on both sides and
is found. Items of fewer than ten words are probed by the hash of all their words.

The fingerprints of the benchmark are set in a bitmap of FILTER_BITS, which has one size
whatever the benchmark is and is sent to all tasks. A document's fingerprints that it lets pass
mark the windows around them; only these leave the task. They are joined with the benchmark's
windows by their words, so the bitmap's false matches and equal hashes end there, and all
matched windows of a text, put together, are the whole shared span. Equal texts are searched once
each but looked up once, by two 64-bit hashes of the text.

Defined cases: a null or empty text has no words and no hits; an item without words is no
window; an item of fewer than ten words is one window; item ids that are null are left out
of the lists of items, though their windows hit; ids that repeat count once; an empty
benchmark hits nothing; a very long text is searched whole; rows that repeat have equal results;
further columns of docs pass through whatever their names, and those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlode.llm.columns import Held
from gridlode.llm.skew import join_hot
from gridlode.llm.storage import written
from gridlode.llm.textcols import ALNUM, Words, as_long, byte_column, column_of, hash_words, pieces, runs

WINDOW, GRAM = 10, 5
SLIDE = WINDOW - GRAM + 1
#: Bits of the filter (16 MiB), and of each of its blocks, which Spark's bitmap functions fix.
FILTER_BITS, BLOCK_BITS = 1 << 27, 32_768
#: Bytes of results that are broadcast to the documents; more are joined by a shuffle.
MAX_BROADCAST_BYTES = 32 << 20
RESULTS = ["n_words", "spans", "items"]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every item its windows (said, n), and the hashes that a document with one of them holds (probe)."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = hash_words(column_of(piece, "text"), ALNUM)
                count, ids = words.count, column_of(piece, "id").to_pylist()
                said, n, item, probe = [], [], [], []
                for length in sorted({int(min(x, WINDOW)) for x in count if x}):
                    found, at = runs(words, length)
                    if length < WINDOW:  # only items of just so many words
                        own = count[words.row[at]] == length
                        found, at = found[own], at[own]
                        probe += as_long(found).tolist()
                    else:
                        probe += [None] * len(at)
                    said += [_said(words, i, length) for i in at]
                    n += [length] * len(at)
                    item += [ids[words.row[i]] for i in at]
                grams, at = runs(words, GRAM)
                prints = np.unique(grams[winnow(grams, words.row[at])])
                said, n, item, probe = said + [None] * len(prints), n + [WINDOW] * len(prints), item + [None] * len(prints), probe + as_long(prints).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(said, pa.string()), pa.array(n, pa.int32()), pa.array(item, pa.string()), pa.array(probe, pa.int64())], names=["said", "n", "item", "probe"])


def _said(words: Words, start: int, n: int) -> str:
    """The words of a window, A-Z as a-z."""
    return b" ".join(words.text(i) for i in range(start, start + n)).lower().decode("utf-8", "surrogatepass")


def winnow(grams: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Indexes of the least hash of each SLIDE consecutive ones of a row; of a shorter row, of the least of all."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    width = np.minimum(SLIDE, np.searchsorted(row, row, "right") - best)  # rows are in order
    low = grams.copy()
    for i in range(1, SLIDE):
        ok = np.flatnonzero(width > i)
        better = ok[grams[ok + i] < low[ok]]
        low[better], best[better] = grams[better + i], better + i
    whole_slide = width == SLIDE
    whole_slide[np.searchsorted(row, np.unique(row))] = True
    return np.unique(best[whole_slide])


def bit_of(probe: Column) -> Column:
    """Place of a hash in the filter."""
    return F.pmod(probe, F.lit(FILTER_BITS))


def bitmap(probes: DataFrame) -> np.ndarray:
    """The filter of all probes: of FILTER_BITS, whatever their number."""
    blocks = probes.select(bit_of(F.col("probe")).alias("bit")).groupBy((F.col("bit") / BLOCK_BITS).cast("long").alias("block"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in blocks.agg(F.expr(f"bitmap_construct_agg(bit % {BLOCK_BITS})").alias("bits")).collect():
        out[r["block"] * BLOCK_BITS // 8 : (r["block"] + 1) * BLOCK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def passes(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = as_long(hashes) % FILTER_BITS
    return (filter_[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def marked(words: Words, filter_: np.ndarray, short: list[int]) -> Iterator[tuple[np.ndarray, int]]:
    """First words of the windows of each length that may stand in the benchmark."""
    grams, at = runs(words, GRAM)
    chosen = winnow(grams, words.row[at])
    hit = at[chosen][passes(filter_, grams[chosen])]
    near = np.unique((hit[:, None] - np.arange(SLIDE)).ravel())
    near = near[(near >= 0) & (near + WINDOW <= len(words.hash))]
    yield near[words.row[near] == words.row[near + WINDOW - 1]] if len(near) else near, WINDOW
    for n in short:
        found, at = runs(words, n)
        yield at[passes(filter_, found)], n


def _candidates(held, short: list[int]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for piece in pieces(batch, "text"):
                    words = hash_words(column_of(piece, "text"), ALNUM)
                    at, n, said = [], [], []
                    for starts, length in marked(words, held.value, short):
                        at += starts.tolist()
                        n += [length] * len(starts)
                        said += [_said(words, i, length) for i in starts]
                    at = np.array(at, dtype=np.int64)
                    row = words.row[at] if len(at) else np.zeros(0, np.int32)
                    kept = [column_of(piece, c).take(pa.array(row)) for c in ("k1", "k2")]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(at - words.first[row]), pa.array(n, pa.int32()), pa.array(said, pa.string())], names=["k1", "k2", "start", "n", "said"])

    return search


def _merged(spans: Column) -> Column:
    """Sorted spans, those that meet put together."""
    last = lambda out: F.element_at(out, -1)
    longer = lambda out, s: F.array(F.struct(last(out)["start"].alias("start"), F.greatest(last(out)["end"], s["end"]).alias("end")))
    meets = lambda out, s: F.coalesce(s["start"] <= F.get(out, F.size(out) - 1)["end"], F.lit(False))
    add = lambda out, s: F.when(meets(out, s), F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), longer(out, s))).otherwise(F.concat(out, F.array(s)))
    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def keys_of(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def found_in(rows: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """k1, k2, spans and items of every text that holds a window of the benchmark."""
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
    made = written(items.mapInArrow(_windows, "said string, n int, item string, probe long"), "windows")
    short = [r["n"] for r in made.where(f"n < {WINDOW}").select("n").distinct().collect()]  # nine at most
    held = rows.sparkSession.sparkContext.broadcast(bitmap(made.where("probe IS NOT NULL")))
    texts = rows.select(*keys_of(F.col(text_col)), F.col(text_col).alias("text"))
    candidates = texts.mapInArrow(_candidates(held, sorted(short)), "k1 long, k2 long, start long, n int, said string")
    candidates = written(candidates.distinct(), "candidates")
    windows = made.where("said IS NOT NULL").groupBy("said").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = join_hot(candidates, windows, ["said"], F.struct("k1", "start"))
    span = F.struct("start", (F.col("start") + F.col("n")).alias("end"))
    each = hits.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(span)).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return written(each.withColumn("spans", _merged(F.col("spans"))), "found")


def _counted(columns: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col):
                buf, offsets = byte_column(column_of(piece, text_col))
                inside = ALNUM[buf]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                first = offsets[:-1][offsets[:-1] < len(buf)]
                begins[first] = inside[first]
                before = np.concatenate([[0], np.cumsum(begins)])
                yield pa.RecordBatch.from_arrays([*(column_of(piece, c) for c in columns), pa.array(np.diff(before[offsets]).astype(np.int64))], names=[*columns, "n_words"])

    return run


def overlap(held: Held, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The held rows with n_words, spans and items."""
    found = found_in(held.rows, held["text"], benchmark, item_col, item_text_col)
    size = found.agg(F.sum(32 + 16 * F.size("spans") + F.length(F.array_join("items", "  ")))).first()[0] or 0
    counted = held.rows.mapInArrow(_counted(held.columns, held["text"]), held.fields(T.StructField("n_words", T.LongType())))
    keyed = counted.select("*", *keys_of(F.col(held["text"])))
    if size <= MAX_BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(found), ["k1", "k2"], "left")
    else:
        joined = join_hot(keyed, found, ["k1", "k2"], F.xxhash64(*[c for c in held.columns if c != held["text"]], F.lit(1)), "left")
    none = [F.coalesce(c, F.array()).alias(c) for c in ("spans", "items")]
    return joined.select(*held.columns, "n_words", *none)


def find_overlap(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs with n_words, spans (merged, in words) and items (ids as strings, sorted)."""
    held = Held(docs, text=text_col)
    return held.given(overlap(held, benchmark, item_col, item_text_col), *RESULTS)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_overlap(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that share a window with the benchmark go.

    All columns stay as they are, whatever their names; null, empty, repeated and very long texts
    and an empty table are treated as by the operator.
    """
    held = Held(docs, text="text")
    return held.given(overlap(held, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("spans") == 0))


#: DuckDB SQL of op4_decontaminate.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
u AS (SELECT DISTINCT item_id, n, t FROM bw),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, u.item_id FROM dw JOIN u ON dw.n = u.n AND dw.t = u.t),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
