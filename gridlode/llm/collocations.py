"""Phrase collocation mining by hashed passes.

Pass k reads the documents once. It counts phrases of k words exactly, but only those that can be frequent:
both their parts of k - 1 words are frequent (Apriori) and their bucket holds min_count occurrences. In the same
pass it counts, by buckets of a hash, those phrases of k + 1 words both of whose parts passed, so that the next
pass has its buckets. Frequent parts and full buckets go to the tasks as two bitmaps of 2^BUCKET_BITS bits, which have
one size whatever the corpus is; they only ever let too much pass, and what passes is counted by its language and words.
Counts leave a task added up, buckets no higher than min_count. The frequent phrases, not the documents, are then
joined with their parts' counts and their longer phrases.

Phrases are told apart by 64-bit hashes only within one piece of a task's texts (PIECE_BYTES); all counts
that meet in a shuffle meet by words.

Defined cases: a null or empty text has no words; a null language is `und` and is one with a language of that name; rows that
repeat count each; a piece of fewer words than a phrase has none of it; a very long text is counted whole;
phrases of equal score and count are ranked by their bytes; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlode.llm.storage import written
from gridlode.llm.textcols import Words, as_long, column_of, hash_words, mix, pieces, runs

#: Bytes that end a piece of text, and those that only part words.
ENDS, GAPS = b".,;:!?\n\v\f\r", b" \t"
WORD = np.array([b not in ENDS + GAPS for b in range(256)])
ENDS_PIECE = np.array([b in ENDS for b in range(256)])
#: Buckets and bits of each bitmap: 4 MiB of bits, 32 MiB of counts in a task.
BUCKET_BITS = 25
BLOCK_BITS = 32_768  # fixed by Spark's bitmap functions
#: Bytes of text that are hashed at a time (a longer text at once), and buckets whose counts leave a task at a time.
PIECE_BYTES, SLOTS_OUT = 1 << 19, 1 << 17
#: Parts in which a language's phrases are ranked before their best are ranked together.
RANK_PARTS = 64


def _lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def by_piece(words: Words) -> Words:
    """The words with numbers of their pieces in place of rows."""
    if not len(words.hash):
        return words
    ends = np.concatenate([[0], np.cumsum(ENDS_PIECE[words.buf])])
    new = (words.row[1:] != words.row[:-1]) | (ends[words.start[1:]] != ends[words.end[:-1]])
    return replace(words, row=np.concatenate([[0], np.cumsum(new)]))


@dataclass
class Grams:
    """Hashes of the runs of k words within a piece, by language, and each run's first word."""

    hash: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, words: Words, k: int, lang: np.ndarray) -> Grams:
        """lang holds a key for each word."""
        found, at = runs(words, k)
        return cls(mix(found ^ lang[at]), at)

    def that_pass(self, *bitmaps: np.ndarray | None) -> np.ndarray:
        ok = np.ones(len(self.hash), bool)
        for bits in bitmaps:
            if bits is not None:
                slot = slots(self.hash)
                ok &= (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        return ok

    def whose_parts(self, parts: Grams, ok: np.ndarray, words: int) -> np.ndarray:
        """Which of these runs have two parts, one word shorter, that are ok."""
        first = np.zeros(words + 1, bool)
        first[parts.at[ok]] = True
        return first[self.at] & first[self.at + 1]


def slots(hashes: np.ndarray) -> np.ndarray:
    return as_long(hashes >> np.uint64(64 - BUCKET_BITS))


COUNTED = "lang string, phrase string, bucket long, c long"


def _rows(lang, phrase, bucket, c) -> pa.RecordBatch:
    n = len(c)
    columns = [pa.array(lang if lang is not None else [None] * n, pa.string()), pa.array(phrase if phrase is not None else [None] * n, pa.string()), pa.nulls(n, pa.int64()) if bucket is None else pa.array(bucket), pa.array(c, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "bucket", "c"])


def said(words: Words, at: np.ndarray, k: int) -> list[str]:
    """The k words from each place on, A-Z as a-z, parted by one space."""
    raw, start, end = words.buf.tobytes(), words.start[at].tolist(), words.end[at + k - 1].tolist()
    return [b" ".join(raw[a:b].lower().split()).decode("utf-8", "surrogatepass") for a, b in zip(start, end, strict=True)]


def _pass(k: int, longest: int, min_count: int, frequent: Broadcast | None, full: Broadcast | None):
    """Count phrases of k words that can be frequent (with k = 1 also all words: no phrase), and buckets of k + 1."""
    most = np.uint8(min(min_count, 255)) if min_count <= 255 else np.uint32(min_count)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.zeros(1 << BUCKET_BITS if k < longest else 0, most.dtype)
        with np.errstate(over="ignore"):
            for batch in batches:
                for piece in pieces(batch, "text", PIECE_BYTES):
                    langs = column_of(piece, "lang").to_pylist()
                    keys = {x: _lang_key(x) for x in set(langs)}
                    plain = hash_words(column_of(piece, "text"), WORD)
                    lang = np.array([keys[x] for x in langs], np.uint64)[plain.row]
                    words = by_piece(plain)
                    grams = Grams.of(words, k, lang)
                    ok = grams.that_pass(full.value if full else None)
                    if frequent:
                        parts = Grams.of(words, k - 1, lang)
                        ok &= grams.whose_parts(parts, parts.that_pass(frequent.value), len(words.hash))
                    _, first, n = np.unique(grams.hash[ok], return_index=True, return_counts=True)
                    at = grams.at[ok][first]
                    yield _rows([langs[r] for r in plain.row[at]], said(words, at, k), None, n)
                    if k == 1:
                        total = dict.fromkeys(langs, 0)
                        for x, c in zip(langs, plain.count.tolist(), strict=True):
                            total[x] += c
                        yield _rows(list(total), None, None, list(total.values()))
                    if k < longest:
                        longer = Grams.of(words, k + 1, lang)
                        if k > 1:
                            longer.hash = longer.hash[longer.whose_parts(grams, ok, len(words.hash))]
                        slot, n = np.unique(slots(longer.hash), return_counts=True)
                        buckets[slot] = np.minimum(buckets[slot].astype(np.int64) + n, most).astype(most.dtype)
        for lo in range(0, len(buckets), SLOTS_OUT):
            held = lo + np.flatnonzero(buckets[lo : lo + SLOTS_OUT])
            yield _rows(None, None, held, buckets[held].astype(np.int64))

    return count


def bitmap(slots_: DataFrame) -> np.ndarray:
    """2^BUCKET_BITS bits, those in the column slot set; they come to the driver as blocks of one size."""
    blocks = slots_.groupBy((F.col("slot") / BLOCK_BITS).cast("long").alias("block")).agg(F.expr(f"bitmap_construct_agg(slot % {BLOCK_BITS})").alias("bits"))
    out = np.zeros((1 << BUCKET_BITS) // 8, np.uint8)
    for r in blocks.collect():
        out[r["block"] * BLOCK_BITS // 8 : (r["block"] + 1) * BLOCK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _slots_of(k: int):
    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                words = hash_words(column_of(batch, "phrase"), WORD)
                lang = np.array([_lang_key(x) for x in column_of(batch, "lang").to_pylist()], np.uint64)[words.row]
                yield pa.RecordBatch.from_arrays([pa.array(slots(Grams.of(words, k, lang).hash))], names=["slot"])

    return slots_of


def counted(docs: DataFrame, longest: int, min_count: int, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """Words of each language (lang, n), and its frequent phrases of 1 to longest words (lang, phrase, k, f)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    frequent = full = totals = None
    found = []
    for k in range(1, longest + 1):
        rows = texts.mapInArrow(_pass(k, longest, min_count, frequent, full), COUNTED)
        rows = rows.groupBy("lang", "phrase", "bucket").agg(F.sum("c").alias("c"))
        kept = (F.col("c") >= min_count) | (F.col("phrase").isNull() & F.col("bucket").isNull())
        rows = written(rows.where(kept), f"phrases of {k}")
        if k == 1:
            totals = rows.where("phrase IS NULL AND bucket IS NULL").select("lang", F.col("c").alias("n"))
        phrases = rows.where("phrase IS NOT NULL").select("lang", "phrase", F.lit(k).alias("k"), F.col("c").alias("f"))
        found.append(phrases)
        if k < longest:
            frequent = send(spark, phrases.select("lang", "phrase").mapInArrow(_slots_of(k), "slot long"))
            full = send(spark, rows.where("bucket IS NOT NULL").select(F.col("bucket").alias("slot")))
    every = found[0]
    for phrases in found[1:]:
        every = every.unionByName(phrases)
    return totals, every


def send(spark: SparkSession, slots_: DataFrame) -> Broadcast:
    return spark.sparkContext.broadcast(bitmap(slots_))


def cut_scores(frequent: DataFrame, least_words: int = 2) -> DataFrame:
    """Candidates (lang, phrase, k, a) with score, l and r of their lowest-scoring cut."""
    words = F.split("phrase", " ")
    of = lambda name: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(name[0]))
    cuts = frequent.where(F.col("k") >= least_words).select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    scored = cuts.join(of("left"), ["lang", "left"]).join(of("right"), ["lang", "right"])
    score = F.expr("cast(2000000 AS decimal(7,0)) * cast(a AS decimal(19,0)) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")
    worst = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("worst")
    return scored.groupBy("lang", "phrase", "k", "a").agg(worst).select("lang", "phrase", "k", "a", "worst.score", "worst.l", "worst.r")


def parts_of_longer(frequent: DataFrame, least_words: int = 2) -> DataFrame:
    """Of every phrase that stands in a longer frequent one: the largest count of those (lang, phrase, longer)."""
    long = frequent.where(F.col("k") > least_words).select("lang", "k", "f", F.split("phrase", " ").alias("w"))
    sized = long.withColumn("size", F.explode(F.sequence(F.lit(least_words), F.col("k") - 1)))
    placed = sized.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    part = F.array_join(F.slice("w", F.col("at"), F.col("size")), " ")
    return placed.groupBy("lang", part.alias("phrase")).agg(F.max("f").alias("longer"))


def best(phrases: DataFrame, top: int) -> DataFrame:
    """The first top phrases of each language with their rank, ranked within parts of a language first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    few = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("rank", number("lang", "part")).where(F.col("rank") <= top)
    return few.withColumn("rank", number("lang").cast("long")).where(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, longest: int = 4, min_count: int = 30, covered_percent: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first top phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to longest words that occurs min_count times is left out if a longer one around it
    occurs covered_percent of its times.
    """
    totals, frequent = counted(docs, longest, min_count, text_col, lang_col)
    scored = cut_scores(frequent).join(parts_of_longer(frequent), ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    own = scored.where(F.col("longer").isNull() | (100 * wide("longer") < covered_percent * wide("a")))
    ranked = best(own.select("lang", "phrase", "a", "l", "r", "score"), top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


#: DuckDB SQL of op13_collocations.
OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, count(*)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, cut, ((2000000 * a::HUGEINT) // (x.f + y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(s[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(s[cut + 1:c.k], ' ')),
lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, k, f, string_split(phrase, ' ') AS s, unnest(range(2, k)) AS size FROM f WHERE k > 2),
i AS (SELECT *, unnest(range(1, k - size + 2)) AS b FROM h),
longer AS (SELECT lang, array_to_string(s[b:b + size - 1], ' ') AS phrase, max(f) AS f FROM i GROUP BY ALL),
kept AS (SELECT z.* FROM lowest z LEFT JOIN longer o ON o.lang = z.lang AND o.phrase = z.phrase WHERE o.f IS NULL OR 100 * o.f < 80 * z.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""
