"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents are ordered by
that key: the key range is cut into buckets, prefix sums of words run over the buckets,
and only the bucket in which the source's budget ends is sorted, to find the exact cut.
A document's share then follows from its key and its source's cut, so texts are never
shuffled and a hot source is spread over many buckets.

Defined cases: a null text has no words; a null source is a source of its own, the last;
rows without words take 0 words; repeated rows (same id and size) share the words left at
the cut evenly, rounded down; sources of equal size per weight are filled in the order of their
names; a very long text counts with all its words; an empty table gives an empty result; any other
columns pass through whatever their names, and those named like an added column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlode.llm.columns import Held
from gridlode.llm.skew import join_hot
from gridlode.plans.materialize import materialize, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
#: One row per source is broadcast up to this many sources; beyond, the cuts are joined by a shuffle.
MAX_BROADCAST_SOURCES = 50_000
#: Rows of a source in one sorted range, on average.
BUCKET_ROWS = 100_000
KEY_HEX = 15


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column) -> Column:
    """60 bits that depend on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, KEY_HEX), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share_percent: int, max_epochs: int) -> DataFrame:
    """Words that each source (source, source_size) is to give.

    The share is dealt by weight; sources whose deal exceeds max_epochs times their size
    stop there and the rest is dealt again among the others. Sorted by size per weight, the
    stopped sources come first, so one prefix sum finds them. The windows here run over one
    row per source.
    """
    n = len(weights)
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    of_rank = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(in_order) - 1) % n + 1).cast("int"))
    weighed = sizes.withColumn("weight", of_rank.cast("decimal(38,0)")).withColumn("whole", F.col("source_size").cast("decimal(38,0)"))
    by_fill = Window.orderBy((F.col("whole") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    summed = lambda c, w: F.sum(c).over(w).cast("decimal(38,0)")
    filled = (
        weighed.withColumn("all_words", summed("whole", everything))
        .withColumn("stopped", F.coalesce(summed("whole", by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)"))
        .withColumn("open_weight", summed("weight", by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        # everything times 100, so that the comparison is exact
        .withColumn("left", (share_percent * F.col("all_words") - 100 * max_epochs * F.col("stopped")).cast("decimal(38,0)"))
        .withColumn("full", (100 * max_epochs * F.col("whole")).cast("double") * F.col("open_weight").cast("double") <= F.col("weight").cast("double") * F.col("left").cast("double"))
    )
    open_left = F.min(F.when(~F.col("full"), F.struct(F.col("whole") / F.col("weight"), F.col("source").isNull(), "source", "left", "open_weight"))).over(everything)
    return filled.withColumn("level", open_left).select(
        "source",
        "source_size",
        F.when(F.col("full"), (max_epochs * F.col("source_size")).cast("double"))
        .otherwise(F.col("weight").cast("double") * F.col("level.left").cast("double") / (100.0 * F.col("level.open_weight").cast("double")))
        .alias("target"),
    )


def cuts(sized: DataFrame, weights: tuple[int, ...], share_percent: int, max_epochs: int) -> DataFrame:
    """Per source: its target, whole epochs, and the key, id and size at which the part epoch ends."""
    spark = sized.sparkSession
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    sizes = materialize(sizes)
    budget = (
        targets(sizes.select("source", "source_size"), weights, share_percent, max_epochs)
        .withColumn("words", F.floor("target"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
    )
    most = sizes.agg(F.max("source_rows")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-most // BUCKET_ROWS))
    bucketed = sized.withColumn("bucket", F.floor(F.col("key") / F.lit(16.0**KEY_HEX) * buckets))
    before = F.coalesce(F.sum("bucket_words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prefix = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_words")).withColumn("before", before)
    b, p = budget.alias("b"), prefix.alias("p")
    ends = (
        b.join(p, F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("bucket_words")), "left")
        .select("b.*", "p.bucket", "p.before")
    )
    ends = materialize(ends)
    e, r = few_or_shuffled(ends.where("bucket IS NOT NULL")).alias("e"), bucketed.alias("r")
    tied = r.join(e, F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.bucket") == F.col("e.bucket"))).select("r.source", "r.key", "r.id", "r.size", "e.rest", "e.before")
    tied = tied.groupBy("source", "key", "id", "size", "rest", "before").agg(F.count(F.lit(1)).alias("copies"))
    ordered = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first(), "size")
    tied = tied.withColumn("from", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = tied.where((F.col("from") <= F.col("rest")) & (F.col("rest") < F.col("from") + F.col("size") * F.col("copies")))
    cut = cut.select("source", F.struct("key", "id", "size").alias("cut"), F.expr("(rest - from) div copies").alias("part"))
    a, c = ends.alias("a"), cut.alias("c")
    out = a.join(c, F.col("a.source").eqNullSafe(F.col("c.source")), "left")
    return materialize(out.select("a.source", "a.source_size", "a.target", "a.epochs", "c.cut", "c.part"))


def few_or_shuffled(per_source: DataFrame) -> DataFrame:
    """Broadcast one row per source when they are few; the rows are checkpointed, so counting them is cheap."""
    return F.broadcast(per_source) if per_source.count() <= MAX_BROADCAST_SOURCES else per_source


def mixed(held: Held, weights: tuple[int, ...], share_percent: int, max_epochs: int) -> DataFrame:
    """The held rows with size, source_size, target and taken."""
    doc_id, source = F.col(held["id"]), F.col(held["source"])
    size = word_count(F.col(held["text"]))
    sized = materialize(held.rows.select(source.alias("source"), doc_id.alias("id"), random_key(doc_id).alias("key"), size.alias("size")))
    per_source = cuts(sized, weights, share_percent, max_epochs)
    few = per_source.count() <= MAX_BROADCAST_SOURCES
    rows = held.rows.select(*held.columns, F.struct(random_key(doc_id).alias("key"), doc_id.alias("id"), size.alias("size")).alias("at"), named(source).alias("of"))
    s = per_source.select(named(F.col("source")).alias("of"), "source_size", "target", "epochs", "cut", "part")
    joined = rows.join(F.broadcast(s), "of", "left") if few else join_hot(rows, s, ["of"], doc_id, "left")
    last = F.when(F.col("cut").isNull() | (F.col("at") > F.col("cut")), F.lit(0)).when(F.col("at") == F.col("cut"), F.col("part")).when(F.col("at") < F.col("cut"), F.col("at.size")).otherwise(F.col("part"))
    return joined.select(*held.columns, F.col("at.size").alias("size"), "source_size", "target", (F.col("epochs") * F.col("at.size") + last).cast("long").alias("taken"))


def named(source: Column) -> Column:
    """A key that is never null: whether the source is, and its name."""
    return F.struct(source.isNull().alias("none"), F.coalesce(source.cast("string"), F.lit("")).alias("name"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share_percent: int = 150, max_epochs: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs with size, source_size, target and taken: the words that the mix takes of each, repeats counted."""
    held = Held(docs, id=id_col, text=text_col, source=source_col)
    return held.given(mixed(held, weights, share_percent, max_epochs), "size", "source_size", "target", "taken")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the mix takes, with size, source_size, target and taken; documents of which nothing is taken go.

    Other columns stay as they are, whatever their names; columns named like those four are replaced. Null, empty,
    repeated and very long texts and an empty table are treated as by the operator.
    """
    return mix(docs).where(F.col("taken") > 0)


#: DuckDB SQL of op7_mixing.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT source, ss, CASE rn % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS w FROM s),
f AS (
  SELECT *, (150 * sum(ss) OVER () - 200 * coalesce(sum(ss) OVER (ORDER BY ss::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
         (sum(w) OVER (ORDER BY ss::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS ow
  FROM w),
g AS (SELECT *, (200 * ss)::DOUBLE * ow <= w::DOUBLE * rest AS fullone FROM f),
h AS (SELECT rest, ow FROM g WHERE NOT fullone ORDER BY ss::DOUBLE / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, ss, CASE WHEN fullone THEN (2 * ss)::DOUBLE ELSE w::DOUBLE * (SELECT rest FROM h) / (100.0::DOUBLE * (SELECT ow FROM h)) END AS target FROM g),
b AS (SELECT *, floor(target)::BIGINT AS words, CASE WHEN ss > 0 THEN floor(target)::BIGINT // ss ELSE 0 END AS epochs FROM t),
c AS (
  SELECT d.*, b.ss, b.target, b.epochs, b.words - b.epochs * b.ss AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, ss AS source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM c
"""
