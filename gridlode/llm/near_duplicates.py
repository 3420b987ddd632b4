"""Near-duplicate groups by SuperMinHash, banding, verification on full sets, and union-find.

A document's set holds its distinct runs of five words. SuperMinHash gives every element a
permutation of the signature's places: the element competes at its first place with a value
below 1, at its second with one below 2, and so on, and stops as soon as every place of the
document holds less. The permutation is a line modulo the prime RANKS, so any two places have
the joint distribution of a uniform permutation, on which the lower variance rests.

Equal sets become one class first. Classes that agree in a band meet in a bucket, where each
is compared with the bucket's most central class only. Verified links join classes into
components; then those members of one bucket that are still in different components are
compared, where their rarest shingles meet early enough, so no link is lost to the choice of
representatives, and a group of copies costs about as many comparisons as it has members.
A similarity of 0.75 escapes all BANDS bands of BAND_ROWS values with a probability of 1e-10.
Links are confirmed on the full sets of 64-bit shingle hashes. Rows of hot buckets, representatives, shingles and
labels are dealt over tasks.

Defined cases: a null text or one without words is empty and linked with nothing; fewer than
five words count as one shingle; rows without an id take part and take the least id of their
group, null if it has none; rows that repeat are copies, of which the first by a hash of all columns
stays; of equally central classes the greater hash is compared with; a very long text has its whole
set; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlode.llm.columns import Held
from gridlode.llm.skew import Dealt, join_hot
from gridlode.llm.storage import written
from gridlode.llm.textcols import as_long, column_of, hash_words, mix, pieces, runs, whole
from gridlode.plans.materialize import materialize

SHINGLE, PERCENT = 5, 75
RANKS, BAND_ROWS = 127, 3
BANDS = RANKS // BAND_ROWS
#: Central classes, of up to BANDS buckets, that each class is compared with at first.
REPS = 3

U64 = np.uint64


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, row by row and sorted within it, and their number by row."""
    words = hash_words(column)
    grams, at = runs(words, SHINGLE)
    cut = np.searchsorted(words.row[at], np.arange(len(column) + 1)) if len(at) else np.zeros(len(column) + 1, np.int64)
    n = words.count
    sets = [np.unique(grams[cut[r] : cut[r + 1]]) if n[r] >= SHINGLE else np.array([whole(words, r)] if n[r] else [], dtype=U64) for r in range(len(column))]
    return np.concatenate([np.zeros(0, U64), *sets]), np.array([len(s) for s in sets], dtype=np.int64)


def superminhash(elements: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Signatures, rows by RANKS; the top byte of a value is the rank at which it was drawn."""
    signature = np.full(rows * RANKS, np.iinfo(U64).max, dtype=U64)
    seed = mix(elements ^ U64(0x5851F42D4C957F2D))
    start = (seed & U64(0xFFFFFFFF)) % U64(RANKS)
    step = (seed >> U64(32)) % U64(RANKS - 1) + U64(1)
    for rank in range(RANKS):
        place = ((start + U64(rank) * step) % U64(RANKS)).astype(np.int64)
        drawn = (mix(elements + U64((rank + 1) * 0xD1342543DE82EF95 % 2**64)) >> U64(8)) | U64(rank << 56)
        np.minimum.at(signature, row * RANKS + place, drawn)
        open_rows = (signature.reshape(rows, RANKS).max(axis=1) >> U64(56)) > rank
        going = open_rows[row]
        if not going.any():
            break
        elements, row, start, step = elements[going], row[going], start[going], step[going]
    return signature.reshape(rows, RANKS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for piece in pieces(batch, "text"):
                elements, count = shingle_sets(column_of(piece, "text"))
                rows = piece.num_rows
                row = np.repeat(np.arange(rows), count)
                sums = [np.zeros(rows, U64), np.zeros(rows, U64)]
                for total, salt in zip(sums, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), strict=True):
                    np.add.at(total, row, mix(elements ^ U64(salt)))
                signature = superminhash(elements, row, rows)
                in_bands = signature[:, : BANDS * BAND_ROWS].reshape(rows, BANDS, BAND_ROWS)
                band = mix(np.arange(1, BANDS + 1, dtype=U64))[None, :]
                for i in range(BAND_ROWS):
                    band = mix(band * U64(0x9DDFEA08EB382D69) + in_bands[:, :, i])
                empty = count == 0
                offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [
                        column_of(piece, "id"),
                        column_of(piece, "text_key"),
                        pa.array(count),
                        pa.array(as_long(sums[0]), mask=empty),
                        pa.array(as_long(sums[1])),
                        pa.ListArray.from_arrays(offsets, pa.array(as_long(band.ravel()))),
                    ],
                    names=["id", "text_key", "n_shingles", "node", "check", "bands"],
                )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            elements, count = shingle_sets(column_of(piece, "text"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([column_of(piece, "node"), pa.array(count), pa.ListArray.from_arrays(offsets, pa.array(as_long(elements)))], names=["node", "n", "shingles"])


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, text_key, n_shingles, node and check (hashes of the set) and bands."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("text_key long, n_shingles long, node long, check long, bands array<long>").fields])
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(_sign, schema), "signatures")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("set_b"))
    both = join_hot(pairs, b, ["b"], F.col("a")).join(a, "a").where((100 * F.col("na") >= PERCENT * F.col("nb")) & (100 * F.col("nb") >= PERCENT * F.col("na")))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.withColumn("common", common).where(100 * F.col("common") >= PERCENT * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def apart(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of buckets' members in different components that may be linked.

    Of two linked sets in one order of elements, the first quarters meet. The order is by
    rarity, so a text's own words come first and those that a whole group shares seldom count.
    """
    mixed = written(members.select("band", "node").join(labels, "node"), "labelled")
    differ = mixed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    open_nodes = join_hot(mixed, differ, ["band"], F.col("node")).groupBy("node").agg(F.min("label").alias("label"))
    held = written(sets.join(open_nodes, "node"), "open")
    each = held.select("node", F.explode("shingles").alias("s"))
    shared = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    order = join_hot(each, shared, ["s"], F.col("node")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("rare"))
    own = F.col("n") - F.size("rare")
    quarter = F.col("n") - F.ceil(PERCENT * F.col("n") / 100) + 1
    lead = held.select("node", "n", "label").join(order, "node").withColumn("take", (quarter - own).cast("int")).where("take > 0")
    lead = lead.select("node", "n", "label", own.alias("own"), F.posexplode(F.slice("rare", F.lit(1), F.col("take"))).alias("at", "e"))
    # as many elements are left from here on, which bounds what two sets share if this is the first that they share
    lead = written(lead.select("node", "n", "label", "e.s", (F.col("n") - F.col("own") - F.col("at")).alias("left")), "leads")
    several = lead.groupBy("s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("s")
    lead = written(join_hot(lead, several, ["s"], F.col("node")), "leads")
    other = lead.select("s", *[F.col(c).alias(f"o_{c}") for c in ("node", "n", "label", "left")])
    close = (100 * F.col("n") >= PERCENT * F.col("o_n")) & (100 * F.col("o_n") >= PERCENT * F.col("n"))
    enough = (100 + PERCENT) * F.least("left", "o_left") >= PERCENT * (F.col("n") + F.col("o_n"))
    pairs = join_hot(lead, other, ["s"], F.col("node")).where((F.col("label") < F.col("o_label")) & close & enough)
    return pairs.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and label, the least node reachable: least labels spread over edges, and every label jumps to its own label."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = Dealt(materialize(both.distinct()), ["a"], F.col("b"))
    labels = materialize(nodes.select("node", F.col("node").alias("label")))
    while True:
        from_edges = both.join(labels.withColumnRenamed("node", "a")).select(F.col("b").alias("node"), "label")
        spread = materialize(labels.unionByName(from_edges).groupBy("node").agg(F.min("label").alias("label")))
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = join_hot(spread, jump, ["label"], F.col("node"), "left").select("node", F.least("label", "further").alias("label"))
        new = materialize(jumped)
        moved = new.withColumnRenamed("label", "new").join(labels, "node").where(F.col("new") != F.col("label")).limit(1).count()
        labels = new
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, text_key, n_shingles and component_id, the least id of its group."""
    rows = signed(docs, id_col, text_col)
    grouped = rows.where("node IS NOT NULL").groupBy("node", "check").agg(
        F.min("id").alias("first_id"),
        F.min(F.struct("id", "text_key")).alias("one"),
        F.count(F.lit(1)).alias("copies"),
        F.first("bands").alias("bands"),
    )
    classes = written(grouped, "classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("band")
    members = written(join_hot(banded, buckets, ["band"], F.col("node")), "members")
    nodes = written(members.groupBy("node").agg(F.lit(1).alias("one")).select("node"), "nodes")
    found = classes.join(nodes, "node").select("node", "one.id", "one.text_key")
    texts = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"), F.col(text_col).alias("text"))
    texts = found.join(texts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select("node", "text")
    sets = written(texts.mapInArrow(_sets, "node long, n long, shingles array<long>"), "sets")

    # the member that meets most others is the nearest to the core of its bucket
    size = members.groupBy("band").agg(F.count(F.lit(1)).alias("size"))
    by_band = Dealt(members, ["band"], F.col("node"))
    central = by_band.join(size).groupBy("node").agg(F.sum("size").alias("meets"))
    ranked = members.join(central, "node")
    reps = ranked.groupBy("band").agg(F.max_by("node", F.struct("meets", "node")).alias("rep"))
    stars = by_band.join(reps).where("node <> rep").groupBy("node", "rep").agg(F.count(F.lit(1)).alias("agree"))
    best = stars.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("agree", "rep")), False), 1, REPS).alias("best"))
    first = written(linked(best.select(F.col("node").alias("a"), F.explode("best.rep").alias("b")), sets), "links")
    labels = components(first, nodes)
    second = written(linked(apart(members, labels, sets), sets), "more_links")
    if not second.isEmpty():
        labels = components(first.unionByName(second), nodes)
    groups = classes.join(labels, "node", "left").where("copies > 1 OR label IS NOT NULL").select("node", "check", "first_id", F.coalesce("label", "node").alias("label"))
    groups = materialize(groups)
    least = groups.groupBy("label").agg(F.min("first_id").alias("component_id"))
    known = join_hot(groups, least, ["label"], F.col("node")).select("node", "check", F.lit(True).alias("grouped"), "component_id")
    out = join_hot(rows.select("id", "text_key", "n_shingles", "node", "check"), known, ["node", "check"], F.col("id"), "left")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", "text_key", "n_shingles", component.alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the least id of each group; rows that repeat in id and text stay once."""
    held = Held(docs, id=id_col, text=text_col)
    found = near_duplicates(held.rows, held["id"], held["text"])
    stay = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select("id", F.col("text_key").alias("key")).distinct()
    keyed = held.rows.withColumn("own_key", text_key(F.col(held["text"])))
    kept = keyed.join(stay, F.col(held["id"]).eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left_semi")
    whole = F.struct(*held.columns)
    one = kept.groupBy(F.col(held["id"]).alias("id"), "own_key").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row"))
    return held.given(one.select("row.*"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, the one with the least id; texts without words all stay.

    All columns stay as they are, whatever their names; null, empty, repeated and very long texts
    and an empty table are treated as by the operator.
    """
    return deduplicate(docs)


#: DuckDB SQL of op3_near_dedup.
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, g.m AS component_id, d.doc_id = g.m AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.a = d.doc_id
"""
