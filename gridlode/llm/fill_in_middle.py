"""Fill-in-the-middle transformation.

The Split pre-tokenizer of the tokenizers library, with isolated matches of UNIT, gives the code-point
offsets of a text's units; nothing is trained. Their number is n, two hash draws choose the ranks at which
prefix and middle end, and the offsets at those ranks cut the text. Draws, forms and slices are column
expressions: only texts and draws go to Python, three numbers a row come back, and no row is shuffled.

Defined cases: a null text is empty; an empty text has no units and is plain; a null id draws by the seed
alone; rows that repeat get equal results; a text that holds a marker is plain, so that every output can be
taken apart again; a very long text is cut into units in slices that end where a unit does, so the offsets
in memory stay few; further columns pass through whatever their names, and those named like a result are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from gridlode.llm.columns import Held

#: White space with the word after it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: A unit ends here for certain.
UNIT_END = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
#: Code points handed to the pre-tokenizer at once, up to the next end of a unit.
SLICE_CHARS = 1 << 18
#: Starts of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]


def slices(text: str, limit: int = SLICE_CHARS) -> Iterator[tuple[int, str]]:
    """Parts of a text and where they start; each but the last ends where a unit ends."""
    at = 0
    while len(text) - at > limit:
        end = UNIT_END.search(text, at + limit)
        if not end:
            break
        yield at, text[at : end.start()]
        at = end.start()
    yield at, text[at:]


def unit_ends(split: pre_tokenizers.Split, text: str, limit: int = SLICE_CHARS) -> np.ndarray:
    """Offsets in code points at which the units end."""
    parts = [np.array([end for _, (_, end) in split.pre_tokenize_str(part)], dtype=np.int64) + at for at, part in slices(text, limit)]
    return np.concatenate(parts)


def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Number of units, and the offsets at which prefix and middle end."""
    split = pre_tokenizers.Split(Regex(UNIT), "isolated")
    for texts, first, second in batches:
        out = np.zeros((3, len(texts)), dtype=np.int64)
        for i, (text, a, b) in enumerate(zip(texts, first.to_pylist(), second.to_pylist(), strict=True)):
            ends = np.concatenate([[0], unit_ends(split, text.as_py())])
            n = len(ends) - 1
            lo, hi = sorted((a % (n + 1), b % (n + 1)))
            out[:, i] = n, ends[lo], ends[hi]
        yield pa.StructArray.from_arrays([pa.array(x) for x in out], names=["n", "prefix", "middle"])


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers that depend on seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _checked(markers: tuple[str, str, str]) -> None:
    """Outputs can be taken apart only if no marker can begin within another one or be made by one and text beside it."""
    ends = lambda x: {x[i:] for i in range(1, len(x))}
    starts = lambda x: {x[:i] for i in range(1, len(x))}
    if len(set(markers)) < 3 or not all(markers) or any(a in b and a != b or ends(a) & starts(b) for a in markers for b in markers):
        raise ValueError(f"markers that overlap: {markers}")


def fill_in_middle(
    docs: DataFrame, seed: int = 42, percent: int = 50, suffix_first_percent: int = 80, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of docs with n, form (plain, psm or spm), prefix_chars, middle_chars and output.

    percent of the texts are cut, suffix_first_percent of them with the suffix first (spm).
    """
    _checked(markers)
    held = Held(docs, id=id_col, text=text_col)
    text = F.coalesce(F.col(held["text"]), F.lit(""))
    h1, h2, h3, h4 = draws(seed, F.col(held["id"]))
    cut_points = F.arrow_udf(_cuts, "struct<n: long, prefix: long, middle: long>")
    rows = held.rows.select(*held.columns, text.alias("whole"), cut_points(text, h1, h2).alias("cut"), (h3 % 100).alias("h3"), (h4 % 100).alias("h4"))
    marked = F.lit(False)
    for m in markers:
        marked |= F.contains(F.col("whole"), F.lit(m))
    form = F.when((F.col("whole") == "") | marked | (F.col("h3") >= percent), "plain").when(F.col("h4") < suffix_first_percent, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    whole, lo, hi = F.col("whole"), F.col("cut.prefix").cast("int"), F.col("cut.middle").cast("int")
    p, s, m = map(F.lit, markers)
    prefix, middle, suffix = F.substring(whole, F.lit(1), lo), F.substring(whole, lo + 1, hi - lo), F.substring(whole, hi + 1, F.length(whole))
    plain = F.col("form") == "plain"
    output = F.when(plain, whole).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    out = rows.select(
        *held.columns, F.col("cut.n").alias("n"), "form", F.when(~plain, F.col("cut.prefix")).alias("prefix_chars"), F.when(~plain, F.col("cut.middle") - F.col("cut.prefix")).alias("middle_chars"), output.alias("output")
    )
    return held.given(out, *RESULTS)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of."""

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        """What stands after the first marker, after the second, and after the middle's."""
        at, last = F.instr(output, two), F.instr(output, markers[2])
        return (
            F.substring(output, F.lit(len(one) + 1), at - len(one) - 1),
            F.substring(output, at + len(two), last - at - len(two)),
            F.substring(output, last + len(markers[2]), F.length(output)),
        )

    prefix, suffix, middle = parts(markers[0], markers[1])
    suffix2, prefix2, middle2 = parts(markers[1], markers[0])
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


#: DuckDB SQL of op11_fill_in_middle.
OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
e AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
f AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:n], '') AS s
  FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
