"""Quality rules: counts of a text, and its divergence from language references.

The references are histograms of each language: one of character classes, one of common words.
They are pooled over all long enough documents of the language, and then once more over those
that are near the first ones, so junk has no part in them. A document is compared with every
reference by Jensen-Shannon divergence. It is near a reference if its classes are within a fixed
distance, with an allowance for chance, and its common words either are nearer than halfway between
what chance gives at its length and what a text without any common word has, or make up half the
reference's share at least. Texts under the minimum length are not judged by it. Everything is a column expression; the counts are written once,
so a text is read once, and only the pooled histograms, of fixed size, are gathered.

Repeated windows of words are found by 64-bit hashes of them.

Defined cases: a null or empty text has no words and fails the base rule; a null or
unlisted lang adds to no reference; without any reference the distances are null and
only the base rule counts; a distance of exactly the limit is kept; repeated rows are judged alike; a
very long text is counted whole; further columns pass through whatever their names, and those
named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlode.llm.columns import Held
from gridlode.llm.storage import written

#: White space that separates words, and symbols.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"
#: Common words, by language.
COMMON = {
    "de": "der die und in den von zu das sich mit auf für des ist im dem nicht ein eine als".split(),
    "en": "the of and to a in is that it for was on with as be by are this at from".split(),
    "es": "de la que el en y los se las del un por con no una para su es al lo".split(),
    "fr": "de la le et les des en un du une que est pour par avec qui dans pas sur au".split(),
}
COMMON_WORDS = sorted({w for words in COMMON.values() for w in words})
#: Character classes counted by pattern; the others are symbols, white space and the rest.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "beyond": r"[^\x00-\x7F]", "mark": r"[!\x22'()+,\-./:;=?@\[\\\]^_`{}~]"}
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Class distance beyond which a text is rejected, and the share of the chance spread that is allowed more.
MAX_CLASS_DISTANCE, CHANCE = 0.25, 1.0
#: With more different repeated windows than this, positions are found by a sort instead of look-ups.
FEW_WINDOWS = 500
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept"]


def _runs(numbers: Column) -> Column:
    """Distinct numbers of a sorted array, each with its count."""
    last = F.filter(F.transform(numbers, lambda x, i: F.when(~x.eqNullSafe(F.get(numbers, i + 1)), F.struct(x.alias("j"), (i + 1).alias("end")))), lambda e: e.isNotNull())
    return F.transform(last, lambda e, k: F.struct(e["j"].alias("j"), (e["end"] - F.coalesce(F.get(last, k - 1)["end"], F.lit(0))).cast("long").alias("n")))


def _with_counts(rows: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    common = F.array(*[F.lit(w) for w in COMMON_WORDS])
    counted = rows.withColumns({"words": F.array_remove(F.split(text, f"[{SPACE}]+"), ""), "lines": lines})
    counted = counted.withColumn("common", F.sort_array(F.transform(F.filter("words", lambda w: w.isin(COMMON_WORDS)), lambda w: F.array_position(common, w).cast("int") - 1)))
    counted = counted.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "chars": F.length(text).cast("long"),
            "commons": _runs(F.col("common")),
            **{k: F.regexp_count(text, F.lit(v)).cast("long") for k, v in CLASSES.items()},
        }
    )
    space = F.col("chars") - F.col("word_chars")
    marked = [F.col(k) for k in CLASSES]
    rest = F.col("chars") - space - F.col("n_symbols") - sum(marked[1:], marked[0])
    other = F.struct(F.lit(len(COMMON_WORDS)).alias("j"), (F.col("n_words") - F.size("common")).cast("long").alias("n"))
    return counted.withColumns({"classes": F.array(*marked, F.col("n_symbols"), space, rest), "commons": F.concat("commons", F.array(other))})


def _with_repeats(counted: DataFrame) -> DataFrame:
    """n_repeat_words: words in windows of three that stand twice or more."""
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = counted.withColumn("windows", windows)
    # most texts repeat no window, which is found without a sort
    out = out.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array("windows")).otherwise(F.array().cast("array<bigint>")))
    again = F.filter("ordered", lambda x, i: (i > 0) & (x == F.get("ordered", i - 1)) & ((i == 1) | (x != F.get("ordered", i - 2))))
    out = out.withColumn("again", again)
    many = F.size("again") > FEW_WINDOWS
    placed = F.when(many, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    out = out.withColumn("placed", placed)
    looked_up = F.filter(F.transform("windows", lambda x, i: F.when(F.array_contains("again", x), i)), lambda i: i.isNotNull())
    same = lambda x, k: F.coalesce(F.get("placed", k)["x"] == x["x"], F.lit(False))
    by_sort = F.sort_array(F.transform(F.filter("placed", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    at = F.when(F.size("again") == 0, F.array().cast("array<int>")).when(many, by_sort).otherwise(looked_up)
    out = out.withColumn("at", at)
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"],
    )
    return out.withColumn("n_repeat_words", covered.cast("long"))


def js_divergence(total: Column, counts: Column, n: str | None, reference: list[float]) -> Column:
    """Jensen-Shannon divergence, base 2, of a histogram (of total) from a fixed one; counts of n None are in place, else (j, n) of what is not 0."""
    q = F.array(*[F.lit(float(x)) for x in reference])
    halves = lambda p, r: F.when(p > 0, p * F.log2(2 * p / (p + r))).otherwise(0.0) + F.when((p > 0) & (r > 0), r * F.log2(2 * r / (p + r)) - r).otherwise(0.0)
    # places where the text has nothing add their reference's share, and all shares are 1
    term = (lambda x, i: halves(x / total, F.get(q, i))) if n is None else (lambda x, i: halves(x[n] / total, F.get(q, x["j"])))
    part = F.aggregate(F.transform(counts, term), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.greatest(F.lit(0.0), (part + 1.0) / 2))


def chance(places: int, n: Column) -> Column:
    """Divergence that n draws from a reference of so many places have from it on average."""
    return F.lit(places / (8 * math.log(2))) / F.greatest(n, F.lit(1))


def without_common(other: float) -> float:
    """Divergence of a text without a common word from a reference with that share of other words."""
    return (math.log2(2 / (1 + other)) + (other * math.log2(2 * other / (1 + other)) if other > 0 else 0.0) + 1 - other) / 2


Reference = tuple[list[float], list[float]]


def pooled(counted: DataFrame, lang_col: str) -> dict[str, Reference]:
    """Class and word shares of each listed language: of fixed size, whatever the documents are."""
    own = counted.where((F.col("n_words") >= MIN_WORDS) & F.col(lang_col).isin(list(COMMON)))
    classes = len(CLASSES) + 3
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"n{i}") for i in range(classes)]
    out = {r["lang"]: ([r[f"n{i}"] for i in range(classes)], [0] * (len(COMMON_WORDS) + 1)) for r in sorted(own.groupBy(F.col(lang_col).alias("lang")).agg(*sums).collect())}
    for r in own.select(F.col(lang_col).alias("lang"), F.explode("commons").alias("c")).groupBy("lang", "c.j").agg(F.sum("c.n").alias("n")).collect():
        out[r["lang"]][1][r["j"]] = r["n"]
    return {lang: tuple([x / sum(h) for x in h] for h in both) for lang, both in out.items()}


def _near(known: dict[str, Reference]) -> dict[str, Column]:
    """class_distance and word_distance from the nearest references, and near: whether some reference's limits hold for each."""
    if not known:
        none = F.lit(None).cast("double")
        return {"class_distance": none, "word_distance": none, "near": F.lit(True)}
    classes = [js_divergence(F.col("chars"), F.col("classes"), None, c) for c, _ in known.values()]
    words = [js_divergence(F.col("n_words"), F.col("commons"), "n", w) for _, w in known.values()]
    limits = [(chance(len(COMMON[lang]), F.col("n_words")) + F.lit(without_common(w[-1]))) / 2 for lang, (_, w) in known.items()]
    some = F.col("n_words") - F.element_at("commons", -1)["n"]
    enough = [2 * some >= F.lit(1 - w[-1]) * F.col("n_words") for _, w in known.values()]
    far_words = F.least(*[F.when(e, -1.0).otherwise(F.round(d - m, 9)) for d, m, e in zip(words, limits, enough, strict=True)], F.lit(9.0))
    distance = F.round(F.sqrt(F.least(*classes, F.lit(9.0))), 6)
    allowed = MAX_CLASS_DISTANCE + CHANCE * F.sqrt(chance(len(CLASSES) + 3, F.col("chars")))
    empty = F.col("n_words") == 0
    return {
        "class_distance": F.when(F.col("chars") > 0, distance),
        "word_distance": F.when(~empty, F.round(F.sqrt(F.least(*words, F.lit(9.0))), 6)),
        "near": F.coalesce((distance <= allowed) & (far_words <= 0), F.lit(True)),
    }


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep_text: bool = True) -> DataFrame:
    """The rows of docs (without their texts, if so asked) with their counts, class_distance, word_distance, base_failed and kept."""
    held = Held(docs, text=text_col, lang=lang_col)
    if not keep_text:
        at = held.columns.index(held["text"])
        held.columns, held.names = [c for i, c in enumerate(held.columns) if i != at], [n for i, n in enumerate(held.names) if i != at]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "classes", "commons"]
    counted = written(_with_repeats(_with_counts(held.rows, held["text"])).select(*held.columns, *counts), "counts")
    lang = held["lang"]
    known = pooled(counted, lang)
    known |= pooled(counted.withColumns(_near(known)).where("near"), lang)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = counted.withColumns({**_near(known), "base_failed": failed})
    return held.given(out.withColumn("kept", ~F.col("base_failed") & F.col("near")), *RESULTS)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs, keep_text=False).drop("lang")


_K = ", ".join(f"({j}, '{w}')" for j, w in enumerate(COMMON_WORDS))
_LANGS = ", ".join(f"('{x}', {len(words)})" for x, words in COMMON.items())
_COUNTS = {k: "len(regexp_extract_all(t, '" + v.replace("'", "''") + "'))" for k, v in CLASSES.items()}
_LINES = "list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '')"


def _step_sql(k: int, of: str) -> str:
    """References pooled over the rows `of`, and every row's nearness to them."""
    return f"""pooled{k} AS (SELECT kind, hist.lang, j, sum(x) AS y FROM hist JOIN {of} USING (r) JOIN langs ON langs.lang = hist.lang WHERE n_words >= {MIN_WORDS} GROUP BY kind, hist.lang, j),
q{k} AS (SELECT kind, lang, j, y / sum(y) OVER (PARTITION BY kind, lang) AS q FROM pooled{k}),
zero{k} AS (SELECT lang, (log2(2 / (1 + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (1 + q)) ELSE 0 END + 1 - q) / 2 AS z, 1 - q AS share FROM q{k} WHERE kind = 'w' AND j = {len(COMMON_WORDS)}),
js{k} AS (
  SELECT kind, r, q{k}.lang, greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS d
  FROM p JOIN q{k} USING (kind, j) WHERE p IS NOT NULL GROUP BY kind, r, q{k}.lang),
far{k} AS (
  SELECT r, round(sqrt(min(d) FILTER (kind = 'c')), 6) AS cd, round(sqrt(min(d) FILTER (kind = 'w')), 6) AS wd,
         min(CASE WHEN 2 * held >= share * n_words THEN -1 ELSE round(d - (places / (8 * ln(2)) / greatest(n_words, 1) + z) / 2, 9) END) FILTER (kind = 'w') AS over, {MAX_CLASS_DISTANCE} + {CHANCE} * sqrt({(len(CLASSES) + 3)} / (8 * ln(2)) / greatest(any_value(chars), 1)) AS most
  FROM js{k} JOIN zero{k} USING (lang) JOIN langs USING (lang) JOIN (SELECT r, n_words, chars, (SELECT coalesce(sum(x), 0) FROM hits WHERE hits.r = n.r) AS held FROM n) AS n USING (r) GROUP BY r),
near{k} AS (SELECT n.r, cd, wd, coalesce(cd <= most AND over <= 0, true) AS near FROM n LEFT JOIN far{k} USING (r)),
only{k} AS (SELECT r FROM near{k} WHERE near)"""


#: DuckDB SQL of op8_quality_rules.
OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w FROM documents),
n AS (
  SELECT r, doc_id, lang, w, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
         (len({_LINES}) - len(list_distinct({_LINES})))::BIGINT AS n_dup_lines, length(t)::BIGINT AS chars, [{", ".join(_COUNTS.values())}] AS cs FROM d),
langs AS (SELECT * FROM (VALUES {_LANGS}) AS v(lang, places)),
everyone AS (SELECT r FROM n),
cls AS (SELECT 'c' AS kind, r, lang, n_words, unnest(range({len(CLASSES) + 3})) AS j, unnest(cs || [n_symbols, chars - word_chars, word_chars - n_symbols - list_sum(cs)]) AS x FROM n),
k AS (SELECT * FROM (VALUES {_K}) AS v(j, word)),
hits AS (SELECT r, j, count(*) AS x FROM (SELECT r, unnest(w) AS word FROM n) JOIN k USING (word) GROUP BY r, j),
com AS (
  SELECT 'w' AS kind, n.r, lang, n_words, k.j, coalesce(x, 0) AS x FROM n CROSS JOIN k LEFT JOIN hits ON hits.r = n.r AND hits.j = k.j
  UNION ALL SELECT 'w', n.r, lang, n_words, {len(COMMON_WORDS)}, n_words - coalesce((SELECT sum(x) FROM hits WHERE hits.r = n.r), 0) FROM n),
hist AS (SELECT kind, r, lang, n_words, j, x::DOUBLE AS x FROM cls UNION ALL SELECT kind, r, lang, n_words, j, x::DOUBLE FROM com),
p AS (SELECT kind, r, j, x / nullif(sum(x) OVER (PARTITION BY kind, r), 0) AS p FROM hist),
{_step_sql(1, "everyone")},
{_step_sql(2, "only1")},
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM n WHERE len(w) >= 3)),
again AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT pos) AS x FROM (SELECT r, unnest(range(i, i + 3)) AS pos FROM again) GROUP BY r),
j AS (SELECT n.*, coalesce(rep.x, 0)::BIGINT AS n_repeat_words, cd, wd, near FROM n LEFT JOIN rep USING (r) JOIN near2 USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, cd AS class_distance, wd AS word_distance, base_failed, NOT base_failed AND near AS kept FROM b
"""
