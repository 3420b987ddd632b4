"""Licence scans with a positional index of rare licence words.

The corpus says how rare each licence word is. Of every template its rarest words are indexed
with their places; a file's occurrences of indexed words, less those places, are the possible
starts of the template, and only starts on which all of its rare words agree are kept. There
the key phrase must stand word for word, and enough of the template's other words.

A row is judged within its task by column expressions alone; only the document frequency of
each licence word, a table of fixed size, is gathered.

Defined cases: a null or empty text has no words, no places, empty labels and score 0; an
empty table gives an empty result; rows that repeat are judged alike; of equally rare words the
first in order is indexed; a very long text is scanned whole; further columns pass through whatever
their names, and those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlode.llm.columns import Held

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Wording of licence notices, the key phrase that must stand in it, and the label.
TEMPLATES = [
    *((phrase, phrase, label) for phrase, label in PHRASES),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "permission is hereby granted free of charge", "mit",
    ),
    ("licensed under the apache license version 2 0", "apache license version 2", "apache-2"),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "see the license for the specific language governing permissions", "apache-2",
    ),
    ("is licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl-3"),
    ("is licensed under the gnu general public license version 2", "gnu general public license version 2", "gpl-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 2", "gpl-2"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "see the gnu general public license for more details", "gpl"),
    ("under the terms of the gnu lesser general public license", "gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "gnu affero general public license", "agpl"),
    ("is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2", "mpl-2"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms with or without modification", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software", "bsd-3"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted", "isc"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "including commercial applications and to alter it and redistribute it freely", "zlib"),
    ("this is free and unencumbered software released into the public domain", "free and unencumbered software", "unlicense"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying documentation covered by this license", "bsl-1"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2", "epl-2"),
    ("this font software is licensed under the sil open font license version 1 1", "sil open font license", "ofl-1"),
    ("under the terms of the artistic license 2 0", "artistic license 2", "artistic-2"),
    ("licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives", "cc-by-nd"),
    ("this work is dedicated to the public domain under cc0 1 0 universal", "public domain", "cc0"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights", "cc0"),
]
#: Rare words of a template that must agree, and the share of its words that must stand in place.
RARE_WORDS, LEAST_SHARE = 3, 0.8
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(1))


def document_frequency(worded: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of rows that hold each word of the vocabulary, which bounds what is gathered."""
    held = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    counts = worded.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in counts}


def rare_places(template: list[str], frequency: dict[str, int]) -> list[tuple[str, int]]:
    """The template's rarest words with their first places."""
    ranked = sorted(set(template), key=lambda w: (frequency[w], w))
    return [(w, template.index(w)) for w in ranked[:RARE_WORDS]]


def _literal(phrase: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in phrase])


def _holds(phrase: list[str], offset: int):
    """Whether the phrase stands word for word so far behind a start."""
    return lambda start: F.slice("words", start + F.lit(offset + 1), F.lit(len(phrase))) == _literal(phrase)


def _share(template: list[str]):
    """Share of the template's words that stand in place behind a start."""
    here = lambda start: F.slice("words", start + 1, F.lit(len(template)))
    return lambda start: F.size(F.filter(F.zip_with(here(start), _literal(template), lambda a, b: a.eqNullSafe(b)), lambda x: x)) / F.lit(float(len(template)))


def _minus(offset: int):
    return lambda h: h["i"] - offset


def _is(word: str):
    return lambda h: h["w"] == word


def _offset(template: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(template)) if template[i : i + len(phrase)] == phrase)


def _starts(rare: list[tuple[str, int]]) -> Column:
    """Starts on which the template's rare words agree, in order and each once."""
    found = None
    for word, offset in rare:
        at = F.transform(F.filter("hits", _is(word)), _minus(offset))
        at = F.filter(at, lambda s: s >= 0)
        found = at if found is None else F.array_intersect(found, at)
    return found


def scan(docs: DataFrame, text_col: str = "text", templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """The rows of docs with their counts, first_word, last_word, base_labels, labels and score."""
    split = [(t.split(), k.split(), label) for t, k, label in (TEMPLATES if templates is None else templates)]
    held = Held(docs, text=text_col)
    worded = held.rows.withColumn("words", words_of(F.col(held["text"])))
    frequency = document_frequency(worded.select("words"), sorted({w for t, _, _ in split for w in t} | {w for p, _ in PHRASES for w in p.split()}))
    index = [rare_places(t, frequency) for t, _, _ in split]
    base_index = [rare_places(p.split(), frequency) for p, _ in PHRASES]
    indexed = sorted({w for rare in (*index, *base_index) for w, _ in rare})
    placed = F.transform("words", lambda w, i: F.when(w.isin(indexed), F.struct(w.alias("w"), i.alias("i"))))
    out = worded.withColumn("hits", F.filter(placed, lambda h: h.isNotNull()))
    places = {f"place{k}": F.filter(_starts(base_index[k]), _holds(phrase.split(), 0)) for k, (phrase, _) in enumerate(PHRASES)}
    shares = {}
    for k, (template, key, _) in enumerate(split):
        verified = F.filter(_starts(index[k]), _holds(key, _offset(template, key)))
        shares[f"share{k}"] = F.array_max(F.transform(verified, _share(template)))
    out = out.withColumns(places | shares)
    every = F.concat(*places)
    sorted_labels = lambda found: F.array_join(F.sort_array(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))), ",")
    base = [F.when(F.size(f"place{k}") > 0, label) for k, (_, label) in enumerate(PHRASES)]
    good = {k: F.coalesce(F.col(f"share{k}") >= LEAST_SHARE, F.lit(False)) for k in range(len(split))}
    score = F.greatest(*[F.when(good[k], F.col(f"share{k}")).otherwise(0.0) for k in good], F.lit(0.0))
    out = out.select(
        *held.columns,
        F.size("words").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        sorted_labels(base).alias("base_labels"),
        sorted_labels([*base, *(F.when(good[k], split[k][2]) for k in good)]).alias("labels"),
        score.alias("score"),
    )
    return held.given(out, *RESULTS)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", *RESULTS)


_ROWS = ", ".join(f"({k}, '{label}', '{t}', '{key}')" for k, (t, key, label) in enumerate(TEMPLATES))
_BASE = ", ".join(f"('{label}', '{phrase}')" for phrase, label in PHRASES)

#: DuckDB SQL of op2_license_scan.
OP2_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
t AS (SELECT k, label, string_split(t, ' ') AS t, string_split(p, ' ') AS p FROM (VALUES {_ROWS}) AS v(k, label, t, p)),
tw AS (SELECT k, unnest(t) AS word, unnest(range(len(t))) AS o FROM t),
f AS (SELECT word, count(DISTINCT r) AS df FROM w WHERE word IN (SELECT word FROM tw) GROUP BY word),
u AS (SELECT k, word, min(o) AS o, coalesce(any_value(df), 0) AS df FROM tw LEFT JOIN f USING (word) GROUP BY k, word),
rare AS (SELECT k, word, o FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY df, word) <= {RARE_WORDS}),
starts AS (
  SELECT r, k, i - o AS s FROM w JOIN rare USING (word) WHERE i >= o GROUP BY r, k, i - o
  HAVING count(*) = (SELECT count(*) FROM rare AS x WHERE x.k = rare.k)),
seen AS (
  SELECT r, k, s, sum((w[s + o + 1] = tw.word)::INT) / any_value(len(t))::DOUBLE AS share,
         bool_or(list_slice(w, s + 1, s + len(t)) = t) AS whole
  FROM starts JOIN t USING (k) JOIN tw USING (k) JOIN d USING (r) GROUP BY r, k, s),
keyed AS (
  SELECT r, k, label, s, share FROM seen JOIN t USING (k) JOIN d USING (r)
  WHERE share >= {LEAST_SHARE} AND len(list_filter(range(len(t) - len(p) + 1), lambda x: list_slice(t, x + 1, x + len(p)) = p AND list_slice(w, s + x + 1, s + x + len(p)) = p)) > 0),
b AS (
  SELECT r, label, i FROM w JOIN d USING (r), (SELECT label, string_split(p, ' ') AS p FROM (VALUES {_BASE}) AS v(label, p)) AS v
  WHERE w.word = v.p[1] AND list_slice(d.w, i + 1, i + len(v.p)) = v.p),
bg AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM b GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (SELECT r, label FROM b UNION SELECT r, label FROM keyed) GROUP BY r),
sc AS (SELECT r, max(share) AS score FROM keyed GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(bg.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(bg.ls, '') AS base_labels, coalesce(l.ls, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN bg USING (r) LEFT JOIN l USING (r) LEFT JOIN sc USING (r)
"""
