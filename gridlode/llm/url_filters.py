"""URL filters by a tree of path templates.

Rules decide first: the longest rule whose host is the url's host or a parent domain of it
and whose path starts the url's path. What rules decide labels the tree, which then judges
the urls that no rule fits.

Per host, segments of a path are generalised: runs of digits, hexadecimal numbers and slugs
become wildcards, and what is equal then is counted as one shape. From the root down, a
branch keeps its segment if it differs from its siblings, by a test of two smoothed
proportions that holds for small counts too, in the share of labelled urls or in the share of
blocked ones; all others merge into a wildcard branch, and those without any label into one of
their own, so none inherits its siblings' labels. One more tree grows over the paths of all hosts
together. A template's purity is the share of blocked among its labelled urls, smoothed by PRIOR_URLS urls:
for the tree of all hosts these are blocked by PRIOR_SHARE, for a host's own tree by the purity that the path's
template has over all hosts, so that a path known from other hosts is judged where a host has few labels or none. Templates
of a purity of one half at least are rejected. The trees work on counts of shapes; a host's urls are never
brought together. Each level is one job.

Defined cases: a null url or one without "://" has an empty host and path, fits no rule, and
is judged with all others of its kind; without any label every template is allowed; a purity of
exactly one half rejects; rows that repeat count each; a very long path has its first LEVELS - 1
segments and all the rest as one more; further columns pass through whatever their names, and
those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlode.llm.columns import Held
from gridlode.llm.skew import join_hot
from gridlode.llm.storage import written

#: Fixed values: (verdict, rule); a rule is a host and the start of a path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Path segments that make levels of their own; what follows is the last level. No more levels are grown than the paths have.
LEVELS = 16
#: A branch keeps its segment where it differs by so many standard errors.
ERRORS = 3.0
#: Wildcards of merged branches: those with labels or among no labels at all, and those without among labelled ones.
MERGED, UNLABELLED = "*", "<unlabelled>"
#: Labelled urls that a template is taken to have beforehand, and the blocked share among them.
PRIOR_URLS, PRIOR_SHARE = 4.0, 0.25
#: As many verdicts of templates are broadcast; more are joined by a shuffle.
MAX_BROADCAST_SHAPES = 200_000
RESULTS = ["host", "path", "rule", "verdict"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct of rule and verdict, null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """Segments of a path with its variable parts as wildcards; those beyond LEVELS - 1 are one."""
    general = path
    for pattern, wildcard in ((r"(?<=/)[^/]*[^/-]-[^/-]+-[^/]*", "<slug>"), (r"(?<=/)(?=[^/]*\d)[0-9a-fA-F-]{8,}(?=[/.]|$)", "<hex>"), (r"\d+", "<n>")):
        general = F.regexp_replace(general, pattern, wildcard)
    return F.split(F.regexp_replace(general, "^/", ""), "/", LEVELS)


def _share_differs(hits: str, of: str, parent: str) -> Column:
    """Whether hits/of of a branch is far from that of its siblings; parent is the prefix of the siblings' sums with its own."""
    own, own_hits = F.col(of).cast("double"), F.col(hits).cast("double")
    rest, rest_hits = F.col(f"{parent}{of}") - own, F.col(f"{parent}{hits}") - own_hits
    share, rest_share = (own_hits + 1) / (own + 2), (rest_hits + 1) / (rest + 2)
    spread = share * (1 - share) / (own + 2) + rest_share * (1 - rest_share) / (rest + 2)
    gap = share - rest_share
    return F.coalesce((rest > 0) & (gap * gap > ERRORS**2 * spread), F.lit(False))


def templates(shapes: DataFrame) -> DataFrame:
    """Template of every row (pooled, host, segments, n, labelled, blocked): the segments it keeps, wildcards for the others.

    Branches are counts, added up before any shuffle; a hot host's branches are left to Spark's handling of skewed joins.
    """
    out = shapes.withColumn("template", F.array().cast("array<string>"))
    at = ["pooled", "host", "template"]
    for level in range(shapes.agg(F.max(F.size("segments"))).first()[0] or 0):
        out = out.withColumn("segment", F.get("segments", F.lit(level)))
        branch = out.groupBy(*at, "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
        total = out.groupBy(*at).agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")])
        judged = branch.join(total, at)
        own = _share_differs("labelled", "n", "all_") | _share_differs("blocked", "labelled", "all_")
        bare = (F.col("labelled") == 0) & (F.col("all_labelled") > 0)
        keep = judged.select(*at, "segment", F.when(own, F.col("segment")).when(bare, UNLABELLED).alias("step")).where("step IS NOT NULL AND segment IS NOT NULL")
        joined = out.join(keep, [*at, "segment"], "left")
        step = F.when(F.col("segment").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.coalesce("step", F.lit(MERGED))))
        out = written(joined.select("pooled", "host", "segments", "n", "labelled", "blocked", F.concat("template", step).alias("template")), "templates")
    return out.select("pooled", "host", "segments", "template", "n", "labelled", "blocked")


def verdicts(grown: DataFrame) -> DataFrame:
    """host, segments, template and rejected of every shape: whether its template is blocked with a smoothed purity of one half at least."""
    at = ["pooled", "host", "template"]
    sums = grown.groupBy(*at).agg(F.sum("labelled").alias("own_labelled"), F.sum("blocked").alias("own_blocked"))
    counted = grown.select(*at, "segments").join(sums, at)
    purity = lambda prior: (F.col("own_blocked") + PRIOR_URLS * prior) / (F.col("own_labelled") + PRIOR_URLS)
    everywhere = counted.where("pooled").select("segments", purity(PRIOR_SHARE).alias("everywhere"))
    own = counted.where("NOT pooled").join(everywhere, "segments")
    return own.select("host", "segments", "template", (purity(F.col("everywhere")) >= 0.5).alias("rejected"))


def judge(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """The rows of pages with host, path, rule, verdict and template."""
    held = Held(pages, url=url_col)
    host, path = host_and_path(F.col(held["url"]))
    rows = held.rows.select("*", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("ruled", longest_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)).withColumn("segments", shape(F.col("path")))
    labelled, blocked = F.col("ruled").isNotNull(), F.coalesce(F.col("ruled.verdict") == "block", F.lit(False))
    counted = rows.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.sum(labelled.cast("long")).alias("labelled"), F.sum(blocked.cast("long")).alias("blocked"))
    own = written(counted.withColumn("pooled", F.lit(False)), "shapes")
    pooled = own.groupBy("segments").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]).withColumns({"pooled": F.lit(True), "host": F.lit("")})
    by_shape = written(verdicts(templates(written(own.unionByName(pooled), "shapes"))), "verdicts")
    # beyond the bound, the rows of hot shapes are dealt over tasks
    few = by_shape.count() <= MAX_BROADCAST_SHAPES
    joined = rows.join(F.broadcast(by_shape), ["host", "segments"], "left") if few else join_hot(rows, by_shape, ["host", "segments"], F.col(held["url"]), "left")
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("rejected"), "block").otherwise("allow"))
    template = F.concat(F.lit("/"), F.array_join("template", "/"))
    out = joined.select(*held.columns, "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), template.alias("template"))
    return held.given(out, *RESULTS, "template")


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", *RESULTS, "template")


def _level_sql(k: int) -> str:
    """One level of the trees: o<k> with the template one step longer."""
    differs = lambda hits, of: f"(all_{of} - {of} > 0 AND pow(({hits} + 1) / ({of} + 2.0::DOUBLE) - (all_{hits} - {hits} + 1) / (all_{of} - {of} + 2.0::DOUBLE), 2) > 9 * (({hits} + 1) / ({of} + 2.0::DOUBLE) * (1 - ({hits} + 1) / ({of} + 2.0::DOUBLE)) / ({of} + 2.0::DOUBLE) + (all_{hits} - {hits} + 1) / (all_{of} - {of} + 2.0::DOUBLE) * (1 - (all_{hits} - {hits} + 1) / (all_{of} - {of} + 2.0::DOUBLE)) / (all_{of} - {of} + 2.0::DOUBLE)))"
    return f"""b{k} AS MATERIALIZED (SELECT pooled, host, template, s[{k + 1}] AS seg, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM o{k} GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT pooled, host, template, sum(n) AS all_n, sum(labelled) AS all_labelled, sum(blocked) AS all_blocked FROM b{k} GROUP BY ALL),
k{k} AS MATERIALIZED (SELECT pooled, host, template, seg, CASE WHEN {differs('labelled', 'n')} OR {differs('blocked', 'labelled')} THEN seg WHEN labelled = 0 AND all_labelled > 0 THEN '{UNLABELLED}' ELSE '{MERGED}' END AS step FROM b{k} JOIN a{k} USING (pooled, host, template) WHERE seg IS NOT NULL),
o{k + 1} AS MATERIALIZED (SELECT o.pooled, o.host, o.s, o.n, o.labelled, o.blocked, CASE WHEN step IS NULL THEN o.template ELSE list_append(o.template, step) END AS template
  FROM o{k} o LEFT JOIN k{k} k ON k.pooled = o.pooled AND k.host = o.host AND k.template = o.template AND k.seg = o.s[{k + 1}])"""


#: DuckDB SQL of op10_url_filters.
OP10_SQL = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(verdict, rule, dom, rest) AS (VALUES {', '.join(f"('{v}', '{x}', '{x.partition('/')[0]}', '/{x.partition('/')[2]}')" for v, x in RULES)}),
m AS (SELECT u.*, (SELECT arg_max(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM r WHERE (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, rest)) AS ruled FROM u),
g AS (SELECT *, [regexp_replace(CASE WHEN regexp_matches(x, '(?s)^.*[^-]-[^-]+-.*$') THEN '<slug>' WHEN regexp_matches(x, '\d') AND regexp_matches(x, '^[0-9a-fA-F-]{{8,}}(\.|$)') THEN regexp_replace(x, '^[0-9a-fA-F-]{{8,}}', '<hex>') ELSE x END, '\d+', '<n>', 'g') FOR x IN string_split(CASE WHEN starts_with(path, '/') THEN substr(path, 2) ELSE path END, '/')] AS w FROM m),
q AS (SELECT *, CASE WHEN len(w) <= {LEVELS} THEN w ELSE list_append(w[1:{LEVELS - 1}], array_to_string(w[{LEVELS}:], '/')) END AS s FROM g),
c AS (SELECT false AS pooled, host, s, count(*) AS n, count(*) FILTER (ruled IS NOT NULL) AS labelled, count(*) FILTER (ruled.verdict = 'block') AS blocked FROM q GROUP BY ALL),
o0 AS MATERIALIZED (SELECT *, []::VARCHAR[] AS template FROM c UNION ALL SELECT true, '', s, sum(n), sum(labelled), sum(blocked), []::VARCHAR[] FROM c GROUP BY s),
{', '.join(map(_level_sql, range(LEVELS)))},
t AS (SELECT pooled, host, template, sum(labelled) AS l, sum(blocked) AS b FROM o{LEVELS} GROUP BY ALL),
e AS (SELECT s, (b + {PRIOR_URLS * PRIOR_SHARE}::DOUBLE) / (l + {PRIOR_URLS}::DOUBLE) AS p FROM o{LEVELS} JOIN t USING (pooled, host, template) WHERE pooled),
v AS (SELECT o.host, o.s, o.template, (b + {PRIOR_URLS}::DOUBLE * p) / (l + {PRIOR_URLS}::DOUBLE) >= 0.5 AS rejected FROM o{LEVELS} o JOIN t USING (pooled, host, template) JOIN e ON e.s = o.s WHERE NOT pooled)
SELECT page_id, q.host, path, ruled.rule AS rule, coalesce(ruled.verdict, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(template, '/') AS template
FROM q JOIN v ON v.host = q.host AND v.s = q.s
"""
