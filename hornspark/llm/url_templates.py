"""Operator 9: URL filters by a path-template tree. DataFrame operations only.

Base rules come first: a rule fits its host and all subdomains where the url's path starts with the
rule's path; the longest rule wins. The method judges the rest:

1. Digits in a path become ``#``. The distinct (host, shape) pairs, with their pages and labels,
   are the leaves of a tree per host, with a level for each segment. Everything after
   this step works on these few rows, so a host with a third of all pages costs no more than others.
2. From the root down, where a node has more than BRANCHES different next segments, the segment is variable: those
   with less than 1 / BRANCHES of the node's pages become ``*`` and go on as one branch; frequent
   literals stay. A leaf that is alone below its node keeps the rest of its path as it is, so that
   rounds end with the last branching and not with the longest path.
3. Branches that are statistically similar merge: a child whose share of bad labels does not differ
   from its siblings' together (two-proportion z-test at 1.96) is part of its parent, from the
   leaves up as far as that holds; the node where it ends stands alone. Without labels on either side nothing
   is known to be similar, and nothing merges.
4. The merged node that a leaf ends in has the smoothed share of bad labels (bad + PRIOR * p) / (labelled +
   PRIOR), p being the share over all pages. Above LIMIT, the template is rejected; without any label it is not.

The label of a page is that of the document whose number its path names: bad where quality is 0 or
toxic is 1 (any of its label rows).

Cases: a null url or one without ``://`` has empty host and path, no rule, and the verdict of its
leaf. Unlabelled trees are allowed, as are empty label tables. Repeated rows give equal rows; null
ids stay; extra columns are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornspark.llm.common import Scratch

#: Verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
BRANCHES = 8
PRIOR = 10
LIMIT = 0.5
#: The square of the z value.
Z2 = 3.8416


def host_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The rule that decides, as text, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(RULES, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def generalised(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """Leaves (host, shape, pages, labelled, bad) with ``ups``: the prefixes of their template from the root down, the last being the template."""
    at = ["host", "prefix"]
    now = scratch.keep(leaves.withColumn("prefix", F.lit("")).withColumn("ups", F.array(F.lit(""))).withColumn("rest", F.col("shape")))
    done = []
    while True:
        done.append(now.filter("rest = ''"))
        now = now.filter("rest <> ''").withColumn("seg", F.regexp_extract("rest", "^/[^/]*", 0))
        if not now.limit(1).count():
            break
        children = now.groupBy(*at, "seg").agg(F.sum("pages").alias("own"), F.count(F.lit(1)).alias("leaves"))
        nodes = children.groupBy(*at).agg(F.count(F.lit(1)).alias("kinds"), F.sum("own").alias("all"), F.sum("leaves").alias("leaves"))
        steps = children.drop("leaves").join(nodes, at)
        rare = (F.col("kinds") > BRANCHES) & (F.col("own") * BRANCHES < F.col("all"))
        alone = F.col("leaves") == 1
        stepped = now.join(steps, [*at, "seg"])
        after = F.concat("prefix", F.when(alone, F.col("rest")).when(rare, F.lit("/*")).otherwise(F.col("seg")))
        rest = F.when(alone, F.lit("")).otherwise(F.expr("substring(rest, length(seg) + 1)"))
        now = scratch.keep(stepped.select("host", "shape", "pages", "labelled", "bad", after.alias("prefix"), F.array_append("ups", after).alias("ups"), rest.alias("rest")))
    return reduce(DataFrame.unionByName, done).select("host", "shape", "labelled", "bad", F.col("prefix").alias("template"), "ups")


def templates(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, shape, template, rate) of leaves (host, shape, pages, labelled, bad)."""
    shapes = scratch.keep(generalised(leaves, scratch))
    sums = [F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]
    ends = scratch.keep(shapes.groupBy("host", "template", "ups").agg(*sums))
    paths = ends.select("host", "template", "labelled", "bad", "ups", F.posexplode("ups").alias("level", "node"))
    paths = paths.withColumn("parent", F.when(F.col("level") > 0, F.expr("element_at(ups, greatest(level, 1))"))).drop("ups")
    nodes = scratch.keep(paths.groupBy("host", "level", "node", "parent").agg(*sums))
    above = nodes.select("host", (F.col("level") + 1).alias("level"), F.col("node").alias("parent"), F.col("labelled").alias("tn"), F.col("bad").alias("tb"))
    n1, b1 = F.col("labelled").cast("double"), F.col("bad").cast("double")
    n2, b2 = (F.col("tn") - F.col("labelled")).cast("double"), (F.col("tb") - F.col("bad")).cast("double")
    p = F.try_divide(b1 + b2, n1 + n2)
    gap = b1 * n2 - b2 * n1  # (p1 - p2)^2 < z^2 p (1 - p) (1/n1 + 1/n2), times (n1 n2)^2
    alike = (n1 > 0) & (n2 > 0) & (gap * gap <= Z2 * p * (1 - p) * (n1 + n2) * n1 * n2)
    apart = nodes.join(above, ["host", "level", "parent"], "left").filter(~F.coalesce(alike, F.lit(False))).select("host", "level", "node")  # roots are apart
    units = paths.join(apart, ["host", "level", "node"]).groupBy("host", "template").agg(F.max(F.struct("level", "node")).alias("u"), F.max("labelled").alias("labelled"), F.max("bad").alias("bad"))
    units = scratch.keep(units.select("host", "template", F.col("u.node").alias("unit"), "labelled", "bad"))
    every = leaves.agg(F.sum("labelled").alias("an"), F.sum("bad").alias("ab"))
    share = F.coalesce(F.try_divide("ab", "an"), F.lit(0.0))
    rated = units.groupBy("host", "unit").agg(*sums).crossJoin(F.broadcast(every))  # one row
    rated = rated.select("host", "unit", F.when(F.col("labelled") > 0, (F.col("bad") + PRIOR * share) / (F.col("labelled") + PRIOR)).alias("rate"))
    return shapes.select("host", "shape", "template").join(units.join(rated, ["host", "unit"]).select("host", "template", "rate"), ["host", "template"])


def url_verdicts(spark: SparkSession, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every page."""
    scratch = Scratch(spark, "urls")
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    p = p.withColumn("shape", F.regexp_replace("path", "[0-9]+", "#"))
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    named = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(bad).alias("is_bad"))
    numbered = p.withColumn("doc", F.regexp_extract("path", "[0-9]+", 0).try_cast("long"))
    counted = numbered.groupBy("host", "shape", "doc").agg(F.count(F.lit(1)).alias("pages"))  # so that shapes without a number are one row each
    marked = counted.join(scratch.keep(named), "doc", "left")
    sums = {"pages": F.col("pages"), "labelled": F.when(F.col("is_bad").isNotNull(), F.col("pages")), "bad": F.col("is_bad") * F.col("pages")}
    leaves = scratch.keep(marked.groupBy("host", "shape").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items())))
    rates = scratch.keep(templates(leaves, scratch))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    judged = p.join(rates, ["host", "shape"], "left").withColumn("rule", rule)
    own = F.when(F.col("rate") > LIMIT, "block").otherwise("allow")
    return scratch.finish(judged.select("page_id", "host", "path", "rule", F.coalesce(verdict, own).alias("verdict"), "template"))


def _sql() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, kind) for kind, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{name}'" for f, name, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{kind}'" for f, _, kind in fits) + f" WHEN rate > {LIMIT} THEN 'block' ELSE 'allow' END"
    n, b, m, c = "CAST(n AS DOUBLE)", "CAST(b AS DOUBLE)", "CAST(tn - n AS DOUBLE)", "CAST(tb - b AS DOUBLE)"
    p = f"(({b} + {c}) / ({n} + {m}))"
    alike = f"(level > 0 AND n > 0 AND tn > n AND ({b} * {m} - {c} * {n}) * ({b} * {m} - {c} * {n}) <= {Z2} * {p} * (1 - {p}) * ({n} + {m}) * {n} * {m})"
    return f"""
WITH RECURSIVE r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
p AS (SELECT *, regexp_replace(path, '[0-9]+', '#', 'g') AS shape, TRY_CAST(regexp_extract(path, '[0-9]+', 0) AS BIGINT) AS doc FROM h),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS is_bad FROM labels GROUP BY 1),
v AS (SELECT host, shape, count(*) AS pages, count(is_bad) AS n, coalesce(sum(is_bad), 0) AS b FROM p LEFT JOIN l ON p.doc = l.doc_id GROUP BY 1, 2),
g AS (
  SELECT host, shape, pages, n, b, '' AS prefix, [''] AS ups, shape AS rest FROM v
  UNION ALL
  SELECT host, shape, pages, n, b, prefix || step, list_append(ups, prefix || step), CASE WHEN leaves = 1 THEN '' ELSE substr(rest, length(seg) + 1) END
  FROM (
    SELECT *, CASE WHEN leaves = 1 THEN rest WHEN kinds > {BRANCHES} AND own * {BRANCHES} < total THEN '/*' ELSE seg END AS step
    FROM (
      SELECT *, count(*) OVER (PARTITION BY host, prefix) AS leaves, sum(pages) OVER (PARTITION BY host, prefix) AS total,
        sum(pages) OVER (PARTITION BY host, prefix, seg) AS own, count(DISTINCT seg) OVER (PARTITION BY host, prefix) AS kinds
      FROM (SELECT *, regexp_extract(rest, '^/[^/]*', 0) AS seg FROM g WHERE rest <> '')))),
s AS (SELECT host, shape, prefix AS template, ups, n, b FROM g WHERE rest = ''),
t AS (SELECT host, template, ups, sum(n) AS n, sum(b) AS b FROM s GROUP BY ALL),
x AS (SELECT host, template, n, b, ups, unnest(range(len(ups))) AS level FROM t),
w AS (SELECT host, template, n, b, level, ups[level + 1] AS node, CASE WHEN level > 0 THEN ups[level] END AS parent FROM x),
nodes AS (SELECT host, level, node, parent, sum(n) AS n, sum(b) AS b FROM w GROUP BY ALL),
pairs AS (SELECT c.*, q.n AS tn, q.b AS tb FROM nodes c LEFT JOIN nodes q ON q.host = c.host AND q.level = c.level - 1 AND q.node = c.parent),
apart AS (SELECT host, level, node FROM pairs WHERE NOT {alike}),
u AS (SELECT w.host, w.template, any_value(w.n) AS n, any_value(w.b) AS b, arg_max(w.node, w.level) AS unit FROM w JOIN apart USING (host, level, node) GROUP BY 1, 2),
f AS (SELECT host, unit, CASE WHEN sum(n) > 0 THEN (sum(b) + {PRIOR} * coalesce((SELECT sum(b) / nullif(sum(n), 0) FROM v), 0)) / (sum(n) + {PRIOR}) END AS rate FROM u GROUP BY ALL),
z AS (SELECT s.host, s.shape, s.template, f.rate FROM s JOIN u USING (host, template) JOIN f ON f.host = u.host AND f.unit = u.unit)
SELECT page_id, p.host, path, {rule.replace('host', 'p.host')} AS rule, {verdict.replace('host', 'p.host')} AS verdict, template
FROM p LEFT JOIN z ON p.host = z.host AND p.shape = z.shape
"""


SQL = _sql()
