"""URL filter: host and path rules, and for the rest trust spread over the link graph. DataFrame operations only.

Hosts are the nodes; a link from a page of one host to another host is an edge, weighted by its pages.
Trust is personalised PageRank along the edges from allowed seeds; distrust is the same along reversed
edges from blocked seeds. A seed's weight is the share of its pages that the rules allow or block, so a
rule for one section does not condemn a host. Scores are unnormalised, score = seed + damping * received
(a wholly blocked host has at least 1), and a host is blocked where its distrust reaches ``threshold`` and
exceeds its trust. Rounds go on until all that is still to be received, by all hosts together, is at most
``tolerance`` of the seeds' sum.

Defined results: a null url or one without :// has empty host and path, no rule and, as a host of its own
without links, the verdict allow; repeated rows stay and count as pages; null html has no links; html of any
length is searched whole; equal trust and distrust allow; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rounds, saved, table

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
DAMPING = 0.85
TOLERANCE = 1e-6
THRESHOLD = 0.5
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule, ruled (the rule's verdict)."""
    url = F.coalesce("url", F.lit(""))
    out = pages.withColumn("host", lower(F.regexp_extract(url, PARTS, 1))).withColumn("path", F.regexp_extract(url, PARTS, 2))
    rule = ruled = F.lit(None).cast("string")
    # later ones override: the longest last
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, ruled = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return out.withColumn("rule", rule).withColumn("ruled", ruled)


def links(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts with the number of times they occur."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), 1)).alias("dst"))
    return found.select("src", lower(F.col("dst")).alias("dst")).where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def most_rounds(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Rounds after which no graph has more than the tolerance left: round k hands on damping^k of the seeds at most."""
    return math.ceil(math.log(tolerance * (1 - damping)) / math.log(damping))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """seeds: side, host, seed, with every host of an edge. edges: side, src, dst, weight. -> side, host, score.

    score = seed + damping * (shares of the scores of all src); each round adds what the last one's additions hand on.
    """
    out = edges.groupBy("side", "src").agg(F.sum("weight").alias("total"))
    shares = saved(edges.join(out, ["side", "src"]).select("side", F.col("src").alias("host"), "dst", (damping * F.col("weight") / F.col("total")).alias("share")), "shares")
    ranks = Rounds(seeds.sparkSession, "rank")
    state = ranks.put(seeds.select("side", "host", F.col("seed").alias("score"), F.col("seed").alias("new")))
    total = state.agg(F.sum("new")).first()[0] or 0.0
    for _ in range(most_rounds(damping, tolerance)):
        got = shares.join(state.where("new > 0").select("side", "host", "new"), ["side", "host"]).groupBy("side", F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("new")).alias("got"))
        new = F.coalesce("got", F.lit(0.0))
        state = ranks.put(state.join(got, ["side", "host"], "left").select("side", "host", (F.col("score") + new).alias("score"), new.alias("new")))
        if (state.agg(F.sum("new")).first()[0] or 0.0) * damping / (1 - damping) <= tolerance * total:
            break
    return state.select("side", "host", "score")


def host_scores(pages: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """pages: host, ruled, html. -> host, trust, distrust; linked hosts without pages included."""
    edges = saved(links(pages), "edges")
    seeds = pages.groupBy("host").agg(*[F.avg((F.coalesce("ruled", F.lit("")) == v).cast("double")).alias(v) for v in ("allow", "block")])
    if edges.isEmpty():
        return seeds.select("host", F.col("allow").alias("trust"), F.col("block").alias("distrust"))
    ends = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    seeds = seeds.join(ends, "host", "full").na.fill(0.0)
    # both sides in one walk: trust along the links, distrust against them
    sides = F.explode(F.array(F.struct(F.lit("trust").alias("side"), F.col("allow").alias("seed")), F.struct(F.lit("distrust").alias("side"), F.col("block").alias("seed"))))
    seeds = saved(seeds.select("host", sides.alias("s")).select("s.side", "host", "s.seed"), "seeds")
    both = edges.withColumn("side", F.lit("trust")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("distrust").alias("side")))
    found = spread(seeds, both, damping, tolerance)
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("score"))).alias(side)
    return found.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust."""
    marked = saved(with_rule(pages.select("page_id", "url", "html"), rules).select("page_id", "host", "path", "rule", "ruled", F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), 1).alias("found")), "marked")
    # the links found stand in for the html, which is read once
    again = marked.select("host", "ruled", F.concat(F.lit("href=//"), F.array_join("found", " href=//")).alias("html"))
    scores = host_scores(again)
    out = marked.join(scores, "host", "left")
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_sql(rules=RULES) -> str:
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    fits = [(f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))", h + p, v) for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    parts = PARTS.replace("'", "''")
    return f"""
WITH RECURSIVE p AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{parts}', 1), {az}) AS host,
                  regexp_extract(coalesce(url, ''), '{parts}', 2) AS path FROM pages),
r AS (SELECT *, {case(1)} AS rule, {case(2)} AS ruled FROM p),
f AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{HREF.replace("'", "''")}', 1)), {az}) AS dst FROM r),
e AS (SELECT src, dst, count(*) AS w FROM f WHERE src <> dst AND src <> '' GROUP BY ALL),
e2 AS (SELECT 'trust' AS side, src, dst, w FROM e UNION ALL SELECT 'distrust', dst, src, w FROM e),
sh AS (SELECT side, src, dst, w / sum(w) OVER (PARTITION BY side, src) AS share FROM e2),
s AS (SELECT host, avg((coalesce(ruled, '') = 'allow')::INT) AS a, avg((coalesce(ruled, '') = 'block')::INT) AS b FROM r GROUP BY host),
fl(k, side, host, v) AS (
  SELECT 0, side, host, v FROM (SELECT 'trust' AS side, host, a AS v FROM s UNION ALL SELECT 'distrust', host, b FROM s) WHERE v > 0
  UNION ALL
  SELECT fl.k + 1, sh.side, sh.dst, sum({DAMPING} * sh.share * fl.v) FROM fl JOIN sh ON sh.side = fl.side AND sh.src = fl.host
  WHERE fl.k < {most_rounds()} GROUP BY fl.k, sh.side, sh.dst),
t AS (SELECT host, coalesce(sum(v) FILTER (side = 'trust'), 0) AS a, coalesce(sum(v) FILTER (side = 'distrust'), 0) AS b FROM fl GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN b >= {THRESHOLD} AND b > a THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN t USING (host)"""
