"""URL filters: rules first, then trust and distrust over the graph of hosts.

A host edge is a link in a page's HTML to another host; edges are summed per pair of hosts
before anything is joined, so a host with a third of all pages is one row. Trust starts at
hosts whose pages are mostly allowed by rules and follows edges by personalised PageRank;
distrust starts at hosts that are mostly blocked and goes against them, as a page that
links to bad hosts is suspect. What reaches a host without further edges goes back to the
walk's seeds; that only scales a walk, so ranks are divided by the walk's sum at its end. A
host whose distrust is at least ``BLOCK_SHARE`` of both (to three digits) is blocked; a
host that neither walk reaches is allowed.

Verdicts are joined to pages by host; pages of a host with over 1 / ``HOT`` of all pages
are dealt over ``SALTS`` parts, and there are fewer than ``HOT`` such hosts to broadcast.

Defined cases: a null url or one without ``://`` has an empty host and path, which no rule
and no edge concerns (allow); null HTML has no links; links to the page's own host and
repeated pages change nothing but weights; repeated pages are judged each; columns named
like a result are replaced, all others kept; no pages give no verdicts.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, durable, packed, unpacked, whole_text

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING = 0.85
STRIDE = 5
#: Largest change of a host's rank within a stride, as part of that rank, at which walks end.
TOLERANCE = 1e-4
BLOCK_SHARE = 0.5
HOT, SALTS = 1000, 64
RESULTS = ["host", "path", "rule", "verdict", "trust", "distrust"]

LINK = r"""(?i)\b(?:href|src)[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?[\x20\x09-\x0D]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\x20\x09-\x0D<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"^(?s:.*?)://((?s:.*))$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct of rule and verdict; null if none does."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        here = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        fits = F.when(here, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, weight)`` of different hosts, from the links of ``pages(host, html)``."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(whole_text("html"), F.lit(LINK), 1)).alias("dst"))
    return links.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def walk(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """Personalised PageRank ``(kind, host, rank)`` of several walks at once.

    ``edges(kind, src, dst, weight)`` and ``seeds(kind, host, seed)`` name the walk they
    belong to; a walk's seeds sum to 1, and so do its ranks. Walks end when no host is new
    and each host's rank has settled relative to itself, whatever the size of the graph, or
    after ``rounds``. Mass that leaves at hosts without edges is not sent back to the seeds
    round by round: that would multiply all ranks of a walk by one number, which dividing
    by their sum does as well.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    steps = durable(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("all")).alias("p")))
    home = durable(seeds).select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("part"))
    rank = before = home.select("kind", "host", (F.col("part") / (1 - DAMPING)).alias("rank"))
    for i in itertools.count(1):
        moved = steps.join(rank, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("p") * DAMPING).alias("part"))
        rank = moved.unionByName(home).groupBy("kind", "host").agg(F.sum("part").alias("rank"))
        settled = False
        if i % STRIDE == 0:
            rank = durable(rank)
            # Seeds and all that they reach keep a rank, so a host is never lost, only new.
            both = rank.withColumnRenamed("rank", "now").join(before, ["kind", "host"], "left")
            settled = both.where(F.col("rank").isNull() | (F.abs(F.col("now") - F.col("rank")) > TOLERANCE * F.col("now"))).isEmpty()
            before = rank
        if settled or i == rounds:
            total = rank.groupBy("kind").agg(F.sum("rank").alias("total"))  # a row a walk
            return rank.join(F.broadcast(total), "kind").select("kind", "host", (F.col("rank") / F.col("total")).alias("rank"))


def host_verdicts(ruled: DataFrame) -> DataFrame:
    """``(host, verdict, trust, distrust)`` of all hosts that a walk reaches, from ``ruled(host, html, fit)``."""
    edges = host_edges(ruled)
    votes = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("fit.verdict") == "allow").alias("good"), F.count_if(F.col("fit.verdict") == "block").alias("bad"))
    sided = durable(votes.select("host", F.when(F.col("good") > F.col("bad"), "trust").when(F.col("bad") > F.col("good"), "distrust").alias("kind")).where("kind IS NOT NULL"))
    counts = sided.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))  # two rows
    seeds = sided.join(F.broadcast(counts), "kind").select("kind", "host", (1.0 / F.col("n")).alias("seed"))
    edges = durable(edges)
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionAll(edges.select(F.lit("distrust"), "dst", "src", "weight"))
    of = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")}
    hosts = walk(both, seeds).groupBy("host").agg(of["trust"], of["distrust"])
    share = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 3)
    return hosts.withColumn("verdict", F.when(share >= BLOCK_SHARE, "block").otherwise("allow"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """The pages with host, path, rule, verdict, trust and distrust."""
    host, path = host_and_path(F.col("row.url"))
    known = packed(pages).select("row", host.alias("host"), path.alias("path"))
    ruled = known.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    hosts = durable(host_verdicts(ruled.select("host", F.col("row.html").alias("html"), "fit")))

    # Pages of hot hosts, and those without a host, are dealt out over salts.
    per_host = known.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    hot = durable(per_host.crossJoin(F.broadcast(per_host.agg(F.sum("n").alias("total")))).where(F.col("n") * HOT > F.col("total")).select(F.col("host").alias("hot")))
    spread = F.array(*map(F.lit, range(SALTS)))
    dealt = hosts.join(F.broadcast(hot), F.col("host") == F.col("hot"), "left")
    dealt = dealt.select(F.col("host").alias("h"), F.explode(F.when(F.col("hot").isNotNull(), spread).otherwise(F.array(F.lit(0)))).alias("s"), F.col("verdict").alias("of_host"), "trust", "distrust")
    own = F.when(F.col("hot").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salted = ruled.join(F.broadcast(hot), F.col("host") == F.col("hot"), "left").withColumn("salt", own)
    judged = salted.join(dealt, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("s")), "left")
    return judged.select(
        *unpacked("row", pages.columns, RESULTS), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "of_host", F.lit("allow")).alias("verdict"),
        *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("trust", "distrust")],
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return judge(documents(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(what: int) -> str:
    cases = "".join(
        f" WHEN (host = '{d}' OR suffix(host, '.{d}')) AND starts_with(path, '{p}') THEN '{(v, d + p)[what]}'" for v, d, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE{cases} END"


#: The same in DuckDB, with a fixed number of rounds that brings every rank to its limit.
ORACLE_SQL = f"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
k AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
ruled AS MATERIALIZED (SELECT *, {_rule_sql(1)} AS rule, {_rule_sql(0)} AS fit FROM k),
lk AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{LINK.replace("'", "''")}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM ruled WHERE host <> ''),
e AS (SELECT src, dst, count(*)::DOUBLE AS w FROM lk WHERE src <> dst GROUP BY 1, 2),
both_ AS (SELECT 'trust' AS kind, src, dst, w FROM e UNION ALL SELECT 'distrust', dst, src, w FROM e),
st AS MATERIALIZED (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS p FROM both_),
sided AS (SELECT host, CASE WHEN good > bad THEN 'trust' WHEN bad > good THEN 'distrust' END AS kind FROM (SELECT host, count(*) FILTER (fit = 'allow') AS good, count(*) FILTER (fit = 'block') AS bad FROM ruled WHERE host <> '' GROUP BY 1)),
seed AS MATERIALIZED (SELECT kind, host, 1 / count(*) OVER (PARTITION BY kind) AS v FROM sided WHERE kind IS NOT NULL),
step AS (SELECT 0 AS i, kind, host, v AS r FROM seed
 UNION ALL SELECT i + 1, kind, host, sum(part) FROM (
  SELECT i, step.kind, dst AS host, r * p * {DAMPING} AS part FROM step JOIN st ON st.kind = step.kind AND st.src = step.host WHERE i < 120
  UNION ALL SELECT DISTINCT step.i, seed.kind, seed.host, seed.v * {1 - DAMPING} FROM seed, (SELECT DISTINCT i FROM step WHERE i < 120) step) GROUP BY 1, 2, 3),
ranks AS (SELECT kind, host, r / sum(r) OVER (PARTITION BY kind) AS r FROM step WHERE i = 120),
hv AS (SELECT host, CASE WHEN round(coalesce(sum(r) FILTER (kind = 'distrust'), 0) / sum(r), 3) >= {BLOCK_SHARE} THEN 'block' ELSE 'allow' END AS v FROM ranks GROUP BY 1)
SELECT page_id, ruled.host, path, rule, coalesce(fit, v, 'allow') AS verdict FROM ruled LEFT JOIN hv ON ruled.host = hv.host
"""
