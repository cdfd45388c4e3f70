"""URL filter by rules and, where none fits, by trust that spreads over the links between hosts.

Rules judge the urls that they fit. Hosts most of whose pages a rule allows (or blocks) are seeds. Trust is a personalised
PageRank from the trusted seeds along host edges; distrust is one from the blocked seeds along reversed edges, so that
who links to blocked hosts loses. A host whose distrust is above its trust is blocked. Masses are integers that are
rounded down, so every run and every order of summing gives the same verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.stage import stage

C = F.col
#: Verdict and place: host, then path. A rule fits its host and all subdomains.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
TOTAL = 10**15  # mass that all seeds of a kind share; TOTAL * FOLLOW fits in 64 bits
FOLLOW = 85  # percent of a host's mass that its edges carry on
ROUNDS = 40  # beyond which 0.85 ** 40 of the mass, 0.15 percent, is left to move
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"^.*?://([^/?#]*)"
PATH = r"^.*?://[^/?#]*([^?#]*)"
#: Links with a host of their own: scheme://host or //host in an href.
LINK = r"""[hH][rR][eE][fF][ \t\n\r\f]*=[ \t\n\r\f]*["']?[ \t\n\r\f]*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^"' \t\n\r\f>/?#]*)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)" + HOST, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)" + PATH, 1)


def _cut(place: str) -> tuple[str, str]:
    host, slash, path = place.partition("/")
    return host, slash + path


def rule_of(host: Column, path: Column, rules) -> Column:
    """Place of the longest rule that fits, or null."""
    best = F.lit(None).cast("string")
    for _, place in sorted(rules, key=lambda r: len(r[1])):
        rule_host, start = _cut(place)
        best = F.when(((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(start), place).otherwise(best)
    return best


def _judged(pages: DataFrame, rules) -> DataFrame:
    """host_, path_, rule_, said_ beside the url's columns: what the rules alone say."""
    said = F.lit(None).cast("string")
    for verdict, place in rules:
        said = F.when(C("rule_") == place, verdict).otherwise(said)
    return pages.withColumn("host_", host_of(C("url"))).withColumn("path_", path_of(C("url"))).withColumn("rule_", rule_of(C("host_"), C("path_"), rules)).withColumn("said_", said)


def host_seeds(pages: DataFrame, rules=RULES) -> DataFrame:
    """host, good, bad: the pages by which a rule's allowed (or blocked) ones outnumber the others of the kind against them."""
    count = lambda verdict: F.sum(F.when(C("said_") == verdict, 1).otherwise(0))
    hosts = _judged(pages.select("url"), rules).filter("host_ <> ''").groupBy(C("host_").alias("host"))
    hosts = hosts.agg(F.count("*").alias("pages"), count("allow").alias("allowed"), count("block").alias("blocked"))
    return hosts.select("host", F.greatest(C("allowed") - C("blocked"), F.lit(0)).alias("good"), F.greatest(2 * C("blocked") - C("pages"), F.lit(0)).alias("bad"))


def host_edges(pages: DataFrame) -> DataFrame:
    """source, target: pairs of different hosts of which a page of the first links to the second, once each."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1), lambda x: F.translate(x, UPPER, LOWER)))
    each = pages.select(host_of(C("url")).alias("source"), F.explode(links).alias("target"))
    return each.filter("source <> '' AND target <> '' AND source <> target").distinct()


def host_ranks(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, total: int = TOTAL) -> DataFrame:
    """host, trust, distrust of every host of `seeds` or `edges`.

    A round is one join of the hosts' masses with the moves and one sum by target, combined before its shuffle; a host with
    many links is split by Spark's skew join. Masses only grow, so equal sums mean that nothing moves any more.
    """
    goods, bads = seeds.agg(F.sum("good"), F.sum("bad")).first()
    share = lambda c, all_: (C(c) * (total // all_ if all_ else 0)).cast("long")
    own = seeds.select("host", share("good", goods).alias("trust"), share("bad", bads).alias("distrust"))
    ends = edges.select(C("source").alias("host")).union(edges.select(C("target").alias("host"))).distinct()
    kept = lambda c: F.expr(f"coalesce({c}, 0L) * {100 - FOLLOW} div 100")
    start = stage(ends.join(own, "host", "full").select("host", kept("trust").alias("trust"), kept("distrust").alias("distrust")))
    ahead = edges.join(edges.groupBy("source").agg(F.count("*").alias("n")), "source").select(C("source").alias("host"), C("target").alias("to"), "n", F.lit(True).alias("forward"))
    back = edges.join(edges.groupBy("target").agg(F.count("*").alias("n")), "target").select(C("target").alias("host"), C("source").alias("to"), "n", F.lit(False).alias("forward"))
    moves = stage(ahead.union(back))
    now, stamp = start, None
    for _ in range(rounds):
        part = lambda mass, way: F.when(C("forward") == way, F.expr(f"{FOLLOW} * {mass} div (100 * n)")).otherwise(0).alias(mass)
        sent = moves.join(now, "host").select(C("to").alias("host"), part("trust", True), part("distrust", False)).filter("trust > 0 OR distrust > 0")
        now = stage(start.union(sent).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
        sums = tuple(now.agg(F.sum(C("trust").cast("decimal(38,0)")), F.sum(C("distrust").cast("decimal(38,0)"))).first())
        if sums == stamp:
            break
        stamp = sums
    return now


def url_verdicts(pages: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of `pages` (page_id, url, html; others are ignored).

    host: between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased; path: from there to `?`, `#` or
    the end; both empty for a null url or one without `://`. rule: the longest that fits, else null. verdict: the rule's;
    else block if the host's distrust is above its trust, else allow, so that a host that nothing reaches is left alone.
    An empty host is no node of the graph. Null html has no links; links without a host, or to their own host, make no
    edge. Repeated rows count as pages and come back as often; null ids stay null. Texts of any length are read whole.
    No rows give no rows.
    """
    pages = pages.select("page_id", "url", "html")
    ranks = host_ranks(stage(host_seeds(pages, rules)), stage(host_edges(pages)), rounds)
    judged = _judged(pages.select("page_id", "url"), rules).join(ranks.withColumnRenamed("host", "host_"), "host_", "left")
    own = F.when(C("distrust") > C("trust"), "block").otherwise("allow")
    mass = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return judged.select("page_id", C("host_").alias("host"), C("path_").alias("path"), C("rule_").alias("rule"), F.coalesce("said_", own).alias("verdict"), mass("trust"), mass("distrust"))


def allowed_pages(pages: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """The rows of `pages` whose verdict is allow, with all their columns; rows are told apart by a number of their own."""
    name = "row_of_verdict"
    numbered = stage(pages.withColumn(name, F.monotonically_increasing_id()))
    good = url_verdicts(numbered.select(C(name).alias("page_id"), "url", "html"), rules, rounds).filter("verdict = 'allow'")
    return numbered.join(good.select(C("page_id").alias(name)), name, "left_semi").select(*[F.col(f"`{c}`") for c in pages.columns])


def verdict_sql(rules=RULES, rounds: int = ROUNDS) -> str:
    """The same in SQL: rounds as a recursive table."""
    fits = []
    for verdict, place in sorted(rules, key=lambda r: -len(r[1])):
        host, start = _cut(place)
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{start}')", place, verdict))
    rule = " ".join(f"WHEN {fit} THEN '{place}'" for fit, place, _ in fits)
    said = " ".join(f"WHEN {fit} THEN '{verdict}'" for fit, _, verdict in fits)
    link = LINK.replace("'", "''")
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    host = lower(rf"regexp_extract(coalesce(url, ''), '{HOST}', 1, 's')")
    return rf"""
WITH RECURSIVE p AS (SELECT page_id, html, {host} AS host, regexp_extract(coalesce(url, ''), '{PATH}', 1, 's') AS path FROM pages),
j AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {said} END AS said FROM p),
per AS (SELECT host, greatest(count(*) FILTER (WHERE said = 'allow') - count(*) FILTER (WHERE said = 'block'), 0) AS good,
               greatest(2 * count(*) FILTER (WHERE said = 'block') - count(*), 0) AS bad FROM j WHERE host <> '' GROUP BY host),
own AS (SELECT host, CAST(coalesce(good * ({TOTAL} // nullif(sum(good) OVER (), 0)), 0) AS BIGINT) AS t,
               CAST(coalesce(bad * ({TOTAL} // nullif(sum(bad) OVER (), 0)), 0) AS BIGINT) AS d FROM per),
e AS (SELECT DISTINCT source, target FROM (SELECT host AS source, {lower("l")} AS target
      FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS l FROM p)) WHERE source <> '' AND target <> '' AND source <> target),
node AS (SELECT host, coalesce(t, 0) * {100 - FOLLOW} // 100 AS t, coalesce(d, 0) * {100 - FOLLOW} // 100 AS d
         FROM (SELECT source AS host FROM e UNION SELECT target FROM e UNION SELECT host FROM own) LEFT JOIN own USING (host)),
moves AS (SELECT host AS f, host AS g, 0 AS kind, t, d, 1 AS n FROM node
          UNION ALL SELECT source, target, 1, 0, 0, count(*) OVER (PARTITION BY source) FROM e
          UNION ALL SELECT target, source, 2, 0, 0, count(*) OVER (PARTITION BY target) FROM e),
r AS (SELECT host, CAST(t AS BIGINT) AS trust, CAST(d AS BIGINT) AS distrust, 0 AS i FROM node
      UNION ALL SELECT g, CAST(sum(CASE kind WHEN 0 THEN m.t WHEN 1 THEN {FOLLOW} * trust // (100 * n) ELSE 0 END) AS BIGINT),
                       CAST(sum(CASE kind WHEN 0 THEN m.d WHEN 2 THEN {FOLLOW} * distrust // (100 * n) ELSE 0 END) AS BIGINT), i + 1
      FROM r JOIN moves m ON m.f = r.host WHERE i < {rounds} GROUP BY g, i)
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM j LEFT JOIN (SELECT * FROM r WHERE i = {rounds}) k ON k.host = j.host"""
