"""Op 8: url filtering by rules and by trust propagated over links between hosts.

Rules decide first: a rule names a host, whose subdomains it also covers, and the
start of a path; of those that fit the longest wins, of equally long ones the
later. Other pages get the verdict of their host. A host is a seed of distrust by
the share of its pages that rules block, and of trust by the share that they allow
and NEUTRAL of the share on which they are silent. Trust is a personalised PageRank
from its seeds along host edges; distrust is one along reversed edges, so a host
that links to blocked hosts is distrusted. A host is blocked if distrust is at
least BLOCK_SHARE of its trust and distrust. Edges are all absolute urls in a
page's html that name another host; relative ones stay on their host. DataFrame
expressions only.

Defined results: a null url or one without :// has an empty host and path, no
rule, and the verdict of the host ""; null html has no links; a host without pages
of its own takes part in the propagation and seeds nothing; repeated rows and ids
keep their rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import HOT_KEYS, cut_lineage, join_by_weight, read_table

#: (verdict, host, start of path). Compiled into one expression: meant for tens of rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DAMPING = 0.85
NEUTRAL = 0.5
BLOCK_SHARE = 0.5
#: Steps of the propagation: what later ones would change is less than DAMPING ** STEPS, 3e-5, of all seeds together.
STEPS = 64
#: Steps between checkpoints; nothing is left to do when these change nothing.
AT_ONCE = 4
#: Blocked hosts that are broadcast, at most; more are joined to pages by shuffle.
BROADCAST_HOSTS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A url with a scheme anywhere in the html, or one without as the value of an attribute.
_LINK = r"(?i)(?:[a-z][a-z0-9+.-]*:|=\s*[\"']?\s*)//([^/?#\"'\s<>\\\\()]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _fitting(host: Column, path: Column, rules, value: int) -> Column:
    """The verdict (value 0) or the text (1) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.lit((verdict, rule_host + rule_path)[value])).otherwise(out)
    return out


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict)."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return urls.select("*", _fitting(F.col("host"), F.col("path"), rules, 1).alias("rule"), _fitting(F.col("host"), F.col("path"), rules, 0).alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: pages of src that name another host dst in a url."""
    links = pages.select(
        host_of(F.col("url")).alias("src"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(1)))).alias("dst"),
    )
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    return links.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def seeds(judged: DataFrame) -> DataFrame:
    """host, pages, trust, distrust: what its own pages make of each host."""
    share = lambda verdict: F.avg(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0))
    silent = F.avg(F.when(F.col("ruled").isNull(), 1.0).otherwise(0.0))
    return judged.groupBy("host").agg(F.count("*").alias("pages"), (share("allow") + NEUTRAL * silent).alias("trust"), share("block").alias("distrust"))


def _arcs(edges: DataFrame) -> DataFrame:
    """at, to, kind, share, hub: forward for trust, reversed for distrust; the shares of a host's arcs sum to one."""
    both = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit("trust").alias("kind"), "n").unionByName(
        edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit("distrust").alias("kind"), "n")
    )
    both = cut_lineage(both)
    total = both.count()
    sums = both.groupBy("at", "kind").agg(F.sum("n").alias("sum"), F.count("*").alias("arcs"))
    shared = join_by_weight(both, sums, ["at", "kind"], "arcs", total)
    return shared.select("at", "to", "kind", (F.col("n") / F.col("sum")).alias("share"), (F.col("arcs") * HOT_KEYS > total).alias("hub"))


def _given(arcs: DataFrame, hubs: DataFrame, now: DataFrame) -> DataFrame:
    """host, kind, given: what each host gets of the scores of those with arcs to it. Scores of hubs, which are few, are broadcast."""
    held = now.select(F.col("host").alias("at"), "kind", "score").where("score > 0")
    keys = ["at", "kind"]
    rows = arcs.where("NOT hub").join(held, keys).unionByName(arcs.where("hub").join(F.broadcast(held.join(F.broadcast(hubs), keys, "left_semi")), keys))
    return rows.groupBy(F.col("to").alias("host"), "kind").agg(F.sum(F.col("share") * F.col("score")).alias("given"))


def propagate(edges: DataFrame, start: DataFrame) -> DataFrame:
    """host, trust, distrust: personalised PageRank from the seeds (host, trust, distrust)."""
    seeded = start.select("host", "trust", "distrust").unpivot(["host"], ["trust", "distrust"], "kind", "seed")
    arcs = cut_lineage(_arcs(edges))
    if arcs.isEmpty():
        # Nothing is given on, so a host keeps the part of its seed that the steps give it.
        return start.select("host", *[((1 - DAMPING) * F.col(k)).alias(k) for k in ("trust", "distrust")])
    hubs = arcs.where("hub").select("at", "kind").distinct()
    reached = arcs.select(F.col("to").alias("host"), "kind", F.lit(0.0).alias("seed")).distinct()
    ranks = cut_lineage(seeded.unionByName(reached).groupBy("host", "kind").agg(F.sum("seed").alias("seed")).withColumn("score", F.col("seed")))
    for _ in range(STEPS // AT_ONCE):
        now = ranks
        for _ in range(AT_ONCE):
            fresh = (1 - DAMPING) * F.col("seed") + DAMPING * F.coalesce(F.col("given"), F.lit(0.0))
            now = now.join(_given(arcs, hubs, now), ["host", "kind"], "left").select("host", "kind", "seed", fresh.alias("score"))
        now = cut_lineage(now)
        was = ranks.select("host", "kind", F.col("score").alias("was"))
        moved = now.join(was, ["host", "kind"]).agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0]
        ranks = now
        if not moved:
            break
    score = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return ranks.groupBy("host").agg(score("trust"), score("distrust"))


def host_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """host, pages (its rows), trust, distrust, verdict of every host with a page."""
    own = cut_lineage(seeds(ruled(pages, rules)))
    scores = propagate(host_edges(pages), own)
    bad = (F.col("distrust") > 0) & (F.round(F.col("distrust") - BLOCK_SHARE * (F.col("trust") + F.col("distrust")), 9) >= 0)
    return own.select("host", "pages").join(scores, "host").withColumn("verdict", F.when(bad, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    blocked = cut_lineage(host_verdicts(pages, rules).where("verdict = 'block'").select("host", "pages", F.col("verdict").alias("own")))
    judged = ruled(pages, rules)
    told, open_ = judged.where("ruled IS NOT NULL").withColumn("verdict", F.col("ruled")), judged.where("ruled IS NULL")
    if blocked.count() <= BROADCAST_HOSTS:
        rest = open_.join(F.broadcast(blocked.select("host", "own")), "host", "left").withColumn("verdict", F.coalesce("own", F.lit("allow")))
    else:
        total = open_.count()
        hit = join_by_weight(open_, blocked, ["host"], "pages", total).withColumn("verdict", F.col("own"))
        crowded = F.broadcast(blocked.where(F.col("pages") * HOT_KEYS > total).select("host"))
        missed = open_.join(crowded, "host", "left_anti").join(blocked.select("host"), "host", "left_anti").withColumn("verdict", F.lit("allow"))
        rest = hit.select(*missed.columns).unionByName(missed)
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return told.select(*columns).unionByName(rest.select(*columns))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))


def _sql_rule(value: int) -> str:
    cases = [
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(v, h + p)[value]}'"
        for v, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2]))[::-1]
    ]
    return "CASE " + " ".join(cases) + " END"


_SQL_LINK, _SQL_URL = _LINK.replace("'", "''"), _URL.replace("'", "''")
_SQL = f"""
WITH RECURSIVE urls AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{_SQL_URL}', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{_SQL_URL}', 2) AS path FROM pages
), judged AS (
  SELECT page_id, html, host, path, {_sql_rule(1)} AS rule, {_sql_rule(0)} AS ruled FROM urls
), edges AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(html, '{_SQL_LINK}', 1))), '{_UPPER}', '{_LOWER}') AS dst FROM judged
  ) WHERE src <> dst GROUP BY src, dst
), pairs AS (
  SELECT src AS origin, dst AS target, 'trust' AS kind, n FROM edges UNION ALL SELECT dst, src, 'distrust', n FROM edges
), arcs AS MATERIALIZED (
  SELECT origin, target, kind, n / sum(n) OVER (PARTITION BY origin, kind) AS share FROM pairs
), own AS (
  SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0::DOUBLE WHEN ruled IS NULL THEN {NEUTRAL}::DOUBLE ELSE 0 END) AS trust, avg(CASE WHEN ruled = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS distrust
  FROM judged GROUP BY host
), base AS MATERIALIZED (
  SELECT host, kind, sum(seed) AS seed FROM (
    SELECT host, 'trust' AS kind, trust AS seed FROM own UNION ALL SELECT host, 'distrust', distrust FROM own
    UNION ALL SELECT DISTINCT target, kind, 0.0::DOUBLE FROM arcs
  ) GROUP BY host, kind
), ranks AS (
  SELECT 0 AS step, host, kind, seed AS score FROM base
  UNION ALL
  SELECT step, host, kind, score FROM (
    WITH now AS (SELECT * FROM ranks WHERE step < {STEPS})
    SELECT (SELECT max(step) FROM now) + 1 AS step, b.host, b.kind, {1 - DAMPING} * b.seed + {DAMPING} * coalesce(g.given, 0) AS score
    FROM base b LEFT JOIN (
      SELECT a.target AS host, a.kind, sum(a.share * r.score) AS given FROM arcs a JOIN now r ON r.host = a.origin AND r.kind = a.kind GROUP BY a.target, a.kind
    ) g ON g.host = b.host AND g.kind = b.kind
    WHERE (SELECT count(*) FROM now) > 0
  )
), scores AS (
  SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) AS distrust
  FROM ranks WHERE step = {STEPS} GROUP BY host
)
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN distrust > 0 AND round(distrust - {BLOCK_SHARE} * (trust + distrust), 9) >= 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged JOIN scores USING (host)
"""

QUERIES = {"op8_url_filters": op8_url_filters}
ORACLE_SQL = {"op8_url_filters": _SQL}
