"""URL filters: rules by host and path, and link-graph propagation of trust and distrust. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import cut, drop

#: (verdict, host, start of the path)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
#: Rounds of the SQL, which can't test for convergence.
ROUNDS = 10
#: Rounds between two writes that cut the lineage.
LEG = 5
#: Propagation ends when no score has grown in a leg by more than this share of itself, plus TINY: then no host is new either.
TOLERANCE, TINY = 1e-9, 1e-300

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's.

    Among rules of one length a block wins. Null if none fits.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links from the pages of one host to another host, counted. Links within a host are no edges."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where((F.col("src") != "") & (F.col("dst") != F.col("src")))
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of trust along the edges and of distrust against them: (host, trust, distrust).

    seeds: (host, trust, distrust), shares of the restart. A round gives each host (1 - damping) of its seed, and damping
    times what its neighbours hand on in proportion to their links. Mass that reaches a host without further links is
    dropped, which scales all scores alike. Both runs go through one join a round, on (run, host); every `LEG` rounds
    the scores are written to the shared folder.

    Without a number of rounds it goes on until every score is settled: scores only grow, and none has grown in the last leg by more
    than `tolerance` of itself, so that far hosts with small scores are as exact as near ones, and none was reached for the first
    time. That takes as many rounds as the longest way from a seed, and about 130 where links form cycles. Scores below `TINY`, some
    4,000 links from a seed, count as settled.
    """
    spark = edges.sparkSession
    both = edges.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("run"), F.col("src").alias("a"), F.col("dst").alias("b"), "n"),
        F.struct(F.lit("distrust").alias("run"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"),
    )).alias("e")).select("e.*")
    out = both.groupBy("run", "a").agg(F.sum("n").alias("all"))
    steps = cut(both.join(out, ["run", "a"]).select("run", "a", "b", (F.col("n") / F.col("all")).alias("share")), "op7-steps")
    start = seeds.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("run"), F.col("host").alias("a"), F.col("trust").alias("s")),
        F.struct(F.lit("distrust").alias("run"), F.col("host").alias("a"), F.col("distrust").alias("s")),
    )).alias("e")).select("e.*").where("s > 0")
    restart = cut(start.select("run", "a", (F.col("s") * (1 - damping)).alias("s")), "op7-seeds")
    now = restart
    if not steps.isEmpty():
        before, k = restart, 0
        while rounds is None or k < rounds:
            k += 1
            moved = now.join(steps, ["run", "a"]).select("run", F.col("b").alias("a"), (F.col("s") * F.col("share") * damping).alias("s"))
            now = restart.unionByName(moved).groupBy("run", "a").agg(F.sum("s").alias("s"))
            if k % LEG == 0:
                now = cut(now, "op7-scores")
                old = before.select("run", "a", F.col("s").alias("old"))
                grown = now.join(old, ["run", "a"], "left").where(F.col("s") - F.coalesce("old", F.lit(0.0)) > F.col("s") * tolerance + TINY)
                settled = rounds is None and grown.isEmpty()
                if before is not restart:
                    drop(spark, before)
                before = now
                if settled:
                    break
    return now.groupBy(F.col("a").alias("host")).agg(*(F.sum(F.when(F.col("run") == r, F.col("s")).otherwise(0.0)).alias(r) for r in ("trust", "distrust")))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int | None = None, damping: float = DAMPING, margin: float = 1.0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A verdict for every page: page_id, host, path, rule, verdict, trust, distrust.

    The longest fitting rule decides. Where none fits, the host does: hosts are seeded with their shares of all pages
    that rules allow (trust) or block (distrust), trust runs along the links between hosts and distrust against them, and
    a host whose distrust exceeds margin times its trust is blocked. Unseeded, unreached hosts have 0 and 0: allowed.
    Null urls or urls without `://` have an empty host and path, no rule, and are allowed by the method. Null or
    empty html has no links. Repeated rows and null page_ids come back as they are. Rules are literals of the
    plan, so their number should stay in the hundreds. Pages are reduced to their host before anything is
    shuffled; html is only read.
    """
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    base = base.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"))
    counts = base.where("host != ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    total = counts.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    seeds = counts.select("host", (F.col("allowed") / F.lit(max(1, total["allowed"] or 0))).alias("trust"), (F.col("blocked") / F.lit(max(1, total["blocked"] or 0))).alias("distrust"))
    scores = propagate(host_edges(pages, url_col, html_col), seeds, rounds, damping)
    out = base.join(scores, "host", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust")})
    method = F.when(F.col("distrust") > F.col("trust") * margin, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every page's verdict."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def sql(rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """The same for DuckDB, each round a table of its own; it ends after `rounds`, so it is the same only where the scores are settled by then."""
    fold = f"'{UPPER}', '{LOWER}'"
    order = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block"), reverse=True)
    test = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {test(h, p)} THEN '{h}{p}'" for _, h, p in order)
    ruled = " ".join(f"WHEN {test(h, p)} THEN '{v}'" for v, h, p in order)
    link = LINK.replace("'", "''")
    steps = "".join(
        f", r{k} AS MATERIALIZED (SELECT run, a, sum(s) AS s FROM (SELECT * FROM r0 UNION ALL SELECT r.run, b, s * share * {damping} FROM r{k - 1} r JOIN step ON r.run = step.run AND r.a = step.a) GROUP BY ALL)" for k in range(1, rounds + 1)
    )
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), {fold}) AS host, coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path, html FROM pages),
b AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {ruled} END AS ruled FROM p),
c AS (SELECT host, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked FROM b WHERE host <> '' GROUP BY host),
t AS (SELECT greatest(1, sum(allowed)) AS allowed, greatest(1, sum(blocked)) AS blocked FROM c),
edge AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), {fold}) AS dst FROM p) WHERE src <> '' AND dst <> src GROUP BY ALL),
way AS (SELECT 'trust' AS run, src AS a, dst AS b, n FROM edge UNION ALL SELECT 'distrust', dst, src, n FROM edge),
step AS (SELECT run, a, b, n / CAST(sum(n) OVER (PARTITION BY run, a) AS DOUBLE) AS share FROM way),
r0 AS (SELECT run, a, s * {1 - damping!r} AS s FROM (SELECT 'trust' AS run, host AS a, c.allowed / CAST(t.allowed AS DOUBLE) AS s FROM c, t UNION ALL SELECT 'distrust', host, c.blocked / CAST(t.blocked AS DOUBLE) FROM c, t) WHERE s > 0){steps},
h AS (SELECT a AS host, sum(CASE WHEN run = 'trust' THEN s ELSE 0 END) AS trust, sum(CASE WHEN run = 'distrust' THEN s ELSE 0 END) AS distrust FROM r{rounds} GROUP BY a)
SELECT page_id, b.host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict FROM b LEFT JOIN h ON b.host = h.host
"""


SQL = sql()
