"""URL filters: rules for hosts and paths, and a verdict by link-graph propagation for what no rule reaches.

The pages of the rules are the seeds: a host is trusted by the part of its pages that a rule allows, and blocked by the part that a rule
blocks. Trust follows the links (personalised PageRank over host edges); distrust goes back along them, from blocked hosts to those
that link to them. A host is blocked if its distrust is above its trust and no less than what a host has whose pages are blocked by half
and whom nobody else taints; else it is allowed.

Host edges are distinct (from, to) pairs with the number of links on pages: absolute and protocol-relative ``href`` values; and each host and the nearest of its
parent domains that is a host of the table are tied both ways, as one site. A host's links to itself say nothing and are left out.

Amounts are longs in units of 10^-12 and every division rounds down, so results don't depend on the order of sums. A round is one join of
the hosts to their edges and one sum by host; a host of over ``HUB`` edges on a side has its edges dealt over that many more keys
and its row repeated for each of them. Rounds stop early only when a round changes nothing. The state is written every ``TOGETHER``
rounds in the shared folder. The driver holds one count for each of those.

Defined cases: a null url, or one without ``://``, has an empty host and path; an empty host is no node and gets allow unless a rule fits.
A null html has no links. Links to hosts without pages are edges all the same. Rules of one length: the first given wins. Repeated pages count as often
as they stand. Long texts are read whole. An empty table gives an empty result; other columns of any name are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidlake.llm.common import staged

UNIT = 10**12
DAMPING = 85  # of 100
ROUNDS, TOGETHER = 24, 4
BLOCKED_PART = 50  # of 100 of a host's own pages
HUB = 10_000
MOST_RULES = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)[\x20\x09-\x0D"']href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?(?:https?:)?//([^/?#"'>\x20\x09-\x0D]+)"""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Fixed values of the contract.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """struct<rule, ruled> of the longest rule that fits; null fields where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules: they are part of the plan")
    ordered = sorted(rules, key=lambda r: -len(r.host + r.path))
    fits = [((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path) for r in ordered]

    def first(values: list[str]) -> Column:
        return F.coalesce(*[F.when(fit, F.lit(v)) for fit, v in zip(fits, values, strict=True)], F.lit(None).cast("string"))

    return F.struct(first([r.host + r.path for r in ordered]).alias("rule"), first([r.verdict for r in ordered]).alias("ruled"))


def links(pages: DataFrame) -> DataFrame:
    """(source, target, n): links between different hosts. pages: host, html."""
    to = F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1))
    found = pages.where("host <> ''").select(F.col("host").alias("source"), to.alias("target")).withColumn("target", F.translate("target", _UPPER, _LOWER))
    return found.where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def site_edges(hosts: DataFrame) -> DataFrame:
    """(source, target, n): each host and its nearest parent domain that is a host too, both ways."""
    labels = F.split("host", r"\.")
    parents = hosts.where("host <> ''").select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k + 1, F.size(labels)), "."))).alias("up", "parent"))
    known = hosts.select(F.col("host").alias("parent"))
    near = parents.join(known, "parent").groupBy("host").agg(F.min_by("parent", "up").alias("parent"))
    return near.select(F.explode(F.array(F.struct(F.col("host").alias("source"), F.col("parent").alias("target")), F.struct(F.col("parent").alias("source"), F.col("host").alias("target")))).alias("e")).select("e.*", F.lit(1).cast("long").alias("n"))


def _floor_part(value: str, times: str, of: str) -> Column:
    return F.expr(f"(cast({value} as decimal(19,0)) * cast({times} as decimal(19,0))) div cast({of} as decimal(19,0))")


def _steps(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What one round sends, (from_host, deal, to_host, kind, n, total): trust along an edge, distrust against it; and the keys of each (host, kind)."""
    both = edges.select("source", "target", "n", F.lit("trust").alias("kind")).unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "n", F.lit("distrust").alias("kind")))
    total = both.groupBy("source", "kind").agg(F.sum("n").alias("total"), F.count("*").alias("fan")).withColumn("deals", (F.col("fan") / HUB).cast("int") + 1)
    total = staged(total.select(F.col("source").alias("from_host"), "kind", "total", "deals"))
    steps = both.select(F.col("source").alias("from_host"), F.col("target").alias("to_host"), "kind", "n").join(total, ["from_host", "kind"])
    return staged(steps.withColumn("deal", F.pmod(F.xxhash64("to_host"), "deals").cast("int")).drop("deals")), total.select("from_host", "kind", "deals")


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of all hosts. seeds: host, trusted, blocked (longs, of UNIT); edges: source, target, n."""
    steps, deals = _steps(edges)
    own = lambda c: F.expr(f"({c} * {100 - DAMPING}) div 100")
    base = staged(seeds.select("host", own("trusted").alias("trusted"), own("blocked").alias("blocked")))
    state = base.select("host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust"))
    before = None
    for done in range(0, rounds, TOGETHER):
        for _ in range(min(TOGETHER, rounds - done)):
            amounts = state.select(F.col("host").alias("from_host"), F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "amount")).where("amount > 0")
            dealt = amounts.join(deals, ["from_host", "kind"]).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
            sent = dealt.join(steps, ["from_host", "kind", "deal"]).withColumn("sent", _floor_part("amount", "n", "total"))
            got = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("sent")).otherwise(0)).alias(f"got_{kind}")
            sums = sent.groupBy(F.col("to_host").alias("host")).agg(got("trust"), got("distrust"))
            new = lambda own, kind: F.expr(f"coalesce({own}, 0) + (coalesce(got_{kind}, 0) * {DAMPING}) div 100").alias(kind)
            state = base.join(sums, "host", "full_outer").select("host", new("trusted", "trust"), new("blocked", "distrust"))
        state = staged(state)
        after = tuple(state.agg(F.count("*"), F.sum(F.col("trust").cast("decimal(38,0)")), F.sum(F.col("distrust").cast("decimal(38,0)"))).first())
        if after == before:  # amounts never fall from round to round, so equal sums are equal states
            break
        before = after
    return state


def judge_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict of each page; trust and distrust are its host's."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), longest_rule(rules, host, path).alias("r")).select("page_id", "host", "path", "r.*")
    of_host = judged.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("barred"))
    hosts = staged(of_host.where("host <> ''"))
    seeds = hosts.select("host", _floor_part("allowed", str(UNIT), "n").alias("trusted"), _floor_part("barred", str(UNIT), "n").alias("blocked"))
    edges = links(pages.select(host.alias("host"), "html")).unionByName(site_edges(hosts))
    state = propagate(seeds, staged(edges.groupBy("source", "target").agg(F.sum("n").alias("n"))), rounds)
    least = UNIT * BLOCKED_PART * (100 - DAMPING) // 10_000
    amount = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = judged.join(state, "host", "left").select("page_id", "host", "path", "rule", "ruled", amount("trust"), amount("distrust"))
    found = F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", found).alias("verdict"), "trust", "distrust")


def _oracle() -> str:
    """The same in one statement, a common table for each round."""
    ordered = sorted(RULES, key=lambda r: -len(r.host + r.path))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in ordered) + " END"
    own = 100 - DAMPING
    state = [f"s0 AS MATERIALIZED (SELECT host, (allowed * {UNIT}::HUGEINT // n) * {own} // 100 AS trust, (barred * {UNIT}::HUGEINT // n) * {own} // 100 AS distrust FROM h)"]
    for k in range(1, ROUNDS + 1):
        state.append(
            f"g{k} AS (SELECT dst AS host, sum(CASE WHEN kind = 1 THEN trust * e.n // total ELSE 0 END) AS t, sum(CASE WHEN kind = 2 THEN distrust * e.n // total ELSE 0 END) AS d\n"
            f"        FROM s{k - 1} JOIN e ON src = host GROUP BY 1),\n"
            f"     s{k} AS MATERIALIZED (SELECT host, coalesce(s0.trust, 0) + coalesce(t, 0) * {DAMPING} // 100 AS trust, coalesce(s0.distrust, 0) + coalesce(d, 0) * {DAMPING} // 100 AS distrust\n"
            f"        FROM s0 FULL JOIN g{k} USING (host))"
        )
    return f"""
WITH u AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
     j AS (SELECT page_id, host, path, {case(lambda r: r.host + r.path)} AS rule,
                  {case(lambda r: r.verdict)} AS ruled FROM u),
     h AS MATERIALIZED (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS barred FROM j WHERE host <> '' GROUP BY 1),
     a AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{_HREF.replace("'", "''")}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM u WHERE host <> ''),
     p AS (SELECT h.host, q.host AS parent, row_number() OVER (PARTITION BY h.host ORDER BY length(q.host) DESC) AS k FROM h JOIN h q ON ends_with(h.host, '.' || q.host)),
     l AS (SELECT src, dst FROM a WHERE src <> dst UNION ALL SELECT host, parent FROM p WHERE k = 1 UNION ALL SELECT parent, host FROM p WHERE k = 1),
     n AS (SELECT src, dst, count(*)::HUGEINT AS n FROM l GROUP BY 1, 2),
     e AS MATERIALIZED (SELECT src, dst, n, 1 AS kind, sum(n) OVER (PARTITION BY src) AS total FROM n UNION ALL SELECT dst, src, n, 2, sum(n) OVER (PARTITION BY dst) FROM n),
     {(", " + chr(10) + "     ").join(state)}
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > trust AND distrust >= {UNIT * BLOCKED_PART * own // 10_000} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust FROM j LEFT JOIN s{ROUNDS} USING (host)"""


ORACLE = _oracle()
