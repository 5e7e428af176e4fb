"""URL filters: path rules, then trust and distrust spread over the graph of hosts.

A rule names a host and a path prefix and fits that host and its subdomains; the longest
rule that fits decides.  Hosts whose pages the rules allow seed a personalised PageRank
along host edges, hosts whose pages they block seed one along reversed edges.  Host edges
are hyperlinks between hosts and the steps between a host and its parent domains.  Pages
without a rule get their host's verdict: block where distrust exceeds ``ratio`` times
trust.

Nulls and edge cases: a null url, and one without ``://``, has an empty host and path and
no rule; it is allowed, as is every host that no seed reaches; null html has no links;
repeated rows are judged alike and count as pages; ties between trust and distrust allow;
an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import discard, materialise

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    """Rule from a text like ``example.org/es/``: host up to the first slash, then path."""
    host, slash, rest = text.partition("/")
    return Rule(verdict, host, slash + rest)


# The rules that the query applies.
RULES = [
    parse_rule("allow", "org/"),
    parse_rule("block", "example.org/es/"),
    parse_rule("block", "example.org/en/1"),
    parse_rule("allow", "com/fr/"),
    parse_rule("block", "com/de/"),
]


def _after_scheme(url: Column) -> Column:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UP, _LOW)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null without one."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        ok = fits(r, host, path)
        text = F.when(ok, r.text) if text is None else text.when(ok, r.text)
        verdict = F.when(ok, r.verdict) if verdict is None else verdict.when(ok, r.verdict)
    null = F.lit(None).cast("string")
    return (text, verdict) if text is not None else (null, null)


def host_edges(pages: DataFrame) -> DataFrame:
    """Weighted edges src -> dst between different hosts, from links and parent domains.

    ``pages`` has host and html.  Weights are numbers of links; a step between a host and
    its parent domain weighs one in each direction.
    """
    links = pages.filter("html is not null and host <> ''").select(
        F.col("host").alias("src"),
        F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))).alias("url"))
    # a link without a scheme has that of its page, whose host is read alike
    links = links.withColumn("url", F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url")))
    links = links.select("src", host_of(F.col("url")).alias("dst")).filter("dst <> '' and dst <> src")
    # read twice below, so that the pages are searched for links once
    links = materialise(links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")), "url-links")
    hosts = pages.select("host").distinct().union(links.select(F.col("dst").alias("host"))).distinct()
    # every domain along the way up: a.b.c -> b.c -> c
    parts = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    steps = hosts.filter("host <> ''").select(F.explode(F.arrays_zip(F.slice(chain, 1, F.size(chain) - 1).alias("low"), F.slice(chain, 2, F.size(chain)).alias("up"))).alias("s")).select("s.low", "s.up").filter("low is not null and up is not null and low <> '' and up <> ''").distinct()
    one = F.lit(1.0).alias("weight")
    tree = steps.select(F.col("low").alias("src"), F.col("up").alias("dst"), one).union(steps.select(F.col("up").alias("src"), F.col("low").alias("dst"), one))
    return links.union(tree).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, ratio: float = 1.0, tie: float = 1e-9, settle_every: int = 10, rounds: int | None = None) -> DataFrame:
    """Trust and distrust of every host by personalised PageRank.

    Rounds go on until they can change no host's verdict: no host was reached anew, and for
    each host ``ratio`` times trust and distrust are further apart than all that is still to
    come, or differ by less than ``tie`` of their sum with less than that to come.  What is
    to come is bounded by the last moves of all ranks, which shrink by the damping each
    round.  With ``rounds`` exactly as many are made.

    ``seeds`` has host, trusted and blocked (weights).  Both walks run in one table, with
    a kind column; distrust goes against the edges.  What would leave a host without
    edges ends there.
    """
    both = edges.select(F.lit("t").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    step = materialise(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "url-steps")
    start = seeds.select(F.lit("t").alias("kind"), "host", F.col("trusted").alias("w")).union(seeds.select(F.lit("d").alias("kind"), "host", F.col("blocked").alias("w"))).filter("w > 0")
    sums = start.groupBy("kind").agg(F.sum("w").alias("all"))
    start = materialise(start.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("w") / F.col("all")).alias("rank")), "url-seeds")
    rank = settled = start
    reached, done, i = -1, False, 0
    while not done:
        moved = rank.join(step, (rank["kind"] == step["kind"]) & (rank["host"] == step["src"])).select(rank["kind"], F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        rank = moved.union(start.select("kind", "host", (F.col("rank") * (1 - damping)).alias("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        i += 1
        if i % settle_every and i != rounds:
            continue
        rank = materialise(rank, "url-rank")
        if rounds is None:
            both = rank.withColumn("move", F.col("rank")).union(settled.select("kind", "host", F.lit(0.0), -F.col("rank")))
            both = both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.abs(F.sum("move")).alias("move"))
            weight = F.when(F.col("kind") == "t", F.lit(ratio)).otherwise(F.lit(1.0))
            fade = damping ** settle_every
            ahead = both.agg((F.coalesce(F.sum(weight * F.col("move")), F.lit(0.0)) * fade / (1 - fade)).alias("x")).scalar()  # a subquery of one value
            sides = both.withColumn("w", weight * F.col("rank")).groupBy("host").agg(
                F.count("*").alias("n"), F.abs(F.sum(F.when(F.col("kind") == "t", F.col("w")).otherwise(-F.col("w")))).alias("apart"), F.sum("w").alias("all"))
            may_turn = (F.col("apart") <= ahead) & ((F.col("apart") > tie * F.col("all")) | (ahead > tie * F.col("all")))
            now = sides.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(may_turn).alias("open")).first()
            done = now["n"] == reached and now["open"] == 0
            reached = now["n"]
        else:
            done = i >= rounds
        if settled is not start:
            discard(settled)
        settled = rank
    discard(step)
    return rank.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "t", F.col("rank")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "d", F.col("rank")).otherwise(0.0)).alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[Rule] = RULES, *, ratio: float = 1.0, tie: float = 1e-9, **walk) -> DataFrame:
    """page_id, host, path, rule, verdict, and the trust and distrust of the host.

    A host's seed weights are the shares of its pages that rules allow and block.
    """
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    text, ruled = longest_rule(rules, F.col("host"), F.col("path"))
    judged = base.select("page_id", "host", "path", text.alias("rule"), ruled.alias("ruled"))
    seeds = materialise(judged.filter("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce(F.col("ruled") == "allow", F.lit(False))).cast("double")).alias("trusted"),
        F.avg((F.coalesce(F.col("ruled") == "block", F.lit(False))).cast("double")).alias("blocked")), "url-hosts")
    ranks = spread(host_edges(base.select("host", "html")), seeds, ratio=ratio, tie=tie, **walk).withColumnRenamed("host", "_host")
    # pages of a hot host meet one row of ranks; AQE splits such a join where it shuffles
    found = judged.join(ranks, judged["host"] == ranks["_host"], "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    # sums of doubles differ in their last digits with the order of rows: no verdict hangs on these
    host_verdict = F.when(distrust - ratio * trust > tie * (distrust + ratio * trust), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", host_verdict).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
