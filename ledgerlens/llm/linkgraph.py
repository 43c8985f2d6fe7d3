"""URL filter: rules first, then trust and distrust propagated over the host link graph.

Rules are a short configured list of (host, path prefix, verdict). A rule fits its host and all subdomains where the
url's path starts with its path; the longest (host and path together) wins, ties go to the first in text order.

Pages that no rule fits are judged by their host. Host edges are the links of the pages' HTML to other hosts (absolute
or scheme-relative href and src), weighted by linking pages, and, as hosts under one name are run together, an edge of
weight 1 both ways between a host and its parent name. Personalised PageRank spreads trust along the edges from hosts
with pages that an allow rule fits; distrust spreads against the edges (who links to blocked hosts is suspect) from
hosts with pages that a block rule fits. Either starts with a mass by the number of those pages. Distrust that a host
itself starts with by a rule for some of its paths doesn't count against its other pages: the rule has said which are meant;
only what reaches it from others does. A host is blocked if its distrust is at least `least`
of trust and distrust together. Hosts that neither reaches, and pages without host, are allowed.

Scale: links are reduced to (host, host, pages) before anything else; a round is one join of the masses, unique per
host, with the edges and one pre-aggregated sum. A hub's edges are split by the adaptive skew join. Rounds go on until no
new host is reached, however long the chain, and AT_ONCE further rounds change the masses by `tolerance` of a seed mass of 1
at most (about 50 rounds, as what is left after n rounds is damping^n).

Defined cases: a null url, or one without ://, has empty host and path. Null HTML has no links. Repeated rows each give
rows. Empty tables give no rows; without seeds every other host is allowed. Only the three named columns are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import discard, written

#: Edges that a task of a propagation round takes, about.
ROWS_PER_TASK = 100_000
#: Propagation rounds between two written tables.
AT_ONCE = 4
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The winning rule as a struct (rule, verdict), else null."""
    out = None
    for name, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        value = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, w): links between hosts by number of pages and links, and the edges to parent names."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("to")).select(
        F.col("host").alias("src"), F.translate("to", string.ascii_uppercase, string.ascii_lowercase).alias("dst"))
    links = links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    # the host and all names above it that have two labels at least
    labels = F.split("host", r"\.")
    chain = hosts.select(F.explode(F.expr(
        r"transform(sequence(1, greatest(1, size(split(host, '\\.')) - 2)), k -> struct("
        r"array_join(slice(split(host, '\\.'), k, size(split(host, '\\.'))), '.') as c, "
        r"array_join(slice(split(host, '\\.'), k + 1, size(split(host, '\\.'))), '.') as p))"
    )).alias("x"), F.size(labels).alias("n")).where("n > 2").select("x.c", "x.p").distinct()
    family = chain.select(F.col("c").alias("src"), F.col("p").alias("dst")).union(chain.select("p", "c")).withColumn("w", F.lit(1.0))
    return links.union(family).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """Masses (host, kind, mass) of personalised PageRank; edges (kind, src, dst, w), seeds (kind, host, mass).

    The masses of each kind's seeds are scaled to 1. Each kind runs over its own edges, both in one table. Mass at a
    host without edges is lost.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    steps = written(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("all")).alias("p")))
    # a round works on so many rows at most: as many tasks as they need, not as many as shuffles are set to
    tasks = max(8, -(-steps.count() // ROWS_PER_TASK))
    total = seeds.groupBy("kind").agg(F.sum("mass").alias("all"))
    start = written(seeds.join(total, "kind").select("kind", "host", (F.col("mass") / F.col("all")).alias("mass")).coalesce(tasks))
    mass, reached = start, start.count()
    while reached:
        new = mass
        for _ in range(AT_ONCE):
            moved = steps.join(new.withColumnRenamed("host", "src"), ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), (F.col("p") * F.col("mass") * damping).alias("mass")).coalesce(tasks)
            back = start.select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass"))
            new = moved.union(back).groupBy("kind", "host").agg(F.sum("mass").alias("mass")).coalesce(tasks)
        new = written(new)
        both = new.union(mass.select("kind", "host", -F.col("mass"))).groupBy("kind", "host").agg(F.sum("mass").alias("d"))
        change = both.agg(F.sum(F.abs("d"))).first()[0]
        now = new.count()
        if mass is not start:
            discard(mass)
        mass = new
        if now == reached and change <= tolerance:
            break
        reached = now
    if mass is not start:
        discard(start)
    discard(steps)
    return mass


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url_col: str = "url",
          html_col: str = "html", damping: float = 0.85, least: float = 0.5, tolerance: float = 1e-3) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of each page."""
    url = F.col(url_col).cast("string")
    judged = pages.select(F.col(page_id).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = written(judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select(
        "id", "host", "path", "r.rule", F.col("r.verdict").alias("by_rule")))
    whole = [n + p for n, p, v in rules if v == "block" and p == "/"]
    hosts = written(judged.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("by_rule") == "allow").cast("double").alias("trust"),
        F.count_if(F.col("by_rule") == "block").cast("double").alias("distrust"),
        F.count_if((F.col("by_rule") == "block") & ~F.col("rule").isin(whole)).cast("double").alias("by_path")))
    linked = host_edges(pages.select(host_of(url).alias("host"), F.col(html_col).cast("string").alias("html")), hosts)
    linked = written(linked)
    edges = linked.select(F.lit("trust").alias("kind"), "src", "dst", "w").union(
        linked.select(F.lit("distrust"), F.col("dst"), F.col("src"), "w"))
    seeds = hosts.select(F.lit("trust").alias("kind"), "host", F.col("trust").alias("mass")).union(
        hosts.select(F.lit("distrust"), "host", "distrust")).where("mass > 0")
    mass = propagate(edges, seeds, damping, tolerance)
    of = mass.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("mass")).otherwise(0.0)).alias("trust"),
                                  F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(0.0)).alias("distrust"))
    all_blocked = hosts.agg(F.sum("distrust")).first()[0] or 1.0
    own = hosts.where("by_path > 0").select("host", (F.col("by_path") / all_blocked * (1 - damping)).alias("own"))
    of = written(of.join(own, "host", "left"))
    discard(linked, hosts, mass)
    zero = F.lit(0.0)
    trust, distrust = F.coalesce("trust", zero), F.coalesce("distrust", zero)
    received = distrust - F.coalesce("own", zero)
    by_host = F.when((received > 1e-12) & (received >= least * (trust + received)), "block").otherwise("allow")
    return judged.join(of, "host", "left").select(
        "id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
