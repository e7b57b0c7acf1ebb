"""URL verdicts by rules, and by trust that spreads over the host graph.

A rule allows or blocks the pages of a host, and of its subdomains, whose path
starts with the rule's path; the longest fitting rule decides.  Hosts of
allowed pages are seeds of trust, which a personalised PageRank passes on
along links; hosts of blocked pages are seeds of distrust, which passes
against the links, since a page answers for what it links to.  A page that no
rule fits is blocked when its host holds clearly more distrust than trust.

All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.session import stage

DAMPING = 0.85
ROUNDS = 12
ROUNDS_PER_STAGE = 4
DISTRUST_SHARE = 0.75
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # allow or block, host, path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest fitting rule as ``{rule, verdict}``, null if none fits."""
    chosen = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda rule: -len(rule[1] + rule[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        said = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, said) if chosen is None else chosen.when(fits, said)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if chosen is None else chosen


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct host pairs ``src``, ``dst`` with the number of links.

    A link is an absolute ``href`` of an ``<a>``; a relative one stays on its
    host and says nothing.  A host is also tied, both ways, to the next
    shorter host name that owns pages, since both belong to one site.
    """
    links = (pages.filter("host <> '' and html is not null")
             .select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("to"))
             .filter(F.col("to").rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"))
             .select(F.col("host").alias("src"), host_of(F.concat(F.lit("x:"), F.regexp_extract("to", r"(//.*)", 1)))
                     .alias("dst")).filter("dst <> '' and src <> dst"))
    linked = links.groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.filter("host <> ''").select("host").distinct()
    labels = F.split("host", r"\.")
    parents = hosts.select("host", F.posexplode(F.transform(
        F.sequence(F.lit(2), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    ).alias("depth", "parent")).filter("parent <> ''")
    ties = (parents.join(hosts.withColumnRenamed("host", "parent"), "parent", "left_semi")
            .groupBy("host").agg(F.min_by("parent", "depth").alias("parent")))
    return (linked.unionByName(ties.select(F.col("host").alias("src"), F.col("parent").alias("dst"), F.lit(1).cast("long").alias("n")))
            .unionByName(ties.select(F.col("parent").alias("src"), F.col("host").alias("dst"), F.lit(1).cast("long").alias("n")))
            .groupBy("src", "dst").agg(F.sum("n").alias("n")))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``host`` with its ``trust`` and ``distrust`` after ``ROUNDS`` rounds.

    ``seeds`` holds ``kind`` (trust or distrust), ``host`` and ``weight``.
    Both walks restart at their seeds in proportion to the weights.  They run
    as one table keyed by kind and host.
    """
    moves = (edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
             .unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"),
                                       F.col("src").alias("to"), "n")))
    degree = moves.groupBy("kind", "host").agg(F.sum("n").alias("degree"))
    moves = stage(moves.join(degree, ["kind", "host"])
                  .select("kind", "host", "to", (F.lit(DAMPING) * F.col("n") / F.col("degree")).alias("share")),
                  "host-moves")
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))  # two rows
    start = stage(seeds.join(F.broadcast(total), "kind")
                  .select("kind", "host", (F.col("weight") / F.col("total")).alias("rank")), "host-seeds")
    ranks = start
    for turn in range(1, ROUNDS + 1):
        moved = ranks.join(moves, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
        restart = start.select("kind", "host", (F.col("rank") * (1 - DAMPING)).alias("rank"))
        ranks = moved.unionByName(restart).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if turn % ROUNDS_PER_STAGE == 0:
            ranks = stage(ranks, "host-ranks")
    return ranks.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0.0)).alias("distrust"))


def judged(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per page: ``host``, ``path``, the deciding ``rule`` or null, and the ``verdict``.

    A null url, or one without ``://``, has empty host and path.  Where no
    rule fits, the page is blocked if distrust is at least ``DISTRUST_SHARE``
    of its host's trust and distrust together, else allowed; so a host that
    nothing is known of is allowed.  Repeated pages are judged one by one; an
    empty table gives no rows; other columns are ignored.  ``rules`` is a
    short list that becomes one expression.
    """
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"),
                         path_of(F.col("url")).alias("path"), "html")
    ruled = split.withColumn("by_rule", rule_for(rules, F.col("host"), F.col("path")))
    seeds = (ruled.filter("by_rule is not null and host <> ''")
             .groupBy(F.when(F.col("by_rule.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
             .agg(F.count("*").alias("weight")))
    known = propagate(host_edges(split), seeds)
    blocked = known.filter(F.col("distrust") >= DISTRUST_SHARE * (F.col("trust") + F.col("distrust")))
    doubted = blocked.filter("distrust > 0").select("host", F.lit("block").alias("doubt"))
    return ruled.select("page_id", "host", "path", "by_rule").join(doubted, "host", "left").select(
        "page_id", "host", "path", "by_rule.rule",
        F.coalesce("by_rule.verdict", "doubt", F.lit("allow")).alias("verdict"))
