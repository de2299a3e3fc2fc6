"""URL filters: allow and block rules, and propagation of trust and distrust over the link graph of hosts.

A rule (action, host, path) fits a URL of its host or a subdomain whose path starts with the rule's path; the longest rule wins
(block before allow at equal length). Hosts with pages that a rule allows are trusted seeds, hosts with pages that a rule blocks
are blocked seeds, both weighted by pages. Edges lead from a page's host to the hosts it links to, and both ways between a host
and the next shorter domain of two labels or more. Personalised PageRank spreads trust along the edges and distrust against them;
a host is blocked when its distrust is more than `share` of both together, and allowed otherwise, also where neither arrives.

The ranks solve a system of linear equations. Hosts with a single neighbour, most of all hosts, are eliminated from it first, layer
by layer, which is exact and takes one join a layer; what is left is propagated as residuals: a step passes on what hosts got
since they last did, and only from hosts whose own rank that still changes.

DataFrame functions only. Null URLs and URLs without `://` have an empty host and path and fit no rule. Null html has no links.
Rows are judged one by one, repeated rows alike; empty tables stay empty; columns other than page_id, url and html are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescope.plans.scratch import write_scratch

DAMPING = 0.85
#: Layers of hosts with a single neighbour that are eliminated at most; the others are propagated.
LAYERS = 8
#: What a host may have got and not passed on, as a part of its rank.
CHANGE = 1e-8
SHARE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s{0,4}=\s{0,4}["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """All columns, and host and path."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    })


def suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(action, rule_host, rule_path) as a table."""
    one = [F.struct(F.lit(a).alias("action"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for a, h, p in rules]
    return spark.range(1).select(F.explode(F.array(*one)).alias("r")).select("r.*")


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """`pages` (host, path, ...) with rule and action of the longest rule that fits, else null."""
    hosts = pages.select("host").where("host <> ''").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("rule_host"))
    fitting = hosts.join(rules, "rule_host").groupBy("host").agg(
        F.collect_list(F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("size"), (F.col("action") == "block").alias("blocks"),
            F.concat("rule_host", "rule_path").alias("rule"), "rule_path", "action",
        )).alias("_rules")
    )
    # Written: a hot host's pages can be split in the join only if nothing there was dealt by host for another reason.
    fitting = write_scratch(fitting, "fitting")
    best = F.array_max(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    joined = pages.join(fitting.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left")
    return joined.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "action": F.col("_best.action")}).drop("_host", "_rules", "_best")


def edges_of(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, weight): links between hosts, and steps between a host and the domain above it."""
    linked = pages.where("host <> ''").select("host", F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)))).alias("link"))
    links = linked.select(F.col("host").alias("src"), F.translate("link", UPPER, LOWER).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select("host").where("host <> ''").unionAll(links.select("dst")).distinct()
    domain = F.filter(suffixes(F.col("host")), lambda d: F.size(F.split(d, r"\.")) >= 2)
    chain = hosts.select(F.explode(F.arrays_zip(domain.alias("low"), F.slice(domain, 2, F.greatest(F.size(domain), F.lit(1))).alias("high"))).alias("e")).where("e.high IS NOT NULL")
    steps = chain.select(F.col("e.low").alias("src"), F.col("e.high").alias("dst")).distinct()
    both = steps.unionAll(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return links.where("src <> dst").unionAll(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def single_neighbours(way: DataFrame) -> DataFrame:
    """(host, other): the hosts with one neighbour only; of two that have but each other, the larger one."""
    links = way.where("kind = 'trust' AND src <> dst").select("src", "dst")
    both = links.unionAll(links.select("dst", "src")).toDF("host", "other")
    # Of a host with many neighbours a task passes on two.
    alone = both.groupBy("host").agg(F.min("other").alias("other"), F.max("other").alias("last")).where("other = last").drop("last")
    back = alone.select(F.col("host").alias("other"), F.col("other").alias("_back"))
    return alone.join(back, "other", "left").where("_back IS NULL OR host > other").select("host", "other")


def _less_leaves(nodes: DataFrame, way: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The system without some leaves: what is needed to get their ranks back, and the nodes and ways that are left.

    A leaf's rank is (b + inward * rank of its neighbour) / (1 - loop), so its neighbour gets outward * b / (1 - loop) once and
    a loop of inward * outward / (1 - loop).
    """
    inward = way.join(leaves, (way.dst == leaves.host) & (way.src == leaves.other)).select("kind", "host", F.col("part").alias("inward"))
    outward = way.join(leaves, (way.src == leaves.host) & (way.dst == leaves.other)).select("kind", "host", F.col("part").alias("outward"))
    facts = nodes.join(leaves, "host").join(inward, ["kind", "host"], "left").join(outward, ["kind", "host"], "left").na.fill(0.0, ["inward", "outward"])
    facts = write_scratch(facts.select("kind", "host", "other", "b", "loop", "inward", "outward"), "leaves")
    gained = facts.groupBy("kind", F.col("other").alias("host")).agg(
        F.expr("sum(outward * b / (1 - loop))").alias("more_b"), F.expr("sum(inward * outward / (1 - loop))").alias("more_loop")
    )
    gone = leaves.select("host")
    left = nodes.join(gone, "host", "left_anti").join(gained, ["kind", "host"], "left").na.fill(0.0, ["more_b", "more_loop"])
    left = left.select("kind", "host", (F.col("b") + F.col("more_b")).alias("b"), (F.col("loop") + F.col("more_loop")).alias("loop"))
    ways = way.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("kind", "src", "dst", "part")
    return facts, write_scratch(left, "nodes"), write_scratch(ways, "way")


def _solved(nodes: DataFrame, way: DataFrame) -> DataFrame:
    """(kind, host, rank) of the nodes, by propagating residuals until no host has more than CHANGE of its rank to pass on."""
    state = nodes.select("kind", "host", F.expr("b / (1 - loop)").alias("rank")).withColumn("rest", F.col("rank"))
    if way.isEmpty():
        return state.select("kind", "host", "rank")
    loops = nodes.select("kind", F.col("host").alias("dst"), F.expr("1 / (1 - loop)").alias("often"))
    way = write_scratch(way.join(loops, ["kind", "dst"]).select("kind", "src", "dst", (F.col("part") * F.col("often")).alias("part")), "way")
    state = write_scratch(state, "ranks")
    due = F.col("rest") > CHANGE * F.col("rank")
    while not state.where(due).isEmpty():
        moved = state.where(due).select("kind", F.col("host").alias("src"), "rest").join(way, ["kind", "src"])
        moved = moved.select("kind", F.col("dst").alias("host"), (F.col("rest") * F.col("part")).alias("rank")).withColumn("rest", F.col("rank"))
        kept = state.withColumn("rest", F.when(due, 0.0).otherwise(F.col("rest")))
        state = write_scratch(kept.unionAll(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("rest").alias("rest")), "ranks")
    return state.select("kind", "host", "rank")


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank): `trust` along the edges and `distrust` against them, from seeds (kind, host, weight).

    Both ranks are one table and go through the same joins, and sum up to 1 each. Scaling them at the end is the same as returning
    to the seeds what reaches a host without edges onward. There is no cap on steps: hosts far from any seed and ranks however
    small are reached as well.
    """
    way = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionAll(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    out = way.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    way = write_scratch(way.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("out") * damping).alias("part")), "way")
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = seeds.join(total, "kind").select("kind", "host", (F.col("weight") / F.col("total") * (1 - damping)).alias("b"))
    every = way.select("kind", F.explode(F.array("src", "dst")).alias("host")).withColumn("b", F.lit(0.0))
    nodes = write_scratch(start.unionAll(every).groupBy("kind", "host").agg(F.sum("b").alias("b")).withColumn("loop", F.lit(0.0)), "nodes")
    layers = []
    for _ in range(LAYERS):
        leaves = write_scratch(single_neighbours(way), "single")
        if leaves.isEmpty():
            break
        facts, nodes, way = _less_leaves(nodes, way, leaves)
        layers.append(facts)
    ranks = write_scratch(_solved(nodes, way), "ranks")
    for facts in reversed(layers):
        # Each layer hangs on the nodes that were left after it.
        near = ranks.select("kind", F.col("host").alias("other"), F.col("rank").alias("near"))
        back = facts.join(near, ["kind", "other"], "left").select("kind", "host", F.expr("(b + inward * coalesce(near, 0)) / (1 - loop)").alias("rank"))
        ranks = write_scratch(ranks.unionAll(back), "ranks")
    whole = ranks.groupBy("kind").agg(F.sum("rank").alias("whole")).where("whole > 0")
    return ranks.where("rank > 0").join(whole, "kind").select("kind", "host", (F.col("rank") / F.col("whole")).alias("rank"))


def judge(pages: DataFrame, rules: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", share: float = SHARE) -> DataFrame:
    """page_id, host, path, rule (null: none fits) and verdict (`allow` or `block`) of every page."""
    given = parts(pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")))
    # Written, so that the pages of a hot host can be split in each of the joins on hosts.
    ruled = write_scratch(matched(given.select("page_id", "host", "path"), rules), "ruled")
    seeds = ruled.where("action IS NOT NULL").groupBy("host", "action").agg(F.count("*").cast("double").alias("weight")).select(
        F.when(F.col("action") == "block", "distrust").otherwise("trust").alias("kind"), "host", "weight"
    )
    ranks = propagated(edges_of(given), seeds)
    amount = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    hosts = ranks.groupBy(F.col("host").alias("_host")).agg(amount("trust").alias("trust"), amount("distrust").alias("distrust"))
    part = F.round(F.try_divide("distrust", F.col("trust") + F.col("distrust")), 6)
    blocked = hosts.where(part > share).select("_host", F.lit(True).alias("blocked"))
    verdict = F.coalesce("action", F.when(F.col("blocked"), "block"), F.lit("allow"))
    return ruled.join(blocked, F.col("host") == F.col("_host"), "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
