"""Connected components and leader clustering over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import apart, cut, few_files, release


def connected_components(
    edges: DataFrame, a: str = "a", b: str = "b", node: str = "node", comp: str = "comp", rows: int | None = None
) -> DataFrame:
    """(node, comp) for each node of an edge: comp is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows the pointers to their roots by
    doubling, and contracts the edges to edges between roots. Stars vanish in one round; long chains
    shrink at least by half. The nodes follow the rounds' pointers once, at the end. Null ends are ignored;
    a loop is a node without a neighbour. `rows`: the number of edges, or a bound on it, if the caller knows it.
    """
    ends = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    first = cut(few_files(ends.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), rows))
    live, rounds = first.filter("a <> b"), []
    while edges_left := live.count():
        most = 2 * edges_left  # nodes
        both = live.union(live.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("up")).select(F.col("a").alias("u"), F.least("a", "up").alias("root"))
        hooks = _to_roots(cut(few_files(hooks, most)), most)
        ends = apart(hooks.select(F.col("u").alias("a"), F.col("root").alias("ra")), most)
        after = live.join(ends, "a").join(ends.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
        after = after.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        after = cut(few_files(after, edges_left))
        release(live)
        live = after
        rounds.append((hooks, most))
    labels = first.select(F.explode(F.array("a", "b")).alias(node)).distinct().withColumn(comp, F.col(node))
    for hooks, most in rounds:
        known = apart(hooks.select(F.col("u").alias(comp), F.col("root").alias("__root")), most)
        labels = labels.join(known, comp, "left").select(node, F.coalesce("__root", comp).alias(comp))
    labels = cut(few_files(labels, 2 * first.count()))
    release(first, live, *[hooks for hooks, _ in rounds])
    return labels


def _to_roots(hooks: DataFrame, rows: int) -> DataFrame:
    """Pointers (u, root), `rows` at most, followed two steps at a time until every one ends at a root. A root points to itself or isn't listed."""
    while True:
        up = lambda at, to: apart(hooks.select(F.col("u").alias(at), F.col("root").alias(to)), rows)
        jumped = hooks.join(up("root", "next"), "root", "left").withColumn("next", F.coalesce("next", "root"))
        jumped = jumped.join(up("next", "last"), "next", "left")
        to = F.coalesce("last", "next")
        jumped = cut(few_files(jumped.select("u", to.alias("root"), (to != F.col("root")).alias("moved")), rows))
        release(hooks)
        hooks = jumped
        if not jumped.filter("moved").take(1):
            return hooks


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(u, comp) for all nodes, those without a link too."""
    found = connected_components(links, "u1", "u2", "u", "comp")
    return nodes.select("u").join(apart(found, found.count()), "u", "left").select("u", F.coalesce("comp", "u").alias("comp"))


def merged_components(*parts: DataFrame) -> DataFrame:
    """(u, comp) of the closure of several (u, comp) tables over the same nodes."""
    edges, nodes = None, None
    for part in parts:
        own = part.select(F.col("u").alias("u1"), F.col("comp").alias("u2"))
        edges = own if edges is None else edges.union(own)
        nodes = part.select("u") if nodes is None else nodes.union(part.select("u"))
    return components(nodes.distinct(), edges)


def leader_clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(u, leader) for all nodes (u, ord_key); links must hold every linked pair of a component.

    In order of (ord_key, u), a free node becomes a leader and takes the free nodes linked to it. That is
    the lexicographically first maximal independent set: in rounds, nodes without an undecided smaller
    neighbour become leaders and their neighbours members, until none is undecided; a member then
    belongs to its smallest linked leader.
    """
    order = lambda side: nodes.select(F.col("u").alias(side), F.struct("ord_key", "u").alias(f"o_{side}"))
    both = links.join(order("u1"), "u1").join(order("u2"), "u2")
    edges = cut(both.select(F.least("o_u1", "o_u2").alias("low"), F.greatest("o_u1", "o_u2").alias("high")))
    live, decided = edges, []
    while live.take(1):
        tops = live.select(F.col("low").alias("o")).distinct().join(live.select(F.col("high").alias("o")).distinct(), "o", "left_anti")
        tops = cut(tops)
        decided.append(tops)
        taken = live.join(tops.withColumnRenamed("o", "low"), "low", "left_semi").select(F.col("high").alias("o"))
        gone = cut(tops.union(taken).distinct())
        rest = live.join(gone.withColumnRenamed("o", "low"), "low", "left_anti")
        # a node may lose all its edges while undecided: its smaller neighbours became members, so it leads
        after = cut(rest.join(gone.withColumnRenamed("o", "high"), "high", "left_anti"))
        ends = live.select(F.explode(F.array("low", "high")).alias("o")).distinct()
        left = after.select(F.explode(F.array("low", "high")).alias("o")).distinct()
        decided.append(cut(ends.join(gone, "o", "left_anti").join(left, "o", "left_anti")))
        if live is not edges:
            release(live)
        release(gone)
        live = after
    if not decided:
        return nodes.select("u", F.col("u").alias("leader"))
    leaders = decided[0]
    for more in decided[1:]:
        leaders = leaders.union(more)
    leaders = cut(leaders)
    release(live, *decided)
    taken = edges.join(leaders.withColumnRenamed("o", "low"), "low").join(leaders.withColumnRenamed("o", "high"), "high", "left_anti")
    owned = taken.groupBy(F.col("high.u").alias("u")).agg(F.min("low").alias("leader"))
    return nodes.select("u").join(owned, "u", "left").select("u", F.coalesce("leader.u", "u").alias("leader"))
