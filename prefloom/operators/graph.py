"""Preference and comparison graphs as edge tables, connectivity, components and orderings."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def preference_graph(pairs: DataFrame) -> DataFrame:
    """(src, dst) for each pair i < j of (loser, winner, p): j -> i if P[i, j] < 1/2, else i -> j."""
    p = pairs.where("loser < winner")
    weak = F.col("p") < 0.5
    return p.select(F.when(weak, F.col("winner")).otherwise(F.col("loser")).alias("src"), F.when(weak, F.col("loser")).otherwise(F.col("winner")).alias("dst"))


def comparison_graph(pairs: DataFrame) -> DataFrame:
    """Undirected edges, both ways, of pairs in which both sides win sometimes."""
    v = pairs.where("p <> 0 and loser <> winner")
    g = v.groupBy(F.least("loser", "winner").alias("a"), F.greatest("loser", "winner").alias("b")).agg(F.countDistinct("winner").alias("n")).where("n = 2")
    return g.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")


def menu_graph(menus: DataFrame) -> DataFrame:
    """A clique for each menu (menu_id, item_id), repeated where menus repeat."""
    g = menus.groupBy("menu_id").agg(F.collect_list("item_id").alias("a"))
    return g.select(F.explode("a").alias("src"), "a").select("src", F.explode("a").alias("dst")).where("src <> dst")


def menu_stars(menus: DataFrame) -> DataFrame:
    """An edge (src, dst) from each item of a menu to the menu's least item: the components of ``menu_graph``, by as many edges as items."""
    least = menus.groupBy("menu_id").agg(F.min("item_id").alias("dst"))
    return menus.join(least, "menu_id").select(F.col("item_id").alias("src"), "dst").where("src <> dst").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): least reachable node of each node that has an edge, a loop too; nodes of any type that has an order.

    Alternating large stars (a node's greater neighbours move to its least one) and small stars (the rest do), each a
    partial aggregation and a join, until no edge changes; what is joined is written first, so that a hub's rows can
    be split.
    """
    ends = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("src is not null and dst is not null").distinct())
    e = ends.where("u <> v")
    state = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v"), F.col("u")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            nodes = ends.select(F.col("u").alias("node")).union(ends.select("v")).distinct()
            return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        state = now
    raise RuntimeError("components did not settle")


def menu_components(menus: DataFrame) -> DataFrame:
    """(component, items): sorted items of each connected component; items of lone menus only do not appear."""
    c = components(menu_stars(menus))
    return c.groupBy(F.col("root").alias("component")).agg(F.sort_array(F.collect_list("node")).alias("items"))


def connected(edges: DataFrame, nodes: Iterable[int] | None = None) -> bool:
    """Is every node reachable from every other in the undirected graph?"""
    c = components(edges)
    n_roots, n_nodes = c.agg(F.countDistinct("root"), F.count("*")).first()
    if nodes is None:
        return n_roots <= 1
    n = len(set(nodes))
    return n <= 1 or (n_roots == 1 and n_nodes == n)


def topological_order(edges: DataFrame, strength: np.ndarray) -> list[int]:
    """Reversed depth-first post-order over the item graph, roots in order of falling strength; cycles are walked once."""
    out: dict[int, list[int]] = {}
    for r in edges.select("src", "dst").distinct().orderBy("src", "dst").collect():  # at most items x items
        out.setdefault(r.src, []).append(r.dst)
    seen: set[int] = set()
    post: list[int] = []
    for root in np.argsort(-np.asarray(strength), kind="stable").tolist():
        stack = [(root, iter(out.get(root, ())))] if root not in seen else []
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            nxt = next((x for x in rest if x not in seen), None)
            if nxt is None:
                post.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(out.get(nxt, ()))))
    return post[::-1]
