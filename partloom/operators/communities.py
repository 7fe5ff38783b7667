"""Louvain communities of many graphs at once: rounds of local moves, then contraction to weighted nodes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_GAIN = 1e-7  # of modularity, below which a graph counts as settled
GROUPS = 100_000  # whose rows are sent to every task
WHOLE = 2_000_000  # nodes and links in both directions of a graph, up to which one task holds it


def per_group(nodes: DataFrame, group: str):
    """What to do with a table of one row a group before a join on the group: while the groups of `nodes` are few it goes
    to every task, so that the nodes of a large graph stay dealt. Joins on nodes carry a hint to merge, as Spark would
    send them by way of the driver in each round while their files are small."""
    return F.broadcast if nodes.select(group).distinct().limit(GROUPS + 1).count() <= GROUPS else lambda rows: rows


def both_ways(edges: DataFrame, group: str = "cloud", weight: str | None = None) -> DataFrame:
    """Edges `(group, a, b, w)` in both directions, repeated ones summed, loops once."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select(group, "a", "b", w.alias("w"))
    turned = e.where("a <> b").select(group, F.col("b").alias("a"), F.col("a").alias("b"), "w")
    return e.union(turned).groupBy(group, "a", "b").agg(F.sum("w").alias("w"))


def weighted_nodes(nodes: DataFrame, links: DataFrame, group: str = "cloud") -> DataFrame:
    """Nodes `(group, node, k, loop, m2)`: degree (a loop counts twice), twice the loop's weight, twice the graph's weight."""
    degree = links.groupBy(group, F.col("a").alias("node")).agg(
        F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w"))).alias("k"), F.sum(F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(0.0)).alias("loop")
    )
    each = per_group(nodes, group)
    m2 = degree.groupBy(group).agg(F.sum("k").alias("m2"))
    out = nodes.select(group, F.col("node")).distinct().join(degree.hint("merge"), [group, "node"], "left").join(each(m2), group, "left")
    return out.select(group, "node", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("k", "loop", "m2")))


def best_moves(state: DataFrame, links: DataFrame, resolution: float = 1.0, group: str = "cloud") -> DataFrame:
    """`state` (group, node, k, m2, community, ...) with the best neighbouring community `to`, the modularity `gain` of
    moving there alone (0 where the own one is as good; ties to the smallest community), and the sizes of both.

    A candidate is a community that a neighbour is in; how strongly a node hangs on each is a combinable sum over its
    edges, so a hub costs one row for each community around it."""
    at = state.select(group, F.col("node").alias("b"), F.col("community").alias("to"))
    hang = links.where("a <> b").join(at.hint("merge"), [group, "b"]).select(group, F.col("a").alias("node"), "to", "w")
    own = state.select(group, "node", F.col("community").alias("to"), F.lit(0.0).alias("w"))
    hang = hang.union(own).groupBy(group, "node", "to").agg(F.sum("w").alias("w"))
    total = state.groupBy(group, F.col("community").alias("to")).agg(F.sum("k").alias("total"), F.count("*").alias("size"))
    rows = state.select(group, "node", "k", "m2", "community").join(hang.hint("merge"), [group, "node"]).join(total.hint("merge"), [group, "to"])
    here = F.col("to") == F.col("community")
    score = F.when(F.col("m2") > 0, F.col("w") - resolution * F.col("k") * (F.col("total") - F.when(here, F.col("k")).otherwise(0.0)) / F.col("m2")).otherwise(0.0)
    best = rows.withColumn("score", score).groupBy(group, "node").agg(
        F.max(F.struct("score", (-F.col("to")).alias("low"), "size")).alias("best"), F.max(F.when(here, F.struct("score", "size"))).alias("own")
    )
    gain = F.when(F.col("m2") > 0, 2 * (F.col("best.score") - F.col("own.score")) / F.col("m2")).otherwise(0.0)
    out = state.join(best.hint("merge"), [group, "node"])
    better = gain > 1e-12
    return out.select(
        *state.columns, F.when(better, -F.col("best.low")).otherwise(F.col("community")).alias("to"), F.when(better, gain).otherwise(0.0).alias("gain"),
        F.col("own.size").alias("own_size"), F.when(better, F.col("best.size")).otherwise(F.col("own.size")).alias("to_size"),
    )


def modularity(state: DataFrame, links: DataFrame, resolution: float = 1.0, group: str = "cloud", community: str = "community") -> DataFrame:
    """`(group, q)` of graphs with edges."""
    c = F.col(community)
    a, b = (state.select(group, F.col("node").alias(s), c.alias(f"c_{s}")) for s in "ab")
    inside = links.where("a <> b").join(a.hint("merge"), [group, "a"]).join(b.hint("merge"), [group, "b"]).where("c_a = c_b").groupBy(group, F.col("c_a").alias("c")).agg(F.sum("w").alias("inside"))
    parts = state.groupBy(group, c.alias("c"), "m2").agg(F.sum("k").alias("total"), F.sum("loop").alias("loops")).where("m2 > 0").join(inside.hint("merge"), [group, "c"], "left")
    share = (F.coalesce("inside", F.lit(0.0)) + F.col("loops")) / F.col("m2") - resolution * F.pow(F.col("total") / F.col("m2"), F.lit(2.0))
    return parts.groupBy(group).agg(F.sum(share).alias("q"))


def local_moves(state: DataFrame, links: DataFrame, cut, resolution: float = 1.0, group: str = "cloud") -> tuple[DataFrame, bool]:
    """Moves single nodes until no graph gains `LEAST_GAIN` any more: (state, whether anything moved).

    A round computes every node's best move. First, half of the nodes (by a digest of node and round) take theirs at
    once; a node that is alone moves to another lonely one only if that has the smaller id, or the two would trade
    places for ever. Graphs whose modularity does not grow by this, as moves made together may spoil each other, take
    instead the moves that are the best of both communities they touch: these touch different communities, so their
    gains add up exactly. Each round thus gains in every graph that is not settled, and no partition comes twice. Three values of a round reach
    the driver: whether any graph is open and whether any node moved.
    """
    sides = lambda p: F.explode(F.array(F.col("community"), F.col("to")))
    q, each = modularity(state, links, resolution, group), per_group(state, group)
    state = cut(state.join(each(q), group, "left").withColumn("open", F.col("q").isNotNull()))
    moved, number = False, 0
    columns = [c for c in state.columns if c != "open"]
    while True:
        number += 1
        active = state.where("open")
        prop = cut(best_moves(active.select(*columns), links, resolution, group))
        wanted = prop.where("gain > 0")
        top = wanted.select(group, "node", "gain", sides(wanted).alias("c")).groupBy(group, "c").agg(F.max(F.struct("gain", (-F.col("node")).alias("low"))).alias("top")).select(group, "c", (-F.col("top.low")).alias("first"))
        alone = wanted.join(top.select(group, F.col("c").alias("community"), F.col("first").alias("f1")).hint("merge"), [group, "community"]).join(top.select(group, F.col("c").alias("to"), F.col("first").alias("f2")).hint("merge"), [group, "to"])
        alone = alone.where("f1 = node and f2 = node").select(group, "node", F.lit(True).alias("alone"))
        lonely = (F.col("own_size") == 1) & (F.col("to_size") == 1) & (F.col("to") > F.col("community"))
        go = (F.pmod(F.xxhash64(F.col("node").cast("long"), F.lit(number)), F.lit(2)) == 0) & ~lonely & (F.col("gain") > 0)
        tried = cut(prop.join(alone.hint("merge"), [group, "node"], "left").withColumn("many", F.when(go, F.col("to")).otherwise(F.col("community"))))
        after = modularity(tried, links, resolution, group, "many").withColumnRenamed("q", "q_many")
        single = tried.groupBy(group).agg(F.sum(F.when(F.col("alone"), F.col("gain")).otherwise(0.0)).alias("one"))
        verdict = tried.select(group, "q").distinct().join(each(after), group).join(each(single), group)
        verdict = verdict.select(group, (F.col("q_many") >= F.col("q") + LEAST_GAIN).alias("take"), "q_many", "one")
        step = F.when(F.col("take"), F.col("many")).when(F.coalesce("alone", F.lit(False)) & (F.col("one") >= LEAST_GAIN), F.col("to")).otherwise(F.col("community"))
        new_q = F.when(F.col("take"), F.col("q_many")).otherwise(F.col("q") + F.when(F.col("one") >= LEAST_GAIN, F.col("one")).otherwise(0.0))
        went = tried.join(each(verdict), group).select(
            *(step.alias("community") if c == "community" else new_q.alias("q") if c == "q" else F.col(c) for c in columns), (F.col("take") | (F.col("one") >= LEAST_GAIN)).alias("open"),
        )
        state = cut(went.select(*columns, "open").union(state.where("not open").select(*columns, "open")))
        if state.where("open").isEmpty():
            return state.select(*(c for c in columns if c != "q")), moved
        moved = True


def contracted(state: DataFrame, links: DataFrame, group: str = "cloud") -> tuple[DataFrame, DataFrame]:
    """Communities as nodes, and the edges between them: (nodes with `node, k, loop, m2`, links)."""
    a, b = (state.select(group, F.col("node").alias(s), F.col("community").alias(f"c_{s}")) for s in "ab")
    between = links.where("a <> b").join(a.hint("merge"), [group, "a"]).join(b.hint("merge"), [group, "b"]).groupBy(group, F.col("c_a").alias("a"), F.col("c_b").alias("b")).agg(F.sum("w").alias("w"))
    within = between.where("a = b").select(group, F.col("a").alias("community"), F.col("w").alias("inner"))
    nodes = state.groupBy(group, "community", "m2").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop")).join(within.hint("merge"), [group, "community"], "left")
    nodes = nodes.select(group, F.col("community").alias("node"), "k", (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop"), "m2")
    return nodes, between.where("a <> b")


def _odd_digests(nodes: np.ndarray, number: int) -> np.ndarray:
    """Whether Spark's xxhash64(node, number) of a long and an int is odd."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def mixed(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = mixed(turn((np.uint64(42) + p5 + np.uint64(8)) ^ (turn(nodes.astype(np.uint64) * p2, 31) * p1), 27) * p1 + p4)
        return mixed(turn((h + p5 + np.uint64(4)) ^ (np.uint64(number) * p1), 23) * p2 + p3) & np.uint64(1) == 1


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of `w` by (a, b), in that order; both are below n."""
    key = a * n + b
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return key[first] // n, key[first] % n, np.add.reduceat(w[order], first) if len(key) else w


def _graph_moves(g: dict, com: np.ndarray, resolution: float) -> tuple[np.ndarray, bool]:
    """`local_moves` of one graph: its nodes (ids in order, k, loop), links without loops (a, b, w), m2; nodes, links and
    communities by place."""
    ids, k, a, b, w, m2 = g["ids"], g["k"], g["a"], g["b"], g["w"], g["m2"]
    n, moved, number = len(ids), False, 0
    if not m2 > 0:
        return com, False
    every = np.arange(n)

    def quality(c):
        inside = np.bincount(c[a], np.where(c[a] == c[b], w, 0.0), n)
        return float(np.sum((inside + np.bincount(c, g["loop"], n)) / m2 - resolution * (np.bincount(c, k, n) / m2) ** 2))

    q = quality(com)
    while True:
        number += 1
        node, to, hang = _summed(np.r_[a, every], np.r_[com[b], com], np.r_[w, np.zeros(n)], n)
        total, size = np.bincount(com, k, n), np.bincount(com, minlength=n)
        here = to == com[node]
        score = hang - resolution * k[node] * (total[to] - np.where(here, k[node], 0.0)) / m2
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        best = np.maximum.reduceat(score, start)
        tops = np.flatnonzero(score == best[node])
        tops = tops[np.r_[True, node[tops][1:] != node[tops][:-1]]]
        gain = 2 * (best - score[here]) / m2
        better = gain > 1e-12
        to, gain = np.where(better, to[tops], com), np.where(better, gain, 0.0)

        some = np.flatnonzero(better)
        side, who = np.r_[com[some], to[some]], np.r_[some, some]
        order = np.lexsort((who, -gain[who], side))
        lead = order[np.r_[True, side[order][1:] != side[order][:-1]]] if len(order) else order
        first = np.full(n, -1)
        first[side[lead]] = who[lead]
        alone = better & (first[com] == every) & (first[to] == every)
        lonely = (size[com] == 1) & (size[to] == 1) & (to > com)
        many = np.where(better & ~lonely & ~_odd_digests(ids, number), to, com)
        after, one = quality(many), float(gain[alone].sum())
        if after >= q + LEAST_GAIN:
            com, q = many, after
        elif one >= LEAST_GAIN:
            com, q = np.where(alone, to, com), q + one
        else:
            return com, moved
        moved = True


def _graph_contracted(g: dict, com: np.ndarray) -> tuple[dict, np.ndarray]:
    """`contracted` of one graph, and every node's place among the communities."""
    names, at = np.unique(com, return_inverse=True)
    n = len(names)
    a, b, w = _summed(at[g["a"]], at[g["b"]], g["w"], n)
    loop = np.bincount(at, g["loop"], n) + np.bincount(a, np.where(a == b, w, 0.0), n)
    out = a != b
    return {"ids": g["ids"][names], "k": np.bincount(at, g["k"], n), "loop": loop, "a": a[out], "b": b[out], "w": w[out], "m2": g["m2"]}, at


def _graph_levels(g: dict, resolution: float) -> np.ndarray:
    """The levels above: of each node the place of the node that names its community in the end."""
    of, level = np.arange(len(g["ids"])), g
    while True:
        com, changed = _graph_moves(level, np.arange(len(level["ids"])), resolution)
        if not changed:
            return np.searchsorted(g["ids"], level["ids"])[of]
        level, at = _graph_contracted(level, com)
        of = at[of]


def _graph_of(pdf: pd.DataFrame) -> dict:
    """The graph of rows (a, b, w, k, loop, m2): nodes have no b, links have no k. Links of nodes that are not listed are left out."""
    is_node = pdf["b"].isna().to_numpy()
    nodes, links = pdf[is_node].sort_values("a"), pdf[~is_node]
    ids, a, b = nodes["a"].to_numpy(np.int64), links["a"].to_numpy(np.int64), links["b"].to_numpy(np.int64)
    kept = (a != b) & np.isin(a, ids) & np.isin(b, ids)
    k, loop = nodes["k"].to_numpy(float), nodes["loop"].to_numpy(float)
    return {"ids": ids, "k": k, "loop": loop, "a": np.searchsorted(ids, a[kept]), "b": np.searchsorted(ids, b[kept]), "w": links["w"].to_numpy(float)[kept], "m2": float(nodes["m2"].iat[0]) if len(ids) else 0.0}


def _graph_louvain(g: dict, resolution: float) -> np.ndarray:
    """`louvain` of one graph."""
    com, moved = _graph_moves(g, np.arange(len(g["ids"])), resolution)
    while moved:
        level, at = _graph_contracted(g, com)
        of = np.searchsorted(g["ids"], level["ids"])[_graph_levels(level, resolution)]
        com, moved = _graph_moves(g, of[at], resolution)
    return com


def _in_tasks(nodes: DataFrame, links: DataFrame, solve, resolution: float, group: str) -> DataFrame:
    """`(group, node, community)` by `solve` of every graph of `nodes` (group, node, k, loop, m2), each in one task."""
    kind = nodes.schema[group].dataType.simpleString()
    none = F.lit(None)
    rows = nodes.select(group, F.col("node").cast("long").alias("a"), none.cast("long").alias("b"), none.cast("double").alias("w"), "k", "loop", "m2")
    rows = rows.union(links.select(group, F.col("a").cast("long"), F.col("b").cast("long"), "w", *(none.cast("double") for _ in range(3))))

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        g = _graph_of(pdf)
        return pd.DataFrame({group: [pdf[group].iat[0]] * len(g["ids"]), "node": g["ids"], "community": g["ids"][solve(g, resolution)]})

    return rows.groupBy(group).applyInPandas(solved, f"`{group}` {kind}, node long, community long")


def _large(nodes: DataFrame, links: DataFrame, group: str, whole: int) -> DataFrame:
    """Groups of more than `whole` nodes and links."""
    return nodes.select(group).union(links.select(group)).groupBy(group).count().where(F.col("count") > whole).select(group)


def louvain(edges: DataFrame, nodes: DataFrame, cut, *, resolution: float = 1.0, weight: str | None = None, group: str = "cloud", whole: int = WHOLE) -> DataFrame:
    """Communities `(group, node, community)` of undirected graphs: edges (group, a, b), nodes (group, node), whole
    numbers as node ids; a community is named by its smallest node.

    Local moves from single nodes, contraction of the communities to nodes, local moves of these, and so on until a
    level changes nothing; then the nodes may move once more on their own, and if any does, the levels are built anew.
    Nodes without an edge are communities of their own. Where several moves gain the same, the smallest community is taken.

    A graph of up to `whole` nodes and links is solved in one task, by the same rules in arrays. Larger graphs are not
    gathered: a round is a few joins and sums over all their edges, until a level is small enough for a task.
    """
    links = cut(both_ways(edges, group, weight))
    base = cut(weighted_nodes(nodes, links, group).where(F.col(group).isNotNull()))
    big = cut(_large(base, links, group, whole))
    if big.isEmpty():
        return _named(cut(_in_tasks(base, links.where(F.col(group).isNotNull()), _graph_louvain, resolution, group)), group)
    only = lambda rows, how: rows.join(F.broadcast(big), group, how)
    small = cut(_in_tasks(only(base, "left_anti"), only(links.where(F.col(group).isNotNull()), "left_anti"), _graph_louvain, resolution, group))
    links, base = cut(only(links, "left_semi")), cut(only(base, "left_semi"))
    state, moved = local_moves(base.withColumn("community", F.col("node")), links, cut, resolution, group)
    while moved:
        of, done = state.select(group, "node", "community"), None
        level_nodes, level_links = contracted(state, links, group)
        while True:
            level_nodes, level_links = cut(level_nodes), cut(level_links)
            still = cut(_large(level_nodes, level_links, group, whole))
            level = _in_tasks(level_nodes.join(still, group, "left_anti"), level_links.join(still, group, "left_anti"), _graph_levels, resolution, group)
            up = level.select(group, F.col("node").alias("community"), F.col("community").alias("upper"))
            settled = cut(of.join(still, group, "left_anti").join(up.hint("merge"), [group, "community"]).select(group, "node", F.col("upper").alias("community")))
            done = settled if done is None else done.union(settled)
            of = cut(of.join(still, group, "left_semi"))
            if still.isEmpty():
                break
            level_nodes, level_links = level_nodes.join(still, group, "left_semi"), level_links.join(still, group, "left_semi")
            level, changed = local_moves(level_nodes.withColumn("community", F.col("node")), level_links, cut, resolution, group)
            if not changed:
                done = done.union(of)
                break
            up = level.select(group, F.col("node").alias("community"), F.col("community").alias("upper"))
            of = cut(of.join(up.hint("merge"), [group, "community"]).select(group, "node", F.col("upper").alias("community")))
            level_nodes, level_links = contracted(level, level_links, group)
        state, moved = local_moves(base.join(done.hint("merge"), [group, "node"]), links, cut, resolution, group)
    return _named(small.union(state.select(group, F.col("node").cast("long"), F.col("community").cast("long"))), group)


def _named(of: DataFrame, group: str) -> DataFrame:
    """Communities by their smallest node."""
    low = of.groupBy(group, "community").agg(F.min("node").alias("low"))
    return of.join(low.hint("merge"), [group, "community"]).select(group, "node", F.col("low").alias("community"))
