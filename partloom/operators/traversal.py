"""Traversal of boundary representations kept as incidence tables: ancestors and descendants, ordered wires."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("solid", "shell", "face", "wire", "edge", "vertex")


def shape(kind: str, id_) -> F.Column:
    """The name of a shape in incidence tables, `kind:id`."""
    return F.concat(F.lit(f"{kind}:"), id_.cast("string"))


def kind_of(name: str) -> F.Column:
    return F.substring_index(F.col(name), ":", 1)


LEVELS = 16  # of a hierarchy that are walked link by link


def closure(links: DataFrame, cut, group: str = "model_id") -> DataFrame:
    """All `(group, top, bottom, depth)` of which `bottom` is reached from `top` along links (group, parent, child); depth is
    the shortest way. A round puts a link above the ways that the round before has found, so that a way is made from the
    few shapes right below its top, and not at every shape on it; what many edges lead to, such as a vertex of a wire, is
    one way from there on. Hierarchies end within LEVELS rounds. Longer chains and links that lead back (no tree has
    them) go on by doubling: a round joins the ways found with themselves at their meeting shape. A way to itself is
    left out."""
    links = cut(links.select(group, F.col("parent").alias("top"), F.col("child").alias("bottom")).where("top <> bottom").distinct())
    above = links.select(group, "top", F.col("bottom").alias("via"))
    found = [links.withColumn("depth", F.lit(1))]
    least = lambda ways: ways.groupBy(group, "top", "bottom").agg(F.min("depth").alias("depth"))
    while True:
        below = found[-1].select(group, F.col("top").alias("via"), "bottom")
        if len(found) > 1:  # from here on the tops are few, and so are the links above them
            above = cut(above.join(cut(below.select(group, "via").distinct()), [group, "via"], "left_semi"))
        new = cut(above.join(below, [group, "via"]).where("top <> bottom").select(group, "top", "bottom").distinct().withColumn("depth", F.lit(len(found) + 1)))
        if new.isEmpty():
            break
        found.append(new)
        if len(found) == LEVELS:
            break
    ways = found[0]
    for more in found[1:]:
        ways = ways.union(more)
    ways = cut(least(ways))
    if len(found) < LEVELS:
        return ways
    size = -1
    while (n := ways.count()) != size:
        size = n
        down = ways.select(group, F.col("top").alias("bottom"), F.col("bottom").alias("far"), F.col("depth").alias("more"))
        longer = ways.join(down, [group, "bottom"]).where("top <> far").select(group, "top", F.col("far").alias("bottom"), (F.col("depth") + F.col("more")).alias("depth"))
        ways = cut(least(ways.union(longer)))
    return ways


def within(ways: DataFrame, top: str, bottom: str) -> DataFrame:
    """The `bottom` shapes of every `top` shape (kinds), e.g. the edges of a solid or, read from right to left, the faces
    of a vertex."""
    return ways.where((kind_of("top") == top) & (kind_of("bottom") == bottom))


def shape_counts(ways: DataFrame, group: str = "model_id") -> DataFrame:
    """`(group, top_kind, bottom_kind, ways, tops, bottoms)`: how many pairs and how many different shapes on either side."""
    return ways.groupBy(group, kind_of("top").alias("top_kind"), kind_of("bottom").alias("bottom_kind")).agg(
        F.count("*").alias("ways"), F.countDistinct("top").alias("tops"), F.countDistinct("bottom").alias("bottoms")
    )


def ordered_wires(edges: DataFrame, cut, group: str = "model_id") -> DataFrame:
    """Edges of wires in the order in which they are walked: `(group, wire, edge, start, end, place)`, places from 0.

    edges: group, wire, edge, start, end (oriented: an edge is followed by the one that starts where it ends). An open
    wire begins at the edge that follows none, a closed one at its smallest edge; of several edges at one vertex the
    smallest follows; edges that the walk does not reach have no place. Places come from list ranking: every edge
    knows how far it is from the one it points to, and points twice as far in each round, so that a wire of n edges
    takes log2(n) rounds and no wire is gathered."""
    key = [group, "wire"]
    e = cut(edges.select(*key, "edge", "start", "end").distinct())
    first = e.groupBy(*key, F.col("start").alias("end")).agg(F.min("edge").alias("next"))
    chain = e.join(first, [*key, "end"], "left")
    before = chain.where("next is not null").groupBy(*key, F.col("next").alias("edge")).agg(F.min("edge").alias("prev"))
    chain = cut(chain.join(before, [*key, "edge"], "left"))
    # of two edges that lead to one only the smaller does; a walk starts where nothing leads to, else at the smallest edge
    heads = chain.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("prev").isNull(), F.col("edge"))), F.min("edge")).alias("head"))
    # pointers run towards the head, which ends the list
    rows = chain.join(heads, key).select(*key, "edge", "head", F.when(F.col("edge") == F.col("head"), None).otherwise(F.col("prev")).alias("to"))
    rows = cut(rows.withColumn("place", F.when(F.col("to").isNull(), 0).otherwise(1)).withColumn("last", F.coalesce("to", "edge")))
    n = e.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < n:
        via = rows.select(*key, F.col("edge").alias("last"), F.col("place").alias("more"), F.col("last").alias("further"))
        rows = cut(rows.join(via, [*key, "last"]).select(*key, "edge", "head", F.col("further").alias("last"), (F.col("place") + F.col("more")).alias("place")))
        reach *= 2
    place = rows.select(*key, "edge", F.when(F.col("last") == F.col("head"), F.col("place")).alias("place"))
    return e.join(place, [*key, "edge"])
