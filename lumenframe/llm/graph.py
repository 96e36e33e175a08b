"""Connected components by rounds of joins, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


#: Nodes of very many edges are joined by broadcast; there are at most twice as many of them, 16 bytes each.
HEAVY = 20_000
#: Rows of a heavy key at least.
LEAST_ROWS = 1024


def _with_least(edges: DataFrame, low: DataFrame, size: int) -> DataFrame:
    """edges (u, v) with their node's m of low (u, m, n).

    A node with at least its share of all edges, one in ``HEAVY``, is heavy: there can be no more than twice ``HEAVY`` of them, so they may be broadcast and
    their edges stay where they are.  The others' edges meet by node.
    """
    least = max(LEAST_ROWS, 2 * size // HEAVY)
    heavy = low.where(F.col("n") >= least).select("u", "m")
    marked = edges.join(F.broadcast(heavy), "u", "left")
    rest = marked.where("m IS NULL").select("u", "v").join(low.where(F.col("n") < least).select("u", "m"), "u")
    return marked.where("m IS NOT NULL").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) of every node on an edge (a, b) of longs; the component is its smallest node.

    Alternates the two star operations: each node hands its larger neighbours to its smallest one, then its
    smaller ones.  Only minima by node are gathered.  Rounds are written to the shared folder, each takes the place of the one before; they end when no
    edge changes, after a number of rounds that grows with the logarithm of the nodes.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "cc")
    mark = None
    count = lambda: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = count()
    for _ in range(max_rounds):
        mark = now
        # large star: of all neighbours and itself, the smallest takes the larger ones
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_least(both.where("v > u"), low, 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "cc-large")
        # small star: of the smaller neighbours the smallest takes the others and the node
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, low, mark[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, e = e, written(small, "cc")
        discard(last, large)
        now = count()
        if mark == now:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
