"""Connected components by randomised contraction.

Every round moves each node to the neighbour (or itself) of least random priority and renames the
edges accordingly; edges inside a node vanish and parallel ones merge, so an expected constant
share of the nodes is gone after each round, whatever the shape of the graph.  A round costs two
equi-joins and aggregations with map-side combination; no node's neighbours are ever gathered.
Where the caller allows it, rounds end as soon as the edges left are few enough for the driver to hold:
each round is several jobs with plans of their own, which take more of the driver's memory than such a rest.
The renamings are then composed from the last round back to the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def collected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b) that the driver can hold; there is at least one, and no loop."""
    found = edges.toArrow()
    node, ends = np.unique(np.concatenate([found["a"].to_numpy(), found["b"].to_numpy()]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(node))
    while (root[a] != root[b]).any():
        # The greater root goes below the least one that an edge joins it with; then paths are halved to the end.
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    return edges.sparkSession.createDataFrame(pa.table({"node": node, "root": node[root]}))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_collected: int = 0) -> DataFrame:
    """(node, root) for every node that an edge between two different nodes touches.

    ``root`` is one of the component's nodes and the same for all of them.  Null ends, loops and
    repeated edges are ignored.  At most ``most_collected`` edges between 64-bit numbers, all or those left after
    some rounds, go to the driver.
    """
    spark = edges.sparkSession
    live = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    renamed: list[DataFrame] = []
    while (left := live.count()) > most_collected:
        salt = F.lit(len(renamed))
        end = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
        both = live.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e")).select("e.a", "e.b")
        rank = lambda c: F.struct(F.xxhash64(salt, F.col(c)).alias("p"), F.col(c).alias("v"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
        to = F.when(rank("node") < F.col("m"), F.col("node")).otherwise(F.col("m.v"))
        step = cut(least.select("node", to.alias("to")))
        renamed.append(step)
        first = live.join(step.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a").select("ra", "b")
        second = first.join(step.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        live = cut(second.filter("a <> b").distinct())
    if left:
        renamed.append(collected_components(live))
    if not renamed:
        return spark.createDataFrame([], live.select(F.col("a").alias("node"), F.col("a").alias("root")).schema)
    out = renamed.pop() if left else renamed.pop().select("node", F.col("to").alias("root"))
    for step in reversed(renamed):
        later = out.select(F.col("node").alias("to"), F.col("root").alias("later"))
        out = step.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("root"))
    return out
