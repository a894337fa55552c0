"""Connected components of a link table by Spark joins, for links that no single task could hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmill.session import checkpointed

MOST_ROUNDS = 60


def stars(nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (key, node): each node with the smallest node of its key (others only), and which rows are the smallest."""
    order = np.lexsort((nodes, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(k) else order
    other = nodes[order] != nodes[head]
    return nodes[order][other], nodes[head][other], order[new]


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every node of ``links`` (a, b), roots included; root is the component's smallest id.

    Each round hands every node its smallest neighbour, ties the others to that one, and halves the way to the root.
    Smallest neighbours are combined before the shuffle and written to the shared folder, so both sides of the joins are
    plain exchanges that adaptive execution may split where many nodes share a root.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    links = checkpointed(links.where("a <> b").select(larger.alias("a"), smaller.alias("b")).distinct())
    for _ in range(MOST_ROUNDS):
        parent = checkpointed(links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        up = parent.select(F.col("a").alias("m"), F.col("m").alias("mm"))
        jumped = parent.join(up, "m", "left").select("a", F.coalesce("mm", "m").alias("b"), F.col("mm").isNotNull().alias("moved"))
        several = parent.where("n > 1").select("a", "m")
        tied = links.join(several, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        links = checkpointed(jumped.unionByName(tied).groupBy("a", "b").agg(F.max("moved").alias("moved")))
        if not links.where("moved").limit(1).count():
            found = links.select(F.col("a").alias("id"), F.col("b").alias("root"))
            return found.unionByName(found.select(F.col("root").alias("id"), "root").distinct())
        links = links.select("a", "b")
    raise RuntimeError("the components did not settle")


def arrow_pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
