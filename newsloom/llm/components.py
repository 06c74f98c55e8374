"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import stored


def connected_components(links: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node that a link names; equal labels, one component.

    Each round every node takes, of itself and its neighbours, the one with the least hash under that round's seed;
    links between the nodes taken are what remains. Connectivity is kept exactly, since the link from a node to the one
    it takes is contracted with it. Random order shrinks paths as fast as stars, so rounds grow with the logarithm of a
    component's size. A node's neighbours are never gathered: the choice is an aggregate, combined before its shuffle.
    Each round is written to the shared folder. Null ends and self links are ignored; no links, no rows.
    """
    kind = links.schema[u].dataType
    pairs = links.select(F.col(u).cast(kind).alias("a"), F.col(v).cast(kind).alias("b")).where("a <> b")
    edges = stored(pairs.distinct(), "links")
    labels = None
    for seed in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64(F.col("b"), F.lit(seed)), F.col("b"))
        own = F.struct(F.xxhash64(F.col("a"), F.lit(seed)), F.col("a"))
        taken = (
            both.groupBy("a")
            .agg(F.min(order).alias("least"))
            .select("a", F.when(own < F.col("least"), F.col("a")).otherwise(F.col("least")["b"]).alias("t"))
        )
        taken = stored(taken, "taken")
        if labels is None:
            labels = taken.select(F.col("a").alias("node"), F.col("t").alias("label"))
        else:
            moved = labels.join(taken, labels["label"] == taken["a"], "left")
            labels = stored(moved.select("node", F.coalesce("t", "label").alias("label")), "labels")
        first = taken.select("a", F.col("t").alias("s"))
        second = taken.select(F.col("a").alias("b"), F.col("t").alias("e"))
        mapped = edges.join(first, "a").join(second, "b").where("s <> e")
        edges = stored(mapped.select(F.least("s", "e").alias("a"), F.greatest("s", "e").alias("b")).distinct(), "links")
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    if labels is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    return labels
