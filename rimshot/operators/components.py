"""Connected components of a graph that is given as a table of edges, for each group on its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimshot.session import checkpoint_dir

FEW_NODES = 200_000  # so many labels are sent to every task; more are joined by an exchange


def with_label(df: DataFrame, labels: DataFrame, keys: list[str], node: str, of: str, out: str, how: str = "inner",
               few: bool | None = None) -> DataFrame:
    """``df`` with the label of the node in its column ``node`` from ``labels`` (keys, ``of``, ``out``), a stored frame.

    Labels are sent to every task if they are ``few``, by default by their count; otherwise both sides are dealt out by
    the node."""
    names = [f"_of_{k}" for k in keys]
    side = labels.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(of).alias("_of"), F.col(out))
    if few if few is not None else labels.count() <= FEW_NODES:
        side = F.broadcast(side)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return df.join(side, reduce(lambda x, y: x & y, same, F.col(node) == F.col("_of")), how).select(*[df[c] for c in df.columns], out)


def connected(edges: DataFrame, keys: list[str], a: str, b: str, out: str = "component") -> DataFrame:
    """(keys, ``a``, ``out``): every node with the smallest node that it is joined to by edges of its group.

    Each round gives a node the least label among itself and its neighbours (a grouped min, reduced before the exchange)
    and then the label which that node has itself, so labels travel twice as far in each round. It ends when the labels
    of all edges' ends agree, which is all that the driver learns. Edges with a null end join nothing. Labels are stored
    after every round."""
    checkpoint_dir(edges.sparkSession)
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ends = F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("other")), F.struct(F.col(b).alias("node"), F.col(a).alias("other")))
    both = known.select(*keys, F.inline(ends)).distinct().checkpoint()
    labels = both.groupBy(*keys, "node").agg(F.least("node", F.min("other")).alias("label")).checkpoint()
    few = labels.count() <= FEW_NODES  # the rounds change labels, not nodes
    while True:
        near = with_label(both, labels.withColumnRenamed("label", "near"), keys, "other", "node", "near", few=few)
        near = with_label(near, labels.withColumnRenamed("label", "old"), keys, "node", "node", "old", few=few)
        if near.where("near < old").isEmpty():
            return labels.select(*keys, F.col("node").alias(a), F.col("label").alias(out))
        step = near.groupBy(*keys, "node").agg(F.least(F.min("near"), F.min("old")).alias("label"))
        far = with_label(step, labels.withColumnRenamed("label", "far"), keys, "label", "node", "far", few=few)
        labels = far.select(*keys, "node", F.least("label", "far").alias("label")).checkpoint()
