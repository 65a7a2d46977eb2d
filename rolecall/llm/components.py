"""Connected components of a table of links, without collecting it anywhere.

Every node points to the smallest node that it is linked to. Pointers are
followed to their ends by doubling, links are redrawn between the ends, and this
repeats on what is left. Each round at least halves the nodes that still have
links. Tables are written between steps, so lineage stays short, and look-ups go
through ``spread_lookup``, so a node that very many others point to is no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.operators.skew import materialize, spread_lookup


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: not null); root is the smallest node it reaches."""
    found = None
    links = _redrawn(links.select("a", "b"))
    while not links.isEmpty():
        pointers = _followed(
            links.select(F.col("a").alias("node"), F.col("b").alias("to"))
            .union(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
            .groupBy("node")
            .agg(F.least("node", F.min("to")).alias("to"))
        )
        if found is None:
            found = pointers
        else:
            moved = _moved(found, "to", pointers)
            # Nodes that got links only now: they were ends before.
            found = materialize(moved.unionByName(pointers.join(found, "node", "left_anti")))
        links = _redrawn(_moved(_moved(links, "a", pointers), "b", pointers))
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.withColumnRenamed("to", "root")


def _redrawn(links: DataFrame) -> DataFrame:
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialize(ends.filter("a < b").distinct())


def _moved(df: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
    """``df`` with the node in ``column`` replaced by what it points to."""
    to = pointers.select(F.col("node").alias(column), F.col("to").alias("_to"))
    other = next(c for c in df.columns if c != column)
    joined = spread_lookup(df, to, [column], [other], "left")
    return joined.withColumn(column, F.coalesce("_to", column)).select(df.columns)


def _followed(pointers: DataFrame) -> DataFrame:
    """Pointers to the ends of their chains, by doubling."""
    pointers = materialize(pointers)
    while True:
        nxt = materialize(_moved(pointers, "to", pointers))
        if nxt.join(pointers, ["node", "to"], "left_anti").isEmpty():
            return nxt
        pointers = nxt
