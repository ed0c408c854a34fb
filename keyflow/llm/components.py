"""Connected components of a table of links, by contraction: each round maps nodes to their least neighbour's root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyflow.llm.common import settle


#: A hot root's rows are dealt to so many tasks.
SALTS = 16


def by_root(rows: DataFrame, roots: DataFrame, on: str, key: str, how: str = "inner") -> DataFrame:
    """rows with the columns of roots, whose ``on`` is unique; rows of one value of ``on`` are spread by ``key``, for which roots is repeated ``SALTS`` times.

    So roots should hold only what several rows may have. how: "inner", or "left" for rows without a root as well.
    """
    salted = roots.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, [on, "__salt"], how).drop("__salt")


def _jump(labels: DataFrame, parent: DataFrame) -> DataFrame:
    """labels (node, root) with each root replaced by its own root in parent; only roots that have another one are sent."""
    up = parent.filter("node <> root").toDF("root", "above").join(labels.select("root").distinct(), "root", "left_semi")
    return by_root(labels, up, "root", "node", "left").select("node", F.coalesce("above", "root").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a long, b long), the root being the least node reachable.

    Rounds of: parent = least neighbour or oneself; two pointer jumps; links between different parents go on. Each
    round's tables are written to the shared folder. Self links and repeated links are harmless; no links: no rows.
    """
    ordered = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links = settle(ordered(links), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root"))
        parent = settle(parent, "parents")
        for _ in range(2):
            parent = settle(_jump(parent, parent), "parents")
        a, b = parent.toDF("a", "ra"), parent.toDF("b", "rb")
        links = settle(ordered(links.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "links")
        labels = parent if labels is None else settle(_jump(labels, parent), "labels")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
