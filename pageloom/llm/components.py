"""Connected components of a link table, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of links with the smallest node it can reach. Nulls and self-links are ignored; links may repeat and may point either way.

    Each round first gives every node its smallest smaller neighbour and moves its other links onto that one (no join; links are combined before the shuffle), then replaces each parent by its own parent. Nodes with very many children are on the side of the join that Spark can split. Rounds grow with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("p")).where("v <> p")
    while True:
        grouped = edges.groupBy("v").agg(F.collect_set("p").alias("ps")).withColumn("p", F.array_min("ps"))
        pairs = F.array_append(F.transform(F.array_remove("ps", F.col("p")), lambda q: F.struct(q.alias("v"), F.col("p").alias("p"))), F.struct("v", "p"))
        edges = stored(grouped.select(F.explode(pairs).alias("e")).select("e.v", "e.p").distinct(), "links")
        up = stored(edges.groupBy("v").agg(F.min("p").alias("up"), F.count("*").alias("n")), "parents")
        deep = edges.join(up.select(F.col("v").alias("p"), "up"), "p", "left_semi")
        if up.where("n > 1").isEmpty() and deep.isEmpty():
            roots = edges.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct()
            return edges.select(F.col("v").alias("node"), F.col("p").alias("root")).unionByName(roots)
        edges = edges.join(up.select(F.col("v").alias("p"), "up"), "p", "left").select("v", F.coalesce("up", "p").alias("p"))
