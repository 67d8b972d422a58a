"""Connected components of a link table, by repeated minimum over neighbours with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.llm.common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached, for each node of links (two long columns).

    Each round takes the minimum label over neighbours (an aggregation that combines before its shuffle), then
    replaces each label by that label's own label, so chains halve. A hub with very many links is only ever a
    join key, whose partition Spark splits. Nulls and self links are ignored; no links give an empty table.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        moved = cut(hooked.join(up, "label", "left").select("node", "old", F.coalesce(F.least("label", "above"), "label").alias("label")))
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
