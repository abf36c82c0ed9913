"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


#: Rows of a file of labels at least: a few links make a file a round, not one for each partition.
FILE_ROWS = 50_000


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``a, b``): the least node it is linked with.

    Each round takes the least label among a node and its neighbours and then follows
    labels to their own labels, which halves long chains.  Labels stay a table in the
    shared folder; the driver sees one number for each round.
    """
    links = links.where("a <> b")
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    files = both.count() // FILE_ROWS + 1
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")).coalesce(files))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        onward = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        moved = materialise(moved.join(onward, "to").select("node", F.least("to", "beyond").alias("label"), (F.least("to", "beyond") != F.col("was")).alias("changed")).coalesce(files))
        labels = moved.select("node", "label")
        if moved.where("changed").isEmpty():
            return labels
