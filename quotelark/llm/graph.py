"""Connected components of a link table, as repeated joins.

Nulls, ties and odd input: links are of whole numbers without nulls, as the operators number what they link; a link that is repeated,
turned about or of a node with itself counts once; a node without a link isn't in the result; an empty table gives an empty
result. Only a and b are read, so other names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelark.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node that links lead to.

    Every round takes the least label among a node's neighbours and then its label's label, so a chain of n links needs about
    log n rounds. Sums and minima are combined before each shuffle, and each round's labels are written to the shared folder.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        least = cut(labels.join(near, labels["node"] == near["a"], "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("least")))
        up = least.select(F.col("node").alias("up"), F.col("least").alias("top"))
        moved = cut(least.join(up, least["least"] == up["up"], "left").select("node", F.col("root").alias("old"), F.least("least", F.coalesce("top", "least")).alias("root")))
        labels = moved.select("node", "root")
        if moved.where("old <> root").isEmpty():
            return labels
