"""Connected components by rounds of joins, for edge tables of any size.

Each round every vertex learns the least label among its neighbours, roots
hook onto the least label seen by any member, and labels jump to their label's
label, so chains shrink by a constant factor a round.  Minima are aggregates
with map-side combine, so a vertex with very many edges is no hot spot.  Every
round is written to the shared checkpoint folder, and removed when the next one
is; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.session import cut_lineage, drop_staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); the
    component is its least node.  Null ends and loops add nothing."""
    links = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut_lineage(links.select("a", "b").union(links.select("b", "a")), "links")
    held = labels = cut_lineage(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        # the least label among the neighbours of each node
        seen = (links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen")))
        step = labels.join(seen, "node").select("node", "label", F.least("label", "seen").alias("low"))
        # roots hook onto the least label their members have seen
        hooks = step.groupBy(F.col("label").alias("root")).agg(F.min("low").alias("hook"))
        moved = cut_lineage(step.join(hooks, step.label == hooks.root).select("node", F.col("label").alias("old"), F.least("low", "hook").alias("label")), "hooked")
        # labels jump to their label's label
        to = moved.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = cut_lineage(moved.join(to, moved.label == to["at"], "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        changed = jumped.filter("label <> old").limit(1).count()
        drop_staged(held, moved)
        held, labels = jumped, jumped.select("node", "label")
        if not changed:
            drop_staged(links)
            return labels.withColumnRenamed("label", "component")
