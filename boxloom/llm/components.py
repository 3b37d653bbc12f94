"""Connected components of a link table, as joins in rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.session import drop_tables, durable


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node it reaches.

    Each round takes the smallest label among the neighbours, then the label of that label, so
    chains halve; it ends with the first round that changes nothing. An empty table of links
    gives no rows; links of a node with itself and repeated links do no harm.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges = durable(both.distinct(), "edges")
    labels = durable(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = (edges.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        moved = durable(
            lower.join(jump, "low", "left").select(
                "node", "old", F.least("low", F.coalesce("lower", "low")).alias("label")), "labels")
        drop_tables(labels)
        labels = moved.select("node", "label")
        if moved.where("label < old").isEmpty():
            drop_tables(edges)
            return labels


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links between nodes; nodes not in ``labels`` stand for themselves.

    ``labels`` is a written table, which the new one replaces.
    """
    named = labels.select("node", "label")
    ends = links.select("a", "b")
    for side in ("a", "b"):
        ends = ends.join(named.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side, "left")
    merged = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    nodes = named.select("node", "label").union(
        ends.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        .join(named, "node", "left_anti").select("node", F.col("node").alias("label")))
    out = durable(
        nodes.join(merged.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left")
        .select("node", F.coalesce("new", "label").alias("label")), "labels")
    drop_tables(merged, labels)
    return out
