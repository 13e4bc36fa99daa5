"""Families of related records: connected components over shared names and owners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.shared import cut, join_facts


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each node's component, for ``edges`` with columns ``a, b``.

    Labels form trees, a label being a node of the same component that isn't larger. Each round hooks what a node points to
    (its label, and the node itself) under the smallest label among the neighbours, then lets every node take its label's
    label. Hooking labels and not only nodes lets a small label take over a tree as a whole, in whatever order the names come.
    It ends when a round changes nothing: labels only ever fall, so it always does. Every round is a few aggregations with
    map-side partials and joins that keep heavy nodes in place; it ends in a table in the shared folder, so lineage stays short
    and lost executors cost one round. Edges and labels never reach the driver. Self-loops, repeated edges and nulls are
    allowed (edges with a null end are none); no edges give no rows.
    """
    both = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    if labels.isEmpty():
        return labels
    while True:
        near = join_facts(both.withColumnRenamed("b", "node"), labels, "node", "inner").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        offers = labels.join(near, "node").select("node", "label", "near")
        # a node and the label it has are both offered the least label next to the node
        hooked = offers.select(F.explode(F.array("node", "label")).alias("node"), "near").groupBy("node").agg(F.min("near").alias("near"))
        lowered = cut(labels.join(hooked, "node", "left").select("node", F.least("label", "near").alias("low"), F.col("label").alias("old")), "hooked")
        # jump: a node takes its label's label
        jump = lowered.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        moved = join_facts(lowered, jump, "low", "left").select("node", F.least("low", "lower").alias("label"), "old")
        step = cut(moved, "labels")
        if step.filter("label <> old").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")


def name_families(named: DataFrame) -> DataFrame:
    """``name, family`` for ``named`` with columns ``name, owner``: names with a common owner are one family, transitively.

    The graph searched is the small one: only names with several owners link owners, so components run over owners alone;
    all other names take their owner's label or, without owners, stand alone. A family is called ``o:<owner>`` or
    ``n:<name>``. Null names are dropped.
    """
    pairs = named.filter(F.col("name").isNotNull())
    owners = pairs.groupBy("name").agg(F.min("owner").alias("owner"), F.max("owner").alias("other"))
    linking = owners.filter("owner <> other").select("name", F.col("owner").alias("a"))
    edges = join_facts(pairs.filter("owner is not null").distinct(), linking, "name", "inner").select("a", F.col("owner").alias("b")).filter("a <> b")
    labels = components(edges)
    owned = join_facts(owners.select("name", F.col("owner").alias("node")), labels, "node", "left")
    family = F.when(F.col("node").isNull(), F.concat(F.lit("n:"), "name")).otherwise(F.concat(F.lit("o:"), F.coalesce("label", "node")))
    return owned.select("name", family.alias("family"))
