"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _forest(batches):
    """A spanning forest of each task's edges: every node with the smallest node it is joined to there, batch by batch."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
        label = np.arange(len(nodes))
        left, right = ends[: len(a)], ends[len(a) :]
        while True:  # hook to the smaller label, then jump
            before = label.copy()
            low = np.minimum(label[left], label[right])
            np.minimum.at(label, left, low)
            np.minimum.at(label, right, low)
            np.minimum.at(label, before, label)
            label = label[label]
            if (label == before).all():
                break
        moved = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component): the smallest node that each node of the edges ``(a, b)`` (longs) is connected to.

    Large-star and small-star steps (Kiveris et al. 2014) until nothing changes.  A step is a minimum
    for each node (combined before the shuffle) and a join that Spark can split where a node has very
    many neighbours.  Loops, repeated and reversed edges do no harm; nodes without edges do not appear.
    """
    now = materialize(edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long").distinct(), f"{tag}-0")
    step, before = 0, None
    while True:
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").unionByName(least.select(F.col("a").alias("x"), "m"))
        now = materialize(small.select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct(), f"{tag}-{step}")
        h = F.xxhash64("a", "b").cast("decimal(20,0)")
        seen = now.agg(F.count("*"), F.sum(h), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if seen == before:
            break
        before = seen
    out = now.groupBy("a").agg(F.min("b").alias("component"))
    return out.select(F.col("a").alias("node"), "component").unionByName(out.select(F.col("component").alias("node"), "component").distinct())
