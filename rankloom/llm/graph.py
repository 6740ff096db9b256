"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a long, b long) to (node long, component long): the least node that links reach, itself included.

    Each round lets every node point to the least of itself and its neighbours, follows these pointers to their ends, and puts the
    ends in the links' place. Links within what has become one node go, so that the rounds together read hardly more than the first: a
    star or a chain takes one, whatever its size. What a round makes is written to the shared folder, so that it depends on no earlier
    one. Nothing but whether rows are left comes to the driver. Nulls and loops are ignored; no links give no rows."""
    pairs = links.where("a is not null and b is not null and a <> b")
    edges, labels = _distinct(pairs), None
    while labels is None or edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = common.staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("end")), "ends")
        while True:
            ahead = ends.select(F.col("node").alias("end"), F.col("end").alias("ahead"))
            ends = common.staged(ends.join(ahead, "end").select("node", F.col("ahead").alias("end"), (F.col("ahead") != F.col("end")).alias("moved")), "ends")
            if not ends.where("moved").limit(1).count():
                break
            ends = ends.drop("moved")
        ends = ends.drop("moved")
        if labels is None:
            labels = ends.withColumnRenamed("end", "component")
        else:
            further = ends.withColumnRenamed("node", "component")
            labels = common.staged(labels.join(further, "component", "left").select("node", F.coalesce("end", "component").alias("component")), "labels")
        of = lambda k: ends.select(F.col("node").alias(k), F.col("end").alias(f"end_{k}"))
        edges = _distinct(edges.join(of("a"), "a").join(of("b"), "b").where("end_a <> end_b").select(F.col("end_a").alias("a"), F.col("end_b").alias("b")))
    return labels


def _distinct(pairs: DataFrame) -> DataFrame:
    """Each link once, whichever way it was given."""
    return common.staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def least_linked(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id in each row's component, by spreading least ids over a symmetric matrix of links."""
    least = ids
    while True:
        near = np.where(link, least[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(least, near)
        if (new == least).all():
            return least
        least = new
