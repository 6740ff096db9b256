"""Embedding near-duplicates with a pivot-permutation index.

Reference points (pivots) are vectors of a bounded sample, ``SAMPLE`` rows by hash, that are pairwise apart. Each vector is
described by its ``NEAREST`` pivots in order of nearness. Inverted lists, one for a label and pivot, bring together
the vectors that have the pivot in their description; pairs with at least ``SHARED`` pivots in common are verified by
cosine in double precision, once, in the list of their least common pivot. The number of pivots follows the square root of
the number of vectors, so that lists grow slower than the table. Long lists are cut into blocks that are compared two by
two in matrix products, which leave counts and a spanning star, never a row for each pair.

Equal vectors of a label are one class, which the least vec_id stands for.

Cases: null label, and null, empty, zero or non-finite vectors link with nothing, and neither does a row without vec_id;
vectors of other length never link; an empty table gives an empty result; other columns are ignored. Rows that share a vec_id
are one vertex: it and the vectors equal to one of its own have the links of all of them, in n_links one for each. Labels are of any
type that can be grouped, components of any numeric type.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

SAMPLE, NEAREST, SHARED, BLOCK = 8192, 8, 2, 512


def unit(table_column) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    flat = table_column.combine_chunks() if isinstance(table_column, pa.ChunkedArray) else table_column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(vectors: np.ndarray, n: int, apart: float = 0.8) -> np.ndarray:
    """The first n rows, in the given order, whose cosine with every row chosen before is under ``apart``."""
    chosen = np.zeros((0, vectors.shape[1]))
    for v in vectors:
        if len(chosen) == n:
            break
        if not len(chosen) or (chosen @ v).max() < apart:
            chosen = np.vstack([chosen, v])
    return chosen


def compare_blocks(table: pa.Table, threshold: float, shared: int) -> pa.Table:
    """Links among the rows of two blocks of one list: each row's count, by multiplicity, and its least reached id."""
    own = np.array(table.column("block")) == table.column("low")[0].as_py()
    same = table.column("low")[0].as_py() == table.column("high")[0].as_py()
    ids, mult = np.array(table.column("node")), np.array(table.column("mult"))
    x, described = unit(table.column("embedding")), np.stack(table.column("pivots").to_numpy())
    pivot = table.column("pivot")[0].as_py()
    names, column = np.unique(described, return_inverse=True)
    hot = np.zeros((len(ids), len(names)), np.float32)
    hot[np.arange(len(ids))[:, None], column.reshape(described.shape)] = 1
    earlier = hot * (names < pivot)
    link = (x @ x.T >= threshold) & (hot @ hot.T >= shared) & (earlier @ earlier.T == 0)
    if same:
        np.fill_diagonal(link, False)
    else:
        link &= own[:, None] != own[None, :]
    degree = link @ mult
    some = degree > 0
    least = graph.least_linked(link[some][:, some], ids[some]) if some.any() else ids[:0]
    return pa.table({"node": pa.array(ids[some], pa.int64()), "degree": pa.array(degree[some], pa.int64()), "least": pa.array(least, pa.int64())})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0),
        F.lit(False),
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    classes = common.staged(rows.where(sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.countDistinct("vec_id").alias("mult")), "classes")
    n = classes.count()
    sample = classes.select("embedding", F.xxhash64("embedding", F.lit(7)).alias("h")).orderBy("h").limit(SAMPLE).toArrow()
    by_size: dict[int, list] = {}
    for v in sample.column("embedding").to_pylist():
        by_size.setdefault(len(v), []).append(v)
    n_pivots = max(64, min(SAMPLE, 2 * math.isqrt(n)))
    pivots = {d: choose_pivots(unit(pa.array(v, pa.list_(pa.float64()))), n_pivots) for d, v in by_size.items()}

    def describe(batches):
        for b in batches:
            sizes = np.array([len(v) for v in b.column("embedding")])
            out = [None] * len(sizes)
            for d in set(sizes.tolist()):
                at = np.flatnonzero(sizes == d)
                if d in pivots:
                    near = unit(b.column("embedding").take(pa.array(at))) @ pivots[d].T
                    order = np.argsort(-near, axis=1, kind="stable")[:, :nearest]
                else:  # a length that the sample lacks: one list for each label
                    order = np.zeros((len(at), 1), np.int64)
                if order.shape[1] < shared:  # too few pivots to share: all of that length meet
                    order = np.tile(np.arange(shared), (len(at), 1))
                for i, o in zip(at, order):
                    out[i] = o
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], names=[*b.schema.names, "pivots"])

    sized = classes.withColumn("dim", F.size("embedding"))
    described = sized.mapInArrow(describe, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sized.schema) + ", pivots array<int>")
    described = common.staged(described, "described")
    lists = described.select("label", "dim", F.explode("pivots").alias("pivot")).groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    entries = described.withColumn("pivot", F.explode("pivots")).join(lists, ["label", "dim", "pivot"])
    entries = entries.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entries = entries.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    found = entries.groupBy("label", "dim", "pivot", "low", "high").applyInArrow(
        lambda t: compare_blocks(t, threshold, shared), "node long, degree long, least long"
    )
    found = common.staged(found, "found")
    degrees = found.groupBy("node").agg(F.sum("degree").alias("degree"))
    components = graph.connected_components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    by_class = classes.join(degrees, "node", "left").join(components, "node", "left")
    by_class = by_class.select("label", "embedding", (F.coalesce("degree", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    linked = rows.where(sound).join(by_class, ["label", "embedding"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
