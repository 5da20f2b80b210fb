"""Plumbing the operators share: recovery points, Arrow row maps, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, dropped_shuffles


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 512) -> DataFrame:
    """Apply ``fn`` to slices of at most ``rows`` rows, so Python holds few texts at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` does not have."""
    have = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def filter_arrow(docs: DataFrame, columns: dict[str, str], fn: Callable[[pa.RecordBatch], list[bool]], rows: int = 512) -> DataFrame:
    """The rows of ``docs``, whole, for which ``fn`` of the named columns says True.

    ``fn`` gets a batch of the columns under their names here, as the types here; a column that
    ``docs`` lacks is null. Names match as Spark matches them.
    """
    at, more, width = [], [], len(docs.columns)
    for name, kind in columns.items():
        own = next((i for i, c in enumerate(docs.columns) if c.lower() == name), None)
        if own is not None and docs.dtypes[own][1] == kind:
            at.append(own)
        else:
            at.append(width + len(more))
            more.append((F.lit(None) if own is None else F.col(f"`{docs.columns[own]}`")).cast(kind).alias(fresh(docs, name)[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                keep = pa.array(fn(pa.RecordBatch.from_arrays([part.column(i) for i in at], names=list(columns))), pa.bool_())
                yield part.select(range(width)).filter(keep)

    return (docs.select("*", *more) if more else docs).mapInArrow(run, docs.schema)


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as its UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def held_out(column: str, modulus: int, rest: int = 2):
    """True where crc32 of the id as text leaves ``rest``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == rest


def merge_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union the links ``left[k] - right[k]`` into ``labels``.

    ``labels[i]`` is the index of the root of ``i``; roots are the smallest index of
    their set. Memory is that of the arrays given; no pair list is built.
    """
    while True:
        a, b = labels[left], labels[right]
        differ = a != b
        if not differ.any():
            return labels
        np.minimum.at(labels, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a long, b long)``; component = smallest node.

    Alternating large-star and small-star rounds: each node links its neighbours to the
    smallest node it knows. Edges never leave the executors, each round shuffles at most
    a constant number of rows an edge, and the number of rounds is logarithmic in the
    longest path. Hot hubs are plain equi-joins of two shuffled sides, which adaptive
    execution splits. Every round ends at a checkpoint. Self-links only name a node.
    """
    edges = cut(edges.select("a", "b"))
    nodes = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        state = cut(small)
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return nodes.join(state.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
