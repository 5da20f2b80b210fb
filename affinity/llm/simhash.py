"""SimHash near-duplicates over vantage-point-tree shards.

Fingerprints are 64 majority bits over the XXH64 hashes (seed 42) of word shingles.
Distinct fingerprints are dealt to shards by a vantage-point tree: a node sends a
fingerprint to its inner side if its Hamming distance to the vantage point is at most
the radius, else to the outer side. By the triangle bound two fingerprints within
``bits`` differ by at most ``bits`` in that distance, so one that lies within ``bits``
of a boundary is also copied across it. Every pair within ``bits`` then meets in the
home shard of one of the two: the search is exact whatever tree is drawn. Within a shard
a tree of its own prunes branches by the same bound.

Defined results: null or word-less text has fingerprint 0, linked like any other; a
repeated row gets the same row of results each time; a null doc_id is never the
smallest unless its component has no other; an empty table gives no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, fresh, map_arrow, merge_labels, raw

#: Shingle hashes whose bits are unpacked at once; bounds memory for very long texts.
CHUNK = 1 << 15
#: Distinct fingerprints that a shard should hold at home, and the most leaves a tree gets.
SHARD_ROWS, MOST_SHARDS, SAMPLE = 8192, 16384, 65536
#: Fingerprints of a leaf within a shard.
LEAF_ROWS = 256


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text in UTF-8; only A-Z are lower-cased."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    take = xxhash.xxh64_intdigest
    if len(words) < shingle:
        grams, n = [b" ".join(words)], 1
    else:
        grams, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    hashes = np.fromiter((take(g, 42) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp)`` per row and the long columns ``carry``; fp is the fingerprint's 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(x, shingle) for x in raw(batch, "text")), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *carry])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    return map_arrow(picked, run, ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in carry)]))


def distance(values: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ point).astype(np.int16)


def build_tree(sample: np.ndarray, leaves: int, bits: int) -> list[tuple]:
    """Nodes ``(point, radius, inner, outer)``; a child below zero is shard ``-child - 1``.

    ``sample`` is a bounded sample of distinct fingerprints. Of a few candidate points and
    the radii in the middle of their distances, a node takes those that split most evenly
    with the fewest fingerprints near the boundary.
    """
    nodes: list[tuple] = []
    shards = 0
    rng = np.random.default_rng(7)

    def grow(values: np.ndarray, want: int) -> int:
        nonlocal shards
        best = None
        if want > 1 and len(values) > 8:
            for point in values[rng.choice(len(values), min(8, len(values)), replace=False)]:
                d = distance(values, point)
                for radius in np.unique(np.quantile(d, [0.35, 0.42, 0.5, 0.58, 0.65]).astype(int)):
                    inner = (d <= radius).mean()
                    near = (np.abs(d - radius - 0.5) <= bits).mean()
                    if 0.15 <= inner <= 0.85 and (best is None or near + abs(inner - 0.5) < best[0]):
                        best = (near + abs(inner - 0.5), point, int(radius), d <= radius)
        if best is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(())
        left = grow(values[best[3]], want // 2)
        right = grow(values[~best[3]], want - want // 2)
        nodes[at] = (best[1], best[2], left, right)
        return at

    if grow(sample, leaves) < 0:
        return []
    return nodes


def route(values: np.ndarray, nodes: list[tuple], bits: int, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the value, shard, and whether the shard is its home, for every copy dealt; ``home`` false where all are guests."""
    n = len(values)
    home = np.ones(n, bool) if home is None else home
    if not nodes:
        return np.arange(n), np.zeros(n, np.int32), home
    out, stack = [], [(0, np.arange(n), home)]
    while stack:
        at, index, home = stack.pop()
        if not len(index):
            continue
        if at < 0:
            out.append((index, np.full(len(index), -at - 1, np.int32), home))
            continue
        point, radius, left, right = nodes[at]
        d = distance(values[index], point)
        inner = d <= radius
        # a guest may be sought from either side; a home row is copied inwards only, so each pair is met
        go_in, go_out = inner | (d <= radius + bits), ~inner | (~home & (d > radius - bits))
        stack.append((left, index[go_in], (home & inner)[go_in]))
        stack.append((right, index[go_out], (home & ~inner)[go_out]))
    if not out:
        return np.zeros(0, int), np.zeros(0, np.int32), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def shard_links(values: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of a shard: ``(value, root value)`` where they differ.

    The shard has a tree of its own, down to leaves of about ``LEAF_ROWS``: a branch that the
    triangle bound rules out for a fingerprint is never compared with it.
    """
    labels = np.arange(len(values))
    drawn = values if len(values) <= SAMPLE else values[np.random.default_rng(5).choice(len(values), SAMPLE, replace=False)]
    nodes = build_tree(drawn, max(1, len(values) // LEAF_ROWS), bits) if len(values) > 2 * LEAF_ROWS else []
    index, leaf, own = route(values, nodes, bits, home)
    order = np.argsort(leaf, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
        members, mine = index[part], index[part[own[part]]]
        for at in range(0, len(mine), LEAF_ROWS):
            rows = mine[at : at + LEAF_ROWS]
            i, j = np.nonzero(np.bitwise_count(values[rows][:, None] ^ values[members][None, :]) <= bits)
            i, j = rows[i], members[j]
            other = i != j
            if other.any():
                labels = merge_labels(labels, i[other], j[other])
    moved = np.flatnonzero(labels != np.arange(len(values)))
    return values[moved], values[labels[moved]]


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """A spanning set ``(a, b)`` of all links between distinct fingerprints ``distinct(fp long)``."""
    count = distinct.count()
    leaves = max(1, min(MOST_SHARDS, -(-count // SHARD_ROWS)))
    picked = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect() if leaves > 1 else []
    nodes = build_tree(np.array([r.fp for r in picked], np.int64).view(np.uint64), leaves, bits) if picked else []

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        index, shard, home = route(values.view(np.uint64), nodes, bits)
        return pa.RecordBatch.from_arrays([pa.array(values[index]), pa.array(shard), pa.array(home)], names=["fp", "shard", "home"])

    def search(table: pa.Table) -> pa.Table:
        a, b = shard_links(table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy(zero_copy_only=False).astype(bool), bits)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt = map_arrow(distinct.select("fp"), deal, "fp long, shard int, home boolean", rows=1 << 16)
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 2, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp, component_id, component_fp)`` per row of ``docs(doc_id, text)``, and its long columns ``carry``.

    ``component_id`` is the smallest doc_id that links reach, ``component_fp`` the smallest
    fingerprint of the component (its key even where ids are null). Copies share a
    fingerprint and are one node of the graph, so a group of any size costs one row.
    """
    found = cut(fingerprints(docs, shingle, carry))
    classes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("low")))
    graph = connected_components(links(classes.select("fp"), bits))
    classes = classes.join(graph.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = classes.select("fp", "component").join(lowest, "component")
    return found.join(classes, "fp", "left").select("doc_id", "fp", "component_id", F.col("component").alias("component_fp"), *carry)


def keep_one(docs: DataFrame, bits: int = 2, shingle: int = 3) -> DataFrame:
    """One row of each component of ``docs``, all columns kept: one with its smallest doc_id.

    A null doc_id stands in only where the component has no other. Of different texts under
    that id in the component the one with the smallest hash stays, of repeated rows any.
    Rows of one doc_id in different components are different documents.
    """
    # a row's id and text in 128 bits: the row chosen is told by them, whatever ids are null or repeated
    long, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    names = fresh(docs, "key_one", "key_two")
    key = [F.xxhash64(long, text).alias(names[0]), F.xxhash64(F.lit(1), text, long).alias(names[1])]  # nulls are passed over: the number tells the two apart
    found = near_duplicates(docs.select("doc_id", "text", *key), bits, shingle, carry=tuple(names))
    chosen = found.where("doc_id <=> component_id").groupBy("component_fp").agg(F.min(F.struct(*names)).alias("k")).select(*[f"k.{n}" for n in names])
    # one key for both steps, so that documents are dealt out once
    return docs.select("*", *key).join(chosen, names, "left_semi").dropDuplicates(names).select(*[f"`{c}`" for c in docs.columns])
