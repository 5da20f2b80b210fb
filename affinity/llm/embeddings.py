"""Near-duplicate embeddings by sorted projection passes.

A pass gives every distinct vector 64 bits, the signs of its projections on random
directions, and sorts all vectors by them. Vectors with a small angle share long
prefixes and come to lie close; each is compared with the ``window`` vectors before it
at least (blocks of that size against themselves and the block before), across the
borders of partitions too. The number of passes follows from the corpus: with ``n``
vectors that the bits halve, a pair at the threshold falls into one window with about
``p = (1 - angle / pi) ^ log2(n / window)``, and passes are added until a pair is missed
by all with the probability ``miss`` at most. A block reports its links as a spanning
forest, so that a group of copies costs rows in proportion to its size; the forests of all
passes are united into components.

Whether the bits did halve the crowd is measured: the rows ``window`` places before and
after a vector tell how many bits a partner must share to lie between them in that pass.
Vectors whose measured depths leave a partner more than ``miss`` of a chance to be missed
go through further passes among themselves, and those that still do (a dense region,
which signs barely tell apart) are compared with one another exactly. A pair is safe if
one of its vectors is, so no others need it. The exact comparison grows with the square
of the number of vectors left, less the pairs within one large component.

Any two linked vectors are in one component, so the number of links is then counted
exactly within components. Vectors closer to their component's mean direction than half
the threshold's angle all link with one another: they are counted, not compared. The
others are compared with their component in blocks.

Exact copies are one node of the search with a weight. Defined results: a vector that is
null, zero or holds a null or non-finite component, or whose length differs from that of
most, links with nothing; a vec_id that comes more than once counts once, with its
smallest vector; a null vec_id is a row that links with nothing; an empty table gives no
rows; further columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, map_arrow, merge_labels, shuffle_partitions

#: Rows of a comparison block when links are counted: of those asked for, and of their component.
COUNT_ROWS, AGAINST_ROWS = 1024, 8192
#: Vectors of a stripe when crowded ones are compared exactly.
STRIPE_ROWS = 4096
#: Keeps rounding out of the counted (not compared) core of a component.
MARGIN = 1e-6


def passes_needed(n: int, window: int, threshold: float, miss: float) -> int:
    angle = math.acos(threshold)
    together = (1 - angle / math.pi) ** max(0.0, math.log2(max(n, 1) / window))
    return 1 if together > 1 - miss else math.ceil(math.log(miss) / math.log1p(-together))


def unit(data: list[bytes], dim: int) -> np.ndarray:
    """Rows of raw doubles as vectors of length one."""
    m = np.frombuffer(b"".join(data), "<f8").reshape(len(data), dim)
    # scaled first, so that neither tiny nor huge components leave the range of doubles
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``(vec_id, v)`` once an id, and the distinct usable ``(node, v, weight)``; and their length.

    ``v`` holds the doubles' bytes; ``node`` is the smallest id of the vector's copies.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x in batch.column(1).to_pylist():
            # + 0.0 so that both zeros are one
            a = np.array([math.nan if c is None else c for c in x], float) + 0.0 if x else np.zeros(0)
            out.append(a.astype("<f8").tobytes() if len(a) and np.isfinite(a).all() and a.any() else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = map_arrow(picked, run, "vec_id long, v binary", rows=4096)
    rows = cut(rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")).union(rows.where("vec_id is null").select("vec_id", F.lit(None).cast("binary"))))
    sizes = rows.where("v is not null").groupBy(F.length("v").alias("bytes")).count().orderBy(F.desc("count"), "bytes").limit(1).collect()
    size = sizes[0].bytes if sizes else 0
    return rows, cut(rows.where(F.length("v") == size).groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))), size // 8


def joined(first: pa.RecordBatch, second: pa.RecordBatch) -> pa.RecordBatch:
    """Both batches as one; an error, never a loss, where a column would pass what one may hold."""
    (out,) = pa.Table.from_batches([first, second]).combine_chunks().to_batches()
    return out


def forest(m: np.ndarray, passes: np.ndarray, own: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i, root)`` of a spanning forest of the links of the last ``own`` rows with all rows."""
    close = m[-own:] @ m.T >= threshold
    close &= passes[-own:, None] == passes[None, :]
    i, j = np.nonzero(close)
    labels = merge_labels(np.arange(len(m)), i + len(m) - own, j)
    moved = np.flatnonzero(labels != np.arange(len(m)))
    return moved, labels[moved]


def shared_bits(pass_a: np.ndarray, key_a: np.ndarray, pass_b: np.ndarray, key_b: np.ndarray) -> np.ndarray:
    """Leading bits in which keys agree, 0 to 64; -1 where the passes differ."""
    differ = (key_a ^ key_b).view(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        differ = differ | (differ >> np.uint64(shift))
    return np.where(pass_a == pass_b, 64 - np.bitwise_count(differ).astype(np.int32), -1).astype(np.int32)


def windows(nodes: DataFrame, dim: int, threshold: float, window: int, passes: int, number: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(a, b)`` links that span those found in all passes; and ``(node, pass, bits)`` shared with the rows ``window`` places away. Passes are numbered from ``number``."""

    def keys(batches):
        planes = np.random.default_rng(20 + number).standard_normal((passes, dim, 64))  # the same in every task
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                m = unit(part.column(1).to_pylist(), dim)
                for p in range(passes):
                    bits = np.packbits(m @ planes[p] > 0, axis=1)
                    key = bits.view(">u8").reshape(-1).astype(np.uint64) ^ np.uint64(1 << 63)  # unsigned order for signed longs
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), number + p, np.int32)), pa.array(key.view(np.int64)), *part.columns], names=["pass", "key", "node", "v"])

    def crowding(near: pa.RecordBatch, far: pa.RecordBatch) -> pa.RecordBatch:
        """Of rows ``window`` places apart: what each of both shares with the other."""
        sides = [[x.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2)] for x in (near, far)]
        (pass_a, key_a, a), (pass_b, key_b, b) = sides
        bits = shared_bits(pass_a, key_a, pass_b, key_b)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([a, b]), np.concatenate([pass_a, pass_b]), np.concatenate([bits, bits]))], names=["node", "pass", "bits"])

    def sweep(batches):
        """Blocks of ``window`` rows in order; the first and last of the partition go on to meet their neighbours'."""
        task, before, links, first = TaskContext.get().partitionId(), None, [], True
        rest = None

        def compare(block: pa.RecordBatch):
            nonlocal before
            both = block if before is None else joined(before, block)
            node, passed = (both.column(k).to_numpy(zero_copy_only=False) for k in (2, 0))
            i, root = forest(unit(both.column(3).to_pylist(), dim), passed, block.num_rows, threshold)
            if before is not None:
                yield row(*crowding(before.slice(0, block.num_rows), block).columns)
            before = block
            yield row(pa.array(node[i]), b=pa.array(node[root]))

        def row(a, passed=None, bits=None, **given):
            n, given = len(a), given | {"a": a, "pass": passed, "bits": bits}
            return pa.RecordBatch.from_arrays([pa.nulls(n, kind) if given.get(name) is None else given[name] for name, kind in SWEPT], names=[name for name, _ in SWEPT])

        def border(block: pa.RecordBatch, at: int, begin: int):
            n = block.num_rows
            place = pa.array(np.arange(begin, begin + n, dtype=np.int32))
            return row(block.column(2), block.column(0), border=pa.array(np.full(n, at, np.int32)), place=place, key=block.column(1), v=block.column(3))

        for batch in batches:
            rest = batch if rest is None else joined(rest, batch)
            while rest.num_rows >= window:
                block, rest = rest.slice(0, window), rest.slice(window)
                if first:
                    yield border(block, task, 0)
                    first = False
                yield from compare(block)
        if rest is not None and rest.num_rows:
            if first:
                yield border(rest, task, 0)
            # the last block is short: the one before it goes along, so that the window holds
            last = rest if before is None else joined(before, rest)
            yield from compare(rest)
            yield border(last, task + 1, -last.num_rows)
        elif before is not None:
            yield border(before, task + 1, -before.num_rows)

    def meet(table: pa.Table) -> pa.Table:
        node, passed = (table.column(k).to_numpy() for k in ("a", "pass"))
        i, root = forest(unit(table.column("v").to_pylist(), dim), passed, len(node), threshold)
        links = pa.table({"a": pa.array(node[i]), "b": pa.array(node[root]), "pass": pa.nulls(len(i), pa.int32()), "bits": pa.nulls(len(i), pa.int32())})
        # the rows window places apart across the border
        batch = table.select(["pass", "key", "a", "place"]).sort_by("place").combine_chunks().to_batches()[0]
        place = batch.column(3).to_numpy()
        ends, begins = batch.slice(0, int((place < 0).sum())), batch.slice(int((place < 0).sum()))
        if ends.num_rows < window or not begins.num_rows:
            return links
        shared = crowding(ends.slice(ends.num_rows - window, begins.num_rows), begins.slice(0, window))
        return pa.concat_tables([links, pa.table({"a": shared.column(0), "b": pa.nulls(shared.num_rows, pa.int64()), "pass": shared.column(1), "bits": shared.column(2)})])

    n = nodes.count() * passes
    parts = max(1, min(4 * shuffle_partitions(nodes.sparkSession), n // (8 * window)))
    dealt = nodes.select("node", "v").mapInArrow(keys, "pass int, key long, node long, v binary")
    ordered = dealt.repartitionByRange(parts, "pass", "key", "node").sortWithinPartitions("pass", "key", "node")
    found = cut(ordered.mapInArrow(sweep, "a long, b long, border int, pass int, bits int, place int, key long, v binary"))
    met = cut(found.where("border is not null").select("a", "pass", "key", "place", "v", "border").groupBy("border").applyInArrow(meet, "a long, b long, pass int, bits int"))
    both = found.where("border is null").select("a", "b", "pass", "bits").union(met)
    return both.where("b is not null").select("a", "b").distinct(), both.where("bits is not null").select(F.col("a").alias("node"), "pass", "bits")


#: Columns of the sweep: links, what rows share, and rows for the next partition to meet.
SWEPT = [("a", pa.int64()), ("b", pa.int64()), ("border", pa.int32()), ("pass", pa.int32()), ("bits", pa.int32()), ("place", pa.int32()), ("key", pa.int64()), ("v", pa.binary())]


def crowded(nodes: DataFrame, shared: DataFrame, threshold: float, miss: float) -> DataFrame:
    """``(node)`` of the vectors whose partners may be missed with more than ``miss`` after the depths measured."""
    # a partner that shares one bit more than both rows at the window's ends lies between them;
    # a pass that does not know both ends (or tells none apart in 64 bits) counts nothing
    agree = 1 - math.acos(threshold) / math.pi
    depth = shared.groupBy("node", "pass").agg(F.max("bits").alias("bits"), F.count("*").alias("ends")).where("ends = 2 and bits < 64")
    missed = depth.groupBy("node").agg(F.sum(F.when(F.col("bits") < 0, F.lit(-1e9)).otherwise(F.log1p(-F.pow(F.lit(agree), F.col("bits") + 1)))).alias("log_missed"))
    return nodes.select("node").join(missed.where(F.col("log_missed") <= math.log(miss)), "node", "left_anti")


def exact_links(members: DataFrame, dim: int, threshold: float) -> DataFrame:
    """``(a, b)`` that span all links between different components of ``members(component, node, v)``.

    Rows are dealt to stripes, large components to ones of their own, and every two stripes
    meet in a cell, unless both are of the same component.
    """
    members = cut(members)
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > STRIPE_ROWS).select("component", F.col("component").alias("own"), "size")
    total = members.count()
    part = F.pmod(F.xxhash64("node"), F.ceil(F.coalesce("size", F.lit(total)) / STRIPE_ROWS))
    striped = cut(members.join(sizes, "component", "left").select("component", "node", "v", "own", part.alias("part")))
    # one number per stripe, and those of its component's: the driver has a row per STRIPE_ROWS vectors, cells are made on the executors
    stripes = striped.select("own", "part").distinct().orderBy("own", "part").collect()
    count = len(stripes)
    low: dict[int | None, int] = {}
    high: dict[int | None, int] = {}
    for i, x in enumerate(stripes):
        low.setdefault(x.own, i)
        high[x.own] = i
    if count < 2 and (not stripes or stripes[0].own is not None):
        return members.sparkSession.createDataFrame([], "a long, b long")
    numbers = members.sparkSession.createDataFrame([(x.own, x.part, i, low[x.own], high[x.own]) for i, x in enumerate(stripes)], "own2 long, part2 long, i long, low long, high long")

    def compare(table: pa.Table) -> pa.Table:
        node, side, component = (table.column(k).to_numpy() for k in ("node", "side", "component"))
        m = unit(table.column("v").to_pylist(), dim)
        _, labels = np.unique(component, return_inverse=True)
        labels = np.unique(labels, return_index=True)[1][labels]  # a component's rows share its first row's label
        start = labels.copy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        theirs = np.ascontiguousarray(m[right].T)
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            i, j = np.nonzero(m[rows] @ theirs >= threshold)
            i, j = rows[i], right[j]
            other = start[i] != start[j]
            labels = merge_labels(labels, i[other], j[other])
        moved = np.flatnonzero((labels != start) & (start == np.arange(len(m))))
        return pa.table({"a": pa.array(node[moved]), "b": pa.array(node[labels[moved]])})

    numbered = striped.join(numbers, F.col("own").eqNullSafe(F.col("own2")) & (F.col("part") == F.col("part2")))
    met = numbered.withColumn("j", F.expr(f"explode(sequence(0L, {count - 1}L))")).where(F.col("own").isNull() | ~F.col("j").between(F.col("low"), F.col("high")))
    side = F.when(F.col("i") < F.col("j"), 0).when(F.col("i") > F.col("j"), 1).otherwise(2)
    dealt = met.select("component", "node", "v", (F.least("i", "j") * count + F.greatest("i", "j")).alias("cell"), side.alias("side"))
    return dealt.groupBy("cell").applyInArrow(compare, "a long, b long")


def count_links(members: DataFrame, dim: int, threshold: float) -> DataFrame:
    """``(node, n)``: weights of the other nodes of its component that link with each node of ``members(component, node, v, weight)``."""

    def add_up(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, v in zip(batch.column(0).to_numpy(), unit(batch.column(1).to_pylist(), dim)):
                sums[c] = sums.get(c, 0.0) + v
        yield pa.RecordBatch.from_pydict({"component": pa.array(sums, pa.int64()), "v": pa.array([x.astype("<f8").tobytes() for x in sums.values()], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        v = np.frombuffer(b"".join(table.column("v").to_pylist()), "<f8").reshape(-1, dim).sum(axis=0)
        return pa.table({"component": table.column("component").slice(0, 1), "mean": pa.array([v.tobytes()], pa.binary())})

    half = math.cos(math.acos(threshold) / 2 - MARGIN)

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, mean = unit(batch.column(2).to_pylist(), dim), np.frombuffer(b"".join(batch.column(4).to_pylist()), "<f8").reshape(-1, dim)
        core = (m * mean).sum(axis=1) >= half * np.linalg.norm(mean, axis=1)
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(core)], names=["component", "node", "v", "weight", "core"])

    means = members.select("component", "v").mapInArrow(add_up, "component long, v binary").groupBy("component").applyInArrow(total, "component long, mean binary")
    placed = cut(map_arrow(members.join(means, "component").select("component", "node", "v", "weight", "mean"), split, "component long, node long, v binary, weight long, core boolean", rows=4096))
    core = placed.where("core").groupBy("component").agg(F.sum("weight").alias("all"))
    counted = placed.where("core").join(core, "component").select("node", (F.col("all") - F.col("weight")).alias("n"))

    # what lies outside of a core is compared: blocks of these rows, each with every block of the component
    outside = placed.groupBy("component").agg(F.count_if(~F.col("core")).alias("out"), F.count("*").alias("size")).where("out > 0")
    asked_blocks, against_blocks = F.ceil(F.col("out") / COUNT_ROWS), F.ceil(F.col("size") / AGAINST_ROWS)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    spread = placed.join(outside, "component")
    asked = spread.where("not core").select("component", F.pmod(F.xxhash64("node"), asked_blocks).alias("q"), each(against_blocks).alias("r"), F.col("node").alias("n1"), F.col("v").alias("v1"), F.col("weight").alias("w1"))
    against = spread.select(F.col("component").alias("c2"), each(asked_blocks).alias("q2"), F.pmod(F.xxhash64("node"), against_blocks).alias("r2"), F.col("node").alias("n2"), F.col("v").alias("v2"), F.col("weight").alias("w2"), F.col("core").alias("core2"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        a, b = unit(left.column("v1").to_pylist(), dim), unit(right.column("v2").to_pylist(), dim)
        n1, n2, w1, w2 = left.column("n1").to_numpy(), right.column("n2").to_numpy(), left.column("w1").to_numpy(), right.column("w2").to_numpy()
        core = right.column("core2").to_numpy()
        mine, theirs = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for at in range(0, len(b), 4096):
            close = (a @ b[at : at + 4096].T >= threshold) & (n1[:, None] != n2[None, at : at + 4096])
            mine += close @ w2[at : at + 4096]
            theirs[at : at + 4096] = w1 @ close
        back = core & (theirs > 0)  # a core vector learns of its links outside here alone
        return pa.table({"node": pa.array(np.concatenate([n1, n2[back]])), "n": pa.array(np.concatenate([mine, theirs[back]]))})

    compared = asked.groupBy("component", "q", "r").cogroup(against.groupBy("c2", "q2", "r2")).applyInArrow(compare, "node long, n long")
    return counted.union(compared).groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, window: int = 256, miss: float = 0.002) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each id of ``vectors(vec_id, embedding)``."""
    rows, nodes, dim = classes(vectors)
    none = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not dim:
        return none
    n = nodes.count()
    passes = passes_needed(n, window, threshold, miss)
    links, shared = windows(nodes, dim, threshold, window, passes)
    if n > window:
        rest = cut(nodes.join(crowded(nodes, shared, threshold, miss), "node").select("node", "v"))
        again, shared_again = windows(rest, dim, threshold, window, passes // 3 + 1, number=passes)
        rest = cut(rest.join(crowded(rest, shared.union(shared_again), threshold, miss), "node"))
        links = links.union(again)
    graph = cut(connected_components(links))
    if n > window:
        more = cut(exact_links(rest.join(graph, "node", "left").select(F.coalesce("component", "node").alias("component"), "node", "v"), dim, threshold))
        if not more.isEmpty():
            graph = cut(connected_components(graph.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    members = cut(graph.join(nodes, "node").select("component", "node", "v", "weight"))
    counts = count_links(members, dim, threshold)
    found = nodes.join(graph, "node", "left").join(counts, "node", "left").select("v", F.coalesce("component", "node").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.join(found, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
