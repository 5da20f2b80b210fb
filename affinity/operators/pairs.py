"""User pairs: exact co-occurrence, bounded neighbours for large groups, and their counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BUY, EngineConfig
from ..functions.columns import native_order
from ..functions.shuffle import item_seed, shuffled
from ..sources.writers import line_blocks, lines_of
from .lineage import cut, dropped_shuffles, written
from .postings import KEY, degrees, edges, pair_plan, usable

#: How many times more contributions than packed edges make cells faster than the join, and contributions from which the disk decides:
#: the join shuffles some 14 bytes for each, cells some 15 for each edge, once, and read a packed edge once per block.
SHORT, MANY = 16, 1 << 26
#: Contributions that are worth a cell of ``cell_counts`` up to ``SPREAD`` blocks, most of a cell beyond, edges of one of its blocks, contributions counted at once, and most tasks.
CELL, SPREAD, LARGE_CELL, BLOCK_EDGES, AT_ONCE, TASKS = 32 << 20, 16, 1 << 30, 1 << 20, 1 << 20, 8192
#: Pairs whose 64 bits are counted in the time of one contribution, pairs counted so at once, and most words of bits of a cell.
BITS, PAIRS, WORDS = 16, 1 << 14, 4 << 20
#: Lines of a frame of ``ordered_counts``, at most: its contributions, or its pairs of users where these are fewer.
STRIP = 1 << 24


def exact_pairs(edge: DataFrame) -> DataFrame:
    """``(item_id, behavior, user1, user2)``, user1 < user2, for all pairs of each group of ``edge``.

    An equi-join of edge rows with a residual: it spills, and adaptive execution splits hot groups.
    """
    a = edge.select(*KEY, F.col("user_id").alias("user1"))
    b = edge.select(*KEY, F.col("user_id").alias("user2"))
    return a.join(b, KEY).where("user1 < user2")


def native_positions(edge: DataFrame, seed: int) -> DataFrame:
    """Adds ``pos``, each user's place from 0 in the hash order of its group.

    Ranked in 256 ranges of the hash, whose sizes add up to the ranges' offsets: a group
    of any size is sorted by many tasks.
    """
    hashed = edge.withColumn("h", native_order(F.col("item_id"), F.col("behavior"), seed, F.col("user_id"))).withColumn("r", F.substring("h", 1, 2))
    earlier = Window.partitionBy(*KEY).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashed.groupBy(*KEY, "r").agg(F.count("*").alias("m")).select(*KEY, "r", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*KEY, "r").orderBy("h", "user_id")) - 1
    return hashed.withColumn("own", own).join(offsets, [*KEY, "r"]).withColumn("pos", (F.col("before") + F.col("own")).cast("bigint")).drop("h", "r", "own", "before")


def compat_positions(edge: DataFrame, seed: int) -> DataFrame:
    """Adds ``pos`` by the seeded shuffle, one group at a time: the shuffle itself is sequential."""
    import pandas as pd

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        code = 1 if first.behavior == BUY else 2
        order = {u: i for i, u in enumerate(shuffled(pdf.user_id.tolist(), item_seed(int(first.item_id), code, seed)))}
        return pdf.assign(pos=pdf.user_id.map(order))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edge.schema.fields)
    return edge.groupBy(*KEY).applyInPandas(place, f"{kinds}, pos bigint")


def bounded_pairs(placed: DataFrame) -> DataFrame:
    """Pairs of users ``1 .. k div 2`` apart on their group's ring ``(…, n, k, pos)``; with odd k also half a ring.

    Every user names its partners' places and meets them by an equi-join on the place:
    n * k / 2 rows come out and no more are ever built.
    """
    near = F.transform(F.expr("sequence(1, greatest(k div 2, 1))"), lambda o: F.when(F.col("k") >= 2, o.cast("bigint")))
    half = F.when((F.col("k") % 2 == 1) & (F.col("pos") < F.expr("n div 2")), F.expr("n div 2"))
    steps = placed.where("k > 0").select(*KEY, "n", F.col("user_id").alias("u"), "pos", F.explode(F.concat(near, F.array(half))).alias("step")).where("step is not null")
    asked = steps.select(*KEY, "u", ((F.col("pos") + F.col("step")) % F.col("n")).alias("pos"))
    met = asked.join(placed.select(*KEY, "pos", F.col("user_id").alias("v")), [*KEY, "pos"])
    return met.select(*KEY, F.least("u", "v").alias("user1"), F.greatest("u", "v").alias("user2"))


def hybrid_pairs(obs: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Pair contributions: groups within their exact limit in full, larger ones bounded."""
    edge = edges(obs)
    return planned_pairs(edge, pair_plan(degrees(edge), cfg), cfg)


def planned_pairs(edge: DataFrame, plan: DataFrame, cfg: EngineConfig) -> DataFrame:
    """``hybrid_pairs`` of edges whose groups' plan is known."""
    known = edge.join(plan.select(*KEY, "n", "k"), KEY)
    whole = exact_pairs(known.where("k = n - 1").select(*KEY, "user_id"))
    large = known.where("k < n - 1 and k > 0")
    placed = native_positions(large, cfg.sample_seed) if cfg.sampling == "native" else compat_positions(large, cfg.sample_seed)
    return whole.unionByName(bounded_pairs(placed))


def capped_edges(obs: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Edges of the groups that no cap drops."""
    edge = edges(obs)
    if cfg.max_users_per_item > 0:
        edge = edge.join(usable(degrees(edge), cfg).select(*KEY), KEY, "left_semi")
    return edge


def capped_pairs(obs: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Exact pair contributions of usable groups."""
    return exact_pairs(capped_edges(obs, cfg))


def count_pairs(contributions: DataFrame) -> DataFrame:
    """``user1, user2, buy_count, pv_count``"""
    of = lambda b: F.sum((F.col("behavior") == b).cast("bigint"))
    return contributions.groupBy("user1", "user2").agg(of("buy").alias("buy_count"), of("pv").alias("pv_count"))


def exact_counts(edge: DataFrame, least: tuple[int, int] = (0, 0), kept: bool = False) -> DataFrame:
    """``count_pairs`` of all pairs of each group, by the form that costs less.

    Pairs with fewer buys and fewer views than ``least`` may be missing. Ids must be whole numbers.

    The edges are written down first, unless they are ``kept`` already, and told apart by one pass over the degrees: the join
    shuffles a row per contribution, the square of a large group; cells shuffle every edge once and read it, packed, once per block.
    """
    edge, n, made = sized(edge, kept)
    blocks = blocks_of(n, made, edge.sparkSession.sparkContext.defaultParallelism)
    if joined(n, made, blocks):
        return count_pairs(exact_pairs(edge))
    sizes = edge.groupBy(block_of(blocks).alias("block")).agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK_EDGES).collect()
    return cell_counts(edge, blocks, least, {r.block: r.n for r in sizes})


def ordered_counts(edge: DataFrame, least: tuple[int, int] = (0, 0), kept: bool = False, most: int | None = None, lines: bool = False) -> Iterator[DataFrame]:
    """``exact_counts`` with every partition in order: in one frame or, with ``most``, in one for each range of first users, which makes some ``most`` contributions (``lines``: lines, at most).

    Blocks are ranges of users here, and a partition is a cell of some blocks with some others, which counts its pairs in their order:
    nothing is sorted, and what a frame leaves on the disk can go before the next one runs. Short lists, and those with a user too large
    for a block, make one frame that is sorted. ``lines``: frames of ``value`` instead, which holds some lines of pair files, written where they are counted.
    """
    edge, n, made = sized(edge, kept)
    users = edge.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("all"), F.max("n").alias("largest")).first()
    cores = edge.sparkSession.sparkContext.defaultParallelism
    work = min(made, users["all"] * (users["all"] - 1) / 2) if lines else made
    strips = max(1, math.ceil(work / most)) if most else 1
    blocks = max(blocks_of(n, made, cores), 4 * strips if strips > 1 else 1)
    if joined(n, made, blocks) or users.largest > BLOCK_EDGES:
        enough = (F.col("buy_count") >= least[0]) | (F.col("pv_count") >= least[1])
        counts = exact_counts(edge, least, kept=True).where(enough).sortWithinPartitions("user1", "user2")
        yield lines_of(counts) if lines else counts
        return
    shares = [k / blocks for k in range(1, blocks)]
    bounds = np.array(sorted(set(edge.agg(F.percentile_approx("user_id", shares, max(10_000, 10 * blocks))).first()[0] or [])) if shares else [], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("block", pa.array(np.searchsorted(bounds, batch.column("user").to_numpy()), pa.int64()))

    # part -1: all items
    ranged = known_edges(edge, F.lit(-1).cast("long").alias("part")).mapInArrow(place, "part long, user long, item long, buy boolean, block long")
    packed = written(ranged.groupBy("block").applyInArrow(pack_block, "block long, part long, n long, edges binary"))
    blocks, start = len(bounds) + 1, 0
    fit = max(1, BLOCK_EDGES * blocks // max(n, 1))  # blocks on a side of a cell
    for strip in range(1, strips + 1):
        end, share = start, cells_before(blocks, 0, blocks) * strip / strips
        while end < blocks and (strip == strips or cells_before(end, 0, blocks) + (blocks - end) / 2 <= share):
            end += 1
        if end > start:
            found = counts_of_rows(packed, start, end, blocks, least, cores, fit, lines)
            yield found if lines else found.select(*[F.col(c).cast(edge.schema["user_id"].dataType).alias(c) for c in ("user1", "user2")], *[F.col(c).cast("bigint").alias(c) for c in ("buy_count", "pv_count")])
        start = end


def cells_before(row, start: int, blocks: int):
    """Pairs of blocks in the rows ``start`` to ``row`` of all; row i has those of block i with itself and those after it."""
    return (row - start) * blocks - (row * (row - 1) - start * (start - 1)) / 2


def counts_of_rows(packed: DataFrame, start: int, end: int, blocks: int, least: tuple[int, int], cores: int, fit: int, lines: bool) -> DataFrame:
    """Counts of the pairs whose first user is in the blocks from ``start`` to ``end``, a cell to a partition.

    A cell has some blocks on the left and, on the right, either the same ones or some after them: at most ``fit``,
    and so many that every core has two cells at least.
    """
    each = max(1, int(cells_before(end, start, blocks) // (2 * cores)))
    high = max(1, min(end - start, fit, math.isqrt(each)))
    wide = max(1, min(fit, each // high))
    rows, columns = -(-(end - start) // high), 1 + -(-(blocks - start) // wide)
    after = lambda i: min(start + (i + 1) * high, end)

    # a cell's number: its row of cells, then 0 for the blocks of the left side themselves, else the place of those after them
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = []
            for k, block in enumerate(batch.column("block").to_pylist()):
                row = (block - start) // high if block < end else rows
                if start <= block < end:
                    to += [(k, row * columns + j, 0) for j in range(1 - (after(row) - blocks) // wide)]
                if start <= block:
                    to += [(k, i * columns + 1 + (block - after(i)) // wide, 1) for i in range(row)]
            at, cell, side = np.array(to, np.int32).reshape(-1, 3).T
            yield batch.take(pa.array(at)).append_column("cell", pa.array(cell)).append_column("side", pa.array(side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[tuple, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                sides.setdefault((r["cell"], r["side"]), []).append((r["block"], r["n"], r["edges"]))
        for cell in sorted({c for c, _ in sides}):
            own = cell % columns == 0
            if (cell, 0) in sides and (own or (cell, 1) in sides):
                one, other = ([np.concatenate(x) for x in zip(*[unpack_block(*b[1:]) for b in sorted(sides[cell, side])])] for side in (0, 0 if own else 1))
                yield from line_blocks(*meetings(one, other, own, least)) if lines else counted(one, other, own, least)

    dealt = packed.select("block", "n", "edges").mapInArrow(deal, "block long, n long, edges binary, cell int, side int")
    return dealt.repartitionById(rows * columns, F.col("cell")).mapInArrow(run, "value string" if lines else "user1 long, user2 long, buy_count int, pv_count int")


def sized(edge: DataFrame, kept: bool) -> tuple[DataFrame, int, float]:
    """The edges written down, unless they are ``kept``, their number, and the contributions they make."""
    wrong = [c for c in ("user_id", "item_id") if edge.schema[c].dataType.typeName() not in ("byte", "short", "integer", "long")]
    if wrong:
        raise TypeError(f"ids must be whole numbers, not {', '.join(f'{c} {edge.schema[c].dataType.simpleString()}' for c in wrong)}")
    edge = edge if kept else written(edge)
    size = degrees(edge).agg(F.sum("n").alias("edges"), F.sum(F.expr("n * (n - 1) / 2")).alias("made")).first()
    return edge, size.edges or 0, size.made or 0


def known_edges(edge: DataFrame, *more: Column) -> DataFrame:
    """``user, item, buy`` of the edges that can meet, after ``more``."""
    known = edge.where("item_id is not null and user_id is not null")
    return known.select(*more, F.col("user_id").cast("long").alias("user"), F.col("item_id").cast("long").alias("item"), (F.col("behavior") == BUY).alias("buy"))


def joined(n_edges: int, made: float, blocks: int) -> bool:
    """Whether the join costs less than cells: time while it is small, then disk."""
    return made <= (SHORT if made < MANY else 1) * blocks * n_edges


def blocks_of(n_edges: int, made: float, cores: int = 1) -> int:
    """As many blocks of users that every core has a cell, as far as that stays cheaper than the join, and that neither a cell nor a block gets too large."""
    blocks = lambda cell: math.ceil(math.sqrt(2 * made / cell))
    enough = min(math.ceil((math.sqrt(8 * cores + 1) - 1) / 2), int(made // (SHORT * max(n_edges, 1))))
    return max(1, enough, math.ceil(n_edges / BLOCK_EDGES), min(blocks(CELL), SPREAD), blocks(LARGE_CELL))


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("user_id"), F.lit(blocks))


def cell_counts(edge: DataFrame, blocks: int, least: tuple[int, int] = (0, 0), hot: dict[int, int] | None = None) -> DataFrame:
    """``user1, user2, buy_count, pv_count`` of the pairs with at least so many buys or views, without a row per contribution.

    Users are dealt to blocks by hash. A block's edges make one compressed row, written down once. The cell of two blocks is
    a row of the product of these rows with themselves, whose tasks read both blocks where they are written: the disk holds
    no copy of a block for each of its cells. A pair meets in one cell alone, which counts it in full, a bounded number of
    contributions at a time.

    ``hot`` names blocks with too many edges for a task, as where one user has half of all edges, and how many. Their cells
    are split once more by items: every block's edges also make a row for each part of the items, parts of
    a cell count what they have of a pair, and the pair's counts are added up.
    """
    kind = edge.schema["user_id"].dataType
    hot = hot or {}
    parts = max([1, *(-(-n // BLOCK_EDGES) for n in hot.values())])
    # part -1: all items
    plain = known_edges(edge, block_of(blocks).alias("block"), F.lit(-1).cast("long").alias("part"))
    is_hot = lambda c: F.col(c).isin(list(hot)) if hot else F.lit(False)
    # whole blocks meet whole blocks, parts meet where one of the two blocks is hot
    ordered = F.col("left_block") <= F.col("right_block")
    whole = packed_blocks(plain.where(~is_hot("block")), F.col("block"), blocks)
    cells = product(whole, whole, ordered)
    if hot:
        split = plain.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
        which = F.array_position(F.array(*map(F.lit, sorted(hot))), F.col("block")) - 1
        some = packed_blocks(split.where(is_hot("block")), which * parts + F.col("part"), len(hot) * parts)
        every = packed_blocks(split, F.col("block"), blocks)
        cells = cells.unionByName(product(some, every, (F.col("left_part") == F.col("right_part")) & (ordered | ~is_hot("right_block"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                own, whole = value("left_block") == value("right_block"), value("left_part") < 0
                side = unpack_block(value("left_n"), value("left_edges"))
                other = side if own else unpack_block(value("right_n"), value("right_edges"))
                for found in counted(side, other, own, least if whole else (0, 0)):
                    yield found.append_column("whole", pa.array(np.full(found.num_rows, whole)))

    made = cells.mapInArrow(run, "user1 long, user2 long, buy_count int, pv_count int, whole boolean")
    named = made.select(*[F.col(c).cast(kind).alias(c) for c in ("user1", "user2")], *[F.col(c).cast("bigint").alias(c) for c in ("buy_count", "pv_count")], "whole")
    if not hot:
        return named.drop("whole")
    named = cut(named)
    added = named.where("not whole").groupBy("user1", "user2").agg(*[F.sum(c).alias(c) for c in ("buy_count", "pv_count")])
    enough = F.lit(True) if 0 in least else (F.col("buy_count") >= least[0]) | (F.col("pv_count") >= least[1])
    return named.where("whole").drop("whole").unionByName(added.where(enough))


def packed_blocks(rows: DataFrame, number: Column, count: int) -> DataFrame:
    """``block, part, n, edges``: a compressed row for each, written down in a partition for each of ``count`` numbers, as far as there are tasks for all cells.

    An edge takes a byte or two; the shuffles that made them are dropped.
    """
    places = min(count, math.isqrt(TASKS))
    with dropped_shuffles(rows.sparkSession):
        packed = rows.groupBy("block", "part").applyInArrow(pack_block, "block long, part long, n long, edges binary")
        return cut(packed.repartitionById(places, (number % places).cast("int")))


def product(left: DataFrame, right: DataFrame, meet: Column) -> DataFrame:
    """Rows that ``meet``, a task for each partition of ``left`` with each of ``right``, which it reads where they are written: nothing is shuffled."""
    a, b = (df.select(*[F.col(c).alias(side + c) for c in df.columns]) for df, side in ((left, "left_"), (right, "right_")))
    return a.join(b.hint("shuffle_replicate_nl"), meet)


def pack_block(table: pa.Table) -> pa.Table:
    """A block's edges in the order of its users, compressed."""
    user, item, buy = (table.column(c).to_numpy() for c in ("user", "item", "buy"))
    order = np.lexsort((item, buy, user))
    data = user[order].astype("<i8").tobytes() + item[order].astype("<i8").tobytes() + buy[order].astype(np.uint8).tobytes()
    return pa.table({"block": table.column("block").slice(0, 1), "part": table.column("part").slice(0, 1), "n": pa.array([len(order)], pa.int64()), "edges": pa.array([pa.compress(data, codec="zstd", asbytes=True)], pa.binary())})


def unpack_block(n: int, edges: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = pa.decompress(edges, decompressed_size=17 * n, codec="zstd", asbytes=True)
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n), np.frombuffer(data, np.uint8, n, 16 * n).astype(bool)


def counted(left: tuple, right: tuple, own: bool, least: tuple[int, int] = (0, 0)) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of a user of ``left`` and one of ``right``; ``own``: both are one block, each pair once."""
    user, partner, found = meetings(left, right, own, least)
    for x, y, bought, pv in found:
        x, y = user[x], partner[y]
        yield pa.RecordBatch.from_pydict({"user1": np.minimum(x, y), "user2": np.maximum(x, y), "buy_count": bought.astype(np.int32), "pv_count": pv.astype(np.int32)})


def meetings(left: tuple, right: tuple, own: bool, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, ...]]]:
    """The users of ``left``, those of ``right``, and the pairs of ``counted``: their places there, common buys and views, in order."""
    user, place = np.unique(left[0], return_inverse=True)
    partner, number = np.unique(right[0], return_inverse=True)
    return user, partner, met(left, right, user, place, partner, number, own, least)


def met(left: tuple, right: tuple, user: np.ndarray, place: np.ndarray, partner: np.ndarray, number: np.ndarray, own: bool, least: tuple[int, int]) -> Iterator[tuple[np.ndarray, ...]]:
    """The pairs of ``meetings``; ``place`` and ``number``: the edges' users.

    Groups that make many contributions for the pairs there are become bits, 64 groups to a word, and are
    counted for all pairs; the contributions of the others are counted one by one.
    """
    # groups (an item's buyers or viewers) as numbers from 0
    items, code = np.unique(np.concatenate([left[1], right[1]]), return_inverse=True)
    code = 2 * code + np.concatenate([left[2], right[2]])  # odd: buys
    mine, theirs = code[: len(place)], code[len(place) :]
    # users of the right side in each group, and contributions that it makes
    met_by = np.bincount(theirs, minlength=2 * len(items))
    made = np.bincount(mine, minlength=2 * len(items)) * met_by
    once = made.copy()
    once[np.concatenate([repeated(mine, place), repeated(theirs, number)])] = 0  # a bit can't say how often
    packed = [wide_groups(once, buy, len(user), len(partner)) for buy in (0, 1)]
    bits = [(words_of(groups, mine, place, len(user)), words_of(groups, theirs, number, len(partner))) for groups in packed]
    # what is left for counting one by one: the left side's edges in groups without bits
    made[np.concatenate(packed)] = 0
    some = made[mine] > 0
    place, mine = place[some], mine[some]
    # the right side's users by group; an edge of the left side meets a run of them
    those = number[np.argsort(theirs, kind="stable")]
    size = met_by[mine]
    first = np.cumsum(met_by)[mine] - size
    ends = np.concatenate([[0], np.cumsum(size)])
    edge_of = np.searchsorted(place, np.arange(len(user) + 1))  # each user's first edge
    upto = ends[edge_of]
    wide = any(map(len, packed))
    u = 0
    while u < len(user):
        # users u to v, as many as make AT_ONCE contributions, or PAIRS pairs where bits are counted
        v = max(u + 1, int(np.searchsorted(upto, upto[u] + AT_ONCE, "right")) - 1)
        if wide:
            v = min(v, u + max(1, PAIRS // len(partner)))
        a, b = edge_of[u], edge_of[v]
        # one element per contribution: the user x, its partner y, and whether both bought
        x = np.repeat(place[a:b], size[a:b])
        y = those[np.repeat(first[a:b] - ends[a:b], size[a:b]) + np.arange(ends[a], ends[b])]
        buy = np.repeat(mine[a:b] % 2 == 1, size[a:b])
        if own:
            later = y > x
            x, y, buy = x[later], y[later], buy[later]
        # a pair's place in a grid of users u to v by partners; a block by itself has no partner up to u
        start = u + 1 if own and wide else 0
        width = len(partner) - start
        key = (x - u) * width + y - start
        # the whole grid is counted where there are bits or it is a quarter full, else only the pairs that there are
        if wide or 4 * len(key) > (v - u) * width:
            pv, bought = (tally(*bits[b], u, v, start, key[buy == b]) for b in (0, 1))
            keep = passing(bought, pv, least).reshape(v - u, width)
            if start:
                keep &= np.arange(start, len(partner)) > np.arange(u, v)[:, None]
            pair, per_user = np.flatnonzero(keep), keep.sum(1)
            bought, pv = bought[pair], pv[pair]
            x, y = np.repeat(np.arange(u, v), per_user), pair + np.repeat(start - np.arange(v - u) * width, per_user)
        else:
            pair, at, total = np.unique(key, return_inverse=True, return_counts=True)
            bought = np.bincount(at[buy], minlength=len(pair))
            keep = passing(bought, total - bought, least)
            pair, bought, pv = pair[keep], bought[keep], (total - bought)[keep]
            x, y = u + pair // width, start + pair % width
        if len(pair):
            yield x, y, bought, pv
        u = v


def passing(bought: np.ndarray, pv: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Whether a pair has something in common, and enough buys or views."""
    if 0 in least:
        return (bought > 0) | (pv > 0)
    return (bought >= least[0]) | (pv >= least[1])


def repeated(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Groups that hold a user twice."""
    users = int(place.max(initial=0)) + 1
    edge = np.sort(code * users + place)
    return edge[1:][edge[1:] == edge[:-1]] // users


def wide_groups(made: np.ndarray, buy: int, users: int, partners: int) -> np.ndarray:
    """Groups of buys or of views, 64 to a word, that are counted sooner by bits of all pairs than by their contributions."""
    groups = 2 * np.flatnonzero(made[buy::2]) + buy
    groups = groups[np.argsort(-made[groups], kind="stable")]
    saved = [made[groups[i : i + 64]].sum() * BITS > users * partners for i in range(0, len(groups), 64)]
    return groups[: 64 * min(sum(saved), WORDS // (users + partners))]


def words_of(groups: np.ndarray, code: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The edges in ``groups`` as bits: a row for each word, a column for each of ``n`` users."""
    words = np.zeros((-(-len(groups) // 64), n), np.uint64)
    if len(groups):
        order = np.argsort(groups)
        at = np.minimum(np.searchsorted(groups[order], code), len(groups) - 1)
        known = groups[order][at] == code
        bit = order[at[known]]
        np.bitwise_or.at(words, (bit // 64, place[known]), np.uint64(1) << (bit % 64).astype(np.uint64))
    return words


def tally(mine: np.ndarray, theirs: np.ndarray, u: int, v: int, start: int, key: np.ndarray) -> np.ndarray:
    """For users ``u`` to ``v`` and partners from ``start``: common bits, and how often ``key`` names the pair."""
    n = (v - u) * (theirs.shape[1] - start)
    if len(key) or not len(mine):
        out = np.bincount(key, minlength=n)
    else:
        out = np.zeros(n, np.uint8 if len(mine) < 4 else np.int32)  # three words have 192 bits
    grid = out.reshape(v - u, -1) if n else out
    for a, b in zip(mine, theirs):
        grid += np.bitwise_count(a[u:v, None] & b[start:]) if n else 0
    return out
