"""User-complete sampling of an event log to a byte budget.

Users are classed by activity, and whole profiles are added greedily in a fixed order, a
profile that no longer fits being skipped. The walk is sequential by definition, yet few
jobs find its result. Ranges of the order, on executors, are summed up; the profiles that fit one
after the other from the start are a prefix, found from these sums. From then on the walk goes down by powers of
two: while ``room`` bytes are left, with ``2**c <= room < 2**(c + 1)``, every profile below ``2**c`` bytes fits,
and at most one larger one can still come in, after which the room is below ``2**c``. So the next
place where the room falls below is the first at which either the small profiles' running
sum has used it up or a larger profile fits, and both are found from the ranges' sums and one pass
over the profiles. Each power takes one round at most, whatever the number of profiles.
What is taken is told by bounds of the order and sizes, never as a list of users.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SamplerConfig
from ..functions.columns import stable_hash_hex
from .lineage import cut

def user_stats(events: DataFrame) -> DataFrame:
    """``user_id, projected_bytes, total, useful, buy, fav``; the bytes are those of the output lines."""
    size = F.length("user") + F.length("item") + F.length("behavior") + F.length("ts") + 4
    buy, fav = ((F.col("behavior") == b).cast("bigint") for b in ("buy", "fav"))
    return events.groupBy("user_id").agg(F.sum(size.cast("bigint")).alias("projected_bytes"), F.count("*").alias("total"), F.sum(buy + fav).alias("useful"), F.sum(buy).alias("buy"), F.sum(fav).alias("fav"))


#: Equal ranges that a round of ``nearest_rank`` counts values in.
RANGES = 1024


def nearest_rank(stats: DataFrame, column: str, fractions: dict[str, float]) -> dict[str, int]:
    """Values at ``round_half_even((n - 1) * fraction)`` of the sorted column; 0 for no rows.

    Each round counts the values in equal ranges of what is left for each rank, and goes on in the range that
    holds it: seven rounds at most for whole numbers of 64 bits, and no row is sorted.
    """
    facts = stats.agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    if not facts.n:
        return dict.fromkeys(fractions, 0)
    left = {name: (int(facts.low), int(facts.high), round((facts.n - 1) * f)) for name, f in fractions.items()}
    while any(low < high for low, high, _ in left.values()):
        at = []
        for low, high, _ in left.values():
            width = (high - low) // RANGES + 1
            inside = F.col(column).between(low, high)
            at.append(F.when(inside, F.expr(f"(cast(`{column}` as decimal(20,0)) - {low}BD) div {width}BD").cast("int")))
        counts: list[dict[int, int]] = [{} for _ in at]
        for r in stats.select(F.posexplode(F.array(*at))).where("col is not null").groupBy("pos", "col").agg(F.count("*").alias("m")).collect():
            counts[r.pos][r.col] = r.m
        for (name, (low, high, rank)), own in zip(list(left.items()), counts):
            width = (high - low) // RANGES + 1
            for k in sorted(own):
                if rank < own[k]:
                    left[name] = (low + k * width, min(high, low + (k + 1) * width - 1), rank)
                    break
                rank -= own[k]
    return {name: low for name, (low, _, _) in left.items()}


def thresholds(stats: DataFrame) -> dict[str, int]:
    useful = nearest_rank(stats, "useful", {"useful_p10": 0.10, "useful_p95": 0.95})
    return useful | nearest_rank(stats, "total", {"total_p25": 0.25, "total_p95": 0.95})


def user_class(limits: dict[str, int]) -> Column:
    low = (F.col("useful") <= max(1, limits["useful_p10"])) & (F.col("total") <= limits["total_p25"])
    high = (F.col("useful") >= max(2, limits["useful_p95"])) | (F.col("total") >= limits["total_p95"])
    return F.when(low, "low").when(high, "high").when(F.col("useful") >= 2, "regular").otherwise("low")


def anchor_items(events: DataFrame, core: DataFrame) -> DataFrame:
    """Distinct ``(item_id, behavior)`` of buy and fav events of core users."""
    return events.where(F.col("behavior").isin("buy", "fav")).join(core.select("user_id"), "user_id", "left_semi").select("item_id", "behavior").distinct()


def neighbour_scores(events: DataFrame, anchors: DataFrame, core: DataFrame, regular: DataFrame) -> DataFrame:
    """``user_id, score``: anchor events, repeats included, of regular users outside of the core."""
    hits = events.where(F.col("behavior").isin("buy", "fav")).join(anchors, ["item_id", "behavior"], "left_semi")
    others = regular.select("user_id").join(core.select("user_id"), "user_id", "left_anti")
    return hits.join(others, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("score"))


@dataclass(frozen=True)
class Place:
    """A profile in the order of a walk: by score down, then by hash up."""

    part: int
    score: int
    h: str


def beyond(place: Place | None) -> Column:
    """The profiles after ``place``."""
    if place is None:
        return F.lit(True)
    return (F.col("score") < place.score) | (F.col("score") == place.score) & (F.col("h") > place.h)


@dataclass(frozen=True)
class Stop:
    """Where a round ends: the profile there, bytes taken up to it by others, and whether and as which it is taken."""

    place: Place
    before: int
    size: int
    taken: bool


def first_stop(left: DataFrame, starts: dict[int, int], small: int, room: int, least: int, need: int | None) -> Stop | None:
    """The first profile of ``left(part, score, h, size)`` at which a round ends.

    Profiles below ``small`` bytes are taken one after the other, ``starts`` tells the bytes of those in earlier ranges. A round ends
    at the first that does not fit, that leaves less than ``least`` bytes of ``room``, that makes ``need`` bytes full, or at
    a larger one that fits. All ranges look at once, each in its own order; the first one's answer counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, int] = {}  # bytes so far of a range; None once it has stopped
        for batch in batches:
            part, score, size = (batch.column(c).to_numpy() for c in ("part", "score", "size"))
            for p in np.unique(part).tolist():
                if done.get(p, 0) is None:
                    continue
                own = np.flatnonzero(part == p)
                low = size[own] < small
                upto = starts[p] + done.get(p, 0) + np.cumsum(np.where(low, size[own], 0))
                ends = np.where(low, (upto > room - least) | (upto >= (need or FULL)), upto + size[own] <= room)
                at = np.flatnonzero(ends)
                if len(at):
                    k, i = int(at[0]), int(own[at[0]])
                    before = int(upto[k] - (size[i] if low[k] else 0))
                    yield pa.RecordBatch.from_pydict({"part": [p], "score": [int(score[i])], "h": [batch.column("h")[i].as_py()], "before": [before], "size": [int(size[i])], "taken": [before + int(size[i]) <= room]})
                    done[p] = None
                else:
                    done[p] = int(upto[-1]) - starts[p]

    found = left.select("part", "score", "h", "size").mapInArrow(run, "part long, score long, h string, before long, size long, taken boolean").orderBy("part").limit(1).collect()
    return Stop(Place(found[0].part, found[0].score, found[0].h), found[0].before, found[0].size, found[0].taken) if found else None


#: More bytes than there are.
FULL = 1 << 62


def greedy(candidates: DataFrame, used: int, budget: int, stop: int | None = None) -> tuple[DataFrame, int]:
    """Walk ``candidates(user_id, size, score, h)`` by score down, then hash up; take what fits into ``budget``.

    With ``stop`` the walk ends as soon as that many bytes are used. Returns the users taken
    and the bytes then used. Hashes of two users must differ.
    """
    # sorted into ranges, which stay as they are once written
    rows = cut(candidates.select("user_id", F.col("size").cast("bigint").alias("size"), F.col("score").cast("bigint").alias("score"), "h").orderBy(F.desc("score"), "h").withColumn("part", F.spark_partition_id()))
    taken, after, first = F.lit(False), None, True
    while stop is None or used < stop:
        room = budget - used
        if room < 0:
            break
        left = rows.where(beyond(after) & (F.col("size") <= room))
        # at first all are small: what fits one after the other is taken
        small, least = (FULL, 0) if first else (1 << max(room, 1).bit_length() - 1, 1 << max(room, 1).bit_length() - 1)
        sums = left.groupBy("part").agg(F.sum("size").alias("all"), F.sum(F.when(F.col("size") < small, F.col("size")).otherwise(0)).alias("small")).orderBy("part").collect()
        if not sums:
            break
        need = None if stop is None else stop - used
        if sum(r["all"] for r in sums) <= room and (need is None or sum(r["all"] for r in sums) < need):
            taken, used = taken | beyond(after) & (F.col("size") <= room), used + sum(r["all"] for r in sums)
            break
        starts, running = {}, 0
        for r in sums:
            starts[r.part] = running
            running += r.small
        end = first_stop(left, starts, small, room, least, need)
        inside = beyond(after) & (F.col("size") < min(small, room + 1))
        if end is None:  # the small ones leave room, and no larger one fits
            taken, used = taken | inside, used + running
            break
        at = (F.col("score") == end.place.score) & (F.col("h") == end.place.h)
        taken = taken | inside & ~beyond(end.place) & ~at
        used += end.before
        if end.taken:
            taken, used = taken | at, used + end.size
        after, first = end.place, False
    return rows.where(taken).select("user_id"), used


@dataclass
class Selection:
    """The users taken, by stage, and what is known about the walk."""

    users: DataFrame  # user_id, stage
    used: int
    limits: dict[str, int]
    composition: dict[str, int] = field(default_factory=dict)


def select_users(events: DataFrame, cfg: SamplerConfig) -> Selection:
    """Core, neighbours, low and high outliers, then the rest, each to its share of the target.

    Stages are kept apart by anti-joins, and each ends at a checkpoint.
    """
    cfg.validate()
    spark: SparkSession = events.sparkSession
    stats = cut(user_stats(events))
    limits = thresholds(stats)
    classed = stats.select("user_id", F.col("projected_bytes").alias("size"), user_class(limits).alias("kind"))
    chosen = spark.createDataFrame([], "user_id long, stage string")
    used = 0

    def walk(stage: str, pool: DataFrame, salt: int, end: int, stop: int | None = None, scored: bool = False) -> DataFrame:
        nonlocal chosen, used
        score = F.col("score") if scored else F.lit(0).cast("bigint")
        rows = pool.join(chosen.select("user_id"), "user_id", "left_anti").select("user_id", "size", score.alias("score"), stable_hash_hex(F.col("user_id"), cfg.seed + salt).alias("h"))
        taken, used = greedy(rows, used, min(end, cfg.max_bytes), stop)
        taken = cut(taken.withColumn("stage", F.lit(stage)))
        chosen = cut(chosen.unionByName(taken))
        return taken

    target = cfg.target_bytes
    of = lambda kind: classed.where(F.col("kind") == kind)
    core = walk("core", of("regular"), 0, int(target * 0.70))
    anchors = cut(anchor_items(events, core))
    near = cut(classed.join(neighbour_scores(events, anchors, core, of("regular")), "user_id"))
    walk("neighbor", near, 1, int(target * 0.90), scored=True)
    walk("low", of("low"), 2, int(target * 0.95))
    walk("high", of("high"), 3, target)
    walk("fill", near, 1, target, scored=True)
    if used < target:
        walk("fill", classed, 4, target)
    if used < cfg.min_bytes:
        walk("fill", classed, 5, cfg.max_bytes, stop=cfg.min_bytes)
    if used < cfg.min_bytes:
        raise RuntimeError(f"could not reach the minimum size: {used} of {cfg.min_bytes} bytes")
    counts = {r.stage: r.n for r in chosen.groupBy("stage").agg(F.count("*").alias("n")).collect()}
    composition = {f"{name}_users": counts.get(stage, 0) for name, stage in (("core", "core"), ("neighbor", "neighbor"), ("low_outlier", "low"), ("high_outlier", "high"), ("fill", "fill"))}
    composition |= {"total_selected_users": sum(counts.values()), "anchor_item_behavior_keys": anchors.count(), "neighbor_candidates": near.count()}
    return Selection(chosen, used, limits, composition)


def keep_users(events: DataFrame, selected: DataFrame) -> DataFrame:
    """All events of the selected users, repeats and all."""
    return events.join(selected.select("user_id"), "user_id", "left_semi")
