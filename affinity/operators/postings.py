"""Distinct users per (item, behavior): edges, degrees, posting lists and the pair forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BUY, EngineConfig
from ..functions.columns import potential_pairs

KEY = ["item_id", "behavior"]


def edges(obs: DataFrame) -> DataFrame:
    """Distinct ``(item_id, behavior, user_id)`` of buy and pv.

    Dealt by all three columns with a map-side combine, so no popular item lands in one task.
    """
    return obs.where(F.col("behavior").isin("buy", "pv")).select("item_id", "behavior", "user_id").distinct()


def degrees(edge: DataFrame) -> DataFrame:
    """``(item_id, behavior, n)`` distinct users of every group."""
    return edge.groupBy(*KEY).agg(F.count("*").alias("n"))


def usable(degree: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Groups with two users at least and, where a cap is set, not above it."""
    kept = degree.where("n >= 2")
    return kept.where(F.col("n") <= cfg.max_users_per_item) if cfg.max_users_per_item > 0 else kept


def posting_lists(edge: DataFrame, cfg: EngineConfig) -> DataFrame:
    """``(item_id, behavior, users)``: sorted distinct users of usable groups, for output; pairing uses the edges."""
    lists = edge.groupBy(*KEY).agg(F.array_sort(F.collect_set("user_id")).alias("users"))
    return usable(lists.withColumn("n", F.size("users").cast("bigint")), cfg).drop("n")


#: Users of a chunk of a posting list.
CHUNK = 4096


def posting_chunks(edge: DataFrame, degree: DataFrame, size: int = CHUNK) -> DataFrame:
    """``item_id, behavior, chunk, first, last, n, users``: posting lists of ``degree``'s groups in chunks of at most ``size`` ordered users.

    A list longer than a chunk is cut into equal ranges of its users' ids before it is ordered, so many
    tasks order it and no row holds it whole. Chunks follow each other by their numbers, which may leave some out.
    """
    bounds = edge.groupBy(*KEY).agg(F.min("user_id").alias("low"), F.max("user_id").alias("high"))
    at = {c: F.col(c).cast("double") for c in ("user_id", "low", "high")}  # rounding keeps the order
    place = F.floor((at["user_id"] - at["low"]) * F.expr(f"2 * (n div {size}) + 1") / (at["high"] - at["low"] + 1))
    part = F.when(F.col("n") > size, place).otherwise(F.lit(0)).cast("bigint")
    ranged = edge.join(degree.select(*KEY, "n").join(bounds, KEY), KEY).select(*KEY, "user_id", part.alias("part"))
    own = F.row_number().over(Window.partitionBy(*KEY, "part").orderBy("user_id")) - 1
    numbered = ranged.select(*KEY, "user_id", (F.col("part") * (1 << 32) + F.floor(own / size)).cast("bigint").alias("chunk"))
    users = numbered.groupBy(*KEY, "chunk").agg(F.array_sort(F.collect_list("user_id")).alias("users"))
    return users.select(*KEY, "chunk", F.element_at("users", 1).alias("first"), F.element_at("users", -1).alias("last"), F.size("users").cast("bigint").alias("n"), "users")


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """The edges that ``posting_chunks`` holds."""
    return chunks.select(*KEY, F.explode("users").alias("user_id"))


def by_behavior(limits: dict[str, int]) -> Column:
    return F.when(F.col("behavior") == BUY, F.lit(limits["buy"])).otherwise(F.lit(limits["pv"])).cast("bigint")


def pair_plan(degree: DataFrame, cfg: EngineConfig) -> DataFrame:
    """What pairing will do with each usable group."""
    return planned(usable(degree, cfg), cfg)


def planned(degree: DataFrame, cfg: EngineConfig) -> DataFrame:
    """What pairing would do with each group, without generating a pair.

    Adds ``sampled`` (the group is above its exact limit), ``k`` (partners of each user,
    n - 1 for all), ``odd_adjusted``, ``potential`` and ``planned`` pairs.
    """
    limit, asked = by_behavior(cfg.exact_limits), by_behavior(cfg.neighbours)
    known = degree.withColumn("sampled", (limit >= 0) & (F.col("n") > limit))
    k0 = F.when(F.col("sampled"), F.least(F.greatest(asked, F.lit(0)), F.col("n") - 1)).otherwise(F.col("n") - 1)
    odd = (F.col("k0") < F.col("n") - 1) & (F.col("n") % 2 == 1) & (F.col("k0") % 2 == 1)
    full = known.withColumn("k0", k0).withColumn("odd_adjusted", odd).withColumn("k", F.col("k0") - odd.cast("bigint"))
    return full.select(*KEY, "n", "sampled", "k", "odd_adjusted", potential_pairs("n").alias("potential"), F.expr("cast(n * k div 2 as bigint)").alias("planned"))
