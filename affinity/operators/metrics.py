"""Counters of every stage: sums that a run adds up while it writes, or one-row and few-row DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import BUY, PV, EngineConfig
from ..functions.columns import is_finite
from .lineage import own_session
from .postings import planned


class Watch:
    """Counters of the rows that pass chosen places of a plan, added up by the job that runs it.

    Each watched frame must be run once, and to its end. A task that is run again because an executor was
    lost may count twice, as in all of Spark's observed metrics.
    """

    def __init__(self) -> None:
        self.seen: list[Observation] = []

    def on(self, df: DataFrame, *columns: Column) -> DataFrame:
        self.seen.append(Observation())
        return df.observe(self.seen[-1], *columns)

    def counters(self) -> dict[str, int]:
        """All counters by name, once the jobs are done."""
        return {name: int(n or 0) for o in self.seen for name, n in o.get.items()}


#: Would replace a plan found to be empty, and the places in it.
DROPS_EMPTY = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


def watched_session(spark: SparkSession) -> SparkSession:
    """A session in which the places that a ``Watch`` chose are there to the end of a run."""
    name = "spark.sql.adaptive.optimizer.excludedRules"
    return own_session(spark, {name: ",".join(filter(None, [spark.conf.get(name, None), DROPS_EMPTY]))})


STATUSES = ("BUY", "PV", "FILTERED", "HEADER", "INVALID")


def parse_tallies() -> list[Column]:
    return [tally(f"records_{s.lower()}", F.col("status") == s) for s in STATUSES]


def parse_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("status").agg(F.count("*").alias("records"))


def tally(name: str, condition=None, value=None):
    """A sum of ``value`` (1 without) over rows that meet ``condition``; 0 for no rows."""
    value = F.lit(1) if value is None else value
    return F.coalesce(F.sum(F.when(condition, value) if condition is not None else value), F.lit(0)).cast("bigint").alias(name)


def posting_tallies(cfg: EngineConfig) -> list[Column]:
    """Lists emitted and dropped, distinct edges, potential and planned pairs, over all groups with their plan."""
    cap, n = cfg.max_users_per_item, F.col("n")
    above = (n > cap) & F.lit(cap > 0)
    of = lambda b: (F.col("behavior") == b) & (n >= 2) & ~above
    kinds = (("emitted", "posting_lists", None), ("distinct", "edges", n), ("potential", "all_pairs", F.col("potential")), ("planned", "pair_contributions", F.col("planned")))
    columns = [tally(f"{what}_{b}_{kind}", of(b), value) for b in ("buy", "pv") for what, kind, value in kinds]
    return [*columns, tally("items_with_less_than_two_users", (n < 2) & ~above), tally("items_above_hard_max_users", above)]


def posting_counts(degree: DataFrame, cfg: EngineConfig) -> DataFrame:
    """``posting_tallies`` in one pass over the degrees."""
    return planned(degree, cfg).agg(*posting_tallies(cfg))


def plan_tallies(kind: str | None = None, usable: Column | None = None) -> list[Column]:
    """Exact and sampled lists, pairs not generated, odd degrees adjusted; of one behavior, under its name, if told."""
    own = F.lit(True) if kind is None else (F.col("behavior") == kind) & usable
    name = "" if kind is None else f"{kind}_"
    parts = (("exact_lists", own & ~F.col("sampled"), None), ("sampled_lists", own & F.col("sampled"), None), ("not_generated", own, F.col("potential") - F.col("planned")), ("odd_adjusted", own & F.col("odd_adjusted"), None))
    return [tally(name + what, condition, value) for what, condition, value in parts]


def generated_tallies() -> list[Column]:
    return [tally(f"{b}_generated", F.col("behavior") == b) for b in (BUY, PV)]


def pairing_counts(plan: DataFrame, contributions: DataFrame) -> DataFrame:
    """Exact and sampled lists, pairs generated and not generated, odd degrees adjusted, by behavior."""
    groups = plan.groupBy("behavior").agg(*plan_tallies())
    made = contributions.groupBy("behavior").agg(F.count("*").alias("generated"))
    return groups.join(made, "behavior", "left").select("behavior", "exact_lists", "sampled_lists", F.coalesce("generated", F.lit(0)).alias("generated"), "not_generated", "odd_adjusted")


def score_tallies(cfg: EngineConfig) -> list[Column]:
    low = F.col("score") < cfg.min_score
    return [tally("emitted_pairs", ~low), tally("filtered_by_score", low)]


def score_counts(scored: DataFrame, cfg: EngineConfig) -> DataFrame:
    return scored.agg(*score_tallies(cfg))


def candidate_tallies() -> list[Column]:
    self_pair, bad = F.col("user1") == F.col("user2"), ~is_finite(F.col("score"))
    return [tally("directed_candidates", ~self_pair & ~bad, F.lit(2)), tally("self_pairs", self_pair), tally("invalid_scores", ~self_pair & bad)]


def candidate_counts(scored: DataFrame) -> DataFrame:
    return scored.agg(*candidate_tallies())


def list_tallies(k: int) -> list[Column]:
    """Over the users' lists: how many there are, how many are short, and what they hold."""
    size = F.size("top")
    return [tally("users_emitted"), tally("candidates_kept", None, size), tally("users_with_fewer_than_k", size < k)]


def top_counts(candidates: DataFrame, k: int) -> DataFrame:
    """Users emitted, candidates seen and dropped, users with fewer than k."""
    seen = candidates.groupBy("user_id").agg(F.count("*").alias("seen"))
    return seen.agg(tally("users_emitted"), tally("candidates_seen", None, F.col("seen")), tally("users_with_fewer_than_k", F.col("seen") < k), tally("candidates_dropped", None, F.greatest(F.col("seen") - k, F.lit(0))))


#: Bytes of lines that are parsed at once.
PIECE = 1 << 18


def line_order(spark: SparkSession, place: str) -> DataFrame:
    """``lines, misplaced`` of files of pair lines: how many there are, and how many stand before a smaller one of their file.

    A file is read by one task, piece by piece; ``writers.write_lines`` bounds the files it writes.
    """
    files = spark.read.format("binaryFile").load(place).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                lines, misplaced = order_of(content.as_py())
                yield pa.RecordBatch.from_pydict({"lines": [lines], "misplaced": [misplaced]})

    found = files.mapInArrow(run, "lines long, misplaced long")
    return found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "misplaced")])


def order_of(text: bytes) -> tuple[int, int]:
    """Lines of a text, which ends with a line's end, and how many stand before a smaller one."""
    lines = misplaced = start = 0
    before = None
    while start < len(text):
        size = PIECE
        while (end := text.rfind(b"\n", start, start + size)) < 0:
            if start + size >= len(text):
                raise ValueError("the last line has no end")
            size *= 2
        piece = np.frombuffer(text, np.uint8, end + 1 - start, start)
        # a comma, a tab, a comma and the end of each line; all other bytes are digits and signs
        marks = np.flatnonzero(piece < 45)
        if len(marks) % 4 or (piece[marks].view("<u4") != int.from_bytes(b",\t,\n", "little")).any():
            raise ValueError("lines of pairs are u1,u2<TAB>buy,pv")
        comma, tab, line_end = marks[::4], marks[1::4], marks[3::4]
        a, b = numbers(piece, np.concatenate([[0], line_end[:-1] + 1]), comma), numbers(piece, comma + 1, tab)
        misplaced += np.count_nonzero((a[:-1] > a[1:]) | (a[:-1] == a[1:]) & (b[:-1] > b[1:]))
        misplaced += before is not None and before > (a[0], b[0])
        lines, before, start = lines + len(a), (a[-1], b[-1]), end + 1
    return lines, int(misplaced)


def numbers(text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The whole numbers that stand from ``begins`` to ``ends``, digit by digit from the last one."""
    signed = text[begins] == 45
    size = ends - begins - signed
    least, out, at = size.min(), np.zeros(len(ends), np.int64), ends.copy()
    for k in range(size.max()):
        at -= 1
        digit = text[at].astype(np.int64) - 48 if k < least else np.where(k < size, text[at], 48).astype(np.int64) - 48
        out += digit * 10**k
    return np.where(signed, -out, out) if signed.any() else out
