"""The engine's two pipelines and the sampler, plans from log to result; runs that write count their steps as they go."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import BUY, PV, EngineConfig, SamplerConfig
from ..operators import metrics, pairs, postings, ranking, sampler
from ..operators.lineage import cut, written
from ..sources import readers, writers


def pair_counts(obs: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Exact common buys and views of every pair of users that passes the thresholds.

    Asking for it runs the jobs up to the edges, and those that pack the edges of large groups.
    """
    cfg.validate()
    return ranking.passing_counts(pairs.exact_counts(pairs.capped_edges(obs, cfg), (cfg.min_buy, cfg.min_pv)), cfg)


def ordered_pair_lines(obs: DataFrame, cfg: EngineConfig) -> Iterator[DataFrame]:
    """Lines of ``pair_counts`` in frames of a range of first users each, every partition in the order of its pairs; a ``value`` may hold many lines."""
    cfg.validate()
    return pairs.ordered_counts(pairs.capped_edges(obs, cfg), (cfg.min_buy, cfg.min_pv), most=pairs.STRIP, lines=True)


def pair_scores(obs: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Weighted scores over exact and bounded pairs, from ``min_score`` on."""
    cfg.validate()
    return ranking.passing_scores(ranking.scores(pairs.count_pairs(pairs.hybrid_pairs(obs, cfg)), cfg), cfg)


def similar_users(obs: DataFrame, cfg: EngineConfig | None = None) -> DataFrame:
    """``user_id, rank, similar_user, score``: each user's most similar users."""
    cfg = cfg or EngineConfig()
    return ranking.top_k(ranking.directed(pair_scores(obs, cfg)), cfg.top_k)


@dataclass
class Run:
    """What a run has written, and the counters of its steps, added up while it wrote."""

    result: DataFrame
    counters: dict[str, int]


def watched_edges(lines: DataFrame, cfg: EngineConfig, watch: metrics.Watch) -> tuple[DataFrame, DataFrame]:
    """The log's edges and the plan of its usable groups, both written down: the lines are read once."""
    parsed = watch.on(readers.parse(lines, cfg), *metrics.parse_tallies())
    edge = written(postings.edges(readers.observations(parsed)))
    groups = postings.planned(postings.degrees(edge), cfg)
    below_cap = F.col("n") <= cfg.max_users_per_item if cfg.max_users_per_item > 0 else F.lit(True)
    tallies = [t for b in (BUY, PV) for t in metrics.plan_tallies(b, (F.col("n") >= 2) & below_cap)]
    return edge, postings.usable(cut(watch.on(groups, *metrics.posting_tallies(cfg), *tallies)), cfg)


def watched_scores(edge: DataFrame, plan: DataFrame, cfg: EngineConfig, watch: metrics.Watch) -> DataFrame:
    made = watch.on(pairs.planned_pairs(edge, plan, cfg), *metrics.generated_tallies())
    scored = watch.on(ranking.scores(pairs.count_pairs(made), cfg), *metrics.score_tallies(cfg))
    return ranking.passing_scores(scored, cfg)


def watched_lists(passing: DataFrame, cfg: EngineConfig, watch: metrics.Watch) -> DataFrame:
    known = watch.on(passing, *metrics.candidate_tallies())
    return watch.on(ranking.top_lists(ranking.top_k(ranking.directed(known), cfg.top_k)), *metrics.list_tallies(cfg.top_k))


def top_counters(watch: metrics.Watch) -> dict[str, int]:
    """The counters of a top run; what a list dropped is what it saw less what it kept."""
    out = watch.counters()
    kept = out.pop("candidates_kept")
    return out | {"candidates_seen": out["directed_candidates"], "candidates_dropped": out["directed_candidates"] - kept}


def run_counts(spark: SparkSession, source: str, target: str, cfg: EngineConfig, min_partitions: int | None = None, persist: bool = False, ordered: bool = False) -> Run:
    """Lines in, ``u1,u2<TAB>buy,pv`` lines out; the pairs are kept for further use where ``persist`` is set.

    ``ordered``: every file in the order of its pairs. Counters: the parser's, those of the posting lists, and pairs generated, emitted and candidates they make.
    """
    writers.guard(source, target)
    cfg.validate()
    watch = metrics.Watch()
    lines = readers.read_lines(metrics.watched_session(spark), source, min_partitions)
    edge, usable = watched_edges(lines, cfg, watch)
    kept = edge.join(usable.select(*postings.KEY), postings.KEY, "left_semi") if cfg.max_users_per_item > 0 else edge
    least = (cfg.min_buy, cfg.min_pv)
    counts = next(pairs.ordered_counts(kept, least, kept is edge)) if ordered else pairs.exact_counts(kept, least, kept is edge)
    out = ranking.passing_counts(counts, cfg)
    out = watch.on(out, *[metrics.tally(f"{b}_generated", None, F.col(f"{b}_count")) for b in (BUY, PV)], metrics.tally("emitted_pairs"))
    out = out.persist() if persist else out
    writers.write_pairs(out, target, cfg.overwrite)
    counters = watch.counters()
    # every group is paired in full here, whatever a top run's plan is
    counters = {name: n for name, n in counters.items() if not name.endswith(("exact_lists", "sampled_lists", "not_generated", "odd_adjusted"))}
    counters |= {f"{b}_posting_lists": counters[f"emitted_{b}_posting_lists"] for b in (BUY, PV)} | {"directed_candidates": 2 * counters["emitted_pairs"]}
    return Run(out, counters)


def run_top(spark: SparkSession, source: str | None, target: str, cfg: EngineConfig, stages: str | None = None, min_partitions: int | None = None) -> Run:
    """Lines in, one line of similar users per user out, the counters of every step beside.

    ``stages`` also keeps posting lists, in chunks, and scores. Without a ``source`` the run goes on from the
    posting lists of an earlier one in ``stages``, reads no log, and has no counters of the steps before.
    """
    writers.guard(*([source] if source else []), target, *([stages] if stages else []))
    cfg.validate()
    watch, own = metrics.Watch(), metrics.watched_session(spark)
    if source is None:
        edge = postings.chunk_edges(own.read.parquet(f"{stages}/postings"))
        plan = postings.usable(cut(postings.planned(postings.degrees(edge), cfg)), cfg)
    else:
        edge, plan = watched_edges(readers.read_lines(own, source, min_partitions), cfg, watch)
        if stages:
            writers.write_postings(postings.posting_chunks(edge, plan), f"{stages}/postings", cfg.overwrite)
    passing = watched_scores(edge, plan, cfg, watch)
    if stages:
        writers.write_stage(passing, f"{stages}/scores", cfg.overwrite or source is None)
        passing = own.read.parquet(f"{stages}/scores")
    lists = watched_lists(passing, cfg, watch)
    writers.write_top(lists, target, cfg.overwrite)
    return Run(lists, top_counters(watch))


class SourceTooSmall(RuntimeError):
    """The whole source is below the minimum size."""


class SizeOutOfRange(RuntimeError):
    """What was written, and then withdrawn, is smaller or larger than asked for."""


@dataclass
class Sampled:
    report: dict
    selection: sampler.Selection


def run_sampler(spark: SparkSession, source: str, target: str, cfg: SamplerConfig, overwrite: bool = False) -> Sampled:
    """Shrink a five-column CSV to the byte budget, whole users only, with a report beside the output.

    The projected size is checked before anything is written, the written one before it is published.
    """
    writers.guard(source, target)
    cfg.validate()
    header = readers.detect_header(spark, source) if cfg.header == "auto" else cfg.header == "yes"
    events = readers.read_csv5(spark, source, "yes" if header else "no")
    facts = sampler.user_stats(events).agg(F.sum("projected_bytes").alias("bytes"), F.sum("total").alias("rows"), F.count("*").alias("users")).first()
    if (facts.bytes or 0) < cfg.min_bytes:
        raise SourceTooSmall(f"the source has {facts.bytes or 0} bytes without its category, below {cfg.min_bytes}")
    selection = sampler.select_users(events, cfg)
    kept = sampler.keep_users(events, selection.users)
    seen = Observation()
    with writers.published(spark, target, overwrite) as place:
        writers.write_csv(writers.event_rows(kept).observe(seen, F.count("*").alias("rows")), place, cfg.write_header)
        size = writers.written_bytes(spark, place)
        if not cfg.min_bytes <= size <= cfg.max_bytes:
            raise SizeOutOfRange(f"{size} bytes would be written, not {cfg.min_bytes} to {cfg.max_bytes}; nothing was published")
    report = {
        "input": source, "output": target, "source_had_header": header, "output_has_header": cfg.write_header, "seed": cfg.seed,
        "valid_source_rows": facts.rows, "source_users": facts.users, "selected_users": selection.composition["total_selected_users"], "rows_written": seen.get["rows"],
        "actual_output_bytes": size, "actual_output_gb": size / 1e9,
        "requested_min_gb": cfg.min_bytes / 1e9, "requested_target_gb": cfg.target_bytes / 1e9, "requested_max_gb": cfg.max_bytes / 1e9,
        "thresholds": selection.limits, "composition": selection.composition, "job1_deduplication_preserved": True,
    }
    writers.write_report(spark, report, target.rstrip("/") + ".report.json")
    return Sampled(report, selection)
