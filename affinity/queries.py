"""Queries over the test tables, one or more per operator, each with the SQL that must agree.

The tables stand in for logs: purchases and views of ``events`` are buys and views of the
item in ``props.k``; order lines are another log with many items and short lists; raw
lines for the parser are made from events by fixed rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig, SamplerConfig
from .functions.columns import behavior_code, behavior_name, stable_hash_hex
from .functions.shuffle import GAMMA, MIX_A, MIX_B, SHORT_A, SHORT_B
from .operators import metrics, pairs, postings, ranking, sampler
from .operators.lineage import cut, dropped, dropped_shuffles, scratch
from .plans import pipelines
from .sources import readers, writers

CFG = EngineConfig(sample_seed=7)
CAPPED = EngineConfig(max_users_per_item=18, sample_seed=7)
SEED = 20260703


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item() -> F.Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def obs(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "buy").otherwise("pv")
    return table(spark, d, "events").where(F.col("event_type").isin("purchase", "view")).select("user_id", item().alias("item_id"), kind.alias("behavior"))


def sales(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    kind = F.when(F.col("l_returnflag") == "R", "pv").otherwise("buy")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), kind.alias("behavior"))


BEHAVIOR = {"purchase": "buy", "view": "pv", "click": "fav", "signup": "cart", "error": "err"}


def behavior() -> F.Column:
    return F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in BEHAVIOR.items()])


def lines(spark: SparkSession, d: str, sep: str = ",") -> DataFrame:
    """Raw lines: user, item, behavior, time, with every kind of fault the parser knows."""
    e, i, u = F.col("event_id"), item().cast("string"), F.col("user_id").cast("string")
    b = F.when(e % 5 == 0, F.upper(behavior())).otherwise(behavior())
    p = F.when(e % 7 == 0, " ").otherwise("")
    join = lambda *x: F.concat_ws(sep, *x)
    rules = [(101, 0, F.lit("   ")), (103, 1, join(*map(F.lit, ("user_id", "item_id", "behavior", "timestamp")))), (107, 2, join(F.lit("12"), F.lit("34"))), (109, 3, join(F.concat(F.lit("x"), u), i, b, F.lit("1"))), (113, 4, join(u, F.lit("1.5"), b, F.lit("1"))), (127, 5, join(F.lit("9223372036854775808"), i, b, F.lit("1")))]
    line = F.coalesce(*[F.when(e % n == r, x) for n, r, x in rules], F.concat(p, join(F.concat(u, p), F.concat(p, i), F.concat(p, b, p), (e + 1700000000).cast("string"))))
    return table(spark, d, "events").select(F.explode(F.array(line)).alias("value"))


def source5(spark: SparkSession, d: str) -> DataFrame:
    """Five text columns as a CSV reader gives them, some rows with faults."""
    e = F.col("event_id")
    user = F.when(e % 97 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string")))
    kind = F.when(e % 89 == 1, "  ").otherwise(F.upper(behavior()))
    ts = F.when(e % 83 == 2, "12:30").otherwise((e + 1700000000).cast("string"))
    return table(spark, d, "events").select(user.alias("user"), item().cast("string").alias("item"), F.lit("7").alias("category"), kind.alias("behavior"), ts.alias("ts"))


def events5(spark: SparkSession, d: str) -> DataFrame:
    """The clean events of the sampler."""
    raw = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user"), item().cast("string").alias("item"), F.lit("7").alias("category"), behavior().alias("behavior"), (F.col("event_id") + 1700000000).cast("string").alias("ts"))
    return readers.clean_events(raw)


def parsed(s: SparkSession, d: str) -> DataFrame:
    return readers.parse(lines(s, d), EngineConfig(has_header=True))


def hybrid(s: SparkSession, d: str) -> DataFrame:
    return pairs.hybrid_pairs(obs(s, d), CFG)


def scored(s: SparkSession, d: str) -> DataFrame:
    return pipelines.pair_scores(obs(s, d), CFG)


def sampler_config(events: DataFrame) -> SamplerConfig:
    """Half of the log, give or take a tenth of that."""
    total = sampler.user_stats(events).agg(F.sum("projected_bytes")).first()[0]
    return SamplerConfig(total // 2, total // 2 - total // 20, total // 2 + total // 20, SEED)


def selection(s: SparkSession, d: str) -> sampler.Selection:
    events = events5(s, d)
    return sampler.select_users(events, sampler_config(events))


def classed(s: SparkSession, d: str) -> DataFrame:
    stats = cut(sampler.user_stats(events5(s, d)))
    return stats.select("user_id", sampler.user_class(sampler.thresholds(stats)).alias("kind"))


def posting_lists_query(s: SparkSession, d: str) -> DataFrame:
    lists = postings.posting_lists(postings.edges(obs(s, d)), CFG)
    return lists.select("item_id", "behavior", F.array_join(F.transform("users", lambda x: x.cast("string")), " ").alias("users"))


def capped_degrees(s: SparkSession, d: str) -> DataFrame:
    return postings.usable(postings.degrees(postings.edges(obs(s, d))), CAPPED)


def bounded_query(s: SparkSession, d: str) -> DataFrame:
    """Every group bounded, whatever its size."""
    return pairs.hybrid_pairs(obs(s, d), EngineConfig(exact_max_users_buy=0, exact_max_users_pv=0, max_neighbours_buy=5, max_neighbours_pv=4, sample_seed=7))


def hybrid_metrics(s: SparkSession, d: str) -> DataFrame:
    plan = postings.pair_plan(postings.degrees(postings.edges(obs(s, d))), CFG)
    return metrics.pairing_counts(plan, hybrid(s, d))


def compat_query(s: SparkSession, d: str) -> DataFrame:
    return pairs.count_pairs(pairs.hybrid_pairs(obs(s, d), EngineConfig(sampling="compat")))


def topk_text(s: SparkSession, d: str) -> DataFrame:
    return ranking.top_lists(pipelines.similar_users(obs(s, d), CFG)).select(writers.top_line().alias("line"))


def percentiles(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(sorted(sampler.thresholds(cut(sampler.user_stats(events5(s, d)))).items()), "name string, value long")


def hash_order(s: SparkSession, d: str) -> DataFrame:
    users = events5(s, d).select("user_id").distinct()
    return users.select("user_id", F.conv(stable_hash_hex(F.col("user_id"), SEED), 16, 10).alias("hash"))


def anchors(s: SparkSession, d: str) -> DataFrame:
    return sampler.anchor_items(events5(s, d), classed(s, d).where("kind = 'high'"))


def neighbours(s: SparkSession, d: str) -> DataFrame:
    kinds = classed(s, d)
    return sampler.neighbour_scores(events5(s, d), anchors(s, d), kinds.where("kind = 'high'"), kinds.where("kind = 'regular'"))


def sampled_events(s: SparkSession, d: str) -> DataFrame:
    return sampler.keep_users(events5(s, d), selection(s, d).users).select("user_id", "item_id", "behavior", "ts")


def composition(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame(sorted(selection(s, d).composition.items()), "name string, value long")


def behavior_codes(s: SparkSession, d: str) -> DataFrame:
    named = table(s, d, "events").select(behavior().alias("behavior")).withColumn("code", behavior_code(F.col("behavior")).cast("int"))
    return named.groupBy("behavior", "code").agg(F.count("*").alias("n")).withColumn("name", behavior_name(F.col("code")))


def awkward(c: F.Column, line_ends: bool) -> F.Column:
    """A text that needs quotes in CSV, or looks as if it did."""
    e, more = F.col("event_id"), {0: '"q"', 1: "\\", 2: ",x", 3: "\n z" if line_ends else '"', 4: '\\"y', 5: ' "'}
    return F.concat(c, F.coalesce(*[F.when(e % 7 == k, v) for k, v in more.items()], F.lit("")))


def csv5_file(s: SparkSession, d: str) -> DataFrame:
    """A log written as quoted CSV with a header and read again: fields with quotes, commas, backslashes and line ends."""
    raw = table(s, d, "events").select(F.col("user_id").cast("string").alias("user"), item().cast("string").alias("item"), awkward(F.lit("c"), True).alias("category"), awkward(behavior(), True).alias("behavior"), (F.col("event_id") + 1700000000).cast("string").alias("ts"))
    place = scratch(s)
    writers.write_csv(raw, place, header=True)
    return readers.read_csv5(s, place)


def csv_lines(s: SparkSession, d: str) -> DataFrame:
    """The lines of a published CSV of events."""
    rows = table(s, d, "events").select(F.col("user_id").cast("string").alias("user"), item().cast("string").alias("item"), awkward(behavior(), False).alias("behavior"), (F.col("event_id") + 1700000000).cast("string").alias("ts"))
    place = scratch(s)
    writers.write_events(rows, place)
    return readers.read_lines(s, place, min_partitions=16)


def posting_chunk_lists(s: SparkSession, d: str) -> DataFrame:
    """Posting lists put together from stored chunks of at most 16 users, and their longest chunk."""
    edge, place = postings.edges(obs(s, d)), scratch(s)
    writers.write_postings(postings.posting_chunks(edge, postings.usable(postings.degrees(edge), CFG), 16), place)
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "users"))), lambda x: x["users"]))
    lists = s.read.parquet(place).groupBy("item_id", "behavior").agg(F.array_join(ordered.cast("array<string>"), " ").alias("users"), (F.max("n") <= 16).alias("short"))
    return lists


def postings_resumed(s: SparkSession, d: str) -> DataFrame:
    """The most similar users, from stored posting lists: the log is not read again."""
    edge, place = postings.edges(obs(s, d)), scratch(s)
    writers.write_postings(postings.posting_chunks(edge, postings.usable(postings.degrees(edge), CFG)), place)
    stored = postings.chunk_edges(s.read.parquet(place))
    made = pairs.planned_pairs(stored, postings.pair_plan(postings.degrees(stored), CFG), CFG)
    return ranking.top_k(ranking.directed(ranking.passing_scores(ranking.scores(pairs.count_pairs(made), CFG), CFG)), CFG.top_k)


def sampler_report(s: SparkSession, d: str) -> DataFrame:
    """The numbers of the report beside a sampled CSV, read back: sizes, rows, thresholds, composition."""
    raw = table(s, d, "events").select(F.col("user_id").cast("string").alias("user"), item().cast("string").alias("item"), F.lit("7").alias("category"), behavior().alias("behavior"), (F.col("event_id") + 1700000000).cast("string").alias("ts"))
    place = scratch(s)
    writers.write_csv(raw, f"{place}/log")
    pipelines.run_sampler(s, f"{place}/log", f"{place}/out", sampler_config(events5(s, d)))
    report = s.read.json(f"{place}/out.report.json", multiLine=True)
    plain = [F.col(c) for c in ("valid_source_rows", "source_users", "selected_users", "rows_written", "actual_output_bytes")]
    row = report.select(*plain, "thresholds.*", "composition.*").first()
    return s.createDataFrame(sorted(row.asDict().items()), "name string, value long")


def pairs_ordered(s: SparkSession, d: str) -> DataFrame:
    """Pair files written in order: lines, and how many stand before a smaller one of their file.

    Those of a range of first users are written, read again and deleted before the next range's.
    """
    lines = misplaced = 0
    for part in pipelines.ordered_pair_lines(obs(s, d), CFG):
        place = scratch(s)
        with dropped_shuffles(s):
            writers.write_lines(part, place, most=writers.FILE_BLOCKS)
            found = metrics.line_order(s, place).first()
        dropped(s, place)
        lines, misplaced = lines + found.lines, misplaced + found.misplaced
    return s.createDataFrame([(lines, misplaced)], "lines long, misplaced long")


COUNTED = EngineConfig(has_header=True, sample_seed=7, min_score=1.0, top_k=10)


def run_counters(s: SparkSession, d: str) -> DataFrame:
    """All counters of a top run over raw lines, added up by the run itself."""
    watch = metrics.Watch()
    edge, plan = pipelines.watched_edges(lines(metrics.watched_session(s), d), COUNTED, watch)
    lists = pipelines.watched_lists(pipelines.watched_scores(edge, plan, COUNTED, watch), COUNTED, watch)
    lists.write.format("noop").mode("overwrite").save()
    return s.createDataFrame(sorted(pipelines.top_counters(watch).items()), "name string, value long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "behavior_codes": behavior_codes,
    "parse_observations": lambda s, d: readers.observations(parsed(s, d)),
    "parse_status_counts": lambda s, d: metrics.parse_counts(parsed(s, d)),
    "parse_custom_layout": lambda s, d: readers.parse(lines(s, d, "|"), EngineConfig(delimiter="|", user_index=1, item_index=0)),
    "csv5_ingest": lambda s, d: readers.clean_events(source5(s, d)),
    "csv5_file": csv5_file,
    "csv_lines": csv_lines,
    "posting_chunk_lists": posting_chunk_lists,
    "postings_resumed": postings_resumed,
    "run_counters": run_counters,
    "sampler_report": sampler_report,
    "pairs_ordered": pairs_ordered,
    "distinct_edges": lambda s, d: postings.edges(obs(s, d)),
    "posting_lists": posting_lists_query,
    "posting_degrees": lambda s, d: postings.degrees(postings.edges(sales(s, d))),
    "posting_hard_cap": capped_degrees,
    "posting_forecast": lambda s, d: metrics.posting_counts(postings.degrees(postings.edges(sales(s, d))), CAPPED),
    "pairs_exact_counts": lambda s, d: pipelines.pair_counts(obs(s, d), CFG),
    "pairs_threshold_or": lambda s, d: pipelines.pair_counts(obs(s, d), EngineConfig(min_buy=2, min_pv=3)),
    "pairs_capped_counts": lambda s, d: pipelines.pair_counts(sales(s, d), CAPPED),
    "pair_count": lambda s, d: pipelines.pair_counts(sales(s, d), CFG).agg(F.count("*").alias("pairs")),
    "pairs_bounded_native": bounded_query,
    "pairs_hybrid_native": hybrid,
    "pairs_hybrid_metrics": hybrid_metrics,
    "pairs_hybrid_compat": compat_query,
    "pair_scores": scored,
    "pair_scores_min": lambda s, d: pipelines.pair_scores(obs(s, d), EngineConfig(sample_seed=7, min_score=1.0)),
    "pair_score_metrics": lambda s, d: metrics.score_counts(scored(s, d), EngineConfig(min_score=1.0)),
    "directed_candidates": lambda s, d: ranking.directed(scored(s, d)),
    "directed_metrics": lambda s, d: metrics.candidate_counts(scored(s, d)),
    "topk_similar_users": lambda s, d: pipelines.similar_users(obs(s, d), CFG),
    "topk_lists_text": topk_text,
    "topk_metrics": lambda s, d: metrics.top_counts(ranking.directed(scored(s, d)), 10),
    "pairs_text_lines": lambda s, d: pipelines.pair_counts(obs(s, d), CFG).select(writers.pair_line().alias("line")),
    "user_stats": lambda s, d: sampler.user_stats(events5(s, d)),
    "user_percentiles": percentiles,
    "user_classes": classed,
    "hash_order": hash_order,
    "anchor_items": anchors,
    "neighbor_scores": neighbours,
    "sampler_selection": lambda s, d: selection(s, d).users,
    "sampler_composition": composition,
    "sampled_events": sampled_events,
}


# --- SQL -----------------------------------------------------------------------------------------

K = "cast(json_extract_string(props, '$.k') as bigint)"
BEH = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BEHAVIOR.items()) + " END"
OBS = f"obs AS (SELECT user_id, {K} AS item_id, CASE event_type WHEN 'purchase' THEN 'buy' ELSE 'pv' END AS behavior FROM events WHERE event_type IN ('purchase', 'view'))"
SALES = "obs AS (SELECT o_custkey AS user_id, l_partkey AS item_id, CASE l_returnflag WHEN 'R' THEN 'pv' ELSE 'buy' END AS behavior FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
EDGE = "edge AS (SELECT DISTINCT item_id, behavior, user_id FROM obs)"
DEG = "deg AS (SELECT item_id, behavior, count(*) AS n FROM edge GROUP BY ALL)"
EXACT = "contrib AS (SELECT a.item_id, a.behavior, a.user_id AS user1, b.user_id AS user2 FROM edge a JOIN edge b ON a.item_id = b.item_id AND a.behavior = b.behavior AND a.user_id < b.user_id)"
COUNTS = "counts AS (SELECT user1, user2, count(*) FILTER (behavior = 'buy') AS buy_count, count(*) FILTER (behavior = 'pv') AS pv_count FROM contrib GROUP BY ALL)"


WIDE = "18446744073709551616::UHUGEINT"


def step_sql(x: str, bits: int, factor: int) -> str:
    return f"((xor({x}, {x} >> {bits}) * {factor}::UHUGEINT) % {WIDE})"


def mix_sql(value: str) -> str:
    """The 64-bit finaliser over 128-bit numbers."""
    return f"(SELECT xor(c, c >> 31) FROM (SELECT {step_sql('b', 27, MIX_B)} AS c FROM (SELECT {step_sql('a', 30, MIX_A)} AS b FROM (SELECT {value} AS a))))"


def shuffle_sql(seed: int) -> str:
    """Places by the seeded shuffle: one draw of a group at each step of a recursion, refused draws included."""
    start = f"xor(xor({mix_sql('item_id::UHUGEINT')}, {mix_sql("(CASE behavior WHEN 'buy' THEN 1 ELSE 2 END)::UHUGEINT")}), {seed}::UHUGEINT)"
    return f"""dealt AS (SELECT item_id, behavior, list(user_id ORDER BY user_id) AS u, count(*) - 1 AS i FROM edge GROUP BY ALL),
        walk AS (SELECT item_id, behavior, u, i, {start} AS state FROM dealt
            UNION ALL SELECT item_id, behavior, CASE WHEN fine THEN list_transform(u, lambda x, p: CASE p WHEN i + 1 THEN u[j + 1] WHEN j + 1 THEN u[i + 1] ELSE x END) ELSE u END, i - fine::int, state
            FROM (SELECT *, CASE WHEN even THEN r % (i + 1) ELSE (r >> 1) % (i + 1) END AS j, even OR (r >> 1) + i - (r >> 1) % (i + 1) < 2147483648 AS fine
                FROM (SELECT *, ({step_sql('z', 28, SHORT_B)} >> 32)::bigint AS r, bit_count(i + 1) = 1 AS even
                    FROM (SELECT *, {step_sql('state', 33, SHORT_A)} AS z FROM (SELECT item_id, behavior, u, i, (state + {GAMMA}::UHUGEINT) % {WIDE} AS state FROM walk WHERE i > 0))))),
        pos AS (SELECT item_id, behavior, unnest(u) AS user_id, generate_subscripts(u, 1) - 1 AS pos FROM walk WHERE i = 0)"""


#: Places by the hash order.
HASHED = "pos AS (SELECT item_id, behavior, user_id, row_number() OVER (PARTITION BY item_id, behavior ORDER BY md5(concat_ws('|', item_id, behavior, '7', user_id)), user_id) - 1 AS pos FROM edge)"


def ring(exact_buy: int, exact_pv: int, near_buy: int, near_pv: int, places: str = HASHED) -> str:
    """Plan, places on the ring, and pairs by their distance on it."""
    pick = lambda buy, pv: f"CASE behavior WHEN 'buy' THEN {buy} ELSE {pv} END"
    return f"""plan0 AS (SELECT *, n > {pick(exact_buy, exact_pv)} AS sampled, CASE WHEN n > {pick(exact_buy, exact_pv)} THEN least({pick(near_buy, near_pv)}, n - 1) ELSE n - 1 END AS k0 FROM deg WHERE n >= 2),
        plan AS (SELECT *, (k0 < n - 1 AND n % 2 = 1 AND k0 % 2 = 1) AS odd, k0 - (k0 < n - 1 AND n % 2 = 1 AND k0 % 2 = 1)::int AS k FROM plan0),
        {places},
        contrib AS (SELECT a.item_id, a.behavior, least(a.user_id, b.user_id) AS user1, greatest(a.user_id, b.user_id) AS user2
            FROM pos a JOIN pos b ON a.item_id = b.item_id AND a.behavior = b.behavior AND a.pos < b.pos JOIN plan p ON p.item_id = a.item_id AND p.behavior = a.behavior
            WHERE k = n - 1 OR least(b.pos - a.pos, n - (b.pos - a.pos)) <= k // 2 OR (k % 2 = 1 AND b.pos - a.pos = n // 2))"""


HYBRID = f"{OBS}, {EDGE}, {DEG}, {ring(21, 5, 10, 2)}"
SCORED = f"{HYBRID}, {COUNTS}, scored AS (SELECT user1, user2, buy_count * 1.0::DOUBLE + pv_count * 0.2::DOUBLE AS score FROM counts)"
DIRECTED = f"{SCORED}, directed AS (SELECT user1 AS user_id, user2 AS similar_user, score FROM scored UNION ALL SELECT user2, user1, score FROM scored)"
TOP = f"{DIRECTED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, similar_user) AS rank FROM directed) WHERE rank <= 50)"


def lines_sql(sep: str) -> str:
    b = f"CASE WHEN event_id % 5 = 0 THEN upper({BEH}) ELSE {BEH} END"
    p = "CASE WHEN event_id % 7 = 0 THEN ' ' ELSE '' END"
    join = lambda *x: f" || '{sep}' || ".join(f"({v})" for v in x)
    return f"""lines AS (SELECT CASE WHEN event_id % 101 = 0 THEN '   ' WHEN event_id % 103 = 1 THEN {join("'user_id'", "'item_id'", "'behavior'", "'timestamp'")}
        WHEN event_id % 107 = 2 THEN {join("'12'", "'34'")} WHEN event_id % 109 = 3 THEN {join("'x' || user_id", K, b, "'1'")} WHEN event_id % 113 = 4 THEN {join("user_id", "'1.5'", b, "'1'")}
        WHEN event_id % 127 = 5 THEN {join("'9223372036854775808'", K, b, "'1'")} ELSE {p} || {join(f"user_id || {p}", f"{p} || {K}", f"{p} || {b} || {p}", "event_id + 1700000000")} END AS value FROM events)"""


def parsed_sql(sep: str, user: int, item_: int, header: bool) -> str:
    head = "WHEN contains(lower(u), 'user') OR contains(lower(i), 'item') THEN 'HEADER'" if header else ""
    number = lambda c: f"CASE WHEN regexp_full_match({c}, '[+-]?[0-9]+') THEN try_cast({c} AS bigint) END"
    return f"""{lines_sql(sep)}, cut AS (SELECT trim(value, E' \\t\\r\\n') AS line, string_split(trim(value, E' \\t\\r\\n'), '{sep}') AS f FROM lines),
        fields AS (SELECT line, len(f) AS n, trim(f[{user + 1}], E' \\t\\r\\n') AS u, trim(f[{item_ + 1}], E' \\t\\r\\n') AS i, lower(trim(f[3], E' \\t\\r\\n')) AS behavior FROM cut),
        parsed AS (SELECT {number("u")} AS user_id, {number("i")} AS item_id, behavior, CASE WHEN line = '' OR n < 3 THEN 'INVALID' {head} WHEN {number("u")} IS NULL OR {number("i")} IS NULL THEN 'INVALID'
            WHEN behavior = 'buy' THEN 'BUY' WHEN behavior = 'pv' THEN 'PV' ELSE 'FILTERED' END AS status FROM fields)"""


PARSED = parsed_sql(",", 0, 1, True)
EVENTS5 = f"e5 AS (SELECT user_id, user_id::varchar AS u, {K} AS item_id, {K}::varchar AS i, {BEH} AS behavior, (event_id + 1700000000)::varchar AS ts FROM events)"
STATS = "stats AS (SELECT user_id, sum(length(u) + length(i) + length(behavior) + length(ts) + 4)::bigint AS projected_bytes, count(*) AS total, count(*) FILTER (behavior IN ('buy', 'fav')) AS useful, count(*) FILTER (behavior = 'buy') AS buy, count(*) FILTER (behavior = 'fav') AS fav FROM e5 GROUP BY user_id)"
RANK = "(SELECT {0} FROM (SELECT {0}, row_number() OVER (ORDER BY {0}) - 1 AS r FROM stats) WHERE r = (SELECT round_even((count(*) - 1) * {1}, 0) FROM stats))"
LIMITS = "limits AS (SELECT " + ", ".join(f"{RANK.format(c, f)} AS {n}" for n, c, f in (("useful_p10", "useful", 0.10), ("useful_p95", "useful", 0.95), ("total_p25", "total", 0.25), ("total_p95", "total", 0.95))) + ")"
CLASSED = "classed AS (SELECT user_id, projected_bytes AS size, CASE WHEN useful <= greatest(1, useful_p10) AND total <= total_p25 THEN 'low' WHEN useful >= greatest(2, useful_p95) OR total >= total_p95 THEN 'high' WHEN useful >= 2 THEN 'regular' ELSE 'low' END AS kind FROM stats, limits)"
KINDS = f"{EVENTS5}, {STATS}, {LIMITS}, {CLASSED}"


def hash_sql(value: str, seed: int) -> str:
    """SplitMix64 over 128-bit numbers, cut to 64 bits after each step."""
    return mix_sql(f"((xor({value}, {seed})::UHUGEINT + {GAMMA}::UHUGEINT) % {WIDE})")


def sampler_sql() -> str:
    """The stages of the greedy walk, each a recursion over its candidates in order."""
    out = [KINDS, "goal AS (SELECT (sum(size) // 2)::bigint AS target, (sum(size) // 2 - sum(size) // 20)::bigint AS low, (sum(size) // 2 + sum(size) // 20)::bigint AS most FROM classed)"]
    begin, before = "SELECT 0::bigint AS used", []

    def walk(name: str, pool: str, salt: int, end: str, score: str = "0", guard: str = "true", stop: str = "false") -> None:
        nonlocal begin
        gone = " ".join(f"AND user_id NOT IN (SELECT user_id FROM {b})" for b in before)
        out.append(f"{name}_c AS MATERIALIZED (SELECT user_id, size, row_number() OVER (ORDER BY {score} DESC, {hash_sql('user_id', SEED + salt)}) AS rn FROM {pool} {gone})")
        out.append(f"{name}_w AS MATERIALIZED (SELECT 0::bigint AS rn, used, -1::bigint AS user_id, ({guard}) AS live FROM ({begin}), goal UNION ALL SELECT c.rn, CASE WHEN live AND used + size <= least({end}, most) THEN used + size ELSE used END, CASE WHEN live AND used + size <= least({end}, most) THEN c.user_id ELSE -1 END, live AND NOT (live AND used + size <= least({end}, most) AND {stop}) FROM {name}_w w JOIN {name}_c c ON c.rn = w.rn + 1, goal)")
        out.append(f"{name} AS MATERIALIZED (SELECT user_id FROM {name}_w WHERE user_id >= 0)")
        begin = f"SELECT max(used) AS used FROM {name}_w"
        before.append(name)

    walk("core", "classed WHERE kind = 'regular'", 0, "floor(target * 0.70)")
    out.append("anchors AS (SELECT DISTINCT item_id, behavior FROM e5 WHERE behavior IN ('buy', 'fav') AND user_id IN (SELECT user_id FROM core))")
    out.append("near AS MATERIALIZED (SELECT user_id, any_value(size) AS size, count(*) AS score FROM e5 JOIN anchors USING (item_id, behavior) JOIN classed USING (user_id) WHERE kind = 'regular' AND user_id NOT IN (SELECT user_id FROM core) GROUP BY user_id)")
    walk("neighbor", "near WHERE true", 1, "floor(target * 0.90)", "score")
    walk("low_", "classed WHERE kind = 'low'", 2, "floor(target * 0.95)")
    walk("high_", "classed WHERE kind = 'high'", 3, "target")
    walk("fill1", "near WHERE true", 1, "target", "score")
    walk("fill2", "classed WHERE true", 4, "target", guard="used < target")
    walk("fill3", "classed WHERE true", 5, "most", guard="used < low", stop="used + size >= low")
    chosen = " UNION ALL ".join(f"SELECT user_id, '{stage}' AS stage FROM {name}" for name, stage in zip(before, ("core", "neighbor", "low", "high", "fill", "fill", "fill")))
    return "WITH RECURSIVE " + ",\n".join(out) + f", chosen AS ({chosen})"


SAMPLER = sampler_sql()


def awkward_sql(text: str, line_ends: bool) -> str:
    more = {0: "'\"q\"'", 1: "'\\'", 2: "',x'", 3: "chr(10) || ' z'" if line_ends else "'\"'", 4: "'\\\"y'", 5: "' \"'"}
    return f"({text} || CASE event_id % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in more.items()) + " ELSE '' END)"


def counters_sql() -> str:
    """The counters of ``run_counters``, each from the relation that it counts."""
    of = lambda b: f"behavior = '{b}'"
    named = [(f"records_{x.lower()}", f"SELECT count(*) FROM parsed WHERE status = '{x}'") for x in metrics.STATUSES]
    for b in ("buy", "pv"):
        for name, value in ((f"emitted_{b}_posting_lists", "count(*)"), (f"distinct_{b}_edges", "sum(n)"), (f"potential_{b}_all_pairs", "sum(n * (n - 1) // 2)"), (f"planned_{b}_pair_contributions", "sum(n * k // 2)"), (f"{b}_exact_lists", "count(*) FILTER (NOT sampled)"), (f"{b}_sampled_lists", "count(*) FILTER (sampled)"), (f"{b}_not_generated", "sum(n * (n - 1) // 2) - sum(n * k // 2)"), (f"{b}_odd_adjusted", "count(*) FILTER (odd)")):
            named.append((name, f"SELECT coalesce({value}, 0) FROM plan WHERE {of(b)}"))
        named.append((f"{b}_generated", f"SELECT count(*) FROM contrib WHERE {of(b)}"))
    named += [("items_with_less_than_two_users", "SELECT count(*) FROM deg WHERE n < 2"), ("items_above_hard_max_users", "SELECT 0")]
    named += [("emitted_pairs", "SELECT count(*) FROM scored WHERE score >= 1.0"), ("filtered_by_score", "SELECT count(*) FROM scored WHERE score < 1.0"), ("directed_candidates", "SELECT count(*) FROM directed"), ("self_pairs", "SELECT 0"), ("invalid_scores", "SELECT 0")]
    named += [("users_emitted", "SELECT count(*) FROM seen"), ("candidates_seen", "SELECT coalesce(sum(n), 0) FROM seen"), ("users_with_fewer_than_k", "SELECT count(*) FROM seen WHERE n < 10"), ("candidates_dropped", "SELECT coalesce(sum(greatest(n - 10, 0)), 0) FROM seen")]
    logged = "obs AS (SELECT user_id, item_id, behavior FROM parsed WHERE status IN ('BUY', 'PV'))"
    steps = f"{PARSED}, {logged}, {EDGE}, {DEG}, {ring(21, 5, 10, 2)}, {COUNTS}, scored AS (SELECT user1, user2, buy_count * 1.0::DOUBLE + pv_count * 0.2::DOUBLE AS score FROM counts), passing AS (SELECT * FROM scored WHERE score >= 1.0)"
    return f"WITH {steps}, directed AS (SELECT user1 AS user_id FROM passing UNION ALL SELECT user2 FROM passing), seen AS (SELECT user_id, count(*) AS n FROM directed GROUP BY user_id) " + " UNION ALL ".join(f"SELECT '{name}' AS name, ({value})::BIGINT AS value" for name, value in named)


ORACLES: dict[str, str] = {
    "behavior_codes": f"SELECT {BEH} AS behavior, CASE {BEH} WHEN 'buy' THEN 1 WHEN 'pv' THEN 2 END AS code, CASE {BEH} WHEN 'buy' THEN 'buy' WHEN 'pv' THEN 'pv' ELSE 'unknown' END AS name, count(*) AS n FROM events GROUP BY ALL",
    "parse_observations": f"WITH {PARSED} SELECT user_id, item_id, behavior FROM parsed WHERE status IN ('BUY', 'PV')",
    "parse_status_counts": f"WITH {PARSED} SELECT status, count(*) AS records FROM parsed GROUP BY status",
    "parse_custom_layout": f"WITH {parsed_sql('|', 1, 0, False)} SELECT * FROM parsed",
    "csv5_ingest": f"""SELECT user_id, user_id::varchar AS "user", {K} AS item_id, {K}::varchar AS item, {BEH} AS behavior, (event_id + 1700000000)::varchar AS ts FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 1 AND event_id % 83 <> 2""",
    "csv5_file": f"""SELECT user_id, user_id::varchar AS "user", {K} AS item_id, {K}::varchar AS item, trim({awkward_sql(BEH, True)}) AS behavior, (event_id + 1700000000)::varchar AS ts FROM events""",
    "csv_lines": f"""SELECT user_id || ',' || {K} || ',' || CASE WHEN regexp_matches(b, '[",]') THEN '"' || replace(b, '"', '""') || '"' ELSE b END || ',' || (event_id + 1700000000) AS value FROM (SELECT *, {awkward_sql(BEH, False)} AS b FROM events)""",
    "posting_chunk_lists": f"WITH {OBS}, {EDGE} SELECT item_id, behavior, string_agg(user_id::varchar, ' ' ORDER BY user_id) AS users, true AS short FROM edge GROUP BY ALL HAVING count(*) >= 2",
    "postings_resumed": f"WITH {TOP} SELECT user_id, rank::int AS rank, similar_user, score FROM top",
    "run_counters": counters_sql(),
    "sampler_report": f"""{SAMPLER}, kept AS (SELECT * FROM e5 WHERE user_id IN (SELECT user_id FROM chosen)), names(name, stage) AS (VALUES ('core_users', 'core'), ('neighbor_users', 'neighbor'), ('low_outlier_users', 'low'), ('high_outlier_users', 'high'), ('fill_users', 'fill'))
        SELECT 'valid_source_rows' AS name, count(*) AS value FROM e5 UNION ALL SELECT 'source_users', count(*) FROM stats UNION ALL SELECT 'selected_users', count(*) FROM chosen UNION ALL SELECT 'rows_written', count(*) FROM kept
        UNION ALL SELECT 'actual_output_bytes', sum(length(u) + length(i) + length(behavior) + length(ts) + 4)::BIGINT FROM kept UNION ALL (UNPIVOT (SELECT * FROM limits) ON COLUMNS(*) INTO NAME name VALUE value)
        UNION ALL SELECT name, count(chosen.stage) FROM names LEFT JOIN chosen USING (stage) GROUP BY name UNION ALL SELECT 'total_selected_users', count(*) FROM chosen
        UNION ALL SELECT 'anchor_item_behavior_keys', count(*) FROM anchors UNION ALL SELECT 'neighbor_candidates', count(*) FROM near""",
    "pairs_ordered": f"WITH {OBS}, {EDGE}, {EXACT}, {COUNTS} SELECT count(*) AS lines, 0::BIGINT AS misplaced FROM counts",
    "distinct_edges": f"WITH {OBS}, {EDGE} SELECT * FROM edge",
    "posting_lists": f"WITH {OBS}, {EDGE} SELECT item_id, behavior, string_agg(user_id::varchar, ' ' ORDER BY user_id) AS users FROM edge GROUP BY ALL HAVING count(*) >= 2",
    "posting_degrees": f"WITH {SALES}, {EDGE}, {DEG} SELECT * FROM deg",
    "posting_hard_cap": f"WITH {OBS}, {EDGE}, {DEG} SELECT * FROM deg WHERE n BETWEEN 2 AND 18",
    "posting_forecast": f"WITH {SALES}, {EDGE}, {DEG}, {ring(21, 5, 10, 2)}, all_ AS (SELECT d.*, coalesce(p.k, 0) AS k FROM deg d LEFT JOIN plan p USING (item_id, behavior)) SELECT "
    + ", ".join(f"coalesce(sum({v}) FILTER (behavior = '{b}' AND n BETWEEN 2 AND 18), 0)::bigint AS {w}_{b}_{x}" for b in ("buy", "pv") for w, x, v in (("emitted", "posting_lists", "1"), ("distinct", "edges", "n"), ("potential", "all_pairs", "n * (n - 1) // 2"), ("planned", "pair_contributions", "n * k // 2")))
    + ", count(*) FILTER (n < 2) AS items_with_less_than_two_users, count(*) FILTER (n > 18) AS items_above_hard_max_users FROM all_",
    "pairs_exact_counts": f"WITH {OBS}, {EDGE}, {EXACT}, {COUNTS} SELECT * FROM counts",
    "pairs_threshold_or": f"WITH {OBS}, {EDGE}, {EXACT}, {COUNTS} SELECT * FROM counts WHERE buy_count >= 2 OR pv_count >= 3",
    "pairs_capped_counts": f"WITH {SALES}, edge0 AS (SELECT DISTINCT item_id, behavior, user_id FROM obs), edge AS (SELECT * FROM edge0 WHERE (item_id, behavior) IN (SELECT (item_id, behavior) FROM edge0 GROUP BY item_id, behavior HAVING count(*) <= 18)), {EXACT}, {COUNTS} SELECT * FROM counts",
    "pair_count": f"WITH {SALES}, {EDGE}, {EXACT}, {COUNTS} SELECT count(*) AS pairs FROM counts",
    "pairs_bounded_native": f"WITH {OBS}, {EDGE}, {DEG}, {ring(0, 0, 5, 4)} SELECT * FROM contrib",
    "pairs_hybrid_native": f"WITH {HYBRID} SELECT * FROM contrib",
    "pairs_hybrid_metrics": f"WITH {HYBRID}, made AS (SELECT behavior, count(*) AS generated FROM contrib GROUP BY behavior) SELECT behavior, count(*) FILTER (NOT sampled) AS exact_lists, count(*) FILTER (sampled) AS sampled_lists, any_value(generated) AS generated, (sum(n * (n - 1) // 2) - sum(n * k // 2))::bigint AS not_generated, count(*) FILTER (odd) AS odd_adjusted FROM plan JOIN made USING (behavior) GROUP BY behavior",
    "pairs_hybrid_compat": f"WITH RECURSIVE {OBS}, {EDGE}, {DEG}, {ring(21, 5, 10, 2, shuffle_sql(EngineConfig().sample_seed))}, {COUNTS} SELECT * FROM counts",
    "pair_scores": f"WITH {SCORED} SELECT * FROM scored",
    "pair_scores_min": f"WITH {SCORED} SELECT * FROM scored WHERE score >= 1.0",
    "pair_score_metrics": f"WITH {SCORED} SELECT count(*) FILTER (score >= 1.0) AS emitted_pairs, count(*) FILTER (score < 1.0) AS filtered_by_score FROM scored",
    "directed_candidates": f"WITH {DIRECTED} SELECT * FROM directed",
    "directed_metrics": f"WITH {DIRECTED} SELECT count(*) AS directed_candidates, 0::bigint AS self_pairs, 0::bigint AS invalid_scores FROM directed",
    "topk_similar_users": f"WITH {TOP} SELECT user_id, rank::int AS rank, similar_user, score FROM top",
    "topk_lists_text": f"WITH {TOP} SELECT user_id || chr(9) || '[' || string_agg('(' || similar_user || ',' || score || ')', ', ' ORDER BY rank) || ']' AS line FROM top GROUP BY user_id",
    "topk_metrics": f"WITH {DIRECTED}, seen AS (SELECT user_id, count(*) AS seen FROM directed GROUP BY user_id) SELECT count(*) AS users_emitted, sum(seen)::bigint AS candidates_seen, count(*) FILTER (seen < 10) AS users_with_fewer_than_k, sum(greatest(seen - 10, 0))::bigint AS candidates_dropped FROM seen",
    "pairs_text_lines": f"WITH {OBS}, {EDGE}, {EXACT}, {COUNTS} SELECT user1 || ',' || user2 || chr(9) || buy_count || ',' || pv_count AS line FROM counts",
    "user_stats": f"WITH {EVENTS5}, {STATS} SELECT * FROM stats",
    "user_percentiles": f"WITH {EVENTS5}, {STATS}, {LIMITS} UNPIVOT (SELECT * FROM limits) ON COLUMNS(*) INTO NAME name VALUE value",
    "user_classes": f"WITH {KINDS} SELECT user_id, kind FROM classed",
    "hash_order": f"SELECT user_id, {hash_sql('user_id', SEED)}::varchar AS hash FROM (SELECT DISTINCT user_id FROM events)",
    "anchor_items": f"WITH {KINDS} SELECT DISTINCT item_id, behavior FROM e5 JOIN classed USING (user_id) WHERE kind = 'high' AND behavior IN ('buy', 'fav')",
    "neighbor_scores": f"WITH {KINDS}, anchors AS (SELECT DISTINCT item_id, behavior FROM e5 JOIN classed USING (user_id) WHERE kind = 'high' AND behavior IN ('buy', 'fav')) SELECT user_id, count(*) AS score FROM e5 JOIN classed USING (user_id) JOIN anchors USING (item_id, behavior) WHERE kind = 'regular' GROUP BY user_id",
    "sampler_selection": f"{SAMPLER} SELECT * FROM chosen",
    "sampler_composition": f"""{SAMPLER}, names(name, stage) AS (VALUES ('core_users', 'core'), ('neighbor_users', 'neighbor'), ('low_outlier_users', 'low'), ('high_outlier_users', 'high'), ('fill_users', 'fill'))
        SELECT name, count(chosen.stage) AS value FROM names LEFT JOIN chosen USING (stage) GROUP BY name UNION ALL SELECT 'total_selected_users', count(*) FROM chosen
        UNION ALL SELECT 'anchor_item_behavior_keys', count(*) FROM anchors UNION ALL SELECT 'neighbor_candidates', count(*) FROM near""",
    "sampled_events": f"{SAMPLER} SELECT user_id, item_id, behavior, ts FROM e5 WHERE user_id IN (SELECT user_id FROM chosen)",
}
