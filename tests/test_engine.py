"""Unit, golden and property tests of the similarity engine."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity.config import ConfigError, EngineConfig
from affinity.functions.shuffle import item_seed, shuffled
from affinity.operators import metrics, pairs, postings, ranking
from affinity.plans import pipelines
from affinity.sources import readers, writers

LOG = """user_id,item_id,behavior,timestamp
1,10,buy,100
2,10,buy,101
3,10,buy,102
1,10,buy,103
1,20,pv,104
2,20,PV,105
 4 , 20 ,pv,106
2,30,fav,107
3,30,cart,108
5,40,buy,109
abc,1,buy,1
abc,1,fav,1
1,2

9223372036854775808,10,buy,1""".split("\n")


@pytest.fixture(scope="module")
def parsed(spark):
    return readers.parse(spark.createDataFrame([(x,) for x in LOG], "value string"), EngineConfig(has_header=True))


@pytest.fixture(scope="module")
def obs(parsed):
    return readers.observations(parsed)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_parse_statuses(spark, parsed):
    assert dict(map(tuple, metrics.parse_counts(parsed).collect())) == {"BUY": 5, "PV": 3, "FILTERED": 2, "HEADER": 1, "INVALID": 5}
    plain = readers.parse(spark.createDataFrame([(LOG[0],)], "value string"), EngineConfig())
    assert [r.status for r in plain.collect()] == ["INVALID"]


@pytest.mark.parametrize("delimiter", ["|", "\t", "::", "\\E", "."])
def test_parse_literal_delimiters(spark, delimiter):
    line = delimiter.join(["7", "buy", "9", ""])
    got = readers.parse(spark.createDataFrame([(line,)], "value string"), EngineConfig(delimiter=delimiter, user_index=2, item_index=0, behavior_index=1))
    assert rows(got) == [(9, 7, "buy", "BUY")]


def test_posting_lists_and_counts(obs):
    lists = postings.posting_lists(postings.edges(obs), EngineConfig())
    assert rows(lists) == [(10, "buy", [1, 2, 3]), (20, "pv", [1, 2, 4])]
    counts = metrics.posting_counts(postings.degrees(postings.edges(obs)), EngineConfig()).first()
    assert (counts.distinct_buy_edges, counts.distinct_pv_edges, counts.potential_buy_all_pairs, counts.planned_pv_pair_contributions, counts.items_with_less_than_two_users) == (3, 3, 3, 3, 1)


def test_pair_counts_thresholds_and_cap(obs):
    all_pairs = [(1, 2, 1, 1), (1, 3, 1, 0), (1, 4, 0, 1), (2, 3, 1, 0), (2, 4, 0, 1)]
    assert rows(pipelines.pair_counts(obs, EngineConfig())) == all_pairs
    assert rows(pipelines.pair_counts(obs, EngineConfig(min_buy=1, min_pv=2))) == [all_pairs[i] for i in (0, 1, 3)]
    assert rows(pipelines.pair_counts(obs, EngineConfig(min_pv=3))) == all_pairs
    assert rows(pipelines.pair_counts(obs, EngineConfig(max_users_per_item=2))) == []


def test_scores_and_top(obs):
    top = pipelines.similar_users(obs, EngineConfig(top_k=2))
    lines = [r[0] for r in ranking.top_lists(top).select(writers.top_line()).collect()]
    assert sorted(lines) == ["1\t[(2,1.2), (3,1.0)]", "2\t[(1,1.2), (3,1.0)]", "3\t[(1,1.0), (2,1.0)]", "4\t[(1,0.2), (2,0.2)]"]
    assert pipelines.pair_scores(obs, EngineConfig(min_score=1.0)).count() == 3


def test_top_k_is_prefix(obs):
    small, large = (rows(pipelines.similar_users(obs, EngineConfig(top_k=k))) for k in (1, 2))
    assert small == [r for r in large if r[1] == 1]


def test_self_pairs_and_odd_scores_are_dropped(spark):
    bad = spark.createDataFrame([(1, 1, 1.0), (1, 2, float("nan")), (1, 3, float("inf")), (1, 4, 0.0)], "user1 long, user2 long, score double")
    assert rows(ranking.directed(bad)) == [(1, 4, 0.0), (4, 1, 0.0)]
    assert tuple(metrics.candidate_counts(bad).first()) == (2, 1, 2)


def test_shuffle_goldens():
    seed = 0x6A09E667F3BCC909
    assert shuffled(list(range(1, 8)), item_seed(42, 2, seed)) == [7, 3, 2, 6, 5, 1, 4]
    assert shuffled(list(range(1, 7)), item_seed(1, 2, seed)) == [1, 2, 5, 4, 6, 3]
    assert shuffled(list(range(1, 23)), item_seed(42, 1, seed)) == [19, 13, 9, 8, 22, 2, 15, 6, 12, 1, 14, 21, 4, 16, 11, 18, 3, 17, 20, 5, 10, 7]


def group(spark, n, item=42, behavior="pv"):
    return spark.createDataFrame([(u, item, behavior) for u in range(1, n + 1)], "user_id long, item_id long, behavior string")


def ring_pairs(df, cfg):
    return {(r.user1, r.user2) for r in pairs.hybrid_pairs(df, cfg).collect()}


@pytest.mark.parametrize(("k", "want"), [(2, {(3, 7), (2, 3), (2, 6), (5, 6), (1, 5), (1, 4), (4, 7)}), (1, set()), (6, 21)])
def test_compat_rings(spark, k, want):
    got = ring_pairs(group(spark, 7), EngineConfig(sampling="compat", exact_max_users_pv=5, max_neighbours_pv=k))
    assert got == want if isinstance(want, set) else len(got) == want


def test_compat_half_turn(spark):
    got = ring_pairs(group(spark, 6, item=1), EngineConfig(sampling="compat", max_neighbours_pv=3))
    assert got == {(1, 2), (2, 5), (4, 5), (4, 6), (3, 6), (1, 3), (1, 4), (2, 6), (3, 5)}


@pytest.mark.parametrize(("n", "k"), [(6, 1), (7, 3), (12, 5), (13, 4), (30, 9), (31, 30)])
def test_bounded_degree_and_forecast(spark, n, k):
    cfg = EngineConfig(exact_max_users_pv=0, max_neighbours_pv=k)
    df = group(spark, n)
    made = [(r.user1, r.user2) for r in pairs.hybrid_pairs(df, cfg).collect()]
    plan = postings.pair_plan(postings.degrees(postings.edges(df)), cfg).first()
    degree = Counter(u for p in made for u in p)
    assert len(made) == len(set(made)) == plan.planned
    assert all(a < b for a, b in made)
    assert set(degree.values()) <= {plan.k} and (not plan.k or len(degree) == n)


def test_hybrid_without_limit_is_exact(spark):
    df = group(spark, 25, behavior="buy")
    exact = pairs.capped_pairs(df, EngineConfig())
    assert rows(pairs.hybrid_pairs(df, EngineConfig(exact_max_users_buy=-1))) == rows(exact)


def test_exact_counts_of_large_groups_shuffle_no_contributions(spark):
    df = group(spark, 200).union(group(spark, 150, behavior="buy"))
    out = pipelines.pair_counts(df, EngineConfig())
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out) == rows(pairs.count_pairs(pairs.capped_pairs(df, EngineConfig())))


def test_thresholds_of_large_groups_shuffle_no_contributions(spark):
    df = group(spark, 60).union(group(spark, 40, behavior="buy")).union(group(spark, 30, item=43, behavior="buy"))
    cfg = EngineConfig(min_buy=2, min_pv=3)
    out = pipelines.pair_counts(df, cfg)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out) == [(u, v, 2, 1) for u in range(1, 30) for v in range(u + 1, 31)]


def test_lines_of_large_groups_shuffle_no_contributions(spark):
    out = pipelines.pair_counts(group(spark, 60), EngineConfig()).select(writers.pair_line().alias("line"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "format_string" not in plan
    assert sorted(r.line for r in out.collect()) == sorted(f"{u},{v}\t0,1" for u in range(1, 60) for v in range(u + 1, 61))


@pytest.mark.parametrize(("cell", "block_edges"), [(1 << 20, 1 << 20), (200, 1 << 20), (1 << 20, 60)])
def test_cells_count_as_the_join(spark, monkeypatch, cell, block_edges):
    monkeypatch.setattr(pairs, "CELL", cell)
    monkeypatch.setattr(pairs, "BLOCK_EDGES", block_edges)
    ids = [-(2**63), -5, 0, 2**63 - 1, *range(30, 60)]
    made = [(u, i, b) for k, u in enumerate(ids) for i, b in ((7, "buy"), (7, "pv"), (-(2**63), "pv"), (k % 5, "buy")) if (k + i) % 3]
    edge = spark.createDataFrame([*made, (None, 7, "buy"), (3, None, "pv"), (4, None, "pv")], "user_id long, item_id long, behavior string")
    n = edge.count()
    got = pairs.cell_counts(edge, pairs.blocks_of(n, n * 10))
    assert rows(got) == rows(pairs.count_pairs(pairs.exact_pairs(edge)))


def test_a_user_with_half_of_all_edges_is_spread(spark, monkeypatch):
    """Its block is split by items: no packed row holds more than a few edges over the bound, and pairs are added up."""
    monkeypatch.setattr(pairs, "BLOCK_EDGES", 50)
    made = [(0, i, "buy" if i % 3 else "pv") for i in range(400)] + [(u, (u * 7 + i * 13) % 400, "buy" if i % 2 else "pv") for u in range(1, 50) for i in range(8)]
    edge = spark.createDataFrame(sorted(set(made)), "user_id long, item_id long, behavior string")
    seen = spark.sparkContext.accumulator(0)
    plain = pairs.pack_block

    def pack(table):
        seen.add(int(table.num_rows > 120))
        return plain(table)

    monkeypatch.setattr(pairs, "pack_block", pack)
    for least in ((0, 0), (2, 3), (1, 2)):
        blocks = 4
        sizes = edge.groupBy(pairs.block_of(blocks).alias("block")).count().where("count > 100").collect()
        assert sizes and len(sizes) < blocks
        got = pairs.cell_counts(edge, blocks, least, {r.block: r["count"] for r in sizes})
        want = pairs.count_pairs(pairs.exact_pairs(edge))
        if 0 not in least:
            want = want.where(f"buy_count >= {least[0]} or pv_count >= {least[1]}")
        assert rows(got) == rows(want)
    assert seen.value == 0


def test_exact_counts_choose_by_cost(spark, monkeypatch):
    monkeypatch.setattr(pairs, "cell_counts", lambda *a: "cells")
    short = spark.range(2000).selectExpr("id as user_id", "id div 10 as item_id", "'buy' as behavior")
    assert pairs.exact_counts(short) != "cells" and pairs.exact_counts(group(spark, 60).select("user_id", "item_id", "behavior")) == "cells"
    with pytest.raises(TypeError, match="user_id string"):
        pairs.exact_counts(short.selectExpr("cast(user_id as string) user_id", "item_id", "behavior"))


def test_many_contributions_are_not_joined(spark, monkeypatch):
    """360 copies of sf0.1 with users and items of their own (93 contributions an edge, 13 blocks) shuffle no contributions; the counts are the join's."""
    n, made = 360 * 37425, 360 * 3497167.0
    assert not pairs.joined(n, made, pairs.blocks_of(n, made, 8))
    assert pairs.joined(n, 9.0 * n, pairs.blocks_of(n, 9.0 * n, 8))  # lists of at most 18 users
    monkeypatch.setattr(pairs, "MANY", 0)
    apart = spark.range(900).selectExpr("id as user_id", "id div 6 as item_id", "if(id % 12 < 6, 'buy', 'pv') as behavior")
    edge = apart.union(spark.range(900).selectExpr("id", "1000 + id div 6", "'pv'"))
    out = pairs.exact_counts(edge)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out) == rows(pairs.count_pairs(pairs.exact_pairs(edge)))


def apart(spark):
    """Short lists of users of their own, as in copies of a log whose users and items are shifted."""
    lists = spark.range(900).selectExpr("id as user_id", "id div 6 as item_id", "if(id % 12 < 6, 'buy', 'pv') as behavior")
    return lists.union(spark.range(900).selectExpr("id", "1000 + id div 9", "'buy'"))


def test_lines_of_many_short_lists_shuffle_no_contributions(spark, monkeypatch):
    want = [f"{r.user1},{r.user2}\t{r.buy_count},{r.pv_count}" for r in pairs.count_pairs(pairs.exact_pairs(apart(spark))).collect()]
    monkeypatch.setattr(pairs, "MANY", 0)
    out = pipelines.pair_counts(apart(spark), EngineConfig()).select(writers.pair_line().alias("line"))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.line for r in out.collect()) == sorted(want)


def test_thresholds_of_many_short_lists_shuffle_no_contributions(spark, monkeypatch):
    want = rows(pairs.count_pairs(pairs.exact_pairs(apart(spark))).where("buy_count >= 2 or pv_count >= 3"))
    monkeypatch.setattr(pairs, "MANY", 0)
    out = pipelines.pair_counts(apart(spark), EngineConfig(min_buy=2, min_pv=3))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out) == want and want


def test_lines_of_many_blocks_copy_no_block(spark, monkeypatch):
    """Cells read their two blocks where they are written: no shuffle holds a block once per cell."""
    monkeypatch.setattr(pairs, "SHORT", 1)
    monkeypatch.setattr(pairs, "LARGE_CELL", 500)
    monkeypatch.setattr(pairs, "TASKS", 9)  # fewer partitions than blocks
    df = group(spark, 90).union(group(spark, 70, behavior="buy")).union(group(spark, 40, item=43))
    blocks = []
    plain = pairs.cell_counts
    monkeypatch.setattr(pairs, "cell_counts", lambda edge, n, *more: blocks.append(n) or plain(edge, n, *more))
    out = pipelines.pair_counts(df, EngineConfig()).select(writers.pair_line().alias("line"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert blocks[0] > 4 and "CartesianProduct" in plan and "Exchange" not in plan
    want = pairs.count_pairs(pairs.exact_pairs(df)).select(writers.pair_line().alias("line"))
    assert sorted(r.line for r in out.collect()) == sorted(r.line for r in want.collect())


def test_thresholds_of_many_blocks_copy_no_block(spark, monkeypatch):
    """As many blocks as there may be cost no shuffle of their cells; neither thresholds nor two blocks split by items lose a pair."""
    made = {(u, (u * k + i) % 12, b) for u in range(40) for k, b in ((3, "buy"), (5, "pv"), (7, "pv")) for i in range(3)}
    edge = spark.createDataFrame(sorted(made), "user_id long, item_id long, behavior string")
    want = rows(pairs.count_pairs(pairs.exact_pairs(edge)).where("buy_count >= 2 or pv_count >= 3"))
    for blocks in (2, 9):
        out = pairs.cell_counts(edge, blocks, (2, 3))
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert rows(out) == want and want
    monkeypatch.setattr(pairs, "BLOCK_EDGES", 60)
    assert rows(pairs.cell_counts(edge, 3, (2, 3), {0: 120, 2: 121})) == want


@pytest.mark.parametrize("least", [(0, 0), (2, 3)])
def test_ordered_counts_are_in_order_unsorted(spark, monkeypatch, least):
    """A frame for each range of first users, every partition in order without a sort, all pairs of the join."""
    monkeypatch.setattr(pairs, "SHORT", 1)
    ids = [-(2**63), -5, 0, 2**63 - 1, *range(30, 200)]
    edge = spark.createDataFrame([(u, i, b) for k, u in enumerate(ids) for i in range(9) for b in ("buy", "pv") if (k * i + k) % 4], "user_id long, item_id long, behavior string")
    frames = list(pairs.ordered_counts(edge, least, most=20_000))
    assert len(frames) > 2 and all("Sort" not in f._jdf.queryExecution().executedPlan().toString() for f in frames)
    found = [[tuple(r) for r in part] for f in frames for part in f.rdd.glom().collect()]
    assert all(part == sorted(part) for part in found)
    want = pairs.count_pairs(pairs.exact_pairs(edge)).where(f"{0 in least} or buy_count >= {least[0]} or pv_count >= {least[1]}")
    assert sorted(r for part in found for r in part) == rows(want)
    starts = [min(r[0] for r in f.collect()) for f in frames]
    assert starts == sorted(set(starts))
    assert [f.count() for f in pairs.ordered_counts(edge.where("false"), most=10)] == [0]


@pytest.mark.parametrize("most", [2_000, None])
@pytest.mark.parametrize("least", [(0, 0), (2, 3)])
def test_ordered_lines_are_written_in_blocks(spark, monkeypatch, tmp_path, least, most):
    """Lines leave the tasks that count them as texts of many, a frame has few cells, and the files are those of the pairs one by one."""
    ids = [-(2**63), -5, 0, 2**63 - 1, *range(8, 200)]
    edge = spark.createDataFrame([(u, i, b) for k, u in enumerate(ids) for i in range(9) for b in ("buy", "pv") if (k * i + k) % 4], "user_id long, item_id long, behavior string")
    want = [f"{a},{b}\t{x},{y}" for a, b, x, y in rows(pairs.count_pairs(pairs.exact_pairs(edge)).where(f"{0 in least} or buy_count >= {least[0]} or pv_count >= {least[1]}"))]
    for short in (1, pairs.SHORT):  # cells, then a sorted join
        monkeypatch.setattr(pairs, "SHORT", short)
        monkeypatch.setattr(pairs, "MANY", 1 << 26 if short > 1 else 0)
        frames = list(pairs.ordered_counts(edge, least, most=most, lines=True))
        assert (len(frames) > 4) == (short == 1 and most is not None)
        texts = [r.value for f in frames for r in f.collect()]
        assert len(texts) < len(want) / 20
        assert sorted(x for t in texts for x in t.split("\n")) == sorted(want)
        assert all(f.rdd.getNumPartitions() <= 40 for f in frames)
        for i, f in enumerate(frames):
            writers.write_lines(f, str(tmp_path / f"{short}.{i}"), most=2)
        found = [metrics.line_order(spark, str(tmp_path / f"{short}.{i}")).first() for i in range(len(frames))]
        assert (sum(r.lines for r in found), sum(r.misplaced for r in found)) == (len(want), 0)


@pytest.mark.parametrize("piece", [1, 9, 30, 1 << 18])
def test_order_of_a_text_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(metrics, "PIECE", piece)
    pair = [(-(2**63), 5), (-7, 2**63 - 1), (-7, -8), (3, 4), (3, 10), (3, 9), (12, 13)]
    text = "".join(f"{a},{b}\t{i},{10**i}\n" for i, (a, b) in enumerate(pair)).encode()
    assert metrics.order_of(text) == (7, 2)
    assert metrics.order_of(b"") == (0, 0)
    for bad in (text[:-1], text.replace(b"\t", b" "), text + b"\n"):
        with pytest.raises(ValueError):
            metrics.order_of(bad)


def test_lines_out_of_order_are_told(spark, tmp_path):
    """Within a batch, between batches and between splits of a file; files are not compared."""
    right = [f"{u},{v}\t0,1" for u in range(9, 59) for v in range(u + 1, 60)]
    (tmp_path / "a").write_text("\n".join(right) + "\n")
    (tmp_path / "b").write_text("\n".join(right[:7] + ["9,11\t1,1"] + right[7:] + ["1,2\t0,1"]) + "\n")
    own = spark.newSession()
    for batch, split in ((10_000, "128m"), (3, "128m"), (7, "300b"), (1, "300b")):
        own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        own.conf.set("spark.sql.files.maxPartitionBytes", split)
        assert tuple(metrics.line_order(own, str(tmp_path)).first()) == (2 * len(right) + 2, 2)
    (tmp_path / "c").mkdir()
    assert tuple(metrics.line_order(own, str(tmp_path / "c")).first()) == (0, 0)


def test_every_core_has_a_cell():
    for cores in (1, 4, 8, 300):
        b = pairs.blocks_of(1000, 1000 * 500.0, cores)
        assert b * (b + 1) // 2 >= cores and b <= 31  # 500 contributions an edge pay for 31 copies of it


@pytest.mark.parametrize("at_once", [1, 40, 1 << 20])
def test_contributions_are_counted_in_bounded_parts(monkeypatch, at_once):
    monkeypatch.setattr(pairs, "AT_ONCE", at_once)
    side = lambda users: tuple(np.array(x) for x in zip(*[(u, u % k, b) for u in users for k in (2, 3) for b in (False, True)]))
    low, high = side(range(20)), side(range(20, 50))
    for left, right, own in ((low, high, False), (low, low, True)):
        got = [r for b in pairs.counted(left, right, own) for r in zip(*b.to_pydict().values())]
        want = Counter((min(u, v), max(u, v), bool(b)) for u, i, b in zip(*left) for v, j, c in zip(*right) if i == j and b == c and (u < v if own else True))
        assert len(got) == len({r[:2] for r in got})
        assert {(u, v, b): n for u, v, *own_ in got for b, n in zip((True, False), own_) if n} == want


@pytest.mark.parametrize("worth", [0, 1, 10**6])
@pytest.mark.parametrize("least", [(2, 3), (1, 0), (9, 2)])
def test_groups_counted_by_bits_and_thresholds(monkeypatch, worth, least):
    monkeypatch.setattr(pairs, "BITS", worth)
    monkeypatch.setattr(pairs, "PAIRS", 70)
    side = lambda users: tuple(np.array(x) for x in zip(*[(u, i, b) for u in users for i in range(300) for b in (False, True) if (u * i + u + b) % (2 + i % 3) == 0 or i == u == 5]))
    low, high = side(range(18)), side(range(18, 29))
    low = tuple(np.append(x, y) for x, y in zip(low, (17, 4, True)))  # an edge that may be there before
    for left, right, own in ((low, high, False), (low, low, True)):
        want = Counter((min(u, v), max(u, v), bool(b)) for u, i, b in zip(*left) for v, j, c in zip(*right) if i == j and b == c and (u < v if own else True))
        both = {p: (want[*p, True], want[*p, False]) for p in {k[:2] for k in want}}
        got = [r for b in pairs.counted(left, right, own, least) for r in zip(*b.to_pydict().values())]
        assert sorted(got) == sorted((*p, x, y) for p, (x, y) in both.items() if x >= least[0] or y >= least[1])


def test_large_groups_are_counted_without_their_contributions(monkeypatch):
    users = np.arange(3000)
    side = (np.repeat(users, 40), np.tile(np.arange(40), 3000), np.zeros(120_000, bool))
    repeat, longest = np.repeat, []
    monkeypatch.setattr(np, "repeat", lambda *a, **k: longest.append(len(out := repeat(*a, **k))) or out)
    assert list(pairs.counted(side, side, True, (1, 41))) == []  # 180 million contributions, no pair passes
    assert max(longest) < 1000


def test_edges_of_many_blocks_leave_no_shuffle_behind(spark):
    df = group(spark, 200).union(group(spark, 150, behavior="buy"))
    plan = pipelines.pair_counts(df, EngineConfig(min_buy=1, min_pv=2))._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "FlatMapGroupsInArrow" not in plan
    assert pairs.blocks_of(2_245_500, 1.26e10) <= 16 < pairs.blocks_of(2_245_500, 1.26e12)


def test_order_and_repeats_do_not_matter(spark, obs):
    again = obs.union(obs).repartition(3).orderBy(F.desc("user_id"))
    assert rows(pipelines.similar_users(again)) == rows(pipelines.similar_users(obs))


def test_empty_log(spark):
    none = spark.createDataFrame([], "user_id long, item_id long, behavior string")
    assert pipelines.similar_users(none).count() == 0
    assert pipelines.pair_counts(none, EngineConfig()).count() == 0


@pytest.mark.parametrize("bad", [{"top_k": 0}, {"weight_pv": -1.0}, {"weight_buy": float("nan")}, {"min_score": -0.1}, {"exact_max_users_pv": -2}, {"max_neighbours_buy": -1}, {"user_index": -1}, {"sampling": "x"}, {"delimiter": ""}, {"min_buy": -1}])
def test_config_is_validated(bad):
    with pytest.raises(ConfigError):
        EngineConfig(**bad).validate()
