"""The sampler, readers of CSV, sinks and the command line."""

import json
import random

import pytest

from affinity import cli
from affinity.config import ConfigError, EngineConfig, SamplerConfig
from affinity.functions.columns import stable_hash_hex
from affinity.operators import sampler
from affinity.plans import pipelines
from affinity.sources import readers, writers


def test_stable_hash_goldens(spark):
    want = {0: 16944439436457992629, 1: 1778789418868501248, 100: 8154908533240354144, 1000001: 1291643021534783827}
    got = spark.createDataFrame([(v,) for v in want], "v long").select("v", stable_hash_hex(__import__("pyspark").sql.functions.col("v"), 20260703).alias("h")).collect()
    assert {r.v: int(r.h, 16) for r in got} == want


def test_stable_hash_equals_whole_numbers_of_python(spark):
    from pyspark.sql import functions as F

    rng, mask = random.Random(2), (1 << 64) - 1
    values = [0, -1, 1, 2**63 - 1, -(2**63), 2**32, 2**32 - 1, *(rng.getrandbits(64) - 2**63 for _ in range(300))]

    def hashed(v, seed):
        x = ((v ^ seed) + 0x9E3779B97F4A7C15) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return f"{x ^ x >> 31:016x}"

    for seed in (0, 20260703, 2**62 + 12345):
        df = spark.createDataFrame([(v,) for v in values], "v long").select("v", stable_hash_hex(F.col("v"), seed).alias("h"))
        assert {r.v: r.h for r in df.collect()} == {v: hashed(v, seed) for v in values}
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("sizes", "budget", "want"), [([40, 70, 30, 50, 10], 100, [0, 2, 4]), ([5], 4, []), ([], 9, []), ([3, 3, 3], 9, [0, 1, 2])])
def test_greedy_skips_and_goes_on(spark, sizes, budget, want):
    df = spark.createDataFrame([(i, n, 0, f"{i:016x}") for i, n in enumerate(sizes)], "user_id long, size long, score long, h string")
    taken, used = sampler.greedy(df, 0, budget)
    assert sorted(r.user_id for r in taken.collect()) == want and used == sum(sizes[i] for i in want)


def test_greedy_over_many_ranges_equals_a_walk(spark):
    import random

    random.seed(5)
    items = [(i, random.randint(1, 90), random.randint(0, 3), f"{random.getrandbits(64):016x}") for i in range(3000)]
    for budget, stop in ((40_000, None), (40_000, 39_000), (10**9, None)):
        used, want = 100, []
        for i, size, _, _ in sorted(items, key=lambda x: (-x[2], x[3])):
            if used + size <= budget:
                want.append(i)
                used += size
                if stop is not None and used >= stop:
                    break
        taken, got = sampler.greedy(spark.createDataFrame(items, "user_id long, size long, score long, h string"), 100, budget, stop)
        assert got == used and sorted(r.user_id for r in taken.collect()) == sorted(want)


def test_greedy_takes_one_round_per_power_of_two(spark, monkeypatch):
    """Sizes that each leave room for one small profile more, by the thousand, and a budget that never fills."""
    rounds = []
    plain = sampler.first_stop
    monkeypatch.setattr(sampler, "first_stop", lambda *a: rounds.append(1) or plain(*a))
    sizes = [x for k in range(1500) for x in (1, 3000 - k)]
    df = spark.createDataFrame([(i, n, 0, f"{i:016x}") for i, n in enumerate(sizes)], "user_id long, size long, score long, h string")
    for budget in (1000, 3000, 4400):
        rounds.clear()
        used, want = 0, []
        for i, n in enumerate(sizes):
            if used + n <= budget:
                want.append(i)
                used += n
        taken, got = sampler.greedy(df, 0, budget)
        assert (sorted(r.user_id for r in taken.collect()), got) == (want, used) and len(rounds) <= budget.bit_length() + 1


def test_nearest_rank_equals_sorting(spark):
    rng = random.Random(4)
    for values in ([7] * 50, [-5, -5, 3], [rng.randrange(-(2**62), 2**62) for _ in range(500)], [rng.choice([1, 2, 2, 3, 900_000]) for _ in range(400)], [2**63 - 1, -(2**63), 0]):
        stats = spark.createDataFrame([(v,) for v in values], "total long")
        got = sampler.nearest_rank(stats, "total", {"low": 0.1, "mid": 0.5, "high": 0.95})
        assert got == {name: sorted(values)[round((len(values) - 1) * f)] for name, f in (("low", 0.1), ("mid", 0.5), ("high", 0.95))}


def test_nearest_rank_rounds_half_to_even(spark):
    for n, fraction, want in ((11, 0.95, 10), (6, 0.5, 2), (4, 0.5, 2)):
        stats = spark.createDataFrame([(i,) for i in range(n)], "total long")
        assert sampler.nearest_rank(stats, "total", {"p": fraction}) == {"p": want}
    assert sampler.nearest_rank(spark.createDataFrame([], "total long"), "total", {"p": 0.5}) == {"p": 0}


CSV = '﻿user,item,cat,behavior,time\n1,10,7,buy,100\n"2"," 10",7,Fav,101,more\n3,x,7,buy,1\n4,10,7,,5\n5,10,7,pv,noon\n6,10\n1,11,7,pv,102\n'


@pytest.fixture
def source(tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(CSV, encoding="utf-8")
    return str(path)


def test_csv5(spark, source):
    assert readers.detect_header(spark, source)
    got = sorted((r.user_id, r.item, r.behavior, r.ts) for r in readers.read_csv5(spark, source).collect())
    assert got == [(1, "10", "buy", "100"), (1, "11", "pv", "102"), (2, "10", "fav", "101")]


def test_sampler_run(spark, tmp_path):
    path, out = tmp_path / "in.csv", str(tmp_path / "out")
    path.write_text("".join(f"{u},{i},0,{'buy' if i % 2 else 'fav'},{100 + i}\n" for u in range(1, 60) for i in range(u % 7 + 2)))
    cfg = SamplerConfig(2000, 1800, 2200)
    done = pipelines.run_sampler(spark, str(path), out, cfg)
    report = json.loads(open(out + ".report.json").read())
    lines = [r.value for r in spark.read.text(out).collect()]
    assert cfg.min_bytes <= sum(len(x) + 1 for x in lines) == report["actual_output_bytes"] <= cfg.max_bytes
    assert len(lines) == report["rows_written"]
    users = {r.user_id for r in done.selection.users.collect()}
    assert {int(x.split(",")[0]) for x in lines} == users
    per_user = {u: u % 7 + 2 for u in users}
    assert len(lines) == sum(per_user.values())  # whole profiles only
    again = sampler.select_users(readers.read_csv5(spark, str(path)), cfg)
    assert {r.user_id for r in again.users.collect()} == users


def test_sampler_refuses_small_sources(spark, source, tmp_path):
    with pytest.raises(pipelines.SourceTooSmall):
        pipelines.run_sampler(spark, source, str(tmp_path / "o"), SamplerConfig(2000, 1800, 2200))
    with pytest.raises(ValueError, match="different"):
        pipelines.run_sampler(spark, source, source, SamplerConfig())
    with pytest.raises(ConfigError):
        SamplerConfig(1, 2, 3).validate()


def test_sinks_and_overwrite_guard(spark, tmp_path):
    log, out = tmp_path / "log.txt", str(tmp_path / "pairs")
    log.write_text("1,10,buy\n2,10,buy\n2,10,pv\n3,10,pv\n")
    pipelines.run_counts(spark, str(log), out, EngineConfig())
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["1,2\t1,0", "2,3\t0,1"]
    with pytest.raises(Exception, match="(?i)exists"):
        pipelines.run_counts(spark, str(log), out, EngineConfig())
    pipelines.run_counts(spark, str(log), out, EngineConfig(overwrite=True))
    with pytest.raises(ValueError, match="different"):
        writers.guard(out, str(tmp_path / "x" / ".." / "pairs"))


def test_command_line(spark, tmp_path, capsys):
    log, out = tmp_path / "log.txt", str(tmp_path / "top")
    log.write_text("1,10,buy\n2,10,buy\n")
    assert cli.main(["top", str(log), out, "--stages", str(tmp_path / "stages"), "--count-results"]) == 0
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["1\t[(2,1.0)]", "2\t[(1,1.0)]"]
    assert spark.read.parquet(str(tmp_path / "stages/postings")).count() == 1
    assert cli.main(["top", str(log), out]) == 1  # the output exists
    assert cli.main(["top", str(log), out, "--top-k", "0"]) == 2
    assert cli.main(["nothing"]) == 2
    assert cli.main(["sample", "--input", str(log), "--output", str(tmp_path / "s"), "--header", "no"]) == 3


def test_summary_persist_and_order(spark, tmp_path, capsys):
    log, out = tmp_path / "log.txt", str(tmp_path / "pairs")
    log.write_text("1,10,buy\n2,10,buy\n3,10,buy\n2,20,pv\n1,20,pv\nx,1,buy\n")
    assert cli.main(["counts", str(log), out, "--persist-final", "--ordered", "--count-results", "--summary"]) == 0
    said = dict(x.split("=") for x in capsys.readouterr().out.splitlines() if "=" in x)
    want = {"RECORDS_BUY": 3, "RECORDS_INVALID": 1, "BUY_POSTING_LISTS": 1, "BUY_GENERATED": 3, "PV_GENERATED": 1, "EMITTED_PAIRS": 3, "DIRECTED_CANDIDATES": 6, "USERS_EMITTED": 3}
    assert {k: int(said[k]) for k in want if k in said} == {k: v for k, v in want.items() if k in said} and len(set(want) & set(said)) >= 7, said
    for f in (tmp_path / "pairs").glob("part-*"):
        pairs = [tuple(map(int, x.split("\t")[0].split(","))) for x in f.read_text().splitlines()]
        assert pairs == sorted(pairs)


def test_written_size_is_checked(spark, tmp_path):
    path, out = tmp_path / "in.csv", str(tmp_path / "out")
    path.write_text("".join(f"{u},{i},0,{'buy' if i % 2 else 'fav'},{100 + i}\n" for u in range(1, 60) for i in range(u % 7 + 2)))
    projected = pipelines.run_sampler(spark, str(path), out, SamplerConfig(2000, 1800, 2200)).report["actual_output_bytes"]
    # the header lines, which the projection leaves out, pass the largest size
    with pytest.raises(pipelines.SizeOutOfRange):
        pipelines.run_sampler(spark, str(path), str(tmp_path / "more"), SamplerConfig(projected, 1800, projected + 10, write_header=True))


def test_places_in_other_file_systems(spark, tmp_path):
    for a, b in (("hdfs://n/a/b", "hdfs://n/a/./b/"), ("file:///a/b", "/a/b"), ("file:/a//b", "/a/b")):
        with pytest.raises(ValueError, match="different"):
            writers.guard(a, b)
    writers.guard("hdfs://n/a", "hdfs://m/a", "/a")
    writers.write_report(spark, {"a": 1}, f"file://{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1}


def test_behavior_codes(spark):
    from affinity.functions.columns import behavior_code, behavior_name

    df = spark.createDataFrame([("buy", 1), ("pv", 2), ("fav", 3), (None, None)], "name string, code int")
    got = df.select(behavior_code(df.name), behavior_name(df.code)).collect()
    assert [tuple(r) for r in got] == [(1, "buy"), (2, "pv"), (None, "unknown"), (None, "unknown")]
