"""Quoted CSV, atomic publishing, counters of the run itself, stored posting lists."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from affinity.config import EngineConfig, SamplerConfig
from affinity.operators import metrics, pairs, postings, ranking
from affinity.plans import pipelines
from affinity.sources import readers, writers

BITS = ["a", '"', ",", "\\", " ", "buy", "é", "#", "\t"]


def read_by_csv(path, header):
    """The events of a file as the csv module reads it."""
    out = []
    with open(path, encoding="utf-8-sig", newline="") as f:
        rows = csv.reader(f)
        if header:
            next(rows, None)
        for row in rows:
            if len(row) < 5:
                continue
            user, item, behavior, ts = row[0].strip(), row[1].strip(), row[3].strip().lower(), row[4].strip()
            if behavior and all(x.lstrip("+-").isdigit() for x in (user, item, ts)):
                out.append((int(user), user, item, behavior, ts))
    return sorted(out)


@pytest.mark.parametrize("ends, mark, quoting, line_end", [([], "utf-8-sig", csv.QUOTE_MINIMAL, "\n"), (["\n", "\r\n"], "utf-8", csv.QUOTE_ALL, "\r\n"), (["\n", "\r\n"], "utf-8-sig", csv.QUOTE_MINIMAL, "\n")])
def test_csv_equals_the_csv_module(spark, tmp_path, ends, mark, quoting, line_end):
    rng, path = random.Random(3), str(tmp_path / "log.csv")
    text = lambda: "".join(rng.choice(BITS + ends) for _ in range(rng.randrange(6)))
    with open(path, "w", encoding=mark, newline="") as f:
        rows = csv.writer(f, lineterminator=line_end, quoting=quoting)
        for k in range(600):
            rows.writerow([text() if k % 9 == 4 else f" {k}" if k % 9 == 5 else str(k), str(k % 77), text(), text() if k % 3 else "Buy", str(1000 + k), *([text()] if k % 5 == 0 else [])][: 4 if k % 50 == 1 else 9])
    assert readers.spans_lines(spark, path) == bool(ends)
    for header in ("no", "yes"):
        got = sorted(tuple(r) for r in readers.read_csv5(spark, path, header).select("user_id", "user", "item", "behavior", "ts").collect())
        assert got == read_by_csv(path, header == "yes") and len(got) > 400
    if not ends:  # read in splits, as no field spans lines, or whole: the same
        split, whole = (sorted(map(repr, readers.read_csv5(spark, path, "no", multi_line=m).collect())) for m in (False, True))
        assert split == whole
    events = readers.read_csv5(spark, path, "no").coalesce(1)
    want = io.StringIO(newline="")
    rows = csv.writer(want, lineterminator="\n")
    rows.writerow(["user_id", "item_id", "behavior", "timestamp"])
    rows.writerows([(r.user, r.item, r.behavior, r.ts) for r in events.collect()])
    writers.write_events(events, str(tmp_path / "out"), header=True)
    written = [p for p in os.listdir(tmp_path / "out") if p.startswith("part-")]
    assert "".join((tmp_path / "out" / p).read_bytes().decode() for p in written) == want.getvalue()


def failing(spark):
    return spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("user1"), F.lit(9).alias("user2"), F.lit(1).alias("buy_count"), F.lit(0).alias("pv_count"))


@pytest.mark.parametrize("system", ["file", "viewfs"])
def test_a_failed_run_leaves_the_old_output(spark, tmp_path, system):
    (tmp_path / "there").mkdir()
    base = f"file://{tmp_path}/there"
    if system == "viewfs":
        spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.mounted.link./there", base)
        base = "viewfs://mounted/there"
    out = f"{base}/pairs"
    good = spark.createDataFrame([(1, 2, 1, 0)], "user1 long, user2 long, buy_count long, pv_count long")
    with pytest.raises(Exception, match="lost"):
        writers.write_pairs(failing(spark), out)
    assert os.listdir(tmp_path / "there") == []
    writers.write_pairs(good, out)
    with pytest.raises(Exception, match="lost"):
        writers.write_pairs(failing(spark), out, overwrite=True)
    assert [r.value for r in spark.read.text(out).collect()] == ["1,2\t1,0"]
    with pytest.raises(FileExistsError):
        writers.write_pairs(good, out)
    writers.write_pairs(good.withColumn("pv_count", F.lit(5)), out, overwrite=True)
    assert [r.value for r in spark.read.text(out).collect()] == ["1,2\t1,5"]
    writers.write_report(spark, {"a": 1}, f"{base}/r.json")
    writers.write_report(spark, {"a": 2}, f"{base}/r.json")
    assert (tmp_path / "there/r.json").read_text() == '{\n  "a": 2\n}'
    assert sorted(x for x in os.listdir(tmp_path / "there") if not x.startswith(".")) == ["pairs", "r.json"]


def test_an_output_out_of_range_is_withdrawn(spark, tmp_path):
    path, out = tmp_path / "in.csv", str(tmp_path / "out")
    path.write_text("".join(f"{u},{i},0,{'buy' if i % 2 else 'fav'},{100 + i}\n" for u in range(1, 60) for i in range(u % 7 + 2)))
    size = pipelines.run_sampler(spark, str(path), out, SamplerConfig(2000, 1800, 2200)).report["actual_output_bytes"]
    before = sorted(r.value for r in spark.read.text(out).collect())
    with pytest.raises(pipelines.SizeOutOfRange):
        pipelines.run_sampler(spark, str(path), out, SamplerConfig(size, 1800, size + 10, write_header=True), overwrite=True)
    assert sorted(r.value for r in spark.read.text(out).collect()) == before
    assert sorted(x for x in os.listdir(tmp_path) if not x.startswith(".")) == ["in.csv", "out", "out.report.json"]


def log_of(tmp_path, users=40, items=12):
    rng, path = random.Random(6), tmp_path / "log.txt"
    rows = [f"{rng.randrange(users)},{rng.randrange(items)},{rng.choice(['buy', 'pv', 'PV', 'fav'])}" for _ in range(700)]
    path.write_text("\n".join([*rows, "user,item,behavior", "x,1,buy", "1,2", "", "77,99,buy"]) + "\n")
    return str(path)


def counted_apart(spark, path, cfg):
    """The counters, each by an aggregation of its own over the log."""
    parsed = readers.parse(readers.read_lines(spark, path), cfg)
    obs = readers.observations(parsed)
    degree = postings.degrees(postings.edges(obs))
    made = pairs.hybrid_pairs(obs, cfg)
    scored = ranking.scores(pairs.count_pairs(made), cfg)
    passing = ranking.passing_scores(scored, cfg)
    out = {f"records_{s.lower()}": 0 for s in metrics.STATUSES} | {f"records_{r.status.lower()}": r.records for r in metrics.parse_counts(parsed).collect()}
    out |= metrics.posting_counts(degree, cfg).first().asDict()
    out |= {f"{b}_{name}": 0 for b in ("buy", "pv") for name in ("exact_lists", "sampled_lists", "not_generated", "odd_adjusted", "generated")}
    for r in metrics.pairing_counts(postings.pair_plan(degree, cfg), made).collect():
        out |= {f"{r.behavior}_{name}": n for name, n in r.asDict().items() if name != "behavior"}
    for counts in (metrics.score_counts(scored, cfg), metrics.candidate_counts(passing), metrics.top_counts(ranking.directed(passing), cfg.top_k)):
        out |= counts.first().asDict()
    return out


@pytest.mark.parametrize("cfg", [EngineConfig(has_header=True, top_k=7, min_score=0.5), EngineConfig(max_users_per_item=21, top_k=3), EngineConfig(min_score=1e9)])
def test_counters_are_those_of_the_run(spark, tmp_path, cfg):
    path = log_of(tmp_path)
    run = pipelines.run_top(spark, path, str(tmp_path / "top"), cfg)
    assert run.counters == counted_apart(spark, path, cfg)


def test_counters_of_an_empty_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("1,1,fav\n")
    counters = pipelines.run_top(spark, str(tmp_path / "log.txt"), str(tmp_path / "top"), EngineConfig()).counters
    assert {k: n for k, n in counters.items() if n} == {"records_filtered": 1}


def test_counters_of_a_counts_run(spark, tmp_path):
    path, cfg = log_of(tmp_path), EngineConfig(min_buy=2, min_pv=3)
    run = pipelines.run_counts(spark, path, str(tmp_path / "pairs"), cfg, min_partitions=3)
    lines = [r.value for r in spark.read.text(str(tmp_path / "pairs")).collect()]
    assert run.counters["emitted_pairs"] == len(lines) > 0
    counts = [list(map(int, x.split("\t")[1].split(","))) for x in lines]
    assert [run.counters["buy_generated"], run.counters["pv_generated"]] == [sum(c) for c in zip(*counts)]
    apart = counted_apart(spark, path, cfg)
    assert all(run.counters[k] == apart[k] for k in apart if k.startswith(("records_", "emitted_buy", "emitted_pv", "distinct_", "potential_", "items_")))


def test_the_log_is_read_once(spark, tmp_path):
    """Every line of the input passes a reader's function once while all counters and lists are made."""
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watch, cfg = metrics.Watch(), EngineConfig()
    lines = readers.read_lines(spark, log_of(tmp_path)).mapInArrow(tell, "value string")
    edge, plan = pipelines.watched_edges(lines, cfg, watch)
    lists = pipelines.watched_lists(pipelines.watched_scores(edge, plan, cfg, watch), cfg, watch)
    lists.write.format("noop").mode("overwrite").save()
    counters = pipelines.top_counters(watch)
    assert seen.value == 705 == sum(counters[f"records_{s.lower()}"] for s in metrics.STATUSES)


def test_a_run_goes_on_from_stored_lists(spark, tmp_path):
    path, stages, cfg = log_of(tmp_path), str(tmp_path / "stages"), EngineConfig(top_k=5)
    fresh = pipelines.run_top(spark, path, str(tmp_path / "a"), cfg, stages)
    assert fresh.counters == counted_apart(spark, path, cfg)
    os.remove(path)
    resumed = pipelines.run_top(spark, None, str(tmp_path / "b"), cfg, stages)
    a, b = (sorted(r.value for r in spark.read.text(str(tmp_path / x)).collect()) for x in "ab")
    assert a == b and a
    assert {k: fresh.counters[k] for k in resumed.counters} == resumed.counters and resumed.counters["users_emitted"] == len(a)


def test_long_lists_are_cut_into_chunks(spark, tmp_path):
    edge = spark.range(5000).selectExpr("cast(1 as bigint) item_id", "'buy' behavior", "case when id < 4000 then id * 3 else 9000000000000000000 + id end as user_id")
    edge = edge.union(spark.createDataFrame([(2, "pv", 5), (2, "pv", -(1 << 63)), (2, "pv", (1 << 63) - 1), (3, "buy", 1)], edge.schema))
    kept = postings.usable(postings.degrees(edge), EngineConfig())
    chunks = postings.posting_chunks(edge, kept, size=64)
    rows = sorted(chunks.collect(), key=lambda r: (r.item_id, r.chunk))
    assert max(r.n for r in rows) <= 64 and len(rows) > 5000 // 64
    for r in rows:
        assert r.users == sorted(r.users) and (r.first, r.last, r.n) == (r.users[0], r.users[-1], len(r.users))
    for i in (1, 2):  # chunks follow each other
        users = [u for r in rows if r.item_id == i for u in r.users]
        assert users == sorted(u.user_id for u in edge.where(f"item_id = {i}").collect())
    writers.write_postings(chunks, str(tmp_path / "p"))
    stored = postings.chunk_edges(spark.read.parquet(str(tmp_path / "p")))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, edge.where("item_id < 3").collect()))


def test_minimum_partitions_shuffle_nothing(spark, tmp_path):
    (tmp_path / "log.txt").write_text("".join(f"{i},1,buy\n" for i in range(3000)))
    lines = readers.read_lines(spark, str(tmp_path / "log.txt"), 12)
    assert lines.rdd.getNumPartitions() >= 12 and lines.count() == 3000
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.files.openCostInBytes") != "1"
