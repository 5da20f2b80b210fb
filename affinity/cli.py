"""Command line: ``counts``, ``top`` and ``sample``. Exit codes: 0 done, 2 bad arguments, 3 source too small, 1 failed."""

from __future__ import annotations

import argparse
import sys
import time
from dataclasses import fields

from .config import ConfigError, EngineConfig, SamplerConfig


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="affinity")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("counts", "top"):
        p = commands.add_parser(name)
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("--partitions", type=int, default=None, help="input partitions at least")
        p.add_argument("--shuffle-partitions", type=int, default=None)
        p.add_argument("--count-results", action="store_true")
        p.add_argument("--persist-final", action="store_true", help="keep the final pairs in memory and on disk while they are written and counted")
        p.add_argument("--ordered", action="store_true", help="pairs in order within each file")
        p.add_argument("--summary", action="store_true", help="print the counters of every step")
        p.add_argument("--stages", default=None, help="folder for posting lists and scores")
        p.add_argument("--resume", action="store_true", help="go on from the posting lists in --stages; the input is not read")
        p.add_argument("--app-name", default="affinity")
        for f in fields(EngineConfig):
            flag = "--" + f.name.replace("_", "-")
            if f.type == "bool":
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, type={"int": int, "float": float}.get(f.type, str), default=f.default)
    p = commands.add_parser("sample")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    for name, value in (("target", 1.55), ("min", 1.50), ("max", 1.60)):
        p.add_argument(f"--{name}-gb", type=float, default=value)
    p.add_argument("--seed", type=int, default=20260703)
    p.add_argument("--header", choices=("auto", "yes", "no"), default="auto")
    p.add_argument("--write-header", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--app-name", default="affinity")
    return top


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    from pyspark.sql import SparkSession

    from .plans import pipelines

    started = time.time()
    try:
        if args.command == "sample":
            cfg = SamplerConfig(int(args.target_gb * 1e9), int(args.min_gb * 1e9), int(args.max_gb * 1e9), args.seed, args.header, args.write_header).validate()
        else:
            cfg = EngineConfig(**{f.name: getattr(args, f.name) for f in fields(EngineConfig)}).validate()
            if args.partitions is not None and args.partitions < 1 or args.shuffle_partitions is not None and args.shuffle_partitions < 1:
                raise ConfigError("partitions must be at least 1")
        spark = SparkSession.builder.appName(args.app_name).getOrCreate()
        if args.command == "sample":
            done = pipelines.run_sampler(spark, args.input, args.output, cfg, args.overwrite)
            print(f"{done.report['rows_written']} rows of {done.report['selected_users']} users written")
        else:
            if args.shuffle_partitions:
                spark.conf.set("spark.sql.shuffle.partitions", args.shuffle_partitions)
            if args.resume and (args.command == "counts" or not args.stages):
                raise ConfigError("--resume goes with top and --stages")
            if args.command == "counts":
                done = pipelines.run_counts(spark, args.input, args.output, cfg, args.partitions, args.persist_final or args.count_results, args.ordered)
            else:
                done = pipelines.run_top(spark, None if args.resume else args.input, args.output, cfg, args.stages, args.partitions)
            if args.count_results:
                # pairs are kept; lists of users are counted where they were written
                print(f"{done.result.count() if args.command == 'counts' else spark.read.text(args.output).count()} lines written")
            if args.summary:
                for name, n in done.counters.items():
                    print(f"{name.upper()}={n}")
        print(f"{time.time() - started:.1f} s")
        return 0
    except pipelines.SourceTooSmall as e:
        print(e, file=sys.stderr)
        return 3
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001 - the command's boundary
        print(f"failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
