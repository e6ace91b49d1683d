"""Command line: python -m sigmill COMMAND ...

    methods                          list schedulable methods
    quality BARS --interval 1h       quality checks of a bar store
    signal BARS EXPRESSION OUT       evaluate an expression, write (symbol, open_time, signal)
    backtest BARS SIGNALS OUT        positions and returns of candidate signals
    gates RESULTS OUT                gate items of result rows
    score RESULTS OUT                tiers, research gate and hard score
    archive RESULTS OUT              JSON bundle with hashes
    verify BUNDLE                    check the hashes of a bundle
    ledger TRIALS                    trial counts by family
    query NAME SF_DIR                run a registered query and show it

BARS, SIGNALS, RESULTS, TRIALS and OUT are Parquet paths.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill import queries
from sigmill.operators import ledger, quality, rules, simulate
from sigmill.plans import expr, methods
from sigmill.sources import bars


def tiers(spark: SparkSession, path: str) -> DataFrame:
    return rules.hard_score(rules.research_gate(rules.stratify(spark.read.parquet(path))))


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    a, out = args.args, None
    if args.command == "methods":
        methods.schedulable(spark).select("method_id", "family").show(100, False)
    elif args.command == "quality":
        quality.quality_checks(bars.scan_bars(spark, a[0]), bars.interval_ms(args.interval)).show(1000, False)
    elif args.command == "signal":
        out = expr.signal(bars.scan_bars(spark, a[0]), a[1]).select("symbol", "open_time", "signal")
    elif args.command == "backtest":
        rule = simulate.Rules(entry_band=args.entry_band, exit_band=args.exit_band, stop_loss=args.stop_loss)
        out = simulate.backtest(spark.read.parquet(a[1]), bars.scan_bars(spark, a[0]), sizing=simulate.Sizing(interval=args.interval), rules=rule)
    elif args.command == "gates":
        out = rules.gates(spark.read.parquet(a[0]))
    elif args.command == "score":
        out = tiers(spark, a[0])
    elif args.command == "archive":
        ledger.write_bundle(spark, spark.read.parquet(a[0]), a[1])
    elif args.command == "verify":
        bad = ledger.verify_bundle(spark, a[0]).where("not valid").count()
        print(f"{bad} damaged")
        return int(bad > 0)
    elif args.command == "ledger":
        ledger.trial_counts(spark.read.parquet(a[0]), F.current_timestamp()).show(1000, False)
    elif args.command == "query":
        queries.QUERIES[a[0]](spark, a[1]).show(args.rows, False)
    if out is not None:
        out.write.mode("overwrite").parquet(a[-1])
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="sigmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices="methods quality signal backtest gates score archive verify ledger query".split())
    p.add_argument("args", nargs="*")
    p.add_argument("--interval", default="5m")
    p.add_argument("--entry-band", type=float, default=0.0)
    p.add_argument("--exit-band", type=float, default=0.0)
    p.add_argument("--stop-loss", type=float, default=0.0)
    p.add_argument("--rows", type=int, default=20)
    args = p.parse_args(argv)
    return run(spark or SparkSession.builder.appName("sigmill").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
