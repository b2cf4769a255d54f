"""python -m sievelake scan TARGET [--format terminal|json|sarif|html] [--output FILE] [--ai] ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from sievelake.operators.assess import PROVIDERS
from sievelake.plans.scan import scan
from sievelake.sources.sinks import WRITERS, text_report


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievelake")
    s = p.add_subparsers(dest="command", required=True).add_parser("scan")
    s.add_argument("target")
    s.add_argument("--format", choices=["terminal", *WRITERS], default="terminal")
    s.add_argument("--output")
    s.add_argument("--ai", action="store_true")
    s.add_argument("--ai-provider", default="mock")
    s.add_argument("--ai-mode", default="hybrid")
    s.add_argument("--fail-on", default="LOW")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: nothing at or above the threshold; 1: something; 2: the scan could not be made or reported."""
    args = parser().parse_args(argv)
    if args.ai and args.ai_provider not in PROVIDERS:
        print(f"Unknown AI provider '{args.ai_provider}'", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("sievelake").getOrCreate()
    try:
        session = scan(spark, args.target, ai=args.ai, mode=args.ai_mode, provider=args.ai_provider)
    except FileNotFoundError as e:
        print(f"No such target: {e}", file=sys.stderr)
        return 2
    if session.project()["file_count"] == 0:
        print("Warning: no scannable files found.")
        return 0
    if args.format != "terminal":
        if not args.output:
            print("--output is required when --format is not terminal", file=sys.stderr)
            return 2
        WRITERS[args.format](session, args.output)
        print(f"Report written to {args.output}")
    else:
        for line in text_report(session):
            print(line)
    return int(session.fails(args.fail_on))


if __name__ == "__main__":
    sys.exit(main())
