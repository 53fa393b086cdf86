"""Evaluate a golden set and gate on the result.

Exit status: 0 passed, 1 gate failed, 2 the evaluation itself failed.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import evaluation as E
from quarrylens.session import shared_dir
from quarrylens.sources.tables import read_golden_set, write_jsonl, write_report


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--dataset", required=True, help="golden triplets, JSON lines")
    parser.add_argument("--output", help="folder for results and report")
    parser.add_argument("--threshold", type=float, default=E.FAITHFULNESS_THRESHOLD)
    parser.add_argument("--fast", action="store_true", help=f"only the first {E.FAST_TRIPLETS} triplets")
    parser.add_argument("--no-gate", action="store_true", help="report without failing")
    parser.add_argument("--require-all-categories", action="store_true")
    return parser.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        rows = read_golden_set(spark, args.dataset)
        # Ids follow the file order: partitions are numbered in reading order.
        triplets = rows.withColumn("response_id", F.monotonically_increasing_id())
        chosen = E.first_triplets(triplets, "response_id", E.FAST_TRIPLETS if args.fast else 0)
        # Written once: the report, the verdict and the output files read the same answers.
        path = f"{shared_dir(spark)}/evaluation-{uuid.uuid4().hex}"
        answered = E.evaluate_triplets(chosen)
        answered.write.parquet(path)
        results = spark.read.schema(answered.schema).parquet(path)
        report = E.eval_report(results, args.threshold)
        report = report.withColumn("timestamp", F.current_timestamp().cast("string")).withColumn("dataset_path", F.lit(args.dataset))
        figures = report.first().asDict()
        verdict = E.gate_verdict(results, args.threshold, args.require_all_categories).first()
        if args.output:
            write_jsonl(results, f"{args.output}/results")
            write_report(report, f"{args.output}/report")
    except Exception as exc:  # noqa: BLE001  the exit status carries it
        print(f"evaluation failed: {exc}", file=sys.stderr)
        return 2
    print(E.report_text(figures))
    if args.no_gate or verdict["passed"]:
        return 0
    print("gate failed: " + ", ".join(verdict["failures"]), file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.getOrCreate(), arguments(sys.argv[1:])))
