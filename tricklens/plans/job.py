"""Batch job: read rounds, summarize, write one JSON row.

    spark-submit submit_summary.py --input s3a://.../rounds/ --output s3a://.../summary/ \
        --roster s3a://.../roster.json [--format json|parquet] [--infer-schema] [--topology original|corrected] \
        [--rules '{"aces_over": 1}'] [--column-order a,b,...] [--strict] [--preview]

The roster maps each person to a list of lower-case aliases, e.g.
``{"ann": ["ann", "annie"], "bo": ["bo"]}``: JSON text, or a path that Spark
reads. The caller's ``spark-submit`` provides the session and cluster settings.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tricklens.model import Roster, Rules
from tricklens.plans.audit import summarize_with_account
from tricklens.plans.results import get, put, replace_rows
from tricklens.plans.summary import summarize
from tricklens.sources.rounds import read_rounds


MANIFEST = "_manifest"


def write_summary(summary: DataFrame, path: str) -> None:
    """``path`` becomes a folder with the summary as JSON lines in a single file.

    Overwrites in one step: readers of the folder see the row that was there
    or the new one. Null totals are left out of the JSON object.
    """
    replace_rows(summary, path)


def read_manifest(spark: SparkSession, output_path: str) -> dict:
    """What the job that wrote ``output_path`` read: ``files``, and the counts of bad lines if it kept them."""
    return json.loads(get(spark, f"{output_path.rstrip('/')}/{MANIFEST}") or "{}")


def load_roster(spark: SparkSession, text_or_path: str) -> Roster:
    """A roster from JSON text, or from a JSON file on any storage that Spark reads."""
    text = text_or_path
    if not text_or_path.lstrip().startswith("{"):
        text = spark.read.text(text_or_path, wholetext=True).first()["value"]
    return Roster.of(json.loads(text))


def run(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    roster: Roster,
    fmt: str = "json",
    rules: Rules = Rules(),
    preview: bool = False,
    column_order: Sequence[str] | None = None,
    infer_schema: bool = False,
    bad_lines: str | None = None,
) -> DataFrame:
    """Read, summarize, write; returns the summary.

    The input's files are fixed when they are listed at the start. Their names
    are written beside the result (``MANIFEST``, which readers of the folder do
    not see), so that count and sums can be had again from just these files
    whatever has arrived since. ``bad_lines`` names a folder for the lines that
    are no round records; the same scan writes them, and the manifest counts them.
    """
    rounds = read_rounds(spark, input_path, fmt, infer_schema, bad_lines is not None)
    files, account = sorted(rounds.inputFiles()), {}
    if bad_lines is not None:
        summary, account = summarize_with_account(rounds, roster, bad_lines, rules, column_order)
    else:
        summary = summarize(rounds, roster, rules, column_order)
    write_summary(summary, output_path)
    put(spark, f"{output_path.rstrip('/')}/{MANIFEST}", json.dumps({"files": files, **account}))
    if preview:
        # Reads the written row back instead of re-running the plan.
        written = spark.read.json(output_path)
        written.show(10, truncate=False)
        written.printSchema()
    return summary


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--roster", required=True, help="JSON text or path of a JSON file")
    parser.add_argument("--format", default="json")
    parser.add_argument("--topology", default="original", choices=["original", "corrected"])
    parser.add_argument("--infer-schema", action="store_true", help="take every JSON value in the type it has")
    parser.add_argument("--bad-lines", help="folder for the lines that are no round records")
    parser.add_argument("--rules", default="{}", help="JSON object of other rules: thresholds, figure_weights")
    parser.add_argument("--column-order", help="all summary columns, comma-separated, in the order to write")
    parser.add_argument("--strict", action="store_true", help="fail on records the metrics cannot read")
    parser.add_argument("--preview", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("round-summary").getOrCreate()
    run(
        spark,
        args.input,
        args.output,
        load_roster(spark, args.roster),
        fmt=args.format,
        rules=Rules(topology=args.topology, strict=args.strict, **json.loads(args.rules)),
        preview=args.preview,
        column_order=args.column_order.split(",") if args.column_order else None,
        infer_schema=args.infer_schema,
        bad_lines=args.bad_lines,
    )


if __name__ == "__main__":
    main()
