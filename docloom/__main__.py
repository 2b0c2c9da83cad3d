"""Command line: ``python -m docloom predict|batch|evaluate``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from . import service
from .sources import sinks
from .sources.files import ACCEPTED

COMMANDS = ("predict", "batch", "evaluate")


def _session() -> SparkSession:
    return SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _show(found: dict) -> str:
    fields = [f"  {k.replace('_', ' ').title():<24}{v['value']} ({v['confidence']:.2f})" for k, v in found["fields"].items()]
    marks = [f"  {k.title():<24}{v['status']}" for k, v in found["visual_marks"].items()]
    return "\n".join(["EXTRACTION RESULT", f"Type: {found['document_type']}", *fields, *marks, f"Overall confidence: {found['overall_confidence']:.2f}", f"Decision: {found['decision']}", *[f"  - {r}" for r in found["review_reasons"]]])


def predict(args: argparse.Namespace) -> int:
    if not os.path.exists(args.input_file):
        print(f"Error: Input file not found: '{args.input_file}'", file=sys.stderr)
        return 1
    try:
        found = service.predict(_session(), args.input_file, document_type=args.schema)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    print(_show(found))
    if args.output:
        service.write_record(found, args.output)
        print(f"Saved to {args.output}")
    return 0


def batch(args: argparse.Namespace) -> int:
    if not os.path.isdir(args.input_dir):
        print(f"Error: Input directory not found: '{args.input_dir}'", file=sys.stderr)
        return 1
    names = sorted(f for f in os.listdir(args.input_dir) if f.lower().endswith(ACCEPTED))
    if not names:
        print(f"No document files found in '{args.input_dir}'")
        return 0
    spark = _session()
    folder = os.path.abspath(args.input_dir)
    docs = service.extract_files(service.read_files(spark, [f"file://{folder}/{f}" for f in names]), document_type=args.schema).cache()
    for row in docs.orderBy("doc_id").toLocalIterator():
        name = os.path.basename(row["doc_id"])
        try:
            found = service.record(row, name)
        except ValueError as e:
            found = {"document": name, "status": "error", "error": str(e)}
        print(f"{name}: " + (found.get("error") or f"{found['document_type']}, {found['decision']} ({found['overall_confidence']:.2f})"))
        if args.output_dir:
            service.write_record(found, os.path.join(args.output_dir, f"{os.path.splitext(name)[0]}_result.json"))
    print(" ".join(f"{k}={v}" for k, v in sinks.batch_summary(docs, docs["error"].isNotNull()).first().asDict().items()))
    return 0


def evaluate(args: argparse.Namespace) -> int:
    try:
        report = service.evaluation_report(service.evaluate_folder(_session(), f"file://{os.path.abspath(args.data_dir)}"))
    except Exception as e:
        print(f"Error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    print(report)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(report)
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="docloom", description="Fields, tables and decisions from documents")
    commands = out.add_subparsers(dest="command")
    p = commands.add_parser("predict", help="one document")
    p.add_argument("input_file")
    p.add_argument("--schema", help="document type, in place of classification")
    p.add_argument("--output", "-o", help="JSON file for the result")
    p.set_defaults(run=predict)
    b = commands.add_parser("batch", help="all documents of a folder; each fails by itself")
    b.add_argument("input_dir")
    b.add_argument("--schema")
    b.add_argument("--output-dir", "-o", help="folder for a JSON file per document")
    b.set_defaults(run=batch)
    e = commands.add_parser("evaluate", help="a folder with samples and ground_truth")
    e.add_argument("data_dir")
    e.add_argument("--output", "-o", help="file for the report")
    e.set_defaults(run=evaluate)
    return out


def main(argv: list[str] | None = None) -> int:
    """Exit code; a first word that is no command is the file to predict."""
    words = list(sys.argv[1:] if argv is None else argv)
    if words and words[0] not in (*COMMANDS, "-h", "--help"):
        words.insert(0, "predict")
    args = parser().parse_args(words)
    if not args.command:
        parser().print_help()
        return 1
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
