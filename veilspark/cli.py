"""Command line: python -m veilspark.cli entities|redact (--text TEXT | --file PATH | --stdin) [--out PATH]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import pipeline
from .sources import adapters, sinks

#: Texts to try with --demo: plain data, and things that only look like data.
DEMO = (
    "Mail anna.berg@example.com or call 555-123-4567.",
    "Card 4111 1111 1111 1111, order number 1234 5678.",
    "IBAN GB82 WEST is cut off; GB82WEST12345698765432 is not.",
)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="veilspark")
    parser.add_argument("command", choices=("entities", "redact"))
    given = parser.add_mutually_exclusive_group(required=True)
    given.add_argument("--text", action="append")
    given.add_argument("--file")
    given.add_argument("--stdin", action="store_true")
    given.add_argument("--demo", action="store_true")
    parser.add_argument("--out", help="a folder for JSON lines instead of the screen")
    parser.add_argument("--labels", action="store_true", help="redact with class names")
    args = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("veilspark").getOrCreate()
    if args.file:
        texts = adapters.read_texts(spark, args.file)
    else:
        texts = adapters.given_texts(spark, list(DEMO) if args.demo else args.text or [line.rstrip("\n") for line in sys.stdin])
    docs = texts.withColumnRenamed("path", "doc_id")
    out = sinks.entity_json(pipeline.entities(docs)) if args.command == "entities" else pipeline.redacted(docs, labels=args.labels)
    if args.out:
        out.write.mode("overwrite").json(args.out)
    else:
        out.show(100, truncate=False)


if __name__ == "__main__":
    main()
