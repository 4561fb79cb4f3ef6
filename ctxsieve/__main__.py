"""Command line: trim conversations in JSON files, or replay one transcript.

    python -m ctxsieve trim IN OUT [--keep 0.6] [--pretty]
    python -m ctxsieve replay TRANSCRIPT
"""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ctxsieve", description="Query-aware trimming of contexts on Spark.")
    out.add_argument("--version", action="version", version="ctxsieve 0.2")
    of = out.add_subparsers(dest="command", required=True)
    trim = of.add_parser("trim", help="trim files that hold an array of messages, or messages and keep")
    trim.add_argument("source")
    trim.add_argument("target")
    trim.add_argument("--keep", type=float, help="share of a block's chunks that stays; a file's own keep comes first (0.6)")
    trim.add_argument("--pretty", action="store_true", help="indent the JSON")
    replay = of.add_parser("replay", help="what trimming tool outputs would have removed from a transcript")
    replay.add_argument("source")
    return out


def run(args: argparse.Namespace, spark) -> None:
    from pyspark.sql import functions as F

    from .operators import admission, messages
    from .sources import transcripts

    if args.command == "replay":
        rows = admission.replay_report(admission.replay(transcripts.replay_outputs(transcripts.json_lines(spark, args.source))))
        rows.orderBy("keep").show(truncate=False)
        return
    if args.keep is not None and not 0 <= args.keep <= 1:
        raise SystemExit("--keep is between 0 and 1")
    rows = transcripts.read_messages(spark, args.source)
    share = F.coalesce("keep", F.lit(0.6 if args.keep is None else args.keep))
    done = messages.trim_parts(rows.withColumn("keep", share), F.col("keep"))
    seen = transcripts.write_messages(done, args.target, pretty=args.pretty)
    print(f"{seen.get['messages']} messages, about {seen.get['tokens']} tokens written", file=sys.stderr)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    run(parser().parse_args(), SparkSession.builder.appName("ctxsieve").getOrCreate())
