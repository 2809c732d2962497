"""Command line: ``python -m momentlake videos|search|audit`` over a folder with ``items.parquet`` and ``videos.parquet``."""

from __future__ import annotations

import argparse
import datetime
import getpass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from momentlake.operators.ranking import numbered
from momentlake.plans import report
from momentlake.plans.engine import Engine
from momentlake.sources import audit, config, tables


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    parser = argparse.ArgumentParser(prog="momentlake")
    parser.add_argument("--config")
    parser.add_argument("--data", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("videos")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--top-k", type=int)
    search.add_argument("--video", action="append", default=[])
    search.add_argument("--frames-only", action="store_true")
    search.add_argument("--json", action="store_true")
    log = commands.add_parser("audit")
    log.add_argument("--last", type=int, default=20)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("momentlake").getOrCreate()
    path = f"{args.data}/audit"
    if args.command == "videos":
        lines = [r.choice for r in tables.video_choices(tables.read_table(spark, args.data, "videos")).collect()]
    elif args.command == "audit":
        lines = [r.line for r in report.hit_json(audit.read_audit(spark, path, args.last)).collect()]
    else:
        engine = Engine(tables.read_table(spark, args.data, "items"), tables.read_table(spark, args.data, "videos"), config=config.load_config(args.config))
        hits = numbered(engine.search(args.query, top_k=args.top_k, video_ids=args.video, use_crops=not args.frames_only), [F.desc("score"), F.asc("item_id")])
        lines = [r.line for r in (report.hit_json(hits) if args.json else report.hit_lines(hits)).collect()]
        now = datetime.datetime.now().astimezone().isoformat(timespec="seconds")
        audit.write_audit(audit.audit_record(spark, time=now, os_user=getpass.getuser(), query=args.query, videos=args.video, n_results=len(lines), verify=False), path)
    print(*lines, sep="\n")
    return lines


if __name__ == "__main__":
    main()
