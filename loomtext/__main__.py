"""Command line: run the book pipeline, search its products, report on logs."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import config
from .session import build_session


def main(argv: list[str] | None = None) -> int:
    settings = config.load()
    parser = argparse.ArgumentParser(prog="loomtext")
    parser.add_argument("--master", default="local[*]")
    tasks = parser.add_subparsers(dest="task", required=True)
    run = tasks.add_parser("run", help="texts to products")
    run.add_argument("source")
    run.add_argument("folder")
    run.add_argument("--only", nargs="*")
    run.add_argument("--force", action="store_true")
    run.add_argument("--chapters", type=int, default=settings.get("run.chapters"))
    search = tasks.add_parser("search", help="scenes for a question")
    search.add_argument("folder")
    search.add_argument("question")
    log = tasks.add_parser("log", help="health of a run log")
    log.add_argument("path")
    tasks.add_parser("settings", help="all settings")
    args = parser.parse_args(argv)
    if problems := settings.problems():
        parser.error("; ".join(problems))
    if args.task == "settings":
        print(settings.markdown())
        return 0
    spark = build_session(args.master)
    if args.task == "run":
        from .plans.book import build_runner

        manifest = build_runner(spark, args.folder, args.source, max_chapters=args.chapters).run(args.only, force=args.force)
        manifest.show(100, False)
        return int(manifest.where("status IN ('fail', 'blocked')").count() > 0)
    if args.task == "search":
        from .operators import retrieval

        docs = spark.read.parquet(f"{args.folder}/records").select("scene_id", "raw_text")
        postings, lengths = retrieval.build_index(docs, "scene_id", "raw_text")
        retrieval.full_text(docs, postings, lengths, "scene_id", "raw_text", args.question, settings.get("retrieval.limit")).show(50, False)
        return 0
    from .operators import runlog
    from .sources.tables import log_records

    rows = log_records(spark, args.path)
    runlog.span(rows).show(truncate=False)
    runlog.health(rows, ["step"], F.col("level") == "ERROR").show(100, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
