"""`python -m symtrail.cli index|sync|ask|stats`: a thin command line over the engine."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import functions as F

from symtrail.engine import CodeGraph
from symtrail.session import build
from symtrail.sources import tree


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="symtrail")
    verbs = out.add_subparsers(dest="verb", required=True)
    for verb in ("index", "sync", "ask", "stats"):
        one = verbs.add_parser(verb)
        one.add_argument("--store", required=True, help="folder of the graph snapshots")
        if verb != "stats":
            one.add_argument("folder", help="source tree")
        if verb == "ask":
            one.add_argument("question")
    return out


def repo_of(folder: str) -> str:
    name = "".join(c if c.isalnum() and c.isascii() or c in "_.-" else "_" for c in os.path.basename(os.path.abspath(folder)))
    return name or "project"


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build("symtrail")
    engine = CodeGraph(spark, args.store)
    if args.verb == "stats":
        engine.stats().show(truncate=False)
        return
    repo = repo_of(args.folder)
    files = tree.scan(spark, args.folder, repo)
    listed = tree.tracked(spark, args.folder)
    if listed is not None:
        files = files.join(listed, "rel_path", "left_semi")
    if args.verb == "ask":
        asked = spark.createDataFrame([("q", repo, args.question)], "question_id string, repo_id string, query string")
        answered = engine.ask(asked, os.path.abspath(args.folder))
        answered.routed.show(truncate=False)
        answered.packed.filter("handle is not null").orderBy("position").select(
            "handle", "role", "level", F.col("text")).show(60, truncate=120)
    else:
        only = spark.createDataFrame([(repo,)], "repo_id string")        # the store may hold others
        (engine.sync if args.verb == "sync" else engine.reconcile)(files, repos=only)
        engine.stats().show(truncate=False)


if __name__ == "__main__":
    main()
