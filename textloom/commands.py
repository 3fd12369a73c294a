"""Batch commands: ``python -m textloom.commands search QUERIES DOCUMENTS OUT`` answers a file of
queries, ``... evaluate JUDGMENTS RUN...`` scores run files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from textloom.operators import metrics
from textloom.operators.index import Stored
from textloom.operators.search import run_rows
from textloom.session import session
from textloom.shared import shared_dir
from textloom.sources import readers, sinks


def search(spark: SparkSession, queries: str, documents: str, out: str, method: str | None = None, k: int = 10) -> int:
    """Write the run of all queries; a malformed one is warned of and has no results."""
    try:
        asked = [(r.qid, r.query) for r in readers.queries(spark, queries).collect()]
        index = Stored(readers.documents(spark, documents), f"{shared_dir(spark)}/textloom/search-index")
        if not index.docs.limit(1).count():
            raise ValueError("no documents")
    except Exception as e:  # noqa: BLE001 - the command's answer to unreadable input is its exit code
        print(f"cannot read the input: {e}", file=sys.stderr)
        return 1
    rows = run_rows(index, asked, method, k).persist()
    for r in rows.where("error is not null").collect():
        print(f"warning: query {r.qid} is malformed: {r.error}", file=sys.stderr)
    sinks.write_run(rows, out)
    return 0


def evaluate(spark: SparkSession, judgments: str, runs: list[str], k: int = 10) -> int:
    """Print MAP and MRR of each run, best first; a run that can't be read is skipped."""
    if not runs:
        print("no run files", file=sys.stderr)
        return 2
    board, skipped = metrics.leaderboard_of_files(spark, runs, readers.judgments(spark, judgments).persist(), k)
    for path, why in skipped.items():
        print(f"skipped {path}: {why}", file=sys.stderr)
    print(f"run\tMAP@{k}\tMRR@{k}\tqueries\tcovered")
    for r in board.collect():
        print(f"{r.run}\t{r.map:.4f}\t{r.mrr:.4f}\t{r.n_queries}\t{r.n_covered}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textloom")
    commands = parser.add_subparsers(dest="command", required=True)
    s = commands.add_parser("search")
    for name in ("queries", "documents", "out"):
        s.add_argument(name)
    s.add_argument("--method")
    e = commands.add_parser("evaluate")
    e.add_argument("judgments")
    e.add_argument("runs", nargs="*")
    for each in (s, e):
        each.add_argument("--k", type=int, default=10)
    a = parser.parse_args(argv)
    spark = session("textloom")
    if a.command == "search":
        return search(spark, a.queries, a.documents, a.out, a.method, a.k)
    return evaluate(spark, a.judgments, a.runs, a.k)


if __name__ == "__main__":
    sys.exit(main())
