"""Commands: python -m quarry index | search | search-dataset | answer | answer-dataset | evaluate | cached | serve."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from quarry.errors import QuarryError
from quarry.operators import evaluate
from quarry.plans import indexing, models, service
from quarry.sources import datasets
from quarry.sources.cache import QueryCache


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, mode: bool = False, k: bool = False, folder: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        if folder:
            c.add_argument("--folder", default="data/processed")
        if mode:
            c.add_argument("--mode", choices=service.MODES, default="bm25")
        if k:
            c.add_argument("--k", type=int, default=10)
        return c

    c = command("index", "root")
    c.add_argument("--max-chunk-size", type=int, default=2000)
    c.add_argument("--semantic", action="store_true")
    command("search", "question", mode=True, k=True)
    command("search-dataset", "dataset", "output", mode=True, k=True)
    command("answer", "question", mode=True, k=True)
    command("answer-dataset", "results", "output", mode=True)
    command("evaluate", "results", "dataset", folder=False)
    command("cached", "question", mode=True, k=True)
    c = command("serve", mode=True)
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8000)
    return p


def show(value) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2))


def spans(rows: list[dict]) -> list[dict]:
    return [{"file_path": r["file_path"], "first_character_index": r["start"], "last_character_index": r["end"]} for r in rows]


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    if args.command == "index":
        return show(indexing.index(spark, args.root, args.folder, args.max_chunk_size, models.HashingEmbedder if args.semantic else None))
    if args.command == "evaluate":
        expected = datasets.expected_spans(datasets.load_dataset(spark, args.dataset))
        rows = datasets.load_search_results(spark, args.results)
        return show({f"recall@{k}": v for k, v in evaluate.evaluate(expected, rows.where("rank is not null"), rows).items()})
    search = service.SearchService(spark, args.folder, args.mode)
    if args.command == "search":
        rows = search.search_one(args.question, args.k)
        if args.mode == "bm25":
            return show({"question": args.question, "k": args.k, "retrieved_sources": spans(rows)})
        for r in rows:
            print(f"{r['file_path']} [{r['start']}, {r['end']}]")
    elif args.command == "search-dataset":
        print(search.search_dataset(args.dataset, args.output, args.k))
    elif args.command == "answer":
        show(service.AnswerService(search).answer(args.question, args.k))
    elif args.command == "answer-dataset":
        print(service.AnswerService(search).answer_dataset(args.results, args.output))
    elif args.command == "cached":
        search.cache = QueryCache(spark, args.folder, args.mode)
        for label in ("first", "again"):
            began = time.perf_counter()
            n = len(search.search_one(args.question, args.k))
            print(f"{label}: {n} results in {time.perf_counter() - began:.4f} s")
    else:
        server = service.serve(service.AnswerService(search), args.host, args.port)
        print(f"http://{args.host}:{server.server_port}")
        server.serve_forever()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    try:
        run(args, spark)
    except (QuarryError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
