"""``python -m quarry COMMAND``: index, search, serve, web, eval, bench and hook."""

from __future__ import annotations

import argparse
import json
import sys

from quarry.operators import evaluate, index, scoring
from quarry.service import hook
from quarry.service.http import server
from quarry.service.rpc import Service
from quarry.session import cut, get_session
from quarry.sources.config import default_name, load_registry
from quarry.sources.store import Store
from quarry.sources.tree import golden_questions, source_files


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, help_ in (("index", "bring an index up to date"), ("search", "search a tree"), ("serve", "tools over standard input"),
        ("web", "tools over HTTP"), ("eval", "retrieval quality over questions"), ("bench", "token costs over questions"), ("hook", "write a post-commit hook")):
        c = commands.add_parser(name, help=help_)
        c.add_argument("folders", nargs="*" if name in ("serve", "web") else 1)
        c.add_argument("--store", help="folder of index tables")
        if name == "search":
            c.add_argument("query")
            c.add_argument("--mode", choices=scoring.MODES, default="hybrid+rerank")
        if name in ("search", "eval", "bench"):
            c.add_argument("--top", type=int, default=scoring.DEFAULT_K)
        if name in ("eval", "bench"):
            c.add_argument("questions")
        if name == "eval":
            c.add_argument("--report")
        if name in ("serve", "web"):
            c.add_argument("--registry", help="JSON file of projects")
        if name == "web":
            c.add_argument("--port", type=int, default=7878)
    return parser


def main(argv: list[str]) -> int:
    given = arguments().parse_args(argv)
    if given.command == "hook":
        print(hook.install(given.folders[0], given.store or f"{given.folders[0]}/.git/quarry"))
        return 0
    spark = get_session("quarry")
    spark.sparkContext.setLogLevel("ERROR")
    projects = [(default_name(f), f.rstrip("/")) for f in given.folders]
    if getattr(given, "registry", None):
        projects += [(p.name, p.path) for p in load_registry(given.registry)]
    service = Service(spark, projects, lambda path: source_files(spark, path), store=Store(spark, given.store) if given.store else None)
    if given.command == "serve":
        service.serve(sys.stdin, sys.stdout)
    elif given.command == "web":
        with server(service, port=given.port) as web:
            print(f"http://{web.server_address[0]}:{web.server_address[1]}", flush=True)
            web.serve_forever()
    elif given.command == "index":
        print(json.dumps(service.build(service.project(""))))
    elif given.command == "search":
        print(json.dumps(service.search(given.query, given.mode, given.top), ensure_ascii=False, indent=2))
    else:
        files, built = service.tables("")
        questions = cut(golden_questions(spark, given.questions))
        if given.command == "eval":
            results = evaluate.evaluate(built, questions, given.top)
            print(evaluate.report(results))
            if given.report:
                evaluate.write_report(given.report, results)
        else:
            print(json.dumps(bench(built, questions, files, given.top), ensure_ascii=False, indent=2))
    return 0


def bench(built: index.Index, questions, files, k: int) -> dict:
    from pyspark.sql import functions as F

    asked = evaluate.bench_questions(questions).select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    rows = cut(evaluate.token_bench(built, asked, files, k))
    return {"tasks": [r.asDict() for r in rows.orderBy("query_id").collect()], **evaluate.mean_median(rows).first().asDict()}  # a row per question


def run() -> None:
    sys.exit(main(sys.argv[1:]))


if __name__ == "__main__":
    run()
