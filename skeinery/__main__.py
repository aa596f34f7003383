"""Commands: ``python -m skeinery build FOLDER``, ``query TEXT``, ``ask TEXT``, ``evaluate``, ``serve-tools``. One line of JSON on stdout, logs (and the evaluation's table) on stderr."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import SparkSession

from skeinery import config
from skeinery.operators import answer, embed, evaluate
from skeinery.plans.search import Cached, HybridEngine
from skeinery.serving import protocol
from skeinery.sources import files
from skeinery.sources.index import IndexBusy, IndexMissing, VersionedIndex
from skeinery.sources.vectors import VectorTable


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="skeinery", description=__doc__)
    out.add_argument("--root", help="folder of the indexes")
    out.add_argument("--name", help="name of the index")
    commands = out.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="index a folder; only changed files, unless --full")
    build.add_argument("folder")
    build.add_argument("--full", action="store_true")
    for name in ("query", "ask"):
        one = commands.add_parser(name)
        one.add_argument("text")
        one.add_argument("--top-k", type=int)
        if name == "ask":
            one.add_argument("--mode")
            one.add_argument("--model", help="module:function that completes a prompt; without it the prompt itself is given")
    test = commands.add_parser("evaluate", help="measure the index on a golden set")
    test.add_argument("--golden", required=True, help="JSONL of query and relevant_files")
    test.add_argument("--k", type=int)
    test.add_argument("--out", help="write the report as JSON to this file")
    tools = commands.add_parser("serve-tools", help="offer the search as a tool over JSON-RPC on stdin and stdout")
    tools.add_argument("--url", help="address of the search service")
    return out


def run(spark: SparkSession, args: argparse.Namespace, settings: config.Settings) -> dict:
    """The command's document."""
    root = args.root or settings.index_root
    vectors = VectorTable(spark, f"{root}/embedded-texts", settings.emb_cache_max_size)
    index = VersionedIndex(spark, root, args.name or settings.index_name, embed.get(settings.embed_model), vectors=vectors)
    if args.command == "build":
        found = files.load(spark, args.folder)
        chunking = {"size": settings.window_tokens, "overlap": settings.window_overlap, "max_chars": settings.max_chunk_chars}
        version = index.build(found, overwrite=True, **chunking) if args.full else index.update(found, **chunking)
        return {"index": index.name, "version": index.current(), "changed": version is not None}
    engine = HybridEngine.over(index, settings)
    if args.command == "query":
        return Cached(lambda: (index.current(), engine), settings.retrieve_cache_size).query(args.text, args.top_k)
    if args.command == "evaluate":
        k = args.k or settings.eval_k
        rows, means = evaluate.evaluate(evaluate.load_golden(spark, args.golden), k, engine.search)
        evaluate.report(rows, means, k, args.out, stream=sys.stderr)
        mean = means.first()
        return {f"recall@{k}": mean.recall, "mrr": mean.mrr, f"ndcg@{k}": mean.ndcg, "queries": mean.n_queries}
    complete = str
    if args.model:
        module, _, function = args.model.partition(":")
        complete = getattr(importlib.import_module(module), function)
    return {"answer": answer.ask(args.text, engine.search, complete, spark, args.mode, args.top_k or settings.ask_top_k, settings.max_context_tokens)}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config.setup_logging()
    if args.command == "serve-tools":
        protocol.serve(url=args.url)  # a client of the service; no session is needed
        return 0
    spark = SparkSession.builder.appName("skeinery").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        document, code = run(spark, args, config.load(spark=spark)), 0
    except (IndexBusy, IndexMissing, FileExistsError, ValueError) as trouble:
        document, code = {"error": str(trouble)}, 1
    print(json.dumps(document), flush=True)
    return code


if __name__ == "__main__":
    sys.exit(main())
