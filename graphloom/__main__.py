"""python -m graphloom: builds a tree or a workspace and answers questions about it. Results are printed as JSON or text."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .engine import DomainError, Engine, NotBuilt, NotFound
from .streaming.watch import watch
from .workspace import Workspace, discover


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    top.add_argument("--root", default=".", help="folder of the tree")
    verbs = top.add_subparsers(dest="verb", required=True)
    build = verbs.add_parser("build")
    build.add_argument("--full", action="store_true", help="start afresh")
    build.add_argument("--watch", metavar="CHECKPOINT", help="then rebuild on changes; a folder for the stream's checkpoint")
    build.add_argument("--sync", action="store_true", help="with --watch: recompile stale pages after each rebuild")
    verbs.add_parser("workspace").add_argument("action", choices=["build"])
    impact = verbs.add_parser("impact")
    impact.add_argument("symbol")
    impact.add_argument("--depth", type=int, default=3)
    verbs.add_parser("flow").add_argument("name")
    context = verbs.add_parser("context")
    context.add_argument("symbol")
    context.add_argument("--task", choices=["fix", "refactor", "onboard"], default="fix")
    context.add_argument("--budget", type=int)
    context.add_argument("--auto-budget", action="store_true")
    context.add_argument("--plan", action="store_true")
    context.add_argument("--json", action="store_true")
    domain = verbs.add_parser("domain")
    domain.add_argument("action", choices=["rename", "add"])
    domain.add_argument("name")
    domain.add_argument("rest", nargs="+", help="the new name, or paths and symbols")
    wiki = verbs.add_parser("wiki")
    wiki.add_argument("action", choices=["sync", "lint", "show"])
    wiki.add_argument("page", nargs="?", default="index")
    wiki.add_argument("--strict", action="store_true")
    return top


def _rebuild(engine: Engine, sync: bool):
    def rebuild(batch, _: int) -> None:
        if not batch.isEmpty():
            engine.build()
            if sync and engine.stale_queue():
                engine.sync()

    return rebuild


def run(spark: SparkSession, arguments: Sequence[str]) -> tuple[str, int]:
    """What a command prints, and its exit code."""
    a = parser().parse_args(arguments)
    engine = Engine(spark, a.root)
    show = lambda x: json.dumps(x, indent=2, ensure_ascii=False)
    try:
        match a.verb:
            case "build":
                report = engine.build(incremental=not a.full)
                if a.watch:
                    watch(spark, engine.store.root, a.watch, _rebuild(engine, a.sync)).awaitTermination()
                return show(report), 0
            case "workspace":
                folder = discover(spark, a.root)
                return (show(Workspace(spark, folder).build()), 0) if folder else ("no workspace manifest here or above", 1)
            case "impact":
                return show(engine.impact(a.symbol, a.depth)), 0
            case "flow":
                return show(engine.flow(a.name)), 0
            case "context":
                found = engine.context(a.symbol, a.task, a.budget, a.auto_budget, a.plan)
                return (show(found) if a.json else found["markdown"]), 0
            case "domain":
                return show(engine.rename_domain(a.name, a.rest[0]) if a.action == "rename" else engine.add_to_domain(a.name, a.rest)), 0
        if a.action == "sync":
            return show({"pages": engine.sync()}), 0
        if a.action == "lint":
            report = engine.lint()
            return show(report), int(a.strict and not report["strict_ok"])
        return engine.page(a.page).body, 0
    except (NotBuilt, NotFound, DomainError) as wrong:
        return str(wrong), 1


def main() -> None:
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    text, code = run(spark, sys.argv[1:])
    print(text)
    spark.stop()
    sys.exit(code)


if __name__ == "__main__":
    main()
