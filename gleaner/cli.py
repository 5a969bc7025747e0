"""Command line: list, index, search, eval, status and serve.

Exit codes: 0 done, 2 wrong usage or configuration, 3 no embedding service,
4 a table with old columns.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections import Counter
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from gleaner.errors import ConfigError, EmbedderError, EvalError, StaleSchemaError, StoreError
from gleaner.operators import evaluation, ranking
from gleaner.operators.embedding import HashingEmbedder, HttpEmbedder
from gleaner.operators.indexer import index_source
from gleaner.operators.store import FreshnessLog, Store
from gleaner.service import Server, build_tools
from gleaner.sources import config as cfg

USAGE, NO_EMBEDDER, STALE = 2, 3, 4


class Exit(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


class App:
    """What the commands share; also the three tools for other programs."""

    def __init__(self, spark: SparkSession, config: cfg.Config, clock=lambda: datetime.now(UTC)) -> None:
        self.spark, self.config, self.clock = spark, config, clock
        self.store = Store(spark, str(config.db_path), config.embedding.dim, config.keep_runs, clock)
        self.freshness = FreshnessLog(spark, str(config.db_path), clock)
        e = config.embedding
        self.embedder = HashingEmbedder(e.dim) if e.provider == "hashing" else HttpEmbedder(e.url, e.model, e.dim)

    def known(self, names: list[str] | None) -> list[str]:
        configured = [s.name for s in self.config.sources]
        unknown = [n for n in names or [] if n not in configured]
        if unknown:
            raise Exit(USAGE, f"unknown source: {', '.join(unknown)}")
        return list(names) if names else configured

    def healthy(self, names: list[str] | None = None) -> None:
        try:
            self.embedder.health_check()
        except EmbedderError as e:
            if names:
                self.freshness.record_error(names, str(e))
            raise Exit(NO_EMBEDDER, str(e)) from e

    def list_sources(self) -> list[dict]:
        return [{"name": n, "chunk_count": c} for n, c in sorted(self.store.counts().items())]

    def search(self, query: str, sources: list[str] | None = None, k: int = 10, context_chunks: int = 0) -> list[Row]:
        names = [s.name for s in self.config.sources] if sources is None else sources
        if not query.strip() or not names:
            return []
        return ranking.search(self.store.corpus(names), query, self.embedder, None, k, context_chunks, self.store.terms(names)).collect()  # 100 rows at most

    def index_status(self) -> dict:
        counts, runs, now = self.store.counts(), self.freshness.read(), self.clock()
        rows = []
        for name in sorted({*counts, *(s.name for s in self.config.sources)}):
            r = runs.get(name, dict.fromkeys(FreshnessLog.FIELDS) | {"failures": []})
            rows.append({"name": name, "chunk_count": counts.get(name, 0), "last_run_age_seconds": _age(r["last_run"], now), **r})
        return {"total_chunks": sum(counts.values()), "sources": rows}

    def index(self, names: list[str], force: bool) -> dict[str, list[dict]]:
        targets = [s for s in self.config.sources if s.name in names]
        stale = self.store.stale([s.name for s in targets])
        if stale and not force:
            message = f"old table layout, index with --force: {', '.join(stale)}"
            self.freshness.record_error([s.name for s in targets], message)
            raise Exit(STALE, message)
        self.healthy([s.name for s in targets])
        out = {}
        for source in targets:
            try:
                out[source.name] = index_source(self.store, source, self.embedder, force)
            except StaleSchemaError as e:
                raise Exit(STALE, str(e)) from e
            self.freshness.record_run(source.name, out[source.name], self.config.embedding.model)
        return out


def _age(stamp: str | None, now: datetime) -> int | None:
    try:
        return int((now - datetime.fromisoformat(stamp)).total_seconds()) if stamp else None
    except (ValueError, TypeError):
        return None


def _print_hit(place: int, hit: Row) -> None:
    bm25 = f"{hit['bm25']:.2f}" if hit["bm25"] is not None else "-"
    print(f"{place}. [{hit['source_name']}] {hit['source_path']}  score={hit['score']:.3f} cos={hit['cosine']:.3f} bm25={bm25}")
    for label in ("heading_path", "note_date", "status"):
        if hit[label]:
            print(f"    {label}: {hit[label]}")
    print("\n".join(f"    {line}" for line in hit["text"].splitlines()))


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gleaner")
    parser.add_argument("--config", type=Path)
    parser.add_argument("--log-level", default="WARNING", choices=("DEBUG", "INFO", "WARNING", "ERROR"))
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    commands.add_parser("status")
    index = commands.add_parser("index")
    index.add_argument("sources", nargs="*")
    index.add_argument("--force", action="store_true")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--sources", nargs="+")
    search.add_argument("-k", type=int, default=10)
    search.add_argument("--context", type=int, default=0)
    commands.add_parser("serve")
    check = commands.add_parser("eval")
    check.add_argument("--golden", type=Path, default=Path("eval/golden.toml"))
    check.add_argument("-k", type=int, default=5)
    return parser


def _run(app: App, args: argparse.Namespace) -> None:
    if args.command == "list":
        for s in app.list_sources():
            print(f"{s['name']}\t{s['chunk_count']}")
    elif args.command == "status":
        print(json.dumps(app.index_status(), indent=2))
    elif args.command == "index":
        for name, results in app.index(app.known(args.sources), args.force).items():
            counts = Counter(r["status"] for r in results)
            print(f"{name}: " + (", ".join(f"{n} {s}" for s, n in sorted(counts.items())) or "nothing to do"))
    elif args.command == "search":
        names = app.known(args.sources)
        app.healthy()
        hits = app.search(args.query, names, args.k, args.context)
        for i, hit in enumerate(hits, 1):
            _print_hit(i, hit)
        if not hits:
            print("no results")
    elif args.command == "serve":
        app.healthy()
        Server(build_tools(app)).serve(sys.stdin, sys.stdout)
    else:
        golden = evaluation.load_golden(app.spark, args.golden)
        names = [n for n in app.known(None) if n in app.store.names()]
        if not names:
            raise Exit(USAGE, "nothing is indexed")
        app.healthy()
        results = evaluation.query_results(
            golden, golden.select("query_id", "query_text", app.embedder.embed_column(F.col("query_text")).cast("array<double>").alias("query_vector")), app.store.corpus(names), args.k)
        for r in results.join(golden.select("query_id", "query_text"), "query_id").orderBy("query_id").toLocalIterator():
            print(f"{'pass' if r['passed'] else 'FAIL'}  {r['query_text']}  rank={r['best_rank']} max_cos={r['max_cosine']:.3f}")
        total = evaluation.report(results).first()
        print(f"recall@{args.k} {total['recall']:.3f}  MRR {total['mrr']:.3f}  negatives {total['negatives_passed']}/{total['negatives']}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = _arguments().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        logging.basicConfig(stream=sys.stderr, level=args.log_level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")  # the output is for results alone
        config = cfg.load(args.config or cfg.default_path())
        spark = spark or SparkSession.builder.appName("gleaner").getOrCreate()
        _run(App(spark, config), args)
    except (ConfigError, EvalError, StoreError) as e:
        print(f"error: {e}", file=sys.stderr)
        return USAGE
    except Exit as e:
        print(f"error: {e}", file=sys.stderr)
        return e.code
    return 0


if __name__ == "__main__":
    sys.exit(main())
