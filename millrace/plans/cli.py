"""The command line: init, fetch, score, list, show, status, export, run. Exit codes: 0 done, 1 failed, 2 misused."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schema
from millrace.operators.filters import Scope, applied_at, resolve_languages, top
from millrace.plans.config import EXAMPLE, ConfigError, load_config
from millrace.plans.run import PHASES, Report, Run, RunError
from millrace.plans.store import StoreError

LIST_COLUMNS = ("id", "score", "title", "company", "location", "work_mode", "status", "source")
SUMMARY_COLUMNS = ("id", "url", "title", "company", "source", "location", "work_mode", "score", "status", "detected_language")


def list_cells() -> list:
    cut = {"id": F.substring("id", 1, 8), "score": F.col("score").cast("string"), "location": F.col("location")}
    return [F.coalesce(cut.get(c, F.col(c)), F.lit("-")).alias(c) for c in LIST_COLUMNS]


def score_style(score):
    return F.when(score >= 70, "green").when(score >= 40, "yellow").otherwise("dim")


def detail(row: DataFrame, *keys: str) -> DataFrame:
    """(label, value) rows of a posting's fields, after its ``keys``; what is empty has none."""
    text = {c: F.array_join(c, ", ") if c in schema.LISTS else F.date_format(c, "yyyy-MM-dd") if c in schema.TIMES else F.col(c).cast("string") for c in schema.COLUMNS}
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), v.alias("value")) for c, v in text.items() if c not in ("description_raw", "raw_url")])
    return row.select(*keys, F.explode(F.filter(pairs, lambda x: x["value"] != "")).alias("x")).select(*keys, "x.*")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("--config")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init").add_argument("--force", action="store_true")
    fetch = sub.add_parser("fetch")
    fetch.add_argument("--source", action="append", default=[])
    fetch.add_argument("--limit", type=int)
    score = sub.add_parser("score")
    score.add_argument("--limit", type=int)
    score.add_argument("--rescore", action="store_true")
    for name in ("list", "export", "run"):
        s = sub.add_parser(name)
        if name == "export":
            s.add_argument("format")
            s.add_argument("--output")
        if name != "run":
            s.add_argument("--source")
            s.add_argument("--status", choices=schema.STATUSES)
            s.add_argument("--min-score", type=int)
            s.add_argument("--max-score", type=int)
            s.add_argument("--unscored", action="store_true")
            s.add_argument("--remote", action="store_true")
        s.add_argument("--language", action="append", default=[])
        if name == "list":
            s.add_argument("--sort", choices=("score", "date", "company"), default="score")
            s.add_argument("--limit", type=int, default=50)
            s.add_argument("--json", action="store_true")
        if name == "run":
            for phase in PHASES:
                s.add_argument(f"--skip-{phase}", action="store_true")
    sub.add_parser("show").add_argument("ref")
    status = sub.add_parser("status")
    status.add_argument("ref")
    status.add_argument("status", choices=schema.STATUSES)
    when = status.add_mutually_exclusive_group()
    when.add_argument("--at")
    when.add_argument("--clear-date", action="store_true")
    return p


def _scope(args: argparse.Namespace, configured: Sequence[str]) -> Scope:
    own = {k: getattr(args, k, None) for k in ("source", "status", "min_score", "max_score")}
    return Scope(**own, scored=False if getattr(args, "unscored", False) else None, remote=getattr(args, "remote", False), languages=resolve_languages(args.language, configured))


def _found(run: Run, ref: str):
    rows = run.store.resolve(ref)
    many = rows.collect()
    if not many:
        broken = run.store.unreadable_rows
        raise RunError(f"nothing stored is {ref}" + (f" (but {broken} rows can't be read)" if broken else ""))
    if len(many) > 1:
        raise RunError(f"{ref} is ambiguous: {', '.join(r['id'] for r in many)}")
    return rows, many[0]


def _unreadable(count: int) -> None:
    if count:
        print(f"{count} stored postings could not be read", file=sys.stderr)


def _print(report: Report) -> int:
    bad = report.failed()
    for phase in PHASES:
        for name, n, said in report.of(phase):
            shown = ", ".join(f"{c.replace('_', ' ')} {v}" for c, v in n.items() if c != "unreadable")
            print(f"{phase} {name}: {shown or 'nothing'}" + " FAILED" * ((phase, name) in bad))
            for text in said:
                print(f"  {name}: {text}", file=sys.stderr)
    _unreadable(max([n.get("unreadable", 0) for n in report.counters.values()], default=0))
    return 0 if report.ok else 1


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if args.command == "init":
            at = Path(args.config or "config.yaml")
            if at.exists() and not args.force:
                raise RunError(f"{at} exists; --force overwrites it")
            at.write_text(EXAMPLE, encoding="utf-8")
            return 0
        config = load_config(args.config)
        try:
            scope = _scope(args, config.search.languages) if hasattr(args, "language") else None
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        spark = spark or SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        return _command(Run(spark, config, dry_run=args.dry_run), args, scope)
    except (ConfigError, RunError, StoreError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1


def _command(run: Run, args: argparse.Namespace, scope: Scope | None) -> int:
    if args.command == "fetch":
        return _print(run.fetch(args.source, args.limit))
    if args.command == "score":
        pending = run.store.count(Scope(scored=None if args.rescore else False))
        if not pending:
            print("nothing to score")
            return 0
        print(f"{pending if args.limit is None else min(pending, args.limit)} to score")
        _print(run.score(args.limit, args.rescore))
        return 0
    if args.command == "list":
        rows = top(run.store.list(scope), args.sort, args.limit)
        unreadable = run.store.unreadable_rows
        if args.json:
            print(json.dumps([r.asDict() for r in rows.select(*SUMMARY_COLUMNS).collect()], ensure_ascii=False, indent=2))
        else:
            for r in [LIST_COLUMNS, *rows.select(*list_cells()).collect()]:
                print("  ".join(r))
        _unreadable(unreadable)
        return 0
    if args.command == "show":
        rows, _ = _found(run, args.ref)
        for r in detail(rows).collect():
            print(f"{r['label']}: {r['value']}")
        return 0
    if args.command == "status":
        rows, row = _found(run, args.ref)
        given = datetime.fromisoformat(args.at) if args.at else None
        given = given and (given if given.tzinfo else given.replace(tzinfo=UTC))
        at = rows.select(applied_at(args.status, F.lit(datetime.now(UTC)), F.lit(given) if given else None, args.clear_date)).first()[0]
        if not run.dry_run:
            run.store.update_status(row["url"], args.status, F.lit(at) if at else None)
        print(f"{row['id']} is {args.status}")
        return 0
    if args.command == "export":
        return _print(run.export([args.format], scope, args.output))
    return _print(run.run([p for p in PHASES if getattr(args, f"skip_{p}")], scope))


if __name__ == "__main__":
    sys.exit(main())
