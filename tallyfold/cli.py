"""The commands: python -m tallyfold.cli COMMAND. Exit codes: 0 done, 1 failed (or findings, where asked), 2 wrong usage."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from tallyfold.config import Config, resolve
from tallyfold.errors import ReconError, UsageError
from tallyfold.plans.engine import Engine


def parser() -> argparse.ArgumentParser:
    every = argparse.ArgumentParser(add_help=False)
    every.add_argument("--store", help="folder that keeps datasets, memory and findings")
    every.add_argument("--tolerance", help="absolute tolerance, a decimal number")
    every.add_argument("--m2m-cap", dest="m2m_cap", help="most pairs of rows of one finest key")
    every.add_argument("--large", help="bytes beyond which a file is read in splits")
    every.add_argument("--schema-out", dest="schema_out", help="where document writes")
    every.add_argument("--fail-on-findings", action="store_true", help="exit with 1 where level 0 has findings")
    every.add_argument("--json", action="store_true", help="one JSON object on standard output")
    p = argparse.ArgumentParser(prog="tallyfold")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: str, into=sub, **optional) -> argparse.ArgumentParser:
        c = into.add_parser(name, parents=[every])
        for f in flags:
            c.add_argument(f"--{f}", required=True)
        for f, how in optional.items():
            c.add_argument(f"--{f.replace('_', '-')}", **how)
        return c

    command("ingest", "file", profile={}, spec={"help": "JSON or a file of it"})
    profile = sub.add_parser("profile").add_subparsers(dest="sub", required=True)
    command("list", into=profile)
    command("show", "name", into=profile)
    command("attach", "profile", into=profile, file_id={"type": int, "required": True})
    pair = sub.add_parser("pair").add_subparsers(dest="sub", required=True)
    command("list", into=pair)
    command("create", "name", "profile-a", "profile-b", into=pair)
    command("hierarchy", file_id={"type": int, "required": True})
    files = {"file_a_id": {"type": int}, "file_b_id": {"type": int}}
    command("suggest", "pair", **files)
    many = {"action": "append", "default": []}
    command("map", "pair", key=many, compare=many, display=many, clear={"action": "store_true"})
    command("reconcile", "pair", **files)
    command("run", "file-a", "file-b", pair={}, profile_a={}, profile_b={}, auto={"action": "store_true"})
    command("document")
    command("sql", "query")
    return p


def spec_of(text: str | None) -> dict | None:
    if text is None:
        return None
    raw = text if text.lstrip().startswith("{") else Path(text.removeprefix("@")).read_text(encoding="utf-8")
    try:
        return json.loads(raw)
    except json.JSONDecodeError as e:
        raise UsageError(f"the parse spec is not JSON: {e}") from None


def perform(e: Engine, a: argparse.Namespace, config: Config) -> object:
    limits = {"tolerance": config.tolerance, "m2m_cap": config.m2m_cap}
    does: dict[str, Callable[[], object]] = {
        "ingest": lambda: e.ingest(a.file, a.profile, spec_of(a.spec)),
        "profile list": e.profiles,
        "profile show": lambda: e.profile(a.name),
        "profile attach": lambda: e.attach(a.file_id, a.profile),
        "pair list": e.pairs,
        "pair create": lambda: {"pair_id": e.create_pair(a.name, a.profile_a, a.profile_b)},
        "hierarchy": lambda: e.hierarchy(a.file_id),
        "suggest": lambda: e.suggest(a.pair, a.file_a_id, a.file_b_id),
        "map": lambda: e.map(a.pair, a.key, a.compare, a.display, a.clear),
        "reconcile": lambda: e.reconcile(a.pair, a.file_a_id, a.file_b_id, **limits),
        "run": lambda: e.run(a.file_a, a.file_b, a.pair, a.auto, a.profile_a, a.profile_b, **limits),
        "document": lambda: {"written": config.schema_out, "characters": Path(config.schema_out).write_text(e.document(), encoding="utf-8")},
        "sql": lambda: [json.loads(r) for r in e.sql(a.query).toJSON().toLocalIterator()],
    }
    return does[f"{a.command} {a.sub}" if "sub" in a else a.command]()


def shown(result: object) -> str:
    """A line for each entry."""
    if isinstance(result, dict):
        return "\n".join(f"{k}: {v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)}" for k, v in result.items())
    return "\n".join(json.dumps(r, ensure_ascii=False, default=str) for r in result)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:  # argparse has written why
        return int(e.code or 0)
    try:
        config = resolve(vars(a))
        e = Engine(spark or SparkSession.builder.appName("tallyfold").getOrCreate(), config.store, config.large)
        result = perform(e, a, config)
    except UsageError as e:
        print(f"error(UsageError): {e}", file=sys.stderr)
        return 2
    except (ReconError, OSError) as e:
        print(f"error({type(e).__name__}): {' '.join(str(e).split())}", file=sys.stderr)
        return 1
    print(json.dumps(result, ensure_ascii=False, default=str) if a.json else shown(result))
    return 1 if a.fail_on_findings and isinstance(result, dict) and result.get("total_findings", 0) > 0 else 0


if __name__ == "__main__":
    sys.exit(main())
