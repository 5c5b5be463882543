"""python -m grove [--root DIR] [--json] COMMAND …: the commands of grove.api on a local session or a cluster's."""

from __future__ import annotations

import argparse
import json
import signal
import sys
import threading

from pyspark.sql import DataFrame, SparkSession

from grove.api import NotFoundError, Project, Workspace, stream_envelope

COMMANDS = {
    "init": (), "index": ("full", "watch"), "sketch": ("target", "limit=50", "no_docs"), "refs": ("target", "kind", "limit=20", "context=0"), "callers": ("target", "depth=1", "limit=20", "context=0"), "deps": ("target", "depth=1"),
    "rdeps": ("target", "depth=1"), "impact": ("target", "depth=3"), "find": ("query", "kind", "limit=10"), "similar": ("target", "kind", "limit=10"), "source": ("target",), "trace": ("target", "max_depth=10", "limit=20"),
    "entrypoints": (), "map": ("limit=10",), "status": (),
}
WORKSPACE = {"init": ("name",), "list": (), "index": ("full", "watch"), "status": (), "refs": ("target", "kind", "limit=20"), "find": ("query", "kind", "limit=10"), "map": ("limit=10",), "entrypoints": ()}


def _add(to: argparse._SubParsersAction, commands: dict[str, tuple[str, ...]]) -> None:
    for name, options in commands.items():
        p = to.add_parser(name)
        for o in options:
            key, _, default = o.partition("=")
            if key in ("target", "query"):
                p.add_argument(key)
            elif key in ("full", "watch", "no_docs"):
                p.add_argument("--" + key.replace("_", "-"), action="store_true")
            else:
                p.add_argument("--" + key.replace("_", "-"), type=int if default else str, default=int(default) if default else None)


def _watch(target: Project | Workspace, full: bool) -> int:
    """Watches until the process is told to stop, and drains what is pending then."""
    if full:
        target.reindex(True)
    ended = threading.Event()
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: ended.set())
    watcher = target.watch()
    print("watching", *watcher.roots, file=sys.stderr)
    ended.wait()
    watcher.stop()
    print(json.dumps(watcher.log.totals()))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="grove")
    parser.add_argument("--root", default=".")
    parser.add_argument("--json", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    _add(commands, COMMANDS)
    _add(commands.add_parser("workspace").add_subparsers(dest="sub", required=True), WORKSPACE)
    a = vars(parser.parse_args(argv))
    root, as_json, command, sub = (a.pop(k, None) for k in ("root", "json", "command", "sub"))
    spark = SparkSession.builder.appName("grove").getOrCreate()
    method = {"index": "reindex"}.get(sub or command, sub or command)
    watching = a.pop("watch", False)
    try:
        if watching:
            return _watch(Workspace(spark, root) if sub else Project(spark, root), a["full"])
        out = getattr(Workspace(spark, root) if sub else Project(spark, root), method)(*a.values())
    except (NotFoundError, FileNotFoundError, FileExistsError, ValueError) as e:
        print(f"grove: {e}", file=sys.stderr)
        return 1
    for name, df in (out.items() if isinstance(out, dict) else [(command, out)]):
        if not isinstance(df, DataFrame):
            print(f"{name}: {df}")
        elif as_json:
            stream_envelope(sys.stdout.write, name, df, a.get("target"))
            print()
        else:
            print(*df.columns, sep="\t")
            for row in df.toLocalIterator():  # a partition at a time: all rows, whole
                print(*("" if v is None else v for v in row), sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main())
