"""Line shell: queries and dot-commands over text streams."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterable
from typing import TextIO

from .engine import Engine
from .model import Kind, QueryError

SHOWN = 100
HELP = ".load FILE NAME KIND colN [header] [delim C] | .save DIR | .open DIR | .tables | .columns | .stats | .mode list|csv|table | .timing on|off | .help | .quit"


def shown(value: object) -> str:
    return "NULL" if value is None else f"{value:g}" if isinstance(value, float) else str(value)


def table_text(rows: list[list[str]], mode: str) -> list[str]:
    if mode == "csv":
        return [",".join(r) for r in rows]
    if mode == "table" and rows:
        widths = [max(len(r[c]) for r in rows) for c in range(len(rows[0]))]
        rows = [[v.ljust(w) if c + 1 < len(r) else v for c, (v, w) in enumerate(zip(r, widths, strict=True))] for r in rows]
    return [" │ ".join(r) for r in rows]


class Shell:
    def __init__(self, engine: Engine, out: TextIO):
        self.engine, self.out, self.mode, self.timing = engine, out, "list", False

    def say(self, *lines: str) -> None:
        for line in lines:
            print(line, file=self.out)

    def run(self, lines: Iterable[str]) -> None:
        for line in lines:
            line = line.strip()
            if line and not line.startswith("#") and not self.one(line):
                break

    def one(self, line: str) -> bool:
        """Run one line; False ends the session."""
        if line in (".quit", ".exit"):
            return False
        began = time.perf_counter()
        if line.startswith("."):
            try:
                self.command(line.split())
            except (IndexError, ValueError, StopIteration):
                self.say(f"Error: {line.split()[0]} needs other arguments; {HELP}")
            except QueryError as wrong:
                self.say(f"Error: {wrong}")
            return True
        try:
            _, rows = self.engine.run(line)
            text = table_text([[shown(v) for v in r] for r in rows[:SHOWN]], self.mode)
            self.say(*text, *([f"… ({len(rows)} rows)"] if len(rows) > SHOWN else []))
        except QueryError as wrong:
            self.say(f"Error: {wrong}")
        if self.timing:
            self.say(f"({(time.perf_counter() - began) * 1000:.3f} ms)")
        return True

    def command(self, words: list[str]) -> None:
        name, rest = words[0], words[1:]
        catalog = self.engine.catalog
        if name == ".load":
            path, column, kind, place, *more = rest
            if not place.startswith("col"):
                raise ValueError
            delimiter = more[more.index("delim") + 1] if "delim" in more else ","
            self.engine.load_csv(path, {column: (int(place[3:]), Kind(kind))}, f"{path}#{column}", "header" in more, delimiter)
            self.say(f"loaded {column}: {catalog.rows(f'{path}#{column}')} rows")
        elif name == ".save":
            self.say("saved" if self.engine.save(rest[0]) else "Error: not saved")
        elif name == ".open":
            if catalog.columns:
                self.say("Error: .open needs an empty session")
            else:
                self.say("opened" if self.engine.load(rest[0]) else "Error: not opened")
        elif name == ".tables":
            self.say(*(f"{t}: {', '.join(c)}" for t, c in catalog.tables.items()))
        elif name == ".columns":
            self.say(*(f"{c.name} │ {c.kind.value} │ {catalog.rows(c.dataset)}" for c in catalog.columns.values()))
        elif name == ".stats":
            self.say(*(f"{k} │ {v}" for k, v in self.engine.stats().items()))
        elif name == ".mode":
            if rest[0] not in ("list", "csv", "table"):
                raise ValueError
            self.mode = rest[0]
        elif name == ".timing":
            self.timing = {"on": True, "off": False}[rest[0]] if rest and rest[0] in ("on", "off") else not self.timing
        elif name == ".help":
            self.say(HELP)
        else:
            self.say(f"Error: unknown command {name}; {HELP}")


def main(argv: list[str] | None = None) -> int:
    options = argparse.ArgumentParser(prog="quernstone")
    options.add_argument("-c", "--command")
    options.add_argument("-f", "--file")
    options.add_argument("--serve", type=int, metavar="PORT")
    options.add_argument("--open", metavar="DIR")
    options.add_argument("--token")
    chosen = options.parse_args(argv)
    from pyspark.sql import SparkSession

    engine = Engine(SparkSession.builder.appName("quernstone").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    if chosen.open and not engine.load(chosen.open):
        print(f"Error: {chosen.open} does not open", file=sys.stderr)
        return 1
    if chosen.serve is not None:
        from .serving.protocol import Policy, Service
        from .serving.tcp import Server

        every = set(range(1, len(engine.catalog.columns) + 1))
        who = "owner" if chosen.token else "local"
        policy = Policy({who: every}, {who}, {who}, {chosen.token: who} if chosen.token else {})
        Server(Service(engine, policy), chosen.serve, tokens=bool(chosen.token)).serve_forever()
        return 0
    shell = Shell(engine, sys.stdout)
    if chosen.command:
        shell.run([chosen.command])
    elif chosen.file:
        with open(chosen.file) as lines:
            shell.run(lines)
    else:
        shell.run(sys.stdin)
    return 0


if __name__ == "__main__":
    sys.exit(main())
