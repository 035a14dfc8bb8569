"""Command line: create, append, optimize, query, shell."""

from __future__ import annotations

import argparse
import base64
import cmd
import json
import os
import re
import shlex
import shutil
import subprocess
import sys
import time
from pathlib import Path
from typing import Any

from pyarrow import csv
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .display import text_table
from .errors import SqlError, TidemarkError
from .functions import sqltext
from .model import IndexSpec, TimeBucket
from .session import ResultReader, Session
from .table import TimeSeriesTable


def spark_session() -> SparkSession:
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table_name(path: str) -> str:
    """SQL name of a table directory: lower case, other signs as underscores, t_ before a leading digit."""
    name = re.sub(r"\W", "_", Path(path).absolute().name.lower())
    return name if re.match(r"[a-z_]", name) else f"t_{name}"


def index_spec(a: argparse.Namespace) -> IndexSpec:
    entities = tuple(a.entity or ())
    if a.index_type == "timestamp":
        if a.bucket_width is not None:
            raise TidemarkError("--bucket-width is for integer indexes; give --bucket")
        if a.bucket is None:
            raise TidemarkError("a timestamp index needs --bucket")
        return IndexSpec.timestamp(a.index, TimeBucket.parse(a.bucket), entities, a.timezone)
    if a.bucket is not None or a.timezone is not None:
        raise TidemarkError("--bucket and --timezone are for timestamp indexes; give --bucket-width")
    if a.bucket_width is None:
        raise TidemarkError("an integer index needs --bucket-width")
    return IndexSpec.integer(a.index, a.bucket_width, entities, a.index_type == "uint64")


def export(df: DataFrame, path: Path, fmt: str) -> None:
    """One CSV or JSON Lines file, written part by part; nothing stays on failure."""
    if path.exists():
        raise TidemarkError(f"{path} exists already")
    part = path.with_name(f".{path.name}.{os.getpid()}")
    try:
        with ResultReader(df) as reader, part.open("wb") as out:
            if fmt == "csv":
                with csv.CSVWriter(out, reader.schema) as writer:
                    for batch in reader:
                        writer.write_batch(batch)
            else:
                for batch in reader:
                    out.writelines(json.dumps(r, default=plain).encode() + b"\n" for r in batch.to_pylist())
        os.replace(part, path)
    finally:
        part.unlink(missing_ok=True)


def plain(v: Any) -> Any:
    """JSON form of a value that JSON lacks."""
    return v.isoformat() if hasattr(v, "isoformat") else base64.b64encode(v).decode() if isinstance(v, bytes) else str(v)


def paged(text: str) -> None:
    """Through $PAGER on a terminal that is too short for the text, else as it is."""
    pager = os.environ.get("PAGER", "less -S")
    if sys.stdout.isatty() and pager and text.count("\n") + 2 > shutil.get_terminal_size().lines:
        try:
            subprocess.run(shlex.split(pager), input=text, text=True, check=False)
            return
        except OSError:  # no such pager
            pass
    print(text)


def show(session: Session, sql: str, rows: int, explain: bool = False, output: str | None = None, fmt: str = "csv", timing: bool = False) -> None:
    began = time.time()
    df, kept = session.plan(sql)
    if explain:
        for name, segments in kept.items():
            print(f"{name}: {len(segments)} of {len(session.table(name).state.segments)} segment(s)")
        df.explain("formatted")
    if output:
        nested = [f.name for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
        if fmt == "csv" and nested:
            raise TidemarkError(f"CSV can't hold nested column(s): {', '.join(nested)}")
        export(df, Path(output), fmt)
    if rows:
        try:
            paged(text_table(df.limit(rows).toArrow(), rows))
        except PySparkException as e:
            raise SqlError(str(e)) from e
    if timing:
        print(f"{(time.time() - began) * 1000:.0f} ms")


class Shell(cmd.Cmd):
    """SQL goes on over lines to a semicolon; commands: append, optimize, refresh, alias, unalias, status,
    explain, timing, rows, help, cls, quit."""

    prompt = "tidemark> "

    def __init__(self, session: Session, name: str, table: TimeSeriesTable, rows: int = 20) -> None:
        super().__init__()
        self.session, self.name, self.table, self.rows = session, name, table, rows
        self.aliases: set[str] = set()
        self.timing, self.held = False, ""

    def _try(self, fn, *args) -> None:
        try:
            fn(*args)
        except (TidemarkError, OSError, ValueError) as e:
            print(f"error: {e}")

    def _sql(self, line: str) -> str:
        return sqltext.renamed(line, {a.lower(): self.name for a in self.aliases})

    def onecmd(self, line: str) -> bool:
        """Lines go to the statement that has begun, if one has."""
        if self.held or self.parseline(line)[0] in ("select", "with", "values"):
            return bool(self.default(line)) if line != "EOF" else self.do_quit("")
        return bool(super().onecmd(line))

    def do_append(self, path: str) -> None:
        """append PATH: append a Parquet file"""

        def run() -> None:
            began = time.time()
            self.table.refresh()
            print(f"version {self.table.append_parquet(shlex.split(path)[0] if path.strip() else '')}" + (f" in {(time.time() - began) * 1000:.0f} ms" if self.timing else ""))

        self._try(run)

    def do_optimize(self, _: str) -> None:
        """optimize: one file for each entity of mixed segments"""

        def run() -> None:
            self.table.refresh()
            print(self.table.optimize())

        self._try(run)

    def do_refresh(self, _: str) -> None:
        """refresh: load the newest version"""
        print("reloaded" if self.table.refresh() else "unchanged")

    def do_status(self, _: str) -> None:
        """status: version, segments, rows, bytes, bounds and aliases"""
        segments, spec = self.table.state.ordered(), self.table.index_spec
        print(f"{self.name} version {self.table.version}, {len(segments)} segments, {sum(s.rows for s in segments)} rows, {sum(s.size for s in segments)} bytes")
        if segments:
            print(f"{spec.column}: {spec.user_value(segments[0].low)} to {spec.user_value(max(s.high for s in segments))}")
        if self.aliases:
            print(f"aliases: {', '.join(sorted(self.aliases))}")

    def do_alias(self, name: str) -> None:
        """alias [NAME | --clear]: a second name for the table in statements"""
        name = name.strip()
        if name == "--clear":
            return self.do_unalias("")
        if name and not re.fullmatch(r"[A-Za-z_]\w*", name):
            print(f"error: {name!r} is not a name")
        elif name:
            self.aliases.add(name)
        print(", ".join(sorted({self.name, *self.aliases})))

    def do_unalias(self, name: str) -> None:
        """unalias [NAME]: drop one second name, or all"""
        self.aliases = self.aliases - {name.strip()} if name.strip() else set()

    def do_timing(self, how: str) -> None:
        """timing [on|off]: show how long statements take"""
        self.timing = how.strip().lower() != "off"

    def do_rows(self, n: str) -> None:
        """rows [N]: rows of a preview; 0 shows none"""
        self._try(lambda: setattr(self, "rows", max(0, int(n))) if n.strip() else print(self.rows))

    def do_explain(self, sql: str) -> None:
        """explain SQL: show the plan"""
        self._try(lambda: print(self.session.explain(self._sql(sql.rstrip("; ")))))

    def do_cls(self, _: str) -> None:
        """cls: clear the screen"""
        print("\033[2J\033[H", end="")

    do_clear = do_cls

    def do_quit(self, _: str) -> bool:
        """quit: leave"""
        return True

    do_exit = do_EOF = do_quit

    def emptyline(self) -> None:
        pass

    def default(self, line: str) -> None:
        text = f"{self.held}\n{line}" if self.held else line
        if not sqltext.ended(text):
            self.held, self.prompt = text, "     ...> "
            return
        self.held, self.prompt = "", Shell.prompt
        self._try(lambda: show(self.session, self._sql(text.strip().rstrip("; \n")), self.rows, timing=self.timing))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    c = sub.add_parser("create")
    c.add_argument("table")
    c.add_argument("--index", required=True)
    c.add_argument("--index-type", choices=("timestamp", "int64", "uint64"), default="timestamp")
    c.add_argument("--bucket")
    c.add_argument("--bucket-width", type=int)
    c.add_argument("--timezone")
    c.add_argument("--entity", action="append")
    a = sub.add_parser("append")
    a.add_argument("table")
    a.add_argument("parquet")
    a.add_argument("--timing", action="store_true")
    o = sub.add_parser("optimize")
    o.add_argument("table")
    q = sub.add_parser("query")
    q.add_argument("table")
    q.add_argument("sql")
    q.add_argument("--max-rows", type=int, default=20, help="0 shows none")
    q.add_argument("--explain", action="store_true")
    q.add_argument("--timing", action="store_true")
    q.add_argument("--output")
    q.add_argument("--format", choices=("csv", "jsonl"), default="csv")
    s = sub.add_parser("shell")
    s.add_argument("table")
    s.add_argument("--max-rows", type=int, default=20)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.verb == "create":
            t = TimeSeriesTable.create(spark_session(), a.table, index_spec(a))
            print(f"created {t.root} at version {t.version}")
        elif a.verb == "append":
            began = time.time()
            print(f"version {TimeSeriesTable.open(spark_session(), a.table).append_parquet(a.parquet)}")
            if a.timing:
                print(f"{(time.time() - began) * 1000:.0f} ms")
        elif a.verb == "optimize":
            print(TimeSeriesTable.open(spark_session(), a.table).optimize())
        else:
            session = Session(spark_session())
            name = table_name(a.table)
            table = session.register_tstable(name, a.table)
            if a.verb == "shell":
                Shell(session, name, table, a.max_rows).cmdloop()
            else:
                show(session, a.sql, a.max_rows, a.explain, a.output, a.format, a.timing)
    except (SqlError, TidemarkError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
