"""Bounded previews of results as text and HTML."""

from __future__ import annotations

import html
import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

import pyarrow as pa


#: Prefix of the environment's settings, and the file that holds others in its table [display].
ENV, FILE = "TIDEMARK_DISPLAY_", "tidemark.toml"


@dataclass(frozen=True)
class Preview:
    """How tables are shown in notebooks: rows from both ends, columns, signs of a value."""

    head: int = 20
    tail: int = 5
    columns: int = 50
    width: int = 120

    @classmethod
    def configured(cls, folder: str | os.PathLike = ".") -> Preview:
        """Settings of the environment before those of the file before the defaults; wrong ones raise ValueError."""
        path = Path(folder) / FILE
        try:
            found = tomllib.loads(path.read_text()).get("display", {}) if path.is_file() else {}
        except tomllib.TOMLDecodeError as e:
            raise ValueError(f"{path}: {e}") from e
        names = [f.name for f in fields(cls)]
        if unknown := sorted(set(found) - set(names)):
            raise ValueError(f"{path}: unknown setting(s) {', '.join(unknown)}")
        found |= {n: os.environ[ENV + n.upper()] for n in names if ENV + n.upper() in os.environ}
        try:
            values = {n: int(v) for n, v in found.items()}
        except (TypeError, ValueError) as e:
            raise ValueError(f"display settings are whole numbers: {e}") from e
        if bad := [n for n, v in values.items() if v < (0 if n == "tail" else 1)]:
            raise ValueError(f"{bad[0]} is too small")
        return cls(**values)


def enable_notebook_display(preview: Preview | None = None) -> bool:
    """Show Arrow tables as HTML in this notebook; False outside of one."""
    try:
        from IPython import get_ipython
    except ImportError:
        return False
    shell = get_ipython()
    if shell is None:
        return False
    shown = preview or Preview.configured()
    shell.display_formatter.formatters["text/html"].for_type(pa.Table, lambda t: html_table(t, shown.head, shown.tail, shown.width, shown.columns))
    return True


def cell(value: Any) -> str:
    """Floats with at most six decimals and no trailing zeros; bytes as hex."""
    if value is None:
        return ""
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".") if value == value and abs(value) < 1e15 else str(value)
    return value.hex() if isinstance(value, bytes) else str(value)


def text_table(table: pa.Table, rows: int = 20) -> str:
    """Aligned columns of the first rows."""
    part = table.slice(0, rows)
    shown = [list(r) for r in zip(*([cell(v) for v in c.to_pylist()] for c in part.columns))]
    widths = [max(len(r[i]) for r in [table.column_names, *shown]) for i in range(table.num_columns)]
    line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip()
    return "\n".join([line(table.column_names), "-+-".join("-" * w for w in widths), *map(line, shown)])


def html_table(table: pa.Table, head: int = 20, tail: int = 5, width: int = 120, columns: int = 50) -> str:
    """HTML of the first and last rows and the first columns; long values are shortened."""
    n, wide = table.num_rows, table.num_columns
    table = table.select(range(min(wide, columns)))
    parts = [table] if n <= head + tail else [table.slice(0, head), table.slice(n - tail)]
    short = lambda s: s if len(s) <= width else s[: width - 1] + "…"
    row = lambda values, tag: "<tr>" + "".join(f"<{tag}>{html.escape(short(v))}</{tag}>" for v in values) + "</tr>"
    body = [[row([cell(v) for v in r.values()], "td") for r in p.to_pylist()] for p in parts]
    gap = [f'<tr><td colspan="{table.num_columns}">… {n - head - tail} more …</td></tr>'] if len(parts) == 2 else []
    return "<table>" + row(table.column_names, "th") + "".join(sum([body[0], gap, *body[1:]], [])) + f"</table><p>{n} rows, {wide} columns</p>"
