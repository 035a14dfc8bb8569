"""Rewrites of SQL text before parsing. Strings, quoted names and comments are never touched."""

from __future__ import annotations

import re

TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\$(?P<param>\w+)|(?P<word>[A-Za-z_][\w$]*)|(?P<other>.)", re.S)


def pieces(sql: str):
    """(text, parameter name or None, bare word or None)"""
    for m in TOKEN.finditer(sql):
        yield m[0], m["param"], m["word"]


def named_parameters(sql: str) -> str:
    """$1 and $name become :p_1 and :p_name."""
    return "".join(f":p_{param}" if param else text for text, param, _ in pieces(sql))


def unsigned_types(sql: str) -> str:
    """BIGINT UNSIGNED becomes DECIMAL(20, 0)."""
    out, held = [], None
    for text, _, word in pieces(sql):
        if held is not None:
            if text.isspace():
                held += text
                continue
            if word and word.upper() == "UNSIGNED":
                out.append("DECIMAL(20, 0)")
                held = None
                continue
            out.append(held)
            held = None
        if word and word.upper() == "BIGINT":
            held = text
        else:
            out.append(text)
    return "".join(out) + (held or "")


def month_strides(sql: str) -> str:
    """date_bin over an interval of months or years, which Spark keeps apart from days, is a function of its own."""
    parts = [(text, word) for text, _, word in pieces(sql)]
    out = [text for text, _ in parts]
    for i, (_, word) in enumerate(parts):
        if not word or word.lower() != "date_bin":
            continue
        ahead = [text for text, _ in parts[i + 1 :] if not text.isspace() and not text.startswith(("--", "/*"))]
        if ahead[:1] == ["("] and len(ahead) > 2 and ahead[1].upper() == "INTERVAL":
            stride = " ".join(ahead[2 : (ahead.index(",") if "," in ahead else len(ahead))]).upper()
            if re.search(r"\b(MONTH|YEAR)S?\b", stride):
                out[i] = "date_bin_months"
    return "".join(out)


def renamed(sql: str, names: dict[str, str]) -> str:
    """Bare words that are an alias become its table's name; strings, quoted names and comments stay, and so does
    what follows a dot."""
    out, before = [], ""
    for text, _, word in pieces(sql):
        out.append(names.get(word.lower(), text) if word and before != "." else text)
        before = text
    return "".join(out)


def ended(sql: str) -> bool:
    """Whether a statement ends in a semicolon that is no part of a string, name or comment."""
    last = ""
    for text, _, _ in pieces(sql):
        if not text.isspace() and not text.startswith(("--", "/*")):
            last = text
    return last == ";"


EXPLAIN = re.compile(r"\s*EXPLAIN\s+(?:(EXTENDED|VERBOSE|CODEGEN|COST|FORMATTED|SIMPLE)\s+)?(?=SELECT\b|WITH\b|VALUES\b|\()", re.I)


def explained(sql: str) -> tuple[str, str] | None:
    """(mode, query) of an EXPLAIN of a query."""
    m = EXPLAIN.match(sql)
    if not m:
        return None
    mode = (m[1] or "simple").lower()
    return {"verbose": "extended"}.get(mode, mode), sql[m.end() :]


def prepared(sql: str) -> str:
    return month_strides(unsigned_types(named_parameters(sql)))


def parameters(params) -> dict:
    """Arguments by the names that named_parameters gives them."""
    if params is None:
        return {}
    if isinstance(params, dict):
        return {f"p_{str(k).lstrip('$')}": v for k, v in params.items()}
    if not isinstance(params, (list, tuple)):
        raise TypeError("params are a mapping or a sequence of values")
    return {f"p_{i}": v for i, v in enumerate(params, 1)}
