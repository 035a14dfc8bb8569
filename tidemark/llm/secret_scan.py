"""Secret scans with one combined deterministic automaton.

All rules are compiled by subset construction and minimisation into one transition array over byte
classes; one pass over the bytes finds the stretches with any hit. Inside such a stretch the automaton of each
rule that was seen, read backwards, tells where its matches begin, and read forwards where they end, so no byte
is tried as a start in vain; an exact check drops matches that are too short, and byte offsets become code points. A private key's span goes on over its body, beyond the stretch, to the END
line or, without one, to the end of its base64 lines.

Defined results: a null text is empty; a text without finds has zero counts, no spans and the hash of the
empty string; equal starts are ordered by kind; rows with equal or null ids are each answered on their
own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Dfa, Scanner, compile_rules
from .common import Columns, arrow_rows


@dataclass(frozen=True)
class Rule:
    """hit: the least text that makes a match possible; whole: the match; fits: the exact check of a match;
    rest: where the secret that follows a match ends, given the bytes, the match's end and the text's."""

    kind: str
    hit: str
    whole: str
    fits: Callable[[bytes], bool]
    rest: Callable[[bytes, int, int], int] | None = None


KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile(rb"(?i:%s)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % KEYWORDS.encode())


def at_least(n: int) -> Callable[[bytes], bool]:
    return lambda m: len(m) >= n


def assigned(m: bytes) -> bool:
    found = ASSIGN.fullmatch(m)
    return found is not None and len(found[1]) >= 12


PEM_EDGE = re.compile(rb"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
#: What a key without END line goes on with: headers and base64 lines, also quoted, commented or with escaped line ends.
PEM_LINES = re.compile(rb"""(?:(?:[\s"',>#*|]|\\[nr])*+(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/=]{16,}+))*+(?:(?:[\r\n]|\\[nr])++[A-Za-z0-9+/]{1,15}+={0,2}+(?=[\r\n\\]|\Z)|\s*+[A-Za-z0-9+/]{1,15}+={1,2}+)?""")


def pem_end(data: bytes, at: int, end: int) -> int:
    """End of a private key whose BEGIN line ends at at: that of its END line, or of its last base64 line."""
    edge = PEM_EDGE.search(data, at, end)
    return edge.end() if edge and edge[1] == b"END" else PEM_LINES.match(data, at, end).end()


#: The first three are the base kinds; the rest are published token formats.
RULES = (
    Rule("assign", f"(?i)({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=\\-]", f"(?i)({KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=\\-]+", assigned),
    Rule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", at_least(18)),
    Rule("hex", "[0-9a-f]{16}", "[0-9a-f]+", at_least(16)),
    Rule("github", "gh[pousr]_[A-Za-z0-9]", "gh[pousr]_[A-Za-z0-9]+", at_least(40)),
    Rule("slack", "xox[abprs]\\-[A-Za-z0-9]", "xox[abprs]\\-[A-Za-z0-9\\-]+", at_least(20)),
    Rule("google", "AIza[A-Za-z0-9_\\-]", "AIza[A-Za-z0-9_\\-]+", at_least(39)),
    Rule("stripe", "[rs]k_(live|test)_[A-Za-z0-9]", "[rs]k_(live|test)_[A-Za-z0-9]+", at_least(24)),
    Rule("jwt", "eyJ[A-Za-z0-9_\\-]+\\.eyJ", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", at_least(40)),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----", at_least(1), pem_end),
)
BASE = 3
#: Bytes of text that one pass takes at a time.
PASS_BYTES = 8 << 20


class Secrets:
    """The compiled rules; spans() answers a list of texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.any: Dfa = compile_rules([r.hit for r in rules], anywhere=True)
        self.each: list[Dfa] = [compile_rules([r.whole], anywhere=False) for r in rules]
        self.begin: list[Dfa] = [compile_rules([r.whole], anywhere=True, mirrored=True) for r in rules]
        self.scan = Scanner(self.any)

    def matches(self, data: bytes, start: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(start, kind number, end) in bytes of one stretch."""
        mask = self.any.seen(data, start, end)
        for k, rule in enumerate(self.rules):
            if mask >> k & 1:
                dfa, done = self.each[k], start
                for i in reversed(self.begin[k].starts(data, start, end)):
                    if i < done:
                        continue
                    done = dfa.longest(data, i, end)
                    if rule.fits(data[i:done]):
                        yield i, k, done

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Per text (start, kind number, end) in code points, by start, then kind."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        a = 0
        while a < len(coded):
            b, size = a, 0
            while b < len(coded) and (b == a or size + len(coded[b]) <= PASS_BYTES):
                size += len(coded[b])
                b += 1
            bounds = np.cumsum([len(c) for c in coded[a:b]])
            data = b"".join(coded[a:b])
            for start, end in self.scan(data, bounds):
                i = int(np.searchsorted(bounds, start, side="right"))
                base = int(bounds[i]) - len(coded[a + i])
                points = lambda at, i=i, base=base: at - base if len(coded[a + i]) == len(texts[a + i]) else len(data[base:at].decode("utf-8", "surrogatepass"))
                for s, k, e in self.matches(data, start, end):
                    rest = self.rules[k].rest
                    out[a + i].append((points(s), k, points(rest(data, e, int(bounds[i])) if rest else e)))
            a = b
        for found in out:
            found.sort()
        return out


def joined(kinds: list[str], spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, list of (kind, start, end)."""
    kind, secrets = docs.schema[id_col].dataType.simpleString(), Secrets()

    def run(batches: Iterable[Columns]) -> Iterator[Columns]:
        for b in batches:
            ids, texts = b.values()
            found = secrets.spans(texts)
            yield {"id": ids, "spans": [[{"kind": RULES[k].kind, "start": s, "end": e} for s, k, e in f] for f in found]}

    return arrow_rows(docs.select(id_col, text_col), run, f"id {kind}, spans array<struct<kind string, start int, end int>>").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every secret replaced by [KIND]; n_chars, if there, follows the new text."""
    schema, secrets = docs.schema, Secrets()

    def run(batches: Iterable[Columns]) -> Iterator[Columns]:
        for b in batches:
            texts, sizes = list(b[text_col]), list(b["n_chars"]) if "n_chars" in b else None
            for i, found in enumerate(secrets.spans(texts)):
                if not found:
                    continue
                parts, at = [], 0
                for s, k, e in found:
                    if s >= at:
                        parts += [texts[i][at:s], f"[{RULES[k].kind.upper()}]"]
                    at = max(at, e)
                texts[i] = "".join(parts) + texts[i][at:]
                if sizes is not None:
                    sizes[i] = len(texts[i])
            yield b | {text_col: texts} | ({} if sizes is None else {"n_chars": sizes})

    return arrow_rows(docs, run, schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    secrets, kinds = Secrets(), [r.kind for r in RULES]

    def run(batches: Iterable[Columns]) -> Iterator[Columns]:
        for b in batches:
            found = secrets.spans(b["text"])
            base = [[x for x in f if x[1] < BASE] for f in found]
            yield {
                "doc_id": b["doc_id"],
                **{f"n_{kinds[k]}": [sum(x[1] == k for x in f) for f in base] for k in range(BASE)},
                "base_sha256": [hashlib.sha256(joined(kinds, f).encode()).hexdigest() for f in base],
                "spans": [joined(kinds, f) for f in found],
            }

    return arrow_rows(docs.select(F.col("doc_id"), F.col("text")), run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
