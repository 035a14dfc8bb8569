"""Personal-data detection with offset-preserving deobfuscation.

The four detectors run on the text itself (base spans). A transducer then rewrites homoglyphs, spelled
digits and addresses and at/dot disguises and keeps, for every character it emits, the source span it came from;
the same detectors run on the rewritten text and their finds are mapped back to source characters. A mapped
find is added if a rewrite lies inside it and no base span of its kind overlaps it. Whether a text is rewritten
at all is told by what every rewrite needs, so a find does not depend on other parts of the text, and every
pattern takes time in proportion to the text.

Defined results: a null text is empty; a text without finds has zero counts, no spans and the hash of the
empty string; equal starts are ordered by kind; base spans are never changed or removed; rows with equal
or null ids are each answered on their own; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Columns, arrow_rows

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind number, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches from the @ signs outwards: the part before an @ holds none, so each @ is tried once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Base spans of all kinds, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        if text.count(".") >= 3:
            for m in IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


#: Signs of other scripts that look like the ASCII sign beside them.
LOOKALIKES = {
    **dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуѵԁԛԝһ", "ABESIJKMHOPCTXYaesijopcxyvdqwh")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρικ", "ABEZHIKMNOPTYXovpik")),
    **dict(zip("ıȷɑɡ․。｡‐‑‒–—−⁃", "ijag...-------")),
}
#: Signs that are dropped: they show nothing.
UNSEEN = "​‌‍⁠﻿­"


def sign(c: str) -> str | None:
    """ASCII form of one sign, from the table or by compatibility decomposition; None if it has none."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in UNSEEN:
        return ""
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    flat = unicodedata.normalize("NFKC", c)
    return flat if flat != c and flat.isascii() and len(flat) == 1 and flat != " " else None


def table() -> dict[str, str]:
    return {chr(i): s for i in range(0x80, 0x20000) if not 0xD800 <= i < 0xE000 and (s := sign(chr(i))) is not None}


#: Spelled digits in the corpus languages.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "oh": "0", "plus": "+",
}
NUMBER = "|".join(sorted((w for w in DIGIT_WORDS if w != "plus"), key=lambda w: (-len(w), w)))
#: A run of spelled digits, mixed with written ones: at least three, so that prose with a lone number word is let be.
SPELLED = re.compile(rf"(?<!\w)(?:plus[ -]++)?(?:(?:{NUMBER}|[0-9]++)(?:[ .-]++|(?!\w))){{3,}}", re.I)
SPELLED_ITEM = re.compile(rf"(?:plus[ -]+)|(?:{NUMBER})", re.I)
#: An address in groups of one to three spelled or written digits, parted by dots or words for them.
GROUP = rf"(?:{NUMBER}|[0-9]{{1,3}})(?:[ -](?:{NUMBER}|[0-9])(?!\w)){{0,2}}"
DOTTED = r"(?:[ \t]{1,8}(?:dot|punkt|punto|point)[ \t]{1,8}|[ \t]?\.[ \t]?)"
SPELLED_IP = re.compile(rf"(?<!\w){GROUP}(?:{DOTTED}{GROUP}){{3}}(?!\w)", re.I)
SPELLED_IP_PART = re.compile(rf"(?P<dot>{DOTTED})|(?P<digit>{NUMBER})|(?P<gap>[ -]+)", re.I)
#: at and dot signs in brackets, as words between spaces, or between bars.
HIDDEN = re.compile(
    r"[\[({<]\s*+(?:(?P<at>at|@|arroba|ät)|(?P<dot>dot|punkt|point|punto|\.))\s*+[\])}>]"
    r"|(?<=[ \t])(?:(?P<at_word>at)|(?P<at_sure>arroba)|(?P<dot_word>dot|punkt|punto))(?=[ \t])"
    r"|_(?:(?P<at_bar>at)|(?P<dot_bar>dot))_",
    re.I,
)
#: What each disguise but the bare word "at" holds; that word alone changes nothing.
HIDDEN_PARTS = ("dot", "punkt", "punto", "arroba", "_at_", "(", "[", "{", "<")
SURE = re.compile(HIDDEN.pattern.replace("(?P<at_word>at)|", ""), re.I)
#: Number words as their ASCII pieces, and ASCII signs and all other bytes as blanks.
PIECES = frozenset(p.encode() for w in DIGIT_WORDS for p in re.split(r"[^a-z]", w) if p)
BLANKED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def counted(text: str) -> bool:
    """False only if no three number words or numbers, one at least spelled, follow each other."""
    words = text.encode("utf-8", "replace").translate(BLANKED).split()
    if PIECES.isdisjoint(words):
        return False
    run = spelled = 0
    for w in words:
        if w in PIECES:
            spelled = 1
        elif not w.isdigit() and w not in DOT_WORDS:
            run = spelled = 0
            continue
        run += 1
        if run >= 3 and spelled:
            return True
    return False


DOT_WORDS = frozenset((b"dot", b"punkt", b"punto", b"point"))


class Deobfuscator:
    """The composed transducers. rewrite() gives the text and, per character, source start, source end and rewrite mark."""

    def __init__(self) -> None:
        self.signs = table()

    def needed(self, text: str) -> bool:
        """False only if no rewrite that matters applies."""
        if not text.isascii() and not self.signs.keys().isdisjoint(set(text)):
            return True
        low = text.lower()
        return any(p in low for p in HIDDEN_PARTS) and bool(SURE.search(text)) or counted(text)

    def rewrite(self, text: str) -> tuple[str, list[int], list[int], list[int]]:
        n = len(text)
        if text.isascii():
            flat, starts, ends, marks = text, list(range(n)), list(range(1, n + 1)), [0] * n
        else:
            chars, starts, ends, marks = [], [], [], []
            get = self.signs.get
            for i, c in enumerate(text):
                r = get(c, c)
                if r:
                    chars.append(r)
                    starts.append(i)
                    ends.append(i + 1)
                    marks.append(0 if r == c else 1)
            flat = "".join(chars)
        for step in (self._addresses, self._spelled, self._hidden):
            flat, starts, ends, marks = self._apply(step(flat), flat, starts, ends, marks)
        return flat, starts, ends, marks

    @staticmethod
    def _apply(edits, flat, starts, ends, marks):
        """Replace (start, end, text, mark): what comes in their place spans all that they replace."""
        out, s2, e2, m2, at = [], [], [], [], 0
        for a, b, new, mark in edits:
            out.append(flat[at:a])
            s2 += starts[at:a]
            e2 += ends[at:a]
            m2 += marks[at:a]
            out.append(new)
            for _ in new:
                s2.append(starts[a])
                e2.append(ends[b - 1])
                m2.append(mark)
            at = b
        out.append(flat[at:])
        return "".join(out), s2 + starts[at:], e2 + ends[at:], m2 + marks[at:]

    @staticmethod
    def _addresses(flat: str) -> Iterator[tuple[int, int, str, int]]:
        """Spelled addresses: groups lose their gaps, words for dots become dots."""
        for run in SPELLED_IP.finditer(flat):
            parts = list(SPELLED_IP_PART.finditer(flat, run.start(), run.end()))
            if any(m["digit"] for m in parts):
                for m in parts:
                    yield m.start(), m.end(), "." if m["dot"] else DIGIT_WORDS[m["digit"].lower()] if m["digit"] else "", 18

    @staticmethod
    def _spelled(flat: str) -> Iterator[tuple[int, int, str, int]]:
        for run in SPELLED.finditer(flat):
            for m in SPELLED_ITEM.finditer(flat, run.start(), run.end()):
                word = m[0].rstrip(" -").lower()
                yield m.start(), m.end(), DIGIT_WORDS[word], 2

    @staticmethod
    def _hidden(flat: str) -> Iterator[tuple[int, int, str, int]]:
        """Disguises between signs of an address, with the blanks around them; these are looked through outwards
        from the disguise, and not beyond the one before."""
        last, n = 0, len(flat)
        for m in HIDDEN.finditer(flat):
            a, b = m.span()
            blank = str.isspace if m["at"] or m["dot"] else " \t".__contains__
            while a > last and blank(flat[a - 1]):
                a -= 1
            while b < n and blank(flat[b]):
                b += 1
            if last <= a and 0 < a and b < n and flat[a - 1] in LOCAL and flat[b] in LOCAL:
                at = m["at"] or m["at_word"] or m["at_sure"] or m["at_bar"]
                yield a, b, "@" if at else ".", 4 if m["at_word"] else 8 if at else 16
            last = max(last, b)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Finds that only the rewritten text shows, in source characters."""
        flat, starts, ends, marks = self.rewrite(text)
        taken = {k: [(s, e) for s, kind, e in base if kind == k] for k in range(len(KINDS))}
        out = []
        for s, k, e in detect(flat):
            inside = 0
            for m in marks[s:e]:
                inside |= m
            # a bare word "at" counts only beside a disguised dot
            if not inside or k == 0 and inside & 4 and not inside & 16:
                continue
            a, b = starts[s], ends[e - 1]
            near = taken[k]
            i = bisect.bisect_left(near, (b, b))
            if i and near[i - 1][1] > a:
                continue
            out.append((a, k, b))
        return out


def find_pii(text: str | None, rewriter: Deobfuscator) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one text."""
    text = text or ""
    base = detect(text)
    if not rewriter.needed(text):
        return base, base
    return base, sorted({*base, *rewriter.added(text, base)})


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base and all spans as lists of (kind, start, end)."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind string, start int, end int>>"

    def run(batches: Iterable[Columns]) -> Iterator[Columns]:
        rewriter = Deobfuscator()
        told = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        for b in batches:
            ids, texts = b.values()
            found = [find_pii(t, rewriter) for t in texts]
            yield {"id": ids, "base": [told(f[0]) for f in found], "spans": [told(f[1]) for f in found]}

    return arrow_rows(docs.select(id_col, text_col), run, f"id {kind}, base {span}, spans {span}").withColumnRenamed("id", id_col)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def run(batches: Iterable[Columns]) -> Iterator[Columns]:
        rewriter = Deobfuscator()
        for b in batches:
            found = [find_pii(t, rewriter) for t in b["text"]]
            yield {
                "doc_id": b["doc_id"],
                **{f"n_{kind}": [sum(x[1] == k for x in base) for base, _ in found] for k, kind in enumerate(KINDS)},
                "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found],
                "spans": [joined(spans) for _, spans in found],
            }

    return arrow_rows(docs.select(F.col("doc_id"), F.col("text")), run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
