"""Benchmark decontamination by greedy string tiling.

Documents and test items meet where they share a seed of ``min_match`` consecutive tokens. For every such
pair, tiles are laid: the longest matches of unmarked tokens are found by Karp-Rabin hashes of falling
length and marked without overlap, until no match of ``min_match`` tokens is left. The share of the item's
tokens under tiles is its coverage, whatever the order its passages stand in; a document is contaminated
by an item at ``coverage`` or more.

The items are sent to the tasks, in parts of about PASS_BYTES bytes of text so that a part's index stays within
about ten times that; the documents are read once for each part, and every row is judged where it stands. So
nothing is shuffled, no token or passage can be a hot key, and the answer is the same at every size of the
benchmark and of a part.

Defined results: null or blank texts and items have no tokens and never match; an item shorter than
``min_match`` tokens is matched whole; rows without an id are checked like others; every row of the documents
meets every row of the items, so repeated ones give one row each pair; extra columns are ignored; an empty
table on either side gives no pairs and keeps all documents.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Columns, arrow_rows, filtered

MIN_MATCH, COVERAGE, START = 5, 0.5, 20
#: Bytes of item texts, about, that are sent to the tasks at a time. An item is never divided.
PASS_BYTES = 8 << 20
#: Tokens are runs of ASCII letters, digits and underscores and of non-ASCII signs but punctuation.
MARKS = re.compile("[\u0080-\u00bf\u2000-\u206f\u3000-\u303f]")
SPACED = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
MATCHED = "doc_id bigint, item_id bigint, coverage double, tiles int, covered int, item_tokens int"


def tokens(text: str | None) -> list[bytes]:
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = MARKS.sub(" ", text)
    return text.encode("utf-8", "replace").translate(SPACED).split()


def karp_rabin(seq: list[int], marked: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(start, rolling hash) of every unmarked stretch of s tokens."""
    base, mod = 1_000_003, (1 << 61) - 1
    top = pow(base, s - 1, mod)
    h = run = 0
    for i, t in enumerate(seq):
        if marked[i]:
            h = run = 0
            continue
        if run >= s:
            h = (h - seq[i - s] * top) % mod
        h = (h * base + t) % mod
        run += 1
        if run >= s:
            yield i - s + 1, h


def tile(pattern: list[int], text: list[int], min_match: int, start: int = START) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (pattern start, text start, length), longest first."""
    p_marked, t_marked, tiles = [False] * len(pattern), [False] * len(text), []
    s = max(min_match, min(start, len(pattern)))
    while True:
        table: dict[int, list[int]] = {}
        for i, h in karp_rabin(text, t_marked, s):
            table.setdefault(h, []).append(i)
        found: list[tuple[int, int, int]] = []
        longest = 0
        for i, h in karp_rabin(pattern, p_marked, s):
            for j in table.get(h, ()):
                if pattern[i : i + s] != text[j : j + s]:
                    continue
                k = s
                while i + k < len(pattern) and j + k < len(text) and pattern[i + k] == text[j + k] and not p_marked[i + k] and not t_marked[j + k]:
                    k += 1
                longest = max(longest, k)
                found.append((k, i, j))
            if longest > 2 * s:
                break
        if longest > 2 * s:  # scan again with a length nearer to the longest match
            s = longest
            continue
        heap = [(-k, i, j) for k, i, j in found]
        heapq.heapify(heap)
        while heap:
            k, i, j = heapq.heappop(heap)
            k = -k
            free = [not (p_marked[i + d] or t_marked[j + d]) for d in range(k)]
            if all(free):
                p_marked[i : i + k] = [True] * k
                t_marked[j : j + k] = [True] * k
                tiles.append((i, j, k))
                continue
            d = 0  # what an earlier tile has left of it goes back by its own length
            while d < k:
                e = d
                while e < k and free[e]:
                    e += 1
                if e - d >= s:
                    heapq.heappush(heap, (d - e, i + d, j + d))
                d = e + 1
        if s <= min_match:
            return tiles
        s = max(min_match, s // 2) if s > 2 * min_match else min_match


class Benchmark:
    """Items as token numbers with an index of their seeds."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_match: int) -> None:
        self.min_match, self.vocabulary, self.items = min_match, {}, []
        for item_id, text in items:
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)], dtype=np.int64)
            if len(words):
                self.items.append((item_id, words))
        self.widths = sorted({min(min_match, len(w)) for _, w in self.items})
        # seeds in order, and the items that hold each, as stretches of one array
        found, held = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int32)]
        for k, (_, words) in enumerate(self.items):
            own = np.unique(self.hashes(words, min(min_match, len(words))))
            found.append(own)
            held.append(np.full(len(own), k, dtype=np.int32))
        every, items_of = np.concatenate(found), np.concatenate(held)
        order = np.argsort(every, kind="stable")
        self.owners = items_of[order]
        self.seeds, self.first = np.unique(every[order], return_index=True)
        self.last = np.r_[self.first[1:], len(every)]
        # one bit for each value of a seed's low bits: most documents' stretches end here
        self.slots = np.zeros(1 << 20, dtype=bool)
        self.slots[self.seeds & np.uint64((1 << 20) - 1)] = True

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        """A hash for each stretch of n token numbers; stretches with an unknown token (0) are marked by no seed."""
        if len(ids) < n:
            return np.empty(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h = np.full(len(ids) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ x[k : len(ids) - n + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(29)
        return h

    def check(self, text: str | None, coverage: float) -> list[tuple]:
        """(item_id, coverage, tiles, covered, item tokens) of the items that reach the coverage."""
        words = tokens(text)
        if not words or not self.items:
            return []
        get = self.vocabulary.get
        ids = np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words))
        places: dict[int, list[tuple[int, int]]] = {}
        for n in self.widths:
            h = self.hashes(ids, n)
            maybe = np.flatnonzero(self.slots[h & np.uint64((1 << 20) - 1)])
            if not len(maybe):
                continue
            at = np.searchsorted(self.seeds, h[maybe])
            at[at == len(self.seeds)] = 0
            for i, k in zip(maybe[self.seeds[at] == h[maybe]].tolist(), at[self.seeds[at] == h[maybe]].tolist()):
                for item in self.owners[self.first[k] : self.last[k]].tolist():
                    places.setdefault(item, []).append((i, n))
        out = []
        for item, spots in sorted(places.items()):
            item_id, pattern = self.items[item]
            held = np.zeros(len(words) + 1, dtype=np.int64)  # tiles consist of seeds: other tokens can be in none
            for i, n in spots:
                held[i] += 1
                held[i + n] -= 1
            inside = np.cumsum(held[:-1]) > 0
            n = min(self.min_match, len(pattern))
            if np.count_nonzero(inside) < n or np.count_nonzero(inside) < coverage * len(pattern):  # a tile takes each token once
                continue
            kept, last = [], -1
            for i in np.flatnonzero(inside).tolist():
                if kept and i != last + 1:
                    kept.append(-len(kept))  # a break that matches nothing
                kept.append(int(ids[i]))
                last = i
            tiles = tile(pattern.tolist(), kept, n)
            covered = sum(t[2] for t in tiles)
            if covered and covered >= coverage * len(pattern):
                out.append((item_id, covered / len(pattern), len(tiles), covered, len(pattern)))
        return out


def parts(items: DataFrame, min_match: int, pass_bytes: int) -> Iterator[Benchmark]:
    """The items dealt by hash into parts that a task can hold."""
    q = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text"))
    size = q.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // pass_bytes))
    for k in range(n):
        some = q.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Benchmark([(r["item_id"], r["text"]) for r in some], min_match)


def contaminated(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Pairs of doc_id and item_id with the item's coverage, where it reaches the threshold."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    names = ("doc_id", "item_id", "coverage", "tiles", "covered", "item_tokens")

    def found(bench: Benchmark) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterable[Columns]) -> Iterator[Columns]:
            for b in batches:
                rows = [(i, *r) for i, t in zip(b["doc_id"], b["text"]) for r in sent.value.check(t, coverage)]
                if rows:
                    yield dict(zip(names, map(list, zip(*rows))))

        return arrow_rows(d, run, MATCHED)

    return reduce(DataFrame.unionAll, map(found, parts(items, min_match, pass_bytes)))


def clean_documents(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Rows of docs that no item contaminates; every row is judged on its own text."""
    for bench in parts(items, min_match, pass_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(bench)
        docs = filtered(docs, lambda texts, sent=sent: [not sent.value.check(t, coverage) for t in texts], "text")
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
