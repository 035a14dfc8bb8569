"""Near copies by word shingles: 5-word Jaccard similarity of 0.8 or more, found exactly.

A text is the set of its 5-word shingles, lower-cased and with any white space as one. All shingles have one order:
those that are frequent in a sample of the texts come last, the others by their hash. The order moves work, not
results. Two sets of similarity 0.8 or more share one of the first n - ceil(0.8 n) + 1 shingles of either (n: its
size), so texts that share such a shingle meet in its cell. Shingles travel there as KEY bytes of their hash, packed by
ranges of keys; what a cell of two shingles holds too much costs work only. Two filters discard pairs there, neither a similar one:
the sizes differ too much, or, if the cell's shingle is the first one the pair shares, too few are left behind it.
So every similar pair passes in the cell of its first shared shingle, whatever the cell's size.

Pairs never leave a cell as rows. Where a cell has pairs beside one partner for each text, the texts' counts of shingles
by slots come to it, the more slots the longer the text, pairs that differ by too many are discarded, and a spanning forest of the rest leaves
the task: fewer rows than texts. So similar texts are of one component of these edges. The texts of a component then
meet in one task (or in each two blocks of PART texts or WEIGHT shingles, if they are more), where all pairs are
verified on the shingle sets, one range of hashes after the other, and again only a forest leaves. With closest, texts whose SimHash fingerprints of these shingles are
linked by the pivot tables of simhash.py are candidates too.

Defined results: texts equal up to case and white space are one node; a null text has no words, and texts
without words are one node; fewer than five words make one shingle of all; rows without an id take part,
and a component's id is its smallest non-null id (null if it has none).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import simhash
from .common import Columns, arrow_rows, dropped, written
from .components import connected_components

SHINGLE = 5
SEED = 42
#: Texts of the sample that tells frequent shingles, and the most of these that are told.
SAMPLE, FREQUENT = 4000, 1 << 16
#: Least slots of a text's shingle counts, and the shingles a slot holds in the mean before there are twice as many slots.
BUCKETS, MEAN = 256, 8
#: Bytes of a shingle's key, keys of a part of them, and keys that are sorted into parts at once.
KEY, KEYS, SORTED = 5, 1 << 17, 1 << 18
#: Marks of the frequent shingles, by the first bits of their hashes.
MARKS = 20
#: Rows and columns of a block of comparisons.
BLOCK = 1024
#: Pairs whose slots are compared at once, and shingles whose sets are.
PAIRS, COLUMNS = 4096, 4096
#: Texts of a cell that is compared together with others of its size.
SMALL = 32
#: Texts of a block, and shingles of it; a group of more is compared in each two of its blocks.
PART, WEIGHT = 512, 1 << 21
#: Shingles of all sets of two blocks that are numbered at once.
RANGE = 1 << 18
#: Slots of the bitmap of wanted nodes (8 MB).
BITS = 1 << 26
ODDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def normal(text_col: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " ")))


def raw(text_col: str) -> Column:
    """The hash of a text as it stands, null as empty: tells texts apart without working out their normal form."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def lowered(text_col: str) -> Column:
    """A text whose words between white space (Java's, which is that of bytes) are those of the normal text."""
    return F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary")


def shingles(text: str | bytes) -> np.ndarray:
    """Sorted distinct hashes of a normal or lowered text's shingles."""
    return of_words((text.encode("utf-8", "replace") if isinstance(text, str) else text).split())


def of_words(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([h(b" ".join(words), SEED)], dtype=np.uint64)
    each = np.fromiter(map(h, words), dtype=np.uint64, count=len(words))
    n = len(words) - SHINGLE + 1
    x = each[:n] * ODDS[0]
    for j in range(1, SHINGLE):
        x = (x ^ (x >> np.uint64(29))) * ODDS[j] + each[j : n + j] * ODDS[(j + 1) % SHINGLE]
    x = (x ^ (x >> np.uint64(32))) * ODDS[0]
    x = np.sort(x ^ (x >> np.uint64(29)))
    return x[np.r_[True, x[1:] != x[:-1]]]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def passing(n_a: np.ndarray, left_a: np.ndarray, n_b: np.ndarray, left_b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar if their first shared shingle has so many left, itself included."""
    both = 9 * np.minimum(left_a, left_b) >= 4 * (n_a + n_b)
    return both & (5 * np.minimum(n_a, n_b) >= 4 * np.maximum(n_a, n_b))


def marked(frequent: np.ndarray) -> np.ndarray:
    """Where a frequent shingle may be, by the first bits of its hash."""
    marks = np.zeros(1 << MARKS, dtype=bool)
    marks[(frequent >> np.uint64(64 - MARKS)).astype(np.int64)] = True
    return marks


def first_ones(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The shingles of a set that a similar one must share one of, in the order of all."""
    most = len(found) - (4 * len(found) + 4) // 5 + 1
    at = np.flatnonzero(marks[(found >> np.uint64(64 - MARKS)).astype(np.int64)])
    if len(at):
        place = np.minimum(np.searchsorted(frequent, found[at]), len(frequent) - 1)
        hit = frequent[place] == found[at]
        at, place = at[hit], place[hit]
        found = np.r_[np.delete(found, at), found[at[np.argsort(counts[place], kind="stable")]]]
    return found[:most]


def slots(found: np.ndarray) -> bytes:
    """Counts of a set's shingles by slots, modulo 16, two in a byte."""
    width = max(BUCKETS, 1 << (len(found) // MEAN).bit_length())
    counts = np.bincount((found % np.uint64(width)).astype(np.int64), minlength=width).astype(np.uint8)
    return ((counts[::2] & 15) | (counts[1::2] << 4)).tobytes()


def counted(told: bytes, sets: int, width: int) -> np.ndarray:
    """Counts of so many sets by so many slots, at most those that were told: further ones are added to the first."""
    each = np.frombuffer(told, np.uint8).reshape(sets, -1) if sets else np.empty((0, width // 2), np.uint8)
    counts = np.stack([each & 15, each >> 4], axis=2).reshape(sets, each.shape[1] * 2 // width, width)
    return counts.sum(axis=1, dtype=np.uint8) & 15


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles are in one set only, at least. In similar sets they are a ninth of both at most."""
    d = (a - b) & 15
    return np.minimum(d, 16 - d).sum(axis=-1, dtype=np.int64)


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, those of one place together: what is alike in them is compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()


def whole(told: Iterable[bytes], width: int) -> np.ndarray:
    parts = [np.frombuffer(x, np.uint8).reshape(width, -1) for x in told]
    out = np.zeros((sum(p.shape[1] for p in parts), 8), dtype=np.uint8)
    np.concatenate([p.T for p in parts], out=out[:, :width])
    return out.view(np.int64).ravel()


def keys(found: np.ndarray) -> bytes:
    return np.ascontiguousarray((found >> np.uint64(64 - 8 * KEY)).view(np.uint8).reshape(-1, 8)[:, :KEY]).tobytes()


def by_arrays(df: DataFrame, fn: Callable[[Iterator[dict[str, np.ndarray]]], Iterable[dict[str, np.ndarray]]], schema: str) -> DataFrame:
    """mapInArrow for functions over columns of numbers without nulls."""
    out = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn({n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def whole_cells(batches: Iterable[dict[str, np.ndarray]]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """(rows, first row of each cell and the end) of rows sorted by (k, node), equal ones once, no cell cut in two."""

    def told(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        k, i = rows["k"], rows["node"]
        stay = np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1])]
        rows = {c: v[stay] for c, v in rows.items()}
        k = rows["k"]
        return rows, np.r_[np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), len(k)]

    held: list[dict[str, np.ndarray]] = []  # rows of one cell, which may go on
    for b in batches:
        if not len(b["k"]):
            continue
        held.append(b)
        if b["k"][-1] == held[0]["k"][0]:
            continue
        rows = {c: np.concatenate([h[c] for h in held]) for c in b}
        cut = int(np.searchsorted(rows["k"], rows["k"][-1]))
        yield told({c: v[:cut] for c, v in rows.items()})
        held = [{c: v[cut:] for c, v in rows.items()}]
    if held:
        yield told({c: np.concatenate([h[c] for h in held]) for c in held[0]})


def cells(signed: DataFrame) -> DataFrame:
    """(k, node, n, pos) of the texts of each cell that has more than one."""
    parts = max(1, -(-(signed.select(F.sum(F.length("firsts"))).first()[0] or 0) // (KEY * KEYS)))
    packed = T.StructType.fromDDL("part int, k binary, node binary, n binary, pos binary")
    packed_arrow = to_arrow_schema(packed)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            size = pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) // KEY
            ends = np.cumsum(size)
            start = 0
            while start < len(nodes):
                done = ends[start] - size[start]
                stop = max(start + 1, int(np.searchsorted(ends, done + SORTED, side="right")))
                told = np.frombuffer(b"".join(b.column(2).slice(start, stop - start).to_pylist()), np.uint8).reshape(-1, KEY)
                k = np.zeros((len(told), 8), dtype=np.uint8)
                k[:, :KEY] = told
                k = k.view(np.int64).ravel()
                of = np.repeat(np.arange(start, stop), size[start:stop])
                pos = np.arange(len(k)) - (ends - size)[of] + done
                order = np.argsort(k)
                k, of, pos = k[order], of[order], pos[order].astype(np.int32)
                part = k.view(np.uint64) * np.uint64(parts) >> np.uint64(8 * KEY)
                cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(k)].tolist()
                node, many = nodes[of], n[of]
                each = [slice(i, j) for i, j in zip(cuts[:-1], cuts[1:])]
                cols = [part[cuts[:-1]].astype(np.int32), *([planes(x[c], w) for c in each] for x, w in ((k, KEY), (node, 8), (many, 4), (pos, 4)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, packed_arrow)], schema=packed_arrow)
                start = stop

    schema = T.StructType.fromDDL("k bigint, node bigint, n int, pos int")
    arrow = to_arrow_schema(schema)

    def shared(held: list[list[bytes]]) -> pa.RecordBatch:
        k, node, n, pos = (whole(x, w) for x, w in zip(zip(*held), (KEY, 8, 4, 4)))
        order = np.argsort(k)
        same = k[order[1:]] == k[order[:-1]]
        at = order[np.r_[False, same] | np.r_[same, False]]
        at = at[np.lexsort((pos[at], node[at], k[at]))]
        # of equal texts, and of two shingles of a text with one key, the first stands
        at = at[np.r_[True, (k[at][1:] != k[at][:-1]) | (node[at][1:] != node[at][:-1])]] if len(at) else at
        same = k[at][1:] == k[at][:-1]
        at = at[np.r_[False, same] | np.r_[same, False]] if len(at) else at
        return pa.RecordBatch.from_arrays([pa.array(x[at], f.type) for x, f in zip((k, node, n.astype(np.int32), pos.astype(np.int32)), arrow)], schema=arrow)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            for i, p in enumerate(b.column(0).to_pylist()):
                if p != part:
                    if held:
                        yield shared(held)
                    part, held = p, []
                held.append([b.column(c)[i].as_py() for c in range(1, 5)])
        if held:
            yield shared(held)

    dealt = signed.select("node", "n", "firsts").mapInArrow(pack, packed).repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(meet, schema)


def partners(batches: Iterable[dict[str, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
    """First round: of each text of a cell that passes with another, the first such text before it (or itself), and
    whether its cell holds pairs beside these."""
    for rows, starts in whole_cells(batches):
        n, left, nodes = rows["n"], rows["n"] - rows["pos"], rows["node"]
        size = np.diff(starts)
        two = starts[:-1][size == 2]
        two = two[passing(n[two], left[two], n[two + 1], left[two + 1])]
        at, first, more = [two + 1], [two], [np.zeros(len(two), dtype=bool)]
        # in a pair that passes, the smaller set has eight ninths left
        small = np.add.reduceat(9 * left >= 8 * n, starts[:-1]) > 0
        for s, e in zip(starts[:-1][(size > 2) & small].tolist(), starts[1:][(size > 2) & small].tolist()):
            before = np.full(e - s, -1)
            some, pairs = np.zeros(e - s, dtype=bool), 0
            for i in range(s, e, BLOCK):
                for j in range(i, e, BLOCK):
                    a, b = slice(i, min(e, i + BLOCK)), slice(j, min(e, j + BLOCK))
                    ok = passing(n[a, None], left[a, None], n[None, b], left[None, b])
                    if i == j:
                        ok = np.triu(ok, 1)
                    pairs += int(ok.sum())
                    some[i - s : i - s + BLOCK] |= ok.any(1)
                    to = before[j - s : j - s + BLOCK]
                    has = ok.any(0)
                    some[j - s : j - s + BLOCK] |= has
                    new = has & (to < 0)
                    to[new] = ok.argmax(0)[new] + i - s
            if pairs:
                m = np.flatnonzero(some)
                told = np.where(before[m] < 0, m, before[m])
                at.append(m + s)
                first.append(told + s)
                more.append(np.full(len(m), pairs > int((told != m).sum())))
        i, j = np.concatenate(at), np.concatenate(first)
        if len(i):
            yield {c: rows[c][i] for c in ("k", "node", "n", "pos")} | {"other": nodes[j], "more": np.concatenate(more)}


def together(batches: Iterable[dict[str, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
    """Of each cell a spanning forest of the pairs that pass and that the slots do not discard: fewer rows than texts."""
    for rows, starts in whole_cells(batches):
        n, left, nodes, told = rows["n"], rows["n"] - rows["pos"], rows["node"], rows["slots"]
        width = np.array([2 * len(x) for x in told])
        # sets that pass have as many slots as each other, or one has twice as many
        counts, place = {}, np.zeros((2, len(n)), dtype=int)
        for w in set(width.tolist()):
            some = [np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)]
            place[0][some[0]] = np.arange(len(some[0]))
            place[1][some[1]] = np.arange(len(some[1])) + len(some[0])
            counts[w] = np.concatenate([counted(b"".join(told[x]), len(x), w) for x in some])

        def may(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            least, out = np.minimum(width[u], width[v]), np.zeros(len(u), dtype=bool)
            for w in set(least.tolist()):
                p = np.flatnonzero(least == w)
                a, b = (place[(width[x[p]] > w).astype(int), x[p]] for x in (u, v))
                for c in range(0, len(p), step := max(1, PAIRS * BUCKETS // w)):
                    q = p[c : c + step]
                    out[q] = 9 * differing(counts[w][a[c : c + step]], counts[w][b[c : c + step]]) <= n[u[q]] + n[v[q]]
            return out

        size = np.diff(starts)
        at, to = np.empty(0, dtype=int), np.empty(0, dtype=int)
        for m in set(size[size <= SMALL].tolist()):
            x, y = ((starts[:-1][size == m][:, None] + i).ravel() for i in np.triu_indices(m, 1))
            ok = passing(n[x], left[x], n[y], left[y])
            x, y = x[ok], y[ok]
            ok = may(x, y)
            at, to = np.r_[at, x[ok]], np.r_[to, y[ok]]
        if len(at):
            at, to = simhash.forest(len(n), at, to)
            yield {"a": nodes[at], "b": nodes[to]}
        for s, e in zip(starts[:-1][size > SMALL].tolist(), starts[1:][size > SMALL].tolist()):
            label, at, to = np.arange(e - s), np.empty(0, dtype=int), np.empty(0, dtype=int)
            for i in range(s, e, BLOCK):
                for j in range(i, e, BLOCK):
                    a, b = slice(i, min(e, i + BLOCK)), slice(j, min(e, j + BLOCK))
                    ok = passing(n[a, None], left[a, None], n[None, b], left[None, b]) & (label[i - s : i - s + BLOCK, None] != label[None, j - s : j - s + BLOCK])
                    x, y = np.nonzero(np.triu(ok, 1) if i == j else ok)
                    for c in range(0, len(x), PAIRS):
                        u, v = x[c : c + PAIRS] + i - s, y[c : c + PAIRS] + j - s
                        apart = label[u] != label[v]
                        u, v = u[apart], v[apart]
                        ok = may(s + u, s + v)
                        if ok.any():
                            at, to = simhash.forest(e - s, np.r_[at, u[ok]], np.r_[to, v[ok]])
                            label = np.arange(e - s)
                            label[at] = to
            if len(at):
                yield {"a": nodes[s + at], "b": nodes[s + to]}


def among(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of df whose node is in wanted, and a few others: a bitmap of fixed size tells, so df is not moved."""
    place = F.pmod("node", F.lit(BITS))
    maps = wanted.select(F.bitmap_bucket_number(place).alias("__at"), F.bitmap_bit_position(place).alias("bit")).groupBy("__at").agg(F.bitmap_construct_agg("bit").alias("__bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = df.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("__at"))
    return held.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*df.columns)


def frequent_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that are most frequent in a sample, and their counts there."""

    def run(batches: Iterable[Columns]) -> Iterator[Columns]:
        for b in batches:
            for t in b["text"]:
                yield {"k": shingles(t).view(np.int64)}

    part = docs.sample(min(1.0, SAMPLE / max(1, docs.count())), seed=SEED).select(lowered(text_col).alias("text"))
    told = arrow_rows(part, run, "k bigint").groupBy("k").count().where("count > 1").orderBy(F.desc("count"), "k").limit(FREQUENT).collect()
    found = np.array([r["k"] for r in told], dtype=np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r["count"] for r in told], dtype=np.int64)[order]


def likely(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """The pairs (a, b) that the slots do not discard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            stay = []
            for n_a, n_b, x, y in zip(*(b.column(at[c]).to_pylist() for c in ("a_n", "b_n", "a_slots", "b_slots"))):
                width = 2 * min(len(x), len(y))
                stay.append(bool(9 * differing(counted(x, 1, width), counted(y, 1, width))[0] <= n_a + n_b))
            yield b.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    def side(end: str) -> DataFrame:
        return counts.select(F.col("node").alias(end), F.col("n").alias(f"{end}_n"), F.col("slots").alias(f"{end}_slots"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "a_n", "b_n", "a_slots", "b_slots").mapInArrow(run, "a bigint, b bigint")


def similar_ones(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs of similar sets."""
    if len(sets) <= 4:
        linked = [(i, j) for j in range(len(sets)) for i in range(j) if similar(sets[i], sets[j])]
        return simhash.forest(len(sets), np.array([i for i, _ in linked], dtype=int), np.array([j for _, j in linked], dtype=int))
    n = np.array([len(x) for x in sets])
    # what sets share in one range of hashes adds to what they share in the others
    parts = -(-int(n.sum()) // RANGE)
    ends = np.arange(1, parts, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // parts)
    cuts = np.array([[0, *np.searchsorted(x, ends), len(x)] for x in sets])
    both = np.zeros((len(sets), len(sets)), dtype=np.int32)
    for lows, highs in zip(cuts.T[:-1], cuts.T[1:]):
        _, at, often = np.unique(np.concatenate([x[lo:hi] for x, lo, hi in zip(sets, lows, highs)]), return_inverse=True, return_counts=True)
        # shingles of one set only are in no intersection; the others are numbered anew
        place = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[at]
        of = np.repeat(np.arange(len(sets)), highs - lows)[place >= 0]
        place = place[place >= 0]
        order = np.argsort(place, kind="stable")
        of, place = of[order], place[order]
        for first in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
            lo, hi = np.searchsorted(place, [first, first + COLUMNS])
            held = np.zeros((len(sets), min(COLUMNS, int(place[hi - 1]) + 1 - first)), dtype=np.float32)
            held[of[lo:hi], place[lo:hi] - first] = 1
            both += (held @ held.T).astype(np.int32)
    return simhash.forest(len(sets), *np.nonzero(np.triu(9 * both.astype(np.int64) >= 4 * (n[:, None] + n[None, :]), 1)))


def blocks(each: DataFrame) -> DataFrame:
    """(group, blocks) of rows (group, n): how many blocks of at most about PART texts and WEIGHT shingles it takes."""
    return each.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART), F.ceil(F.sum("n") / WEIGHT)).cast("int").alias("blocks"))


def linked(edges: DataFrame, signed: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(a, b) nodes, such that the components are those of all similar pairs. Similar nodes are of one component of
    edges; the texts of such a component meet in one task, or, if they are many, each two blocks of them do."""
    groups = connected_components(edges).select(F.col("node").alias("of"), F.col("root").alias("group"))
    # one of the texts that are equal up to case and white space stands for its node
    each = signed.groupBy("node").agg(F.min("raw").alias("raw"), F.max("n").alias("n"))
    each = written(each.join(groups, each["node"] == groups["of"]).select("raw", "node", "group", "n"), "grouped")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            stay = []
            for v in b.column(0).to_pylist():
                stay.append(v not in seen)
                seen.add(v)
            yield b.filter(pa.array(stay, pa.bool_()))

    texts = among(docs.select(raw(text_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), each.select(F.col("raw").alias("node")))
    texts = texts.mapInArrow(once, "node bigint, text string").select(F.col("node").alias("is"), normal("text").alias("text"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = each.join(blocks(each), "group").select("raw", "node", "group", own.alias("own"), other.alias("other")).select("raw", "node", "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = texts.join(dealt, texts["is"] == dealt["raw"]).select("group", "i", "j", "node", "text")

    answer = T.StructType.fromDDL("a bigint, b bigint")
    arrow = to_arrow_schema(answer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}

        def told() -> pa.RecordBatch:
            nodes = np.array(list(held), dtype=np.int64)
            a, b = similar_ones(list(held.values()))
            return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], schema=arrow)

        for rows in batches:
            # the texts leave Arrow one by one
            for k, (g, i, j, v) in enumerate(zip(*(rows.column(c).to_pylist() for c in range(4)))):
                if (g, i, j) != part:
                    if len(held) > 1:
                        yield told()
                    part, held = (g, i, j), {}
                if v not in held:
                    held[v] = shingles(rows.column(4)[k].as_py())
        if len(held) > 1:
            yield told()

    out = written(dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(run, answer), "links")
    dropped(each)
    return out


def roots(docs: DataFrame, text_col: str = "text", closest: bool = False) -> DataFrame:
    """(node, root) of every text: node is the raw() of it, root the same for all of a component."""
    frequent, counts = frequent_shingles(docs, text_col)

    def run(batches: Iterable[Columns]) -> Iterator[Columns]:
        marks = marked(frequent)
        for b in batches:
            found, nodes = [], []
            one = dict(zip(b["raw"], b["text"]))
            for t in one.values():
                words = t.split()
                found.append(of_words(words))
                nodes.append(simhash.signed(xxhash.xxh64_intdigest(b" ".join(words), SEED)))
            yield {
                "raw": list(one),
                "node": nodes,
                "n": [len(f) for f in found],
                "firsts": [keys(first_ones(f, frequent, counts, marks)) for f in found],
                "slots": [slots(f) for f in found],
                "fp": [simhash.signed(simhash.majority(f)) if closest else 0 for f in found],
            }

    signed = arrow_rows(docs.select(raw(text_col).alias("raw"), lowered(text_col).alias("text")), run, "raw bigint, node bigint, n int, firsts binary, slots binary, fp bigint")
    signed = written(signed, "signatures")
    # a stage of its own: two functions in a task take two workers
    shared = written(cells(signed), "cells")
    met = written(by_arrays(shared.repartition("k").sortWithinPartitions("k", "node"), partners, "k bigint, node bigint, n int, pos int, other bigint, more boolean"), "met")
    dropped(shared)
    pairs = met.where("node <> other and not more").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    if closest:
        fps = signed.select("node", "fp").distinct()
        close = connected_components(simhash.links(fps.select("fp").distinct())).select(F.col("node").alias("of"), "root")
        alike = written(fps.join(close, fps["fp"] == close["of"], "left").select("node", F.coalesce("root", "fp").alias("root")), "alike")
        least = alike.groupBy("root").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("size")).where("size > 1").select("root", "b")
        near = alike.join(least, "root").where("node <> b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
        pairs = pairs.unionAll(near)
    pairs = written(pairs.distinct(), "pairs")
    open_cells = met.where("more").select("k", "node", "n", "pos")
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).unionAll(open_cells.select("node"))
    slotted = written(among(signed.select("node", "n", "slots"), wanted).dropDuplicates(["node"]), "slots")
    open_cells = open_cells.join(slotted.select(F.col("node").alias("of"), "slots"), F.col("node") == F.col("of")).select("k", "node", "n", "pos", "slots")
    forests = by_arrays(open_cells.repartition("k").sortWithinPartitions("k", "node"), together, "a bigint, b bigint")
    edges = written(likely(pairs, slotted).unionAll(forests), "candidates")
    found = connected_components(linked(edges, signed, docs, text_col)).select(F.col("node").alias("of"), "root")
    each = signed.select("raw", "node").distinct()
    out = written(each.join(found, each["node"] == found["of"], "left").select(F.col("raw").alias("node"), F.coalesce("root", "node").alias("root")), "near")
    for held in (met, signed, pairs, slotted, edges):
        dropped(held)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; fp is the row's raw()."""
    near = roots(docs, text_col, closest=True)
    each = written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), raw(text_col).alias("fp")), "nodes")
    nodes = each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    joined = nodes.join(near, nodes["fp"] == near["node"]).select("fp", "least", "n", "root")
    joined = written(joined, "joined")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size")).where("size > 1")
    answer = joined.join(least, "root").select(F.col("fp").alias("of"), "component_id", F.lit(True).alias("known"))
    out = each.join(answer, each["fp"] == answer["of"], "left")
    return out.select("doc_id", "fp", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
