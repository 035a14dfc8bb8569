"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64-bit majority votes over XXH64 of word shingles. Their Hamming distances to PIVOTS
reference fingerprints make the pivot table: by the triangle inequality two fingerprints within MOST bits
differ by at most MOST in every coordinate, so a pair whose largest coordinate difference is greater is
discarded, and what is left is verified.

The table also deals the fingerprints out. A few coordinates, those that spread these fingerprints most, are
cut into slabs of WIDTH distances; a fingerprint goes to its own slab and, if it stands within MOST of the
slab's lower end, to the one below, so that two linked ones share a slab in every coordinate, hence a cell.
A task cuts its cells further, coordinate by coordinate in the same way, until a part is small (LEAF) or the
references are used up, and then compares the part in blocks. One coordinate is taken for every factor FACTOR that
the fingerprints are more than FEW, and brings about 1.7 rows a row, so the rows dealt (16 bytes each) grow as
n to the power 1.2. That is what pivots can give: the distances of unlike fingerprints stand close to 32, so
a coordinate tells little.

Of a part only a spanning forest of its links leaves the task, so a large group of near copies costs
comparisons, not rows.

Defined results: a null text has no words; a text without words has fingerprint zero and is linked like
any other; fewer words than a shingle make one shingle of all; equal fingerprints link; rows without an id take
part, and a component's id is its smallest non-null id (null if it has none); repeated rows are answered
once each; extra columns are ignored; an empty table gives an empty answer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Columns, arrow_rows, written
from .components import connected_components

SHINGLE, BITS, MOST = 3, 64, 2
SEED = 42
#: Distances in a slab, and coordinates in the pivot table.
WIDTH, PIVOTS = 3, 24
#: Fingerprints of a part that are compared without a further cut, and rows and columns of a block of comparisons.
LEAF, BLOCK = 256, 1024
#: Largest share of a part that one cut may leave together.
SHARE = 0.6
#: There is one coordinate for every factor FACTOR that the fingerprints are more than FEW.
FEW, FACTOR = 500, 12
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: References of the pivot table: odd multiples of the golden ratio's 64-bit fraction.
REFERENCES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) for i in range(PIVOTS)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the 64-bit hashes."""
    votes = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 14):
        part = hashes[a : a + (1 << 14)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return h(b" ".join(words), SEED)
    return majority(np.fromiter((h(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])), dtype="<u8", count=len(words) - 2))


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number."""

    def run(batches: Iterable[Columns]) -> Iterator[Columns]:
        for b in batches:
            ids, texts = b.values()
            yield {"doc_id": ids, "fp": [signed(fingerprint(t)) for t in texts]}

    return arrow_rows(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")), run, "doc_id bigint, fp bigint")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, root) that join what the edges a, b join, by least labels."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (again := root[root]).tolist() != root.tolist():
            root = again
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def compared(fps: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links of one part: the largest coordinate difference discards, popcount verifies.
    The coordinates are taken one after the other, each on the pairs that are left."""
    held_a: list[np.ndarray] = []
    held_b: list[np.ndarray] = []
    for i in range(0, len(fps), BLOCK):
        for j in range(i, len(fps), BLOCK):
            t, u = table[i : i + BLOCK], table[j : j + BLOCK]
            near = (np.abs(t[:, None, 0] - u[None, :, 0]) <= most) & (np.abs(t[:, None, 1] - u[None, :, 1]) <= most)
            a, b = np.nonzero(np.triu(near, 1) if i == j else near)
            for k in range(2, table.shape[1]):
                if not len(a):
                    break
                stay = np.abs(t[a, k] - u[b, k]) <= most
                a, b = a[stay], b[stay]
            if len(a):
                stay = np.bitwise_count(fps[i : i + BLOCK][a] ^ fps[j : j + BLOCK][b]) <= most
                a, b = forest(len(fps), a[stay] + i, b[stay] + j)
                held_a.append(a)
                held_b.append(b)
    if not held_a:
        return np.empty(0, dtype=int), np.empty(0, dtype=int)
    return forest(len(fps), np.concatenate(held_a), np.concatenate(held_b))


def cell_links(fps: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """(a, b) of distinct fingerprints: a spanning forest of the links within most bits."""
    table = np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    width, left, right = most + 1, [], []
    todo = [(np.arange(len(fps)), 0)]
    while todo:
        at, k = todo.pop()
        if len(at) < 2:
            continue
        if len(at) <= LEAF or k == PIVOTS:
            a, b = compared(fps[at], table[at], most)
            left.append(at[a])
            right.append(at[b])
            continue
        d = table[at, k]
        slab, below = d // width, d % width < most
        parts = [at[(slab == s) | (slab == s + 1) & below] for s in range(int(slab.min()) - 1, int(slab.max()) + 1)]
        # near copies stand alike in a coordinate; a cut that parts few of them is not worth its overlap
        todo += [(p, k + 1) for p in parts] if max(map(len, parts)) <= SHARE * len(at) else [(at, k + 1)]
    if not left:
        return []
    a, b = forest(len(fps), np.concatenate(left), np.concatenate(right))
    return list(zip(fps[a].tolist(), fps[b].tolist()))


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b) fingerprints such that the links' components are those of all pairs within most bits. fps: distinct."""
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(int(p))))) for p in REFERENCES]
    told = fps.select(*(d.alias(f"d{i}") for i, d in enumerate(distance))).agg(F.count(F.lit(1)).alias("n"), *(F.var_pop(f"d{i}").alias(f"v{i}") for i in range(PIVOTS))).first()
    n = max(1, told["n"])
    best = sorted(range(PIVOTS), key=lambda i: (-(told[f"v{i}"] or 0.0), i))[: max(1, min(PIVOTS, round(math.log(max(1, n / FEW), FACTOR))))]
    width = most + 1
    dealt = fps.select("fp")
    for i in best:
        slab = F.floor(distance[i] / width).cast("int")
        dealt = dealt.withColumn(f"c{i}", F.explode(F.when(distance[i] % width < most, F.array(slab, slab - 1)).otherwise(F.array(slab))))
    keyed = dealt.select("fp", F.xxhash64(*(f"c{i}" for i in best)).alias("cell"))

    def run(batches: Iterable[Columns]) -> Iterator[Columns]:
        cell, held = None, []

        def told(rows: list[int]) -> list[tuple[int, int]]:
            return cell_links(np.array(rows, dtype=np.int64).view(np.uint64), most) if len(rows) > 1 else []

        for b in batches:
            out: list[tuple[int, int]] = []
            for c, fp in zip(b["cell"], b["fp"]):
                if c != cell:
                    out += told(held)
                    cell, held = c, []
                held.append(fp)
            if out:
                yield {"a": [signed(x) for x, _ in out], "b": [signed(y) for _, y in out]}
        if out := told(held):
            yield {"a": [signed(x) for x, _ in out], "b": [signed(y) for _, y in out]}

    sorted_cells = keyed.repartition("cell").sortWithinPartitions("cell").select("cell", "fp")
    return arrow_rows(sorted_cells, run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    each = written(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    fps = written(fps, "distinct")
    roots = connected_components(links(fps.select("fp")))
    joined = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size")).where("size > 1")
    answer = joined.join(least, "root").select(F.col("fp").alias("of"), "component_id", F.lit(True).alias("known"))
    # a row that is alone answers with its own id, so only fingerprints with company are joined
    out = each.join(answer, each["fp"] == answer["of"], "left")
    return out.select("doc_id", "fp", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """Rows of docs that stay: one of each component that find tells, that with its id. Rows without an id are kept."""
    found = written(find(docs, id_col, text_col), "components")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
    repeated = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    named = kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return named.unionAll(kept.where(F.col(id_col).isNull()))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
