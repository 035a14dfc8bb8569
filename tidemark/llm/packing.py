"""Conflict-constrained best-fit packing.

Documents are cut into pieces of at most ``capacity`` words and packed into bins. Pieces conflict if they
come from one source or from one duplicate cluster (another document of it), so a bin carries a bitmap of
its sources and one of its clusters. Pieces go in by falling size; the bins are kept ordered by residual,
and from the tightest that holds the piece the search moves to successors until the bitmaps allow it.

Pieces are dealt by hash into groups of about GROUP pieces, each packed on its own: a group is a bounded
task at any input size, hot sources and clusters spread over all groups, and the loss is at most the
tails of each group's bins. Packing shuffles nothing but ids, sizes and keys, and the pieces'
texts where they are asked for. The duplicate clusters are
the components of near copies (near_copies.py), exact copies among them.

Defined results: a null or blank text is one piece of size 0; a null source or cluster conflicts with
nothing; pieces of one document are of one source, so they never share a bin; equal sizes go in by id and
piece; repeated rows are packed once each (they share a cluster); extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import near_copies

CAPACITY, GROUP = 2048, 2000
#: Bytes whose words are counted at once.
AT_ONCE = 1 << 22
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
PACKED = "bin_id string, position int, doc_id bigint, piece int, first_word bigint, n_words bigint, bin_words bigint"


def best_fit(pieces: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """Bin number of each (size, source, cluster), given in packing order. None conflicts with nothing."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(p[1] for p in pieces if p[1] is not None))}
    # a cluster that comes once in the group can meet no other of its kind
    clusters = Counter(p[2] for p in pieces if p[2] is not None)
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in clusters.items() if n > 1)}
    bins: list[tuple[int, int]] = []  # (residual, bin), ordered
    sources: list[int] = []
    kinds: list[int] = []
    out = []
    for size, source, cluster in pieces:
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        i = bisect_left(bins, (size, -1))
        while i < len(bins) and (sources[bins[i][1]] & s or kinds[bins[i][1]] & c):
            i += 1
        if i == len(bins):
            b, residual = len(sources), capacity
            sources.append(0)
            kinds.append(0)
        else:
            residual, b = bins.pop(i)
        sources[b] |= s
        kinds[b] |= c
        insort(bins, (residual - size, b))
        out.append(b)
    return out


def counted_words(texts: pa.Array) -> np.ndarray:
    """Numbers of words of texts without nulls (white space is Java's: ASCII), some MB after the other."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out, start = np.zeros(len(texts), dtype=np.int64), 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + AT_ONCE, side="right")) - 1)
        at = ends[start : stop + 1] - ends[start]
        space = SPACE[data[ends[start] : ends[stop]]]
        first = ~space
        first[1:] &= space[:-1]
        own = at[:-1][at[1:] > at[:-1]]
        first[own] = ~space[own]
        out[start:stop] = np.diff(np.searchsorted(np.flatnonzero(first), at))
        start = stop
    return out


def with_words(df: DataFrame) -> DataFrame:
    """The texts in the column words become their numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("words")
            yield b.set_column(i, "words", pa.array(counted_words(b.column(i))))

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, T.LongType() if f.name == "words" else f.dataType) for f in df.schema]))


def pack(docs: DataFrame, source: Column, cluster: Column, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP, roots: DataFrame | None = None, with_text: bool = False) -> DataFrame:
    """PACKED rows, one for each piece. roots (node, root) maps clusters to larger ones; with_text adds each
    piece's own text as the column text, and a document's pieces joined are its text."""
    text = [F.col(text_col).alias("text")] if with_text else []
    held = ["text"] if with_text else []
    sized = with_words(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("words"), source.cast("string").alias("source"), cluster.alias("cluster"), *text))
    if roots is not None:
        sized = sized.join(roots, sized["cluster"] == roots["node"], "left").select("doc_id", "words", "source", F.coalesce("root", "cluster").alias("cluster"), *held)
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("words") / capacity)).cast("int")
    pieces = sized.select("*", F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("first_word"), F.least(F.lit(capacity).cast("bigint"), F.col("words") - F.col("piece").cast("bigint") * capacity).alias("n_words"), "source", "cluster", "words", *held
    )
    if with_text:
        each = F.regexp_extract_all("text", F.lit(r"(\s*\S+\s*)"), F.lit(1))
        part = F.array_join(F.slice(each, F.col("first_word").cast("int") + 1, F.col("n_words").cast("int")), "")
        pieces = pieces.withColumn("text", F.when(F.col("words") > capacity, part).otherwise(F.col("text")))
    pieces = pieces.drop("words")
    # sizes follow the rows: the pieces are at most the rows and the words that fill whole bins
    total = docs.select(F.ceil(F.length(text_col) / (6 * capacity)).alias("n")).agg(F.sum(F.greatest(F.lit(1), F.coalesce("n", F.lit(1))))).first()[0] or 0
    groups = max(1, -(-total // group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))

    packed = PACKED + (", text string" if with_text else "")
    arrow = to_arrow_schema(T.StructType.fromDDL(packed))

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["n_words"], r["doc_id"] is None, r["doc_id"] or 0, r["piece"]))
        put = best_fit([(r["n_words"], r["source"], r["cluster"]) for r in rows], capacity)
        used, filled = Counter(), Counter()
        for b, r in zip(put, rows):
            r["bin_id"], r["position"] = f"{r['group']}-{b}", used[b]
            used[b] += 1
            filled[b] += r["n_words"]
        for b, r in zip(put, rows):
            r["bin_words"] = filled[b]
        return pa.Table.from_pylist([{n: r[n] for n in arrow.names} for r in rows], schema=arrow)

    return dealt.groupBy("group").applyInArrow(run, packed)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Clusters are the components of near copies; a text without words is in none."""
    cluster = F.when(F.col("text").rlike(r"\S"), near_copies.raw("text"))
    return pack(docs, F.col("source"), cluster, roots=near_copies.roots(docs), **options)


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
