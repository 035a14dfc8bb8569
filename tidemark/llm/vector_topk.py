"""Exact top-k inner-product search by tiled matrix products.

Vectors are scaled to whole numbers and packed into blocks of rows. The blocks are dealt into cells of at most
CELL_BLOCKS blocks; every block of the stated query set is copied to every cell and meets its blocks by a
merge join, which spills and broadcasts nothing. There are as many cells as there are shuffle partitions, or
more where a cell would pass CELL_BLOCKS, so the copies of the queries stay few. A task multiplies two blocks as a tile, takes each query's best of a tile by
partial selection, merges the lists of its tiles, and the lists of all tasks are merged per query by a
rank filter that also runs before the shuffle.

Defined results: vectors that are null, hold nulls or non-finite components (also after scaling) take no
part; only vectors of one length meet; ties go to the smaller id; exact repeats of a row count once, and
differing rows of one id are separate queries and candidates but never meet their own id; rows without id
take no part; scores beyond 64 bits saturate in the output but are compared exactly within a tile.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Columns, arrow_rows, written

SCALE, K, EVERY = 1024, 10, 100
#: Numbers in a block (2 MB), and most blocks in a cell (2 GB).
BLOCK, CELL_BLOCKS = 1 << 18, 1024
EXACT = float(1 << 53)


def blocks(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(block, dim, n, ids, keys, data, top): whole-number vectors as float64 blocks. keys tell rows of one id apart."""

    def pack(batches: Iterable[Columns]) -> Iterator[Columns]:
        held: dict[int, list[tuple[int, int, list[float]]]] = {}

        def block(dim: int) -> Columns:
            rows = held.pop(dim)
            data = np.array([r[2] for r in rows], dtype="<f8").reshape(len(rows), dim)
            top = float(np.abs(data).max()) if data.size else 0.0
            ids = np.array([r[0] for r in rows], dtype="<i8").tobytes()
            return {"dim": [dim], "n": [len(rows)], "ids": [ids], "keys": [np.array([r[1] for r in rows], dtype="<i8").tobytes()], "data": [data.tobytes()], "top": [top]}

        for b in batches:
            for i, key, vec in zip(b["id"], b["key"], b["vec"]):
                if any(v is None for v in vec):
                    continue
                with np.errstate(all="ignore"):
                    whole = np.floor(np.asarray(vec, dtype="<f8") * scale)
                if not np.isfinite(whole).all():
                    continue
                rows = held.setdefault(len(vec), [])
                rows.append((i, key, whole))
                if len(rows) * max(1, len(vec)) >= BLOCK or len(rows) >= 8192:
                    yield block(len(vec))
        for dim in list(held):
            yield block(dim)

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(vec_col).alias("key"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
    return arrow_rows(rows, pack, "dim int, n int, ids binary, keys binary, data binary, top double")


def _best(k: int, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties to the smaller id; repeats of (query, id, score) count once."""
    order = np.lexsort((ids, -score, query)) if score.dtype != object else np.array(sorted(range(len(score)), key=lambda i: (query[i], -score[i], ids[i])), dtype=int)
    query, ids, score = query[order], ids[order], score[order]
    if not len(query):
        return query, ids, score
    first = np.r_[True, query[1:] != query[:-1]]
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    take = rank < k
    return query[take], ids[take], score[take]


def tile_best(q_ids, q_data, c_ids, c_data, bound: float, k: int):
    """Each query's k best of one tile: partial selection of the k-th score, then all that reach it."""
    outs, step = [], max(1, (1 << 21) // max(1, len(c_ids)))
    for a in range(0, len(q_ids), step):
        part = q_data[a : a + step]
        if bound < EXACT:
            score = part @ c_data.T
            least = -np.inf
        else:
            whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape)
            score, least = whole(part).dot(whole(c_data).T), None
        own = q_ids[a : a + step, None] == c_ids[None, :]
        if least is not None:
            score[own] = least
            n = score.shape[1]
            cut = np.partition(score, n - k, axis=1)[:, n - k : n - k + 1] if n > k else np.full((len(part), 1), -np.inf)
            qi, ci = np.nonzero((score >= cut) & ~own)
            outs.append(_best(k, qi + a, c_ids[ci], score[qi, ci].astype(np.int64)))
        else:
            qi, ci = np.nonzero(~own)
            outs.append(_best(k, qi + a, c_ids[ci], score[qi, ci]))
    if not outs:
        return np.empty(0, int), np.empty(0, int), np.empty(0, int)
    return tuple(np.concatenate([o[i] for o in outs]) for i in range(3))


def top_k(df: DataFrame, id_col: str, vec_col: str, query_filter, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row that passes query_filter."""
    spark = df.sparkSession
    base = df.select(F.col(id_col), F.col(vec_col)).where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    # repeats go by one shuffle of the vectors; shards and queries are then read from its result
    base = written(base.groupBy(id_col, vec_col).agg(F.lit(1).alias("__one")).drop("__one"), "vectors")
    numbers = base.agg(F.sum(F.greatest(F.lit(1), F.size(vec_col))).cast("bigint")).first()[0] or 0
    n_blocks = -(-numbers // BLOCK)
    groups = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks), -(-n_blocks // CELL_BLOCKS))
    shard = blocks(base, id_col, vec_col, scale).withColumn("cell", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    asked = blocks(base.where(query_filter), id_col, vec_col, scale)
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in asked.columns)).withColumn("q_cell", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
    met = shard.hint("merge").join(asked, (F.col("cell") == F.col("q_cell")) & (F.col("dim") == F.col("q_dim"))).select("dim", "n", "ids", "data", "top", "q_n", "q_ids", "q_keys", "q_data", "q_top")

    def multiply(batches: Iterable[Columns]) -> Iterator[Columns]:
        lists: dict[bytes, tuple] = {}

        def told(block: bytes, keys: np.ndarray) -> Columns:
            q, ids, score = lists.pop(block)[:3]
            q_ids = np.frombuffer(block[16:], dtype="<i8")
            return {"query_id": q_ids[q].tolist(), "query_key": keys[q].tolist(), "vec_id": ids.tolist(), "score": [min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in score]}

        for b in batches:
            for dim, n, ids, data, top, qn, q_ids, q_keys, q_data, q_top in zip(*b.values()):
                c_ids, qi = np.frombuffer(ids, dtype="<i8"), np.frombuffer(q_ids, dtype="<i8")
                found = tile_best(qi, np.frombuffer(q_data, dtype="<f8").reshape(qn, dim), c_ids, np.frombuffer(data, dtype="<f8").reshape(n, dim), top * q_top * max(1, dim), k)
                name = dim.to_bytes(8, "little") + hash(q_keys).to_bytes(8, "little", signed=True) + q_ids
                if name in lists:
                    found = _best(k, *(np.concatenate([np.asarray(a, dtype=object) if o.dtype == object or a.dtype == object else a, o]) for a, o in zip(lists[name][:3], found)))
                lists[name] = (*found, np.frombuffer(q_keys, dtype="<i8"))
                if len(lists) > 64:
                    old = next(iter(lists))
                    yield told(old, lists[old][3])
        for name in list(lists):
            yield told(name, lists[name][3])

    found = arrow_rows(met, multiply, "query_id bigint, query_key bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(df, "vec_id", "embedding", F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0)


OP3_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
