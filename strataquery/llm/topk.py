"""Exact top-k inner-product search.

Method: rows are dealt into shards and queries into blocks; each (block, shard) tile is one matrix
product that keeps only every query's k best of the shard; the lists are merged in a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

QUERY_EVERY = 50
K = 5
SCALE = 256
#: Rows of a shard, bytes of a block of queries (the larger, the less often the rows travel), and lists merged at one level
#: of the tree.
SHARD_ROWS, BLOCK_BYTES, FAN_IN = 16384, 64 << 20, 16
MIN_SHARDS = 48
#: Rows of a product that are held at once.
STEP = 512
_EXACT = float(2**53)
_LONG = 2**63 - 1


def quantize(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as long (saturating beyond long); null if the vector takes no part."""
    as_double = vector.cast("array<double>")
    sound = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(as_double, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0), np.int64)


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating-point BLAS while every partial sum is below 2**53, else in whole numbers."""
    width = max(queries.shape[1], 1)
    top = max(1.0, float(np.abs(queries.astype(np.float64)).max(initial=0))) * max(1.0, float(np.abs(rows.astype(np.float64)).max(initial=0))) * width
    if top < _EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if top < float(2**62):
        return queries @ rows.T
    exact = queries.astype(object) @ rows.astype(object).T
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score desc, id asc); all that tie with the k-th are looked at."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bar)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], ~scores[near]))][:k]


def _tile(k: int):
    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        qno, own, vec, score = [], [], [], []
        if len(queries) and len(rows):
            q, r = _matrix(queries["vec"]), _matrix(rows["vec"])
            q_no = queries["qno"].to_numpy()
            q_id, ids = queries["id"].to_numpy(), rows["id"].to_numpy()
            for at in range(0, len(q), STEP):
                products = _products(q[at : at + STEP], r)
                for i, line in enumerate(products):
                    mine = np.flatnonzero(ids != q_id[at + i])
                    best = mine[_best(line[mine], ids[mine], k)]
                    qno.append(np.full(len(best), q_no[at + i]))
                    own.append(np.full(len(best), q_id[at + i]))
                    vec.append(ids[best])
                    score.append(line[best])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({
            "qno": pa.array(join(qno), pa.int64()), "query_id": pa.array(join(own), pa.int64()),
            "shard": pa.array(np.full(sum(map(len, qno)), key[1].as_py()), pa.int64()),
            "vec_id": pa.array(join(vec), pa.int64()), "score": pa.array(join(score), pa.int64()),
        })

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of every query row's k best other rows.

    Rows whose id is null, whose vector is null, or holds a null, NaN or infinite component take no part. A query's
    candidates are the rows of another id and of the same number of components; rows that repeat an id stay rows of
    their own. A repeated query row gets one list per row, numbered alike. An empty table gives an empty result.
    """
    ready = vectors.select(F.col(id_col).cast("long").alias("id"), quantize(F.col(vec_col), scale).alias("vec"), is_query.alias("asks")).where("id is not null and vec is not null")
    n, asked, width = ready.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("vec"))).first()
    block_rows = max(1024, BLOCK_BYTES // (8 * max(1, width or 1)))
    shards, blocks = max(MIN_SHARDS, -(-n // SHARD_ROWS)), max(1, -(-asked // block_rows))
    dims = ready.withColumn("dim", F.size("vec"))
    queries = (
        dims.where("asks").withColumn("qno", F.monotonically_increasing_id())
        .withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id", "qno"), F.lit(blocks)))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        .select("block", "shard", "dim", "qno", "id", "vec")
    )
    rows = (
        dims.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "id", "vec"), F.lit(shards)))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        .select("block", "shard", "dim", "id", "vec")
    )
    tiles = queries.groupBy("block", "shard", "dim").cogroup(rows.groupBy("block", "shard", "dim"))
    found = tiles.applyInArrow(_tile(k), "qno long, query_id long, shard long, vec_id long, score long")
    lists = found.groupBy("qno", "query_id", "shard").agg(_sorted_top(F.collect_list(F.struct(F.bitwise_not("score").alias("low_first"), "vec_id", "score")), k).alias("best"))
    while shards > 1:
        lists = (
            lists.withColumn("shard", F.expr(f"shard div {FAN_IN}"))
            .groupBy("qno", "query_id", "shard")
            .agg(_sorted_top(F.flatten(F.collect_list("best")), k).alias("best"))
        )
        shards = -(-shards // FAN_IN)
    return lists.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )


def _sorted_top(entries: Column, k: int) -> Column:
    return F.slice(F.array_sort(entries), 1, k)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


OP1_SQL = f"""
with ready as (
  select vec_id, list_transform(embedding, lambda x: floor(cast(x as double) * {SCALE})) as vec
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) as bigint) as score
  from ready q join ready c on q.vec_id <> c.vec_id and len(q.vec) = len(c.vec)
  where q.vec_id % {QUERY_EVERY} = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored
)
select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= {K}
"""
