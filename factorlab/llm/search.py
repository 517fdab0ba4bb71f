"""Exact top-k inner products in three phases with a uniform threshold.

Vectors are integers; a shorter one counts as filled up with zeros. Shards of vectors meet blocks of
queries in cells, each a small dense product.

1. Every cell scores by the leading components only, takes each query's local best by
   that partial score and sends their exact scores. The k-th best of all those is a cutoff
   that the true k-th score can't be below.
2. The cutoff goes back to the cells. An entry whose partial score plus the largest
   possible remainder (Cauchy-Schwarz) stays under it is dropped, whichever shard holds it.
3. The scores of the entries left are resolved exactly and merged; ties to the smaller id.

No cell sends more than k rows a query, however many entries tie.

A vector that is null or empty, or that holds a null or non-finite component, takes no part. Products
are exact: floats while every sum stays under 2**53, then 64-bit integers, then integers of any size.
Components and scores beyond 64 bits are taken as the end of that range. A row without vec_id takes no part;
rows that share a vec_id are never each other's candidates, and as queries they are ranked together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorlab.llm.common import by_value, written

by_value(__name__)

SCALE = 64
LEAD = 24
SHARD = 8_192
BLOCK = 2_048
END = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of finite vectors."""
    e = F.col("embedding")
    fine = F.coalesce(F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    v = vectors.filter(e.isNotNull() & F.col("vec_id").isNotNull() & fine & (F.size(e) > 0))
    return v.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _lengths(column: pa.ChunkedArray) -> np.ndarray:
    return pc.list_value_length(column).to_numpy().astype(np.int64)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of `width` components: shorter vectors filled up with zeros, longer ones cut."""
    lengths, values = _lengths(column), pc.list_flatten(column).to_numpy().astype(np.int64)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row[at < width], at[at < width]] = values[at < width]
    return out


def _exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in the smallest type whose products are exact."""
    most = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (q, x)]
    bound = most[0] * most[1] * q.shape[1]
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
    return q.astype(kind), x.astype(kind)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id; `ids` ascend."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > cut)
        keep = np.concatenate((above, np.flatnonzero(score == cut)[: k - len(above)]))
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))]


def _cells(vectors: DataFrame, queries: DataFrame, shards: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt over a grid of (block, shard) cells by equality keys."""
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int")
    # Own column names: both sides come from one table.
    left = queries.select(block.alias("_qb"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_qs"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("cutoff").alias("cut"))
    right = vectors.withColumn("_s", shard).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left, right


def top_k(vectors: DataFrame, is_query: Column, k: int, lead: int = LEAD, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every query but itself."""
    data = written(vectors, "vectors")
    queries = data.filter(is_query)
    n, m = data.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def scored(left: pa.Table, right: pa.Table, first: bool) -> pa.Table:
        order = np.argsort(right["vec_id"].to_numpy(), kind="stable")
        ids, qs = right["vec_id"].to_numpy()[order], left["query_id"].to_numpy()
        cut = None if first else left["cut"].to_numpy(zero_copy_only=False)
        got = ([], [], [])
        if len(qs) and len(ids):
            # Components that only one side has meet zeros.
            width = int(min(_lengths(left["q"]).max(), _lengths(right["v"]).max()))
            q, x = _exact(_matrix(left["q"], width), _matrix(right["v"], width)[order])
            rest_x = np.sqrt((x[:, lead:].astype(np.float64) ** 2).sum(axis=1))
            for at in range(0, len(qs), 256):
                part = (q[at : at + 256, :lead] @ x[:, :lead].T).astype(np.float64)
                for i, row in enumerate(part, start=at):
                    own = ids != qs[i]
                    if first:
                        near = np.flatnonzero(own)
                        near = np.sort(near[_best(row[near], ids[near], k)])
                    else:
                        rest = np.sqrt((q[i, lead:].astype(np.float64) ** 2).sum())
                        # More than the bound, against rounding of roots and of large sums.
                        reach = row + rest * rest_x * (1 + 1e-9) + 1 + np.abs(row) * 1e-12
                        low = cut[i] - abs(cut[i]) * 1e-12
                        near = np.flatnonzero(own if np.isnan(cut[i]) else own & (np.maximum(reach, -END) >= low))
                    score = np.clip(x[near] @ q[i], -END, END).astype(np.int64)
                    keep = _best(score, ids[near], k)
                    got[0].append(np.full(len(keep), qs[i]))
                    got[1].append(ids[near][keep])
                    got[2].append(score[keep])
        return pa.table([np.concatenate(g).astype(np.int64) if g else pa.array([], pa.int64()) for g in got], schema=out)

    ddl = "query_id long, vec_id long, score long"
    left, right = _cells(data, queries.withColumn("cutoff", F.lit(None).cast("double")), shards, blocks)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    local = left.groupBy("_qb", "_qs").cogroup(right.groupBy("_b", "_s")).applyInArrow(lambda a, b: scored(a, b, True), ddl)
    ranked = local.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == k)
    cutoff = written(ranked.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("cutoff")), "cutoff")
    left, right = _cells(data, queries.join(cutoff, "vec_id", "left"), shards, blocks)
    found = left.groupBy("_qb", "_qs").cogroup(right.groupBy("_b", "_s")).applyInArrow(lambda a, b: scored(a, b, False), ddl)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
