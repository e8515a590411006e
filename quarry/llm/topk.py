"""Operator 7, exact top-k search by MaxScore.

A vector's terms are its components; the posting list of a component holds every vector's value there.
Candidates are dealt into shards, each in one task, and queries are copied to every shard and streamed past it
in blocks. A shard's candidates are traversed in chunks. In a chunk, a term's least and greatest value bound
what it can add to a query's score. In the order of that range, the longest run of terms, from the smallest
range on, that can't lift a candidate over the query's threshold (its k-th best score so far) even with all of
their greatest values, while the others are at their least, is non-essential. The other terms are essential: they alone are
traversed for all candidates of the chunk, and the non-essential ones are probed, greatest range first, for those
that still compete. The threshold rises from chunk to chunk, and with it the non-essential set grows; at last it
may hold all terms, and the chunk is passed over. The shards' best rows are then merged by score.

A vector is copied once for each ``SPAN`` queries, which is once in most tables; a task's memory holds a
shard and a block of queries. Scores are whole numbers: doubles hold them exactly below 2**53, beyond that the
same steps take Python's integers.

Odd input: vectors that are null or hold a null or non-finite component, and rows with a null id, take no
part. Shorter vectors count as having zeros. Rows that repeat an id are rows of their own. Equal
scores rank the smaller id first. Fewer candidates than k: all of them. Scores beyond 64 bits are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import common

#: Candidates of a shard: no more than the first, and no fewer than the second only to keep more tasks busy.
SHARD_ROWS, LEAST_ROWS = 32_768, 2_048
CHUNK = 2_048
BLOCK_ROWS = 256
SPAN = 1 << 20
_PROBE = 8


def _matrix(lists: pa.ListArray, least: int = 0) -> np.ndarray:
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    out = np.zeros((len(sizes), max(least, int(sizes.max(initial=0)))), np.int64)
    out[common.spread(at - at[0]), np.arange(at[0], at[-1]) - at[:-1][common.spread(at - at[0])]] = flat[at[0] : at[-1]]
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


def max_score(x: np.ndarray, ids: np.ndarray, own: np.ndarray, q: np.ndarray, k: int, chunk: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, scores) of each query's k best, without the row at own[i] (-1: none); x and q have equal widths."""
    largest = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    kind = np.float64 if largest < 1 << 53 else object
    q, chunk = q.astype(kind), chunk or CHUNK
    best = [(np.zeros(0, np.int64), np.zeros(0, kind)) for _ in q]
    for first in range(0, len(x), chunk):
        part = x[first : first + chunk].astype(kind)
        low, high = part.min(axis=0), part.max(axis=0)
        most, least = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
        ranges = most - least
        order = np.argsort(ranges, axis=1, kind="stable")
        raised = least.sum(axis=1)[:, None] + np.cumsum(np.take_along_axis(ranges, order, 1), axis=1)
        full = np.array([len(r) == k for r, _ in best])
        floors = np.array([s[-1] if f else 0 for f, (_, s) in zip(full, best)], kind)
        split = np.where(full, (raised < floors[:, None]).sum(axis=1), 0)  # terms that are not essential
        asked = np.flatnonzero(split < x.shape[1]) if x.shape[1] else np.arange(len(q))
        essential = np.zeros(q.shape, bool)
        np.put_along_axis(essential, order, np.arange(x.shape[1])[None, :] >= split[:, None], 1)
        sums = part @ np.where(essential, q, 0)[asked].T
        for column, i in enumerate(asked.tolist()):
            others, scores = order[i, : split[i]][::-1], sums[:, column]
            rest = most[i, others].sum()
            held = scores + rest >= floors[i] if full[i] else np.ones(len(part), bool)
            if first <= own[i] < first + len(part):
                held[own[i] - first] = False
            rows = np.flatnonzero(held)
            scores = scores[rows]
            for at in range(0, len(others), _PROBE):
                if not len(rows):
                    break
                now, later = others[at : at + _PROBE], others[at + _PROBE :]
                scores = scores + part[np.ix_(rows, now)] @ q[i, now]
                held = np.flatnonzero(scores + most[i, later].sum() >= floors[i])
                rows, scores = rows[held], scores[held]
            if len(rows):
                rows, scores = np.concatenate([best[i][0], rows + first]), np.concatenate([best[i][1], scores])
                top = _best(scores, ids[rows], k)
                best[i] = rows[top], scores[top]
    return best


def _search(k: int):
    """Streams rows (shard, span, side, vec_id, n, v) in that order: a shard's candidates, then the queries for it."""
    columns, chunk, block = ["query_id", "query_n", "vec_id", "score"], CHUNK, BLOCK_ROWS

    def run(batches):
        group, held, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                ids, ns, vectors = (batch.column(i).slice(a, b - a) for i in (3, 4, 5))
                ids, ns = ids.to_numpy(), ns.to_numpy()
                if (own := tuple(keys[:2, a])) != group:
                    group, held, shard = own, [], None
                if not keys[2, a]:
                    held.append((ids, ns, _matrix(vectors)))
                    continue
                if not held:
                    continue  # a shard without candidates
                if shard is None:
                    width = max(x.shape[1] for _, _, x in held)
                    found = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, _, x in held])
                    shard = tuple(np.concatenate(x) for x in zip(*((i, n) for i, n, _ in held))), found
                    place = {p: i for i, p in enumerate(zip(shard[0][0].tolist(), shard[0][1].tolist()))}
                (all_ids, _), x = shard
                for at in range(0, b - a, block):
                    asked = list(zip(ids[at : at + block].tolist(), ns[at : at + block].tolist()))
                    q = _matrix(vectors.slice(at, block), x.shape[1])
                    wide = np.pad(x, ((0, 0), (0, q.shape[1] - x.shape[1]))) if q.shape[1] > x.shape[1] else x
                    best = max_score(wide, all_ids, np.array([place.get(p, -1) for p in asked]), q, k, chunk)
                    sizes = [len(r) for r, _ in best]
                    yield pa.RecordBatch.from_arrays([
                        *(pa.array(np.repeat([p[i] for p in asked], sizes).astype(np.int64)) for i in (0, 1)),
                        pa.array(all_ids[np.concatenate([r for r, _ in best])]), pa.array([int(s) for _, scores in best for s in scores], pa.int64()),
                    ], names=columns)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from vectors and queries of (vec_id, n, v): v integer components;
    a query leaves out the row with its own (vec_id, n)."""
    spark = vectors.sparkSession
    common.bounded_arrow(spark)
    rows = vectors.count()
    shards = max(1, -(-rows // SHARD_ROWS), min(common.partitions(spark), rows // LEAST_ROWS))
    spans = max(1, -(-queries.count() // SPAN))
    part = lambda n, seed: F.pmod(F.xxhash64("vec_id", "n", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["shard", "span", "side", "vec_id", "n", "v"]
    left = vectors.withColumns({"shard": part(shards, 1), "side": F.lit(0)}).withColumn("span", every(spans)).select(*columns)
    right = queries.withColumns({"span": part(spans, 2), "side": F.lit(1)}).withColumn("shard", every(shards)).select(*columns)
    dealt = left.unionByName(right).repartition(min(shards * spans, 16 * common.partitions(spark)), "shard", "span").sortWithinPartitions("shard", "span", "side")
    found = dealt.mapInArrow(common.lean(_search(k)), "query_id long, query_n long, vec_id long, score long")
    window = Window.partitionBy("query_id", "query_n").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 20 best of all other rows, for the rows whose vec_id is divisible by 20."""
    table = common.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    whole = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    number = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.xxhash64("v"))).cast("long")
    vectors = table.where(whole).select("vec_id", F.transform("e", lambda x: F.floor(x * 64).cast("long")).alias("v")).withColumn("n", number)
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
