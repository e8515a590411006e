"""Batch retrieval: a table of questions in, (qid, rank from 1, chunk_id, score) out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import ranking, text
from quarry.operators import lexical, tokens
from quarry.operators.lexical import MOST_BROADCAST, LexicalIndex, bounded

# Results by default, and how many more candidates a fused search takes from each side.
DEFAULT_K = 10
WIDER, LEAST_CANDIDATES = 4, 10
# End of the fixed values.

#: Query vectors, and embeddings, that one task holds.
QUERY_BLOCK, SHARD = 2_000, 8_192


def checked_k(k: int) -> int:
    if k <= 0:
        raise ValueError(f"k must be positive, not {k}")
    return k


def checked_question(question: str) -> str:
    if not question or not question.strip():
        raise ValueError("the question is blank")
    return question


def candidates(k: int, asked: int | None = None) -> int:
    """How many results a fused search takes from one side."""
    return asked or max(WIDER * k, LEAST_CANDIDATES)


def asked(questions: DataFrame) -> DataFrame:
    """questions (qid, question), of which none may be blank: that is an error once they are read."""
    blank = F.raise_error(F.concat(F.lit("the question is blank: "), F.coalesce(F.col("qid"), F.lit("null")))).cast("boolean")
    return questions.where(F.when(F.col("question").isNotNull() & text.not_blank(F.col("question")), True).otherwise(blank))


def query_terms(questions: DataFrame) -> DataFrame:
    """(qid, term, qtf, qpos) of questions (qid, question): how often a term stands there, and where first."""
    exploded = questions.select("qid", F.posexplode(text.tokenize(F.col("question"))).alias("qpos", "term"))
    return exploded.groupBy("qid", "term").agg(F.count("*").alias("qtf"), F.min("qpos").alias("qpos"))


def bm25_scores(terms: DataFrame, index: LexicalIndex, k1: float = ranking.K1, b: float = ranking.B) -> DataFrame:
    """(qid, chunk_id, ordinal, score, qpos) of every chunk that holds a term of the question."""
    found = _scanned(terms, index, None, k1, b)
    return _joined_scores(terms, index, k1, b) if found is None else found


def _scanned(terms: DataFrame, index: LexicalIndex, k: int | None, k1: float, b: float) -> DataFrame | None:
    """bm25_scores, or of each question and task only what may be among the k best. Questions are the small side: their
    terms go to all tasks, and each chunk is scored in its own row. None if there are too many terms for that."""
    ranking.checked(k1, b)
    known = bounded(terms).join(index.term_stats, "term").select("qid", "term", "qtf", "qpos", "idf")
    rows = known.limit(MOST_BROADCAST + 1).collect()
    if len(rows) > MOST_BROADCAST:
        return None
    packed, vocabulary = index.packed or (None, sorted({r["term"] for r in rows}))
    lists = tokens.lists_of_packed
    if packed is None and index.segments is not None:
        packed, lists = index.segments, tokens.lists_of_segments(vocabulary)
    elif packed is None:
        packed = lexical.packed_for(index, vocabulary)
    questions, numbers = list(dict.fromkeys(r["qid"] for r in rows)), {term: i for i, term in enumerate(vocabulary)}
    at = {qid: i for i, qid in enumerate(questions)}
    asked = [(at[r["qid"]], numbers[r["term"]], r["qtf"], r["qpos"], r["idf"]) for r in rows]
    run = tokens.scores(asked, len(questions), k, k1, b, index.corpus_stats.first()["avgdl"], lists)
    found = packed.mapInArrow(run, "question int, chunk_id string, ordinal long, score double, qpos int")
    kind = terms.schema["qid"].dataType.simpleString()
    names = packed.sparkSession.createDataFrame(list(enumerate(questions)), f"question int, qid {kind}")
    return found.join(F.broadcast(names), "question").select("qid", "ordinal", "chunk_id", F.round("score", ranking.PLACES).alias("score"), "qpos")


def _joined_scores(terms: DataFrame, index: LexicalIndex, k1: float, b: float) -> DataFrame:
    """The same by joins, for more terms than a task may hold. Questions meet the terms' statistics first, and postings
    only once."""
    avgdl = index.corpus_stats.first()["avgdl"]
    hits = index.postings.join(terms.join(index.term_stats, "term"), "term")
    if "dl" not in hits.columns:
        lengths = index.doc_stats.select("chunk_id", "dl")
        hits = hits.join(lengths, "chunk_id", "left").withColumn("dl", F.coalesce("dl", F.raise_error(F.lit("a posting of an unknown chunk")).cast("long")))
    one = F.col("qtf") * ranking.bm25(F.col("tf"), F.col("dl"), F.lit(avgdl), F.col("idf"), k1, b)
    sums = hits.groupBy("qid", "ordinal", "chunk_id").agg(F.sum(one).alias("score"), F.min("qpos").alias("qpos"))
    return sums.withColumn("score", F.round("score", ranking.PLACES))


def best(terms: DataFrame, index: LexicalIndex, k: int, k1: float = ranking.K1, b: float = ranking.B) -> DataFrame:
    """The k best chunks of each question: ties by the place of its first term that the chunk holds, then ordinals. They
    are worked out here, once, for as many questions as give rows that may be broadcast."""
    found = _scanned(terms, index, checked_k(k), k1, b)
    if found is None:
        return top(_joined_scores(terms, index, k1, b), k, "qpos", "ordinal")
    ranked = top(found, k, "qpos", "ordinal")
    rows = ranked.collect() if terms.select("qid").distinct().count() * k <= MOST_BROADCAST else None
    return ranked if rows is None else terms.sparkSession.createDataFrame(rows, ranked.schema)


def top(scores: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best of each question; equal scores by the columns named, least first."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *[F.asc_nulls_last(t) for t in ties])
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "chunk_id", "score")


def bm25(questions: DataFrame, index: LexicalIndex, k: int = DEFAULT_K, k1: float = ranking.K1, b: float = ranking.B) -> DataFrame:
    return best(query_terms(questions), index, k, k1, b)


def dense(queries: DataFrame, embeddings: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Exact inner products of queries (qid, embedding) and embeddings (chunk_id, ordinal, embedding), the k best.

    Embeddings are dealt into shards and queries into blocks; every two meet in one task, which keeps each
    query's best, and these are merged. Vectors that are null or hold a null or NaN take no part; of two
    lengths, the shorter counts as having zeros.
    """
    checked_k(k)
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    wanted = queries.select(F.col("qid").cast("string").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding")).where(good)
    rows = embeddings.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("ordinal").cast("long").alias("ordinal"), F.col("embedding").cast("array<double>").alias("embedding")).where(good)
    blocks, shards = (max(1, -(-table.count() // size)) for table, size in ((wanted, QUERY_BLOCK), (rows, SHARD)))
    part = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("shard", part("ordinal", shards)).withColumn("block", every(blocks))
    right = wanted.withColumn("block", part("qid", blocks)).withColumn("shard", every(shards))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_best_of(k), "qid string, chunk_id string, ordinal long, score double")
    return top(found, k, "ordinal")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(at[0], at[-1]) - at[:-1][row]] = flat[at[0] : at[-1]]
    return out


def _best_of(k: int):
    def score(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names, kinds = ["qid", "chunk_id", "ordinal", "score"], (pa.string(), pa.string(), pa.int64(), pa.float64())
        if not rows.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        width = max(pc.max(pc.list_value_length(t["embedding"])).as_py() for t in (rows, queries))
        x, q = (_matrix(t["embedding"], width) for t in (rows, queries))
        ordinals = rows["ordinal"].to_numpy()
        places, scores = [], []
        for one in q:
            own = np.round(x @ one, ranking.PLACES)
            best = np.lexsort((ordinals, -own))[:k]
            places.append(best)
            scores.append(own[best])
        at = np.concatenate(places)
        ids = queries["qid"].take(pa.array(np.repeat(np.arange(len(q)), [len(p) for p in places])))
        return pa.table([ids, rows["chunk_id"].take(pa.array(at)), pa.array(ordinals[at]), pa.array(np.concatenate(scores))], names=names)

    return score


def fuse(first: DataFrame, second: DataFrame, k: int = DEFAULT_K, rrf_k: int = ranking.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings. Equal sums: by the first list's rank, then the second's."""
    shares = first.select("qid", "chunk_id", F.col("rank").alias("rank_1"), F.lit(None).cast("int").alias("rank_2")).unionByName(
        second.select("qid", "chunk_id", F.lit(None).cast("int").alias("rank_1"), F.col("rank").alias("rank_2"))
    )
    share = ranking.rrf(F.coalesce("rank_1", "rank_2") - 1, rrf_k)
    sums = shares.groupBy("qid", "chunk_id").agg(F.round(F.sum(share), ranking.PLACES).alias("score"), F.min("rank_1").alias("rank_1"), F.min("rank_2").alias("rank_2"))
    return top(sums, checked_k(k), "rank_1", "rank_2")


def hybrid(questions: DataFrame, queries: DataFrame, index: LexicalIndex, embeddings: DataFrame, k: int = DEFAULT_K, lexical_k: int | None = None, dense_k: int | None = None) -> DataFrame:
    checked_k(k)
    return fuse(bm25(questions, index, candidates(k, lexical_k)), dense(queries, embeddings, candidates(k, dense_k)), k)


def materialised(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranked with the chunks' columns, joined last and on few rows; an unknown chunk is an error. The ids go to the
    chunks, so that only the chunks that are wanted move."""
    own = chunks.select(F.col("id").alias("chunk_id"), "file_path", "text", "start", "end", "kind")
    few = own.join(bounded(ranked.select("chunk_id").distinct()), "chunk_id", "left_semi")
    joined = ranked.join(few, "chunk_id", "left")
    return joined.withColumn("file_path", F.coalesce("file_path", F.raise_error(F.concat(F.lit("no such chunk: "), F.col("chunk_id")))))
