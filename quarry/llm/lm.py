"""Operator 8, LM scoring: stupid backoff, relationally.

Words are lower-cased (A-Z) runs of characters other than white space. The corpus's n-grams up to ``ORDER``
are counted over all documents, and each document is scored by the others: its own occurrences are taken off
every count that it uses, so that none is its own evidence and no n-gram need be left out. With c for what
then remains, a word's score after its (ORDER - 1) predecessors is c(n-gram) / c(context) if c(n-gram) > 0, else
``BACKOFF`` times its score after one predecessor fewer; at last c(word) / all words, where a word that no
other document has counts as BACKOFF occurrences. A document's score is the sum of the logarithms.

Documents are dealt into batches by their key's hash. Each batch explodes its n-grams into fingerprints, counts
its distinct ones, and sends these partial counts to buckets, which are ranges of fingerprints. A
bucket adds up the counts of all batches (the count table, partitioned by hash) and joins them back: each batch
gets the totals for what it sent, in the same order, so neither documents nor fingerprints travel
again. The batch then scores its documents and sums per document. An n-gram that is everywhere is one row
for each batch, so no key is hot. Batches and buckets hold a bounded number of bytes; their numbers
follow the corpus.

Odd input: null, empty and blank texts have no words, score 0 and a null mean; contexts do not cross documents;
repeated rows and copies count as often as they occur, and are others to each other. Scores under an
empty rest of the corpus are those of words that none has, out of one word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

ORDER = 3
BACKOFF = 0.4
BATCH_BYTES = 12 << 20
BUCKET_BYTES = 4 << 20
LEAST_BYTES = 2 << 20
#: The n-gram that stands for all words of the corpus.
_ALL = np.uint64(0x5851F42D4C957F2D)


def ngrams(data: np.ndarray, at: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per length n: fingerprints of the n-grams that end at each word (0 where a text has too few before);
    the words' places in their texts; the n+1 offsets of the texts' words."""
    prints, bounds = common.sliced_words(data, at)
    place = np.arange(len(prints)) - bounds[:-1][common.spread(bounds)]
    levels = [common.mix(prints + np.uint64(1))]
    for n in range(2, order + 1):
        own = np.zeros(len(prints), np.uint64)
        if len(prints) >= n:
            own[n - 1 :] = common.mix(levels[-1][n - 2 : -1] * np.uint64(0xC2B2AE3D27D4EB4F) + prints[n - 1 :] + np.uint64(n))
        own[place < n - 1] = 0
        levels.append(own)
    return levels, place, bounds


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    first = np.flatnonzero(new)
    return values[first], np.diff(np.append(first, len(values)))


def _batch_counts(levels: list[np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, counts = _distinct(np.concatenate([x[x != 0] for x in levels] + [np.array([_ALL])]))
    counts[np.searchsorted(found, _ALL)] = bounds[-1]
    return found, counts


def _own(level: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each place, how often its n-gram stands in its text; of: the places' texts."""
    pair = common.mix(level ^ common.mix(of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(pair)
    pair = pair[order]
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    sizes = np.diff(np.append(np.flatnonzero(new), len(pair)))
    out = np.empty(len(pair), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def _bucket_cuts(found: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of fingerprints starts in a sorted array; n+1 places."""
    edges = np.array([i * (1 << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(found, edges), [len(found)]])



def _squeezed(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _restored(raw, size: int) -> bytes:
    return pa.Codec("zstd").decompress(raw, int(size), asbytes=True)


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers as their bytes' planes, most significant last, without planes of zeros."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max(1, 8 - int(np.argmax(planes.any(axis=1)[::-1]))) if len(values) and planes.any() else 1
    raw = planes[:used].tobytes()
    return len(values).to_bytes(4, "little") + bytes([used]) + _squeezed(raw)


def _unpack(raw: bytes) -> np.ndarray:
    n, used = int.from_bytes(raw[:4], "little"), raw[4]
    planes = np.zeros((8, n), np.uint8)
    if n:
        planes[:used] = np.frombuffer(_restored(raw[5:], n * used), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _packed_texts(docs: DataFrame, n_batches: int) -> DataFrame:
    """(batch, key, doc_id, size, packed) of keyed documents: texts travel compressed, with their length."""

    def pack(batches):
        for batch in batches:
            data, at = common.text_bytes(batch.column(3))
            raw = data.tobytes()
            packed = [_squeezed(raw[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at)), pa.array(packed, pa.binary())], names=["batch", "key", "doc_id", "size", "packed"])

    batch = F.pmod(F.xxhash64("_q_key"), F.lit(n_batches)).cast("int").alias("batch")
    return docs.select(batch, F.col("_q_key").alias("key"), "doc_id", "text").mapInArrow(common.lean(pack), "batch int, key long, doc_id long, size long, packed binary")


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sizes = table["size"].to_numpy()
    raw = b"".join(_restored(x.as_buffer(), n) for x, n in zip(table["packed"], sizes.tolist()))
    return np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def count_and_join(batches: DataFrame, buckets: int, order: int) -> DataFrame:
    """(batch, bucket, totals): for each batch the corpus's counts of its distinct n-grams, in their order."""

    def explode(key, table):
        levels, _, bounds = ngrams(*_texts(table), order)
        found, counts = _batch_counts(levels, bounds)
        cuts = _bucket_cuts(found, buckets)
        rows = [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        return pa.table({
            "batch": pa.array([key[0].as_py()] * len(rows), pa.int32()), "bucket": pa.array([i for i, _, _ in rows], pa.int32()),
            "prints": pa.array([_pack(np.diff(found[a:b], prepend=np.uint64(0))) for _, a, b in rows], pa.binary()),
            "counts": pa.array([_pack(counts[a:b]) for _, a, b in rows], pa.binary()),
        })

    def total(key, table):
        prints = [np.cumsum(_unpack(x.as_py()), dtype=np.uint64) for x in table["prints"]]
        counts = np.concatenate([_unpack(x.as_py()) for x in table["counts"]])
        ends = np.cumsum([len(x) for x in prints])
        every = np.concatenate(prints)
        order_ = np.argsort(every)
        every = every[order_]
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        first = np.flatnonzero(new)
        sums = np.add.reduceat(counts[order_], first)
        totals = np.empty(len(every), np.uint64)
        totals[order_] = sums[np.cumsum(new) - 1]
        return pa.table({"batch": table["batch"], "bucket": table["bucket"], "totals": pa.array([_pack(x) for x in np.split(totals, ends[:-1])], pa.binary())})

    sent = batches.groupBy("batch").applyInArrow(explode, "batch int, bucket int, prints binary, counts binary")
    sent = sent.repartition(max(common.partitions(batches.sparkSession), min(buckets, 4 * common.partitions(batches.sparkSession))), "bucket")
    return sent.groupBy("bucket").applyInArrow(total, "batch int, bucket int, totals binary")


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """(key, doc_id, n_words, score) of keyed documents, each under the model of the others."""
    spark = docs.sparkSession
    common.bounded_arrow(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a small corpus is dealt into smaller batches, so that all tasks have some
    n_batches, buckets = max(1, -(-size // BATCH_BYTES), min(common.partitions(spark), -(-size // LEAST_BYTES))), max(1, -(-size // BUCKET_BYTES))
    batches = _packed_texts(docs, n_batches).repartition(common.partitions(spark), "batch")
    totals = count_and_join(batches, buckets, order)

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        levels, place, bounds = ngrams(*_texts(texts), order)
        found, _ = _batch_counts(levels, bounds)
        answered = sorted(zip(answers["bucket"].to_pylist(), answers["totals"].to_pylist()))
        total = np.concatenate([_unpack(x) for _, x in answered]).astype(np.float64)
        of, counts = common.spread(bounds), []
        for level in levels:
            rank = np.argsort(level)
            others = np.empty(len(level))
            others[rank] = total[np.minimum(np.searchsorted(found, level[rank]), len(total) - 1)]
            counts.append(np.where(level == 0, 0, others - _own(level, of)))
        words = total[np.searchsorted(found, _ALL)] - np.diff(bounds)[of]
        best = np.maximum(counts[0], backoff) / np.maximum(words, 1)
        for n in range(2, order + 1):
            context = np.zeros(len(best))
            context[1:] = counts[n - 2][:-1]
            inside = place >= n - 1
            best = np.where(inside & (counts[n - 1] > 0), counts[n - 1] / np.maximum(context, 1), np.where(inside, backoff * best, best))
        logs = np.log(best) if len(best) else best
        sums = np.array([logs[a:b].sum() for a, b in zip(bounds, bounds[1:])])
        return pa.table({"key": texts["key"], "doc_id": texts["doc_id"], "n_words": pa.array(np.diff(bounds)), "score": pa.array(sums, pa.float64())})

    return batches.groupBy("batch").cogroup(totals.groupBy("batch")).applyInArrow(score, "key long, doc_id long, n_words long, score double")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(common.keyed(common.read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", F.round("score", 6).alias("score"), F.when(F.col("n_words") > 0, F.round(F.col("score") / F.col("n_words"), 6)).alias("mean_log_score"))


def brute(texts: list[str | None], order: int = ORDER, backoff: float = BACKOFF) -> list[float]:
    """Scores from dictionaries, word by word; for tests."""
    import math
    import re
    from collections import Counter

    docs = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    count = lambda d: Counter(tuple(d[i - n : i]) for n in range(1, order + 1) for i in range(n, len(d) + 1))
    own = [count(d) for d in docs]
    every = sum(own, Counter())
    words = sum(map(len, docs))

    def of(d: int, history: tuple[str, ...], word: str) -> float:
        left = every[*history, word] - own[d][*history, word]
        if not history:
            return max(left, backoff) / max(words - len(docs[d]), 1)
        if left:
            return left / (every[history] - own[d][history])
        return backoff * of(d, history[1:], word)

    return [sum(math.log(of(k, tuple(d[max(0, i - order + 1) : i]), w)) for i, w in enumerate(d)) for k, d in enumerate(docs)]
