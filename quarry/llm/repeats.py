"""Operator 1, suffix-array dedup: every byte covered by a 100-byte string that also starts earlier goes.

Distributed prefix doubling over sampled suffixes. A full suffix array sorts every byte position some seven
times; here only positions that can matter are ranked. In every window of ``LENGTH`` bytes the
leftmost of the least ``DEPTH``-byte fingerprints is the window's anchor, so equal windows have equal
anchors at equal offsets. Ranks are fingerprints (equal strings, equal ranks), and Spark sorts
(rank, position) pairs at growing depth, dropping what is unique:

1. depth 32: anchors by the rank of their DEPTH bytes. A unique anchor's windows are unique.
2. depth 100 and more: the pair (anchor's rank, rank of all bytes that its windows cover). Of equal
   pairs, all but the first position are repeated with all their windows.
3. depth 100: first positions whose anchor also stands in other surroundings. They are sorted once more
   by rank and position, with the bytes around them; a window is repeated if one with equal rank came before.

Anchors within one batch are combined before they are moved, so a string that is everywhere is moved once
for each batch. Rank groups of more than ``MOST`` positions in step 3 go window by window, ranked by
all 100 bytes, so no task holds a group. Ranks are 64-bit fingerprints; in step 3 a false match
needs both that of the anchor and that of the window to collide.

Odd input: null and empty texts, and those under LENGTH bytes, lose nothing. Documents are ordered by id,
equal ids by text hash; rows that repeat both are copies, of which the first stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

LENGTH = 100
DEPTH = 32
MOST = 20_000
_REPEATED, _CONTESTED = 0, 1


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of that width, by doubling."""
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        values = np.minimum(values[: len(values) - step], values[step:])
        covered += step
    return values


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """(text, first window's start, windows, anchor's rank, rank of all bytes covered) of each anchor, in order;
    starts count from the text's."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prints = common.Fingerprints(data)
    ranks = prints.windows(depth)
    place = np.arange(len(ranks), dtype=np.uint64)
    least = _least((ranks & np.uint64(0xFFFFFFFF00000000)) | place, length - depth + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    of = common.spread(bounds)[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + length <= bounds[1:][of])
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor, of = anchor[start], of[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, at = start[first], start[last], anchor[first]
    covered = common.mix(prints.of(lo, hi + length) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return of[first], lo - bounds[of[first]], hi - lo + 1, ranks[at], covered


_ANCHORS = "rank long, covered long, key long, lo long, n long"


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """The anchors of keyed documents. Within a batch, of equal pairs only the first is passed on; the windows
    of the others are known to be repeated (n below 0)."""

    def find(batches):
        for batch in batches:
            data, at = common.text_bytes(batch.column(1))
            keys = batch.column(0).to_numpy()
            for a, b in common.slices(at):
                of, lo, n, rank, covered = anchors(data[at[a] : at[b]], at[a : b + 1] - at[a])
                key = keys[a:b][of]
                order = np.lexsort((lo, key, covered, rank))
                again = np.zeros(len(order), bool)
                again[1:] = (rank[order][1:] == rank[order][:-1]) & (covered[order][1:] == covered[order][:-1])
                known = np.zeros(len(order), bool)
                known[order] = again
                spread = common.mix(key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64))
                rank, covered, n = np.where(known, spread, rank), np.where(known, np.uint64(0), covered), np.where(known, -n, n)
                yield pa.RecordBatch.from_arrays([common.longs(rank), common.longs(covered), pa.array(key), pa.array(lo), pa.array(n)], names=["rank", "covered", "key", "lo", "n"])

    return docs.select("_q_key", "text").mapInArrow(common.lean(find), _ANCHORS)


def _walk_pairs(batches):
    """Sorted anchors as (kind, rank, key, lo, n): repeated windows, and those that step 3 has to compare.
    Holds one row between batches: the first of a rank of which one surrounding has been seen."""
    last = None  # rank, covered of the row before
    held = None  # (key, lo, n) of the current rank's first row, while it has but one surrounding
    several = False
    for batch in batches:
        if not batch.num_rows:
            continue
        rank, covered, key, lo, n = (c.to_numpy() for c in batch.columns)
        new_rank = np.ones(len(rank), bool)
        new_rank[1:] = rank[1:] != rank[:-1]
        new_pair = new_rank.copy()
        new_pair[1:] |= covered[1:] != covered[:-1]
        if last is not None and last[0] == rank[0]:
            new_rank[0], new_pair[0] = False, last[1] != covered[0]
        group = np.cumsum(new_rank)  # 0: goes on from the batch before
        firsts = np.flatnonzero(new_pair & (n > 0))
        counts = np.bincount(group[firsts], minlength=group[-1] + 1)
        carried = []
        if counts[0]:
            if held is not None:
                carried, held, several = [(last[0], *held)], None, True
            counts[0] = 2 if several else counts[0]
        if group[-1] > 0:
            held, several = None, False
        contested = firsts[counts[group[firsts]] > 1]
        if group[-1] > 0:
            several = bool(counts[-1] > 1)
            if counts[-1] == 1:
                i = firsts[-1]
                held = (key[i], lo[i], n[i])
        repeated = np.flatnonzero(~new_pair | (n < 0))
        last = rank[-1], covered[-1]
        rows = np.concatenate([repeated, contested])
        kinds = np.concatenate([np.full(len(repeated), _REPEATED), np.full(len(contested), _CONTESTED)])
        columns = [kinds, rank[rows], key[rows], lo[rows], np.abs(n[rows])]
        if carried:
            columns = [np.append(c, v) for c, v in zip(columns, (_CONTESTED, *carried[0]))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["kind", "rank", "key", "lo", "n"])


def _surroundings(batches):
    """(rank, key, lo, n, bytes) of each contested row of a document; window by window if its rank is hot."""
    names = ["rank", "key", "lo", "n", "piece"]
    for batch in batches:
        keys, lists = batch.column(0).to_numpy(), batch.column(3)
        data, at = common.text_bytes(batch.column(2))
        bounds, flat = lists.offsets.to_numpy(), lists.flatten()
        of = common.spread(bounds)
        rank, lo, n, hot = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("rank", "lo", "n", "hot"))
        start, raw = at[:-1][of] + lo, data.tobytes()
        cold = np.flatnonzero(~hot)
        for i in range(0, len(cold), 20_000):
            k = cold[i : i + 20_000]
            pieces = [raw[a:b] for a, b in zip(start[k].tolist(), (start[k] + n[k] + LENGTH - 1).tolist())]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[k]) for x in (rank, keys[of], lo, n)), pa.array(pieces, pa.binary())], names=names)
        for i in np.flatnonzero(hot).tolist():
            own = common.Fingerprints(data[start[i] : start[i] + n[i] + LENGTH - 1]).windows(LENGTH)
            own = common.mix(own ^ rank[i : i + 1].view(np.uint64))
            columns = [common.longs(own), pa.array(np.full(len(own), keys[of[i]])), pa.array(lo[i] + np.arange(len(own))), pa.array(np.ones(len(own), np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(own), pa.binary())], names=names)


def _walk_windows(batches):
    """Sorted rows of _surroundings as (key, lo, n): runs of windows that came before under the same rank.
    Holds the windows of the current rank, at most MOST rows of them."""
    last, seen = None, np.zeros(0, np.uint64)
    for whole in batches:
        for at in range(0, whole.num_rows, 4_000):
            batch = whole.slice(at, 4_000)
            rank, key, lo, n = (batch.column(i).to_numpy() for i in range(4))
            pieces = batch.column(4).to_pylist()
            size = np.where(np.array([p is not None for p in pieces]), n + LENGTH - 1, 0)
            data = np.frombuffer(b"".join(p for p in pieces if p), np.uint8)
            starts = np.concatenate([[0], np.cumsum(size)])
            whole_row = size == 0  # a window of a hot rank: its rank says all
            n_own = np.where(whole_row, 1, n)
            of = np.repeat(np.arange(len(rank)), n_own)
            number = np.arange(len(of)) - np.repeat(np.cumsum(n_own) - n_own, n_own)
            value = np.zeros(len(of), np.uint64)
            inside = ~whole_row[of]
            if inside.any():
                windows = common.Fingerprints(data).windows(LENGTH)
                value[inside] = windows[starts[of[inside]] + number[inside]]
            pair = common.mix(value ^ common.mix(rank.view(np.uint64)[of]))
            before = np.ones(len(pair), bool)
            before[np.unique(pair, return_index=True)[1]] = False
            current = rank[of] == (last if last is not None else rank[0])
            if last is not None:
                before |= current & np.isin(pair, seen)
            own = pair[rank[of] == rank[-1]]
            seen = np.union1d(seen, own) if last is not None and last == rank[-1] else np.unique(own)
            last = rank[-1]
            # runs of repeated windows within a row
            hit = np.flatnonzero(before)
            if len(hit):
                cut = np.ones(len(hit), bool)
                cut[1:] = (of[hit][1:] != of[hit][:-1]) | (hit[1:] != hit[:-1] + 1)
                first = np.flatnonzero(cut)
                length = np.diff(np.append(first, len(hit)))
                row = of[hit[first]]
                yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(lo[row] + number[hit[first]]), pa.array(length)], names=["key", "lo", "n"])


def _assemble(batches):
    """What stays of each document, and the removed runs."""
    for batch in batches:
        data, at = common.text_bytes(batch.column(2))
        raw, lists = data.tobytes(), batch.column(3)
        bounds, flat = lists.offsets.to_numpy(), lists.values
        lo, n = flat.field("lo").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
        kept, starts, ends = [], [], []
        for i in range(batch.num_rows):
            text = raw[at[i] : at[i + 1]]
            a, b = bounds[i], bounds[i + 1]
            runs = []
            if b > a and lists[i].is_valid:
                order = np.argsort(lo[a:b], kind="stable")
                s = lo[a:b][order]
                e = np.maximum.accumulate(s + n[a:b][order] + LENGTH - 1)
                new = np.ones(len(s), bool)
                new[1:] = s[1:] > e[:-1]
                first = np.flatnonzero(new)
                runs = list(zip(s[first].tolist(), e[np.append(first[1:], len(s)) - 1].tolist()))
            done, parts = 0, []
            for x, y in runs:
                parts.append(text[done:x])
                done = y
            parts.append(text[done:])
            kept.append(b"".join(parts))
            starts.append([x for x, _ in runs])
            ends.append([y for _, y in runs])
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())
        ], names=["key", "doc_id", "n_bytes", "starts", "ends", "kept"])


def remove_repeats(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(key, doc_id, n_bytes, starts, ends, kept) of keyed documents: the removed runs of bytes, and the rest."""
    spark = docs.sparkSession
    common.bounded_arrow(spark)
    pairs = _anchor_rows(docs).repartition(common.partitions(spark), "rank").sortWithinPartitions("rank", "covered", "key", "lo")
    found = common.pinned(pairs.mapInArrow(common.lean(_walk_pairs), "kind long, rank long, key long, lo long, n long"))
    contested = found.where(F.col("kind") == _CONTESTED)
    hot = common.small(common.pinned(contested.groupBy("rank").count().where(F.col("count") > most).select("rank", F.lit(True).alias("hot"))))
    contested = contested.join(hot, "rank", "left").groupBy("key").agg(F.collect_list(F.struct("rank", "lo", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("rows"))
    # one exchange of the texts, by key, serves both joins
    texts = docs.select("_q_key", "doc_id", "text").repartition(common.partitions(spark), "_q_key")
    around = texts.join(contested, texts["_q_key"] == contested["key"]).select("_q_key", "doc_id", "text", "rows")
    around = around.mapInArrow(common.lean(_surroundings), "rank long, key long, lo long, n long, piece binary")
    around = around.repartition(common.partitions(spark), "rank").sortWithinPartitions("rank", "key", "lo")
    windows = around.mapInArrow(common.lean(_walk_windows), "key long, lo long, n long")
    removed = found.where(F.col("kind") == _REPEATED).select("key", "lo", "n").unionByName(windows)
    removed = removed.groupBy("key").agg(F.collect_list(F.struct("lo", "n")).alias("removed"))
    joined = texts.join(removed, texts["_q_key"] == removed["key"], "left").select("_q_key", "doc_id", "text", "removed")
    return joined.mapInArrow(common.lean(_assemble), "key long, doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.keyed(common.read(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
