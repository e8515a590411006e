"""Operator 10, MinHash near-dedup with HyperMinHash.

Each document's set of word shingles is hashed once. The top bits of a hash choose one of
``REGISTERS`` buckets; a bucket keeps its least hash as a count of leading zeros (6 bits) and the 9
mantissa bits after the first one. Bands of ``ROWS`` compressed registers make groups of candidates;
in these, empty buckets borrow from others in an order fixed for each bucket, so that two documents borrow
alike. Of the buckets that either document has filled itself, the share of equal registers, corrected for
chance collisions, estimates the Jaccard similarity; candidates that may reach the threshold, to
``ERRORS`` standard errors, are verified on their full shingle sets.

Documents with one shingle set (equal sizes and 128-bit sums) are one class, of which only the first takes
part. In a bucket of classes, each is first held against the bucket's first one (linear). Verified links
give components. Then, in buckets that still hold several components, the members outside the largest one
are held against all others: by pairs where a bucket is small, else against that whole component (once
for all bands) and against each other, by blocks of bounded size. A block's task has the full sets: it estimates
by registers, verifies in place, from the most similar on, what its links haven't joined yet, and passes on
those links only. So every candidate pair is verified or joined by others, and none is lost to a cap.

Two documents of similarity 0.8 share a band with probability 1 - (1 - 0.8^6)^40 > 0.99999, those of
0.5 with 0.47 and those of 0.3 with 0.03.

Odd input: null, empty or blank texts have an empty set and are linked with nothing; texts of fewer
words than a shingle have one shingle, all their words. Ties of components go to the least id; a null id
gives its group's name only where there is no other. Rows that repeat an id are documents of their own,
and all of those that bear their group's name count as kept by op10; the pipeline's stage keeps one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.graph import components

WORDS = 5
THRESHOLD_PERCENT = 80
REGISTERS, BANDS, ROWS = 256, 40, 6
ERRORS = 4.5
SMALL_BUCKET = 24
#: Members, and shingles, of a block on average.
BLOCK, BLOCK_SHINGLES = 1_024, 1 << 20
_MANTISSA = 9
#: Marks a register that its bucket hasn't filled itself; such registers serve in bands alone.
_BORROWED = np.uint16(1 << 15)
#: Expected share of equal registers of unrelated sets, for this many mantissa bits.
_COLLISIONS = 0.1699 / (1 << _MANTISSA)


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their n+1 offsets."""
    prints, bounds = common.words(data, at)
    n = np.diff(bounds)
    chain = common.mix(prints)
    for i in range(1, min(width, len(prints))):
        chain[: len(prints) - i] = common.mix(chain[: len(prints) - i] * np.uint64(0x9E3779B97F4A7C15) + prints[i:])
    parts, sizes = [], np.zeros(len(n), np.int64)
    for i, (a, words) in enumerate(zip(bounds.tolist(), n.tolist())):
        if not words:
            continue
        if words >= width:
            own = np.unique(chain[a : a + words - width + 1])
        else:
            value = np.uint64(words)
            with np.errstate(over="ignore"):
                for w in prints[a : a + words]:
                    value = common.mix(np.array([value * np.uint64(0xC2B2AE3D27D4EB4F) + w]))[0]
            own = np.array([value])
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _orders(m: int, rows: int) -> np.ndarray:
    """For each of the first buckets, the order in which it asks all others when it is empty."""
    return np.argsort(common.mix(np.arange(rows * m, dtype=np.uint64) + np.uint64(1)).reshape(rows, m), axis=1)


_ORDERS = _orders(REGISTERS, BANDS * ROWS)


def registers(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The compressed registers (texts x REGISTERS, 16 bits) of sets as shingle_sets gives them."""
    n, banded = len(bounds) - 1, BANDS * ROWS
    out = np.full((n, REGISTERS), _BORROWED, np.uint16)
    filled = np.zeros((n, REGISTERS), bool)
    bucket = (hashes >> np.uint64(64 - REGISTERS.bit_length() + 1)).astype(np.int64)
    cell = common.spread(bounds) * REGISTERS + bucket
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]  # hashes are sorted, so a bucket's first is its least
    value = (hashes[first] << np.uint64(REGISTERS.bit_length() - 1)) >> np.uint64(12)  # 52 bits, exact as a double
    length = np.frexp(value.astype(np.float64))[1].astype(np.int64)
    shift = np.maximum(length - 1 - _MANTISSA, 0).astype(np.uint64)
    mantissa = (value >> shift) & np.uint64((1 << _MANTISSA) - 1)
    out.ravel()[cell[first]] = ((52 - length).astype(np.uint16) << np.uint16(_MANTISSA)) | mantissa.astype(np.uint16)
    filled.ravel()[cell[first]] = True
    row, column = np.nonzero(~filled[:, :banded] & filled.any(axis=1)[:, None])
    own = out.copy()
    for step in range(REGISTERS):
        if not len(row):
            break
        asked = _ORDERS[column, step]
        found = filled[row, asked]
        own[row[found], column[found]] = out[row[found], asked[found]] | _BORROWED
        row, column = row[~found], column[~found]
    return own


def likely(x: tuple, y: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimated similarity, whether it may be the threshold) of rows of registers and set sizes."""
    (a, n_a), (b, n_b) = x, y
    own = (a < _BORROWED) | (b < _BORROWED)
    used = np.maximum(own.sum(axis=-1), 1)
    equal = ((a == b) & own).sum(axis=-1)
    found = (equal / used - _COLLISIONS) / (1 - _COLLISIONS)
    level = percent / 100
    union = (n_a.astype(np.float64) + n_b) / (1 + level)  # at the threshold
    error = np.sqrt(level * (1 - level) / used * np.clip(1 - used / np.maximum(union, 1), 0.02, 1))
    return found, found >= level - ERRORS * error


def sketches(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(key, doc_id, n, mark, more, registers) of keyed documents: size and 128-bit sum of the set, and its size and registers in bytes."""

    def sketch(batches):
        for batch in batches:
            data, at = common.text_bytes(batch.column(2))
            for a, b in common.slices(at):
                hashes, bounds = shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a], width)
                marks = []
                for seed in (77, 0x5851F42D):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(common.mix(hashes + np.uint64(seed)), dtype=np.uint64)])
                    marks.append(common.longs(sums[bounds[1:]] - sums[bounds[:-1]]))
                sizes = np.diff(bounds).astype("<u4")[:, None]
                raw = np.hstack([sizes.view(np.uint8).reshape(-1, 4), registers(hashes, bounds).astype("<u2").view(np.uint8).reshape(-1, 2 * REGISTERS)]).tobytes()
                size = 2 * REGISTERS + 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(np.diff(bounds)), *marks, pa.array([raw[i * size : (i + 1) * size] for i in range(b - a)], pa.binary())],
                    names=["key", "doc_id", "n", "mark", "more", "registers"],
                )

    common.bounded_arrow(docs.sparkSession)
    return docs.select("_q_key", "doc_id", "text").mapInArrow(common.lean(sketch), "key long, doc_id long, n long, mark long, more long, registers binary")


def _table(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * REGISTERS + 4)
    return np.ascontiguousarray(raw[:, 4:]).view("<u2"), np.ascontiguousarray(raw[:, :4]).view("<u4").ravel()


def _estimated(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be links by their registers."""
    own = lambda name: sets.select(F.col("key").alias(name), F.col("registers").alias(f"registers_{name}"))
    joined = pairs.join(own("b"), "b").join(own("a"), "a").select("a", "b", "registers_a", "registers_b")

    def keep(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                part = batch.slice(i, 1_000)
                _, held = likely(_table(part.column(2)), _table(part.column(3)), percent)
                yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(held))

    return joined.mapInArrow(common.lean(keep), "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, width: int = WORDS) -> DataFrame:
    """(key, shingles) of the documents whose keys are in ids (one column of distinct keys): hashes in order, as bytes."""
    texts = docs.select("_q_key", "text").join(common.small(ids.toDF("_q_key")), "_q_key", "left_semi")

    def sets(batches):
        for batch in batches:
            data, at = common.text_bytes(batch.column(1))
            for a, b in common.slices(at):
                hashes, bounds = shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a], width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([hashes[x:y].tobytes() for x, y in zip(bounds, bounds[1:])], pa.binary())], names=["key", "shingles"])

    return texts.mapInArrow(common.lean(sets), "key long, shingles binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, as sorted arrays, reach the threshold; sizes alone may tell that they don't."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(docs: DataFrame, pairs: DataFrame, percent: int = THRESHOLD_PERCENT, width: int = WORDS) -> DataFrame:
    """The pairs (a, b) of keys, which are pinned, whose full shingle sets are similar enough."""
    ids = common.pinned(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct())
    found = full_sets(docs, ids, width)
    own = lambda name: found.select(F.col("key").alias(name), F.col("shingles").alias(f"shingles_{name}"))
    joined = pairs.join(own("b"), "b").join(own("a"), "a").select("a", "b", "shingles_a", "shingles_b")

    def confirm(batches):
        for batch in batches:
            held = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(held, pa.bool_()))

    return joined.mapInArrow(common.lean(confirm), "a long, b long")


def _joined(rows: tuple, other: tuple | None, percent: int) -> list[tuple[int, int]]:
    """Verified links of a block (rep, component, sets), or between two, that join different components; pairs that
    earlier links have joined are left out."""
    reps, of, sets = rows if other is None else tuple([*x, *y] for x, y in zip(rows, other))
    first = len(reps) if other is None else len(rows[0])
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    table, sizes = registers(np.concatenate(sets), bounds), np.diff(bounds)
    of = np.array(of)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.get(c, c)) != c:
            parent[c] = parent.get(up, up)
            c = up
        return c

    near_, i_, j_ = [], [], []
    for i in range(first):
        apart = np.flatnonzero(of[i + 1 if other is None else first :] != of[i]) + (i + 1 if other is None else first)
        if not len(apart):
            continue
        near, held = likely((table[i], sizes[i]), (table[apart], sizes[apart]), percent)
        near_.append(near[held])
        j_.append(apart[held])
        i_.append(np.full(len(j_[-1]), i))
    links = []
    if near_:
        near, i, j = (np.concatenate(x) for x in (near_, i_, j_))
        for x in np.argsort(-near, kind="stable").tolist():
            a, b = int(i[x]), int(j[x])
            if (ra := root(int(of[a]))) != (rb := root(int(of[b]))) and similar(sets[a], sets[b], percent):
                parent[max(ra, rb)] = min(ra, rb)
                links.append((int(reps[a]), int(reps[b])))
    return links


def _blocks(docs: DataFrame, probes: DataFrame, mains: DataFrame, others: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) that join components, found among rows (by, rep, component, n): each of ``probes`` against all of
    ``mains`` with the same ``by``, and ``others`` with the same ``by`` among themselves.

    Both sides are dealt into parts of bounded size by a hash, and every two parts meet in one task.
    """
    sizes = lambda df, name: df.groupBy("by").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias(name))
    part = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["by", "among", "left", "right", "side", "rep", "component"]
    met = sizes(probes, "lefts").join(sizes(mains, "rights"), "by")
    x = probes.join(met, "by").withColumn("left", part(F.col("lefts"))).withColumn("right", every(F.col("rights"))).withColumns({"side": F.lit(0), "among": F.lit(0)}).select(*columns)
    y = mains.join(met, "by").withColumn("right", part(F.col("rights"))).withColumn("left", every(F.col("lefts"))).withColumns({"side": F.lit(1), "among": F.lit(0)}).select(*columns)
    own = others.join(sizes(others, "parts"), "by").withColumn("part", part(F.col("parts"))).withColumn("second", every(F.col("parts")))
    own = own.withColumns({"left": F.least("part", "second"), "right": F.greatest("part", "second"), "side": F.when(F.col("part") <= F.col("second"), 0).otherwise(1), "among": F.lit(1)}).select(*columns)
    rows = common.pinned(x.unionByName(y).unionByName(own))
    found = full_sets(docs, common.pinned(rows.select("rep").distinct()), width)

    def compare(key, group):
        side = group["side"].to_numpy()
        reps, of = group["rep"].to_numpy(), group["component"].to_numpy()
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group["shingles"]]
        take = lambda k: (reps[k].tolist(), of[k].tolist(), [sets[i] for i in k.tolist()])
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if key[1].as_py() and key[2] == key[3]:
            links = _joined(take(one), None, percent) if len(one) > 1 else []
        else:
            links = _joined(take(one), take(two), percent) if len(one) and len(two) else []
        return pa.table({"a": pa.array([min(p) for p in links], pa.int64()), "b": pa.array([max(p) for p in links], pa.int64())})

    return rows.join(found, rows["rep"] == found["key"]).select(*columns, "shingles").groupBy("by", "among", "left", "right").applyInArrow(compare, "a long, b long")


def _apart(docs: DataFrame, shared: DataFrame, sets: DataFrame, links: DataFrame, tried: DataFrame, percent: int, width: int) -> DataFrame:
    """Links between components that candidates in one bucket still have."""
    found = common.pinned(components(links))
    members = shared.join(found, shared["rep"] == found["id"], "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("component"))
    counts = members.groupBy("band", "component").agg(F.count("*").alias("n"))
    split = counts.groupBy("band").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.max_by("component", F.struct("n", "component")).alias("main"))
    members = common.pinned(members.join(split.where("parts > 1").drop("parts"), "band"))

    few = members.where(F.col("size") <= SMALL_BUCKET)
    left = few.where("component <> main").select("band", F.col("rep").alias("a"), F.col("component").alias("of_a"))
    right = few.select("band", F.col("rep").alias("b"), F.col("component").alias("of_b"))
    pairs = left.join(right, "band").where("of_a <> of_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    close = common.pinned(_estimated(common.pinned(pairs.join(tried, ["a", "b"], "left_anti")), sets, percent))

    others = members.where((F.col("size") > SMALL_BUCKET) & (F.col("component") != F.col("main")))
    # against the largest component of each of its groups, once for all bands
    probes = common.pinned(others.select(F.col("main").alias("by"), "rep", "component", "n").distinct())
    whole = found.join(sets.select(F.col("key").alias("id"), "n"), "id").select(F.col("id").alias("rep"), "component", "n").unionByName(members.where("rep = component").select("rep", "component", "n")).distinct()
    mains = whole.join(common.small(probes.select("by").distinct()), F.col("component") == F.col("by"), "left_semi").select(F.col("component").alias("by"), "rep", "component", "n")
    among = others.select(F.col("band").alias("by"), "rep", "component", "n")  # band by band
    return verified(docs, close, percent, width).unionByName(_blocks(docs, probes, mains, among, percent, width))


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT, width: int = WORDS) -> DataFrame:
    """(key, doc_id, n_shingles, component, component_id) of keyed documents; component is the least key
    of those reached by links, component_id that document's id; width: words of a shingle."""
    sets = common.pinned(sketches(docs, width))
    classes = common.pinned(sets.where("n > 0").groupBy("mark", "more", "n").agg(F.min(F.struct("key", "doc_id")).alias("one")).select("mark", "more", "n", F.col("one.key").alias("rep"), "one.doc_id"))
    raw = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * raw + 5, F.lit(raw))))
    firsts = sets.join(classes.select("rep").hint("merge"), F.col("key") == F.col("rep"), "left_semi")
    bands = firsts.select(F.col("key").alias("rep"), "n", F.explode(keys).alias("band"))
    buckets = bands.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1").select("band", "hub")
    shared = common.pinned(bands.join(buckets.hint("merge"), "band"))
    stars = common.pinned(shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    links = common.pinned(verified(docs, common.pinned(_estimated(stars, sets, percent)), percent, width))
    links = common.pinned(links.unionByName(_apart(docs, shared, sets, links, stars, percent, width)))
    found = components(links)
    named = found.join(classes.select(F.col("rep").alias("component"), F.col("doc_id").alias("component_id")), "component")
    classes = classes.select("mark", "more", "n", "rep", F.col("doc_id").alias("rep_id")).join(named, F.col("rep") == F.col("id"), "left")
    classes = classes.select("mark", "more", "n", F.coalesce("component", "rep").alias("component"), F.when(F.col("component").isNull(), F.col("rep_id")).otherwise(F.col("component_id")).alias("component_id"))
    joined = sets.select("key", "doc_id", "n", "mark", "more").join(classes, ["mark", "more", "n"], "left")
    alone = F.col("component").isNull()
    return joined.select(
        "key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.keyed(common.read(spark, sf_dir, "documents"))
    return near_duplicates(docs, width=4).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@common.shielded
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near-duplicates."""
    rows = common.keyed(docs, docs.columns)
    texts = rows.select("_q_key", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    gone = common.pinned(near_duplicates(texts).where("key <> component").select(F.col("key").alias("_q_key")))
    return rows.join(common.small(gone), "_q_key", "left_anti").select(*docs.columns)
