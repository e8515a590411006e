"""What the training-data operators share: row keys, Arrow text access and byte fingerprints.

Defined results for odd input, for every operator of this subpackage unless its own
docstring says otherwise:

* null text counts as the empty text, and a null ``doc_id`` is a document like any other
  (it sorts after every number);
* rows that repeat a ``doc_id`` are separate documents, ordered by their text's hash;
* columns besides the needed ones are carried or ignored, whatever their names: internal
  columns start with ``_q_``, and input columns of such names are renamed while an operator works;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import json
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on, so that memory follows this and not the batch.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_arrow(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of whole texts can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(found)
        return found
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pinned(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder. The shuffle files that it was made from go at
    once, since nothing needs them any more."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, before)


def keyed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(_q_key, doc_id, text), or the columns named: ``_q_key`` is a long, unique and ordered as (doc_id, text hash).

    Unique, non-null ids are their own key. Otherwise the rows are sorted once and numbered,
    and the numbering is pinned, since it depends on how the sort dealt them out.
    """
    if columns is None:
        columns = ["doc_id", "text"]
        df = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    repeated = df.groupBy("doc_id").count().where("`count` > 1 or doc_id is null").limit(1).count()
    if not repeated:
        return df.select(F.col("doc_id").cast("long").alias("_q_key"), *columns)
    ordered = df.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return pinned(ordered.select(F.monotonically_increasing_id().alias("_q_key"), *columns))


def shielded(stage):
    """A stage of the pipeline, with input columns whose names are like internal ones renamed while it works."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mark = "r_"
        while any(c.lower().startswith(mark) for c in docs.columns):
            mark = f"r{mark}"
        names = {f"{mark}{i}" if c.lower().startswith("_q_") else c: c for i, c in enumerate(docs.columns)}
        found = stage(spark, docs.toDF(*names), sf_dir)
        return found.toDF(*[names.get(c, c) for c in found.columns])

    return run


#: Rows of a narrow table (some longs each) that may be broadcast.
MOST_BROADCAST = 200_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, to be broadcast if its rows, which are counted, are few; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of parameters, as a literal of the plan."""
    if not rows:
        return spark.range(0).select(F.inline(F.from_json(F.lit("[]"), f"array<struct<{schema}>>")))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _release() -> None:
    """Gives unused memory back to the system: a worker lives on after its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def lean(f):
    """f, an iterator over Arrow batches, followed by a release of memory at the end of each task."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            _release()

    return run


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one row that is longer."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


# -- fingerprints ------------------------------------------------------------------------------------
# A byte string s has the fingerprint mix(sum of code(s[i]) * BASE**i), modulo 2**64. Prefix sums give the
# fingerprint of any substring: the difference of two of them, moved back by an inverse power of the odd base.

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64 bits: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


CODES = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 2), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


class Fingerprints:
    """Fingerprints of substrings of one byte buffer."""

    def __init__(self, data: np.ndarray, codes: np.ndarray = CODES):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * powers(_BASE, len(data)), out=self.sums[1:])
        self.back = powers(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of data[start:end], elementwise; the length is part of it."""
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix(raw + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def windows(self, length: int) -> np.ndarray:
        """Fingerprints of all windows of one length, as of() gives them."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        raw = (self.sums[length:] - self.sums[:n]) * self.back[:n]
        return mix(raw + _U(length * 0xD6E8FEB86659FD93 % (1 << 64)))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


#: Bytes of terms: ASCII letters, and all bytes of characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x80:] = LETTERS[ord("A") : ord("Z") + 1] = LETTERS[ord("a") : ord("z") + 1] = True


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of one kind, else of bytes other than the six ASCII white spaces; a
    text's end ends a run."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = inside[0], inside[-1]
    joint = offsets[1:-1]
    joint = joint[(joint > 0) & (joint < len(data))]
    cut = joint[inside[joint] & inside[joint - 1]]  # texts that touch without white space
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(cut):
        cut = np.unique(cut)
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words, which are runs(), of lower-cased (A-Z) texts, and the n+1 offsets of each text's words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = runs(data, offsets, kind)
    return Fingerprints(_LOWER[data]).of(starts, ends), np.searchsorted(starts, offsets, side="left")


def sliced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As words(), slice by slice, so that memory beside the result follows the slice."""
    parts, bounds = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in slices(offsets):
        prints, own = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append(prints)
        bounds.append(own[1:] + bounds[-1][-1])
    return np.concatenate(parts), np.concatenate(bounds)


def spread(bounds: np.ndarray) -> np.ndarray:
    """The row number of each element, given the rows' n+1 offsets."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def longs(values: np.ndarray) -> pa.Array:
    """64-bit fingerprints as Spark's signed longs."""
    return pa.array(values.view(np.int64))


def sha_hex(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)
