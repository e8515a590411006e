"""Cached results of questions, as a table keyed by question, k, mode and version of the index."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.errors.exceptions.captured import CapturedException as SparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions import text
from quarry.operators.retrieve import checked_k
from quarry.sources.store import IndexStore


class QueryCache:
    """index_version: by default the index's own, so that a newer index finds no entries of an older one."""

    def __init__(self, spark: SparkSession, folder: str, mode: str = "bm25", index_version: str | None = None):
        self.spark, self.store, self.mode, self._version = spark, IndexStore(spark, folder), mode, index_version

    @property
    def version(self) -> str:
        return self.store.version() if self._version is None else self._version

    @property
    def _path(self) -> str:
        return f"{self.store.folder}/query_cache"

    def _rows(self) -> DataFrame:
        """Entries of this mode and version. A table that can't be read counts as empty, so its answers are worked out
        anew: its files are read here, not later, to tell."""
        none = self.spark.createDataFrame([], schemas.QUERY_CACHE)
        fs, path = self.store._file("query_cache")
        if not fs.exists(path):
            return none
        try:
            table = self.spark.read.parquet(self._path).select(*[F.col(f.name).cast(f.dataType) for f in schemas.QUERY_CACHE])
            rows = table.where((F.col("mode") == self.mode) & (F.col("index_version") == self.version)).persist()
            rows.count()
            return rows
        except (AnalysisException, SparkException, Py4JJavaError):
            return none

    def keyed(self, questions: DataFrame, k: int) -> DataFrame:
        checked_k(k)
        return questions.withColumn("key", text.cache_key(F.col("question"), F.lit(k)))

    def get(self, questions: DataFrame, k: int) -> DataFrame:
        """(qid, rank, chunk_id) of the questions (qid, question) that are held."""
        return self.keyed(questions, k).join(self._rows(), "key").where("rank > 0").select("qid", "rank", "chunk_id")

    def contains(self, questions: DataFrame, k: int) -> DataFrame:
        return self.keyed(questions, k).join(self._rows(), "key", "left_semi").select("qid")

    def entries(self, questions: DataFrame, k: int, results: DataFrame) -> DataFrame:
        """Rows of the table for results (qid, rank, chunk_id); a question without any is held with rank 0."""
        keyed = self.keyed(questions, k).select("qid", "key")
        return keyed.join(results.select("qid", "rank", "chunk_id"), "qid", "left").select(
            "key", F.lit(self.mode).alias("mode"), F.lit(self.version).alias("index_version"), F.coalesce("rank", F.lit(0)).alias("rank"), "chunk_id"
        ).distinct()

    def set(self, questions: DataFrame, k: int, results: DataFrame) -> None:
        self.entries(questions, k, results).write.mode("append").parquet(self._path)

    def get_or_compute(self, questions: DataFrame, k: int, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Hits from the table; misses are computed in one batch and added."""
        rows = self._rows()  # as they are before the table grows
        keyed = self.keyed(questions, k)
        hits = keyed.join(rows, "key").where("rank > 0").select("qid", "rank", "chunk_id")
        missing = keyed.join(rows, "key", "left_anti").drop("key").persist()
        try:
            if not missing.limit(1).count():
                return hits
            self.set(missing, k, compute(missing).select("qid", "rank", "chunk_id"))
            return self.get(questions, k)
        finally:
            missing.unpersist()

    def clear(self) -> None:
        fs, path = self.store._file("query_cache")
        fs.delete(path, True)
