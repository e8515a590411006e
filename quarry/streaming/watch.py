"""New files as a stream: each micro-batch is chunked and its terms are counted; latest() puts the batches together and
numbers chunks over all of them. A stream tells files by their paths: it sees neither deletions nor new content at an
old path, so a pass over the whole tree stays the way to find these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions import text
from quarry.operators import chunking, lexical
from quarry.sources import files


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)
    named = raw.select(files.relative(F.col("path"), root).alias("file_path"), "content").where(files.wanted(F.col("file_path")))
    return named.select("file_path", text.decoded(F.col("content")).alias("content"))


def watch(spark: SparkSession, root: str, folder: str, size: int = chunking.MAX_CHUNK) -> StreamingQuery:
    """Appends chunks and term frequencies of what arrives below root, each batch once: a batch's files lie in a folder of
    its number, which a second try of the batch replaces."""

    def append(batch: DataFrame, number: int) -> None:
        batch.select("file_path").distinct().write.mode("overwrite").parquet(f"{folder}/files/batch={number}")
        chunking.chunk_files(batch, size).write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")
        chunks = spark.read.parquet(f"{folder}/chunks/batch={number}").withColumn("ordinal", F.lit(0).cast("long"))
        lexical.term_frequencies(lexical.token_rows(chunks)).drop("ordinal").write.mode("overwrite").parquet(f"{folder}/terms/batch={number}")

    stream = file_stream(spark, root).writeStream.foreachBatch(append).option("checkpointLocation", f"{folder}/_progress")
    return stream.trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, postings) of all batches, as a pass over the same files has them. Should a path come twice (after the
    stream's own progress was lost), its last batch counts."""
    files, chunks, terms = (spark.read.parquet(f"{folder}/{name}") for name in ("files", "chunks", "terms"))
    last = files.groupBy("file_path").agg(F.max("batch").alias("batch"))
    held = chunking.with_ordinals(chunks.join(last, ["file_path", "batch"], "left_semi").drop("batch"))
    named = chunks.join(last, ["file_path", "batch"], "left_semi").select(F.col("id").alias("chunk_id"), "batch")
    return held, terms.join(named, ["chunk_id", "batch"], "left_semi").join(held.select(F.col("id").alias("chunk_id"), "ordinal"), "chunk_id").select("term", "chunk_id", "ordinal", "tf")
