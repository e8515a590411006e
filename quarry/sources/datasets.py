"""Question sets, search results and answers as JSON documents."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry import schemas
from quarry.errors import DatasetError


def _read(spark: SparkSession, path: str, schema: StructType, field: str) -> DataFrame:
    try:
        raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
        bad = raw.where(F.col("_corrupt").isNotNull() | F.col(field).isNull()).limit(1).count()
        rows = raw.limit(1).count()
    except Exception as e:
        raise DatasetError(f"can't read {path}: {str(e)[:300]}") from e
    if bad or not rows:
        raise DatasetError(f"{path} is not a document with {field}")
    return raw


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, sources, answer); a question without an id gets one, answered questions have sources and an answer."""
    rows = _read(spark, path, schemas.DATASET, "rag_questions").select(F.explode("rag_questions").alias("q"))
    if rows.where("q.question is null").limit(1).count():
        raise DatasetError(f"{path} holds a question without text")
    return rows.select(F.coalesce("q.question_id", F.uuid()).alias("qid"), "q.question", "q.sources", "q.answer")


def expected_spans(questions: DataFrame) -> DataFrame:
    """(qid, number, file_path, start, end) of answered questions. Of rows that repeat an id, the last counts."""
    answered = questions.where("sources is not null and answer is not null")
    ordered = answered.withColumn("_order", F.monotonically_increasing_id())
    last = ordered.groupBy("qid").agg(F.max_by("sources", "_order").alias("sources"))
    spans = last.select("qid", F.posexplode("sources").alias("number", "s"))
    return spans.select("qid", "number", F.col("s.file_path").alias("file_path"), F.col("s.first_character_index").alias("start"), F.col("s.last_character_index").alias("end"))


def load_search_results(spark: SparkSession, path: str) -> DataFrame:
    """(result_id, qid, question, rank, file_path, start, end, k); a result without spans has one row without a rank."""
    raw = _read(spark, path, schemas.SEARCH_RESULTS, "search_results")
    rows = raw.select("k", F.posexplode("search_results").alias("result_id", "r")).select("k", "result_id", "r.question_id", "r.question", F.posexplode_outer("r.retrieved_sources").alias("at", "s"))
    return rows.select(
        "result_id", F.col("question_id").alias("qid"), "question", (F.col("at") + 1).alias("rank"),
        F.col("s.file_path").alias("file_path"), F.col("s.first_character_index").alias("start"), F.col("s.last_character_index").alias("end"), "k",
    )


def nested_results(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """(question_id, question, retrieved_sources): spans in the order of their rank, none if nothing was found."""
    span = F.struct("rank", F.struct("file_path", F.col("start").cast("int").alias("first_character_index"), F.col("end").cast("int").alias("last_character_index")).alias("s"))
    lists = ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(span)), lambda x: x["s"]).alias("retrieved_sources"))
    joined = questions.join(lists, "qid", "left")
    none = F.array().cast(f"array<{schemas.SPAN}>")
    return joined.select(F.coalesce("qid", F.uuid()).alias("question_id"), "question", F.coalesce("retrieved_sources", none).alias("retrieved_sources"))


def save_results(results: DataFrame, k: int, source_path: str, folder: str) -> str:
    """Writes {search_results, k} as one JSON document, named as the question set. One document is one
    value, so its rows pass through the driver, one at a time."""
    spark = results.sparkSession
    target = f"{folder.rstrip('/')}/{PurePosixPath(source_path).name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(b'{"search_results": [')
        for i, row in enumerate(results.toLocalIterator()):
            out.write((", " * bool(i) + json.dumps(row.asDict(recursive=True), ensure_ascii=False)).encode())
        out.write(f'], "k": {k}}}'.encode())
    finally:
        out.close()
    return target


def flat_results(results: DataFrame) -> DataFrame:
    rows = results.select("question_id", "question", F.posexplode("retrieved_sources").alias("at", "s"))
    return rows.select("question_id", "question", (F.col("at") + 1).alias("rank"), "s.*")


