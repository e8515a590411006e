"""Recall of retrieved spans against the expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.errors import EvaluationError
from quarry.functions import ranking

# The cutoffs that are reported.
CUTOFFS = (1, 3, 5, 10)
# End of the fixed values.


def matches(expected: DataFrame, retrieved: DataFrame, least: float = ranking.MIN_IOU) -> DataFrame:
    """(qid, result_id, number, rank): expected spans (qid, number, file_path, start, end) that retrieved ones
    (qid, result_id, rank, file_path, start, end) overlap enough. Only spans of one file and question meet."""
    a, b = expected.alias("a"), retrieved.alias("b")
    overlap = ranking.overlap(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    joined = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.file_path") == F.col("b.file_path")))
    return joined.where(overlap >= least).select("a.qid", "b.result_id", "a.number", "b.rank", overlap.alias("iou"))


def recall_at(expected: DataFrame, retrieved: DataFrame, results: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(k, questions, recall): over the results (qid, result_id) whose question has expected spans, the mean share of
    these found in the first k. All cutoffs in one pass: what counts is a span's best rank."""
    best = matches(expected, retrieved).groupBy("qid", "result_id", "number").agg(F.min("rank").alias("rank"))
    asked = results.select("qid", "result_id").distinct().join(expected.select("qid", "number"), "qid")
    ranked = asked.join(best, ["qid", "result_id", "number"], "left")
    found = [F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"f{k}") for k in cutoffs]
    each = ranked.groupBy("qid", "result_id").agg(F.count("*").alias("n"), *found)
    means = each.agg(F.count("*").alias("questions"), *[F.avg(F.col(f"f{k}") / F.col("n")).alias(f"f{k}") for k in cutoffs])
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col("questions"), F.col(f"f{k}").alias("recall")) for k in cutoffs]))
    return means.select(rows)


def evaluate(expected: DataFrame, retrieved: DataFrame, results: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> dict[int, float]:
    """recall_at as a dictionary; an error where there is nothing to compare."""
    if not expected.limit(1).count():
        raise EvaluationError("no answered questions with sources")
    rows = recall_at(expected, retrieved, results, cutoffs).collect()
    if not rows[0]["questions"]:
        raise EvaluationError("no result belongs to an answered question")
    return {r["k"]: r["recall"] for r in rows}
