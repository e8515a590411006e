"""From results to a bounded context and a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.lexical import bounded

# The budget of a context, the form of its sections, and the answers given without a model.
MAX_CHARACTERS = 12_000
NO_RESULTS = "I could not find relevant information in the retrieved documents."
NO_CONTEXT = "I could not find enough relevant information in the retrieved sources to answer the question."
# End of the fixed values.

RULES = "Answer from the context alone, in a few sentences, and name the sources you used. Say so if the context is not enough."


def resolve(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """spans (file_path, start, end, ...) with id, text and kind of the chunk that is exactly there; none is an error."""
    keys = ["file_path", "start", "end"]
    few = chunks.select(*keys, "id", "text", "kind").join(bounded(spans.select(*keys).distinct()), keys, "left_semi")  # texts of other chunks don't move
    joined = spans.join(few, keys, "left")
    missing = F.raise_error(F.concat(F.lit("no chunk at "), F.concat_ws(" ", *keys)))
    return joined.withColumn("id", F.coalesce("id", missing))


def section() -> Column:
    return F.concat(F.lit("Source: "), F.col("file_path"), F.lit("\n"), F.col("text"))


def build_context(ranked: DataFrame, most: int = MAX_CHARACTERS) -> DataFrame:
    """(qid, n, context) of ranked chunks (qid, rank, file_path, text): sections in order, parted by blank lines, up to
    the first that doesn't fit. Lengths are positive, so a running sum finds it."""
    if most <= 0:
        raise ValueError("the budget must be positive")
    until = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = ranked.withColumn("section", section()).withColumn("used", F.sum(F.length("section") + 2).over(until) - 2)
    kept = sized.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("used") <= most, F.struct("rank", "section")))).alias("sections"))
    parts = F.transform("sections", lambda s: s["section"])
    return kept.select("qid", F.size("sections").cast("long").alias("n"), F.array_join(parts, "\n\n").alias("context"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(f"{RULES}\n\n# Context\n\n"), context, F.lit("\n\n# Question\n\n"), question, F.lit("\n\n# Answer\n\n"))


def answer_messages(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, status, answer): the fixed answer where nothing was found or nothing fits, else a prompt for a model."""
    joined = questions.join(contexts, "qid", "left")
    fixed = F.when(F.col("context").isNull(), NO_RESULTS).when(F.trim("context") == "", NO_CONTEXT)
    return joined.select("qid", F.when(fixed.isNull(), "prompt").otherwise("fixed").alias("status"), fixed.alias("answer"), F.when(fixed.isNull(), prompt(F.col("question"), F.col("context"))).alias("prompt"))
