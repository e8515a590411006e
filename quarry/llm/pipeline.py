"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and tokenising, each over all that
the stage before has kept. Between stages the documents are Parquet files in the shared folder; a stage's
input goes once its output is written, but for the last one, which the result is read from and which goes when the
driver ends.

Odd input is that of the stages: null and empty texts are in no language and go; rows that repeat an id are
documents of their own; null ids stay; an empty table gives an empty result with the same columns; other
columns are carried whatever their names, those of internal names too.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common
from quarry.llm.langid import language_stage
from quarry.llm.lines import line_stage
from quarry.llm.mixing import mixing_stage
from quarry.llm.neardup import near_dedup_stage
from quarry.llm.pieces import pieces_stage

STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: Fitted models and automata aren't SQL; tests hold each stage against brute force instead.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str, at_end: bool = False) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_end:
        fs.deleteOnExit(path)
    else:
        fs.delete(path, True)


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over the given documents; sf_dir holds the other tables."""
    folder, before = f"{common.checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(now := f"{folder}/{i}-{name}")
            docs = spark.read.parquet(now)
            if before:
                _delete(spark, before)
            else:
                _delete(spark, folder, at_end=True)
            before = now
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    return run_on(spark, common.read(spark, sf_dir, "documents"), sf_dir)
