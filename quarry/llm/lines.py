"""Operator 2, line dedup by a log-template tree. DataFrame functions only.

Each non-blank line goes down a tree of fixed depth: its token count, then its ``DEPTH`` leading tokens
(tokens with a digit count as the field ``<*>``). In a leaf that lines of ``min_docs`` documents reach,
a token stays in its place if as many of the leaf's documents have it there; the rest are variable
fields and become ``<*>``. If at least ``CONSTANT`` of a line's tokens stay, that is its template;
otherwise its template is the line itself with its digit fields masked. Lines of a template
that ``min_docs`` documents hold are dropped, but for those of the first document (by id) that has it.
The queries also drop, by the same rule, lines that two documents hold as they are, whatever their
leaf: a generalised template needs more documents than an equal line to be told from chance. For this
the pipeline's stage counts equal documents as one, so that they stay equal, and near-dedup takes them out.

Tokens are what single spaces part, in lines stripped of leading and trailing spaces, tabs and the like. Odd input: a
null or empty text has no lines and stays empty; blank lines stay; equal ids are documents of
their own, ordered by text hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

DEPTH = 3
MIN_DOCS = 5
CONSTANT = 0.6
FIELD = "<*>"


def _masked(tokens: Column) -> Column:
    return F.when(tokens.rlike("[0-9]"), F.regexp_replace(tokens, r"[^ ]*[0-9][^ ]*", FIELD)).otherwise(tokens)


def line_rows(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(_q_key, line_no, line, leaf) of the non-blank lines."""
    rows = docs.select("_q_key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    rows = rows.select("_q_key", "line_no", F.btrim("raw", F.lit(" \t\r\f\v")).alias("line")).where("line <> ''")
    tokens = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return rows.withColumn("leaf", F.xxhash64(tokens, _masked(F.substring_index("line", " ", depth))))


def _recurring(rows: DataFrame, by: list[str], min_docs: int) -> DataFrame:
    """The groups that ``min_docs`` documents hold, with the first such document; counted in two steps, so
    that a group of any size is summed up before it is moved."""
    return rows.groupBy(*by, "_q_key").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("*").alias("docs"), F.min("_q_key").alias("first")).where(F.col("docs") >= min_docs)


def templates(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_q_key, line_no, template) of the lines in leaves that min_docs documents reach."""
    rows = line_rows(docs, depth)
    leaves = common.pinned(_recurring(rows.select("leaf", "_q_key"), ["leaf"], min_docs).select("leaf"))
    held = common.pinned(rows.join(common.small(leaves), "leaf").withColumn("line", _masked(F.col("line"))))
    tokens = held.select("leaf", "_q_key", "line_no", F.posexplode(F.split("line", " ", -1)).alias("place", "token"))
    constant = _recurring(tokens.withColumn("token", F.xxhash64("token")), ["leaf", "place", "token"], min_docs).select("leaf", "place", "token", F.lit(True).alias("stays"))
    marked = tokens.withColumn("token", F.xxhash64("token")).join(constant, ["leaf", "place", "token"], "left")
    per_line = marked.groupBy("_q_key", "line_no").agg(
        F.sum(F.when(F.col("stays"), 1).otherwise(0)).alias("n_constant"), F.count("*").alias("n"),
        F.sum(F.when(F.col("stays"), F.xxhash64("place", "token")).otherwise(0).cast("decimal(38,0)")).alias("constants"),
    )
    generalised = F.xxhash64(F.lit("template"), F.col("leaf"), F.col("n_constant"), F.col("constants"))
    own = F.xxhash64(F.lit("line"), F.col("line"))
    joined = held.join(per_line, ["_q_key", "line_no"])
    return joined.select("_q_key", "line_no", F.when(F.col("n_constant") >= CONSTANT * F.col("n"), generalised).otherwise(own).alias("template"))


def exact_lines(docs: DataFrame, own: Column) -> DataFrame:
    """(_q_key, line_no) of the lines that an earlier document has as they are; own: a long, the same for documents that count as one."""
    rows = docs.select("_q_key", own.alias("own"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    rows = rows.select("_q_key", "own", "line_no", F.btrim("raw", F.lit(" \t\r\f\v")).alias("line")).where("line <> ''")
    rows = rows.select("_q_key", "own", "line_no", F.xxhash64("line").alias("line"))
    shared = rows.groupBy("line").agg(F.min_by("own", "_q_key").alias("first"), F.min("own").alias("least"), F.max("own").alias("most")).where("least <> most").select("line", "first")
    return common.pinned(rows.join(shared.hint("merge"), "line").where("own <> first").select("_q_key", "line_no"))


def dropped_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, exact: Column | None = None) -> DataFrame:
    """(_q_key, gone): the numbers of the lines to drop, for each document that has any."""
    same = None if exact is None else exact_lines(docs, exact)
    found = common.pinned(templates(docs, depth, min_docs))
    recurring = common.small(_recurring(found, ["template"], min_docs))
    rows = found.join(recurring, "template").where("_q_key <> first").select("_q_key", "line_no")
    rows = rows if same is None else rows.unionByName(same)
    return common.pinned(rows.groupBy("_q_key").agg(F.collect_set("line_no").alias("gone")))


def line_dedup(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, exact: Column | None = None) -> DataFrame:
    """docs (with _q_key and text) with recurring lines taken out of ``text``, plus _q_lines and _q_gone (counts);
    exact: also those that two documents have as they are, which differ in this."""
    gone = dropped_lines(docs, depth, min_docs, exact).toDF("_q_own", "_q_numbers")
    joined = docs.join(gone.hint("merge"), F.col("_q_key") == F.col("_q_own"), "left")
    lines = F.split("text", "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_q_numbers")), lambda i: lines[i])
    text = F.when(F.col("_q_numbers").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(F.col("text") == "", 0).otherwise(F.size(lines))
    counts = {"_q_lines": n_lines.cast("long"), "_q_gone": F.coalesce(F.size("_q_numbers"), F.lit(0)).cast("long")}
    return joined.withColumns(counts).withColumn("text", text).drop("_q_numbers", "_q_own")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.keyed(common.read(spark, sf_dir, "documents"))
    return line_dedup(docs, exact=F.col("_q_key")).select("doc_id", F.col("_q_lines").alias("n_lines"), F.col("_q_gone").alias("n_dropped"), common.sha_hex(F.col("text")).alias("kept_sha256"), F.length("text").cast("long").alias("n_chars"))


@common.shielded
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those left without any text go."""
    rows = common.keyed(docs.withColumn("text", F.coalesce("text", F.lit(""))), docs.columns)
    found = line_dedup(rows, exact=F.xxhash64("text")).where((F.col("_q_gone") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)
