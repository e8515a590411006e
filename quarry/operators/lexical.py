"""The lexical index: postings and statistics as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import ranking, text
from quarry.operators import tokens


@dataclass(frozen=True)
class LexicalIndex:
    postings: DataFrame  # term, chunk_id, ordinal, tf
    term_stats: DataFrame  # term, df, idf
    doc_stats: DataFrame  # chunk_id, ordinal, dl
    corpus_stats: DataFrame  # n_docs, avgdl: one row
    held: tuple[DataFrame, ...] = ()  # what is kept in memory for it
    packed: tuple[DataFrame, list[str]] | None = None  # the same postings, a row for each chunk, with the terms by number
    segments: DataFrame | None = None  # the same postings and lengths, inverted for some thousand chunks each

    def release(self) -> None:
        for table in self.held:
            table.unpersist()

    def numbers(self) -> tuple[int, float]:
        row = self.corpus_stats.first()
        return row["n_docs"], row["avgdl"]


def token_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, ordinal, term): a row for each token."""
    return text.token_rows(chunks.select(F.col("id").alias("chunk_id"), "ordinal", "text"))


def term_frequencies(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("term", "chunk_id", "ordinal").agg(F.count("*").alias("tf"))


def document_lengths(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """Every chunk's number of tokens, also those without any, from rows (ordinal, tf) of any grain."""
    sums = counts.groupBy("ordinal").agg(F.sum("tf").alias("dl"))
    return chunks.select(F.col("id").alias("chunk_id"), "ordinal").join(sums, "ordinal", "left").select("chunk_id", "ordinal", F.coalesce("dl", F.lit(0)).alias("dl"))


def document_frequencies(postings: DataFrame, n_docs: int) -> DataFrame:
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", ranking.idf(F.lit(n_docs), F.col("df")))


def corpus(doc_stats: DataFrame) -> DataFrame:
    return doc_stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def of_segments(segments: DataFrame, term_stats: DataFrame, corpus_stats: DataFrame) -> LexicalIndex:
    """The index whose postings and lengths stand in segments."""
    lengths = segments.select(F.inline(F.arrays_zip(F.col("chunk_ids").alias("chunk_id"), F.col("ordinals").alias("ordinal"), F.col("dls").alias("dl"))))
    return LexicalIndex(tokens.segment_postings(segments), term_stats, lengths, corpus_stats, segments=segments)


def segment_frequencies(segments: DataFrame, n_docs: int) -> DataFrame:
    """document_frequencies from what each segment counted."""
    return tokens.term_counts(segments).groupBy("term").agg(F.sum("n").alias("df")).withColumn("idf", ranking.idf(F.lit(n_docs), F.col("df")))


def build(chunks: DataFrame, postings: DataFrame | None = None) -> LexicalIndex:
    """The index of chunks (id, ordinal, text), everything derived from the postings, which may be given where they
    are stored already. The number of chunks goes into the idf as a constant."""
    if postings is None:
        rows = tokens.packed(chunks)
        postings, doc_stats = tokens.unpacked(rows, "chunk_id", "ordinal"), rows.select("chunk_id", "ordinal", "dl")
    else:
        doc_stats = document_lengths(chunks, postings)
    return LexicalIndex(postings, document_frequencies(postings, chunks.count()), doc_stats, corpus(doc_stats))


def build_for(chunks: DataFrame, terms: DataFrame) -> LexicalIndex:
    """As build(), but with the postings of the given terms (a column ``term``) only. One pass over the text: each chunk
    gives one row, of its length and its counts of these terms, without a shuffle. These rows are kept in memory until
    release(). More terms than a task may hold are joined instead."""
    wanted = terms.select("term").distinct()
    vocabulary = [r[0] for r in wanted.limit(MOST_BROADCAST + 1).collect()]
    if len(vocabulary) > MOST_BROADCAST:
        return _build_for_many(chunks, wanted)
    rows = tokens.packed(chunks, vocabulary).persist()
    stats = corpus(rows).persist()
    n_docs = stats.first()["n_docs"]
    numbers = numbered(chunks.sparkSession, vocabulary)
    postings = tokens.unpacked(rows, "ordinal", "chunk_id", "dl").withColumnRenamed("term", "_term").join(F.broadcast(numbers), "_term").select("ordinal", "chunk_id", "dl", "term", "tf")
    counts = rows.select(F.explode("terms").alias("_term")).groupBy("_term").agg(F.count("*").alias("df"))
    known = counts.join(F.broadcast(numbers), "_term").select("term", "df", ranking.idf(F.lit(n_docs), F.col("df")).alias("idf")).persist()
    return LexicalIndex(postings, known, rows.select("chunk_id", "ordinal", "dl"), stats, (rows, stats, known), (rows, vocabulary))


def numbered(spark: SparkSession, vocabulary: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(vocabulary)), "_term int, term string")


def packed_for(index: LexicalIndex, vocabulary: list[str]) -> DataFrame:
    """Packed rows from an index's postings of the vocabulary: these go to their chunks, which then meet their lengths
    once each. A posting of a chunk without a length is an error."""
    wanted = numbered(index.postings.sparkSession, vocabulary)
    hits = index.postings.join(F.broadcast(wanted), "term")
    lists = hits.groupBy("chunk_id", "ordinal").agg(F.collect_list(F.struct("_term", "tf")).alias("l"))
    lengths = index.doc_stats.select("chunk_id", "dl")
    unknown = F.raise_error(F.lit("a posting of an unknown chunk")).cast("long")
    return lists.join(lengths, "chunk_id", "left").select("chunk_id", "ordinal", F.coalesce("dl", unknown).alias("dl"), F.col("l._term").alias("terms"), F.col("l.tf").alias("tfs"))


def _build_for_many(chunks: DataFrame, terms: DataFrame) -> LexicalIndex:
    wanted = terms.withColumn("held", F.col("term"))
    counts = token_rows(chunks).join(wanted, "term", "left").groupBy("ordinal", "chunk_id", "held").agg(F.count("*").alias("tf")).persist()
    n_docs = chunks.count()
    total = counts.agg(F.sum("tf")).first()[0] or 0
    stats = chunks.sparkSession.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(total / n_docs if n_docs else 0.0).alias("avgdl"))
    whole = Window.partitionBy("ordinal")  # a chunk's rows: at most one more than there are terms
    postings = counts.withColumn("dl", F.sum("tf").over(whole)).where("held is not null").select("ordinal", "chunk_id", "dl", F.col("held").alias("term"), "tf").persist()
    known = document_frequencies(postings, n_docs).persist()
    return LexicalIndex(postings, known, document_lengths(chunks, counts), stats, (counts, postings, known))


#: A table of at most so many narrow rows may be broadcast.
MOST_BROADCAST = 200_000


def bounded(table: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """The table, to be broadcast if it is counted to be small; else it is left to a shuffle."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
