"""Operator 9, language ID by Bayesian evidence fusion.

log P(language | row) adds up, besides a constant, the tempered log-likelihood of the text's byte trigrams,
the log-likelihood of the language its markup declares, and the log prior of its host. Priors are
smoothed down a hierarchy, all corpus -> address suffix -> host, and like P(declared | language) come out
of grouped aggregates of every row's text-only posterior, from each of which the row's own posterior is taken
off, so that no row is its own evidence. The class ``und`` (text spread evenly over all
trigrams) stands for what is no language; a row is accepted unless that class has a posterior of
``REJECT`` or the row has no text.

The trigram model alone is fitted on a sample: of each language the labelled rows whose ids' hashes are in the
share that gives ``SAMPLE`` rows on average, all rows of a language that has fewer. Everything else covers all
rows. A language takes 128 KB in the model; more than ``MOST_LANGUAGES`` of them are refused with an error.

Odd input: null or empty text is never accepted and gets ``und`` from no text evidence; a null host has
the corpus's prior; a missing declaration adds nothing; ties go to the first language by name.
Without labelled rows every row is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

SAMPLE = 1_000
MOST_LANGUAGES = 1_000
BUCKETS = 1 << 15
#: Trigrams of a text overlap and repeat: it counts as this many independent ones at most.
EFFECTIVE = 60.0
#: Pseudo-counts of a parent's prior, and of a declaration.
KAPPA, DECLARED = 10.0, 0.5
REJECT = 0.9
UND = "und"

_FOLD = np.full(256, 32, np.int64)
_FOLD[0x80:] = np.arange(0x80, 256)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of each text, and the n+1 offsets of each text's."""
    folded = _FOLD[data]
    if len(folded) < 3:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    code = (folded[:-2] * 40_503 + folded[1:-1] * 2_531 + folded[2:] * 31) % 32_749
    inside = np.ones(len(code), bool)
    for back in (1, 2):
        at = bounds[1:-1] - back
        inside[at[(at >= 0) & (at < len(code))]] = False
    blank = (folded[:-2] == 32) & (folded[1:-1] == 32)
    inside &= ~blank
    kept = np.concatenate([[0], np.cumsum(inside)])
    return code[inside], kept[np.minimum(bounds, len(code))]


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log P(bucket | language)) from (doc_id, lang, text)."""
    labelled = labelled.where("lang is not null and lang <> '' and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    if sizes.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    rows = labelled.join(F.broadcast(sizes), "lang").where(place * F.col("rows") < sample)

    def count(batches):
        for batch in batches:
            data, at = common.text_bytes(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)
            code, bounds = _trigrams(data, at)
            of = langs[common.spread(bounds)]
            for name in set(langs.tolist()):
                n = np.bincount(code[of == name], minlength=1)
                yield pa.RecordBatch.from_arrays([pa.array([name] * np.count_nonzero(n)), pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["lang", "bucket", "n"])

    found = rows.select("lang", "text").mapInArrow(common.lean(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    names = sorted(set(found["lang"]))
    counts = np.full((len(names), BUCKETS), 0.2)
    place = {x: i for i, x in enumerate(names)}
    np.add.at(counts, ([place[x] for x in found["lang"]], found["bucket"]), found["n"])
    return names, np.log(counts / counts.sum(axis=1, keepdims=True))


def text_scores(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """rows (other columns, then ``body``) with (trigrams, scores) in place of body: tempered
    log-likelihoods of the languages in order, then of und."""
    _, table = model
    table = table.astype(np.float32)
    kept = [f for f in rows.schema if f.name != "body"]

    def score(batches):
        for batch in batches:
            data, at = common.text_bytes(batch.column(len(kept)))
            counts, out = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(table) + 1))
            for a, b in common.slices(at):
                code, bounds = _trigrams(data[at[a] : at[b]], at[a : b + 1] - at[a])
                n = np.diff(bounds)
                counts[a:b] = n
                weight = np.minimum(n, EFFECTIVE) / np.maximum(n, 1)
                for i, own in enumerate(table):
                    sums = np.concatenate([[0.0], np.cumsum(own[code], dtype=np.float64)])
                    out[a:b, i] = (sums[bounds[1:]] - sums[bounds[:-1]]) * weight
                out[a:b, -1] = -np.log(BUCKETS) * n * weight
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts), flat], names=[*batch.schema.names[:-1], "trigrams", "scores"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "trigrams long, scores array<double>"])
    common.bounded_arrow(rows.sparkSession)
    return rows.select(*[f.name for f in kept], "body").mapInArrow(common.lean(score), schema)


def _softmax(scores: Column) -> Column:
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """rows of (own columns, host, suffix, declared, body) as (own columns, lang, posterior, accepted)."""
    names = [*model[0], UND]
    n = len(names)
    own = [c for c in rows.columns if c not in ("host", "suffix", "declared", "body")]
    scored = common.pinned(text_scores(rows.select(*own, "host", "suffix", "declared", "body"), model))
    soft = scored.where("trigrams > 0").select("host", "suffix", "declared", _softmax(F.col("scores")).alias("p"))
    # each posterior sums to 1, so that a group's rows are its sums' total
    sums = lambda: [F.count("*").alias("rows"), *[F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(n)]]
    counted = lambda name: F.struct(F.array(*[F.col(f"c{i}") for i in range(n)]).alias("sums"), F.col("rows").cast("double").alias("rows")).alias(name)
    all_rows, *every = (x or 0.0 for x in soft.agg(*sums()).first())
    suffixes = soft.where("suffix is not null").groupBy("suffix").agg(*sums()).select(F.col("suffix").alias("_q_suffix"), counted("of_suffix"))
    hosts = soft.where("host is not null").groupBy("host", "suffix").agg(*sums()).select(F.col("host").alias("_q_host"), "suffix", counted("of_host"))
    hosts = common.pinned(hosts.join(common.small(suffixes), F.col("suffix") == F.col("_q_suffix"), "left").select("_q_host", F.col("suffix").alias("_q_suffix"), "of_host", "of_suffix"))
    declared = common.pinned(soft.where("declared is not null").groupBy("declared").agg(*sums()).select("declared", counted("of_declared")))
    seen = declared.agg(F.count("*").alias("values"), *[F.sum(F.col("of_declared.sums")[i]).alias(f"c{i}") for i in range(n)]).first()
    values = seen["values"] + 1

    joined = scored.join(common.small(hosts), (F.col("host") == F.col("_q_host")) & F.col("suffix").eqNullSafe(F.col("_q_suffix")), "left").join(common.small(declared), "declared", "left")
    text = F.col("trigrams") > 0  # such a row is in all sums
    joined = joined.withColumn("p", F.when(text, _softmax(F.col("scores"))).otherwise(F.array_repeat(F.lit(0.0), n)))
    rest = lambda counts: F.zip_with(counts, F.col("p"), lambda c, x: F.greatest(c - x, F.lit(0.0)))

    def smoothed(counts: Column, rows: Column, parent: Column, weight: float) -> Column:
        return F.zip_with(rest(counts), parent, lambda c, x: (c + weight * x) / (rows - text.cast("double") + weight))

    top = smoothed(F.array(*[F.lit(float(x)) for x in every]), F.lit(float(all_rows)), F.array_repeat(F.lit(1.0 / n), n), float(n))
    above = F.when(F.col("of_suffix").isNull(), top).otherwise(smoothed(F.col("of_suffix.sums"), F.col("of_suffix.rows"), top, KAPPA))
    prior = F.when(F.col("of_host").isNull(), top).otherwise(smoothed(F.col("of_host.sums"), F.col("of_host.rows"), above, KAPPA))
    whole = rest(F.array(*[F.lit(seen[f"c{i}"] or 0.0) for i in range(n)]))
    said = F.zip_with(rest(F.col("of_declared.sums")), whole, lambda c, of: F.log((c + DECLARED) / (of + DECLARED * values)))
    said = F.when(F.col("of_declared").isNull(), F.array_repeat(F.lit(0.0), n)).otherwise(said)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    joined = joined.select(*own, "trigrams", "scores", F.transform(prior, lambda x: F.log(x)).alias("prior"), said.alias("said"))
    fused = add(add(F.col("scores"), F.col("prior")), F.col("said"))
    found = joined.select(*own, "trigrams", fused.alias("fused")).select(*own, "trigrams", _softmax(F.col("fused")).alias("p"))
    known = F.slice("p", 1, n - 1)
    best = F.array_position(known, F.array_max(known)).cast("int")
    none = (F.col("trigrams") == 0) | (F.col("p")[n - 1] >= REJECT)
    lang = F.when(none, UND).otherwise(F.array(*[F.lit(x) for x in names])[F.coalesce(best, F.lit(n)) - 1])
    posterior = F.when(none | best.isNull(), F.col("p")[n - 1]).otherwise(F.array_max(known))
    return found.select(*own, lang.alias("lang"), posterior.alias("posterior"), (lang != UND).alias("accepted"))


def document_rows(docs: DataFrame, key: str = "_q_key") -> DataFrame:
    """Documents, of which the source stands for the host."""
    none = F.lit(None).cast("string")
    return docs.select(key, F.col("source").cast("string").alias("host"), none.alias("suffix"), none.alias("declared"), F.coalesce(F.col("text"), F.lit("")).alias("body"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Web pages: their text without markup, the language that <html> declares, host and suffix of the address."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    said = F.regexp_extract("html", r"(?i)<html\b[^>]*\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^<>]*>", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.when(host.contains("."), F.regexp_extract(host, r"([^.]+)\.?$", 1)).alias("suffix"),
        F.when(said != "", F.lower(said)).alias("declared"), F.coalesce(body, F.lit("")).alias("body"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and of every web page; one of doc_id and page_id is null."""
    docs, pages = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "pages")
    model = fit(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text"))
    rows = document_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source"), "doc_id").unionByName(page_rows(pages), allowMissingColumns=True)
    return identify(rows, model).select("doc_id", "page_id", "lang", F.round("posterior", 6).alias("posterior"), "accepted")


@common.shielded
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language; all columns as they came."""
    model = fit(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text"))
    rows = common.keyed(docs, docs.columns)
    found = common.pinned(identify(document_rows(rows), model).select("_q_key", "accepted"))  # else the condition is worked out at each step below
    rejected = found.where(~F.col("accepted")).select("_q_key")
    return rows.join(common.small(rejected), "_q_key", "left_anti").select(*docs.columns)
