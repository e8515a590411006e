"""Text functions as column expressions, so that they stay in the JVM and next to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens, their least length, and the words that prose drops.
MIN_TOKEN = 2
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "else", "of", "in", "on", "to", "for", "with", "by", "as", "is",
    "it", "this", "that", "these", "those", "be", "are", "was", "were", "from", "at", "into", "your", "you", "we", "our",
    "i", "me", "my", "do", "does", "did", "have", "has", "had", "can", "will", "would", "should",
)
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+(?:\.\p{Nd}+)?"
# Where a name's parts meet: between a small letter or digit and a capital, and before the last capital of a run
# that a small letter follows.
_HUMP = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
# End of the fixed values.


def not_blank(text: Column) -> Column:
    """Whether there is any character but Unicode white space."""
    return text.rlike(r"(?U)\S")


def _valid(token: Column) -> Column:
    return (F.length(token) >= MIN_TOKEN) & ~token.rlike("^_+$")


def _parts(raw: Column) -> Column:
    """An identifier whole, then its parts, lower-cased."""
    return F.concat(F.array(F.lower(raw)), F.split(F.lower(F.regexp_replace(raw, _HUMP, "_")), "_+"))


def tokenize(text: Column) -> Column:
    """Lower-cased tokens in order, with repeats. Names with an underscore or an inner capital also give
    their parts and skip the stop words; null and empty text give no tokens."""

    def expand(raw: Column) -> Column:
        # lower-casing ASCII tells an inner capital without a regular expression; prose has no underscore
        lowered, rest = F.lower(raw), F.substring(raw, 2, 2**31 - 1)
        name = raw.contains("_") | (rest != F.lower(rest))
        prose = F.when((F.length(lowered) >= MIN_TOKEN) & ~lowered.isin(*STOPWORDS), F.array(lowered)).otherwise(F.array().cast("array<string>"))
        return F.when(name, F.filter(_parts(raw), _valid)).otherwise(prose)

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), expand))


def token_rows(rows: DataFrame, column: str = "text") -> DataFrame:
    """rows with one row for each token, ``term``, in place of the text column: the tokens of tokenize(), without their
    order. Flat columns instead of nested arrays, so that all but the extraction itself is generated code."""
    kept = [c for c in rows.columns if c != column]
    raws = rows.select(*kept, F.explode(F.regexp_extract_all(F.col(column), F.lit(TOKEN), F.lit(0))).alias("_raw"))
    rest = F.substring("_raw", 2, 2**31 - 1)
    raws = raws.withColumn("_name", F.col("_raw").contains("_") | (rest != F.lower(rest)))
    whole = F.array(F.lower("_raw"))
    tokens = raws.select(*kept, "_name", F.explode(F.when(F.col("_name"), _parts(F.col("_raw"))).otherwise(whole)).alias("term"))
    term = F.col("term")
    held = (F.length(term) >= MIN_TOKEN) & F.when(F.col("_name"), ~term.rlike("^_+$")).otherwise(~term.isin(*STOPWORDS))
    return tokens.where(held).select(*kept, "term")


def cache_key(question: Column, k: Column) -> Column:
    """Fingerprint of a question, in any case and spacing, and its k."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(question), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.sha2(F.concat(plain, F.lit("::"), k.cast("string")), 256)


def decoded(content: Column) -> Column:
    """UTF-8 bytes as text: invalid ones become U+FFFD, all line ends a line feed."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("_", path, start.cast("string"), end.cast("string"))


def suffix(path: Column) -> Column:
    """The lower-cased extension of a path's last part; a leading dot alone makes none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+(\.[^.]+)$", 1))


# -- the same tokens in SQL for DuckDB, whose regular expressions have no lookaround --------------------


def tokens_sql(source: str, prefix: str = "") -> str:
    """CTEs ending in ``{prefix}tokens(id, pos, token)`` from a query with id and text."""
    words = ", ".join(f"'{w}'" for w in STOPWORDS)
    p = prefix
    return f"""
{p}source AS ({source}),
{p}raws AS (SELECT id, unnest(r) AS raw, generate_subscripts(r, 1) AS i
         FROM (SELECT id, regexp_extract_all(text, '{TOKEN}') AS r FROM {p}source)),
{p}lists AS (SELECT id, i, CASE
    WHEN contains(raw, '_') OR regexp_matches(substr(raw, 2), '[A-Z]') THEN list_filter(
        list_concat([lower(raw)], regexp_split_to_array(lower(regexp_replace(regexp_replace(raw, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '_+')),
        lambda t: length(t) >= {MIN_TOKEN} AND NOT regexp_matches(t, '^_+$'))
    WHEN length(raw) >= {MIN_TOKEN} AND NOT lower(raw) IN ({words}) THEN [lower(raw)]
    ELSE [] END AS l FROM {p}raws),
{p}flat AS (SELECT id, i, unnest(l) AS token, generate_subscripts(l, 1) AS j FROM {p}lists),
{p}tokens AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, j) - 1 AS pos, token FROM {p}flat)"""
