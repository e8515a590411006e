"""Operator 5, PII by information-theoretic sanitisation.

Base detectors find the protected entities (email, ip, card, phone). Corpus co-occurrence then
estimates how much of an entity e a term t reveals: over lines as contexts, with N of them,
IC(e) = log2(N / c(e)) is what there is to know, and PMI(t, e) = log2(N * c(t, e) / (c(t) * c(e)))
is what t tells of it. A term with PMI >= disclosure * IC is disclosing, however few lines hold the
two: in documents that hold e it is generalised to its class (capitalised: [NAME]) or else removed;
the entities become [EMAIL] and the like. A term of an entity's only line is thus disclosing if it
stands in (N / c(e)) ** (1 - disclosure) lines at most.

Odd input: a null or empty text has no spans. Each copy of a line is a context of its own, for the
entity, the term and both. A corpus without entities has no pairs, so nothing is disclosing.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

KINDS = ("email", "ip", "card", "phone")
DISCLOSURE = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: The least number of characters of a term.
LEAST_TERM = 3


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """Leftmost matches: the characters before an @, then the domain; each @ is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    double = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (double + sum(map(int, digits[-1::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds, sorted; code points, end exclusive."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _print(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def entity_of(text: str, start: int, kind: int, end: int) -> int:
    """A fingerprint of the protected value: its letters lower-cased, its digits without separators."""
    value = text[start:end]
    return _print(KINDS[kind], value.lower() if kind < 2 else _digits(value))


def _flagged(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold a digit or an @: no other can have a base span."""
    marks = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
    first = np.searchsorted(marks, at)
    return first[1:] > first[:-1]


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, fingerprint) of a text's words, runs of ASCII letters and of characters beyond ASCII; code points."""
    raw = np.frombuffer(text.encode(), np.uint8)
    bounds = np.array([0, len(raw)])
    starts, ends = common.runs(raw, bounds, common.LETTERS)
    prints, _ = common.words(raw, bounds, common.LETTERS)
    place = np.cumsum((raw & 0xC0) != 0x80)
    return place[starts] - 1, place[ends - 1], prints.view(np.int64)


def _free(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words are terms: of LEAST_TERM characters at least, and apart from all spans."""
    free = ends - starts >= LEAST_TERM
    for a, _, b in spans:
        free[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b, side="left")] = False
    return free


_LINE = pa.struct([("entities", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64()))])


def entity_docs(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text, entities, terms, lines) of the documents that hold an entity: terms are all of the
    document's words, lines those with an entity, each with its entities and the terms beside them."""

    def find(batches):
        for batch in batches:
            data, at = common.text_bytes(batch.column(2))
            held, entities, words, found = [], [], [], []
            for i in np.flatnonzero(_flagged(data, at)).tolist():
                text = batch.column(2)[i].as_py()
                spans, lines = base_spans(text), defaultdict(list)
                if not spans:
                    continue
                for span in spans:
                    lines[text.rfind("\n", 0, span[0]) + 1].append(span)
                starts, ends, prints = _words(text)
                terms, rows = np.where(_free(starts, ends, spans), prints, 0), []
                for start, here in lines.items():
                    end = text.find("\n", start)
                    end = len(text) if end < 0 else end
                    own = terms[np.searchsorted(starts, start) : np.searchsorted(starts, end)]
                    rows.append({"entities": list({entity_of(text, *s) for s in here}), "terms": np.unique(own[own != 0]).tolist()})
                held.append(i)
                entities.append(list({e for row in rows for e in row["entities"]}))
                words.append(np.unique(prints))
                found.append(rows)
            own = batch.take(pa.array(held, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*own.columns[:2], own.column(2).cast(pa.string()), *[pa.array(x, pa.list_(pa.int64())) for x in (entities, words)], pa.array(found, pa.list_(_LINE))],
                names=["key", "doc_id", "text", "entities", "terms", "lines"],
            )

    schema = "key long, doc_id long, text string, entities array<long>, terms array<long>, lines array<struct<entities: array<long>, terms: array<long>>>"
    return docs.select("_q_key", "doc_id", "text").mapInArrow(common.lean(find), schema)


def line_counts(docs: DataFrame) -> DataFrame:
    """(term, lines): in how many lines of the whole corpus a term stands; the row of the null term
    counts all lines. Counted per batch, then summed."""

    def count(batches):
        for batch in batches:
            data, at = common.text_bytes(batch.column(0))
            for a, b in common.slices(at):
                part, bounds = data[at[a] : at[b]], at[a : b + 1] - at[a]
                ends = np.flatnonzero(part == 10) + 1
                lines = np.unique(np.concatenate([bounds, ends]))
                prints, owned = common.words(part, lines, common.LETTERS)
                prints = prints.view(np.int64)
                of = common.spread(owned)
                order = np.lexsort((of, prints))
                prints, of = prints[order], of[order]
                new = np.ones(len(prints), bool)
                new[1:] = (prints[1:] != prints[:-1]) | (of[1:] != of[:-1])
                found, n = np.unique(prints[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([None, *found.tolist()], pa.int64()), pa.array([max(0, len(lines) - 1), *n.tolist()], pa.int64())
                ], names=["term", "lines"])

    return docs.select("text").mapInArrow(common.lean(count), "term long, lines long").groupBy("term").agg(F.sum("lines").alias("lines"))


def disclosing(docs: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term) pairs whose term reveals at least that share of the entity."""
    rows = found.select(F.inline("lines")).select(F.explode("entities").alias("entity"), "terms")
    entities = rows.groupBy("entity").agg(F.count("*").alias("own"))
    pairs = rows.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("both"))
    counts = common.pinned(line_counts(docs))
    all_lines = float(counts.where("term is null").first()["lines"] or 0)
    joined = pairs.join(counts.where("term is not null").hint("merge"), "term").join(entities.hint("merge"), "entity")
    pmi = F.log2(F.lit(all_lines) * F.col("both") / (F.col("lines") * F.col("own")))
    return common.pinned(joined.where(pmi >= disclosure * F.log2(F.lit(all_lines) / F.col("own"))).select("entity", "term"))


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(doc_id, base, spans, sanitised): spans as arrays of kind:start:end; ``term`` follows the base kinds.

    A document is given those of its own words alone that disclose one of its entities, so that an entity
    of many documents isn't multiplied by all of its terms."""
    common.bounded_arrow(docs.sparkSession)
    keyed = common.keyed(docs)
    found = common.pinned(entity_docs(keyed))
    if not found.limit(1).count():
        return keyed.select("doc_id", *[F.array().cast("array<string>").alias(c) for c in ("base", "spans")], F.col("text").alias("sanitised"))
    hidden = disclosing(keyed, found, disclosure)
    own = found.select("key", F.explode("entities").alias("entity"), "terms").select("key", "entity", F.explode("terms").alias("term"))
    own = own.join(hidden.hint("merge"), ["entity", "term"], "left_semi").groupBy("key").agg(F.collect_set("term").alias("hidden"))
    held = found.select("key", "doc_id", "text").join(own.hint("merge"), "key", "left").select("doc_id", "text", "hidden")

    def rewrite(batches):
        for batch in batches:
            bases, spans, texts = [], [], []
            for text, terms in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                base, more = base_spans(text), []
                if terms:
                    starts, ends, prints = _words(text)
                    hit = np.isin(prints, np.array(terms, np.int64)) & _free(starts, ends, base)
                    more = [(a, len(KINDS), b) for a, b in zip(starts[hit].tolist(), ends[hit].tolist())]
                names = (*KINDS, "term")
                every = sorted(base + more)
                bases.append([f"{names[k]}:{a}:{b}" for a, k, b in base])
                spans.append([f"{names[k]}:{a}:{b}" for a, k, b in every])
                texts.append(_replaced(text, every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.list_(pa.string())) for x in (bases, spans)], pa.array(texts, pa.string())], names=["doc_id", "base", "spans", "sanitised"])

    def others(batches):
        for batch in batches:
            data, at = common.text_bytes(batch.column(1))
            free = np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(_flagged(data, at)).tolist():
                free[i] = not base_spans(batch.column(1)[i].as_py())
            own = batch.filter(pa.array(free))
            none = pa.array([[]] * own.num_rows, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([own.column(0), none, none, own.column(1).cast(pa.string())], names=["doc_id", "base", "spans", "sanitised"])

    schema = "doc_id long, base array<string>, spans array<string>, sanitised string"
    return held.mapInArrow(common.lean(rewrite), schema).unionByName(keyed.select("doc_id", "text").mapInArrow(common.lean(others), schema))


def _replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, done = [], 0
    for a, kind, b in spans:
        if b <= done:
            continue
        out.append(text[done : max(a, done)])
        out.append(f"[{KINDS[kind].upper()}]" if kind < len(KINDS) else "[NAME]" if text[a].isupper() else "")
        done = b
    return "".join([*out, text[done:]])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(common.read(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s.startswith(f"{kind}:"))).cast("long")
    return found.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in KINDS], common.sha_hex(F.array_join("base", ",")).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_term"), common.sha_hex(F.col("sanitised")).alias("sanitised_sha256"),
    )
