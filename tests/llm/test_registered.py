"""The registered queries on whole small tables, down to their digest columns, against brute force."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import pytest
from test_operators import PATTERNS, brute_components, brute_repeats, brute_spans

from quarry.llm import lm, media, mixing, queries

DATA = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())


def rows(spark, name):
    return sorted(queries.QUERIES[name](spark, DATA).collect(), key=lambda r: (r.doc_id is None, r.doc_id))


def test_op1(spark, docs):
    got = [(r.doc_id, r.n_bytes, r.n_spans, r.kept_sha256) for r in rows(spark, "op1_repeats")]
    assert got == [(d, n, spans, kept) for (d, _), (n, spans, kept) in zip(docs, brute_repeats(docs))]


def test_op3(spark, docs):
    found, seen = rows(spark, "op3_media"), {}
    assert [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found] == [(d, *media.brute(t).values()) for d, t in docs]
    for (_, text), r in zip(docs, found):
        gif = media.payload_gif((text or "").encode().ljust(64, b"\0") + b"\0" * (-max(64, len((text or "").encode())) % 64))
        assert (r.media_bytes, r.media_sha256) == (len(gif), hashlib.sha256(gif).hexdigest())
        shown = [(c, ms) for c, ms in media.render(media.decode(gif))]
        assert r.n_frames == len(shown) and r.duration_ms == sum(ms for _, ms in shown) and r.feature.startswith(f"gif:{r.n_frames}:{r.duration_ms}:")
        assert seen.setdefault(text, r.feature) == r.feature


def test_op4(spark, docs):
    from quarry.llm import pieces

    with open(pieces.MODEL, "rb") as f:
        model = pieces.Model(f.read())
    for (d, text), r in zip(docs, rows(spark, "op4_sentencepiece")):
        assert r.doc_id == d and r.same and r.n_pieces == len(r.ids) and model.decode(r.ids) == text.replace(pieces.SPACE, " ")
        assert r.decoded_sha256 == sha(model.decode(r.ids))


def test_op5(spark, docs):
    for (d, text), r in zip(docs, rows(spark, "op5_pii")):
        base = [f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in brute_spans(text or "")]
        assert (r.doc_id, r.base_sha256) == (d, sha(",".join(base)))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in PATTERNS]
        assert Counter(x for x in r.spans.split(",") if x and not x.startswith("term")) == Counter(base)


def test_op6(spark, docs):
    found = sorted(rows(spark, "op6_mixing"), key=lambda r: (r.slot, r.place))
    sizes = Counter(r.source for r in found)
    shares = mixing.shares_of({s: n**mixing.TEMPERATURE for s, n in sizes.items()})
    assert sorted(r.doc_id for r in found) == [d for d, _ in docs] and len({(r.slot, r.place) for r in found}) == len(found)
    order = [(r.slot, r.source) for r in found if r.place == 0]
    assert [i for i, _ in order] == list(range(len(order)))
    sent, total = Counter(), sum(shares.values())
    for i, s in order:
        if any(sent[x] == -(-sizes[x] // mixing.BLOCK) for x in sizes):
            break  # a source has run out: the others' shares grow
        sent[s] += 1
        assert all(abs(sent[x] - Fraction((i + 1) * shares[x], total)) < 1 for x in sizes)


def test_op8(spark, docs):
    found = rows(spark, "op8_lm_scores")
    want = lm.brute([t for _, t in docs])
    assert [(r.doc_id, r.score) for r in found] == [(d, pytest.approx(s, abs=1e-4)) for (d, _), s in zip(docs, want)]
    assert all(r.n_words == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for (_, t), r in zip(docs, found))


def test_op9(spark, docs):
    found = queries.QUERIES["op9_language_id"](spark, DATA)
    pages = spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert found.where("doc_id is not null").count() == len(docs) and found.where("page_id is not null").count() == pages
    known = found.join(spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars > 100").select("doc_id", "lang").withColumnRenamed("lang", "want"), "doc_id")
    assert known.where("lang = want").count() >= 0.98 * known.count()


def test_op10(spark, docs):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows(spark, "op10_near_dedup")]
    assert got == [(d, n, c, c == d) for (d, _), (n, c) in zip(docs, brute_components(docs, 4))]
