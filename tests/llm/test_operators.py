"""Each operator against brute force, and on odd input."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, graph, langid, lines, lm, media, mixing, neardup, pieces, pii, repeats, topk


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# -- 1 repeats


def brute_repeats(docs):
    seen, out = set(), []
    for _, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        out.append((len(raw), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [20_000, 2])
def test_repeats(spark, most):
    rng = random.Random(5)
    bases = ["".join(rng.choice("abc é") for _ in range(400)) for _ in range(5)]
    docs = [(i, "".join(b[a : a + rng.randint(0, 260)] for b in rng.choices(bases, k=3) for a in [rng.randint(0, 300)])) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a" * 3000), (103, "a" * 99), (104, "ab" * 300), (105, "a" * 100)]
    found = repeats.remove_repeats(common.keyed(spark.createDataFrame(docs, "doc_id long, text string")), most).orderBy("key").collect()
    assert [(r.n_bytes, len(r.starts), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found] == brute_repeats(docs)


def test_repeats_odd(odd, none):
    found = repeats.remove_repeats(common.keyed(odd))
    assert ids(found) == ids(odd) and repeats.remove_repeats(common.keyed(none)).count() == 0
    long = {r.doc_id: r for r in found.where("doc_id in (7, 8)").collect()}
    assert len(long[7].kept) == 1 and len(long[8].kept) == 5


# -- 2 lines


def brute_lines(docs, depth=lines.DEPTH, least=lines.MIN_DOCS, share=lines.CONSTANT, exact=False):
    mask = lambda t: re.sub("[^ ]*[0-9][^ ]*", lines.FIELD, t)
    rows = []
    for key, text in docs:
        for i, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" \t\r\f\v")
            if line:
                rows.append((key, i, mask(line), (line.count(" ") + 1, mask(" ".join(line.split(" ")[:depth])))))
    leaf_docs, token_docs = {}, {}
    for key, _, line, leaf in rows:
        leaf_docs.setdefault(leaf, set()).add(key)
        for p, t in enumerate(line.split(" ")):
            token_docs.setdefault((leaf, p, t), set()).add(key)
    held = {}
    for key, i, line, leaf in rows:
        if len(leaf_docs[leaf]) < least:
            continue
        tokens = line.split(" ")
        stays = [t if len(token_docs[leaf, p, t]) >= least else None for p, t in enumerate(tokens)]
        template = (leaf, tuple(stays)) if sum(s is not None for s in stays) >= share * len(tokens) else line
        held.setdefault(template, []).append((key, i))
    gone = {}
    for places in held.values():
        keys = {k for k, _ in places}
        if len(keys) >= least:
            for k, i in places:
                if k != min(keys):
                    gone.setdefault(k, set()).add(i)
    first = {}
    for k, t in sorted(docs) if exact else ():
        for i, x in enumerate((t or "").split("\n")):
            if (x := x.strip(" \t\r\f\v")) and first.setdefault(x, t) != t:
                gone.setdefault(k, set()).add(i)
    return {k: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone.get(k, ())) for k, t in docs}


def test_lines(spark, some):
    made = [(10_000 + i, f"Order {i} of user u{i}x was shipped by hand\n{"abcdefgh"[i] * 3} stands only here\nFor the terms please contact {'abcdefgh'[i]} of this office") for i in range(8)]
    docs = some.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    found = lines.line_dedup(common.keyed(docs))
    assert dict(texts(found)) == brute_lines(texts(docs))
    kept = {r.doc_id: r.text for r in found.where("doc_id >= 10000").collect()}
    assert kept[10_000] == made[0][1] and "Order" not in kept[10_003] and "contact" not in kept[10_003] and "ddd stands" in kept[10_003]


def test_exact_lines(spark, some, tmp_path):
    """The queries drop a line from its second document on, besides recurring templates; the stage counts equal documents as one."""
    made = [(10_001, "own a\nshared by two  \nown b"), (10_000, "first\n\tshared by two\nshared by two"), (10_002, "Shared by two\nshared by"), (10_003, "shared by two")]
    docs = some.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stripped = lambda t: [x.strip(" \t\r\f\v") for x in t.split("\n")]
    first, by_template = {}, brute_lines(texts(docs))
    rows = sorted((k, t or "") for k, t in texts(docs))
    for k, t in rows:
        for x in stripped(t):
            first.setdefault(x, t)
    kept = lambda t: Counter(x for x in stripped(t) if x)
    found = {r.doc_id: r.text for r in lines.line_stage(spark, docs, "").collect()}
    want = {k: kept("\n".join(x for x in by_template[k].split("\n") if first.get(x.strip(" \t\r\f\v")) in (t, None))) for k, t in rows}
    assert {k: kept(t) for k, t in found.items() if kept(t)} == {k: c for k, c in want.items() if c}
    assert found[10_000] == made[1][1] and found[10_001] == "own a\nown b" and found[10_002] == made[2][1] and 10_003 not in found
    assert {r.doc_id: r.n_dropped for r in lines.op2_line_dedup(spark, str(tmp_path)).where("doc_id >= 10000").collect()} == {10_000: 0, 10_001: 1, 10_002: 0, 10_003: 1}


def test_lines_odd(spark, odd, none):
    for df in (odd, none):
        assert ids(lines.line_dedup(common.keyed(df))) == ids(df)
    staged = lines.line_stage(spark, odd, "")
    assert staged.columns == odd.columns and staged.count() == odd.count()


# -- 3 media


def test_media(some, odd, none):
    for df in (some, odd, none):
        rows = media.media_columns(media.store_media(df)).collect()
        want = Counter((d, *media.brute(t).values()) for d, t in texts(df))
        got = Counter((r.doc_id, r.n_bytes, len(r.samples), hashlib.sha256(r.samples).hexdigest(), media.brute(None)["tail_crc32"] if r.n_bytes == 0 else __import__("zlib").crc32(r.samples[-64:])) for r in rows)
        assert got == want
        assert all(sum(r.hist_r) == sum(r.hist_g) == sum(r.hist_b) for r in rows)


def test_gif_rules():
    red, green, blue, grey = [255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]
    palette = np.array([grey, red, green, blue], np.uint8)
    full = np.full((4, 4), 1, np.uint8)
    part = np.array([[2, 0], [0, 2]], np.uint8)
    frames = [
        media.Frame(full, delay_cs=5), media.Frame(part, 1, 1, 7, disposal=3, transparent=0), media.Frame(part + 1, 2, 2, 9, disposal=2, palette=np.array([grey, blue, red, green], np.uint8)),
        media.Frame(np.array([[3]], np.uint8), 0, 0, 1, interlaced=True),
    ]
    gif = media.decode(media.encode(media.Gif(4, 4, palette, 0, frames)))
    shown = [(c.copy(), ms) for c, ms in media.render(gif)]
    assert [ms for _, ms in shown] == [50, 70, 90, 10]
    assert shown[1][0][1, 1].tolist() == green and shown[1][0][1, 2].tolist() == red  # transparent
    assert shown[2][0][1, 1].tolist() == red and shown[2][0][2, 2].tolist() == green  # restored, local palette
    assert shown[3][0][3, 3].tolist() == grey and shown[3][0][0, 0].tolist() == blue  # cleared
    rows = np.arange(21 * 3, dtype=np.uint8).reshape(21, 3)
    again = media.decode(media.encode(media.Gif(3, 21, media.GREY, 0, [media.Frame(rows, interlaced=True)])))
    assert (again.frames[0].indices == rows).all()


@pytest.mark.parametrize(("symbols", "size"), [(256, 8), (3, 2), (2, 8), (16, 4)])
def test_lzw(symbols, size):
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 300, 5000, 30_000):
        raw = rng.integers(0, symbols, n, dtype=np.uint8).tobytes()
        assert media.lzw_decode(media.lzw_encode(raw, size), size, n) == raw
        assert media.lzw_decode(media.lzw_encode(raw[:n // 2] * 2, size), size, n // 2 * 2) == raw[: n // 2] * 2


def test_lzw_without_clear_codes():
    """A full table stays as it is until a clear code comes: codes of 12 bits go on."""
    raw = np.random.default_rng(3).integers(0, 256, 6000, dtype=np.uint8).tobytes()
    codes, table, w = [256], {bytes([i]): i for i in range(256)}, b""
    for b in raw:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        codes.append(table[w])
        if len(table) + 2 < 4096:
            table[w + bytes([b])] = len(table) + 2
        w = bytes([b])
    codes += [table[w], 257]
    widths = np.concatenate([[9], [min(12, max(9, (257 + i).bit_length())) for i in range(len(codes) - 1)]])
    assert media.lzw_decode(media._pack(np.array(codes, np.int32), widths), 8, len(raw)) == raw


def test_damaged_gifs(spark):
    good = media.payload_gif(b"a" * 64)
    rows = [(1, good), (2, None), (3, b""), (4, good[:50]), (5, b"GIF89a" + b"\0" * 9), (6, good[:-5])]
    found = {r.doc_id: r for r in media.media_columns(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert found[1].error is None and all(found[i].error and found[i].samples is None for i in range(2, 7))


# -- 4 pieces


def brute_pieces(model, text):
    """Best segmentation by trying every piece at every place."""
    table = {}
    for i, (p, k) in enumerate(zip(model.pieces, model.kinds)):
        if k in (pieces.NORMAL, pieces.USER):
            table[p] = (model.scores[i], i)
    longest = max(map(len, table))
    best = [(0.0, ())] + [None] * len(text)
    for end in range(1, len(text) + 1):
        options = [(best[s][0] + table[text[s:end]][0], s, table[text[s:end]][1]) for s in range(max(0, end - longest), end) if text[s:end] in table]
        if not any(s == end - 1 for _, s, _ in options):
            options.append((best[end - 1][0] + model.unk_score, end - 1, None))
        score, s, i = max(options, key=lambda o: (o[0], -o[1]))
        own = (i,) if i is not None else tuple(model.bytes[b] for b in text[s:end].encode())
        best[end] = (score, best[s][1] + own)
    return list(best[-1][1])


def test_pieces(some):
    with open(pieces.MODEL, "rb") as f:
        model = pieces.Model(f.read())
    rng = random.Random(1)
    samples = [t[:200] for _, t in texts(some)[:40]] + ["", " ", "  a  b ", "a\nb\t c", "日本語 テスト😀", "x" * 50, "▁a ▁"] + ["".join(rng.choice("ab é ▁😀the ") for _ in range(30)) for _ in range(60)]
    for text in samples:
        got = np.frombuffer(model.encode(text), np.int32).tolist()
        assert got == brute_pieces(model, model.normalised(text).replace(" ", pieces.SPACE))
        assert model.decode(got) == text.replace(pieces.SPACE, " ")
    with open(pieces.MODEL, "rb") as f:
        rare = pieces.Model(f.read())
    for i, p in enumerate(rare.pieces):  # letters that stand in pieces but are none
        if p in ("e", "a", "n", "▁", "1"):
            rare.kinds[i] = pieces.UNUSED
    for text in samples:
        assert np.frombuffer(rare.encode(text), np.int32).tolist() == brute_pieces(rare, rare.normalised(text).replace(" ", pieces.SPACE))
    model.segmented = False
    assert np.frombuffer(model.encode(samples[0]), np.int32).tolist() == brute_pieces(model, model.normalised(samples[0]).replace(" ", pieces.SPACE))


def test_pieces_odd(spark, odd, none):
    found = pieces.decode(pieces.encode(odd))
    assert found.where("text is null").where("ids is not null or decoded is not null").count() == 0
    assert found.where(F.col("text").isNotNull() & (F.col("decoded") != F.translate("text", pieces.SPACE, " "))).count() == 0
    assert found.where("text = '' and size(ids) <> 0").count() == 0 and ids(found) == ids(odd)
    assert pieces.decode(pieces.encode(none)).count() == 0 and pieces.pieces_stage(spark, odd, "").where("not decodes").count() == 0


# -- 5 pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0

    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                found.append((m.start(), order, m.end()))
    return sorted(found)


def test_base_spans():
    rng = random.Random(4)
    for letters in ("a@.-1", "12. -+()", "@a.b+0", "0123456789 -", "1+ 9.0"):
        for _ in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("5" * 5000) == [] and pii.base_spans("9" * 9000 + ".1.1.1") == []


def test_disclosing_terms(spark):
    """A name that always stands by one address reveals it; words that stand everywhere don't."""
    rows = [(i, f"the meeting number {'abcdefghij'[i]} is led by Zebulon zeb@x.org\nthe other {'abcdefghij'[i] * 3} meeting is led by somebody") for i in range(5)]
    rows += [(10 + i, "the plan of the meeting number is led by nobody " + "abcdefghij"[i % 10] * (4 + i)) for i in range(80)] + [(99, "Zebulon alone reveals nothing here"), (100, None)]
    found = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    terms = [found[0].sanitised.count(w) for w in ("Zebulon", "zeb@x.org", "the ", "led", "[EMAIL]", "[NAME]")]
    assert terms == [0, 0, 2, 2, 1, 1] and found[99].sanitised == rows[-2][1] and found[100].sanitised == ""
    assert [s.split(":")[0] for s in found[0].spans] == ["term", "email"] and found[0].base == [s for s in found[0].spans if s.startswith("email")]


def test_terms_of_rare_entities_disclose(spark):
    """One line with both is enough: the name beside an address that stands once goes, a common word stays."""
    rows = [(1, "the plan was drawn by Quillon at q@x.org\nthen Quillon left the plan"), (2, "write to r@y.org about the plan")]
    rows += [(10 + i, f"the plan was drawn by nobody at {'abcdefghij'[i % 10] * (3 + i)}") for i in range(80)]
    found = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].sanitised == "the plan was drawn by [NAME] at [EMAIL]\nthen [NAME] left the plan"
    assert found[2].sanitised == " to [EMAIL]  the plan" and len(found) == len(rows)
    assert [s.split(":")[0] for s in found[1].spans] == ["term", "email", "term"] and found[10].spans == []


def brute_sanitised(docs, disclosure=pii.DISCLOSURE):
    """(all spans, sanitised text) by document, with counts over all lines of all documents."""
    word = re.compile(r"[A-Za-z\u0080-\U0010ffff]+")
    low = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    value = lambda text, s: (s[1], text[s[0] : s[2]].lower() if s[1] < 2 else re.sub("[^0-9]", "", text[s[0] : s[2]]))
    lines_of, own, both, n_lines = Counter(), Counter(), Counter(), 0
    for _, text in docs:
        at = 0
        for line in (text or "").split("\n"):
            spans = [(a + at, k, b + at) for a, k, b in brute_spans(line)]
            n_lines += at < len(text or "")
            lines_of.update({low(w) for w in word.findall(line)})
            entities = {value(text, s) for s in spans}
            terms = {low(m[0]) for m in word.finditer(text or "", at, at + len(line)) if len(m[0]) >= 3 and not any(a < m.end() and m.start() < b for a, _, b in spans)}
            own.update(entities)
            both.update((e, t) for e in entities for t in terms)
            at += len(line) + 1
    tells = {(e, t) for (e, t), n in both.items() if math.log2(n_lines * n / (lines_of[t] * own[e])) >= disclosure * math.log2(n_lines / own[e]) - 1e-12}
    out = {}
    for key, text in docs:
        spans, text = brute_spans(text or ""), text or ""
        entities = {value(text, s) for s in spans}
        more = [(m.start(), 4, m.end()) for m in word.finditer(text) if len(m[0]) >= 3 and any((e, low(m[0])) in tells for e in entities) and not any(a < m.end() and m.start() < b for a, _, b in spans)]
        every, shown, done = sorted(spans + more), "", 0
        for a, k, b in every:
            if b > done:
                shown += text[done : max(a, done)] + (("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[k] if k < 4 else "[NAME]" if text[a].isupper() else "")
                done = b
        out[key] = [f"{(*pii.KINDS, 'term')[k]}:{a}:{b}" for a, k, b in every], shown + text[done:]
    return out


def test_disclosure_by_brute_force(spark):
    rng = random.Random(11)
    words = ["plan", "Quillon", "met", "the", "Österberg", "on", "day", "with", "report", "Zed", "zebra", "of"]
    rare = [rng.choice("AbCd") + "".join(rng.choices("aeiou", k=4)) for _ in range(60)]
    marks = ["q@x.org", "éQ@X.org", "10.0.0.1", "+49 30 1234567", "4111 1111 1111 1111", "r@y.net"]
    line = lambda: " ".join(rng.choice(marks) if rng.random() < 0.06 else rng.choice(rare) if rng.random() < 0.2 else rng.choice(words[: rng.randint(4, 12)]) for _ in range(rng.randint(0, 9)))
    docs = [(i, "\n".join(line() for _ in range(rng.randint(1, 4)))) for i in range(150)] + [(200, None), (201, ""), (202, "one line\n")]
    docs += [(300 + i, docs[i][1]) for i in range(20)]
    want = brute_sanitised(docs)
    found = {r.doc_id: (list(r.spans), r.sanitised) for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == want
    assert sum(s.startswith("term") for spans, _ in want.values() for s in spans) > 20


def test_pii_odd(odd, none):
    assert ids(pii.sanitise(odd)) == ids(odd) and pii.sanitise(none).count() == 0


# -- 6 mixing


@pytest.mark.parametrize("seed", range(6))
def test_frames_keep_within_a_block(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.choice([1, 1, 3, 50]) * rng.random() + 1e-3 for i in range(rng.randint(1, 12))}
    shares = mixing.shares_of(weights, 200)
    order, total = mixing.frame(shares), sum(shares.values())
    assert total == 200 and Counter(order) == shares
    sent = Counter()
    for t, s in enumerate(order * 2, 1):
        sent[s] += 1
        assert all(abs(sent[x] - Fraction(t * shares[x], total)) < 1 for x in shares)


def brute_order(blocks, shares):
    """Slot by slot, with releases and deadlines measured from each phase's start."""
    sent, out = dict.fromkeys(blocks, 0), []
    while active := [s for s in sorted(blocks) if sent[s] < blocks[s]]:
        start, before, total = len(out), dict(sent), sum(shares[s] for s in active)
        while all(sent[s] < blocks[s] for s in active):
            t = len(out) - start
            ready = [(-(-(sent[s] - before[s] + 1) * total // shares[s]), s) for s in active if (sent[s] - before[s]) * total // shares[s] <= t]
            _, s = min(ready)
            out.append((s, sent[s]))
            sent[s] += 1
    return out


def test_mixing(spark):
    rows = [(i, None if i % 11 == 0 else f"s{min(i % 7, 3)}") for i in range(700)]
    df = common.keyed(spark.createDataFrame(rows, "doc_id long, source string"), ["doc_id", "source"])
    found = mixing.mix(df, {"s0": 5, "s1": 1, "s3": 2, None: 0.5, "unseen": 9}, block=4).orderBy("slot", "place").collect()
    names = {r.source for r in found}
    counts = Counter(r.source for r in found)
    shares = {"=s0": 10, "=s1": 2, "=s3": 4, "null": 1}
    order = brute_order({"null" if s is None else f"={s}": -(-n // 4) for s, n in counts.items() if s != "s2"}, shares)
    order += [("=s2", i) for i in range(-(-counts["s2"] // 4))]  # of no weight: after all others
    got = [(r.slot, "null" if r.source is None else f"={r.source}") for r in found if r.place == 0]
    assert got == [(i, s) for i, (s, _) in enumerate(order)] and len(found) == len(rows)
    assert all([r.doc_id for r in found if r.source == s] == [i for i, x in rows if x == s] for s in names)


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 10_000, "b": 3, "c": 7}, {"a": 0.3, "b": 0.7}, {"a": 1 / 3, "b": 2 / 7, "c": 0.1, "d": 1e-4}])
def test_given_weights_are_kept_to(weights):
    """Over 100,000 slots, each source's blocks are less than one from its exact share of the slots."""
    slots = 100_000
    total = sum(Fraction(str(w)) for w in weights.values())
    sources = mixing.plan(dict.fromkeys(weights, slots), weights, 1 << 17)
    first = [p for p in sources if p["start"] == 0]
    sent = np.zeros((len(first), slots + 1), np.int64)
    for i, p in enumerate(first):
        at = (np.arange(0, slots, p["frame"])[:, None] + np.array(p["slots"])).ravel()
        sent[i, at[at < slots] + 1] = 1
    assert (sent[:, 1:].sum(axis=0) == 1).all()
    exact = {p["source"]: Fraction(str(weights[p["source"]])) / total for p in first}
    rounded = max(p["frame"] for p in first) == 1 << 17
    for row, p in zip(sent.cumsum(axis=1), first):
        w = exact[p["source"]]
        at = np.arange(slots + 1, dtype=object)
        off = np.abs(row.astype(object) * w.denominator - at * w.numerator).max()
        assert off < w.denominator * (2 if rounded else 1)


def test_sparse_and_few_rows_mix(spark):
    """Ids of any spread are numbered alike."""
    dense = [(i, "ab"[i % 3 > 0]) for i in range(90)]
    mixed = lambda rows: [r[0] for r in mixing.mix(common.keyed(spark.createDataFrame(rows, "doc_id long, source string"), ["doc_id", "source"]), block=2).orderBy("slot", "place").select("doc_id").collect()]
    far = lambda i: i * 7_919_000_003 + (1 << 40)
    assert mixed([(far(i), s) for i, s in dense]) == [far(i) for i in mixed(dense)]


def test_mixing_odd(spark, odd, none):
    staged = mixing.mixing_stage(spark, odd, "")
    assert staged.columns == odd.columns and ids(staged) == ids(odd) and mixing.mixing_stage(spark, none, "").count() == 0
    with pytest.raises(ValueError, match="sources"):
        many = spark.range(mixing.MOST_SOURCES + 1).selectExpr("id doc_id", "cast(id as string) source")
        mixing.mix(common.keyed(many, ["doc_id", "source"]))


# -- 7 top-k


def brute_top(rows, k):
    whole = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for n, (q, x) in enumerate(whole):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for m, (i, y) in enumerate(whole) if m != n)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def test_top_k(spark, tmp_path, monkeypatch):
    for name, value in (("SHARD_ROWS", 60), ("LEAST_ROWS", 10), ("BLOCK_ROWS", 3), ("CHUNK", 25), ("SPAN", 7)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[20][1]) for i in range(30)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (320, [0.0] * 6), (340, [1.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {tuple(r) for r in topk.op7_top_k(spark, str(tmp_path)).collect()} == brute_top(rows, 20)


@pytest.mark.parametrize("scale", [1, 1 << 40])
def test_max_score(scale):
    """Chunk by chunk, with thresholds that make terms non-essential; beyond doubles, in whole numbers."""
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (300, 24)) * (rng.random((300, 24)) < 0.4) * scale
    q = rng.integers(-9, 9, (20, 24)) * (rng.random((20, 24)) < 0.5) * (1 if scale == 1 else 1 << 12)
    ids, own = rng.permutation(300), np.array([*range(10), *[-1] * 10])
    for found, v, skipped in zip(topk.max_score(x, ids, own, q, 5, 16), q, own):
        scores = [(-sum(int(a) * int(b) for a, b in zip(row, v)), ids[i]) for i, row in enumerate(x) if i != skipped]
        assert [(-int(s), ids[r]) for r, s in zip(*found)] == sorted(scores)[:5]


def test_top_k_large_values_and_few_rows(spark, tmp_path):
    rows = [(0, [3e6, -2e6]), (1, [1e6, 5e5]), (20, [-1e6, 1e6])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {tuple(r) for r in topk.op7_top_k(spark, str(tmp_path)).collect()} == brute_top(rows, 20)
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    assert topk.op7_top_k(spark, str(tmp_path)).count() == 0


def test_top_k_repeated_ids(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = Counter(tuple(r) for r in topk.op7_top_k(spark, str(tmp_path)).collect())
    assert sum(found.values()) == 9 and found[0, 1, 0, 4096] + found[0, 1, 1, 4096] == 3


# -- 8 lm


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm(some, odd, monkeypatch, order):
    monkeypatch.setattr(lm, "BATCH_BYTES", 60_000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 40_000)
    docs = some.select("doc_id", "text").limit(60).unionByName(odd.where("length(text) < 1000 or text is null").select("doc_id", "text"))
    found = Counter((r.doc_id, round(r.score, 4)) for r in lm.lm_scores(common.keyed(docs), order).collect())
    rows = texts(docs)
    assert found == Counter((d, round(s, 4)) for (d, _), s in zip(rows, lm.brute([t for _, t in rows], order)))


def test_lm_odd(odd, none):
    assert ids(lm.lm_scores(common.keyed(odd))) == ids(odd) and lm.lm_scores(common.keyed(none)).count() == 0


# -- 9 language ID


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learnt, held_out = (docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == i) for i in (0, 1))
    model = langid.fit(learnt.select("doc_id", "lang", "text"), 50)
    held_out = held_out.where("n_chars > 100")
    found = langid.identify(langid.document_rows(held_out, "doc_id"), model).withColumnRenamed("lang", "found").join(held_out, "doc_id")
    right = found.where("found = lang").count() / found.count()
    assert right > 0.98 and found.where("not accepted").count() == 0


def test_language_evidence(spark):
    """Where a text says little, its page's declaration and its host decide."""
    words = {"en": "the and of with this", "de": "der und das nicht ein"}
    labelled = [(i, lang, " ".join(random.Random(i).choices(words[lang].split(), k=30))) for i in range(60) for lang in words]
    model = langid.fit(spark.createDataFrame(labelled, "doc_id long, lang string, text string"))
    pages = [(i, f"http://h{i % 3}.example.de/x", f"<html lang='de'><p>{t}</p></html>") for i, (_, lang, t) in enumerate(labelled) if lang == "de"]
    pages += [(1000 + i, f"http://h{i % 3}.example.com/x", f'<html lang="en"><p>{t}</p></html>') for i, (_, lang, t) in enumerate(labelled) if lang == "en"]
    pages += [(5000, "http://h1.example.de/y", "<html lang=de>q</html>"), (5001, "http://h1.example.com/y", "<html lang=en>q</html>"), (5002, None, None), (5003, "no address", "<html></html>")]
    rows = langid.page_rows(spark.createDataFrame(pages, "page_id long, url string, html string"))
    found = {r.page_id: r for r in langid.identify(rows, model).collect()}
    assert found[5000].lang == "de" and found[5001].lang == "en" and len(found) == len(pages)
    assert not found[5002].accepted and not found[5003].accepted


def brute_fused(pages, model):
    """Posteriors page by page, every sum taken over the other pages."""
    names, table = model
    n = len(names) + 1
    soft = lambda x: np.exp(x - max(x)) / np.exp(x - max(x)).sum()
    fold = lambda b: b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32
    rows = []
    for _, host, suffix, declared, body in pages:
        raw = [fold(b) for b in body.encode()]
        grams = [(a * 40_503 + b * 2_531 + c * 31) % 32_749 for a, b, c in zip(raw, raw[1:], raw[2:]) if not a == b == 32]
        weight = min(len(grams), langid.EFFECTIVE) / max(1, len(grams))
        scores = np.array([*(weight * sum(np.float32(t[g]).astype(float) for g in grams) for t in table), -weight * len(grams) * math.log(langid.BUCKETS)])
        rows.append((host, suffix, declared, scores, soft(scores) if grams else None))
    out = []
    for i, (host, suffix, declared, scores, _) in enumerate(rows):
        others = [r for j, r in enumerate(rows) if j != i and r[4] is not None]
        sums = lambda held: sum((r[4] for r in others if held(r)), np.zeros(n))  # noqa: E731, B023
        smooth = lambda c, parent, k: (c + k * parent) / (c.sum() + k)
        prior = smooth(sums(lambda r: True), np.full(n, 1 / n), n)
        held = [r for r in rows if r[4] is not None]
        if host is not None and any(r[:2] == (host, suffix) for r in held):
            if suffix is not None:
                prior = smooth(sums(lambda r: r[1] == suffix), prior, langid.KAPPA)  # noqa: B023
            prior = smooth(sums(lambda r: r[:2] == (host, suffix)), prior, langid.KAPPA)  # noqa: B023
        said = np.zeros(n)
        if declared is not None and any(r[2] == declared for r in held):
            values = len({r[2] for r in held if r[2] is not None}) + 1
            said = np.log((sums(lambda r: r[2] == declared) + langid.DECLARED) / (sums(lambda r: r[2] is not None) + langid.DECLARED * values))  # noqa: B023
        out.append(soft(scores + np.log(prior) + said))
    return out


def test_language_fusion_by_brute_force(spark):
    words = {"en": "the and of with this that", "de": "der und das nicht ein ist", "fr": "les des une dans pour que"}
    rng = random.Random(4)
    said = lambda lang, n: " ".join(rng.choices(words[lang].split(), k=n))
    model = langid.fit(spark.createDataFrame([(i, lang, said(lang, 20)) for i in range(20) for lang in words], "doc_id long, lang string, text string"))
    pages = [(i, rng.choice(["a.de", "b.de", "c.com", "d", None]), None, rng.choice(["de", "en", "xx", None]), rng.choice([said(rng.choice(list(words)), rng.randint(1, 9)), "", "q z", "\u65e5\u672c"])) for i in range(60)]
    pages = [(i, h, h.split(".")[1] if h and "." in h else None, d, b) for i, h, _, d, b in pages]
    found = langid.identify(spark.createDataFrame(pages, "page_id long, host string, suffix string, declared string, body string"), model).orderBy("page_id").collect()
    names = [*model[0], langid.UND]
    for (_, _, _, _, body), row, p in zip(pages, found, brute_fused(pages, model)):
        rejected = len(body.encode()) < 3 or p[-1] >= langid.REJECT
        want = len(names) - 1 if rejected else int(np.argmax(p[:-1]))
        assert row.lang == names[want] and row.posterior == pytest.approx(p[want], abs=1e-6) and row.accepted == (not rejected)


def test_language_odd(spark, odd, none):
    staged = langid.language_stage(spark, odd, "")
    assert staged.columns == odd.columns and staged.where("text is null or trim(text) = ''").count() == 0
    assert langid.language_stage(spark, none, "").count() == 0


# -- 10 near-duplicates


def brute_components(docs, width):
    sets = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(len(s), docs[r][0]) for s, r in zip(sets, root)]


@pytest.mark.parametrize("width", [4, 5])
@pytest.mark.parametrize("small", [neardup.SMALL_BUCKET, 2])
def test_near_duplicates(spark, monkeypatch, width, small):
    """A hub with copies that are like it and unlike each other, chains, short texts and exact copies."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(width)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(150)]
    docs = []
    for i in range(40):
        own = list(base)
        for p in rng.sample(range(150), rng.randint(1, 9)):
            own[p] = word()
        docs.append((50 - i, " ".join(own)))
    chain = [word() for _ in range(60)]
    for i in range(12):
        docs.append((100 + i, " ".join(chain[: 60 - 3 * i])))
    docs += [(None, " ".join(base)), (200, " ".join(base)), (200, " ".join(base[:140])), (201, " ".join(base).upper()), (300, None), (301, ""), (302, " \n"), (303, "one"), (304, "ONE"), (305, "one two three"), (306, "one two three"), (307, "a b c d e f g h"), (308, "a b c d e f g h i")]
    docs.sort(key=lambda d: (d[0] is None, d[0]))
    found = neardup.near_duplicates(common.keyed(spark.createDataFrame(docs, "doc_id long, text string")), width=width).orderBy("key").collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == Counter((d[0], *r) for d, r in zip(docs, brute_components(docs, width)))


def test_links_beyond_tried_hubs(spark, monkeypatch):
    """A link between two documents that come after many which are first in all their buckets and like neither."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(neardup, "BLOCK", 9)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(200)]
    docs = []
    for i, changes in enumerate([7] * 40 + [0, 2]):  # forty that are first in all buckets and like none, then two that are alike
        own = list(base)
        for p in range(i % 20, 200, 200 // changes)[:changes] if changes else ():
            own[p] = word()
        docs.append((i, " ".join(own)))
    found = neardup.near_duplicates(common.keyed(spark.createDataFrame(docs, "doc_id long, text string"))).orderBy("key").collect()
    assert [(r.n_shingles, r.component_id) for r in found] == brute_components(docs, neardup.WORDS)
    assert found[41].component_id == 40


@pytest.mark.parametrize("width", [4, 5])
def test_few_words_alone(spark, width):
    """A slice or a partition that holds fewer words than a shingle."""
    for text in (b"", b"one", b"one two", b"one two three", b"one two three four"):
        hashes, bounds = neardup.shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), width)
        assert len(hashes) == bounds[-1] == min(1, len(text))
    docs = spark.createDataFrame([(1, "one two"), (2, "One  two")], "doc_id long, text string").repartition(2, "doc_id")
    assert [(r.n_shingles, r.component_id) for r in neardup.near_duplicates(common.keyed(docs), width=width).collect()] == [(1, 1)] * 2


def test_near_duplicates_odd(spark, odd, none):
    found = neardup.near_duplicates(common.keyed(odd))
    assert ids(found) == ids(odd) and neardup.near_duplicates(common.keyed(none)).count() == 0
    staged = neardup.near_dedup_stage(spark, odd, "")
    assert staged.columns == odd.columns and ids(staged) == ids(odd) - Counter({6: 1, 5: 1})


def test_estimates():
    rng = np.random.default_rng(1)
    for n, share in ((30, 0.8), (400, 0.8), (3000, 0.5)):
        errors = []
        for _ in range(30):
            both = int(2 * n * share / (1 + share))
            every = common.mix(rng.integers(0, 1 << 62, 2 * n - both).astype(np.uint64))
            a, b = np.sort(every[:n]), np.sort(every[n - both :])
            r = neardup.registers(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            near, _ = neardup.likely((r[0], np.uint32(n)), (r[1], np.uint32(n)), 80)
            errors.append(near - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    root = {x: x for p in links for x in p}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {x for x in root if all(a == b for a, b in links if x in (a, b))}
    assert found == {x: r for x, r in root.items() if x not in alone}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
