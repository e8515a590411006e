"""Operator 4, SentencePiece encoding and decoding.

The model file gives pieces with scores. An Aho-Corasick automaton over the pieces reads a text once;
at each position its output links name the pieces that end there, longest first, and each relaxes the
best score of that position (Viterbi). The best segmentation has the highest sum of scores; of equal
ones, that whose last piece is longest. A character in no piece becomes its UTF-8 byte pieces (where the
model has them) at the score of an unknown piece, the lowest score less 10.

The file at hand was trained as BPE; its scores (minus the merge rank) are used as they are, as a
unigram model's, which is what the method asks for. Its ids therefore are those of the greatest sum
of scores, not those of BPE merging.

No piece has a space after another character, so the best path of a text is that of its segments
(spaces, then other characters), and frequent segments are kept in a bounded cache. A model with
such a piece is run over whole texts instead.

Odd input: a null text has null ids, and they decode to null; an empty text has none and decodes to the
empty text. U+2581 in a text decodes to a space, as it does in the library.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments that each generation of a worker's cache holds, and their greatest length.
CACHED, CACHED_LENGTH = 150_000, 48
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, raw[at : at + n]
        at += n


class Model:
    """Pieces, scores and flags of a SentencePiece model file, with its automaton."""

    def __init__(self, raw: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.prefix, self.squeeze, self.unk = True, True, 0
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2):
                    raise ValueError("models with a character map aren't supported")
                self.prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unk = self.kinds.index(UNKNOWN)
        scores = [s for s, k in zip(self.scores, self.kinds) if k == NORMAL]
        self.unk_score = min(scores) - 10
        self.segmented = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, k in zip(self.pieces, self.kinds) if k in (NORMAL, USER))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.spellings = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds)]

    @cached_property
    def automaton(self):
        """Pieces with (length, score, id); made when the first text is encoded."""
        import ahocorasick

        automaton, most = ahocorasick.Automaton(), max(s for s, k in zip(self.scores, self.kinds) if k == NORMAL)
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind in (NORMAL, USER):
                automaton.add_word(piece, (len(piece), self.scores[i] if kind == NORMAL else len(piece) * most - 0.1, i))
        automaton.make_automaton()
        return automaton

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of normalised text."""
        n = len(text)
        score, back, piece = [0.0] + [None] * n, [0] * (n + 1), [self.unk] * (n + 1)
        current, shortest = 0, 1  # the position whose pieces are being seen, longest first, and the last one's length

        def settle(first: int, last: int) -> None:
            """Positions whose character is no piece by itself: it may be unknown; pieces win ties."""
            for at in range(first, last + 1):
                reached = score[at - 1] + self.unk_score
                if score[at] is None or reached > score[at]:
                    score[at], back[at], piece[at] = reached, at - 1, self.unk

        for last, (length, own, i) in self.automaton.iter(text):
            end = last + 1
            if end != current:
                if shortest != 1 or last != current:
                    settle(current + (shortest == 1), last)
                current = end
            reached = score[end - length] + own
            held = score[end]
            if held is None or reached > held:  # longer pieces win ties
                score[end], back[end], piece[end] = reached, end - length, i
            shortest = length
        settle(current + (shortest == 1), n)
        ids: list[int] = []
        at = n
        while at:
            start = back[at]
            if piece[at] == self.unk and self.bytes:
                ids += [self.bytes[b] for b in reversed(text[start:at].encode())]
            else:
                ids.append(piece[at])
            at = start
        return ids[::-1]

    def normalised(self, text: str) -> str:
        text = text.replace(SPACE, " ")
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return " " + text if self.prefix and text else text

    def encode(self, text: str) -> bytes:
        """Ids of a text, as 32-bit integers."""
        text = self.normalised(text)
        if not self.segmented:
            return np.array(self.best(text.replace(" ", SPACE)), np.int32).tobytes()
        out, young = [], self.young
        for segment in re.findall(" *[^ ]+| +", text):
            ids = young.get(segment)
            if ids is None:
                ids = self.old.get(segment)
                if ids is None:
                    ids = np.array(self.best(segment.replace(" ", SPACE)), np.int32).tobytes()
                if len(segment) <= CACHED_LENGTH:
                    if len(young) >= CACHED:
                        self.old, self.young = young, {}
                        young = self.young
                    young[segment] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.spellings.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_models: dict[int, Model] = {}


def _model(raw: bytes) -> Model:
    """The worker's model; its tables are built once per Python process."""
    if (key := hash(raw)) not in _models:
        _models[key] = Model(raw)
    return _models[key]


def _with_columns(df: DataFrame, made: dict[str, str], make, source: str) -> DataFrame:
    """df with columns more (or in place of those of their names), made from another's Arrow array."""
    kept = [c for c in df.columns if c not in made]
    frame = df.select(*[df[c] for c in kept], df[source].alias("_q_source"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != "_q_source"), *(f"`{n}` {k}" for n, k in made.items())])

    def add(batches):
        for batch in batches:
            *rest, column = batch.columns
            yield pa.RecordBatch.from_arrays([*rest, *make(column)], names=[*batch.schema.names[:-1], *made])

    common.bounded_arrow(df.sparkSession)
    return frame.mapInArrow(common.lean(add), schema)


def _encoded(model: Model, texts: pa.Array) -> pa.Array:
    found = [None if t is None else model.encode(t) for t in texts.to_pylist()]
    ends = np.cumsum([0, *(len(x) // 4 if x else 0 for x in found)])
    flat = pa.array(np.frombuffer(b"".join(x for x in found if x), np.int32))
    none = np.array([x is None for x in found], bool)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array(none) if none.any() else None)


def _decoded(model: Model, ids: pa.Array) -> pa.Array:
    bounds, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    return pa.array([None if no else model.decode(flat[a:b].tolist()) for no, a, b in zip(ids.is_null().to_pylist(), bounds, bounds[1:])], pa.string())


def encode(df: DataFrame, column: str = "text", into: str = "ids", model: str = MODEL) -> DataFrame:
    """df with the ids of a text column. The model file (half a MB) is read by the driver and sent along."""
    raw = Path(model).read_bytes()
    return _with_columns(df, {into: "array<int>"}, lambda texts: [_encoded(_model(raw), texts)], column)


def decode(df: DataFrame, column: str = "ids", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with the text that a column of ids stands for; ids out of range raise IndexError."""
    raw = Path(model).read_bytes()
    return _with_columns(df, {into: "string"}, lambda ids: [_decoded(_model(raw), ids)], column)


def round_trip(df: DataFrame, column: str = "text", into: str = "ids", back: str = "decoded", model: str = MODEL) -> DataFrame:
    """As encode() and then decode(), in one pass."""
    raw = Path(model).read_bytes()

    def both(texts: pa.Array) -> list[pa.Array]:
        ids = _encoded(_model(raw), texts)
        return [ids, _decoded(_model(raw), ids)]

    return _with_columns(df, {into: "array<int>", back: "string"}, both, column)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, and whether decoding them gives the text again (U+2581 counts as a space)."""
    docs = common.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = round_trip(docs)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), common.sha_hex(F.col("decoded")).alias("decoded_sha256"), (F.col("decoded") == F.translate("text", SPACE, " ")).alias("same"))


@common.shielded
def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, and whether these decode to the text again."""
    found = round_trip(docs.withColumn("text", F.coalesce("text", F.lit(""))), into="piece_ids", back="_q_decoded")
    return found.withColumns({"n_pieces": F.size("piece_ids").cast("long"), "decodes": F.col("_q_decoded") == F.translate("text", SPACE, " ")}).drop("_q_decoded")
