"""Operator 3, media columns in GIF: LZW code streams, palettes, disposal, transparency, timed frames.

``encode`` and ``decode`` are a full GIF89a writer and reader (any minimum code size, interlacing,
local palettes, deferred clear codes, several sub-blocks); ``render`` composes the frames on the
canvas; ``store_media`` and ``media_columns`` are the DataFrame operators around them.

Odd input: a null or empty text is a payload of 64 zero bytes. A null or damaged GIF gives null frame
columns and its reason in ``error``. Equal payloads give equal files, so ties need no rule.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

WIDTH = 64
#: Rows of one frame at most; a longer payload becomes further frames.
FRAME_ROWS = 1024
DELAY_CS = 10
BINS = 16
_CHUNK = 4096


@dataclass
class Frame:
    indices: np.ndarray  # height x width
    left: int = 0
    top: int = 0
    delay_cs: int = 0
    disposal: int = 0  # 0, 1: leave; 2: clear to background; 3: restore what was there before
    transparent: int | None = None
    palette: np.ndarray | None = None  # n x 3, local
    interlaced: bool = False


@dataclass
class Gif:
    width: int
    height: int
    palette: np.ndarray | None
    background: int = 0
    frames: list[Frame] = field(default_factory=list)


GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


# -- LZW ---------------------------------------------------------------------------------------------


def _widths(min_size: int, first: int, n: int) -> np.ndarray:
    """Bits of the codes number first.. after a clear code: enough for the next free table entry."""
    free = (1 << min_size) + 1 + np.arange(first, first + n)
    return np.clip(np.frexp(free.astype(np.float64))[1], min_size + 1, 12).astype(np.int64)


_schedules: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _schedule(min_size: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and starting bits of the next codes; beyond a full table all are 12 bits wide."""
    first = min(first, _CHUNK)
    if (min_size, first) not in _schedules:
        widths = _widths(min_size, first, _CHUNK)
        _schedules[min_size, first] = widths, np.concatenate([[0], np.cumsum(widths)])
    return _schedules[min_size, first]


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    out, rest = [], np.zeros(0, np.uint8)
    place = np.arange(12)
    for i in range(0, len(codes), 1 << 15):
        bits = ((codes[i : i + (1 << 15), None] >> place) & 1).astype(np.uint8)
        bits = np.concatenate([rest, bits[place < widths[i : i + (1 << 15), None]]])
        whole = len(bits) // 8 * 8
        out.append(np.packbits(bits[:whole], bitorder="little").tobytes())
        rest = bits[whole:]
    out.append(np.packbits(rest, bitorder="little").tobytes())
    return b"".join(out)


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """The code stream of data: clear code, codes with a clear code whenever the table is full, end code."""
    clear = 1 << min_size
    codes, cuts = [clear], []
    if data:
        table: dict[int, int] = {}
        get, put = table.get, codes.append
        symbols = iter(data)
        so_far, free = next(symbols), clear + 2
        for symbol in symbols:
            key = so_far << 8 | symbol
            known = get(key)
            if known is not None:
                so_far = known
                continue
            put(so_far)
            table[key] = free
            free += 1
            so_far = symbol
            if free == 4096:
                put(clear)
                cuts.append(len(codes))
                table.clear()
                free = clear + 2
        put(so_far)
    codes.append(clear + 1)
    bounds = [1, *cuts, len(codes)]
    plan = _schedule(min_size, 0)[0]
    widths = np.concatenate([[min_size + 1], *(plan[: b - a] for a, b in zip(bounds, bounds[1:]))])
    return _pack(np.array(codes, np.int32), widths)


def lzw_decode(raw: bytes, min_size: int, most: int) -> bytes:
    """What a code stream stands for, up to ``most`` symbols."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    padded = np.frombuffer(raw + b"\0\0\0", np.uint8).astype(np.uint32)
    words = padded[:-2] | padded[1:-1] << np.uint32(8) | padded[2:] << np.uint32(16)
    total, at, made, out = 8 * len(raw), 0, 0, []
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, previous, number = base.copy(), None, 0
    while at < total and made < most:
        widths, starts = _schedule(min_size, number)
        n = int(np.searchsorted(at + starts[1:], total, side="right"))
        if not n:
            break
        bits = at + starts[:n]
        found = (words[bits >> 3] >> (bits & 7).astype(np.uint32)) & ((np.uint32(1) << widths[:n].astype(np.uint32)) - np.uint32(1))
        stops = np.flatnonzero((found == clear) | (found == end))
        stop = int(stops[0]) if len(stops) else n
        codes = found[:stop].tolist()
        if codes and previous is None:
            if codes[0] >= clear:
                raise ValueError("a code before its entry")
            previous = table[codes[0]]
            out.append(previous)
            codes = codes[1:]
        size = len(table)
        for code in codes:
            if code < size:
                piece = table[code]
            elif code == size and size < 4096:
                piece = previous + previous[:1]
            else:
                raise ValueError("a code before its entry")
            out.append(piece)
            if size < 4096:
                table.append(previous + piece[:1])
                size += 1
            previous = piece
        number += stop
        if stop < n:
            at += int(starts[stop + 1])
            if found[stop] == end:
                break
            table, previous, number = base.copy(), None, 0
        else:
            at += int(starts[n])
    return b"".join(out)[:most]


# -- files -------------------------------------------------------------------------------------------


def _blocks(raw: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (raw[i : i + 255] for i in range(0, len(raw), 255))) + b"\0"


def _table_bits(palette: np.ndarray) -> int:
    return max(1, int(np.ceil(np.log2(max(2, len(palette))))))


def _table(palette: np.ndarray) -> bytes:
    return palette.astype(np.uint8).tobytes().ljust(3 << _table_bits(palette), b"\0")


def encode(gif: Gif) -> bytes:
    flags = 0x70 | (0x80 | (_table_bits(gif.palette) - 1) if gif.palette is not None else 0)
    out = [b"GIF89a", struct.pack("<HHBBB", gif.width, gif.height, flags, gif.background, 0)]
    if gif.palette is not None:
        out.append(_table(gif.palette))
    for f in gif.frames:
        height, width = f.indices.shape
        packed = f.disposal << 2 | (f.transparent is not None)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, packed, f.delay_cs, f.transparent or 0, 0))
        local = 0x80 | (_table_bits(f.palette) - 1) if f.palette is not None else 0
        out.append(struct.pack("<BHHHHB", 0x2C, f.left, f.top, width, height, local | 0x40 * f.interlaced))
        if f.palette is not None:
            out.append(_table(f.palette))
        palette = f.palette if f.palette is not None else gif.palette
        min_size = max(2, _table_bits(palette) if palette is not None else 8)
        rows = f.indices[_interlaced(height)] if f.interlaced else f.indices
        out += [bytes([min_size]), _blocks(lzw_encode(rows.tobytes(), min_size))]
    return b"".join(out) + b"\x3b"


def _interlaced(height: int) -> np.ndarray:
    """The order in which an interlaced image stores its rows: every 8th, then those between."""
    rows = np.arange(height)
    return np.concatenate([rows[0::8], rows[4::8], rows[2::4], rows[1::2]])


def _sub_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while (n := raw[at]) > 0:
        if at + 1 + n > len(raw):
            raise ValueError("cut short")
        parts.append(raw[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def decode(raw: bytes) -> Gif:
    """Raises ValueError (or IndexError, struct.error where it ends early) if raw isn't a whole GIF."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", raw, 6)
    at = 13

    def table(bits: int) -> np.ndarray:
        nonlocal at
        n = 2 << bits
        found = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return found

    gif = Gif(width, height, table(flags & 7) if flags & 0x80 else None, background)
    delay, disposal, transparent = 0, 0, None
    while (kind := raw[at]) != 0x3B:
        at += 1
        if kind == 0x21:
            label = raw[at]
            body, at = _sub_blocks(raw, at + 1)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, clear_index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, clear_index if packed & 1 else None
        elif kind == 0x2C:
            left, top, w, h, local = struct.unpack_from("<HHHHB", raw, at)
            at += 9
            palette = table(local & 7) if local & 0x80 else None
            min_size = raw[at]
            if not 1 <= min_size <= 8:
                raise ValueError("bad code size")
            stream, at = _sub_blocks(raw, at + 1)
            pixels = np.frombuffer(lzw_decode(stream, min_size, w * h), np.uint8)
            if len(pixels) < w * h:
                raise ValueError("too few pixels")
            indices = pixels.reshape(h, w)
            if local & 0x40:
                straight = np.empty_like(indices)
                straight[_interlaced(h)] = indices
                indices = straight
            gif.frames.append(Frame(indices, left, top, delay, disposal, transparent, palette, bool(local & 0x40)))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("unknown block")
    return gif


def render(gif: Gif) -> Iterator[tuple[np.ndarray, int]]:
    """The canvas (height x width x 3) as each frame shows it, with its time in ms; reused between frames."""
    ground = gif.palette[gif.background] if gif.palette is not None and gif.background < len(gif.palette) else np.zeros(3, np.uint8)
    canvas = np.empty((gif.height, gif.width, 3), np.uint8)
    canvas[:] = ground
    for f in gif.frames:
        palette = f.palette if f.palette is not None else gif.palette if gif.palette is not None else GREY
        part = canvas[f.top : f.top + f.indices.shape[0], f.left : f.left + f.indices.shape[1]]
        before = part.copy() if f.disposal == 3 else None
        inside = f.indices[: part.shape[0], : part.shape[1]]
        if len(palette) < 256:
            palette = np.concatenate([palette, np.zeros((256 - len(palette), 3), np.uint8)])
        if f.transparent is None:
            part[:] = palette[inside]
        else:
            seen = inside != f.transparent
            part[seen] = palette[inside[seen]]
        yield canvas, 10 * f.delay_cs
        if f.disposal == 2:
            part[:] = ground
        elif f.disposal == 3:
            part[:] = before


# -- payloads ----------------------------------------------------------------------------------------


def payload_gif(payload: bytes) -> bytes:
    """A payload, a positive multiple of 64 bytes, as grey frames 64 samples wide."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [Frame(samples[i : i + FRAME_ROWS], delay_cs=DELAY_CS, disposal=1) for i in range(0, len(samples), FRAME_ROWS)]
    return encode(Gif(WIDTH, min(len(samples), FRAME_ROWS), GREY, 0, frames))


def features(raw: bytes) -> tuple[bytes, int, int, np.ndarray]:
    """(samples read back, frames, ms, histogram 3 x 16) of a GIF: the red channel of each frame's own part
    of the rendered canvas, and the colours of every rendered frame."""
    gif = decode(raw)
    parts, ms, histogram = [], 0, np.zeros((3, BINS), np.int64)
    for f, (canvas, shown) in zip(gif.frames, render(gif)):
        part = canvas[f.top : f.top + f.indices.shape[0], f.left : f.left + f.indices.shape[1]]
        parts.append(part[:, :, 0].tobytes())
        ms += shown
        for c in range(3):
            histogram[c] += np.bincount(canvas[:, :, c].ravel(), minlength=256).reshape(BINS, -1).sum(axis=1)
    return b"".join(parts), len(gif.frames), ms, histogram


def store_media(df: DataFrame) -> DataFrame:
    """(doc_id, text) as (doc_id, n_bytes, payload_bytes, media): each whole text stored as a GIF."""

    def store(batches):
        for batch in batches:
            data, at = common.text_bytes(batch.column(1))
            raw = data.tobytes()
            rows = [raw[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]
            padded = [x.ljust(max(1, -(-len(x) // 64)) * 64, b"\0") for x in rows]
            for i in range(0, len(rows), 256):
                part = slice(i, i + 256)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0)[i : i + 256],
                    "n_bytes": pa.array([len(x) for x in rows[part]], pa.int64()),
                    "payload_bytes": pa.array([len(x) for x in padded[part]], pa.int64()),
                    "media": pa.array([payload_gif(x) for x in padded[part]], pa.binary()),
                })

    common.bounded_arrow(df.sparkSession)
    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.lean(store), "doc_id long, n_bytes long, payload_bytes long, media binary")


MEDIA_COLUMNS = "n_frames int, duration_ms long, hist_r array<long>, hist_g array<long>, hist_b array<long>, samples binary, media_bytes long, media_sha256 string, error string"


def media_columns(df: DataFrame, column: str = "media") -> DataFrame:
    """df with, in place of its GIF column, the columns read out of each stored file: frames, time,
    colour histograms of the rendered frames, the samples, and the file's size and hash."""
    keep = [c for c in df.columns if c != column]
    frame = df.select(*keep, column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != column) + ", " + MEDIA_COLUMNS

    def read(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 8 + ("null",)
        size, sha = len(raw), hashlib.sha256(raw).hexdigest()
        try:
            samples, n, ms, h = features(raw)
        except (ValueError, IndexError, struct.error) as e:
            return (None,) * 6 + (size, sha, str(e)[:200] or type(e).__name__)
        return n, ms, h[0].tolist(), h[1].tolist(), h[2].tolist(), samples, size, sha, None

    def columns(batches):
        kinds = [pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.int64(), pa.string(), pa.string()]
        names = [x.strip().split(" ")[0] for x in MEDIA_COLUMNS.split(", ")]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = list(zip(*(read(x.as_py()) for x in part.column(part.num_columns - 1))))
                made = [pa.array(v, k) for v, k in zip(found, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], *names])

    return frame.mapInArrow(common.lean(columns), schema)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as a GIF, reads the files back and digests what they hold."""
    read = media_columns(store_media(common.read(spark, sf_dir, "documents")))
    tail = F.expr("substring(samples, -64)")
    return read.select(
        "doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.concat(F.lit("gif:"), F.col("n_frames").cast("string"), F.lit(":"), F.col("duration_ms").cast("string"), F.lit(":"), F.array_join("hist_r", ",")).alias("feature"),
        "n_frames", "duration_ms",
    )


def brute(text: str | None) -> dict:
    """One document's digest, from the definition alone; for tests."""
    raw = (text or "").encode()
    payload = raw + b"\0" * (64 - len(raw) if len(raw) < 64 else -len(raw) % 64)
    return {"n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:])}
