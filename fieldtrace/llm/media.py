"""GIF columns: byte payloads stored as animated GIFs, and GIFs decoded to timed frames.

The decoder reads LZW code streams, global and local palettes, interlacing, transparency and the
four disposal rules, and gives every frame as it is shown, with its time and a colour histogram.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: A payload is cut to rows of so many samples, and to frames of so many rows.
ROW, FRAME_ROWS, DELAY_CS = 576, 8, 4
CLEAR, STOP, FIRST, FULL = 256, 257, 258, 4096
#: Bits of the j-th code after a clear code, as reader and writer both know them.
WIDTHS = np.minimum(12, np.floor(np.log2(np.maximum(FIRST, FIRST - 1 + np.arange(FULL)))).astype(np.int64) + 1)
GREY = bytes(v for i in range(256) for v in (i, i, i))


BITS = np.arange(16) < np.append(WIDTHS, 12)[:, None]


def _packed(codes: np.ndarray, bits: np.ndarray) -> bytes:
    """Codes one after another, the lowest bits first; ``bits`` tells which of 16 bits each code has."""
    every = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(every[bits], bitorder="little").tobytes()


def lzw_encode(samples: bytes) -> bytes:
    """Greedy LZW with 8-bit samples; the table is cleared when it is full."""
    codes, bits, segment, table, size = [CLEAR], [BITS[:1]], [], {}, FIRST
    put, get = segment.append, table.get
    prefix = samples[0]
    for sample in samples[1:]:
        key = prefix << 8 | sample
        code = get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        table[key] = size
        size += 1
        prefix = sample
        if size == FULL:
            put(CLEAR)
            codes += segment
            bits.append(BITS[: len(segment)])
            segment.clear()
            table.clear()
            size = FIRST
    put(prefix)
    put(STOP)
    codes += segment
    bits.append(BITS[: len(segment)])
    return _packed(np.array(codes), np.concatenate(bits))


@cache
def _layout(min_bits: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Width and place of the j-th code after a clear code, and the table that a clear code leaves."""
    first = (1 << min_bits) + 2
    widths = np.minimum(12, np.floor(np.log2(np.maximum(first, first - 1 + np.arange(FULL)))).astype(np.int64) + 1)
    return widths, np.concatenate([[0], np.cumsum(widths)]), [bytes([i]) for i in range(1 << min_bits)] + [b"", b""]


def lzw_decode(stream: bytes, min_bits: int, limit: int) -> bytes:
    """Samples of a code stream, at most ``limit``; deferred clear codes and lost ends are allowed."""
    clear = 1 << min_bits
    widths, starts, base = _layout(min_bits)
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    end, at, out, made = len(stream) * 8, 0, [], 0
    table, prev, seen = base[:], b"", 0
    put, add = out.append, table.append
    while made < limit and at + min_bits < end:
        if seen + 1 < FULL:
            stop = int(np.searchsorted(starts, starts[seen] + end - at, "right")) - 1
            where, wide = starts[seen:stop] - starts[seen] + at, widths[seen:stop]
        else:
            where = at + 12 * np.arange(min(FULL, (end - at) // 12))
            wide = np.full(len(where), 12)
        if not len(where):
            break
        codes = words[where >> 3] >> (where & 7) & (1 << wide) - 1
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(marks[0]) if len(marks) else len(codes)
        todo = codes[:n].tolist()
        if todo and not prev:
            prev = table[todo[0]]
            out.append(prev)
            todo = todo[1:]
        room = len(table)
        grow = FULL - room
        for code in todo[:grow]:
            if code < room:
                entry = table[code]
            elif code == room:
                entry = prev + prev[:1]
            else:
                raise ValueError("a code that is not in the table yet")
            add(prev + entry[:1])
            put(entry)
            room += 1
            prev = entry
        for code in todo[grow:]:
            prev = table[code]
            put(prev)
        seen += n
        if len(marks):
            if codes[n] == clear + 1:
                break
            at = int(where[n] + wide[n])
            table, prev, seen = base[:], b"", 0
            add = table.append
        else:
            at = int(where[-1] + wide[-1])
            made = sum(map(len, out))
    return b"".join(out)[:limit]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def pad(data: bytes) -> bytes:
    """Bytes 255 are appended up to a positive multiple of the row length."""
    return data + b"\xff" * (ROW - len(data) % ROW if len(data) % ROW or not data else 0)


def gif_of(payload: bytes) -> bytes:
    """A grey animated GIF whose frames hold the samples in turn; a shorter last frame covers fewer rows."""
    rows = len(payload) // ROW
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, FRAME_ROWS), 0xF7, 0, 0), GREY]
    step = ROW * FRAME_ROWS
    for i in range(0, len(payload), step):
        part = payload[i : i + step]
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY_CS, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, ROW, len(part) // ROW, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join(out) + b"\x3b"


def frames_of(media: bytes) -> Iterator[tuple[int, tuple[int, int, int, int], np.ndarray]]:
    """(delay in 1/100 s, frame box x y w h, canvas h*w*4 RGBA as shown) of each frame. ValueError if it is no GIF."""
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise ValueError("no GIF header")
    wide, high, flags = struct.unpack_from("<HHB", media, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((high, wide, 4), np.uint8)
    delay, dispose, clear = 0, 0, -1

    def gathered(i: int) -> tuple[bytes, int]:
        out = []
        while i < len(media) and media[i]:
            out.append(media[i + 1 : i + 1 + media[i]])
            i += 1 + media[i]
        return b"".join(out), i + 1

    while at < len(media) and media[at] != 0x3B:
        if media[at] == 0x21:
            body, after = gathered(at + 2)
            if media[at + 1] == 0xF9 and len(body) >= 4:
                delay, dispose = body[1] | body[2] << 8, body[0] >> 2 & 7
                clear = body[3] if body[0] & 1 else -1
            at = after
            continue
        if media[at] != 0x2C:
            raise ValueError("an unknown block")
        x, y, w, h, local = struct.unpack_from("<HHHHB", media, at + 1)
        at += 10
        palette = shared
        if local & 0x80:
            n = 2 << (local & 7)
            palette = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        if palette is None or x + w > wide or y + h > high:
            raise ValueError("a frame without palette or outside the screen")
        stream, after = gathered(at + 1)
        flat = lzw_decode(stream, media[at], w * h)
        at = after
        if len(flat) < w * h:
            raise ValueError("a code stream that ends before its frame")
        index = np.frombuffer(flat, np.uint8).reshape(h, w)
        if local & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            index = index[np.argsort(order)]
        before = canvas.copy() if dispose == 3 else None
        box = canvas[y : y + h, x : x + w]
        seen = index != clear
        if int(index.max(initial=0)) >= len(palette):
            raise ValueError("a colour outside the palette")
        box[seen, :3] = palette[index[seen]]
        box[seen, 3] = 255
        yield delay, (x, y, w, h), canvas
        if dispose == 2:
            box[:] = 0
        elif dispose == 3:
            canvas = before
        delay, dispose, clear = 0, 0, -1
    if at >= len(media):
        raise ValueError("no end mark")


def histogram(canvas: np.ndarray) -> list[int]:
    """Counts of 8 equal bands of red, green, blue over the visible pixels: 24 numbers."""
    shown = canvas[canvas[:, :, 3] > 0][:, :3] >> 5
    return [int(n) for c in range(3) for n in np.bincount(shown[:, c], minlength=8)]


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each whole text (null: empty) as UTF-8, padded and stored as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                data = [x.encode() for x in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(map(len, data), pa.int64()), pa.array([gif_of(pad(x)) for x in data], pa.binary())], ["key", "n_bytes", "media"])

    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "key long, n_bytes long, media binary")


def frames(media: DataFrame, key: str = "key", column: str = "media") -> DataFrame:
    """One row per frame: key, frame, start_ms, delay_ms, width, height, colours (24 counts), rgba.

    A null, broken or cut GIF gives one row whose frame is -1 and whose other fields are null; repeated rows are repeated;
    a null key stays null; other columns are ignored; an empty table gives no rows.
    """
    schema = "key long, frame int, start_ms long, delay_ms long, width int, height int, colours array<long>, rgba binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "frame", "start_ms", "delay_ms", "width", "height", "colours", "rgba"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            for k, gif in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, at = [], 0
                try:
                    for n, (delay, _, canvas) in enumerate(frames_of(gif or b"")):
                        rows.append((k, n, at * 10, delay * 10, canvas.shape[1], canvas.shape[0], histogram(canvas), canvas.tobytes()))
                        at += delay
                except (ValueError, IndexError, struct.error):
                    rows = []
                rows = rows or [(k, -1, None, None, None, None, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return media.select(F.col(key).cast("long").alias("key"), F.col(column).alias("media")).mapInArrow(run, schema)


def digests(media: DataFrame) -> DataFrame:
    """Reads stored payloads back from their GIFs' frames: sizes, checksums and a colour feature.

    feature is the number of frames, the shown milliseconds and the summed histogram of one grey channel.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def one(key: int | None, n_bytes: int, gif: bytes) -> tuple:
        back, shown, counts, n = [], 0, np.zeros(8, np.int64), 0
        for delay, (x, y, w, h), canvas in frames_of(gif):
            box = canvas[y : y + h, x : x + w, 0]
            back.append(box.tobytes())
            counts += np.bincount(box.reshape(-1) >> 5, minlength=8)
            shown, n = shown + delay * 10, n + 1
        payload = b"".join(back)
        feature = f"{n}/{shown}ms/" + "-".join(map(str, counts.tolist()))
        return key, n_bytes, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(gif), sha256(gif).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]
        for batch in batches:
            if batch.num_rows:
                rows = [one(*x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return media.select("key", "n_bytes", "media").mapInArrow(run, schema)


def gif_digests(docs: DataFrame) -> DataFrame:
    """Stores every text as a GIF and reads it back.

    A null text counts as empty (576 bytes of 255); a null doc_id stays null; repeated rows give
    repeated rows; a text of any length is one GIF of as many frames as it needs, held in its task; other
    columns are ignored; an empty table gives no rows.
    """
    return digests(stored(docs))
