import random
import struct
import zlib
from hashlib import sha256

import numpy as np
import pytest

from fieldtrace.llm import media


def test_lzw_round_trips():
    rng = random.Random(3)
    for n in (1, 2, 255, 4000, 70000):
        for letters in (1, 2, 30, 256):
            data = bytes(rng.randrange(letters) for _ in range(n))
            assert media.lzw_decode(media.lzw_encode(data), 8, n) == data


def plain_lzw(codes_of):
    """A decoder bit by bit, to hold the fast one against."""
    def decode(stream, min_bits, limit):
        bits = int.from_bytes(stream, "little")
        clear, at, wide = 1 << min_bits, 0, min_bits + 1
        table, prev, out = [], None, b""
        while at + wide <= len(stream) * 8:
            code = bits >> at & (1 << wide) - 1
            at += wide
            if code == clear:
                table, wide, prev = [bytes([i]) for i in range(clear)] + [b"", b""], min_bits + 1, None
            elif code == clear + 1:
                break
            else:
                entry = table[code] if code < len(table) else prev + prev[:1]
                if prev is not None and len(table) < 4096:
                    table.append(prev + entry[:1])
                prev, out = entry, out + entry
                wide = min(12, max(wide, len(table).bit_length()))
        return out[:limit]
    return decode


def test_decoder_agrees_with_a_plain_one():
    rng = random.Random(4)
    for n in (10, 3000, 9000):
        data = bytes(rng.randrange(40) for _ in range(n))
        assert plain_lzw(None)(media.lzw_encode(data), 8, n) == data


def gif(frames, high=2, wide=2):
    """frames: (indices, box, delay, disposal, transparent or None, palette or None)."""
    out = [b"GIF89a", struct.pack("<HHBBB", wide, high, 0xF0 | 1, 0, 0), bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])]
    for index, (x, y, w, h), delay, disposal, clear, palette in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, x, y, w, h, 0x80 | 1 if palette else 0) + (palette or b"") + b"\x08")
        out.append(media._blocks(media.lzw_encode(bytes(index))))
    return b"".join(out) + b";"


def test_disposal_transparency_and_local_palettes():
    data = gif([([1, 1, 1, 1], (0, 0, 2, 2), 5, 1, None, None), ([2, 3], (0, 0, 2, 1), 7, 3, 3, None), ([0], (1, 1, 1, 1), 1, 2, None, bytes([9, 9, 9] * 4)), ([2], (0, 0, 1, 1), 2, 0, None, None)])
    shown = [(d, c.copy()) for d, _, c in media.frames_of(data)]
    assert [d for d, _ in shown] == [5, 7, 1, 2]
    assert shown[1][1][0, 0].tolist() == [0, 255, 0, 255] and shown[1][1][0, 1].tolist() == [255, 0, 0, 255]
    assert shown[2][1][0, 0].tolist() == [255, 0, 0, 255] and shown[2][1][1, 1].tolist() == [9, 9, 9, 255]
    assert shown[3][1][1, 1].tolist() == [0, 0, 0, 0]


def test_frames_table_and_broken_media(spark):
    data = gif([([1, 1, 2, 2], (0, 0, 2, 2), 5, 1, None, None), ([3, 3, 3, 3], (0, 0, 2, 2), 4, 1, None, None)])
    rows = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"GIF89a nothing"))], "key long, media binary")
    got = sorted(tuple(r)[:4] for r in media.frames(rows).select("key", "frame", "start_ms", "delay_ms").collect())
    assert got == [(1, 0, 0, 50), (1, 1, 50, 40), (2, -1, None, None), (3, -1, None, None)]


def expected(text):
    data = (text or "").encode()
    payload = data + b"\xff" * (-len(data) % 576 if data else 576)
    return len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_payloads_come_back(spark, odd, empty, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    for df in (docs, odd):
        got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.gif_digests(df).collect()), key=str)
        assert got == sorted(((r.doc_id, *expected(r.text)) for r in df.collect()), key=str)
    assert media.gif_digests(empty).count() == 0
    with pytest.raises(ValueError):
        list(media.frames_of(b"nothing"))
    assert np.sum(media.histogram(np.full((2, 2, 4), 255, np.uint8))) == 12


def test_cut_streams_give_no_frames(spark):
    whole = media.gif_of(media.pad(b"some text that is long enough " * 400))
    rows = [(i, bytearray(whole[: len(whole) - n])) for i, n in enumerate((0, 1, 40, 300, len(whole) // 2))]
    short = whole[:-1].replace(media._blocks(media.lzw_encode(media.pad(b"some text that is long enough " * 400)[:4608])), media._blocks(media.lzw_encode(b"a" * 4000))) + b"\x3b"
    rows.append((9, bytearray(short)))
    got = {k: sorted(r.frame for r in media.frames(spark.createDataFrame(rows, "key long, media binary")).filter(f"key = {k}").collect()) for k in (0, 1, 2, 3, 4, 9)}
    assert len(got[0]) > 1 and got[0][0] == 0 and all(got[k] == [-1] for k in (1, 2, 3, 4, 9))
