"""Fill-in-middle documents by block rotation in place.

A text is scanned once, as UTF-8 bytes, for its units (runs of A-Z and a-z, else single characters). Sentinels go into
one bytearray at the two cuts, and neighbouring blocks change places by three reversals. Restoring finds the sentinels,
turns the same rotation back and takes them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Marks before prefix, suffix and middle; percent of documents that are cut; percent of these that begin with the suffix.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SHARE, SUFFIX_FIRST, SEED = 90, 20, "1"


def starts(data: np.ndarray) -> np.ndarray:
    """Byte places at which a unit starts."""
    lower = data | 32
    letter = (lower >= 97) & (lower <= 122)
    inside = (data & 0xC0) == 0x80
    inside[1:] |= letter[1:] & letter[:-1]
    return np.flatnonzero(~inside)


def n_chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def rotate(buffer: bytearray, start: int, middle: int, stop: int) -> None:
    """buffer[start:middle] and buffer[middle:stop] change places: each is reversed, then both together."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((start, middle), (middle, stop), (start, stop)):
        half = (b - a) // 2
        left = view[a : a + half].copy()
        view[a : a + half] = view[b - half : b][::-1]
        view[b - half : b] = left[::-1]


def transform(text: bytes, cuts: tuple[int, int], form: str) -> bytes:
    """The text with marks at the byte cuts, its suffix moved before the middle (psm) or before all (spm)."""
    first, second = cuts
    out = bytearray(text)
    out[second:second] = SUFFIX
    out[first:first] = MIDDLE
    out[0:0] = PREFIX
    first, second = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(out, first if form == "psm" else 0, second, len(out))
    return bytes(out)


def restore(output: bytes, form: str) -> bytes:
    """The text of which ``transform`` made ``output``; texts that hold a mark are never transformed, so each is found once."""
    if form == "plain":
        return output
    out = bytearray(output)
    suffix = out.index(SUFFIX)
    if form == "psm":
        rotate(out, suffix, out.index(MIDDLE), len(out))
    else:
        rotate(out, suffix, out.index(PREFIX), len(out))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = out.index(mark)
        del out[at : at + len(mark)]
    return bytes(out)


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four whole numbers of 32 bits from the seed and the id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            rows = []
            for text, h1, h2, h3, h4 in zip(*(part.column(i).to_pylist() for i in range(1, 6)), strict=True):
                data = np.frombuffer(text, np.uint8)
                at = starts(data)
                n = len(at)
                if not n or h3 % 100 >= SHARE or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((n, "plain", None, None, text))
                    continue
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                first, second = (int(at[k]) if k < n else len(data) for k in (low, high))
                form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
                rows.append((n, form, n_chars(data[:first]), n_chars(data[first:second]), transform(text, (first, second), form)))
            n, form, prefix, middle, output = zip(*rows, strict=True)
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def filled(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars and output (UTF-8) of each document.

    Null texts are empty, and empty ones plain; so are texts that hold a mark. A null doc_id draws as the empty text.
    Equal rows give equal rows; a text of any length is one row and a few times its bytes in memory; other columns
    aren't read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    rows = rows.select("doc_id", "text", *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed), 1)])
    return rows.mapInArrow(_cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")


def restored(rows: DataFrame) -> DataFrame:
    """The rows with ``restored`` (UTF-8), made of their columns form and output alone; nulls of either stay null."""

    @F.pandas_udf("binary")
    def back(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for output, form in parts:
            yield pd.Series([None if o is None or f is None else restore(o, f) for o, f in zip(output, form, strict=True)], dtype=object)

    return rows.withColumn("restored", back("output", "form"))


def fim_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256; rows are handled as in ``filled``."""
    rows = restored(filled(docs))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
