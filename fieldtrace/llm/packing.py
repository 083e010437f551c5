"""Packing with shortest-pack-first over the length histogram.

Lengths are at most 4096, so the histogram has at most 4096 rows whatever the input; patterns are made
from it alone, longest lengths first, each put into the shortest pack that there is. Documents then
get their place by joining their rank among pieces of equal length to the patterns.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts, text_or_empty

LENGTH, END = 4096, 2
#: Byte-level vocabularies write bytes that don't print as the code points from 256 on, in turn.
BYTE_LETTERS = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}
#: Entries that a worker keeps.
PIECES = 1_500_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts, through the tokenizer, with those of pieces kept.

    The tokenizer never joins across white space. Chunks of Latin letters, digits and ASCII signs split as the
    tokenizer splits them, at the borders of runs of letters and after each digit; other chunks are pieces as they are.
    """

    _plain = r"A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:;=-@\[-`{-~"
    _text = re.compile(f"[{_plain} \\n\\t\\r]*")
    _chunk = re.compile(f"[{_plain}]+")
    _part = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ \n\t\r]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if self._text.fullmatch(text):
            return self._part.findall(text.lower())
        out: list[str] = []
        for x in re.split(r"[ \n\t\r]+", text):
            if self._chunk.fullmatch(x):
                out += self._part.findall(x.lower())
            elif x:
                out.append("\0" + x)  # a mark: this one goes to the tokenizer as it is
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; what isn't known yet is learnt for all of them at once."""
        split = [self.pieces(x) for x in texts]
        if len(self.known) > PIECES:
            self.known = {}
        self._learn(set().union(*split).difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def _learn(self, new: set[str]) -> None:
        rest, tokenize = [x for x in new if x[0] == "\0"], self.model.tokenize
        for x in new.difference(rest):
            own = x if x.isascii() else x.encode().decode("latin-1").translate(BYTE_LETTERS)
            self.known[x] = array("I", [t.id for t in tokenize(own)]).tobytes()
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            for x, e in zip(some, self.tokenizer.encode_batch([x[1:] for x in some], add_special_tokens=False), strict=True):
                self.known[x] = array("I", e.ids).tobytes()


_loaded: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): documents cut after every LENGTH ids, the end id last."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _loaded.setdefault(path, None) or WordTokenizer(path)
        _loaded[path] = tokens
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows, (keys, texts) = [], (c.to_pylist() for c in batch.slice(i, 512).columns)
                for k, x in zip(keys, tokens.ids(texts), strict=True):
                    ids = x + end
                    for a in range(0, len(ids), 4 * LENGTH):
                        own = ids[a : a + 4 * LENGTH]
                        rows.append((k, a // 4, len(own) // 4, zlib.crc32(own), len(ids) // 4) + (own,) * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == 5 else pa.int64()) for n, c in enumerate(zip(*rows, strict=True))], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, schema)


def patterns(histogram: dict[int, int], most: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, how many packs) from length -> count.

    Lengths go longest first into the packs with the most room left; a group of equal packs is split when
    fewer pieces are left than it has packs.
    """
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(most + 1)]
    top = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while top and not room[top]:
                top -= 1
            if top < length:
                fits = most // length
                if left >= fits:
                    room[most - fits * length].append(((length,) * fits, left // fits))
                    top, left = max(top, most - fits * length), left % fits
                else:
                    room[most - length].append(((length,), left))
                    top, left = max(top, most - length), 0
                continue
            pack, n = room[top].pop()
            used = min(n, left)
            if n > used:
                room[top].append((pack, n - used))
            room[top - length].append(((*pack, length), used))
            left -= used
    return [x for group in room for x in group]


def slots(found: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of ranks of a length: length, first rank, first sequence, offset; sorted by length and rank."""
    rows, first, seen = [], 0, {}
    for pack, n in found:
        at = 0
        for length in pack:
            rows.append((length, seen.get(length, 0), first, at))
            seen[length] = seen.get(length, 0) + n
            at += length
        first += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def ranked(rows: DataFrame) -> DataFrame:
    """Column ``rank`` from 0 among rows of equal length, and ``copy``, a number from 0 among equal pieces.

    A common length is ranked in many buckets, whose counts are then summed.
    """
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "length"), F.lit(max(64, parts(rows.sparkSession)))))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    piece = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*piece))
    copy = (F.row_number().over(Window.partitionBy("length", "bucket", *piece).orderBy("own")) - 1).cast("long")
    return rows.withColumn("own", own).withColumn("copy", copy).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") - 1 + F.col("before")).drop("own", "before", "bucket")


def placed(rows: DataFrame) -> DataFrame:
    """Adds copy, sequence_id and offset to rows with doc_id, start, length, ids_crc32, doc_tokens (and ids)."""
    rows = cut(rows)
    histogram = {int(r[0]): int(r[1]) for r in rows.groupBy("length").count().collect()}  # at most LENGTH rows
    length, rank, sequence, offset = slots(patterns(histogram))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        at = ranks.to_numpy(np.int64)
        run = np.searchsorted(length << 44 | rank, lengths.to_numpy(np.int64) << 44 | at, "right") - 1
        return pd.DataFrame({"sequence_id": sequence[run] + at - rank[run], "offset": offset[run]})

    out = ranked(rows).withColumn("place", place("length", "rank"))
    return out.select(*rows.columns, "place.sequence_id", "place.offset", "copy")


def packed(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset, copy.

    Null texts are empty and have the end id alone; repeated rows give pieces of their own, told apart by ``copy``;
    a null doc_id stays null; texts of any length are cut to pieces; other columns are ignored; an empty table gives no
    rows. Sequences are filled from offset 0 without gaps and padded at their end. ids are little-endian
    unsigned 32-bit numbers.
    """
    return placed(pieces(docs, path or vocabulary(), with_ids=with_ids))
