"""Exact substring removal with a distributed difference-cover suffix sort.

1. Every 50-byte window has an anchor, its least 20-byte gram by hash; equal windows have equal anchors.
   Neighbouring windows with one anchor make a run. Runs (hashes only) meet by anchor; equal runs of
   several documents are settled at once, first within a task's texts, then for all.
2. A window holds its anchor and 30 more bytes, so at least 15 at one side: only runs that share an anchor and
   its 15 neighbours at a side with a different run of another document may hold further matches. Their bytes
   are fetched, and each bucket of anchors is suffix-sorted by the difference-cover method: triples at
   places 1 and 2 modulo 3 are sorted and named, the string of names is sorted in the same way as deep as
   50 bytes need, the remaining suffixes are merged, and prefixes of neighbours are compared.
3. Spans meet the texts by document.

Anchors that very many different runs share are split by the content of the windows instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import cut, parts, text_or_empty

#: Bytes of a match, of an anchor gram and of its neighbourhood; texts are scanned in chunks of about so many bytes.
MATCH, GRAM, SIDE, CHUNK = 50, 20, 15, 1 << 21
#: Neighbourhood hash of an anchor too near to the end of its text.
NONE = 255
#: Different runs that share an anchor from which it is split by window content.
HOT = 4096

_POWER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte planes apart so that shuffle compression finds the constant ones."""
    head = np.array([len(arrays[0])], "<u4").tobytes()
    return head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)


def _unpacked(blob: bytes, *types: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, "<u4", 1)[0]), 4, []
    for t in types:
        w = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * w, at).reshape(w, n).T).view(t).reshape(n))
        at += n * w
    return out


def _gathered(blobs: list[bytes], *types: str) -> list[np.ndarray]:
    found = [_unpacked(b, *types) for b in blobs]
    return [np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate(types)]


def runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor hash, left and right neighbourhood) of each run in joined texts, each of MATCH bytes or more."""
    n = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        power = np.full(len(data) + 1, _POWER)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_MIX[data] * power[:-1], out=total[1:])
        inverse = np.full(len(data), np.uint64(pow(int(_POWER), -1, 1 << 64)))
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        h = (total[GRAM:] - total[:-GRAM]) * inverse[:n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    bits = np.uint64(24)
    low = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    wide, have = MATCH - GRAM + 1, 1
    while have * 2 <= wide:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < wide:
        low = np.minimum(low[: len(low) - (wide - have)], low[wide - have :])
    at = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(len(at))
    ok = start + MATCH <= np.repeat(ends, ends - begins)[: len(at)]
    start, at = start[ok], at[ok]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    at = at[new]
    own = np.searchsorted(begins, at, "right") - 1

    def near(a: np.ndarray, inside: np.ndarray) -> np.ndarray:
        a = np.where(inside, a, 0)
        with np.errstate(over="ignore"):
            side = (total[np.minimum(a + SIDE, len(data))] - total[a]) * inverse[np.minimum(a, len(data) - 1)]
            side *= np.uint64(0xBF58476D1CE4E5B9)
        return np.where(inside, (side >> np.uint64(33)) % np.uint64(NONE), NONE).astype("u1")

    left, right = near(at - SIDE, at - SIDE >= begins[own]), near(at + GRAM, at + GRAM + SIDE <= ends[own])
    return start[new], np.diff(np.append(new, len(start))), h[at], left, right


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[tuple[int, int, int, int, int]]]]:
    """Joined bytes of texts, and (doc, twin, place in the text, begin, end in the bytes); long texts are cut with overlap."""
    held, rows, size = [], [], 0
    for batch in batches:
        for k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode()
            if len(data) < MATCH:
                continue
            twin = zlib.crc32(data)
            for a in range(0, len(data) - MATCH + 1, CHUNK):
                part = data[a : a + CHUNK + MATCH - 1]
                rows.append((k, twin, a, size, size + len(part)))
                held.append(part)
                size += len(part)
                if size >= CHUNK:
                    yield b"".join(held), rows
                    held, rows, size = [], [], 0
    if rows:
        yield b"".join(held), rows


def _anchored(buckets: int, docs: int):
    """Texts -> rows of step 1: kind 0 are runs by bucket of their anchor, kind 1 spans by bucket of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for data, rows in _chunks(batches):
            doc, twin, place, begin, end = (np.array(c, np.int64) for c in zip(*rows, strict=True))
            start, n, anchor, left, right = runs(np.frombuffer(data, np.uint8), begin, end)
            own = np.searchsorted(begin, start, "right") - 1
            rhash = np.fromiter((digest(data[a:b]) for a, b in zip(start.tolist(), (start + n + MATCH - 1).tolist(), strict=True)), np.uint64, len(start))
            d, t, at = doc[own], twin[own].astype("<u4"), (start - begin[own] + place[own]).astype("<i8")
            order = np.lexsort((d, rhash, anchor))
            anchor, rhash, d, t, at, n, left, right = (x[order] for x in (anchor, rhash, d, t, at, n, left, right))
            first = np.flatnonzero(np.concatenate([[True], (rhash[1:] != rhash[:-1]) | (anchor[1:] != anchor[:-1])])) if len(d) else np.zeros(0, np.int64)
            least = np.repeat(d[first], np.diff(np.append(first, len(d))))
            later = d > least
            out = list(_by_doc(d[later], t[later], at[later], n[later] + MATCH - 1, docs, 1))
            keep = np.flatnonzero(~later)
            bucket = (anchor[keep] >> np.uint64(40)) % np.uint64(buckets)
            place_ = np.lexsort((at[keep], d[keep], bucket))
            keep, bucket = keep[place_], bucket[place_].astype(np.int64)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                k = keep[edges[b] : edges[b + 1]]
                out.append((b, 0, _packed(anchor[k].astype("<u4"), rhash[k].view(np.uint8).reshape(-1, 8)[:, :7], d[k], t[k], at[k], n[k].astype("u1"), left[k], right[k])))
            yield _rows(out)

    return run


def _rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "blob"])


_SPAN = ("<i8", "<u4", "<i8", "<i8")


def _by_doc(doc: np.ndarray, twin: np.ndarray, at: np.ndarray, length: np.ndarray, docs: int, kind: int, extra: np.ndarray | None = None) -> Iterator[tuple[int, int, bytes]]:
    """Spans packed by bucket of their document; spans of a document that touch are joined first if they carry nothing else."""
    if not len(doc):
        return
    order = np.lexsort((at, twin, doc, np.mod(doc, docs)))
    doc, twin, at, length = doc[order], twin[order], at[order].astype(np.int64), length[order].astype(np.int64)
    if extra is not None:
        extra = extra[order]
    else:
        text = np.concatenate([[True], (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])])
        beyond = np.cumsum(text) * int((at + length).max() + 1)
        reach = np.maximum.accumulate(beyond + at + length)
        new = text | np.concatenate([[True], (beyond + at)[1:] > reach[:-1]])
        first = np.flatnonzero(new)
        stop = np.maximum.reduceat(at + length, first)
        doc, twin, at = doc[first], twin[first], at[first]
        length = stop - at
    bucket = np.mod(doc, docs)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(doc)], strict=True):
        columns = [doc[a:b], twin[a:b].astype("<u4"), at[a:b], length[a:b]] + ([extra[a:b]] if extra is not None else [])
        yield int(bucket[a]), kind, _packed(*columns)


def _settle(docs: int):
    """All runs of a bucket of anchors -> spans of equal runs (kind 1) and the runs whose bytes are needed (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        blobs, target = table.column("blob").to_pylist(), int(table.column("bucket")[0].as_py())
        anchor, seven, doc, twin, at, n, left, right = _gathered(blobs, "<u4", "V7", "<i8", "<u4", "<i8", "u1", "u1", "u1")
        wide = np.zeros((len(seven), 8), np.uint8)
        wide[:, :7] = seven.view(np.uint8).reshape(-1, 7)
        rhash = wide.view("<u8").reshape(-1)
        order = np.lexsort((doc, rhash, anchor))
        anchor, rhash, doc, twin, at, n, left, right = (x[order] for x in (anchor, rhash, doc, twin, at, n, left, right))
        a_new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        r_new = a_new | np.concatenate([[True], rhash[1:] != rhash[:-1]])
        r_first, a_first = np.flatnonzero(r_new), np.flatnonzero(a_new)
        r_id, a_id = np.cumsum(r_new) - 1, np.cumsum(a_new) - 1
        later = doc > doc[r_first][r_id]
        out = list(_by_doc(doc[later], twin[later], at[later], n[later].astype(np.int64) + MATCH - 1, docs, 1))
        kinds = np.bincount(a_id[r_first])
        #: Of each run, what is left is of one document; so two documents here are two runs.
        todo = np.flatnonzero((kinds > 1)[a_id] & ~later)
        ask = np.zeros(len(doc), bool)
        for side in (left, right):
            some = todo[side[todo] != NONE]
            key = a_id[some] * 256 + side[some]
            some, key = some[np.argsort(key, kind="stable")], np.sort(key)
            if len(some):
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                mixed = np.minimum.reduceat(doc[some], first) < np.maximum.reduceat(doc[some], first)
                ask[some] |= np.repeat(mixed, np.diff(np.append(first, len(some))))
        goal = np.where(kinds[a_id[ask]] > HOT, -1, target)
        out += _by_doc(doc[ask], twin[ask], at[ask], n[ask], docs, 2, goal.astype("<i8"))
        return pa.Table.from_batches([_rows(out)])

    return run


def _fetch(buckets: int):
    """Texts and wanted runs of a bucket of documents -> (bucket, blob, bytes): strings with their windows."""

    def run(texts: pa.Table, asks: pa.Table) -> pa.Table:
        doc, twin, at, n, goal = _gathered(asks.column("blob").to_pylist(), *_SPAN, "<i8")
        order = np.lexsort((at, twin, doc))
        doc, twin, at, n, goal = (x[order] for x in (doc, twin, at, n, goal))
        wanted = set(doc.tolist())
        rows: list[tuple[int, int, int, int, int, bytes]] = []
        done = set()
        for k, text in zip(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist(), strict=True):
            if k not in wanted:
                continue
            data = text.encode()
            t = zlib.crc32(data)
            if (k, t) in done:
                continue
            done.add((k, t))
            a, b = np.searchsorted(doc, [k, k + 1])
            for i in (np.flatnonzero(twin[a:b] == t) + a).tolist():
                s, m, g = int(at[i]), int(n[i]), int(goal[i])
                if g >= 0:
                    rows.append((g, k, t, s, m, data[s : s + m + MATCH - 1]))
                else:
                    for j in range(s, s + m):
                        w = data[j : j + MATCH]
                        rows.append((buckets + zlib.crc32(w) % (16 * buckets), k, t, j, 1, w))
        rows.sort(key=lambda r: r[0])
        out, i = [], 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            _, k, t, s, m, w = zip(*rows[i:j], strict=True)
            out.append((rows[i][0], _packed(np.array(k, "<i8"), np.array(t, "<u4"), np.array(s, "<i8"), np.array(m, "<u1")), b"".join(w)))
            i = j
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"bucket": pa.array(cols[0], pa.int64()), "blob": pa.array(cols[1], pa.binary()), "bytes": pa.array(cols[2], pa.binary())})

    return run


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes of ``s`` (positive integers): suffixes that differ in the first ``depth`` symbols
    rank as these do; ranks of the others are next to each other.

    The difference cover {1, 2} modulo 3: triples there are sorted and named; unless the names differ or are
    as deep as needed, the string of names is ranked in the same way; places 0 modulo 3 are then sorted by
    first symbol and the next rank, and merged with the others.
    """
    n = len(s)
    if n < 3:
        z = np.concatenate([s, np.zeros(3, s.dtype)])
        return np.argsort(np.argsort([tuple(z[i : i + 3].tolist()) for i in range(n)] and np.array([z[i] * (int(s.max()) + 1) + z[i + 1] for i in range(n)]), kind="stable"), kind="stable")
    size = int(s.max()) + 1
    z = np.concatenate([s, np.zeros(4, np.int64)]).astype(np.int64)
    one, two = np.arange(1, n + 1, 3), np.arange(2, n + 2, 3)
    cover = np.concatenate([one, two])
    pair = z[cover] * size + z[cover + 1]
    if size > 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    distinct, names = np.unique(pair * size + z[cover + 2], return_inverse=True)
    names = names.reshape(-1) + 1
    if len(distinct) < len(cover) and depth > 3:
        joined = np.concatenate([names[: len(one)], [0], names[len(one) :]])
        deep = suffix_order(joined + 1, -(-depth // 3))
        names = np.concatenate([deep[: len(one)], deep[len(one) + 1 :]]) + 1
    rank = np.zeros(n + 5, np.int64)
    rank[cover] = names
    rank[n:] = 0
    top = int(rank.max()) + 1
    zero = np.arange(0, n, 3)
    by_one, by_two = z[zero] * top + rank[zero + 1], (z[zero] * size + z[zero + 1], rank[zero + 2])
    one, two = one[one < n], two[two < n]
    first = z[one] * top + rank[one + 1]
    both = np.unique(np.concatenate([z[two] * size + z[two + 1], by_two[0]]), return_inverse=True)[1].reshape(-1)
    second, zero_second = both[: len(two)] * top + rank[two + 2], both[len(two) :] * top + by_two[1]
    cover = np.concatenate([one, two])
    own = np.argsort(np.argsort(rank[cover], kind="stable"), kind="stable")
    zero_own = np.argsort(np.argsort(by_one, kind="stable"), kind="stable")
    sorted_zero, sorted_zero_second = np.sort(by_one), np.sort(zero_second)
    out = np.empty(n, np.int64)
    out[one] = own[: len(one)] + np.searchsorted(sorted_zero, first, "right")
    out[two] = own[len(one) :] + np.searchsorted(sorted_zero_second, second, "right")
    out[zero] = zero_own + np.searchsorted(np.sort(first), by_one) + np.searchsorted(np.sort(second), zero_second)
    return out


def _matched(docs: int):
    """Strings of a bucket -> spans of windows that also start in a smaller document."""

    def run(table: pa.Table) -> pa.Table:
        parts_ = [(_unpacked(b, "<i8", "<u4", "<i8", "<u1"), w) for b, w in zip(table.column("blob").to_pylist(), table.column("bytes").to_pylist(), strict=True)]
        doc, twin, at, n = (np.concatenate([p[0][i] for p in parts_]) for i in range(4))
        n = n.astype(np.int64)
        length = n + MATCH - 1
        data = np.frombuffer(b"".join(p[1] for p in parts_), np.uint8)
        begin = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
        own = np.repeat(np.arange(len(doc)), length)
        place = np.arange(len(data)) + own
        s = np.zeros(len(data) + len(doc), np.int64)
        s[place] = data.astype(np.int64) + 1
        rank = suffix_order(s + 1, MATCH)
        window = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(np.arange(len(doc)), n)
        order = np.argsort(rank[window], kind="stable")
        window, of = window[order], of[order]
        z = np.concatenate([s, np.zeros(8, np.int64)]).astype(np.uint64)
        eight = np.zeros(len(s), np.uint64)
        for i in range(7):
            eight = eight * np.uint64(257) + z[i : i + len(s)]
        same = np.ones(max(0, len(window) - 1), bool)
        for i in [*range(0, MATCH - 6, 7), MATCH - 7]:
            e = eight[window + i]
            same &= e[1:] == e[:-1]
        group = np.cumsum(np.concatenate([[0], ~same])) if len(window) else np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], ~same])) if len(window) else np.zeros(0, np.int64)
        d = doc[of]
        later = d > np.minimum.reduceat(d, first)[group] if len(window) else np.zeros(0, bool)
        of, window = of[later], window[later]
        return pa.Table.from_batches([_rows(list(_by_doc(doc[of], twin[of], at[of] + window - begin[of], np.full(len(of), MATCH), docs, 1)))])

    return run


def _spans_of(spans: pa.Table) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Maximal (start, end) by (doc, twin)."""
    doc, twin, at, length = _gathered(spans.column("blob").to_pylist(), *_SPAN)
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for _, _, blob in _by_doc(doc, twin, at, length, 1, 1):
        for d, t, a, m in zip(*(x.tolist() for x in _unpacked(blob, *_SPAN)), strict=True):
            out.setdefault((d, t), []).append((a, a + m))
    return out


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, last = [], 0
    for a, b in spans:
        out.append(data[last:a])
        last = b
    out.append(data[last:])
    return b"".join(out)


def _removal(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with their bucket, spans by bucket of documents)."""
    spark = docs.sparkSession
    #: A bucket of anchors sends one packed row to each bucket of documents.
    groups, buckets = parts(spark) + 1 - parts(spark) % 2, parts(spark) * 3 + 1
    texts = docs.withColumn("bucket", F.coalesce(F.pmod("doc_id", F.lit(groups)), F.pmod(F.xxhash64("text"), F.lit(groups))).cast("long"))
    schema = "bucket long, kind int, blob binary"
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(_anchored(buckets, groups), schema)
    #: Spans found within a task carry the bucket of their document; negative keys keep them apart.
    keyed = rows.withColumn("key", F.when(F.col("kind") == 0, F.col("bucket")).otherwise(-1 - F.col("bucket")))

    def settle(table: pa.Table) -> pa.Table:
        return table.select(["bucket", "kind", "blob"]) if table.column("kind")[0].as_py() else _settle(groups)(table)

    settled = cut(keyed.groupBy("key").applyInArrow(settle, schema))
    asks = settled.filter("kind = 2").select("bucket", "blob")
    strings = texts.groupBy("bucket").cogroup(asks.groupBy("bucket")).applyInArrow(_fetch(buckets), "bucket long, blob binary, bytes binary")
    found = strings.groupBy("bucket").applyInArrow(_matched(groups), schema)
    return texts, settled.filter("kind = 1").select("bucket", "blob").union(found.select("bucket", "blob"))


def substring_removal(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of documents.

    Null texts are empty. Rows without a doc_id have no order: nothing is removed from them, and they remove
    nothing. Rows that share a doc_id are one document to each other. A text of any length is one row, cut to
    overlapping chunks of ``CHUNK`` bytes inside. Other columns are ignored; an empty table gives no rows.
    """

    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        found, rows = _spans_of(spans), []
        for k, text in zip(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist(), strict=True):
            data = text.encode()
            own = found.get((k, zlib.crc32(data)), [])
            rows.append((k, len(data), sum(b - a for a, b in own), len(own), sha256(_kept(data, own)).hexdigest()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table({c: pa.array(v, pa.string() if c == "kept_sha256" else pa.int64()) for c, v in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), cols, strict=True)})

    texts, spans = _removal(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    return texts.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated bytes, all columns kept; those of which nothing is left go.

    Bytes that no longer make a character, where a match began or ended inside one, go too. Null texts stay null; rows
    without a doc_id lose nothing and take nothing from others; rows that share an id are one document to each other, so
    repeated rows stay alike; a text of any length is one row; columns may have any names; an empty table gives no rows.
    """
    names, kinds = docs.columns, docs.schema
    own = [F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"]
    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.struct(*own).alias("rest"), F.col("text").isNull().alias("none"))
    schema = StructType([StructField("text", StringType()), inner.schema["rest"], StructField("none", BooleanType())])

    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        found, kept, out = _spans_of(spans), [], []
        for i, (k, text) in enumerate(zip(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist(), strict=True)):
            own = found.get((k, zlib.crc32(text.encode())), []) if found else []
            left = _kept(text.encode(), own).decode(errors="ignore") if own else text
            if left or not text:
                kept.append(i)
                out.append(left)
        rows = texts.take(pa.array(kept, pa.int64()))
        return pa.table({"text": pa.array(out, pa.string()), "rest": rows.column("rest"), "none": rows.column("none")})

    texts, spans = _removal(inner)
    out = texts.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(run, schema)
    return out.select(*[F.when(~F.col("none"), F.col("text")).cast(kinds["text"].dataType).alias(c) if c == "text" else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(names)])
