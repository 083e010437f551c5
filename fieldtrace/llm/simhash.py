"""SimHash near-duplicates found with a Gray-order hierarchical index.

Upper nodes of the index factor out a shared masked bit pattern. Fingerprints that differ in at most
``RADIUS`` bits agree in one of RADIUS + 1 disjoint masks, so each fingerprint goes to RADIUS + 1 upper
nodes, and a pair is found in the node whose whole mask it shares. A node with too many members is split
again in the same way over its remaining bits; members are distinct, so the splitting ends. Inside a
node the members are sorted by Gray rank and cut into groups of groups with AND/OR masks; pairs of
groups are pruned as soon as their factored patterns have accumulated more differences than allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts, text_or_empty
from .components import components

WORDS, RADIUS, SEED = 3, 2, 42
#: Members of an upper node that one task handles; larger nodes are split. Fan-out of the inner groups.
NODE, FAN = 4096, 16
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15


def fingerprint(data: bytes) -> int:
    words = data.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        votes += np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, twin, fp): signed 64-bit fingerprint of each whole text; null texts and texts without words: 0.

    twin is a hash of the text, which tells rows apart that share a doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.encode()) for x in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "twin", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("twin"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, twin long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def near_pairs(nodes: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``fps`` (uint64) of one node that differ in at most ``radius`` bits, from hierarchies over Gray order.

    ``nodes`` numbers the upper node of each fingerprint. Members of a node, sorted by Gray rank, are cut into groups
    of FAN, these into groups of groups, up to one group a node. A group keeps the bits that all its members
    share; a pair of groups is pruned with all below it if these patterns already differ too much.
    """
    order = np.lexsort((gray_rank(fps), nodes))
    value, mask, node = fps[order], ~np.zeros(len(fps), np.uint64), nodes[order]
    levels, children = [(value, mask)], []
    while len(node):
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        place = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
        starts = np.flatnonzero(place % FAN == 0)
        low, high = np.bitwise_and.reduceat(value & mask, starts), np.bitwise_or.reduceat(value & mask, starts)
        mask = np.bitwise_and.reduceat(mask, starts) & ~(low ^ high)
        value, node = low & mask, node[starts]
        children.append((starts, np.diff(np.append(starts, len(place)))))
        levels.append((value, mask))
        if len(starts) == len(first):
            break
    top = np.arange(len(node))
    stack = [(len(levels) - 1, top, top)]
    while stack:
        depth, a, b = stack.pop()
        value, mask = levels[depth]
        close = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b]) <= radius
        a, b = a[close], b[close]
        if depth == 0:
            if len(a):
                yield order[a], order[b]
            continue
        start, size = children[depth - 1]
        step = max(1, (1 << 20) // FAN**2)
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            many = size[x] * size[y]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            wide = np.repeat(size[y], many)
            x, y = np.repeat(start[x], many) + at // wide, np.repeat(start[y], many) + at % wide
            new = x < y if depth == 1 else x <= y
            stack.append((depth - 1, x[new], y[new]))


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the classes of each pair; a label is the least index of its class."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (labels != (up := labels[labels])).any():
            labels = up


def _node_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a spanning forest for each node) within runs of equal keys."""
    node = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).any(axis=1)]))
    labels = np.arange(len(fps))
    some = np.flatnonzero(np.bincount(node)[node] > 1)
    for a, b in near_pairs(node[some], fps[some]) if len(some) else ():
        labels = _joined(labels, some[np.minimum(a, b)], some[np.maximum(a, b)])
    at = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[at], fps[labels[at]]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, pattern, fp) sorted by node: links of every node; a node may go over several batches."""
    rest = np.zeros((0, 3), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        u, v = _node_links(rows[:, :2], rows[:, 2].copy().view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
        last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        split = int(last[-1]) + 1 if len(last) else 0
        if split:
            yield links(rows[:split])
        rest = rows[split:]
    if len(rest):
        yield links(rest)


def _masks(mask: int) -> list[int]:
    """Disjoint masks, one more than the radius, that cover the bits which ``mask`` leaves."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, node: int | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` whose closure joins all that are within the radius."""
    spark, node = distinct.sparkSession, node or NODE
    todo, found = distinct.select("fp"), None
    nodes = todo.select(F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in _masks(0)])).alias("mask"), "fp")
    layer = _masks(0)
    while True:
        nodes = nodes.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        tree = {m: _masks(m) for m in layer}
        hot = cut(nodes.groupBy("mask", "pattern").count().filter(F.col("count") > node).drop("count"))
        end = hot.isEmpty() or not all(len(x) > RADIUS for x in tree.values())
        calm = nodes if end else nodes.join(hot, ["mask", "pattern"], "left_anti")
        out = calm.select("mask", "pattern", "fp").repartition(parts(spark), "mask", "pattern").sortWithinPartitions("mask", "pattern").mapInArrow(_search, "u long, v long")
        found = out if found is None else found.union(out)
        if end:
            return found
        children = F.create_map(*[x for m, below in tree.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(c)).cast("long") for c in below]))])
        nodes = nodes.join(hot, ["mask", "pattern"], "left_semi").select(F.explode(children[F.col("mask")]).alias("mask"), "fp")
        layer = [c for below in tree.values() for c in below]


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, twin, fp, component_id, first): first is the least (doc_id, twin) of the group.

    Groups are folded by fingerprint before they meet by root, and the roots' table is written, so that
    rows of one large group are dealt by fingerprint in a join that adaptive execution can split.
    """
    rows = cut(fingerprints(docs))
    own = F.struct("doc_id", "twin")
    reps = rows.groupBy("fp").agg(F.min(F.when(F.col("doc_id").isNotNull(), own)).alias("first"))
    roots = components(links(reps))
    joined = cut(reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = cut(joined.groupBy("root").agg(F.min("first").alias("first")))
    named = joined.drop("first").join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"), "first")
    return rows.join(cut(named), "fp")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): groups of texts linked by fingerprints within ``RADIUS`` bits.

    Null texts and texts without words have fingerprint zero and are linked like any other. A null
    doc_id is kept and never becomes a component_id unless its whole group has no other; repeated rows
    are repeated in the result; a text of any length is one row and read whole;
    other columns are ignored; an empty table gives no rows.
    """
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_group(docs: DataFrame) -> DataFrame:
    """One row of each group, that with the smallest doc_id, all columns kept; of equal rows one.

    Rows without a doc_id stay, and so do groups of them; null and empty texts are a group of their own; texts of any
    length count whole; other columns may have any name; an empty table gives no rows.
    """
    names = docs.columns
    rows = _grouped(docs).filter("doc_id is not null")
    gone = rows.filter("doc_id <> first.doc_id or twin <> first.twin").select("doc_id", "twin").distinct()
    #: One row for each (doc_id, text) that stays and of which there are several.
    again = rows.groupBy("doc_id", "twin").count().filter("count > 1").select("doc_id", "twin")
    marks = gone.withColumn("gone", F.lit(True)).join(again.withColumn("again", F.lit(True)), ["doc_id", "twin"], "full").toDF("k", "t", "gone", "again")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("twin"))
    left = own.join(marks, (F.col("id") == F.col("k")) & (F.col("twin") == F.col("t")), "left").filter("gone is null")
    once, more = left.filter("again is null"), left.filter("again").dropDuplicates(["id", "twin"])
    return once.select("row.*").union(more.select("row.*"))
