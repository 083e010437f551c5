"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, all texts that aren't held out are the unlabelled mixture. A linear model
over hashed words and 5-letter pieces of words is trained in numpy with the class-prior-corrected risk
``prior * R+(P) + max(0, R-(U) - prior * R-(P))``; where the second part falls below zero the step goes
the other way, so the model doesn't overfit the positives.

1. One pass counts in how many (text, distinct word) pairs each slot stands, for P and for U. Slots that are clearly more
   frequent in P are used; their log ratio is the starting weight.
2. A second pass writes each text's used slots. Texts with the same ones are one row with counts.
3. Each training step sums risk and gradient over these rows, in tasks; only one number a used slot meets in the driver.

All texts take part. Only the list of positives is bounded (``POSITIVES`` labelled rows, the first by hash of the id).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Most labelled positives that training uses; hash slots, in blocks that are summed together; folds, of which the first is held out.
POSITIVES, SLOTS, BLOCKS, FOLDS = 20_000, 1 << 18, 64, 5
#: A slot is used if it is so many times as frequent among positives and so many standard errors above; at most so many slots.
LEAST_LIFT, LEAST_Z, FEATURES = 2.0, 1.5, 1024
#: Letters of a piece; bounds of starting weights; starting bias.
PIECE, LARGEST, BIAS = 5, 3.0, -3.0
#: Training steps, rate, pull to the starting weights; bounds of the class prior.
STEPS, RATE, DECAY, PRIORS = 100, 0.1, 1e-5, (0.01, 0.5)
#: Taken off the trained bias, as a clean text that is flagged is worse than a toxic one that isn't. It, STEPS and LEAST_Z were
#: chosen on folds 1 to 4 of the labels, each in turn left out of training.
MARGIN = 1.0
#: Words that a task remembers at a time; rows of a task in a training step.
REMEMBERED, STEP_ROWS = 100_000, 100_000
#: Tasks whose counts are summed together first, as a power of two.
LEVEL = 10
#: Tasks whose sums of a training step meet in one task, or in the driver.
FAN_IN = 64

_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
#: Sums of shares travel as whole numbers of this size, so that their order doesn't matter.
_UNIT = float(1 << 50)


class Model(NamedTuple):
    slots: np.ndarray
    weights: np.ndarray
    bias: float


def words(text: str) -> set[bytes]:
    return set(_WORD.findall(text.lower().encode()))


def word_slots(word: bytes) -> set[int]:
    """Slots of a word and of its pieces; ``^`` and ``$`` mark its ends."""
    marked = b"^" + word + b"$"
    return {zlib.crc32(marked) % SLOTS, *(zlib.crc32(marked[i : i + PIECE]) % SLOTS for i in range(len(marked) - PIECE + 1))}


def held_out(doc_id) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def slot_counts(times: Counter) -> np.ndarray:
    """Pairs of texts and distinct words by slot; ``times`` has the texts of each word."""
    out = np.zeros(SLOTS, np.int64)
    for word, n in times.items():
        for slot in word_slots(word):
            out[slot] += n
    return out


def pick(positive: np.ndarray, everything: np.ndarray, pairs: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Used slots and their starting weights, from counts by slot and the pairs of both."""
    if not pairs[0] or not pairs[1]:
        return np.zeros(0, np.int64), np.zeros(0)
    p, u = (positive + 0.5) / (pairs[0] + 1), (everything + 0.5) / (pairs[1] + 1)
    z = (p - u) / np.sqrt(p / pairs[0] + u / pairs[1])
    used = np.flatnonzero((p > LEAST_LIFT * u) & (z > LEAST_Z))
    used = np.sort(used[np.argsort(-z[used], kind="stable")][:FEATURES])
    return used, np.minimum(np.log(p[used] / u[used]), LARGEST)


def risk_parts(flat: np.ndarray, size: np.ndarray, p: np.ndarray, u: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Sums over rows for sigmoid loss: R-(P), R-(U), then the gradients of R-(P) and of R-(U) by weights and bias.

    ``flat`` has the rows' used slots one after another, ``size`` their number; p and u are the rows' shares of P and U.
    R+(P) is the share of P less R-(P), and its gradient the negative one.
    """
    owner = np.repeat(np.arange(len(size)), size)
    z = np.bincount(owner, weights[flat], len(size)) + bias
    loss = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    slope = loss * (1 - loss)
    sums = [np.append(np.bincount(flat, (slope * share)[owner], len(weights)), (slope * share).sum()) for share in (p, u)]
    return np.concatenate([[(loss * p).sum(), (loss * u).sum()], *sums])


def descend(parts, start: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias after the training steps; ``parts(weights, bias)`` gives the sums of ``risk_parts`` over all rows."""
    k = len(start)
    w, bias = start.copy(), BIAS
    moment, square = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1 if k else 1):
        found = parts(w, bias)
        of_p, of_u = found[2 : k + 3], found[k + 3 :]
        grad = of_u - 2 * prior * of_p if found[1] - prior * found[0] >= 0 else prior * of_p - of_u
        grad = grad + DECAY * np.append(w - start, 0.0)
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        delta = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, bias = w - delta[:-1], bias - delta[-1]
    return w, float(bias)


COUNTS = pa.schema([("block", pa.int32()), ("level", pa.int32()), ("counts", pa.binary()), ("of_p", pa.int64()), ("of_u", pa.int64())])


def _counted(positives: np.ndarray):
    """Texts -> (block, packed counts of P and U, pairs of P and U) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, total = (Counter(), Counter()), np.zeros((2, SLOTS), np.int64)
        pairs = [0, 0]

        def settle() -> None:
            for i in range(2):
                total[i] += slot_counts(times[i])
                pairs[i] += sum(times[i].values())
                times[i].clear()

        for batch in batches:
            marks = np.isin(batch.column(0).to_numpy(zero_copy_only=False), positives)
            for a in range(0, batch.num_rows, 256):
                for mark, text in zip(marks[a : a + 256].tolist(), batch.column(1).slice(a, 256).to_pylist(), strict=True):
                    found = words(text)
                    times[1].update(found)
                    if mark:
                        times[0].update(found)
                if len(times[1]) > REMEMBERED:
                    settle()
        settle()
        blobs = [zlib.compress(np.ascontiguousarray(x).tobytes(), 1) for x in np.split(total, BLOCKS, axis=1)]
        n = [pa.array([x] + [0] * (BLOCKS - 1), pa.int64()) for x in pairs]
        level = pa.array([TaskContext.get().partitionId() >> LEVEL] * BLOCKS, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), level, pa.array(blobs, pa.binary()), *n], COUNTS.names)

    return run


def _summed(table: pa.Table) -> pa.Table:
    """A block's counts of several tasks, or of several sums of tasks, as one row."""
    total = np.zeros((2, SLOTS // BLOCKS), np.int64)
    for blob in table.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(blob), np.int64).reshape(2, -1)
    n = [[sum(table.column(c).to_pylist())] for c in ("of_p", "of_u")]
    return pa.table([table.column("block").slice(0, 1), table.column("level").slice(0, 1), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()), *(pa.array(x, pa.int64()) for x in n)], schema=COUNTS)


class _Used:
    """Places of a text's used slots in the list of used ones; words are looked up once a task."""

    def __init__(self, slots: np.ndarray):
        self.place = {s: i for i, s in enumerate(slots.tolist())}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: str) -> list[int]:
        found: set[int] = set()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for word in words(text) if self.place else ():
            own = self.known.get(word)
            if own is None:
                own = self.known[word] = tuple(self.place[s] for s in word_slots(word) if s in self.place)
            if own:
                found.update(own)
        return sorted(found)


def _patterns(docs: DataFrame, slots: np.ndarray, positives: np.ndarray) -> DataFrame:
    """(doc_id, held_out, positive, pattern): used slots of each text as packed 16-bit places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = _Used(slots)
        for batch in batches:
            marks = pa.array(np.isin(batch.column(0).to_numpy(zero_copy_only=False), positives))
            found = [np.array(used(t), "<u2").tobytes() for a in range(0, batch.num_rows, 256) for t in batch.column(2).slice(a, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), marks, pa.array(found, pa.binary())], ["doc_id", "held_out", "positive", "pattern"])

    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, positive boolean, pattern binary")


def _joined(patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(patterns), "<u2").astype(np.int64), np.array([len(x) // 2 for x in patterns], np.int64)


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def _trained(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the patterns of all rows."""
    docs = _own(docs)
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = labels.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    prior = min(max(float(share), PRIORS[0]), PRIORS[1])
    chosen = labels.filter("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES)
    positives = np.array(sorted(r[0] for r in chosen.collect()), np.int64)

    counts = docs.filter(~held_out("doc_id")).mapInArrow(_counted(positives), "block int, level int, counts binary, of_p long, of_u long")
    levels = counts.groupBy("block", "level").applyInArrow(_summed, counts.schema)
    blocks = levels.groupBy("block").applyInArrow(_summed, counts.schema).orderBy("block").collect()
    by_slot = np.concatenate([np.frombuffer(zlib.decompress(r.counts), np.int64).reshape(2, -1) for r in blocks], axis=1) if blocks else np.zeros((2, SLOTS), np.int64)
    slots, start = pick(by_slot[0], by_slot[1], (sum(r.of_p for r in blocks), sum(r.of_u for r in blocks)))

    every = cut(_patterns(docs, slots, positives))
    rows = every.filter("not held_out").groupBy("pattern").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.count("*").alias("u"))
    rows = cut(rows)
    n, n_p, n_u = (max(1, x or 0) for x in rows.agg(F.count("*"), F.sum("p"), F.sum("u")).first())
    rows = rows.coalesce(-(-n // STEP_ROWS))

    tasks = -(-n // STEP_ROWS)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                own = np.frombuffer(blob, np.int64)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def parts(weights: np.ndarray, bias: float) -> np.ndarray:
        width = 2 * len(weights) + 4

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                flat, size = _joined(batch.column(0).to_pylist())
                p, u = (batch.column(i).to_numpy(zero_copy_only=False) / n for i, n in ((1, n_p), (2, n_u)))
                total += risk_parts(flat, size, p, u, weights, bias)
            yield pa.RecordBatch.from_arrays([pa.array([np.rint(total * _UNIT).astype(np.int64).tobytes()], pa.binary())], ["sums"])

        found, left = rows.mapInArrow(run, "sums binary"), tasks
        while left > FAN_IN:
            left = -(-left // FAN_IN)
            found = found.repartition(left).mapInArrow(summed, "sums binary")
        return sum((np.frombuffer(r.sums, np.int64) for r in found.collect()), np.zeros(width, np.int64)) / _UNIT

    weights, bias = descend(parts, start, prior)
    return Model(slots, weights, bias - MARGIN), every


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of documents.

    Null texts score as empty ones; a null doc_id isn't held out and is never a positive; repeated rows are repeated
    and count as often; texts of any length are read whole; other columns aren't read; conflicting labels of an id
    count as toxic, null labels don't count; without labels every score is that of the bias, under a half.
    """
    model, rows = _trained(docs, labels)

    @F.pandas_udf("double")
    def score(patterns: pd.Series) -> pd.Series:
        flat, size = _joined(patterns.tolist())
        return pd.Series(_probability(np.bincount(np.repeat(np.arange(len(size)), size), model.weights[flat], len(size)) + model.bias))

    out = rows.select("doc_id", "held_out", score("pattern").alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose text isn't predicted to be toxic, all columns kept.

    Rows, nulls and labels are handled as in ``toxic_scores``; names of columns don't matter but for doc_id and text.
    """
    model, _ = _trained(docs, labels)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        used = _Used(model.slots)
        for texts in batches:
            yield pd.Series([bool(model.weights[used(t)].sum() + model.bias < 0) for t in texts], dtype=bool)

    return docs.filter(clean(text_or_empty()))


def fit(texts: Iterable[tuple[str, bool]], prior: float) -> Model:
    """The same training on one machine, for small tables and tests: (text, is it a positive) of all rows that aren't held out."""
    rows = [(words(t), mark) for t, mark in texts]
    times = [Counter(w for found, mark in rows if mark or every for w in found) for every in (False, True)]
    slots, start = pick(*map(slot_counts, times), tuple(sum(t.values()) for t in times))
    used = _Used(slots)
    flat, size = _joined([np.array(used(t), "<u2").tobytes() for t, _ in texts])
    p, u = np.array([m for _, m in rows], float), np.ones(len(rows))
    shares = p / max(1.0, p.sum()), u / max(1.0, u.sum())
    weights, bias = descend(lambda w, b: risk_parts(flat, size, *shares, w, b), start, prior)
    return Model(slots, weights, bias - MARGIN)
