"""Quality rules: counts of one text, and lines that many documents of a host share.

Normalised lines are hashed, distinct documents are counted per host, lines above the limit are removed, and
documents that lose more than half of their words are rejected. With ``distinct="texts"`` documents of equal
text count once, so that copies of a page don't make its lines common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: A line is common in a host if more distinct documents than this, and than this share of the host's, have it.
LEAST_DOCS, SHARE = 25, 0.01
#: A document is depleted if removal takes more than this share of its words.
LOST = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Fewest words of a line that is counted (and may be removed).
LINE_WORDS = 1

_WORDS = regex.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = regex.compile(r"[#*$%&|<>]")
_DIGITS = regex.compile(r"[0-9]+")

_RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    names: dict[str, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    _, pair = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)
    _, place, times = np.unique(pair[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)
    twice = (times[place] > 1).astype(np.int64)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(twice)] += twice
    edge[3 : 3 + len(twice)] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def normal(line: str) -> str:
    """Lower case, single spaces, every number as 0."""
    return _DIGITS.sub("0", " ".join(_WORDS.findall(line)).lower())


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(normal(line).encode()) - (1 << 63)


def counts(text: str, least: int = LINE_WORDS) -> tuple[tuple[int, ...], dict[int, int]]:
    """The rules' counts, and the words of each hash of normalised lines of ``least`` words or more."""
    words = _WORDS.findall(text)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    found = {}
    for line in lines:
        n = len(_WORDS.findall(line))
        if n >= least:
            h = line_hash(line)
            found[h] = found.get(h, 0) + n
    rules = (len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(words))
    return rules, found


def measured(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", least: int = LINE_WORDS) -> DataFrame:
    """(doc_id, host, twin, counts..., lines): lines is an array of (hash, words); twin is a hash of the whole text."""
    schema = f"doc_id long, host string, twin long, {_RULES}, hashes array<long>, line_words array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                rows = batch.slice(i, 1024)
                texts = rows.column(2).to_pylist()
                found = [counts(x, least) for x in texts]
                columns = [pa.array([f[0][k] for f in found], pa.int64()) for k in range(5)]
                twin = pa.array([xxhash.xxh64_intdigest(x.encode()) - (1 << 63) for x in texts], pa.int64())
                hashes, n = (pa.array([list(g(f[1])) for f in found], pa.list_(pa.int64())) for g in (dict.keys, dict.values))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), twin, *columns, hashes, n], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), text_or_empty(text).alias("text")).mapInArrow(run, schema)


def common_lines(rows: DataFrame, distinct: str = "documents") -> DataFrame:
    """(host, hash) of lines that more documents of a host have than its limit. Rows are those of ``measured``.

    Repeated rows of a doc_id are one document; rows without one are told apart by their text.
    """
    one = F.coalesce("doc_id", "twin") if distinct == "documents" else F.col("twin")
    limit = rows.groupBy("host").agg(F.greatest(F.lit(float(LEAST_DOCS)), F.count_distinct(one) * SHARE).alias("limit"))
    seen = rows.select("host", one.alias("one"), F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count_distinct("one").alias("count")).filter(F.col("count") > LEAST_DOCS)
    return seen.join(limit, seen["host"].eqNullSafe(limit["host"])).filter("count > limit").select(seen["host"], "hash")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def lost_words(rows: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, twin, host, lost): words in common lines, for rows that have such lines; one row for equal ones."""
    lines = rows.select("doc_id", "twin", "host", F.explode(F.arrays_zip("hashes", "line_words")).alias("line")).select("doc_id", "twin", "host", F.col("line.hashes").alias("hash"), F.col("line.line_words").alias("n")).distinct()
    hit = lines.join(common.select(F.col("host").alias("h"), F.col("hash").alias("x")), F.col("host").eqNullSafe(F.col("h")) & (F.col("hash") == F.col("x")), "left_semi")
    return hit.groupBy("doc_id", "twin", "host").agg(F.sum("n").alias("lost"))


def _with(rows: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    extra = extra.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in extra.columns if c not in keys])
    on = [rows[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(extra, on, "left").drop(*[f"_{k}" for k in keys])


def line_rules(docs: DataFrame, distinct: str = "documents", least: int = LINE_WORDS) -> DataFrame:
    """The counts, base_failed, lost (words in common lines) and kept of each row of documents.

    Null texts count as empty and fail the base rules; a null source is a host of its own; repeated
    rows are repeated and judged alike; texts of any length are read whole; other columns are ignored; an empty table
    gives no rows.
    """
    rows = cut(measured(docs, least=least))
    out = _with(rows, lost_words(rows, common_lines(rows, distinct)), ["doc_id", "twin", "host"]).withColumn("lost", F.coalesce("lost", F.lit(0)))
    return out.select("doc_id", *[x.split()[0] for x in _RULES.split(", ")], base_failed().alias("base_failed"), (~base_failed() & (F.col("lost") <= F.col("n_words") * LOST)).alias("kept"), F.col("lost").alias("n_common_line_words"))


def clean(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", distinct: str = "documents", least: int = LINE_WORDS) -> DataFrame:
    """The documents without their common lines; rejected documents go. All columns stay, of any name.

    Null and empty texts fail the base rules and go, as ``line_rules`` says; a null source or key is a value of its own;
    repeated rows stay repeated; an empty table gives no rows.
    """
    rows = cut(measured(docs, key, host, text, least))
    common = cut(common_lines(rows, distinct))
    lines = rows.select("doc_id", "twin", "host", F.explode("hashes").alias("hash")).distinct()
    hit = lines.join(common.select(F.col("host").alias("h"), F.col("hash").alias("x")), F.col("host").eqNullSafe(F.col("h")) & (F.col("hash") == F.col("x")), "left_semi")
    gone = hit.groupBy("doc_id", "twin", "host").agg(F.collect_set("hash").alias("gone"))
    keys = ["doc_id", "twin", "host"]
    marks = _with(_with(rows.select(*keys, "n_words", base_failed().alias("failed")).distinct(), lost_words(rows, common), keys), gone, keys)
    marks = marks.select("doc_id", "twin", "host", (F.col("failed") | (F.coalesce("lost", F.lit(0)) > F.col("n_words") * LOST)).alias("bad"), "gone").filter("bad or gone is not null")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("k0"), _twin(text).alias("k1"), F.col(host).cast("string").alias("k2"))
    own = own.join(marks, F.col("k0").eqNullSafe(F.col("doc_id")) & (F.col("k1") == F.col("twin")) & F.col("k2").eqNullSafe(F.col("host")), "left").filter("not coalesce(bad, false)")

    @F.pandas_udf("string")
    def without(texts, sets):
        def left(t, g):
            g = set(g.tolist())
            return "\n".join(x for x in t.split("\n") if len(_WORDS.findall(x)) < least or line_hash(x) not in g)

        return type(texts)([t if g is None or t is None else left(t, g) for t, g in zip(texts, sets, strict=True)])

    out = F.when(F.col("gone").isNull(), F.col("text")).otherwise(without(F.col("text"), "gone")).cast(docs.schema[text].dataType)
    return own.select(*[out.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _twin(text: str) -> Column:
    @F.pandas_udf("long")
    def twin(texts):
        return type(texts)([xxhash.xxh64_intdigest(x.encode()) - (1 << 63) for x in texts])

    return twin(text_or_empty(text))
