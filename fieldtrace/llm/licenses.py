"""License scan by diagonal voting.

All rolling word k-gram hashes of the documents are joined to the positions of the same k-grams in
license templates. Hits are counted per document, template and diagonal (document position less template
position), neighbouring diagonals are merged, also over words that were put in between, and the words of each span
are compared with the template's. A filter of the templates' hashes, of fixed size, holds back grams that can't join.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Fixed values of the contract: phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Opening or key sentences of public licenses, by label.
TEMPLATES = {
    "apache": "licensed under the apache license version 2.0 you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4.0 international license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-short": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2.0",
}
#: Whole texts of short public licenses.
TEMPLATES |= {
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to use
        copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software
        is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the software the software is provided as is without warranty of any kind
        express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
        noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether
        in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings
        in the software""",
    "isc-text": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the
        author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in
        no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting
        from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in
        connection with the use or performance of this software""",
    "bsd-text": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and
        the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and
        the following disclaimer in the documentation and or other materials provided with the distribution""",
}
#: Templates whose label is another's.
SAME = {"gpl-short": "gpl", "mit-text": "mit", "isc-text": "isc", "bsd-text": "bsd"}
#: Words of a gram; diagonals that far apart are merged; least share of a template's grams and words within a span.
GRAM, BAND, COVER = 3, 3, 0.6
#: Flags of the filter; words between hits of one stretch; most words of all templates.
FILTER, REACH, TEMPLATE_WORDS = 1 << 20, 12, 200_000

_WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_hash: dict[bytes, int] = {}


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().translate(_LOWER))


def gram_hashes(found: list[bytes]) -> np.ndarray:
    """64-bit hashes of the rolling grams of a list of words."""
    if len(_hash) > 1_000_000:
        _hash.clear()
    get = _hash.get
    own = []
    for w in found:
        h = get(w)
        if h is None:
            h = _hash[w] = zlib.crc32(w) << 32 | zlib.crc32(w[::-1] + b"/")
        own.append(h)
    one = np.array(own, np.uint64)
    n = len(one) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = (out ^ one[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def phrase_starts(found: list[bytes]) -> dict[str, list[int]]:
    """Word places at which each phrase's words stand."""
    line = b" " + b" ".join(found) + b" "
    out, starts = {}, None
    for phrase in PHRASES:
        sought, at, places = b" " + phrase.encode() + b" ", 0, []
        while (at := line.find(sought, at)) >= 0:
            if starts is None:
                starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in found])]).tolist()
            places.append(bisect_left(starts, at))
            at += 1
        if places:
            out[phrase] = places
    return out


def _filter(templates: dict[str, str]) -> np.ndarray:
    """FILTER flags, set for the templates' grams."""
    flags = np.zeros(FILTER, bool)
    for text in templates.values():
        flags[gram_hashes(words(text)).view(np.uint64) % np.uint64(FILTER)] = True
    return flags


def read(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, twin, n_words, n_base, first_word, last_word, base, grams, near) of each text.

    grams are (place, gram) of those that may be a template's; near are the stretches of words around them.
    """
    schema = "doc_id long, twin long, n_words long, n_base long, first_word long, last_word long, base array<string>, grams array<struct<place:long,gram:long>>, near array<struct<at:long,words:string>>"
    flags = _filter(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "twin", "n_words", "n_base", "first_word", "last_word", "base", "grams", "near"]
        grams = pa.list_(pa.struct([("place", pa.int64()), ("gram", pa.int64())]))
        types = [pa.int64()] * 6 + [pa.list_(pa.string()), grams, pa.list_(pa.struct([("at", pa.int64()), ("words", pa.string())]))]
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = []
                for k, x in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns), strict=True):
                    found = words(x)
                    places = phrase_starts(found)
                    every = [p for own in places.values() for p in own]
                    twin = zlib.crc32(x.encode()) << 31 | len(x)
                    hashes = gram_hashes(found)
                    hit = np.flatnonzero(flags[hashes.view(np.uint64) % np.uint64(FILTER)])
                    near = []
                    if len(hit):
                        for part in np.split(hit, np.flatnonzero(np.diff(hit) > REACH) + 1):
                            near.append((int(part[0]), b" ".join(found[part[0] : part[-1] + GRAM]).decode()))
                    rows.append((k, twin, len(found), len(every), min(every, default=None), max(every, default=None), sorted({PHRASES[p] for p in places}), list(zip(hit.tolist(), hashes[hit].tolist(), strict=True)), near))
                columns = list(zip(*rows, strict=True))
                columns[7] = [[{"place": p, "gram": g} for p, g in c] for c in columns[7]]
                columns[8] = [[{"at": p, "words": w} for p, w in c] for c in columns[8]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, schema)


def templates_in(spark, path: str) -> dict[str, str]:
    """Templates from the files of a folder, one license each; the label is the file's name without its ending.

    They are a parameter of the scan, as the built-in ones are: at most TEMPLATE_WORDS words in all.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("name"), "value")
    if files.agg(F.sum(F.length("value"))).first()[0] > 8 * TEMPLATE_WORDS:
        raise ValueError("more template text than a scan takes")
    return {r["name"]: r["value"] for r in files.collect()}


def template_grams(spark, templates: dict[str, str]) -> DataFrame:
    """(gram, template, at): fixed by the templates, of TEMPLATE_WORDS words at most."""
    rows = [(int(h), name, i) for name, text in sorted(templates.items()) for i, h in enumerate(gram_hashes(words(text)).tolist())]
    if len(rows) > TEMPLATE_WORDS:
        raise ValueError("more template text than a scan takes")
    return spark.createDataFrame(rows, "gram long, template string, at int")


def agreement(template: list[str], span: list[str]) -> float:
    """Share of the template's words that stand in the span in the same order (in matching blocks)."""
    blocks = SequenceMatcher(None, template, span, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks) / max(1, len(template))


def spans(rows: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, twin, template, first, last, cover): verified template spans in each document's words.

    Groups of diagonals that follow each other within a template's reach are one span: words put into a template shift
    its rest to another diagonal. A span counts if COVER of the template's grams stand in it and COVER of
    its words agree in order.
    """
    templates = templates or TEMPLATES
    size = {name: max(1, len(words(text)) - GRAM + 1) for name, text in templates.items()}
    rows = rows.filter("size(grams) > 0").dropDuplicates(["doc_id", "twin"])
    hits = rows.select("doc_id", "twin", F.explode("grams").alias("g")).select("doc_id", "twin", "g.place", "g.gram")
    hits = hits.join(F.broadcast(template_grams(rows.sparkSession, templates)), "gram")
    own = ["doc_id", "twin", "template"]
    votes = hits.groupBy(*own, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("place").alias("first"), F.max("place").alias("last"))
    order = Window.partitionBy(*own).orderBy("diagonal")
    group = F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= BAND, 0).otherwise(1)).over(order)
    merge = [F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("first").alias("first"), F.max("last").alias("last")]
    merged = votes.withColumn("group", group).groupBy(*own, "group").agg(*merge).drop("group")
    total = F.create_map(*[x for name, n in sorted(size.items()) for x in (F.lit(name), F.lit(n))])[F.col("template")]
    place = Window.partitionBy(*own).orderBy("first", "last")
    follows = F.col("first") - F.max("last").over(place.rowsBetween(Window.unboundedPreceding, -1)) <= total
    merged = merged.withColumn("group", F.sum(F.when(follows, 0).otherwise(1)).over(place)).groupBy(*own, "group").agg(*merge)
    #: Most of a template within about its length; where chance hits before or after it make a span too wide, the words decide.
    asked = merged.filter(F.size("ats") >= COVER * total).select(*own, "first", (F.col("last") + GRAM - 1).alias("last"))
    asked = asked.join(rows.select(F.col("doc_id").alias("d"), F.col("twin").alias("t"), "near"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t"))).drop("d", "t")
    text = {name: [w.decode() for w in words(x)] for name, x in templates.items()}

    @F.pandas_udf("first long, last long, cover double")
    def verified(names: pd.Series, first: pd.Series, last: pd.Series, near: pd.Series) -> pd.DataFrame:
        out = []
        for name, a, b, stretches in zip(names, first, last, near, strict=True):
            found = {s["at"] + i: w for s in stretches for i, w in enumerate(s["words"].split(" ")) if a <= s["at"] + i <= b}
            places, wide = sorted(found), 2 * len(text[name]) + BAND
            best = (0.0, a, b)
            for i in range(0, len(places), max(1, len(text[name]) // 2)):
                window = [p for p in places[i : i + wide] if p < places[i] + wide]
                best = max(best, (agreement(text[name], [found[p] for p in window]), window[0], window[-1]))
                if i + wide >= len(places):
                    break
            out.append((best[1], best[2], best[0]))
        return pd.DataFrame(out, columns=["first", "last", "cover"])

    checked = asked.withColumn("v", verified("template", "first", "last", "near")).select(*own, "v.first", "v.last", "v.cover")
    return checked.filter(F.col("cover") >= COVER)


def license_labels(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of documents.

    score is 1 with a base label, else the largest cover of a verified span, else 0. Null texts have no
    words; a null doc_id stays; repeated rows are repeated; texts of any length are read whole; labels are empty
    strings where there are none; other columns are ignored; an empty table gives no rows.
    """
    rows = cut(read(docs, templates=templates))
    same = F.create_map(*[F.lit(x) for pair in SAME.items() for x in pair])
    found = spans(rows, templates).withColumn("label", F.coalesce(same[F.col("template")], "template"))
    found = found.groupBy("doc_id", "twin").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover")).toDF("d", "t", "more", "cover")
    kept = rows.drop("grams", "near").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0)))
    return kept.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", both).alias("labels"), score.alias("score"))
