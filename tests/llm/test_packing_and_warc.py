import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from fieldtrace.llm import packing, warc


def check_pack(rows, texts):
    own = Tokenizer.from_file(packing.vocabulary())
    ids = defaultdict(list)
    for k, text in texts:
        ids[k].append([*own.encode(text or "", add_special_tokens=False).ids, 2])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for k, own_ids in ids.items():
        want = sorted((a, len(x[a : a + 4096]), zlib.crc32(np.array(x[a : a + 4096], "<u4").tobytes()), len(x)) for x in own_ids for a in range(0, len(x), 4096))
        assert sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[k]) == want
    for own_rows in by_seq.values():
        at = 0
        for r in sorted(own_rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert sorted(by_seq) == list(range(len(by_seq)))
    return sum(r.length for r in rows) / (4096 * max(1, len(by_seq)))


def test_packed(spark, odd, empty, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    assert check_pack(packing.packed(docs).collect(), [(k, t) for k, t, _ in texts]) > 0.95
    check_pack(packing.packed(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.packed(empty).count() == 0


def test_tokenizer_matches_the_library():
    own, lib = packing.WordTokenizer(packing.vocabulary()), Tokenizer.from_file(packing.vocabulary())
    for text in ("It's <|endoftext|> a TEST, isn't it?", "ÀÉ Straße Ünḯ é x y　z", "a\x1cb\x0bc 12345 don't*** (x)", "İstanbul ΣΑΣ ª µ", "日本語 text… — “q”", "<a href='x'>&amp;</a>"):
        assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_patterns_use_every_piece():
    rng = random.Random(1)
    histogram = {rng.randrange(1, 4097): rng.randrange(1, 500) for _ in range(300)} | {4096: 3, 1: 7}
    found = packing.patterns(histogram)
    used = defaultdict(int)
    for pack, n in found:
        assert sum(pack) <= 4096
        for length in pack:
            used[length] += n
    assert used == histogram and packing.patterns({}) == []


def plain_warc(rows):
    from hashlib import sha256

    first = {}
    for k, html in rows:
        if k is not None and len((html or "").encode()) >= 100:
            first[html] = min(k, first.get(html, k))
    out = []
    for k, html in rows:
        data = (html or "").encode()
        f = first.get(html)
        again = f is not None and k is not None and k > f
        out.append((k, len(data), sha256(data).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_archives(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(warc, "ROLL", 20000)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert sorted((tuple(r) for r in warc.archived(pages).collect()), key=str) == plain_warc([(r.page_id, r.html) for r in pages.collect()])
    odd = [(1, "http://x/\r\nevil: y", "x" * 100), (2, None, "x" * 100), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (None, "u", "x" * 100), (6, "ü", "é" * 50), (7, "u", "é" * 50)]
    df = spark.createDataFrame([(*r, "extra") for r in odd], "page_id long, url string, html string, digest string")
    assert sorted((tuple(r) for r in warc.archived(df).collect()), key=str) == plain_warc([(r[0], r[2]) for r in odd])
    again = spark.createDataFrame([(1, "u", "x" * 100)] * 3, "page_id long, url string, html string")
    assert sorted(r.record_type for r in warc.archived(again).collect()) == ["response", "revisit", "revisit"]
    assert warc.archived(df.filter("page_id = 99")).count() == 0


def test_same_rows_same_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(50)], "page_id long, url string, html string")
    a, b = (warc.write(rows.repartition(n), f"file://{tmp_path}/{n}").select("shard", "part", "records", "bytes", "sha256").collect() for n in (1, 5))
    assert sorted(a) == sorted(b) and a
    with pytest.raises(ValueError):
        warc.parse(b"nothing")


def test_copies_and_ids(spark, texts):
    import zlib

    rows = [(k, t) for k, t, _ in texts[:20]] + [(texts[0][0], texts[0][1])] * 2
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    assert sorted(r.copy for r in got if r.doc_id == texts[0][0] and r.start == 0) == [0, 1, 2] and all(r.copy == 0 for r in got if r.doc_id != texts[0][0])
