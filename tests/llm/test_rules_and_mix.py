import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fieldtrace.llm import licenses, lines, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def plain_rules(rows, distinct="documents", words=1):
    found, per, every = [], defaultdict(set), defaultdict(set)
    for k, text, host in rows:
        one = ("text", text or "") if k is None or distinct == "texts" else k
        every[host].add(one)
        for line in (text or "").split("\n"):
            if len(WORD.findall(line)) >= words:
                per[host, lines.normal(line)].add(one)
    for k, text, host in rows:
        base = plain_counts(text)
        limit = max(lines.LEAST_DOCS, len(every[host]) * lines.SHARE)
        lost = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if len(WORD.findall(x)) >= words and len(per[host, lines.normal(x)]) > limit)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        found.append((k, *base, failed, not failed and lost <= base[0] * lines.LOST, lost))
    return sorted(found, key=str)


@pytest.mark.parametrize("least", [25, 1])
def test_line_rules(spark, odd, empty, texts, monkeypatch, least):
    monkeypatch.setattr(lines, "LEAST_DOCS", least)
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    for df in (docs, odd):
        got = sorted((tuple(r) for r in lines.line_rules(df).collect()), key=str)
        plain = [(r.doc_id, r.text, r.source) for r in df.collect()]
        assert got == plain_rules(plain)
    assert sorted((tuple(r) for r in lines.line_rules(docs, "texts", 3).collect()), key=str) == plain_rules(texts, "texts", 3)
    assert lines.line_rules(empty).count() == 0


def test_copies_are_documents_unless_texts_are_counted(spark, monkeypatch):
    monkeypatch.setattr(lines, "LEAST_DOCS", 3)
    body = "Menu\n" + " ".join(f"w{j}" for j in range(60))
    df = spark.createDataFrame([(i, body, "h") for i in range(5)] + [(9, "Menu\n" + " ".join(f"v{j}" for j in range(60)), "h")], "doc_id long, text string, source string")
    assert {r.doc_id for r in lines.line_rules(df).filter("kept").collect()} == {9}
    assert lines.line_rules(df, "texts").filter("kept").count() == 6
    assert [r.text.split("\n")[0] for r in lines.clean(df).collect()] == [" ".join(f"v{j}" for j in range(60))]


def test_clean_on_odd_and_empty_tables(spark, odd, empty):
    names = ["k0", "k1", "row", "gone", "bad", "twin", "host", *odd.columns]
    wide = odd.selectExpr("1 as k0", "2 as k1", "3 as row", "4 as gone", "5 as bad", "6 as twin", "7 as host", "*")
    got = lines.clean(wide)
    kept = [r for r in lines.line_rules(odd).collect() if r.kept]
    assert got.columns == names and sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(str(r.doc_id) for r in kept)
    assert all(r.gone == 4 and r.host == 7 for r in got.collect())
    assert lines.clean(empty).count() == 0


def test_common_lines_go(spark, monkeypatch):
    monkeypatch.setattr(lines, "LEAST_DOCS", 2)
    rows = [(i, f"All rights reserved 20{i}\n" + " ".join(f"w{'abcde'[i]}x{j}" for j in range(80)), "h", "en") for i in range(5)]
    got = lines.clean(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    assert got.columns == ["doc_id", "text", "source", "lang"]
    assert sorted(r.text for r in got.collect()) == sorted(r[1].split("\n")[1] for r in rows)


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else share[s] for s in order}
        capped |= set(over)


def test_targets(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {s: rng.choice([0, 3, 50, 1000, 90000]) for s in ["a", "b", "ç", "z", "Z", None][: rng.randrange(1, 7)]}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def plain_seats(votes, n):
    won = Counter()
    for _ in range(n):
        won[min(votes, key=lambda v: (-votes[v] / (2 * won[v] + 1), v))] += 1
    return won


def test_seats(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    for n in (1, 7, 200):
        votes = {f"t{i}": rng.choice([0.0, 1.0, 5.5, 300.0, 20000.0]) for i in range(9)} | {"t9": 2.0}
        df = spark.createDataFrame([(t, v, 1) for t, v in votes.items()], "tie string, votes double, g int")
        got = {r.tie: r.seats for r in mixing.seats(df, ["g"], F.col("votes"), F.lit(n)).collect()}
        want = plain_seats({t: v for t, v in votes.items() if v}, n)
        assert {t: s for t, s in got.items() if s} == dict(+want)


def test_seats_where_rows_outnumber_them(spark):
    from pyspark.sql import functions as F

    for n, votes in ((35, {"big": 143.0} | {f"t{i:03}": 1.0 for i in range(857)}), (3, {f"t{i:03}": float(i % 7) for i in range(1000)})):
        df = spark.createDataFrame([(t, v, 1) for t, v in votes.items()], "tie string, votes double, g int")
        got = {r.tie: r.seats for r in mixing.seats(df, ["g"], F.col("votes"), F.lit(n)).collect() if r.seats}
        assert got == dict(plain_seats({t: v for t, v in votes.items() if v}, n))
        assert n != 35 or got == {"big": 35}


def test_picked_blocks(spark):
    """Blocks are whole, seeded and spread over a shard; the mix holds exactly their words, with line breaks."""
    rows = [(i, "\n".join(f"w{i}_{j}" for j in range(50 + i % 300)), "a" if i % 10 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    plan = {r.doc_id: r for r in mixing.taken(docs.select("doc_id", "source", F.size(F.split("text", "\n")).cast("long").alias("size"))).collect()}
    parted = [r for r in plan.values() if 0 < sum(x.n for x in r.picks) < r.size]
    assert parted and any(x.at > 0 for r in parted for x in r.picks) and all(0 < x.n <= mixing.BLOCK and x.at + x.n <= r.size for r in plan.values() for x in r.picks)
    texts_ = {k: t for k, t, _ in rows}
    for r in mixing.mixed(docs).collect():
        own, whole = plan[r.doc_id], texts_[r.doc_id]
        words = whole.split("\n")
        assert r.text == whole or r.text == "\n".join(w for x in own.picks for w in words[x.at : x.at + x.n])


def test_mix(spark, odd, empty, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    for df in (docs, odd):
        rows = mixing.mix_words(df).collect()
        assert sorted((r.doc_id, r.size) for r in rows if r.doc_id is not None) == sorted((r.doc_id, len(WORD.findall(r.text or ""))) for r in df.collect() if r.doc_id is not None)
        assert all(0 <= r.taken <= 2 * r.size for r in rows)
        by = defaultdict(int)
        for r in rows:
            by[r.source_size, r.target] += r.taken
        assert all(abs(taken - target) <= 4 * mixing.BLOCK + 0.02 * target for (_, target), taken in by.items())
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_words(df).collect()), key=str)
        mix = mixing.mixed(df)
        assert mix.columns == df.columns and sum(len(WORD.findall(r.text)) for r in mix.collect()) == sum(r.taken for r in rows)
    assert mixing.mix_words(empty).count() == 0


def plain_base(text):
    found = [w.decode() for w in licenses._WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())]
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(found), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark, odd, empty, texts):
    more = spark.createDataFrame([(9000000, "noise and more noise\n" + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software " + "tail " * 9, "a")], "doc_id long, text string, source string")
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").union(more)
    for df in (docs, odd):
        got = licenses.license_labels(df).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((r.doc_id, *plain_base(r.text)) for r in df.collect()), key=str)
        assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert {r.labels for r in licenses.license_labels(docs).filter("doc_id = 9000000").collect()} == {"mit"}
    assert licenses.license_labels(empty).count() == 0


def test_license_spans(spark, tmp_path):
    rng = random.Random(4)
    bsd = licenses.TEMPLATES["bsd"]
    mit = " ".join(licenses.TEMPLATES["mit-text"].split()).split()
    for i in range(10, len(mit), 40):
        mit[i] = "changed"
    mixed_up = licenses.TEMPLATES["mpl"].split()
    rng.shuffle(mixed_up)
    noise = lambda n: " ".join(f"n{rng.randrange(10**6)}" for _ in range(n))
    rows = [
        (1, noise(30) + " " + bsd.replace("modification are", "modification OF THE FOO LIBRARY are") + " " + noise(30)),
        (2, " ".join(mit)), (3, noise(400) + " " + " ".join(mit[:100]) + " " + noise(400)), (4, " ".join(mixed_up)), (5, " ".join(bsd.split()[:6])),
        (6, " ".join(noise(40) + " " + " ".join(bsd.split()[i : i + 3]) for i in range(0, 19, 3))), (2, " ".join(mit)), (None, bsd),
    ]
    got = {r.doc_id: r.labels for r in licenses.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "bsd", 2: "mit", 3: "mit", 4: "", 5: "", 6: "", None: "bsd"}
    (tmp_path / "house.txt").write_text("you may read this text aloud to anyone who asks for it and to nobody else at all")
    own = licenses.templates_in(spark, str(tmp_path))
    more = spark.createDataFrame([(1, "x y You may read this text ALOUD to anyone, who asks for it and to nobody else!")], "doc_id long, text string")
    assert [r.labels for r in licenses.license_labels(more, own).collect()] == ["house"]


def test_license_spans_against_all_places(spark):
    """Planted sentences with changed words: found if and only if enough grams and words are left."""
    rng = random.Random(8)
    words_ = licenses.TEMPLATES["mit"].split()
    rows, want = [], {}
    for i in range(60):
        own = list(words_)
        for j in rng.sample(range(len(own)), i // 6):
            own[j] = f"q{j}"
        rows.append((i, f"a{i} b c " + " ".join(own) + " d e f"))
        grams = sum(own[j : j + 3] == words_[j : j + 3] for j in range(len(own) - 2)) / (len(own) - 2)
        want[i] = "mit" if grams >= licenses.COVER and sum(a == b for a, b in zip(own, words_, strict=True)) / len(own) >= licenses.COVER else ""
    got = {r.doc_id: r.labels for r in licenses.license_labels(spark.createDataFrame(rows, "doc_id long, text string"), {"mit": licenses.TEMPLATES["mit"]}).collect()}
    assert got == want and len(set(want.values())) == 2
