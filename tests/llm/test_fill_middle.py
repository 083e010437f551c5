import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from fieldtrace.llm import fill_middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_version(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def test_whole_tables(spark, odd, empty, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    for df in (docs, odd):
        got = sorted((tuple(r) for r in fill_middle.fim_digests(df).collect()), key=str)
        assert got == sorted((plain_version(r.doc_id, r.text) for r in df.collect()), key=str)
    assert {r.form for r in fill_middle.filled(docs).collect()} == {"plain", "psm", "spm"}
    assert fill_middle.fim_digests(empty).count() == 0


def test_clashing_names_and_marks(spark):
    rows = [(i, t, b"x", "f", 3, "o") for i, t in enumerate(["a <P> b", "<S>", "x<M>", "< P>", "<P", "<<>M>S>P", "é\U0001f600ß", "\n\r\x00 "] * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output binary, form string, n int, `h1` string")
    assert sorted(tuple(r) for r in fill_middle.fim_digests(df).collect()) == sorted(plain_version(r.doc_id, r.text) for r in df.collect())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ<>PSM é\n\U0001f600", max_size=40), st.integers(0, 99), st.integers(0, 99), st.sampled_from(["psm", "spm"]))
def test_rotation_and_back(text, x, y, form):
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        return
    units = UNIT.findall(text)
    low, high = sorted((x % (len(units) + 1), y % (len(units) + 1)))
    p, m, s = ("".join(u).encode() for u in (units[:low], units[low:high], units[high:]))
    out = fill_middle.transform(text.encode(), (len(p), len(p) + len(m)), form)
    assert out == (b"<S>" + s + b"<P>" + p + b"<M>" + m if form == "spm" else b"<P>" + p + b"<S>" + s + b"<M>" + m)
    assert fill_middle.restore(out, form) == text.encode()
    at = fill_middle.starts(fill_middle.np.frombuffer(text.encode(), "u1"))
    assert [text.encode()[a:b].decode() for a, b in zip(at, [*at[1:], None])] == units
