"""Fill-in-the-middle: runs against counting characters, outputs against plain cuts (and SQL, test_oracles)."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lodestar.llm import fill_in_middle as fim

LETTERS = st.text(st.sampled_from("ab\n<>é߿ह漢퟿😀\U0010ffff"), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=6), st.sampled_from([1, 2, 3, 7, 1 << 20]))
def test_runs(texts, chunk):
    before, fim.CHUNK = fim.CHUNK, chunk
    try:
        data = "".join(texts).encode()
        runs = fim.Runs(np.frombuffer(data, np.uint8))
    finally:
        fim.CHUNK = before
    whole = "".join(texts)
    bytes_of = np.array([len(whole[:k].encode()) for k in range(len(whole) + 1)])
    assert (runs.byte_at(np.arange(len(whole) + 1)) == bytes_of).all()
    assert (runs.points_at(bytes_of) == np.arange(len(whole) + 1)).all()
    assert (np.diff(runs.first[1:]) > 0).all() and (np.diff(runs.width[1:]) != 0).all()


def plain(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [None, "", "a", "é", "<P>", "x<S>y", "<M", "<", "<P<S<M", "S>P>M>", "漢字😀 mixed ascii é" * 9, "\n\t \r\n", "word " * 5000, "\x00\x00", "<<<>>>" * 7]


@pytest.fixture(scope="module")
def rows():
    return [(k, text, "clash") for k, text in enumerate(TEXTS * 12)] + [(None, "no id, é", "x"), (7, "é twice", "x"), (7, "é twice", "x"), (-3, "a negative id", "x")]


def test_outputs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    got = fim.transform(docs).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    assert sorted((str(r[:6]), r.back) for r in got) == sorted((str((i, *plain(i, t))), t or "") for i, t, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_long_text_and_empty_table(spark):
    text = "aé漢😀" * 600_000
    (row,) = fim.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    n, form, prefix, middle, output = plain(1, text)
    assert row[1:5] == (n, form, prefix, middle) and row.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
    assert row.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert fim.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shares_and_marks_are_parameters(spark):
    docs = spark.createDataFrame([(k, f"text {k} <P>") for k in range(200)], "doc_id long, text string")
    made = fim.transform(docs, plain=0, suffix_first=100, marks=("[p]", "[s]", "[m]")).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"), ("[p]", "[s]", "[m]"))).collect()
    assert {r.form for r in made} == {"spm"} and all(r.back == f"text {r.doc_id} <P>" for r in made)
    assert {r.form for r in fim.transform(docs, plain=100).collect()} == {"plain"}
