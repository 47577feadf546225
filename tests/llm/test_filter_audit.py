"""Filter audit: scans against plain counts, outcomes against applying every order document by document (and SQL, test_oracles)."""

import hashlib
import re
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lodestar.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(st.sampled_from("abAB #|é漢\u0085 \n\t😀"), max_size=40), min_size=1, max_size=6)


def scan(texts):
    encoded = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)])
    starts, ends = fa.word_bounds(data, offsets)
    first = np.searchsorted(starts, offsets)
    return np.stack((np.diff(first), fa.distinct_words(data, starts, ends, first), *fa.class_counts(data, offsets))).T.tolist()


def plain(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 8, 1 << 20])
@settings(max_examples=120, deadline=None)
@given(texts=TEXTS)
def test_scan(chunk, texts):
    before, fa.CHUNK = fa.CHUNK, chunk
    try:
        assert scan(texts) == [plain(t) for t in texts]
    finally:
        fa.CHUNK = before


def test_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(fa, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["a b a c abc", "a a a", "", "abc abd abc"]
    assert scan(texts) == [plain(t) for t in texts]


def brute(rows, labels):
    """Every order applied to every document in turn."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    rows = [(i, t or "", s or "") for i, t, s in rows]
    failed = []
    for i, t, s in rows:
        w, d, c, x, n = plain(t)
        fails = {"A": w < 200, "B": 100 * d < 50 * w, "C": 100 * c > 2 * n, "D": x > 0, "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in rows)}
        failed.append((i, s, {k for k, v in fails.items() if v}))
    out, totals = [], {}
    for part in {s for _, s, _ in failed}:
        for order in permutations("ABCDE"):
            left = [(i, f) for i, s, f in failed if s == part]
            everyone = list(left)
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                after = [(i, f) for i, f in left if name not in f]
                late = sum(name in f for _, f in everyone) - len(gone)
                totals[part, name] = totals.get((part, name), 0) + len(gone)
                out.append([part, "".join(order), step, len(after), len(gone), late, sum(f == {name} for _, f in everyone), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name])
                left = after
    return sorted((*r[:-1], totals[r[0], r[-1]]) for r in out)


@pytest.fixture(scope="module")
def rows():
    good = " ".join(f"word{k}é" for k in range(250))
    texts = [good, good + " #", "Few", None, "", "same " * 300, "ALL CAPS " + good, good.upper(), good + " 50% off"]
    out = [(k, t, ("s", None, "", "t")[k % 4]) for k, t in enumerate(texts * 4)]
    return [*out, (None, good, "s"), (None, good, "s"), (3, good, "s"), (3, good, "s"), (100, "lone " + good, "u")]


def test_audit(spark, rows):
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (5, None, 1), (None, 1, 1), (9, 1, 0), (20, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mask int")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    made = fa.audit(docs, marks)
    assert made.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(map(tuple, made.collect())) == brute(rows, labels)
    assert fa.audit(docs.limit(0), marks).collect() == []
    assert {r.good_lost for r in fa.audit(docs, marks.limit(0)).collect()} == {0}


def test_measures(spark, rows):
    long = "x" * (3 << 20) + " y" * 5
    docs = spark.createDataFrame([*rows, (7, long, "s")], "doc_id long, text string, source string")
    got = sorted((r.doc_id is None, r.doc_id, bytes(r.digest), *r[2:7]) for r in fa.measure(docs).collect())
    assert got == sorted((i is None, i, hashlib.sha256((t or "").encode()).digest(), *plain(t or "")) for i, t, _ in [*rows, (7, long, "s")])


def test_limits_are_parameters(spark):
    docs = spark.createDataFrame([(1, "One two two", "s"), (2, "one", "s")], "doc_id long, text string, source string")
    assert {r.doc_id: r.mask for r in fa.failures(docs, min_words=2, min_distinct=70, max_capitals=50).collect()} == {1: 2, 2: 1}
