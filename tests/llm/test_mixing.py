"""Mixing against its SQL and a plain version."""

import random

import duckdb
import pytest

from lodestar.llm import mixing
from tests.oracle import rows_of


def corpus(sources, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices(sources, [3 ** (k % 5) for k in range(len(sources))])[0]
        text = None if i % 17 == 3 else " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 30, 400])))
        rows.append((i, text, source))
    return rows + [(5, rows[5][1], rows[5][2]), (None, "two words", sources[0])]


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, source string, size int, hash string")
    got = [tuple(r) for r in mixing.mix(docs).collect()]
    import pandas as pd

    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": pd.array([r[1] for r in rows], "string"), "source": pd.array([r[2] for r in rows], "string")})
    con = duckdb.connect()
    con.register("documents", documents)
    cursor = con.execute(mixing.MIX_SQL)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(["doc_id", "size", "source_size", "target", "taken"], got) == want
    return got


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        share = (total - sum(3 * sizes[s] for s in full)) / max(1, sum(w for s, w in weight.items() if s not in full))
        more = {s for s in sizes if s not in full and share * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in full else share * weight[s] for s in sizes}
        full |= more


@pytest.mark.parametrize("sources", [["a", "b", "c"], ["z", "Z", "é", "𝔸", "￿", None, "aa", ""], [None]])
def test_mix(spark, sources):
    rows = corpus(sources, 300, len(sources))
    got = check(spark, rows)
    sizes = {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    by_size = {}
    for (d, size, source_size, target, taken) in got:
        assert 0 <= taken <= 3 * size
        by_size.setdefault((source_size, target), []).append((taken, size))
    assert sorted(by_size) == sorted({(sizes[s], want[s]) for s in sizes})
    for (_, target), taken in by_size.items():
        if sum(1 for s in sizes if want[s] == target) == 1:
            assert abs(sum(t for t, _ in taken) - target) <= max(s for _, s in taken)


def test_apply_repeats_rows_and_keeps_columns(spark):
    rows = corpus(["a", "b", "c", None], 200, 3)
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, copies string")
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == []
    assert mixing.apply_mix(docs).collect() == []
