"""Decontamination against brute-force edit distances, and its recall at the edit limit."""

import random

import pytest

from lodestar.llm import decontaminate as dc


def pairs(items, texts):
    """(text, item) pairs that the search finds, for items by number."""
    block = dc.build(list(enumerate(items)))
    return {(t, i) for t, k, _, _ in dc.search(block, texts) for i in block.ids[k]}


def slow(item, words):
    """Least edits of item to any run of words, by the plain table."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        old, row = row, [i]
        for j, b in enumerate(words, 1):
            row.append(min(old[j - 1] + (a != b), old[j] + 1, row[j - 1] + 1))
    return min(row)


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[at] = f"z{rng.randrange(9999)}"
        elif kind == 1:
            words.insert(at, f"z{rng.randrange(9999)}")
        elif len(words) > 1:
            words.pop(at)
    return words


def test_best_match():
    rng = random.Random(2)
    for _ in range(300):
        item = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 80))]
        words = [rng.randrange(6) for _ in range(rng.randrange(0, 60))]
        edits, end = dc.best_match(item, words)
        assert edits == slow(item, words)
        assert edits == len(item) if end == 0 else slow(item, words[:end]) == edits < slow(item, words[: end - 1])


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 15, 30, 60])
def test_recall_at_the_limit(n):
    rng, tries = random.Random(n), 200
    items = [[f"w{rng.randrange(2500)}" for _ in range(n)] for _ in range(tries)]
    noise = lambda: [f"q{rng.randrange(99)}" for _ in range(20)]
    texts = [" ".join(noise() + edited(i, dc.limit(n), rng) + noise()) for i in items]
    found = pairs(map(" ".join, items), texts)
    assert sum((i, i) in found for i in range(tries)) >= 0.93 * tries


@pytest.mark.parametrize("n", [5, 10, 20, 30, 60, 150])
@pytest.mark.parametrize("where", ["start", "second", "middle", "end", "both ends"])
@pytest.mark.parametrize("kind", ["left out", "replaced", "inserted"])
def test_recall_of_edits_in_one_place(n, where, kind):
    rng, tries, k = random.Random(n), 60, dc.limit(n)
    items = [[f"w{rng.randrange(2500)}" for _ in range(n)] for _ in range(tries)]

    def cut(words, at, size):
        new = [] if kind == "left out" else [f"z{rng.randrange(9999)}" for _ in range(size)]
        return words[:at] + new + words[at if kind == "inserted" else at + size :]

    def text(words, before):
        if where == "both ends":
            words = cut(cut(words, n - (k - k // 2), k - k // 2), 0, k // 2)
        else:
            words = cut(words, {"start": 0, "second": 1, "middle": (n - k) // 2, "end": n - k}[where], k)
        return " ".join(before + words)

    for before in ([], [f"q{rng.randrange(99)}" for _ in range(20)], [rng.choice([f"w{rng.randrange(2500)}", "q"]) for _ in range(60)]):
        found = pairs(map(" ".join, items), [text(i, before) for i in items])
        assert sum((i, i) in found for i in range(tries)) >= 0.93 * tries


def test_against_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(60)]
    items = [[rng.choice(vocab) for _ in range(rng.choice([3, 6, 12, 25]))] for _ in range(12)]
    rows = []
    for d in range(40):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 2, 30, 80]))]
        for i in rng.sample(range(12), 2):
            words[len(words) // 2 : len(words) // 2] = edited(items[i], rng.randrange(3), rng)
        rows.append((d, ", ".join(words).title() if d % 2 else "\n".join(words)))
    rows += [(90, None), (91, ""), (92, "!! ?"), (None, " ".join(items[0])), (3, " ".join(items[1]))]
    benchmark = [(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, "..."), (0, " ".join(items[5]))]
    want = []
    for d, t in rows:
        for i, b in benchmark:
            item = dc.words_of(b)
            if item and slow(item, dc.words_of(t)) <= dc.limit(len(item)):
                want.append((d, i, slow(item, dc.words_of(t))))
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    marks = spark.createDataFrame([(*b, 1) for b in benchmark], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in dc.contaminated(docs, marks).collect()), key=str)
    assert set(got) <= set(want)
    exact = [w for w in want if w[2] == 0]
    assert set(exact) <= set(got) and len(got) >= 0.95 * len(want)
    kept = dc.keep_clean(docs, marks)
    assert kept.columns == docs.columns
    bad = {d for d, _, _ in got}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in rows if d not in bad), key=str)


def test_blocks_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x y z")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, "b c d"), (2, "x y z"), (3, "no")], "item_id long, text string")
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 1)
    assert sorted((r.doc_id, r.item_id, r.end_word) for r in dc.contaminated(docs, marks).collect()) == [(1, 1, 4), (2, 2, 3)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(docs, none).collect() == [] and dc.keep_clean(docs, none).count() == 2
    assert dc.contaminated(docs.limit(0), marks).collect() == []


@pytest.mark.parametrize("n", [5, 8, 10, 20, 40, 100])
def test_recall_of_evenly_spread_edits(n):
    rng, tries, k = random.Random(n), 200, dc.limit(n)
    items = [[f"w{rng.randrange(2500)}" for _ in range(n)] for _ in range(tries)]
    replaced = {int((e + 0.5) * n / k) for e in range(k)}
    texts = [" ".join("z" if j in replaced else w for j, w in enumerate(i)) for i in items]
    found = pairs(map(" ".join, items), texts)
    assert sum((i, i) in found for i in range(tries)) >= 0.93 * tries


def test_few_windows_are_compared_however_many_items(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").collect()]
    rng, cut = random.Random(5), []
    while len(cut) < 5000:
        words, n = rng.choice(texts).split(), rng.randrange(8, 31)
        if len(words) > n:
            at = rng.randrange(len(words) - n)
            cut.append(" ".join(words[at : at + n]))
    compared, held = [], dc._held
    monkeypatch.setattr(dc, "_held", lambda block, flat, item, low, high: compared.append(len(item)) or held(block, flat, item, low, high))
    some = texts[:300]
    words = sum(len(dc.words_of(t)) for t in some)
    assert pairs(cut, some) and sum(compared) < words
