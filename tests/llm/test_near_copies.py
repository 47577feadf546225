"""Near copies at a Jaccard similarity of 0.8 against brute force."""

import random

import corpus_pipeline as cp
from lodestar.llm import near_copies as nc

SF = "/root/testdata/sf0.001"


def plain(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets = list(map(plain, texts))
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]


def survivors(rows):
    """Ids of the first row of each component of near copies."""
    root = list(range(len(rows)))
    for i, j in brute([t for _, t in rows]):
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = min((x for x in (d, least.get(r)) if x is not None), default=None)
    return sorted(least.values(), key=str)


def corpus():
    rng = random.Random(3)
    texts = [[f"w{rng.randrange(900)}" for _ in range(n)] for n in [3, 5, 30, 60, 120, 400] for _ in range(3)]
    for base in list(texts):
        for edits in [1, 1, 2, 3, 4, 8]:
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"z{rng.randrange(9999)}"
            texts.append(words)
    rng.shuffle(texts)
    texts = list(dict.fromkeys(" ".join(t) for t in texts))
    return list(enumerate([*texts, texts[0].upper(), "", " \n", None])) + [(None, "nobody has this text but one row")]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nc, "TILE", 2)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, text_id int")
    kept = nc.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == survivors(rows)
    assert nc.keep_one(docs.limit(0)).count() == 0


def test_stage_leaves_no_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(cp.STAGES)["simhash near-dedup"]
    kept = [(r.doc_id, r.text) for r in stage(spark, docs, SF).collect()]
    before = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, SF).collect()]
    assert brute([t for _, t in before]) and not brute([t for _, t in kept])
    assert sorted((d for d, _ in kept), key=str) == survivors(before)
