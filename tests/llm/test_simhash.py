"""SimHash near duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from lodestar.llm import common, simhash


def slow(text):
    words = [w for w in _split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(text):
    out, word = [], ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def brute(rows):
    fps = [slow(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for r, (d, _) in zip(root, rows):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, root)), key=str), [least.get(r) for r in set(root)]


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß x", "ΣΑΣ", "Abc"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 40, 120]))) for _ in range(25)]
    for t in list(texts[:15]):
        for _ in range(4):
            w = t.split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [texts[0]] * 5 + [None, "", " \n\t", "one", "two words", "A b\x1cc D\x85e F", "a b\x1cc d\x85e f", texts[1].upper()]
    rows = [(i * 3 % 1000, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[2]), (None, "nobody else has this text here at all"), (rows[0][0], texts[0]), (0, "the same id with another text")]


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(common, "HOT_KEYS", 1)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, n string")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)[0]


@pytest.mark.parametrize("many", [simhash.MANY, 3])
def test_tiles_of_a_hot_key(spark, monkeypatch, many):
    monkeypatch.setattr(simhash, "MANY", many)
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:
        x = rng.choice(sorted(fps)) if rng.random() < 0.5 else rng.getrandbits(64)
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "TILE", 16)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(a)] = find(b)
    got = {f: find(f) for f in signed}
    assert len(set(got.values())) > 50
    root.update({f: f for f in signed})
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                assert got[a] == got[b]
                root[find(a)] = find(b)
    assert len({find(f) for f in signed}) == len(set(got.values()))


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, __fp int")
    kept = simhash.keep_one(docs.withColumnRenamed("__fp", "extra"))
    assert kept.columns == ["doc_id", "text", "extra"]
    got = kept.collect()
    want = brute(rows)[1]
    assert sorted((r.doc_id for r in got), key=str) == sorted(want, key=str)


def test_a_key_of_half_the_rows_is_split(spark, monkeypatch):
    """Fingerprints that share half their bits: no group of a task has over twice as many rows as a tile."""
    rng = random.Random(4)
    fps = {rng.getrandbits(30) << 33 | 12345 for _ in range(600)} | {rng.getrandbits(63) for _ in range(600)}
    fps |= {f ^ 5 << rng.randrange(58) for f in sorted(fps)[::9]}
    monkeypatch.setattr(simhash, "TILE", 32)
    monkeypatch.setattr(simhash, "MANY", 64)
    made = simhash.groups(spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")).cache()
    assert made.groupBy("t", "k", "i", "j").count().agg({"count": "max"}).first()[0] <= 4 * 32
    met = {}
    for r in made.collect():
        met.setdefault((r.t, r.k, r.i, r.j), set()).add(r.fp)
    close = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    assert close and all(any(a in g and b in g for g in met.values()) for a, b in close)


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(30)] + [(150, 1010)] + [(5000, 5001), (7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(200), *range(1000, 1031)]}, 5000: 5000, 5001: 5000}


def test_keep_one_of_an_id_that_half_the_rows_have(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_KEYS", 1)
    rng = random.Random(8)
    rows = [(None if k % 4 == 0 else 7 if k % 4 == 1 else k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in simhash.keep_one(docs).collect()), key=str) == sorted(brute(rows)[1], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_one(docs).collect() == []


def test_long_text_is_hashed_in_chunks(monkeypatch):
    text = " ".join(str(i % 977) for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text.encode()) == whole == slow(text)
    assert np.uint64(whole) == whole
