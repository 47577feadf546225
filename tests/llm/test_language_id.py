"""Language identification: models against a plain Kneser-Ney, predictions on texts that weren't learned from."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import language_id as li

SYLLABLES = {"xx": "ka ro mi te su no".split(), "yy": "schö ber ung lich ei mü".split(), "zz": "да ни ро ко ст ве".split()}


def text_of(lang, seed, words):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(1, 4))) for _ in range(words)).capitalize() + "."


def learned(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 != 2


class Plain:
    """Interpolated Kneser-Ney by definition, for words with counts."""

    def __init__(self, words, alphabet):
        top, kinds = Counter(), set()
        for word, n in words.items():
            s = li.EDGE + word + li.EDGE
            for k in range(1, len(s)):
                top[s[max(0, k - li.ORDER + 1) : k + 1]] += n
                kinds |= {s[j : k + 1] for j in range(max(0, k - li.ORDER + 1), k + 1)}
        self.n = dict(top)
        for g in kinds - set(top):
            self.n[g] = sum(1 for h in kinds if len(h) == len(g) + 1 and h.endswith(g))
        self.alphabet, self.discount = alphabet, {}
        for size in range(1, li.ORDER + 1):
            once, twice = (sum(1 for g, n in self.n.items() if len(g) == size and n == m) for m in (1, 2))
            self.discount[size] = min(0.9, max(0.1, once / (once + 2 * twice))) if once and twice else 0.5

    def p(self, character, context):
        shorter = self.p(character, context[1:]) if context else 1 / self.alphabet
        same = {g: n for g, n in self.n.items() if len(g) == len(context) + 1 and g[:-1] == context}
        if not same:
            return shorter
        d, total = self.discount[len(context) + 1], sum(same.values())
        return max(same.get(context + character, 0) - d, 0) / total + (1 - sum(n - d for n in same.values()) / total) * shorter

    def word(self, word):
        s = li.EDGE + word + li.EDGE
        return sum(math.log(self.p(s[k], s[max(0, k - li.ORDER + 1) : k])) for k in range(1, len(s)))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, text_of(lang, k, 6), lang, False) for k, lang in enumerate(["xx", "yy", "zz"] * 4)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, aside boolean").select("lang", "aside", "text").repartition(3)


def test_models_equal_plain_ones(corpus):
    rows, docs = corpus
    models = li.train(li.gram_counts(docs).select("lang", "gram", "n"))
    words = {lang: Counter(w for _, t, l, _ in rows if l == lang for some in li.words_of(t) for w in some) for lang in SYLLABLES}
    alphabet = 1 + len({c for some in words.values() for w in some for c in li.EDGE + w})
    assert models.names == ["xx", "yy", "zz"] and models.alphabet == alphabet
    asked = ["karo", "mite", "ung", "schöber", "дани", "q", "kaqro", "ω" * 9, "supercalifragilistic"]
    got = li.Scorer(models).words(asked)
    want = np.array([[Plain(words[lang], alphabet).word(w) for lang in models.names] for w in asked])
    assert np.allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("most", [1 << 20, 120])
def test_probabilities_add_up(corpus, most):
    rows, docs = corpus
    models = li.train(li.gram_counts(docs).select("lang", "gram", "n"), most)
    assert most > 1000 or sum(len(m.grams) for m in models.models) <= most
    letters = sorted({c for _, t, _, _ in rows for some in li.words_of(t) for w in some for c in w} | {li.EDGE})
    assert len(letters) + 1 == models.alphabet
    for model in models.models:
        for context in ("", li.EDGE, "k", "ka", li.EDGE + "ka", "karo", "ей", "ωω", "ung"):
            codes = np.array([[ord(c) for c in context + x] for x in [*letters, "͸"]], np.uint32)
            size = codes.shape[1]
            ending = [li._fold(codes[:, size - k :]) for k in range(size + 1)]
            before = [li._fold(codes[:, size - 1 - k : size - 1]) for k in range(size)]
            p = np.exp(model.log_probability(ending, before, np.full(len(codes), size - 1)))
            assert abs(p.sum() - 1) < 1e-9


@pytest.mark.parametrize("most", [1, 120, 500, 1 << 20])
def test_what_memory_has_no_room_for_counts(corpus, spark, most, monkeypatch):
    rows, docs = corpus
    words = {lang: Counter(w for _, t, l, _ in rows if l == lang for some in li.words_of(t) for w in some) for lang in SYLLABLES}
    models = li.train(li.gram_counts(docs).select("lang", "gram", "n"), most)
    assert models.names == ["xx", "yy", "zz"] and sum(len(m.grams) for m in models.models) <= most
    assert (models.longer is None) == (most == 1 << 20) and (models.often is None or len(models.often) <= li.EACH * most // 3)
    texts = [t for _, t, _, _ in rows] + [text_of(lang, "new", 30) for lang in SYLLABLES] + ["q kaqro supercalifragilistic ωω", "ka " * 500, "x" * 300, None, "12"]
    plain = {lang: Plain(words[lang], models.alphabet) for lang in SYLLABLES}
    known = {w: [plain[lang].word(w) for lang in models.names] for w in {w for t in texts for some in li.words_of(t) for w in some}}
    monkeypatch.setattr(li, "SENT", 50)
    asked = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    got = {r.k: r for r in li.scored(asked, models).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        found = [w for some in li.words_of(text) for w in some]
        assert got[k].chars == sum(len(w) + 1 for w in found)
        if found:
            assert np.allclose(got[k].log_p, np.sum([known[w] for w in found], axis=0), rtol=1e-9)
        else:
            assert got[k].log_p is None
    again = {r.k: r for r in li.scored(asked.repartition(2), models).collect()}
    assert again == got


def test_predictions_are_those_of_whole_models(spark):
    rows = [(k, text_of(lang, k, 3 + k % 40), lang, k % 8 == 0) for k, lang in enumerate(["xx", "yy", "zz"] * 60)]
    docs = spark.createDataFrame([*rows, (500, None, None, False), (501, "12", None, False)], "doc_id long, text string, lang string, aside boolean")
    told = docs.where("lang is not null")
    counts = li.materialize(li.gram_counts(told), "grams")
    made = []
    for most in (90, 1 << 20):
        models = li.train(counts.select("lang", "gram", F.col("n_first").alias("n")), most)
        made.append({r.doc_id: r for r in li.identify(docs, models, li.calibrate(told, models), reject=False).collect()})
    few, whole = made
    assert len(few) == len(whole) == len(rows) + 2
    for k, r in whole.items():
        assert few[k].lang_pred == r.lang_pred and few[k].accepted == r.accepted and abs(few[k].score - r.score) < 1e-6
        assert few[k].cross_entropy == r.cross_entropy or abs(few[k].cross_entropy - r.cross_entropy) < 1e-9


def test_scores_don_t_depend_on_batches_or_memory(corpus, monkeypatch):
    rows, docs = corpus
    models = li.train(li.gram_counts(docs).select("lang", "gram", "n"))
    texts = [t for _, t, _, _ in rows] + [None, "", "12 34", "ka " * 500, "x" * 300]
    want = [(None if p is None else p.tolist(), n) for p, n in li.Scorer(models).texts(texts)]
    assert [n for _, n in want][-5:] == [0, 0, 0, 1500, 301]
    monkeypatch.setattr(li, "REMEMBERED", 5)
    got = [(None if p is None else p.tolist(), n) for p, n in li.Scorer(models).texts(texts)]
    assert [n for _, n in got] == [n for _, n in want] and all(p == q or np.allclose(p, q, rtol=1e-12) for (p, _), (q, _) in zip(got, want))
    monkeypatch.setattr(li, "PIECE", 7)
    got = [(None if p is None else p.tolist(), n) for p, n in li.Scorer(models).texts(texts)]
    assert [n for _, n in got] == [n for _, n in want] and all(p == q or np.allclose(p, q, rtol=1e-12) for (p, _), (q, _) in zip(got, want))


def test_predictions(spark):
    rows = [(k, text_of(lang, k, 3 + k % 40), lang, 1) for k, lang in enumerate(["xx", "yy", "zz"] * 60)]
    rows += [(1000 + k, text_of(lang, 1000 + k, 20), None, 1) for k, lang in enumerate(["xx", "yy", "zz"] * 3)]
    rows += [(2000, None, "xx", 1), (2001, "", "yy", 1), (2002, "12 34 --", None, 1), (None, text_of("xx", "n", 9), "xx", 1), (None, None, None, 1), (5, text_of("zz", 7, 30), "zz", 1), (5, text_of("zz", 7, 30), "zz", 1)]
    rows += [(3000, "ωψφ ξζθ ωωψ " * 20, None, 1), (3001, text_of("yy", "long", 400_000), None, 1)]
    # Labels of rows that are held out must not be learned: a language that only they have doesn't exist.
    rows += [(k, text_of("xx", f"h{k}", 12), "hidden", 1) for k in range(4000, 4040) if not learned(k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, gram int").repartition(5)
    learnt = li.learn(docs)
    assert learnt[0].names == ["xx", "yy", "zz"]
    got = li.identify(docs, *learnt, reject=False).collect()
    assert len(got) == len(rows) and all(r.held_out == (r.doc_id is not None and not learned(r.doc_id)) for r in got)
    truth = {k: lang for k, _, lang, _ in rows if lang in SYLLABLES and k not in (2000, 2001)}
    truth |= {1000 + k: lang for k, lang in enumerate(["xx", "yy", "zz"] * 3)} | {3001: "yy"} | {k: "xx" for k in range(4000, 4040)}
    for r in got:
        if r.doc_id in (2000, 2001, 2002) or r.doc_id is None and r.lang_pred == "und":
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        elif r.doc_id != 3000:
            assert r.lang_pred == truth.get(r.doc_id, "xx") and 0 <= r.score <= 1
    strange = {r.doc_id: r for r in got}[3000]
    assert strange.lang_pred in SYLLABLES and not strange.accepted
    assert sum(r.accepted for r in got) > 0.9 * len(got)
    again = {r.doc_id: r for r in li.identify(docs, *learnt).collect()}
    assert again[3000].lang_pred == "und" and again[3001].lang_pred == "yy"
    rerun = li.identify(docs.repartition(2), *li.learn(docs.repartition(3)), reject=False)
    assert sorted(map(str, rerun.collect())) == sorted(map(str, got))


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    empty = spark.createDataFrame([], schema)
    assert li.identify(empty, *li.learn(empty)).collect() == []
    bare = spark.createDataFrame([(1, "ka ro", None), (2, None, "xx")], schema)
    assert {(r.lang_pred, r.score) for r in li.identify(bare, *li.learn(bare)).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(k, text_of("xx", k, 10), "xx") for k in range(30)], schema)
    assert {r.lang_pred for r in li.identify(one, *li.learn(one), reject=False).collect()} == {"xx"}


def test_held_out_accuracy_on_the_driver_s_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = li.identify(docs, *li.learn(docs), reject=False).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = made.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right / n > 0.98
