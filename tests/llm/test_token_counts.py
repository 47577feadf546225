"""Count-only Viterbi against a library's unigram tokenizer with the same pieces and scores."""

import random

import pytest
import sentencepiece
from tokenizers import Tokenizer, models

from lodestar.llm import token_counts as tc
from lodestar.llm.queries import PIECES


@pytest.fixture(scope="module")
def both():
    with open(PIECES, "rb") as file:
        counter = tc.Counter(file.read())
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    return counter, library


def texts():
    rng = random.Random(4)
    letters = "aeinrst  lou\n\téßüñ梦ゼ벨𝔸☃ЖabcXYZ.,!?0123456789-' "
    out = ["", "a", " ", "  two  spaces ", "the theory of everything", "ﬁ ½", "𝔸𝔸𝔸", "aaaaaaaaaaaaaaaa", "Licensed under the Apache License, Version 2.0."]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(300)]


def test_same_as_library(both):
    counter, library = both
    for text in texts():
        want = len(library.encode(counter.normalize(text), add_special_tokens=False).ids) if text else 0
        assert counter.count(text) == want, text
        assert not text or counter.viterbi(counter.normalize(text)) == want


def test_forgetting_changes_nothing(both, monkeypatch):
    counter, _ = both
    want = [counter.count(t) for t in texts()]
    monkeypatch.setattr(tc, "REMEMBERED", 3)
    counter.known.clear()
    assert [counter.count(t) for t in texts()] == want


def test_ties_keep_the_longest_last_piece(both):
    counter, _ = both
    saved = counter.automaton
    import ahocorasick

    counter.automaton = ahocorasick.Automaton()
    for piece, score in (("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0)):
        counter.automaton.add_word(piece, (len(piece), score))
    counter.automaton.make_automaton()
    try:
        assert counter.viterbi("abc") == 1 and counter.viterbi("abcab") == 2
    finally:
        counter.automaton = saved


def test_rows(spark):
    docs = spark.createDataFrame([(1, "hello world", 0), (1, "hello world", 0), (2, None, 0), (None, "", 0)], "doc_id long, text string, n_tokens int")
    got = tc.token_counts(docs, PIECES).collect()
    assert [r.doc_id for r in got] == [1, 1, 2, None] and got[0].n_tokens == got[1].n_tokens > 0 == got[2].n_tokens == got[3].n_tokens
    assert tc.token_counts(docs.limit(0), PIECES).collect() == []


def test_a_long_text_without_white_space(both):
    counter, library = both
    rng = random.Random(7)
    text = "".join(rng.choice("abcdeinorst1é梦") for _ in range(30_000))
    assert counter.count(text) == len(library.encode(counter.normalize(text), add_special_tokens=False).ids)
    assert not any(len(part) > tc.LONGEST for part in counter.known)
