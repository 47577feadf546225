"""Line-first cleaning: rules, measures, and the whole against its SQL (test_oracles)."""

from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from lodestar.llm import line_quality as lq


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("a b c".split()), max_size=40))
def test_repeated_words(words):
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    assert lq.repeated_words(words) == len(covered)


@pytest.mark.parametrize(
    "line, rule",
    [
        ("Home | About | News.", "navigation"),
        ("no mark at the end of any word", "punctuation"),
        ("He said: \"It is fine.\" and left", None),
        ("BUY THIS NOW OR ELSE!!", "shouting"),
        ("ab### cd*** ef$$$.", "symbols"),
        ("a a a a a a a a.", "repetition"),
        ("All rights reserved.", "boilerplate"),
        ("A plain sentence ends here.", None),
    ],
)
def test_rules(line, rule):
    assert lq.failed_rule(line, line.split()) == rule


def test_rows(spark):
    clean = "\n".join(" ".join(f"word{i}x{k}" for k in range(9)) + "." for i in range(8))
    junk = "\n".join(f"Menu{i} | Item{i} | Link{i} | More{i} | x{i} |" for i in range(12))
    rows = [(1, clean, 0), (2, junk, 0), (3, None, 0), (4, "", 0), (5, clean + "\n" + junk, 0), (1, clean, 0), (None, clean, 0), (6, "one. " * 60, 0)]
    got = lq.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    assert [r.kept for r in got] == [True, False, False, False, False, True, True, False]
    assert got[4].clean_text == clean and got[2].clean_text == "" and got[0].word_chars == len(clean.replace(" ", "").replace("\n", ""))
    assert got[7].base_failed and got[7].n_repeat_words == 60
    assert lq.clean_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
