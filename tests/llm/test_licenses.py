"""License scans: alignment against plain subsequences, places against brute force, edits."""

import random

from hypothesis import given, settings, strategies as st

from lodestar.llm import licenses as li

words = st.lists(st.sampled_from("abcdefgh"), max_size=25)


def plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(old[j - 1] + 1 if x == y else max(old[j], row[-1]))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_alignment(a, b):
    assert li.common_subsequence(a, b) == plain(a, b)
    got = li.aligned(a, b)
    assert got <= plain(a, b) and li.aligned(a, a) == len(a)
    unique = [w for w in a if a.count(w) == 1 == b.count(w)]
    assert got >= min(1, len(unique))


def test_whole_templates_and_edits(spark):
    rng, rows, want = random.Random(3), [], set()
    noise = [f"noise{i}" for i in range(50)] + ["the", "of", "and", "license", "under"]
    for k, (name, text) in enumerate(sorted(li.TEMPLATES.items())):
        body = text.split()
        for _ in range(len(body) // 20):
            body[rng.randrange(len(body))] = "changed"
        before, after = (" ".join(rng.choice(noise[:50]) for _ in range(30)) for _ in range(2))
        rows.append((k, f"{before}\n{' '.join(body)}\n{after} {text.upper()}"))
        want |= {(k, name, 0), (k, name, 1)}
    rows += [(100, None), (101, ""), (102, " ".join(rng.choice(noise) for _ in range(4000))), (None, li.TEMPLATES["ISC"])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, license int")
    got = li.scan(docs).collect()
    seen = {}
    for r in got:
        assert r.coverage >= li.COVERAGE and r.end_word > r.start_word
        seen.setdefault((r.doc_id, r.license), []).append((r.start_word, r.end_word))
    for k, name, _ in want:
        places = sorted(seen[k, name])
        assert len(places) == 2 and places[0][1] <= places[1][0]
    assert (None, "ISC") in seen and not any(d in (100, 101, 102) for d, _ in seen)
    assert li.scan(docs.limit(0)).collect() == []


def test_places_against_brute_force():
    rng = random.Random(9)
    template = "a b c d e f g".split()
    for _ in range(200):
        text = [rng.choice("abcdefgxyz") for _ in range(30)]
        if rng.random() < 0.5:
            text[10:10] = template
        found = list(li.matches(text, template))
        need, span = 6, 10
        possible = any(li.aligned(template, text[s : s + span]) >= need for s in range(len(text)))
        assert bool(found) == possible
        for coverage, s, e in found:
            assert li.aligned(template, text[s:e]) == round(coverage * 7) >= need


def test_like_notices_are_told_apart(spark):
    lines = {"CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.", "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.", "CC-BY-4.0-line": "Licensed under CC BY 4.0.", "MIT-line": "Released under the MIT License.", "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3."}
    docs = spark.createDataFrame([(k, f"Some text.\n{line}\nMore text.") for k, line in enumerate(lines.values())], "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.coverage) for r in li.scan(docs).collect())
    assert got == [(k, name, 1.0) for k, name in enumerate(lines)]
    assert ("Apache-2.0-line" in {r.license for r in li.scan(spark.createDataFrame([(1, li.TEMPLATES["Apache-2.0"])], "doc_id long, text string")).collect()})


def test_a_long_text_of_shuffled_template_words_takes_few_alignments(monkeypatch):
    rng = random.Random(3)
    template = li.words_of(li.TEMPLATES["GPL-3.0"])
    words = [rng.choice(template) for _ in range(4000)]
    words[2000:2000] = template
    calls, plain = [], li.common_subsequence
    monkeypatch.setattr(li, "common_subsequence", lambda a, b: calls.append(len(a) == len(template)) or plain(a, b))
    found = list(li.matches(words, template))
    assert len(found) == 1 and found[0][0] >= li.COVERAGE and found[0][1] < 2000 + len(template) and found[0][2] > 2000
    assert sum(calls) < 400
