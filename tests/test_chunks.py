"""Chunks with a token counter against a plain version, and normal forms against the standard library."""

import json
import random
from urllib.parse import urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from lodestar.functions import ids
from lodestar.operators import generations as N, silver as S
from lodestar.sources import bronze as B


def by_letters(text):
    return len(text or "") // 4


def by_words(text):
    return int(len((text or "").split()) * 1.3)


def plain(blocks, count):
    """Chunks of one document's blocks, as a list of (section, pages, doc, text)."""
    groups = []
    for _, doc, page, path, kind, text in blocks:
        if kind in S.DROPPED_KINDS or not text.strip():
            continue
        section, text = " > ".join(path)[:200] or None, text.strip()
        pieces = [text]
        if count(text) > S.MOST:
            parts = [p for p in text.split("\n\n") if p.strip()]
            parts = parts if len(parts) > 1 else [p for p in text.split("\n") if p.strip()]
            if len(parts) > 1:
                pieces, size = [], S.MOST + 1
                for p in parts:
                    if pieces and size + count(p) <= S.MOST:
                        pieces[-1] += "\n\n" + p
                        size += count(p)
                    else:
                        pieces.append(p)
                        size = count(p)
        for piece in pieces:
            if not groups or groups[-1][:2] != [section, doc] or groups[-1][4] + count(piece) > S.TARGET:
                groups.append([section, doc, [], [], 0])
            groups[-1][2].append(page)
            groups[-1][3].append(piece)
            groups[-1][4] += count(piece)
    merged = []
    for g in groups:
        if merged and count("\n\n".join(g[3])) < S.LEAST and merged[-1][:2] == g[:2]:
            merged[-1][2] += g[2]
            merged[-1][3] += g[3]
        else:
            merged.append(g)
    out = []
    for k, (section, doc, pages, texts, _) in enumerate(merged):
        body, tail = "\n\n".join(texts), ""
        if k and merged[k - 1][1] == doc:
            words, n = "\n\n".join(merged[k - 1][3]).split(), int(S.OVERLAP / 1.3)
            while count is not by_words and n > 1 and count(" ".join(words[-n:])) > S.OVERLAP:
                n //= 2
            tail = " ".join(words[-n:])
        low, high = min(pages), max(pages)
        out.append((section, f"p.{low}" if low == high else f"p.{low}-{high}", doc, f"[…] {tail}\n\n{body}" if tail else body))
    return out


@pytest.mark.parametrize("count", [by_words, by_letters])
def test_chunks_against_a_plain_version(spark, count):
    rng, rows = random.Random(13), []
    for k in range(6):
        for idx in range(60):
            text = rng.choice(["\n", "\n\n", " "]).join(" ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice([2, 20, 300]))) for _ in range(rng.choice([1, 1, 2, 12])))
            rows.append((k, idx, f"d{idx // 25}", idx // 7, [f"S{idx // 11}"] if idx % 9 else [], rng.choice(["paragraph"] * 6 + ["signature", "heading"]), text if rng.random() > 0.05 else " \n"))
    frame = spark.createDataFrame(rows, "k int, idx int, doc string, page int, section_path array<string>, kind string, text string")
    got = S.chunks(frame, ["k"], None if count is by_words else count).orderBy("k", "chunk_index").collect()
    want = [(k, i, *c) for k in range(6) for i, c in enumerate(plain([r[1:] for r in rows if r[0] == k], count))]
    assert [(r.k, r.chunk_index, r.section, r.page_range, r.source_file, r.text) for r in got] == want


def test_page_identity_against_the_standard_library(spark):
    def normal(url):
        p = urlsplit((url or "").strip())
        query = "&".join(kv for kv in p.query.split("&") if kv and not kv.lower().startswith(ids.TRACKING))
        return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path.rstrip("/"), query, ""))

    rng = random.Random(2)
    urls = [None, "", " ", "a.b/c", "//h/p", "http:/x", "mailto:a@b", "HTTP://H/", "x:y", "1:2", "http://h?#", "http://h\n/a", "a:b:c//", "file:", "http:"]
    urls += ["".join(rng.choice(["http", "HTTPS", ":", "/", "//", "?", "#", "&", "a", "B.c", "utm_x=1", "q=2", "fbclid", " ", "é"]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, url string")
    got = {r.k: (r.n, r.h) for r in frame.select("k", ids.normalize_web_url(F.col("url")).alias("n"), ids.web_url_hash(F.col("url")).alias("h")).collect()}
    for k, u in enumerate(urls):
        assert got[k][0] == normal(u), u
    assert len({got[0][1], got[3][1]}) == 2


def test_rules_in_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Rules\n```yaml\nkinds: [a, b]\nname: x\n```\ntext\n```yaml\n- 1\n```\n```yaml\nname: y\nmore:\n  deep: {k: 1}\n```\n```python\nkinds: no\n```\n")
    (tmp_path / "b.md").write_text("nothing here")
    got = {(r.file, r.key): json.loads(r.rule) for r in B.read_rules(spark, str(tmp_path)).collect()}
    assert got == {("a.md", "kinds"): ["a", "b"], ("a.md", "name"): "y", ("a.md", "more"): {"deep": {"k": 1}}}


def test_generations(spark):
    ledger = spark.createDataFrame([("f", 1, "healthy", True, ""), ("f", 2, "building", False, ""), ("f", 3, "failed", False, "old"), ("g", 4, "building", False, "")], "family string, id int, status string, is_current boolean, error string")
    ended = spark.createDataFrame([(2, "healthy", None), (3, "healthy", None), (4, "failed", "no source")], "id int, final string, error string")
    got = N.publish(N.finish(ledger, ended), ["family"])
    assert sorted(map(tuple, got.select("id", "status", "is_current", "error").collect())) == [(1, "healthy", False, ""), (2, "healthy", True, ""), (3, "failed", False, "old"), (4, "failed", False, "no source")]
    assert N.violations(got, ["family"]).collect() == [] and N.violations(got.withColumn("is_current", F.lit(True)), ["family"]).count() == 2
