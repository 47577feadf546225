"""The quality classifier: held-out accuracy, shrinkage against a plain version, edge cases."""

import math

import numpy as np
import pytest

from lodestar.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = qc.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    assert len(got) > 150
    assert sum(r.kept == bool(r.quality) for r in got) / len(got) > 0.97
    good = [r.kept for r in got if r.quality == 1]
    assert sum(good) / len(good) > 0.99


def test_shrinkage(spark):
    rng = np.random.default_rng(3)
    rows = []
    for h in range(12):
        rate = 0.2 + 0.6 * (h % 3) / 2
        for p in range(3):
            for _ in range([1, 8, 60][(h + p) % 3]):
                rows.append((f"h{h}", f"p{p}", float(np.clip(rng.normal(rate + 0.05 * p, 0.1), 0.01, 0.99))))
    rows.append(("lonely", "p", 0.99))
    known, levels = qc.sites(spark.createDataFrame(rows, "host string, path string, value double"))
    got = {r.site: r.prior for r in known.withColumn("prior", levels.prior(one=0)).collect()}
    p = np.array([r[2] for r in rows])
    mean, n = p.mean(), len(p)

    def layout(groups, parents, total):
        ssb = sum(len(v) * np.mean(v) ** 2 for v in groups.values()) - parents
        return ssb, total - ssb

    hosts, paths = {}, {}
    for h, q, x in rows:
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, q), []).append(x)
    between, within = layout(hosts, n * mean**2, (p**2).sum() - n * mean**2)
    k = len(hosts)
    tau = (between / (k - 1) - within / (n - k)) / ((n - sum(len(v) ** 2 for v in hosts.values()) / n) / (k - 1))
    strength = within / (n - k) / tau
    assert levels.of_host == pytest.approx(strength)
    host_mean = {h: (sum(v) + strength * mean) / (len(v) + strength) for h, v in hosts.items()}
    lonely = next(v for s, v in got.items() if "lonely" in s)
    assert abs(lonely - mean) < abs(0.99 - mean)
    for (h, q), v in paths.items():
        value = next(x for s, x in got.items() if f'"{h}"' in s and f'"{q}"' in s)
        low, high = sorted((np.mean(v), host_mean[h]))
        assert low - 1e-9 <= value <= high + 1e-9


def test_sites_decide_where_texts_do_not(spark, monkeypatch):
    """Posteriors flip verdicts, and each is that of all other documents of the site."""
    rng = np.random.default_rng(11)
    words = [f"word{k}" for k in range(400)]

    def text(junk):
        return " ".join("ZZ" if rng.random() < junk else str(rng.choice(words)) for _ in range(60))

    rows, marks = [], []
    for k in range(600):
        site = ("good", "poor", "mixed")[k % 3]
        good = rng.random() < {"good": 0.95, "poor": 0.05, "mixed": 0.5}[site]
        junk = rng.normal(0.2 if good else 0.3, 0.08)  # texts tell the two apart in part only
        rows.append((k, text(min(0.9, max(0.0, junk))), site, f"{site}{k % 2}"))
        if k % 2 == 0 or k % 7 == 0:
            marks.append((k, int(good)))
    rows += [(700, "", "good", "lone"), (None, text(0.2), "poor", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in qc.classify(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()}
    label = dict(marks)
    where = {d: (s, p or "\0") for d, _, s, p in rows}
    value = {d: float(label[d]) if d in label else 1 / (1 + math.exp(-max(-30, min(30, r.evidence)))) for d, r in got.items()}

    def strength(groups, parents):
        """Documents that a parent weighs as much as, by variances between groups and within."""
        n, k = len(value), len(groups)
        between = sum(sum(v) ** 2 / len(v) for v in groups.values()) - sum(sum(v) ** 2 / len(v) for v in parents.values())
        within = sum(x * x for x in value.values()) - sum(sum(v) ** 2 / len(v) for v in groups.values())
        within /= n - (k - len(parents) + 1)
        spread = between / (k - len(parents)) - within
        return 1e12 if spread <= 0 else within / (spread / ((n - sum(len(v) ** 2 for v in groups.values()) / n) / (k - len(parents))))

    hosts, paths = {}, {}
    for d, (h, p) in where.items():
        hosts.setdefault(h, []).append(value[d])
        paths.setdefault((h, p), []).append(value[d])
    a, b = strength(hosts, {0: list(value.values())}), strength(paths, hosts)
    total, flipped = sum(value.values()), 0
    base = None
    for d, r in got.items():
        h, p = where[d]
        mean = (total - value[d]) / (len(value) - 1)
        host = (sum(hosts[h]) - value[d] + a * mean) / (len(hosts[h]) - 1 + a)
        prior = (sum(paths[h, p]) - value[d] + b * host) / (len(paths[h, p]) - 1 + b)
        assert r.site_prior == pytest.approx(prior, abs=1e-9)
        shift = r.log_odds - r.evidence - math.log(prior / (1 - prior))
        base = shift if base is None else base
        assert shift == pytest.approx(base, abs=1e-6) and r.kept == (r.log_odds >= 0)
        flipped += r.kept != (r.evidence >= 0)
    rate = np.mean([q for _, q in marks])
    assert base == pytest.approx(-math.log(rate / (1 - rate)), abs=1e-6)
    # Held out: with sites more verdicts are right than by the text alone.
    truth = {k: where[k][0] for k in range(600) if k not in label and where[k][0] != "mixed"}
    by_site = sum(got[k].kept == (s == "good") for k, s in truth.items())
    by_text = sum((got[k].evidence >= 0) == (s == "good") for k, s in truth.items())
    assert flipped >= 30 and by_site > by_text


def test_edges(spark):
    rows = [(1, None, None, None), (2, "", "s", "en"), (3, "Of Of Of Of " * 40, "s", "en"), (3, "another text of the same id.", "s", "en"), (None, "no id here.", "s", None), (4, "Good words here. " * 3, "s", "en"), (4, "Good words here. " * 3, "s", "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lang string, host int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in qc.classify(docs, none).collect()] == [True] * 7
    kept = qc.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 7
    labels = spark.createDataFrame([(3, 0), (4, 1), (4, None), (2, 0)], "doc_id long, quality int")
    got = qc.classify(docs, labels).collect()
    assert len(got) == 7 and all(math.isfinite(r.log_odds) for r in got)
    empty = spark.createDataFrame([], docs.schema)
    assert qc.classify(empty, labels).collect() == [] and qc.keep_good(empty, labels).collect() == []


def test_fit_needs_both_classes():
    model = qc.fit(np.ones((4, 2)), np.ones(4))
    assert model.weights == (0.0, 0.0)
    assert qc.features(" \n") == pytest.approx([0.0] * len(qc.FEATURES))
