"""The pipeline: each stage against a plain version, on documents with nulls, repeats and clashing names."""

import pytest

import corpus_pipeline as cp
from lodestar.llm import common, decontaminate as dc, mixing, quality_classifier as qc
from tests.llm.test_simhash import slow

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", None, 0), (9002, None, "en", "src0", None), (9003, "x " * 40_000, "en", "src0", 80_000), (0, "another text of a known id", "en", "src1", 10)], real.schema)
    return real.unionByName(odd).unionByName(real.where("doc_id < 5")).cache()


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_names():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "mixing to target weights", "sharding"]
    assert cp.ORACLE_SQL is None


def test_quality(spark, docs):
    out = cp.quality(spark, docs, SF)
    assert out.columns == docs.columns
    judged = qc.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(out) == ids(judged.where("kept"))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {d for d, q in labels.items() if q == 1}
    assert len(good & set(ids(out))) >= 0.97 * len(good)


def test_near_duplicates(spark, docs):
    out = cp.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    rows = [(r.doc_id, slow(r.text)) for r in docs.collect()]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        known = [x for x in (d, least.get(r)) if x is not None]
        least[r] = min(known) if known else None
    assert ids(out) == sorted(least.values(), key=str)


def test_decontamination(spark, docs):
    out = cp.decontamination(spark, docs, SF)
    assert out.columns == docs.columns
    items = [b" ".join(dc.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(b" " + b" ".join(dc.words_of(r.text)) + b" ")
    leaked = {d for d, ts in texts.items() if any(b" " + i + b" " in t for i in items for t in ts)}
    assert leaked and not leaked & set(ids(out))
    assert len(set(texts) - leaked - set(ids(out))) <= 0.02 * len(texts)


def test_mix_and_shards(spark, docs):
    mixed = cp.mix(spark, docs, SF)
    assert mixed.columns == docs.columns
    taken = mixing.mix(docs).groupBy().sum("taken").first()[0]
    assert mixed.select(mixing.n_words(mixed.text).alias("n")).groupBy().sum("n").first()[0] == taken
    out = cp.shards(spark, mixed, SF)
    assert out.columns == [*docs.columns, "shard", "shard_bytes", "version"]
    a, b = out.select(*docs.columns), mixed
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_empty_documents(spark, docs):
    now = docs.limit(0)
    for _, stage in cp.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0


def test_run_is_its_stages_one_after_another(spark):
    out = cp.run(spark, SF)
    want = spark.read.parquet(f"{SF}/documents.parquet")
    columns = want.columns
    for _, stage in cp.STAGES:
        want = stage(spark, want, SF).select(*columns)
    assert out.count() > 50 and out.columns == [*columns, "shard", "shard_bytes", "version"]
    got = out.select(*columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert common.clear(spark) > 20 and common.clear(spark) == 0  # what the stages left in the shared folder
