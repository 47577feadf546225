"""Every operator with extra columns of the names that it uses itself, and with nulls in any column."""

import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, fill_in_middle, filter_audit, html_wrappers, language_id, licenses, line_quality, mixing, quality_classifier, sharding, simhash, token_counts, warc
from lodestar.llm.queries import PIECES

NAMES = (
    "fp n root component_id fingerprint least size hash source_size target taken copies below extra budget prefix s site host path p prior label logit kept "
    "row_key features symbols n_words words n_tokens item_id edits license coverage digest top payload record_id bundle frame offset wrapper part bytes page_id url html text_len form output mask first good toxic n_distinct gram aside place held_out lang_pred score"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five six", "s", "en"), (2, None, "s", None), (3, "", None, "en"), (None, "Released under the MIT License.", "s", "en"), (1, "one two three four five six", "s", "en")]
    out = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return out.withColumns({n: F.lit(None).cast("string") if k % 2 else F.lit(k) for k, n in enumerate(NAMES)})


def test_documents(spark, docs):
    labels = spark.createDataFrame([(1, 1, "x"), (3, 0, "x"), (None, 1, "x")], "doc_id long, quality int, label string")
    marks = spark.createDataFrame([(1, "two three four five", "x"), (None, None, "x")], "item_id long, text string, doc_id string")
    n = docs.count()
    for made in (simhash.near_duplicates(docs), mixing.mix(docs), line_quality.clean_lines(docs), token_counts.token_counts(docs, PIECES), quality_classifier.classify(docs, labels), sharding.shard(docs), fill_in_middle.transform(docs), filter_audit.failures(docs), language_id.identify(docs, *language_id.learn(docs))):
        assert made.count() == n
    assert filter_audit.audit(docs, labels.withColumn("toxic", F.lit(None).cast("int"))).count() == 1200
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, marks).collect()} == {(1, 1)}
    assert {(r.doc_id, r.license) for r in licenses.scan(docs).collect()} == {(None, "MIT-line")}
    for kept in (simhash.keep_one(docs), mixing.apply_mix(docs), quality_classifier.keep_good(docs, labels), decontaminate.keep_clean(docs, marks)):
        assert kept.columns == docs.columns
        kept.count()


def test_pages(docs):
    pages = docs.drop("page_id", "url", "html").withColumnsRenamed({"doc_id": "page_id", "text": "html", "source": "url"})
    assert html_wrappers.extract(pages).count() == docs.count() == warc.round_trip(pages).count()
