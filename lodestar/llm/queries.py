"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestar.llm import decontaminate, fill_in_middle, filter_audit, html_wrappers, language_id, licenses, line_quality, mixing, quality_classifier, sharding, simhash, token_counts, warc
from lodestar.registry import Registry, table

_registry = Registry()
QUERIES, ORACLES = _registry.queries, _registry.oracles


@_registry.add("op8_simhash")
def op8_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_registry.add("op7_mixing", mixing.MIX_SQL)
def op7_mixing(spark, sf_dir):
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@_registry.add("op4_line_quality", line_quality.DIGEST_SQL)
def op4_line_quality(spark, sf_dir):
    """Base measures and verdict of every document."""
    judged = line_quality.clean_lines(table(spark, sf_dir, "documents"), with_text=False)
    return judged.drop("n_lost_words", "clean_text")


@_registry.add("op3_warc", warc.ROUND_TRIP_SQL)
def op3_warc(spark, sf_dir):
    """What the archives of all pages say of each page."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@_registry.add("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    """Evidence, site prior and verdict of every document."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.classify(documents, labels).drop("row_key")


@_registry.add("op1_decontamination")
def op1_decontamination(spark, sf_dir):
    """Every document with the benchmark items that it contains."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_registry.add("op10_sharding")
def op10_sharding(spark, sf_dir):
    """The shard that every document has after compaction."""
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "shard", "shard_bytes", "version")


#: The public vocabulary that the query counts by; a file outside the repository.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@_registry.add("op5_token_counts")
def op5_token_counts(spark, sf_dir, model_file=PIECES):
    """Tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), model_file)


@_registry.add("op9_license_scan")
def op9_license_scan(spark, sf_dir):
    """Every place of a license notice in the documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@_registry.add("op2_main_text")
def op2_main_text(spark, sf_dir):
    """Main text of every page."""
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


@_registry.add("op11_fill_in_middle", fill_in_middle.DIGEST_SQL)
def op11_fill_in_middle(spark, sf_dir):
    """Form, cuts and digests of every document with its middle last."""
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


@_registry.add("op12_filter_audit", filter_audit.AUDIT_SQL)
def op12_filter_audit(spark, sf_dir):
    """What each filter removes, in every order and part."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_registry.add("op13_language_id")
def op13_language_id(spark, sf_dir):
    """Language of every document by models of those that aren't held out; accepted says what the calibration makes of it."""
    documents = table(spark, sf_dir, "documents")
    return language_id.identify(documents, *language_id.learn(documents), reject=False)
