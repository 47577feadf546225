"""A ledger in buckets: lookups, appends, what moves in a plan."""

import re

import pytest
from pyspark.sql import functions as F

from lodestar.sources.ledger import BucketedLedger


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def addresses(spark, start, end):
    return spark.range(start, end).select(F.concat(F.lit("http://h/"), "id").alias("norm"), "id")


def test_fresh_and_known(spark, tmp_path):
    ledger = BucketedLedger(spark, str(tmp_path / "l"), 4)
    assert ledger.fresh(addresses(spark, 0, 3)).count() == 3
    ledger.append(addresses(spark, 0, 50).unionByName(addresses(spark, 40, 60)))
    ledger.append(addresses(spark, 50, 80))
    assert ledger.read().count() == 80 and ledger.read().distinct().count() == 80
    odd = addresses(spark, 70, 90).unionByName(addresses(spark, 85, 86)).unionByName(spark.createDataFrame([(None, -1)], "norm string, id long"))
    # Rows that repeat stay, null addresses are fresh.
    assert sorted(r.id for r in ledger.fresh(odd).collect()) == sorted([*range(80, 90), 85, -1])
    assert sorted(r.norm for r in ledger.known(odd).collect()) == sorted(f"http://h/{i}" for i in range(70, 80))
    again = BucketedLedger(spark, str(tmp_path / "l"), 4)
    assert again.read().count() == 80
    with pytest.raises(ValueError, match="another number"):
        BucketedLedger(spark, str(tmp_path / "l"), 8)
    small = ledger.compact(str(tmp_path / "m"))
    assert small.read().count() == 80 and len(small.read().inputFiles()) <= 4 < len(ledger.read().inputFiles())
    ledger.append(addresses(spark, 0, 0))
    for one in (ledger, again, small):
        one.close()


def test_only_candidates_move(spark, tmp_path):
    ledger = BucketedLedger(spark, str(tmp_path / "l"), 4)
    ledger.append(addresses(spark, 0, 50))
    text = plan(ledger.fresh(addresses(spark, 40, 60)))
    ledger_side = text[text.index("left_anti" if "left_anti" in text else "LeftAnti"):]
    assert text.count("Exchange") == 1 and "Bucketed: true" in text
    assert re.search(r"FileScan parquet(?:(?!Exchange).)*$", ledger_side, re.S)  # the exchange is above the candidates alone
    # A re-written ledger keeps its buckets: no exchange at all.
    compacted = plan(ledger.read().dropDuplicates(["norm"]))
    assert "Exchange" not in compacted
    ledger.close()
