"""A ledger of generations, of which readers see exactly one a family: the newest healthy one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: States of a generation, and of an extraction.
STATES = ("building", "healthy", "failed")
COMPLETE, PARTIAL, UNAVAILABLE, FAILED = "complete", "partial", "unavailable", "failed"


def publish(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger (keys, id, status, is_current) with the newest healthy generation of each family as its current one."""
    newest = F.max(F.when(F.col("status") == "healthy", F.col("id"))).over(Window.partitionBy(*keys))
    return ledger.withColumn("is_current", F.coalesce((F.col("status") == "healthy") & (F.col("id") == newest), F.lit(False)))


def finish(ledger: DataFrame, finished: DataFrame) -> DataFrame:
    """The ledger with the final status of generations that are building (id, final, error); others stay as they are."""
    joined = ledger.join(finished.select("id", "final", F.col("error").alias("_error")), "id", "left")
    ends = (F.col("status") == "building") & F.col("final").isin("healthy", "failed")
    changed = joined.withColumns({"status": F.when(ends, F.col("final")).otherwise(F.col("status")), "error": F.when(ends & (F.col("final") == "failed"), F.coalesce("_error", F.lit(""))).otherwise(F.col("error"))})
    return changed.select(*ledger.columns)


def violations(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Families (keys, n_current) with more than one current generation, or one that isn't healthy."""
    current = ledger.where("is_current").groupBy(*keys).agg(F.count("*").alias("n_current"), F.count_if(F.col("status") != "healthy").alias("_bad"))
    return current.where("n_current > 1 OR _bad > 0").drop("_bad")


def extraction_state(cached: Column, n_units: Column, n_unresolved: Column, failed: Column) -> Column:
    """Struct (status, reused) of an extraction: a complete or partial one of the same fingerprint is taken again.

    A document without text is unavailable, an error fails it, and fields that
    stay open make it partial.
    """
    reused = F.coalesce(cached.isin(COMPLETE, PARTIAL), F.lit(False))
    made = F.when(F.coalesce(n_units, F.lit(0)) == 0, UNAVAILABLE).when(failed, FAILED).when(n_unresolved > 0, PARTIAL).otherwise(COMPLETE)
    return F.struct(F.when(reused, cached).otherwise(made).alias("status"), reused.alias("reused"))
