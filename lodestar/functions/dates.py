"""Dates as sources write them, civil days and ages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZONE = "America/Sao_Paulo"


def iso_to_br(value: Column) -> Column:
    """yyyy-mm-dd as dd/mm/yyyy; that form stays; empty for others."""
    iso = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"^(\d{4})-(\d{2})-(\d{2})"), F.lit(0))
    day = F.get(iso, F.lit(0))
    turned = F.concat_ws("/", F.substring(day, 9, 2), F.substring(day, 6, 2), F.substring(day, 1, 4))
    return F.when(day.isNotNull(), turned).when(value.rlike(r"^\d{2}/\d{2}/\d{4}$"), value).otherwise(F.lit(""))


def parse_deadline(value: Column) -> Column:
    """dd/mm/yyyy as a date; null for what is none."""
    return F.try_to_date(F.when(value.rlike(r"^\d{2}/\d{2}/\d{4}$"), value), "dd/MM/yyyy")


def civil_day(moment: Column) -> Column:
    """The local day of a moment in UTC."""
    return F.to_date(F.from_utc_timestamp(moment, ZONE))


def age_days(moment: Column, as_of: Column) -> Column:
    """Whole local days since a moment, zero for later ones."""
    return F.greatest(F.datediff(as_of, civil_day(moment)), F.lit(0))


def fractional_days(start: Column, end: Column) -> Column:
    """Days between two moments, zero if they are the other way round."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.greatest(micros / F.lit(86_400_000_000.0), F.lit(0.0))
