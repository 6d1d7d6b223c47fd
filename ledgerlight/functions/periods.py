"""Periods: YYYYMM and YYYY integers, and month labels."""

from pyspark.sql import Column, functions as F


def year_of(period: str) -> Column:
    """YYYYMM -> YYYY by truncation."""
    return F.expr(f"{period} div 100").cast("int")


def period_in_year(period: str, year: int) -> Column:
    """Same rows as ``year_of(period) == year``, as a range the scan can prune on."""
    return F.col(period).between(year * 100, year * 100 + 99)


def months_of(period: str, year: int) -> Column:
    """YYYY01 to YYYY12 only."""
    return F.col(period).between(year * 100 + 1, year * 100 + 12)


def month_label(date: str) -> Column:
    return F.date_format(F.col(date), "MM/yyyy")
