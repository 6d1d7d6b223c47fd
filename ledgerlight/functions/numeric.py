"""Column arithmetic shared by the operators."""

from pyspark.sql import Column, functions as F

MILLION = 1_000_000


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, null on a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def percent(numerator: Column, denominator: Column) -> Column:
    return ratio(numerator, denominator) * 100


def round2(value: Column) -> Column:
    return F.round(value, 2).cast("double")


def millions(money: Column) -> Column:
    """Money in millions, rounded to cents of a million in exact decimals."""
    return round2(money / MILLION)


def money_mean(money: Column) -> Column:
    """Mean of a decimal column: exact sum, one division."""
    return F.sum(money).cast("double") / F.nullif(F.count(money), F.lit(0))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of ``value`` with each row counted ``weight`` times; decimals stay exact."""
    used = F.sum(F.when(value.isNotNull(), weight))
    return F.sum(value * weight) / F.nullif(used, F.lit(0))


def to_number(value: Column) -> Column:
    """Text or number to double; what does not parse becomes 0."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def rescale(value: Column, low: Column, high: Column) -> Column:
    """Min-max scale to 0-100; equal bounds give 50."""
    return F.when(low == high, F.lit(50.0)).otherwise((value - low) / (high - low) * 100)


def deviation_percent(value: Column, mean: Column) -> Column:
    """Percent deviation from a mean, 0 when the mean is 0."""
    return F.when(mean == 0, F.lit(0.0)).otherwise((value - mean) / F.abs(mean) * 100)


def dispersion_percent(low: Column, high: Column, mean: Column) -> Column:
    """Range over absolute mean in percent, 0 when the mean is 0 or unknown."""
    return F.coalesce((high - low) / F.nullif(F.abs(mean), F.lit(0.0)) * 100, F.lit(0.0))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
