"""Type repair and null filling of a result before it is shown or exported."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _parsed(column: Column) -> Column:
    """The number in a text; null when it holds none."""
    return F.when(column.rlike(NUMBER), column.try_cast("double"))


def clean_table(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Text columns that hold only numbers become doubles; nulls become 0 or empty text.

    Columns in ``keep`` stay text, as keys with leading zeros must. Empty text counts as a
    missing number. One aggregate row over all text columns decides the
    types; the repair itself is a projection.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
             and f.name not in keep]
    numeric = set()
    if texts:
        wrong = df.agg(*[
            F.count_if((F.col(f"`{c}`") != "") & _parsed(F.col(f"`{c}`")).isNull()).alias(str(i))
            for i, c in enumerate(texts)
        ]).first()
        numeric = {c for i, c in enumerate(texts) if wrong[i] == 0}
    fields = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if f.name in numeric:
            column = F.coalesce(_parsed(column), F.lit(0.0))
        elif isinstance(f.dataType, T.StringType):
            column = F.coalesce(column, F.lit(""))
        elif isinstance(f.dataType, T.FractionalType) and not isinstance(
                f.dataType, T.DecimalType):
            column = F.coalesce(F.nanvl(column, F.lit(0).cast(f.dataType)),
                                F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.NumericType):
            column = F.coalesce(column, F.lit(0).cast(f.dataType))
        fields.append(column.alias(f.name))
    return df.select(*fields)
