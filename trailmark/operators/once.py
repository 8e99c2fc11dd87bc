"""Columns that are computed once per row, whatever is done with them later."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`withColumns` for costly expressions, such as parsing JSON.

    The optimizer merges neighbouring projections and moves filters below them, and then repeats an expression for
    every field taken from it. The columns of a one-element array of structs come out of a generator instead, and
    those stay where they are.
    """
    kept = [name for name in df.columns if name not in columns]
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*kept, F.inline_outer(F.array(row)))
