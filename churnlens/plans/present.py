"""Final projection for compared outputs: stable, engine-neutral value forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles (sum order and last-bit differences vanish), render arrays
    as ``|``-joined strings, leave everything else as is."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # two-stage rounding: first to 10 digits (absorbs last-bit noise of
            # sum order), then to ``digits`` half-up on the exact decimal, so a
            # value such as 54.7334375 rounds the same in every engine
            d = c.cast("double")
            exact = F.round(d.cast("decimal(38,10)"), digits).cast("double")
            c = F.when(F.abs(d) < F.lit(1e20), exact).otherwise(d)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)
