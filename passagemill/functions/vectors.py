"""Dense vector expressions on ARRAY<FLOAT|DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(v: Column) -> Column:
    total = F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(total)


def normalize(v: Column) -> Column:
    """Unit-length copy; a zero vector stays as it is."""
    scaled = F.transform(
        F.array(l2_norm(v)),
        lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))),
    )
    return scaled[0]
