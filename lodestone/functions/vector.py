"""Vector arithmetic on array columns. Sums are in double precision, in array order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def quantized(v: Column, scale: float) -> Column:
    """Signed bytes: rounded half to even and clipped to 127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x * scale))).cast("tinyint"))


def rounded(x: Column, digits: int) -> Column:
    """Rounded half away from zero in double arithmetic, as the SQL's engine does; `round` decides by the decimal that is printed."""
    y = F.abs(x) * 10.0**digits
    whole = F.floor(y).cast("double")
    return F.when(F.isnan(x), x).otherwise(F.signum(x) * F.when(y - whole >= 0.5, whole + 1).otherwise(whole) / 10.0**digits)


def mean_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """key, centroid: mean of the vectors of each key, by dimension, map-side combined."""
    flat = df.where(F.col(vec).isNotNull()).select(key, F.posexplode(as_double(F.col(vec))).alias("dim", "value"))
    means = flat.groupBy(key, "dim").agg(F.avg("value").alias("value"))
    ordered = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("parts"))
    return ordered.select(key, F.transform("parts", lambda p: p["value"]).alias("centroid"))
