"""Arithmetic on arrays of numbers, in double precision."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.features import FEATURES


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either is."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda an expression would be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    return let(doubles(v), lambda a: let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no direction."""
    return let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n))


def scaled(v: Column, by: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(float(by)))


def usable(v: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` numbers, all finite, not all zero."""
    big = F.lit(float("inf"))
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(v, lambda x: x != 0), F.lit(False))


def same_size(a: Column, b: Column, what: Column) -> Column:
    """``a``, or an error that names the record if ``b`` has another dimension."""
    return F.when(b.isNull() | (F.size(a) == F.size(b)), a).otherwise(F.raise_error(F.concat(F.lit("vectors of different sizes: "), what)).cast("array<double>"))


def fused(text: Column, tag: Column, alpha: float) -> Column:
    """unit(alpha * unit(text) + (1 - alpha) * unit(tag)); without a tag vector unit(text)."""
    if not 0 <= alpha <= 1:
        raise ValueError(f"alpha must lie between 0 and 1, not {alpha}")
    mixed = F.zip_with(unit(text), unit(tag), lambda x, y: F.lit(float(alpha)) * x + F.lit(1 - float(alpha)) * y)
    return F.when(tag.isNull(), unit(text)).otherwise(unit(mixed))


def augmented(base: Column, weights: Mapping[str, float], vocab: dict[str, Column] | None = None) -> Column:
    """``base`` and, for each feature of positive weight, its unit vector (or zeros) times the weight.

    An unknown feature of positive weight is an error.
    """
    parts = [doubles(base)]
    for name, w in weights.items():
        if w > 0:
            parts.append(scaled(unit(FEATURES[name](vocab or {})), w))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def mean_vectors(df: DataFrame, keys: list[str], v: str, out: str = "mean") -> DataFrame:
    """The mean vector of each group: sums are made before the shuffle, on the JVM. Null vectors do not count."""
    held = df.filter(F.col(v).isNotNull()).select(*keys, array_to_vector(doubles(F.col(v))).alias("__v"))
    return held.groupBy(*keys).agg(vector_to_array(Summarizer.mean(F.col("__v"))).alias(out))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is not positive."""
    return F.when(whole > 0, part / whole).otherwise(0.0)
