"""Vector functions over arrays, as folds that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.scalar import REGISTRY, scalar


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def paired(a: Column, b: Column, f) -> Column:
    """Sum of f over the pairs of two vectors; vectors of unequal length are an error."""
    a, b = doubles(a), doubles(b)
    checked = F.when(F.size(a) == F.size(b), F.zip_with(a, b, f)).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("array<double>"))
    return F.when(a.isNotNull() & b.isNotNull(), total(checked))


@scalar("dot_product")
def dot_product(a: Column, b: Column) -> Column:
    return paired(a, b, lambda x, y: x * y)


@scalar("l2_norm")
def l2_norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


@scalar("cosine_similarity")
def cosine_similarity(a: Column, b: Column) -> Column:
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms == 0, 0.0).otherwise(dot_product(a, b) / F.nullif(norms, F.lit(0.0)))


@scalar("euclidean_distance")
def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(paired(a, b, lambda x, y: (x - y) * (x - y)))


@scalar("manhattan_distance")
def manhattan_distance(a: Column, b: Column) -> Column:
    return paired(a, b, lambda x, y: F.abs(x - y))


@scalar("nnz")
def nnz(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x != 0))


@scalar("normalize")
def normalize(v: Column) -> Column:
    norm = l2_norm(v)
    return F.when(norm == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / F.nullif(norm, F.lit(0.0))))


REGISTRY["dimension"] = F.size

#: Metric name: (function, whether a larger value is nearer).
METRICS = {
    "COSINE": (cosine_similarity, True),
    "DOT": (dot_product, True),
    "EUCLID": (euclidean_distance, False),
    "MANHATTAN": (manhattan_distance, False),
}
