"""Aggregate functions of the language.

Integer sums widen to bigint. ``std`` is the sample deviation and ``variance`` the population variance; ``percentile`` takes
a percentage and interpolates. Lists are sorted, so that results don't depend on the order rows arrive in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.scalar import literal

#: Grouped by element position in a plan of their own: see :func:`vector_aggregate`.
VECTOR = {"vec_sum": F.sum, "vec_avg": F.avg}


def _list(x: Column) -> Column:
    return F.sort_array(F.collect_list(x))


AGGREGATES: dict[str, Callable[..., Column]] = {
    "count": F.count,
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "collect": _list,
    "collect_list": _list,
    "collect_set": lambda x: F.sort_array(F.collect_set(x)),
    "count_distinct": F.count_distinct,
    "distinct": F.count_distinct,
    "approx_count_distinct": F.approx_count_distinct,
    "percentile": lambda x, p=None: F.percentile(x, (literal(p) if p is not None else 50.0) / 100.0),
    "std": F.stddev_samp,
    "stddev": F.stddev_samp,
    "stddev_samp": F.stddev_samp,
    "stddev_pop": F.stddev_pop,
    "variance": F.var_pop,
    "product": F.product,
    "median": F.median,
    "mode": lambda x: F.mode(x, True),
    "bit_and": F.bit_and,
    "bit_or": F.bit_or,
    "bit_xor": F.bit_xor,
    "bool_and": F.bool_and,
    "bool_or": F.bool_or,
    "any_value": F.any_value,
}

DISTINCT: dict[str, Callable[..., Column]] = {
    "count": F.count_distinct,
    "sum": F.sum_distinct,
    "collect": lambda x: F.sort_array(F.collect_set(x)),
    "collect_list": lambda x: F.sort_array(F.collect_set(x)),
    "min": F.min,
    "max": F.max,
    "count_distinct": F.count_distinct,
    "collect_set": lambda x: F.sort_array(F.collect_set(x)),
}


def is_aggregate(name: str) -> bool:
    return name in AGGREGATES or name in VECTOR or name in ("group_concat", "percentile_cont")


def group_concat(x: Column, sep: Column | None, distinct: bool, order: list[tuple[Column, bool]] | None) -> Column:
    """Values joined in the order asked for, else in their own order."""
    s = literal(sep) if sep is not None else ","
    if order:
        value = x.cast("string")
        row = F.struct(*[k.alias(f"k{i}") for i, (k, _) in enumerate(order)], value.alias("v"))
        rows = F.collect_set(row) if distinct else F.collect_list(row)

        def before(p: Column, q: Column) -> Column:
            """-1, 0 or 1 by the first key that differs; nulls are least, and values settle ties."""
            out = F.when(p["v"].eqNullSafe(q["v"]), 0).when(p["v"].isNull() | (p["v"] < q["v"]), -1).otherwise(1)
            for i, (_, ascending) in reversed(list(enumerate(order))):
                a, b, sign = p[f"k{i}"], q[f"k{i}"], 1 if ascending else -1
                out = F.when(a.eqNullSafe(b), out).when(a.isNull() | (b.isNotNull() & (a < b)), -sign).otherwise(sign)
            return out

        return F.array_join(F.transform(F.array_sort(rows, before), lambda r: r["v"]), s)
    values = F.collect_set(x) if distinct else F.collect_list(x)
    return F.array_join(F.transform(F.sort_array(values), lambda v: v.cast("string")), s)


def vector_aggregate(df: DataFrame, keys: list[str], column: str, name: str, out: str) -> DataFrame:
    """Element-wise sum or average of a vector column: rows are summed by position, so no group is ever gathered whole."""
    parts = df.select(*keys, F.posexplode(F.col(column).cast("array<double>")).alias("pos", "x"))
    sums = parts.groupBy(*keys, "pos").agg(VECTOR[name]("x").alias("x"))
    rows = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("r"))
    return rows.select(*keys, F.transform("r", lambda e: e["x"]).alias(out))
