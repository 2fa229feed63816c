"""Joins, grouping sets, set operations, sampling and deduplication."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.aggregate import VECTOR, vector_aggregate


def condition(left: DataFrame, right: DataFrame, keys: Iterable[tuple[str, str]], null_safe: bool = False) -> Column:
    out = None
    for a, b in keys:
        c = left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b]
        out = c if out is None else out & c
    return out if out is not None else F.lit(True)


def join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join on (left, right) column pairs; a name that both sides have gets a numbered suffix on the right."""
    if how in ("left_semi", "left_anti"):
        return left.join(right, condition(left, right, keys, null_safe), how)
    taken, renamed = set(left.columns), {}
    for c in right.columns:
        new, n = c, 1
        while new in taken:
            new, n = f"{c}_{n}", n + 1
        taken.add(new)
        renamed[c] = new
    other = right.withColumnsRenamed(renamed)
    return left.join(other, condition(left, other, [(a, renamed[b]) for a, b in keys], null_safe), how)


def count_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], null_safe: bool = False) -> DataFrame:
    """One row ``n``: how many rows the inner join has. Each side's rows are counted by key first, so no pair of rows is made."""

    def counted(df: DataFrame, side: int, name: str) -> DataFrame:
        return df.groupBy(*[F.col(pair[side]).alias(f"__k{i}") for i, pair in enumerate(keys)]).agg(F.count("*").alias(name))

    names = [(f"__k{i}", f"__k{i}") for i in range(len(keys))]
    both = join(counted(left, 0, "__left"), counted(right, 1, "__right"), names, null_safe=null_safe)
    return both.agg(F.coalesce(F.sum(F.col("__left") * F.col("__right")), F.lit(0).cast("long")).alias("n"))


def cross(*sides: DataFrame) -> DataFrame:
    """All combinations: what a comma between unconnected patterns asks for."""
    out = sides[0]
    for s in sides[1:]:
        out = out.crossJoin(s)
    return out


def pattern_apply(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], anti: bool = False) -> DataFrame:
    """Rows of ``left`` for which a row of ``right`` exists (or doesn't); without keys, all or nothing."""
    if keys:
        return join(left, right, keys, "left_anti" if anti else "left_semi")
    one = right.limit(1).select(F.lit(1).alias("found"))
    return left.join(one, F.lit(True), "left_anti" if anti else "left_semi")


def rollup_apply(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], value: str, out: str) -> DataFrame:
    """Each left row with the sorted list of its right values; an empty list if it has none."""
    grouped = right.groupBy(*[F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(keys)]).agg(F.sort_array(F.collect_list(value)).alias(out))
    on = condition(left, grouped, [(a, f"__k{i}") for i, (a, _) in enumerate(keys)])
    kind = grouped.schema[out].dataType
    joined = left.join(grouped, on, "left")
    return joined.withColumn(out, F.coalesce(grouped[out], F.array().cast(kind))).drop(*[f"__k{i}" for i in range(len(keys))])


def apply(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], outer: bool = False) -> DataFrame:
    """Lateral: each left row with its matching right rows. Equal keys make it a join, which Spark plans itself."""
    return join(left, right, keys, "left" if outer else "inner")


def append_vertices(df: DataFrame, column: str, tag: DataFrame, prefix: str) -> DataFrame:
    """The properties of the vertices that a column names, missing ones as NULL."""
    side = tag.select(*[F.col(c).alias(f"{prefix}{c}") for c in tag.columns])
    return df.join(side, F.col(column) == F.col(f"{prefix}vid"), "left")


def grouping_sets(df: DataFrame, keys: list[str], sets: list[list[str]], aggs: dict[str, Column]) -> DataFrame:
    """One Expand and one aggregate for all sets; ``grouping_id`` tells rolled-up keys from NULL ones."""
    out = df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    return out.agg(F.grouping_id().alias("grouping_id"), *[c.alias(n) for n, c in aggs.items()])


def aggregate_vectors(df: DataFrame, keys: list[str], wanted: list[tuple[str, str, str]]) -> DataFrame:
    """(function, column, output) element-wise aggregates by key."""
    out = None
    for name, column, alias in wanted:
        if name not in VECTOR:
            raise ValueError(f"{name} isn't a vector aggregate")
        one = vector_aggregate(df, keys, column, name, alias)
        if out is None:
            out = one
        elif keys:
            out = join(out, one, [(k, k) for k in keys], null_safe=True).select(*out.columns, alias)
        else:
            out = out.crossJoin(one)
    return out


# -- set operations: arity must match, columns by position
def checked(left: DataFrame, right: DataFrame) -> DataFrame:
    if len(left.columns) != len(right.columns):
        raise ValueError(f"set operation over {len(left.columns)} and {len(right.columns)} columns")
    return right.toDF(*left.columns)


def union(left: DataFrame, right: DataFrame, distinct: bool = True) -> DataFrame:
    out = left.unionAll(checked(left, right))
    return out.distinct() if distinct else out


def intersect(left: DataFrame, right: DataFrame, multiset: bool = False) -> DataFrame:
    """Distinct common rows, or (multiset) every left row that the right side has."""
    right = checked(left, right)
    return join(left, right, [(c, c) for c in left.columns], "left_semi", True) if multiset else left.intersect(right)


def minus(left: DataFrame, right: DataFrame, multiset: bool = False) -> DataFrame:
    """Distinct left rows that the right side lacks, or (multiset) every such left row."""
    right = checked(left, right)
    return join(left, right, [(c, c) for c in left.columns], "left_anti", True) if multiset else left.subtract(right)


# -- row selection
def sample(df: DataFrame, n: int, method: str = "random", seed: int = 7, key: str | None = None) -> DataFrame:
    """Exactly n rows (or all, if fewer): random or reservoir by least hash of the row, system by every k-th row of a key's order."""
    if method in ("random", "reservoir"):
        draw = F.xxhash64(F.lit(seed), *df.columns)
        return df.orderBy(draw, *df.columns[:1]).limit(n)
    if method != "system" or key is None:
        raise ValueError("system sampling needs a key to order by")
    total = df.count()
    step = max(1, total // max(1, n))
    # A global row number from counts of ranges: each range is numbered on its own, then shifted.
    cuts = sorted(set(df.approxQuantile(key, [i / 32 for i in range(1, 32)], 0.01)))
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    ranged = df.withColumn("__part", part)
    sizes = dict(ranged.groupBy("__part").count().collect())
    start, at = {}, 0
    for p in sorted(sizes):
        start[p], at = at, at + sizes[p]
    offsets = F.create_map(*[F.lit(x) for p, s in start.items() for x in (p, s)]) if start else F.lit(None).cast("map<int,int>")
    numbered = ranged.withColumn("__at", offsets[F.col("__part")] + F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1)
    return numbered.where(F.col("__at") % step == 0).orderBy(key).limit(n).drop("__part", "__at")


def dedup(df: DataFrame, keys: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """Distinct rows, or one row a key: the first in ``order`` if there is one."""
    if not keys:
        return df.distinct()
    if not order:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    return df.groupBy(*keys).agg(first).select(*keys, "__first.*")


def transpose(df: DataFrame, index: str) -> DataFrame:
    return df.transpose(index)


def unwind(df: DataFrame, value: Column, name: str, is_list: bool = True) -> DataFrame:
    """A row for each list element; none for NULL or an empty list, one for a scalar."""
    return df.withColumn(name, F.explode(value if is_list else F.array(value))) if is_list else df.withColumn(name, value).where(F.col(name).isNotNull())
