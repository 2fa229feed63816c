"""Data changes as transforms from one immutable table to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` in its order and types, missing ones as NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def insert(table: DataFrame, rows: DataFrame, keys: list[str], if_not_exists: bool = False) -> DataFrame:
    """Rows replace those of equal key, or (if_not_exists) give way to them."""
    rows = align(rows, table)
    if if_not_exists:
        return table.unionByName(rows.join(table.select(*keys), keys, "left_anti").select(*table.columns))
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows)


def update(table: DataFrame, where: Column, sets: dict[str, Column]) -> DataFrame:
    """Rows that the condition holds for get new values, all computed from the old row."""
    kinds = {f.name: f.dataType for f in table.schema}
    new = {c: F.when(where, v).otherwise(F.col(c)).cast(kinds[c]) if c in kinds else F.when(where, v) for c, v in sets.items()}
    return table.withColumns(new)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], sets: dict[str, Column]) -> DataFrame:
    """Existing keys are updated, others inserted with the set values."""
    old = table.join(rows.select(*keys), keys, "left_semi").select(*table.columns)
    rest = table.join(rows.select(*keys), keys, "left_anti").select(*table.columns)
    fresh = rows.join(table.select(*keys), keys, "left_anti")
    return rest.unionByName(update(old, F.lit(True), sets)).unionByName(align(fresh, table))


def delete(table: DataFrame, keys: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Rows whose columns don't equal any row of ``keys``."""
    cond = None
    for a, b in on:
        c = table[a] == keys[b]
        cond = c if cond is None else cond & c
    return table.join(keys, cond, "left_anti")


def merge(table: DataFrame, rows: DataFrame, keys: list[str], matched: dict[str, Column], created: dict[str, Column]) -> DataFrame:
    """Match rows by key: update the matched, create the others."""
    marked = table.join(rows.select(*keys).distinct().withColumn("__hit", F.lit(True)), keys, "left")
    kept = update(marked, F.coalesce("__hit", F.lit(False)), matched).drop("__hit").select(*table.columns)
    fresh = rows.join(table.select(*keys), keys, "left_anti").withColumns(created)
    return kept.unionByName(align(fresh, table))
