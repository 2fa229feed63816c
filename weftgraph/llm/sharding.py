"""Operator 4, sharding: a uniform shuffle with exact shard sizes from a hypergeometric communication matrix.

Rows are grouped into blocks; how many of each block's rows go to each shard is drawn (multivariate hypergeometric: the law
of a uniform permutation). Each block is permuted locally and cut by its row of the matrix, rows are exchanged, and each
shard is permuted again. Only DataFrame functions touch rows; the driver draws counts.

Cases: a null text counts as empty; null ids are hashed like any value; equal rows are numbered, so that each has a place of
its own and any number of them is spread over blocks; only the length and the checksum of a very long text are exchanged; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, whose local permutation is one task's sort.
BLOCK_ROWS = 1_000_000
MOST_BLOCKS = 4096
#: Equal rows that one task numbers.
EQUAL_ROWS = 100_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good, by inversion.

    The law's weights are products of exact ratios from the mode outwards, in steps until they fall below 1e-18 of the
    mode's, and are normalised by their own sum: rounding is all that keeps it from being exact, some 1e-12 at most.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    up = _weights(high - mode, lambda k: (good - mode - k) / (mode + k + 1) * ((draws - mode - k) / (bad - draws + mode + k + 1)))
    down = _weights(mode - low, lambda k: (mode - k) / (good - mode + k + 1) * ((bad - draws + mode - k) / (draws - mode + k + 1)))
    mass = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    at = int(np.searchsorted(mass, rng.random() * mass[-1], "right"))
    return mode - len(down) + min(at, len(mass) - 1)


def _weights(steps: int, ratio) -> np.ndarray:
    """Products of ratio(0), ratio(0) * ratio(1) and so on, up to ``steps`` of them or until they no longer count."""
    parts, last, at = [], 1.0, 0
    while at < steps and last > 1e-18:
        k = np.arange(at, min(steps, at + 4096), dtype=np.float64)
        parts.append(last * np.cumprod(ratio(k)))
        last, at = float(parts[-1][-1]), at + len(k)
    return np.concatenate(parts) if parts else np.empty(0)


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts with these row and column sums, drawn as a uniform permutation would make them."""
    rng, left, matrix = random.Random(seed), list(shards), []
    for n in blocks:
        row, rest = [], sum(left)
        for s, room in enumerate(left):
            x = hypergeometric(rng, room, rest - room, n)
            row.append(x)
            rest -= room
            n -= x
            left[s] -= x
        matrix.append(row)
    return matrix


def numbered(rows: DataFrame) -> DataFrame:
    """Every row with a ``copy``, from 0 among equal rows: they are counted, with partial counts, and made again from the count.

    Counts beyond EQUAL_ROWS are first cut into parts, which are dealt out.
    """
    counts = rows.groupBy(*rows.columns).count()
    few = counts.where(F.col("count") <= EQUAL_ROWS).withColumn("from", F.lit(0).cast("long"))
    many = counts.where(F.col("count") > EQUAL_ROWS).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(EQUAL_ROWS).cast("long"))))
    many = many.repartition("from", *rows.columns).select(*few.columns)
    last = F.least(F.col("from") + EQUAL_ROWS, "count") - 1
    return few.union(many).select(*rows.columns, F.explode(F.sequence("from", last)).alias("copy"))


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Row keys are hashes of the row itself and its number among equal ones, so a recomputed task makes the same draw.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    n = docs.count()
    rows = numbered(rows)
    tie = F.xxhash64("doc_id", "text_crc32", "size", "copy")
    n_blocks = max(1, min(MOST_BLOCKS, max(-(-n // block_rows), min(64, n // 100))))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), tie), F.lit(n_blocks)).cast("int"))
    held = dict(rows.groupBy("block").count().collect())
    sizes = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([held.get(b, 0) for b in range(n_blocks)], sizes, seed)
    ends = []
    for row in matrix:
        total, cut = 0, []
        for x in row:
            total += x
            cut.append(total)
        ends.append(cut)
    cuts = F.from_json(F.lit(str(ends)), "array<array<bigint>>")
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), tie), "doc_id", "text_crc32", "size", "copy")
    placed = rows.withColumn("at", F.row_number().over(local).cast("long"))
    # "at" numbers a block's rows from 1; as many cuts as lie below it are shards already full.
    placed = placed.withColumn("shard", F.size(F.filter(cuts[F.col("block")], lambda end: end < F.col("at"))).cast("int"))
    # The second permutation orders a shard by a 64-bit key; its leading bits cut the shard into pieces sorted apart.
    pieces = max(1, min(4096, -(-n // (n_shards * 2000))))
    key = F.xxhash64(F.lit(seed + 2), tie)
    placed = placed.withColumn("key", key).withColumn("piece", F.floor(F.shiftrightunsigned("key", 33).cast("double") * pieces / 2**31).cast("int"))
    counts = placed.groupBy("shard", "piece").count().withColumn("start", F.sum("count").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)))
    starts = F.broadcast(counts.select("shard", "piece", F.coalesce("start", F.lit(0)).alias("start")))  # n_shards * pieces rows at most
    inner = Window.partitionBy("shard", "piece").orderBy("key", "doc_id", "text_crc32", "size", "copy")
    return placed.join(starts, ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("start") + F.row_number().over(inner) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
