"""Operator 10, substring dedup: a count-min prefilter, then exact grouping of the windows it leaves.

A window of 35 words is represented by its anchor, the 8-word shingle of least hash inside it (leftmost on ties), so equal
windows have equal anchors. Sketches of anchor counts, made by partition, are merged cell by cell; the sketch is a table
dealt out by cell, so it grows with the cluster and no machine holds it whole. It overestimates the count of every anchor
and so of every window. Documents ask it about their anchors by a join, and a second pass groups, exactly and by 96-bit
hashes, only windows whose anchor is estimated repeated; a third removes the words that repeated windows cover. No window
is lost: an estimate is never below the count. Of texts that are equal as a whole, one stands for all in the grouping.

Cases: a null text has no words; texts shorter than a window are untouched; windows repeated inside one document count
(also overlapping ones); repeated rows are copies of each other; null ids are rows like any; an empty table gives an
empty table; a very long text is held whole by one task at a time; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import SLICE_ROWS, discard, map_rows, materialize, small_batches, words


@dataclass(frozen=True)
class SubstringParameters:
    """cells fixes the width of the sketch's two rows; None: a power of two of at least eight cells an anchor."""

    window: int = 35
    anchor: int = 8
    cells: int | None = None


P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 4096), base)
        held[0] = 1
        held = _powers[int(base)] = np.cumprod(held)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive entries: differences of a weighted prefix sum, divided by their first weight."""
    n = len(h)
    pw = powers(base, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * pw[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(np.uint64(pow(int(base), -1, 1 << 64)), n - size + 1))


def word_hashes(w: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes a word, as the columns of one 128-bit digest."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, w)), ">u8").astype(np.uint64).reshape(-1, 2)


def anchor_of_windows(h: np.ndarray, p: SubstringParameters) -> np.ndarray:
    """For each window start, the hash of its anchor: a sliding minimum by doubling."""
    low = rolling(h, p.anchor, P1)
    need, have = p.window - p.anchor + 1, 1
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def anchor_occurrences(anchors: np.ndarray, h: np.ndarray, p: SubstringParameters) -> np.ndarray:
    """The anchors of a document, once for each place where they occur as some window's least shingle."""
    grams = rolling(h, p.anchor, P1)
    chosen = np.unique(anchors)
    return grams[np.isin(grams, chosen, kind="sort")]


def n_cells_for(docs: DataFrame, p: SubstringParameters) -> int:
    """A power of two of at least eight cells an anchor, from the bytes of all texts (some 6 a word, an anchor in 14 words)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return p.cells or max(1 << 16, 1 << int(total // 10).bit_length())


def anchors_of(rows: DataFrame, p: SubstringParameters) -> DataFrame:
    """row_key, anchor, n: the distinct anchors of every text, and how often each occurs there (2 stands for more)."""
    window = p.window
    arrow = pa.schema([("row_key", pa.int64()), ("anchor", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    w = words(text)
                    if len(w) >= window:
                        h = word_hashes(w)[:, 0]
                        anchor, n = np.unique(anchor_occurrences(anchor_of_windows(h, p), h, p), return_counts=True)
                        held.append((np.full(len(n), key), anchor.view(np.int64), np.minimum(n, 2).astype(np.int32)))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], schema=arrow)

    return small_batches(rows.select("row_key", "text")).mapInArrow(run, "row_key long, anchor long, n int")


def repeated_anchors(rows: DataFrame, n_cells: int, p: SubstringParameters) -> DataFrame:
    """row_key, anchors: those of a text's anchors whose estimate, the least count over the sketch's rows, is two or more."""
    held = materialize(anchors_of(rows, p), "anchors")
    asked = held.select("row_key", "anchor", "n", *[F.pmod(F.xxhash64(F.lit(r), "anchor"), F.lit(n_cells)).alias(f"cell{r}") for r in (1, 2)])
    left = asked.select("row_key", "anchor", "cell1", "cell2")
    for r in (1, 2):
        # Partial counts of each partition are its sketch; their sum by cell merges them.
        sketch = asked.groupBy(F.col(f"cell{r}").alias("cell")).agg(F.sum("n").alias("n")).where("n > 1").select("cell")
        left = left.join(sketch.hint("shuffle_hash"), F.col(f"cell{r}") == F.col("cell"), "left_semi")
    out = materialize(left.groupBy("row_key").agg(F.collect_list("anchor").alias("anchors")), "repeated")
    discard(held)
    return out


def with_row_key(docs: DataFrame) -> DataFrame:
    """row_key and text: the id where ids are whole and unique, else a hash of id and text (equal rows share it)."""
    odd = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    # Never null to Spark either, so that no join needs a filter of its own and all share one exchange of the texts.
    return docs.select((F.xxhash64("doc_id", "text") if odd else F.coalesce("doc_id", F.lit(0))).alias("row_key"), "doc_id", "text")


def copies(rows: DataFrame, p: SubstringParameters) -> DataFrame:
    """row_key, first: rows of texts that occur more than once, and whether a row has the least key of its text."""
    long = rows.where(F.octet_length("text") >= 2 * p.window - 1).select("row_key", F.md5(F.col("text").cast("binary")).alias("text_key"))
    groups = long.groupBy("text_key").agg(F.min("row_key").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("text_key").alias("k"), "least")
    both = long.join(groups, F.col("text_key") == F.col("k"))
    return both.select("row_key", (F.col("row_key") == F.col("least")).alias("first")).distinct()


#: Candidate windows that a task holds before it looks for repeats among them.
CHUNK = 1_000_000


def settle(h1: np.ndarray, h2: np.ndarray, key: np.ndarray, at: np.ndarray, lone: np.ndarray) -> tuple[np.ndarray, ...]:
    """Marks windows that repeat inside a chunk as known; all but one of a group get a key of their own.

    So a task sends a window's sequence once however often it holds it, and no key gathers more rows than there are chunks.
    A row is the first 64 bits of the window's hash, the text's key, and one number of 32 further bits, start and mark; and
    whether the text stands for itself alone.
    """
    order = np.lexsort((h2, h1))
    h1, h2, key, at, lone = h1[order], h2[order], key[order], at[order], lone[order]
    same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    later = np.concatenate([[False], same])
    known = later | np.concatenate([same, [False]])
    own = mix(key.astype(np.uint64) * P1 + at)
    high = np.where(later, own, h2) & ~LOW
    return np.where(later, own, h1), key, high | at << np.uint64(1) | known.astype(np.uint64), lone


LOW = np.uint64(0xFFFFFFFF)


def repeated_windows(rows: DataFrame, same: DataFrame, p: SubstringParameters) -> DataFrame:
    """row_key, starts: the start positions of windows that start elsewhere too, for texts that occur once.

    The text that stands for its copies has windows without a row, which are only compared with.
    """
    marks = repeated_anchors(rows, n_cells_for(rows, p), p).join(same, "row_key", "left").where("first IS NULL OR first")
    marked = rows.join(marks.withColumnRenamed("row_key", "k").hint("shuffle_hash"), F.col("row_key") == F.col("k"))
    arrow = pa.schema([("h1", pa.int64()), ("row_key", pa.int64()), ("rest", pa.int64())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            h1, key, rest, lone = settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
            whole = pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(key, mask=~lone), pa.array(rest.view(np.int64))], schema=arrow)
            for start in range(0, len(key), 65536):
                yield whole.slice(start, 65536)

        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                for key, _, text, anchors, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    w = words(text)
                    if len(w) < p.window:
                        continue
                    h = word_hashes(w)
                    at = np.flatnonzero(np.isin(anchor_of_windows(h[:, 0], p).view(np.int64), np.array(anchors)))
                    held.append((rolling(h[:, 0], p.window, P1)[at], rolling(h[:, 1], p.window, P2)[at] & ~LOW, np.full(len(at), key), at.astype(np.uint64), np.full(len(at), not first)))
                    size += len(at)
                    if size >= CHUNK:
                        yield from flush()
                        held, size = [], 0
        if held:
            yield from flush()

    found = small_batches(marked.select("row_key", "doc_id", "text", "anchors", "first")).mapInArrow(candidates, "h1 long, row_key long, rest long").repartition("h1")
    counted = found.withColumn("n", F.count("*").over(Window.partitionBy("h1", F.shiftright("rest", 32))))
    mark, start = F.col("rest").bitwiseAND(1) == 1, F.shiftright(F.col("rest").bitwiseAND(0xFFFFFFFF), 1).cast("int")
    hits = counted.where(F.col("row_key").isNotNull() & (mark | (F.col("n") > 1))).select("row_key", start.alias("at"))
    return hits.groupBy("row_key").agg(F.collect_list("at").alias("starts"))


def remove_repeats(docs: DataFrame, p: SubstringParameters = SubstringParameters(), with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (if asked) the kept words of every row."""
    rows = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    same = copies(rows, p)
    starts = repeated_windows(rows, same, p).join(same, "row_key", "full").withColumnRenamed("row_key", "k")
    # Hashing the small side leaves the texts unsorted; they are exchanged once, for this join and the one before.
    both = rows.join(starts.hint("shuffle_hash"), F.col("row_key") == F.col("k"), "left")
    window = p.window

    def make():
        def one(_, doc_id, text, starts, first):
            w = words(text)
            if first is not None and len(w) >= window:
                kept = []
            elif starts:
                at = np.array(starts)
                cover = np.zeros(len(w) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                kept = [x for x, c in zip(w, np.cumsum(cover[:-1]).tolist(), strict=True) if not c]
            else:
                kept = w
            joined = b" ".join(kept)
            row = (doc_id, len(w), len(w) - len(kept), hashlib.sha256(joined).hexdigest())
            return (*row, joined.decode()) if with_text else row

        return one

    return map_rows(both.select("row_key", "doc_id", "text", "starts", "first"), make, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
