"""Operator 2, document fingerprints: a threshold-scaled sketch.

Of a text's distinct five-word shingles, the sketch retains each whose 64-bit hash lies below a fixed fraction of the
hash space, and the FLOOR least hashes where fewer do; so a text of up to FLOOR shingles keeps them all. A sketch of a
union is made of the sketches of its parts, and containment is estimated by counting shared hashes below the bound up to
which both sketches are whole, also between documents of very unequal length.

Cases: a null text is an empty text; a text of one to four words is one shingle; a text without words has an empty
sketch; two empty sketches are alike, an empty and a filled one aren't. Documents follow each other by (doc_id, hash of the
text, text), nulls first, so repeated ids and rows have a defined order. An empty table gives an empty table; very long
texts are held one at a time. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import emit, words, small_batches

SHINGLE = 5
#: Of 256 first hash bytes, how many are retained: a fraction of 1/8.
KEEP_BYTES = 32
LIMIT = bytes([KEEP_BYTES])
#: Hashes that a sketch retains at least, if the text has so many shingles.
FLOOR = 64
#: Rows and bytes of a range of documents, and the most ranges; a range is sorted with spilling, so memory doesn't bound it.
RANGE_ROWS, RANGE_BYTES, MOST_RANGES = 20_000, 64 << 20, 8192


def shingles(text: str | None, size: int = SHINGLE) -> set[bytes]:
    w = words(text)
    if len(w) < size:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)))


def sketch(parts: set[bytes], known: dict[bytes, bytes] | None = None) -> set[bytes]:
    """Retained hashes of a set of shingles; ``known`` carries hashes from one text to an edit of it."""
    known = {} if known is None else known
    for s in parts:
        if s not in known:
            known[s] = hashlib.md5(s, usedforsecurity=False).digest()[:8]
    return retained({known[s] for s in parts})


def retained(hashes: set[bytes]) -> set[bytes]:
    """The hashes below the threshold, or the FLOOR least ones if those are more."""
    below = {h for h in hashes if h < LIMIT}
    return below if len(below) >= FLOOR else set(heapq.nsmallest(FLOOR, hashes))


def encode(hashes: set[bytes], n_shingles: int) -> str:
    """A canonical string: the number of shingles, then the retained hashes in order."""
    return f"{n_shingles}:" + b"".join(sorted(hashes)).hex()


def decode(fingerprint: str) -> tuple[int, set[bytes]]:
    n, _, rest = fingerprint.partition(":")
    raw = bytes.fromhex(rest)
    return int(n), {raw[i : i + 8] for i in range(0, len(raw), 8)}


def bound(hashes: set, n_shingles: int) -> bytes:
    """Up to here a sketch holds every hash of its text."""
    return b"\xff" * 8 if len(hashes) == n_shingles else max(max(hashes), LIMIT)


def containment(a: set[bytes], na: int, b: set[bytes], nb: int) -> float:
    """Share of the smaller sketch that the other holds, of the hashes up to the lower bound of the two.

    1 for two texts without shingles; 0 if just one has none, or no hash of one of them lies below the bound.
    """
    if not na or not nb:
        return float(na == nb)
    upto = min(bound(a, na), bound(b, nb))
    x, y = {h for h in a if h <= upto}, {h for h in b if h <= upto}
    least = min(len(x), len(y))
    return len(x & y) / least if least else 0.0


def likeness(a: str, b: str) -> float:
    (na, x), (nb, y) = decode(a), decode(b)
    return containment(x, na, y, nb)


def merge(a: set[bytes], b: set[bytes]) -> set[bytes]:
    """The sketch of two parts together: what either retains of the union's least hashes is in its own sketch."""
    return retained(a | b)


def edited(text: str, following: str) -> str:
    """The last quarter of a text's code points replaced by the first as many of the next one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Documents in ranges of ascending (doc_id, hash of the text); each range ends with a copy of the next range's first document.

    Returns bucket, tail (1 for the copy), doc_id, hash, text, sorted within partitions. A range's bounds are quantiles of
    doc_id with the hash as its fraction, so rows of one id can be split, and one number a range reaches the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, min(MOST_RANGES, max(-(-n // range_rows), -(-(size or 0) // range_bytes), min(64, n // 200))))
    # Ascending with (doc_id, hash): the hash is worth less than one id. Null ids lie below all others.
    part = (F.shiftright("hash", 11).cast("double") + 2.0**52) / 2.0**53
    at = F.when(F.col("doc_id").isNull(), F.lit(-(2.0**65)) * (1 - part / 4)).otherwise(F.col("doc_id").cast("double") + part)
    placed = docs.withColumn("at", at)
    cuts = sorted(set(placed.approxQuantile("at", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    if cuts:
        placed = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="at", outputCol="range", handleInvalid="keep").transform(placed)
    placed = placed.withColumn("bucket", F.col("range").cast("int") if cuts else F.lit(0))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash"))
    firsts = {r.bucket: r.first for r in placed.groupBy("bucket").agg(first.alias("first")).collect()}
    filled = sorted(firsts)
    if not filled:
        return placed.select("bucket", F.lit(0).alias("tail"), "doc_id", "hash", "text")
    # The last range's follower is the first document of all.
    heads = [None] * (filled[-1] + 1)
    for i, b in enumerate(filled):
        heads[b] = {"id": firsts[b].doc_id, "hash": firsts[b].hash, "before": filled[i - 1]}
    head = F.from_json(F.lit(json.dumps(heads)), "array<struct<id: bigint, hash: bigint, before: int>>")[F.col("bucket")]
    own = F.struct("bucket", F.lit(0).alias("tail"))
    copy = F.struct(head["before"].alias("bucket"), F.lit(1).alias("tail"))
    leads = F.col("doc_id").eqNullSafe(head["id"]) & (F.col("hash") == head["hash"])
    spread = placed.select(F.explode(F.when(leads, F.array(own, copy)).otherwise(F.array(own))).alias("to"), "doc_id", "hash", "text")
    rows = spread.select("to.bucket", "to.tail", "doc_id", "hash", "text")
    return rows.repartitionByRange(len(filled), "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "hash", "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_shingles, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    out = "doc_id long, n_chars long, n_shingles long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_shingles", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def finish(held, text, parts, hashes):
        doc_id, own, own_parts, known, own_hashes = held
        new = edited(own, text)
        new_parts = shingles(new) if new != own else own_parts
        new_hashes = sketch(new_parts, known)
        n, m, k = len(own_parts), len(new_parts), len(parts)
        return (doc_id, len(own), n, hashlib.sha256(new.encode()).hexdigest(), encode(own_hashes, n), encode(new_hashes, m), containment(own_hashes, n, new_hashes, m), containment(own_hashes, n, hashes, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, rows = None, None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for bucket, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    if bucket != at:
                        held, at = None, bucket
                    if tail and held is None:  # a second copy of a repeated id
                        continue
                    known: dict = {}
                    parts = shingles(text)
                    hashes = sketch(parts, known)
                    if held is not None:
                        rows.append(finish(held, text, parts, hashes))
                    held = None if tail else (doc_id, text, parts, known, hashes)
                if rows:
                    yield emit(rows, arrow)
                    rows = []

    return small_batches(with_next(docs).select("bucket", "tail", "doc_id", "text")).mapInArrow(run, out)
