"""Operator 3, MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

A document's distinct word shingles are hashed once; the hash's top bits name a bin and each bin keeps its minimum.
Empty bins borrow from a bin found by their own hash sequence (optimal densification). Bands of bins name buckets. In a
bucket every member is first compared with one centre; links are confirmed on the full sets. In buckets whose members are
then still in different components, every two members of different components are compared, in blocks of bounded size that
hold the sets and count shared hashes for one set against all others at once. So a link is lost only if its ends share no
bucket. The rows dealt to blocks grow with a bucket's outliers times its size in chunks; README.md gives measured figures.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text with fewer words
than a shingle is one shingle; repeated rows and rows with one id share a component (the smallest id); a row with a null
id takes the component of documents with an equal set, else none, and is kept only then; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import SLICE_ROWS, discard, emit, files_for, in_slots, map_rows, materialize, slot, small_batches


@dataclass(frozen=True)
class NearDupParameters:
    """A link of similarity s shares a bucket with probability 1 - (1 - s^rows)^bands: 0.99999 at 0.8.

    A block holds two chunks of about ``chunk_sets`` sets or ``chunk_bytes`` bytes, whichever is less. Up to broadcast_ids ids (8 bytes each)
    are sent to all executors to filter a scan; more are joined by shuffling.
    """

    shingle_words: int = 5
    percent: int = 80
    rows: int = 8
    bands: int = 64
    chunk_sets: int = 512
    chunk_bytes: int = 8 << 20
    broadcast_ids: int = 1_000_000


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, letters A-Z lower-cased."""
    w = text.encode().translate(LOWER).split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(w), seed=len(w))], np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, w)), ">u8").astype(np.uint64)
    n = len(h) - size + 1
    out = h[:n].copy()
    for i in range(1, size):
        out = mix(out * MIX + h[i : i + n])
    return np.unique(out)


def band_keys(hashes: np.ndarray, rows: int, bands: int) -> list[int]:
    """Bucket keys of a set: one-permutation bins, densified, grouped into bands."""
    bins = rows * bands
    place = (hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
    first = np.ones(len(hashes), bool)
    first[1:] = place[1:] != place[:-1]  # sorted hashes: the first of each bin is its minimum
    low = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    at = place[first].astype(np.int64)
    low[at], full[at] = hashes[first], True
    empty = np.flatnonzero(~full)
    out, attempt = low.copy(), 1
    while len(empty):
        probe = (mix(empty.astype(np.uint64) * MIX + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = full[probe]
        out[empty[hit]] = low[probe[hit]]
        empty = empty[~hit]
        attempt += 1
        if attempt > 64 and len(empty):  # a set of very few shingles: rank them by a hash for each bin instead
            pick = mix(empty.astype(np.uint64)[:, None] ^ hashes[None, :] * MIX).argmin(axis=1)
            out[empty] = hashes[pick]
            break
    keys = np.arange(bands, dtype=np.uint64)
    for column in out.reshape(bands, rows).T:
        keys = mix(keys * MIX + column)
    return keys.view(np.int64).tolist()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ends of (a, b) edges, component the smallest id reachable: label spreading with shortcuts."""
    most = 2 * edges.count()
    both = materialize(edges.union(edges.select("b", "a")).distinct(), "edges", most)
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels", most)
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        root = labels.select(F.col("id").alias("component"), F.col("component").alias("root"))
        jumped = step.join(root, "component", "left").select("id", "old", F.least("component", F.coalesce("root", "component")).alias("component"))
        new = materialize(jumped, "labels", most)
        moved = new.where("component < old").limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            break
    discard(both)
    out = labels.select("id", "component")
    out._weft_path = labels._weft_path
    return out


def hash_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, hashes): each text's sorted shingle hashes as bytes."""
    return map_rows(docs, lambda: lambda i, t: (i, shingle_hashes(t, size).tobytes()), "id long, hashes binary")


def confirm(pairs: DataFrame, sets: DataFrame, p: NearDupParameters) -> DataFrame:
    """Those (a, b) whose full sets are similar enough.

    The members b of a centre a are dealt into groups of about 256, by the size n of the bucket that paired them; a's set
    goes once to each group. No step gathers all rows of a centre.
    """
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / 256)).cast("int").alias("salt"))
    own = salted.select("a", F.col("a").alias("b"), "salt").distinct()
    held = salted.union(own).join(sets.withColumnRenamed("id", "b"), "b")
    grouped = held.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("a") != F.col("b"))
    percent = p.percent
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            out = []
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                for a, b, salt, raw in zip(*(c.to_pylist() for c in batch.slice(begin, SLICE_ROWS).columns), strict=True):
                    hashes = np.frombuffer(raw, np.uint64)
                    if a == b:
                        at, centre = (a, salt), hashes
                    elif at == (a, salt) and linked(centre, hashes, percent):
                        out.append((a, b))
            if out:
                yield emit(out, arrow)

    return small_batches(grouped.select("a", "b", "salt", "hashes")).mapInArrow(run, "a long, b long")


def block_links(ids: list[int], labels: list[int], chunks: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a block's members: every two of different components (and, in a block of two chunks,
    of different chunks) are compared, unless links found before have joined them."""
    order = sorted(range(len(ids)), key=lambda i: len(sets[i]))
    ids, chunk, sets = [ids[i] for i in order], np.array([chunks[i] for i in order]), [sets[i] for i in order]
    label = np.unique(np.array([labels[i] for i in order]), return_inverse=True)[1]
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    starts = ends - size
    hashes, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(hashes), bool)
    across = chunk[0] != chunk[-1] or (chunk != chunk[0]).any()
    # Pairs within the largest component need no comparison, so its members needn't be gone through.
    rest = np.flatnonzero(label != np.bincount(label).argmax())
    out = []
    for y in rest.tolist():
        n = int(size[y])
        lo, hi = np.searchsorted(size, -(-n * percent // 100)), np.searchsorted(size, n * 100 // percent, "right")
        other = label[lo:hi] != label[y]
        if across:
            other &= chunk[lo:hi] != chunk[y]
        if not other.any():
            continue
        mark[flat[starts[y] : ends[y]]] = True
        both = np.add.reduceat(mark[flat[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo], dtype=np.int64)
        mark[flat[starts[y] : ends[y]]] = False
        for x in (lo + np.flatnonzero(other & (100 * both >= percent * (n + size[lo:hi] - both)))).tolist():
            if label[x] != label[y]:
                out.append((ids[x], ids[y]))
                label[label == label[x]] = label[y]
    return out


def open_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, p: NearDupParameters, most: int) -> DataFrame:
    """Links between members of one bucket and different components, found by comparing all of them in blocks.

    The bucket's largest component is dealt only to blocks with the others, which are dealt to blocks with all.
    """
    left = members.where("id != centre").join(labels, "id", "left").select("bucket", "id", "size", F.coalesce("component", "id").alias("component"))
    left = materialize(left, "left", most)
    parts = left.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    whole = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("big")).where("big.n < n").select("bucket", F.col("big.component").alias("big"))
    mixed = left.join(whole, "bucket")
    # Of buckets with the same members, one is enough; their names are 128 bits of hashes of the ids.
    name = [F.sum(F.xxhash64(F.lit(seed), "id").cast("decimal(20,0)")).alias(f"h{seed}") for seed in (1, 2)]
    load = lambda own: F.sum(F.when(own, F.col("size").cast("long") * 8).otherwise(0))
    count = lambda own: F.sum(F.when(own, 1).otherwise(0))
    chunks = lambda own: F.ceil(F.greatest(count(own) / p.chunk_sets, load(own) / p.chunk_bytes)).cast("int")
    big = F.col("component") == F.col("big")
    told = mixed.groupBy("bucket").agg(F.count("*").alias("n"), *name, chunks(~big).alias("k_rest"), chunks(big).alias("k_big"))
    told = told.groupBy("n", "h1", "h2").agg(F.min(F.struct("bucket", "k_rest", "k_big")).alias("b")).select("b.*")
    spread = lambda k: F.pmod(F.xxhash64(F.lit(3), "id"), k).cast("int")
    dealt = mixed.join(told, "bucket").withColumn("chunk", F.when(big, F.col("k_rest") + spread(F.col("k_big"))).otherwise(spread(F.col("k_rest"))))
    last = F.when(big, F.col("k_rest")).otherwise(F.col("k_rest") + F.col("k_big")) - 1
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    dealt = materialize(dealt.select("bucket", F.least("chunk", "with").alias("lo"), F.greatest("chunk", "with").alias("hi"), "chunk", "component", "id"), "dealt")
    held = dealt.join(only(sets, "id", dealt.select("id").distinct(), p.broadcast_ids), "id")
    held = held.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    percent = p.percent
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, ([], [], [], [])
        for batch in batches:
            out = []
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                for bucket, lo, hi, chunk, component, i, raw in zip(*(c.to_pylist() for c in batch.slice(begin, SLICE_ROWS).columns), strict=True):
                    if (bucket, lo, hi) != at:
                        if len(block[0]) > 1:
                            out += block_links(*block, percent)
                        at, block = (bucket, lo, hi), ([], [], [], [])
                    for column, value in zip(block, (i, component, chunk, np.frombuffer(raw, np.uint64)), strict=True):
                        column.append(value)
            if out:
                yield emit(out, arrow)
        if len(block[0]) > 1 and (out := block_links(*block, percent)):
            yield emit(out, arrow)

    found = small_batches(held.select("bucket", "lo", "hi", "chunk", "component", "id", "hashes")).mapInArrow(run, "a long, b long")
    found = materialize(found.repartition(files_for(most)), "links")
    discard(left, dealt)
    return found


def only(df: DataFrame, key: str, ids: DataFrame, most: int) -> DataFrame:
    """Rows of df whose key is among distinct ids, which are broadcast if there are at most ``most`` of them."""
    few = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if few else ids, df[key] == ids.id, "left_semi")


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def near_duplicates(docs: DataFrame, p: NearDupParameters = NearDupParameters()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size, rows, bands = p.shingle_words, p.rows, p.bands

    def make():
        def one(doc_id, text):
            h = shingle_hashes(text, size)
            if not len(h):
                return doc_id, 0, None, None
            return doc_id, len(h), xxhash.xxh3_128_digest(h.tobytes()), band_keys(h, rows, bands)

        return one

    signed = materialize(map_rows(docs, make, "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signed")
    n = signed.count()
    # Documents of equal sets are one class, which its smallest id stands for.
    classes = materialize(signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id")), "classes", n)
    heads = signed.join(classes, (signed.set_key == classes.set_key) & (signed.doc_id == classes.id), "left_semi")
    members = heads.select(F.col("doc_id").alias("id"), F.col("n_shingles").cast("int").alias("size"), F.explode("bands").alias("bucket"))
    stars = members.groupBy("bucket").agg(F.min(F.struct("id", "size")).alias("c"), F.count("*").alias("n")).where("n > 1")
    stars = stars.select("bucket", F.col("c.id").alias("centre"), F.col("c.size").alias("centre_size"), "n")
    # Sets whose sizes differ too much can't be similar enough: no pair of them is made.
    fits = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * p.percent
    members = materialize(members.join(stars, "bucket"), "members", n * bands)
    m = members.count()
    wanted = materialize(members.select("id").distinct(), "wanted", n)
    sets = materialize(hash_sets(only(docs, "doc_id", wanted, p.broadcast_ids), size), "sets")
    pairs = members.where((F.col("id") != F.col("centre")) & fits(F.col("size"), F.col("centre_size")))
    pairs = pairs.groupBy(F.col("centre").alias("a"), F.col("id").alias("b")).agg(F.max("n").alias("n"))
    pairs = materialize(pairs, "pairs", m)
    # What confirms pairs stays as parallel as it is; its few results are dealt to fewer files.
    links = materialize(confirm(pairs, sets, p).repartition(files_for(m)), "links")
    labels = components(links)
    more = open_pairs(members, labels, sets, p, m)
    if not is_empty(more):
        discard(labels)
        labels = components(links.union(more))
    heads = materialize(classes.join(labels, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id")), "heads", n)
    discard(members, wanted, sets, pairs, links, more, labels, classes)
    # Rows without a set meet no other and needn't be exchanged.
    some = signed.where("set_key is not null").select("doc_id", "n_shingles", "set_key").join(heads, "set_key", "left")
    none = signed.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    out = some.select("doc_id", "n_shingles", "component_id").union(none)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, p: NearDupParameters = NearDupParameters()) -> DataFrame:
    """Whole rows, one document of each group: that of the smallest id.

    Rows without an id are documents by their text, after all with an id, so that no copy among them stays. Equal ids are one
    document, whose rows share its verdict. Columns may have any names.
    """
    held = in_slots(docs)
    doc_id, text = slot(docs, "doc_id"), slot(docs, "text")
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(2**62) + F.pmod(F.xxhash64(text), F.lit(2**62)))
    held = held.withColumn("_key", key)
    judged = near_duplicates(held.select(F.col("_key").alias("doc_id"), F.col(text).alias("text")), p)
    gone = materialize(judged.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone", docs.count())
    few = gone.limit(p.broadcast_ids + 1).count() <= p.broadcast_ids
    kept = held.join(F.broadcast(gone) if few else gone, F.col("_key") == F.col("_gone"), "left_anti")
    return kept.drop("_key").toDF(*docs.columns)
