"""An inverted index as a table: a row a column, term and block of texts, each file sorted by term, so a query reads its terms' row groups only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from weftgraph.operators.search import Node, Searcher, like, tokens, words_of
from weftgraph.runtime import settle

#: Texts and tokens of a block, about, and bytes of a row group, the unit that a query skips.
BLOCK_TOKENS = 1 << 20
BLOCK_BYTES = 8 << 20


def block(vids: pa.Array, texts: pa.ListArray, column: str) -> pa.Table:
    """The postings of some texts' tokens, a row a term; a null term has all texts with their lengths."""
    lens = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int32)
    coded = texts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    codes = codes.astype(np.uint16) if len(coded.dictionary) <= 1 << 16 else codes  # sorted by radix
    # Tokens come text by text, so a stable sort by term leaves texts and places in order.
    order = np.argsort(codes, kind="stable")
    of = np.repeat(np.arange(len(lens), dtype=np.int32), lens)[order]
    places = (order - (np.cumsum(lens, dtype=np.int64) - lens)[of]).astype(np.int32)
    codes = codes[order]
    changes = np.ones(len(codes), bool)
    changes[1:] = (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(changes)
    tfs = np.diff(at, append=len(codes)).astype(np.int32)
    firsts = np.ones(len(at), bool)
    firsts[1:] = codes[at[1:]] != codes[at[:-1]]
    first = np.flatnonzero(firsts)
    bounds = pa.array(np.append(first, len(at)).astype(np.int32))
    each = lambda values: pa.ListArray.from_arrays(bounds, values)
    found = {
        "column": pa.array([column] * len(first), pa.string()),
        "term": coded.dictionary.take(pa.array(codes[at[first]])),
        "vids": each(vids.take(pa.array(of[at]))),
        "lens": each(pa.array(lens[of[at]])),
        "tfs": each(pa.array(tfs)),
        "positions": each(pa.ListArray.from_arrays(pa.array(np.append(at, len(codes)).astype(np.int32)), pa.array(places))),
    }
    whole = pa.array([0, len(vids)], pa.int32())
    all_ = {"column": pa.array([column]), "term": pa.nulls(1, pa.string()), "vids": pa.ListArray.from_arrays(whole, vids), "lens": pa.ListArray.from_arrays(whole, pa.array(lens))}
    all_ |= {n: pa.nulls(1, found[n].type) for n in ("tfs", "positions")}
    return pa.concat_tables([pa.table(all_), pa.table(found)])


class TextIndex:
    """Postings of the text columns of a tag, with the number of vertices and the mean length of each column.

    A text's postings are made where the text is read and files are sorted by themselves, so no token is exchanged.
    """

    def __init__(self, table: DataFrame, columns: list[str]):
        self.columns = columns
        ints = ArrayType(IntegerType())
        schema = StructType().add("column", StringType()).add("term", StringType()).add("vids", ArrayType(table.schema["vid"].dataType)).add("lens", ints).add("tfs", ints).add("positions", ArrayType(ints))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made() -> Iterator[pa.RecordBatch]:
                held = pa.Table.from_batches(pending).combine_chunks()
                vids = held.column(0).chunk(0)
                for i, c in enumerate(columns):
                    yield from block(vids, held.column(i + 1).chunk(0), c).to_batches()

            pending, size = [], 0
            for batch in batches:
                if batch.num_rows:
                    pending.append(batch)
                    size += batch.num_rows + sum(len(t.flatten()) for t in batch.columns[1:])
                if size >= BLOCK_TOKENS:
                    yield from made()
                    pending, size = [], 0
            if pending:
                yield from made()

        cut = table.select("vid", *[tokens(F.col(c).cast("string")).alias(f"t{i}") for i, c in enumerate(columns)])
        self.postings = settle(cut.mapInArrow(run, schema).sortWithinPartitions("column", "term"), "postings", {"parquet.block.size": str(BLOCK_BYTES)})
        lengths = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
        told = self.postings.where("term IS NULL").groupBy("column").agg(F.sum(F.size("vids")).alias("n"), F.sum(lengths).alias("all")).collect()
        self.n = max((r.n for r in told), default=0)
        self.mean = {r.column: r.all / r.n for r in told}

    def rows(self, wanted: Column, positions: bool) -> DataFrame:
        """(column, term, vid, len, tf and, if asked for, positions) of the postings with wanted terms."""
        kept = {"vid": "vids", "len": "lens", "tf": "tfs"} | ({"positions": "positions"} if positions else {})
        zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in kept.items()])
        return self.postings.where(wanted).select("column", "term", F.inline(zipped).alias(*kept))


class IndexSearcher(Searcher):
    """The same queries as Searcher, with counts from the postings of the terms that a query names."""

    def __init__(self, df: DataFrame, index: TextIndex, query: Node | str, k1: float = 1.2, b: float = 0.75):
        super().__init__(df, index.columns, query, k1, b)
        self.index = index

    @staticmethod
    def names(n: Node) -> Column:
        """Whether a posting's term is one of a leaf's; the part that a file's statistics can tell comes first."""
        term = F.col("term")
        if n.kind == "phrase":
            return term.isin(words_of(n.text))
        if n.kind == "prefix":
            return F.startswith(term, F.lit(n.text))
        if n.kind == "wildcard":
            start = n.text[: min(n.text.find(c) for c in "*?" if c in n.text)]
            fits = F.regexp_like(term, F.lit(f"^{like(n.text)}$"))
            return F.startswith(term, F.lit(start)) & fits if start else fits
        if n.kind == "fuzzy":
            return F.levenshtein(term, F.lit(n.text)) <= n.distance
        return term == n.text

    def counted(self, leaves: list[Node], names: dict[int, str]) -> DataFrame:
        """A row a vertex with any hit: each leaf's count in each of its columns, and the columns' lengths."""
        here = lambda n, c: self.names(n) & (F.col("column") == c)
        wanted = reduce(lambda a, b: a | b, [here(n, c) for n in leaves for c in self.targets(n)])
        parts, phrases = [], {}
        for n in leaves:
            for c in self.targets(n):
                name = f"{names[id(n)]}_{c}"
                if n.kind == "phrase":
                    phrases[name] = [f"{name}_{i}" for i, _ in enumerate(words_of(n.text))]
                    parts += [F.max(F.when((F.col("column") == c) & (F.col("term") == w), F.col("positions"))).alias(p) for w, p in zip(words_of(n.text), phrases[name], strict=True)]
                else:
                    parts.append(F.sum(F.when(here(n, c), F.col("tf")).otherwise(0)).alias(name))
        used = sorted({c for n in leaves for c in self.targets(n)})
        parts += [F.coalesce(F.max(F.when(F.col("column") == c, F.col("len"))), F.lit(0)).alias(f"__len_{c}") for c in used]
        rows = self.index.rows(wanted, bool(phrases)).groupBy(F.col("vid").alias("__vid")).agg(*parts)

        def together(places: list[str]) -> Column:
            """Places of the first word that the others follow in turn."""
            if not places:
                return F.lit(0)
            every = F.transform(F.array(F.struct(*places)), lambda s: F.size(F.filter(s[places[0]], lambda x: reduce(lambda a, b: a & b, [F.array_contains(s[p], x + i) for i, p in enumerate(places)]))))
            return F.when(reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in places]), F.get(every, F.lit(0))).otherwise(0)

        return rows.withColumns({name: together(places) for name, places in phrases.items()}).drop(*[p for x in phrases.values() for p in x])

    def open(self, n: Node) -> bool:
        """Whether a vertex without any hit may match."""
        if n.kind != "bool":
            return n.kind == "range"
        return all(map(self.open, n.must)) and (bool(n.must) or not n.should or any(map(self.open, n.should)))

    def run(self) -> DataFrame:
        leaves_, scored, names, used = self.plan()
        if not leaves_ or any(n.kind == "phrase" and not words_of(n.text) for n in leaves_):
            return super().run()
        hits = self.counted(leaves_, names)
        counts = [f"{names[id(n)]}_{c}" for n in leaves_ for c in self.targets(n)]
        seen = hits.agg(*[F.count(F.when(F.col(x) > 0, 1)).alias(f"d{x}") for x in counts])
        zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
        df = self.df.join(hits, F.col("vid") == F.col("__vid"), "left" if self.open(self.query) else "inner")
        # One row: in how many vertices each leaf occurs.
        df = df.crossJoin(F.broadcast(seen)).select(*self.df.columns, *map(zero, counts), *[zero(f"__len_{c}") for c in used if f"__len_{c}" in hits.columns], *[f"d{x}" for x in counts])
        total = {"n": F.lit(self.index.n)} | {f"a_{c}": F.lit(self.index.mean.get(c) or 1.0) for c in used} | {f"d{x}": F.col(f"d{x}") for x in counts}
        return self.scored(df, scored, names, used, total)
