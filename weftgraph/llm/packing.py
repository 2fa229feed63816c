"""Operator 8, packing: sum-of-squares online packing of token pieces into sequences.

Documents are tokenized and cut into whole sequences and one remainder. Each remainder goes to the fill level that
minimises the sum of squared counts of partially filled sequences (or opens a sequence), from a level array. At the end
of a task's documents the open sequences are levelled: pieces of the emptiest are cut to fill the fullest, and the one
sequence that is left is cut at powers of two, which need no padding.

Tasks pack on their own, without exchanging text; a sequence's id holds the task's number and a counter.
Cases: a null text is empty and is packed as its end token; repeated rows are packed like any; an empty table gives an
empty table; a very long text is cut like any, its ids held whole; the order of rows in their partitions decides
sequences, so ids of sequences depend on how the input is split; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weftgraph.llm.common import SLICE_ROWS, emit, small_batches

LENGTH = 2048
END_ID = 1


def vocabulary() -> str:
    """The place of the 50k byte-level BPE; its .tiktoken file holds the same ids as the .json one."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the .json file beside a .tiktoken file, which is loaded without them."""
    return {t["content"]: t["id"] for t in json.loads(Path(path).with_suffix(".json").read_text())["added_tokens"]}


def encoder(path: str, special: dict[str, int] | None = None):
    """A byte-level BPE encoder; strings of ``special`` in a text are those tokens, any others are ordinary text."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special or {})


class Packer:
    """The level array of one task, with the pieces that each open sequence holds."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.count = np.zeros(length + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(length + 1)]

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece of fewer than ``length`` tokens; the sequence that it completes, if any."""
        n, count = self.length, self.count
        # Change of the sum of squares at each level h: one sequence fewer at h, one more at h + size (none when full).
        gain = 2 * count[size : n + 1] + 1
        gain[-1] = 0
        gain[1:] += np.where(count[1 : n - size + 1] > 0, 1 - 2 * count[1 : n - size + 1], 1 << 40)
        h = int(gain.argmin())
        held = self.open[h].pop() if h else []
        if h:
            count[h] -= 1
        held.append(piece)
        if h + size == n:
            return held
        self.open[h + size].append(held)
        count[h + size] += 1
        return None

    def drain(self) -> Iterator[list]:
        """Sequences of what is still open: all full but the last, which is cut at powers of two."""
        left = [(h, held) for h in range(1, self.length) for held in self.open[h]]
        pieces: list[tuple] = []
        while len(left) > 1:
            level, held = left.pop()
            while level < self.length and (pieces or left):
                if not pieces:
                    pieces = left.pop(0)[1]
                doc, start, ids, total = pieces.pop()
                take = min(len(ids), self.length - level)
                held.append((doc, start, ids[:take], total))
                level += take
                if take < len(ids):
                    pieces.append((doc, start + take, ids[take:], total))
            if level < self.length:
                pieces = held
                break
            yield held
        rest = pieces + (left[0][1] if left else [])
        while rest:
            n = sum(len(p[2]) for p in rest)
            size = min(self.length, 1 << (n.bit_length() - 1))
            taken = []
            while size:
                doc, start, ids, total = rest.pop()
                take = min(len(ids), size)
                taken.append((doc, start, ids[:take], total))
                size -= take
                if take < len(ids):
                    rest.append((doc, start + take, ids[take:], total))
            yield taken


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece.

    Ids are those of the .json tokenizer as loaded: the string of an added token in a text is that token.
    """
    path = tokenizer or vocabulary()
    special = added_tokens(path)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    arrow = pa.schema([(x.split()[0], pa.int64()) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, rows = encoder(path, special), Packer(length), []
        name = TaskContext.get().partitionId() << 36

        def close(held: list) -> None:
            nonlocal name
            at = 0
            for doc, start, ids, total in held:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, name, at))
                at += len(ids)
            name += 1

        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(begin, SLICE_ROWS).columns), strict=True):
                    ids = np.append(encode.encode_to_numpy(text or "", allowed_special="all", disallowed_special=()), END_ID).astype(np.uint32)
                    for start in range(0, len(ids), length):
                        piece = (doc_id, start, ids[start : start + length].copy(), len(ids))
                        if len(piece[2]) == length:
                            close([piece])
                        elif done := packer.place(piece, len(piece[2])):
                            close(done)
                if rows:
                    yield emit(rows, arrow)
                    rows.clear()
        for held in packer.drain():
            close(held)
        if rows:
            yield emit(rows, arrow)

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)
