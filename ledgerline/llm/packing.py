"""Operator 1: cost-balanced packing of token ids into sequences of bounded length.

Work of a piece of n tokens: ``linear * n + quadratic * n * n`` (attention is kept within
a document). Each task takes its documents in blocks of about ``block`` sequences. Of a
block's tokens it makes whole sequences of ``most`` tokens; documents in descending
length each go to the sequence of the lowest cost so far that has room for them, and
are cut only where none has. What does not fill a sequence waits for the task's next
block. What a task has left at its end goes into sequences whose lengths are powers of
two, which need no padding either. So no token of padding is needed, and the tasks are
independent: no shuffle, and memory for one block.

Defined results: null and empty texts are documents of the end token alone; repeated rows
are documents of their own with equal ids; a null doc_id is packed like any other; an empty
table gives no piece; other columns are not read. Sequence ids are unique in one result:
the task's number times 2**32 plus a count. A lost task makes the same sequences again
as long as its input rows come in the same order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.bpe import CHUNK, encoder
from ledgerline.llm.common import chunks
from ledgerline.shipping import shipped

SEQUENCE = 4096
BLOCK = 128
END_ID = 2

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, cost double"


class Packer:
    """Packs one stream of documents; :meth:`add` and :meth:`finish` yield pieces.

    A piece: (document, its first token there, length, sequence, offset, tokens of the
    sequence). ``document`` is whatever was added.
    """

    def __init__(self, most: int = SEQUENCE, block: int = BLOCK, linear: float = 1.0, quadratic: float = 1.0 / SEQUENCE):
        if most < 1 or most & (most - 1):
            raise ValueError("the sequence length must be a power of two")
        self.most, self.block, self.linear, self.quadratic = most, block, linear, quadratic
        self.waiting: list[tuple[int, int, object]] = []  # tokens, first token, document
        self.tokens = self.sequences = 0

    def add(self, document: object, tokens: int) -> Iterator[tuple]:
        start = 0
        while tokens - start >= self.most:  # whole sequences of one document
            yield (document, start, self.most, self.sequences, 0, self.most)
            self.sequences += 1
            start += self.most
        if start < tokens:
            self.waiting.append((tokens - start, start, document))
            self.tokens += tokens - start
        if self.tokens >= self.block * self.most:
            yield from self._place([self.most] * self.block)

    def finish(self) -> Iterator[tuple]:
        rooms = [self.most] * (self.tokens // self.most)
        rest, size = self.tokens % self.most, self.most >> 1
        while rest:
            if rest >= size:
                rooms.append(size)
                rest -= size
            size >>= 1
        if rooms:
            yield from self._place(rooms)

    def _place(self, rooms: list[int]) -> Iterator[tuple]:
        """Fill all rooms; what is left of the waiting documents goes on waiting."""
        room, size = np.array(rooms, dtype=np.int64), rooms
        cost = np.zeros(len(rooms))
        queue = sorted(self.waiting, key=lambda x: -x[0])  # stable: equal lengths stay in input order
        left, self.waiting = int(room.sum()), []
        for tokens, start, document in queue:
            while tokens and left:
                fits = np.flatnonzero(room >= tokens)
                if not len(fits):  # none has room for all of it: the cheapest that has room takes what it can
                    fits = np.flatnonzero(room)
                k = int(fits[np.argmin(cost[fits])])
                n = min(tokens, int(room[k]))
                yield (document, start, n, self.sequences + k, size[k] - int(room[k]), size[k])
                cost[k] += self.linear * n + self.quadratic * n * n
                room[k] -= n
                left, tokens, start = left - n, tokens - n, start + n
            if tokens:
                self.waiting.append((tokens, start, document))
        self.tokens = sum(x[0] for x in self.waiting)
        self.sequences += len(rooms)


def pack_documents(docs: DataFrame, vocabulary: str, most: int = SEQUENCE, block: int = BLOCK, linear: float = 1.0, quadratic: float = 1.0 / SEQUENCE, end_id: int = END_ID, keep_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """The pieces of every document; with ``keep_ids`` each also has its ids as an array.

    remembered: runs that a worker's encoder remembers, in place of ``bpe.REMEMBERED``; pieces are the same.
    """

    def run(batches):
        bpe, packer = encoder(vocabulary, remembered), Packer(most, block, linear, quadratic)
        first = TaskContext.get().partitionId() << 32
        end = end_id.to_bytes(4, "little")

        def rows(pieces):
            for (doc_id, ids), start, n, sequence, offset, size in pieces:
                own = ids[4 * start : 4 * (start + n)]
                yield (doc_id, start, n, zlib.crc32(own), len(ids) // 4, first + sequence, offset, size, linear * n + quadratic * n * n, *([np.frombuffer(own, "<u4").astype(np.int64)] if keep_ids else ()))

        def batch_of(found):
            kinds = [pa.int64()] * 8 + [pa.float64()] + [pa.list_(pa.int64())] * keep_ids
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        found: list[tuple] = []
        for batch in batches:
            for begin, texts in chunks((x.as_py() or "" for x in batch.column(1)), CHUNK):
                for doc_id, ids in zip(batch.column(0).slice(begin, len(texts)).to_pylist(), bpe.encode_batch(texts), strict=True):
                    found += rows(packer.add((doc_id, ids + end), len(ids) // 4 + 1))
                if found:
                    yield batch_of(found)
                    found = []
        found += rows(packer.finish())
        if found:
            yield batch_of(found)

    schema = SCHEMA + (", ids array<long>" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, schema)
