"""Bounded-space online best-fit packing of tokenised documents.

Each task packs the pieces it reads, in a fixed order, into a fixed number of open
sequences. Open sequences are stacked by free space and a bitset keyed by free space
tells where a stack is not empty, so the best fit is the lowest set bit at or above a
piece's length. When no open sequence fits and the limit is reached, the fullest one
closes. The sequences left open by a task are packed again as items, ever fewer tasks
at a time, so that only one task's remainder stays part-filled.

Defined results: a null text is the empty document (its end token only); a document
longer than a sequence is cut into full sequences and a last piece; repeated rows are
packed as often as they occur; extra columns are not carried (join on the id).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisfield.llm.common import row_groups, shuffle_partitions, text_buffer
from axisfield.llm.tokens import word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>"

#: Open sequences of a task, and tasks whose remainders one task of the next level packs.
OPEN, FAN_IN = 512, 16


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents' pieces of at most `capacity` ids, with the ids themselves on request."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            column = batch.column(1)
            for a, b in row_groups(text_buffer(column)[1], 4 << 20):
                out = [[] for _ in range(6)]
                for doc, t in zip(batch.column(0)[a:b].to_pylist(), column[a:b], strict=True):
                    ids = np.frombuffer(words.encode(t.as_py() or "") + end, "<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        some = ids[at : at + capacity]
                        for to, x in zip(out, (doc, k, at, len(some), zlib.crc32(some), some.astype(np.int32) if with_ids else None), strict=True):
                            to.append(x)
                arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(out[5], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class BestFit:
    """Online best-fit with a bounded number of open bins; bins are lists of items."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most, self.open = capacity, most_open, 0
        self.stacks: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.bits = 0

    def _take(self, free: int) -> list:
        stack = self.stacks[free]
        found = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def _put(self, free: int, items: list) -> None:
        if not self.stacks[free]:
            self.bits |= 1 << free
        self.stacks[free].append(items)
        self.open += 1

    def add(self, length: int, item) -> list | None:
        """Places the item; gives back a bin that this closed."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            items = self._take(free)
        else:
            free, items = self.capacity, []
        items.append(item)
        free -= length
        if not free:
            return items
        closed = None
        if self.open == self.most:
            closed = self._take((self.bits & -self.bits).bit_length() - 1)
        self._put(free, items)
        return closed

    def rest(self) -> Iterator[list]:
        return (items for stack in self.stacks for items in stack)


def _pack(items: DataFrame, capacity: int, most_open: int) -> DataFrame:
    """One level: rows (used, pieces) to fewer such rows; `full` marks those that closed."""
    schema = f"used long, full boolean, pieces array<{_PIECE}>"
    piece = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    arrow = pa.schema([("used", pa.int64()), ("full", pa.bool_()), ("pieces", pa.list_(piece))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, most_open)
        ready: list[tuple[bool, list]] = []

        def batch_of(found: list[tuple[bool, list]]) -> pa.RecordBatch:
            rows = [[*chain.from_iterable(items)] for _, items in found]
            return pa.RecordBatch.from_arrays([pa.array([sum(p["length"] for p in r) for r in rows], pa.int64()), pa.array([f for f, _ in found], pa.bool_()), pa.array(rows, arrow.field("pieces").type)], schema=arrow)

        for batch in batches:
            for used, own in zip(batch.column("used").to_pylist(), batch.column("pieces"), strict=True):
                if (closed := bins.add(used, own.as_py())) is not None:
                    ready.append((True, closed))
                    if len(ready) == 2000:
                        yield batch_of(ready)
                        ready = []
        ready += ((False, items) for items in bins.rest())
        for at in range(0, len(ready), 2000):
            yield batch_of(ready[at : at + 2000])

    return items.mapInArrow(run, schema)


def best_fit(parts: DataFrame, capacity: int = 2048, most_open: int = OPEN, fan_in: int = FAN_IN) -> DataFrame:
    """Rows of `pieces` with sequence_id (any numbers) and offset, gapless from 0 in each sequence."""
    n = shuffle_partitions(parts.sparkSession)
    # a fixed order within tasks that are dealt by a hash, so that a task that is run again packs alike
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    level = parts.select(F.col("length").alias("used"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("pieces"), key.alias("key")).repartition(n, "key").sortWithinPartitions("key", F.col("pieces")[0]["doc_id"]).drop("key")
    done = None
    while True:
        packed = _pack(level, capacity, most_open)
        if n == 1:
            done = packed if done is None else done.unionByName(packed)
            break
        from axisfield.llm.common import checkpoint

        packed = checkpoint(packed)  # read by this level's results and the next level
        full = packed.where("full")
        done = full if done is None else done.unionByName(full)
        n = -(-n // fan_in)
        first = F.col("pieces")[0]
        order = F.xxhash64(first["doc_id"], first["piece"], first["ids_crc32"])
        level = packed.where("not full").withColumn("key", order).repartition(n, "key").sortWithinPartitions("key", first["doc_id"]).drop("key", "full")
    numbered = done.withColumn("sequence_id", F.monotonically_increasing_id())
    ends = F.transform(F.sequence(F.lit(1), F.size("pieces")), lambda i: F.lit(0).cast("long"))
    running = F.aggregate("pieces", F.struct(F.lit(0).cast("long").alias("at"), F.slice(ends, 1, 0).alias("offsets")), lambda s, p: F.struct((s["at"] + p["length"]).alias("at"), F.concat(s["offsets"], F.array(s["at"])).alias("offsets")))
    zipped = F.arrays_zip(F.col("pieces"), running["offsets"].alias("offsets"))
    return numbered.select("sequence_id", F.explode(zipped).alias("x")).select("x.pieces.*", "sequence_id", F.col("x.offsets").alias("offset"))
