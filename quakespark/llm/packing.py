"""Best-fit packing planned over a histogram of lengths.

Documents are cut into pieces of at most CAPACITY tokens. The plan never sees
a document: it runs best-fit decreasing over the counts of each length (at
most CAPACITY numbers) and yields slots, each a range of ranks within a
length, the sequences they go to, one after another, and their offset. The
pieces then take their slots by joining on the rank within their length.
Ranks come from counts by (length, shard), with more shards for a frequent
length, so that one with a third of all pieces is ranked by many tasks. A
piece of CAPACITY tokens is a sequence by itself and needs no rank.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakespark.llm.common import bound_batches, frees, join_small, settle
from quakespark.llm.tokens import encoder, tokenizer_path

CAPACITY = 4096
END_ID = 1
#: A shard of a length has about a 4096th of the pieces, within these bounds: some thousand shards in all, and one more for each further 131,072 pieces.
SHARD_PIECES, PARTS = (256, 1 << 17), 4096

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
SLOTS = "length long, low long, high long, sequence long, offset long"


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, CRC-32 of the ids) for each piece of a document."""
    for piece, start in enumerate(range(0, len(ids), capacity)):
        part = ids[start : start + capacity]
        yield piece, start, len(part), zlib.crc32(part.tobytes())


def _pieces(path: str, capacity: int, end_id: int):
    @frees
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path), np.array([end_id], dtype="<u4")
        for batch in batches:
            rows = []
            for doc_id, row, text in zip(batch.doc_id, batch.row, batch.text, strict=True):
                rows += [(doc_id, row, *p) for p in cut(np.concatenate([encode(text), end]), capacity)]
            yield pd.DataFrame(rows, columns=["doc_id", "row", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return run


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, low, high, sequence, offset).

    The pieces of a length with ranks low..high-1 go to the sequences
    sequence, sequence+1, ... at the offset. Sequences alike are held together
    as ranges by what room they have left, so the work depends on the number
    of lengths and ranges, not on that of pieces.
    """
    rooms: dict[int, list[list[int]]] = {}
    order: list[int] = []
    slots: list[tuple[int, int, int, int, int]] = []
    made = 0

    def leave(room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append([first, count])

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, count = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, first = capacity, made
                count = -(-left // (capacity // length))
                made += count
            each = room // length
            full = min(count, left // each)
            for k in range(each if full else 0):
                slots.append((length, rank, rank + full, first, capacity - room + k * length))
                rank += full
            left -= full * each
            leave(room - each * length, first, full)
            first, count = first + full, count - full
            if count:
                some = min(left, each - 1) if left < each else 0
                for k in range(some):
                    slots.append((length, rank, rank + 1, first, capacity - room + k * length))
                    rank += 1
                left -= some
                if some:
                    leave(room - some * length, first, 1)
                    first, count = first + 1, count - 1
                leave(room, first, count)
    return slots


def _take(slots: list[tuple[int, int, int, int, int]]):
    by: dict[int, list[tuple[int, int, int]]] = {}
    for length, low, _, sequence, offset in slots:
        by.setdefault(length, []).append((low, sequence, offset))
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(v), strict=True)) for k, v in by.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text is the end id alone. Every row is a document of its
    own, repeated identifiers too; a null identifier stays null. Extra columns
    are ignored. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = settle(source.mapInPandas(_pieces(tokenizer or tokenizer_path(), capacity, end_id), PIECES), "pieces")
    shown = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*shown, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = pieces.where(F.col("length") < capacity)
    lengths = settle(part.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in lengths.collect()}  # fewer than `capacity` rows
    low, high = SHARD_PIECES
    size = min(high, max(low, sum(histogram.values()) // PARTS))
    shards = lengths.select("length", F.ceil(F.col("n") / size).alias("shards"))  # fewer than `capacity` rows
    part = part.join(F.broadcast(shards), "length").withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.col("shards"))).drop("shards")
    counts = part.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = settle(counts.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    slots = plan(histogram, capacity)
    within = F.row_number().over(Window.partitionBy("length", "shard").orderBy("row", "piece"))
    ranked = join_small(part.withColumn("within", within), bases, ["length", "shard"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("within") - 1).alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(_take(slots))  # bounded by the lengths: some 100,000 rows at most

    @frees
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for length in np.unique(lengths):
                low, first, off = shared.value[int(length)]
                rows = np.flatnonzero(lengths == length)
                at = np.searchsorted(low, ranks[rows], "right") - 1
                sequence[rows], offset[rows] = first[at] + ranks[rows] - low[at], off[at]
            yield batch.drop(columns="rank").assign(doc_id=batch.doc_id.astype("Int64"), sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").unionByName(full)
