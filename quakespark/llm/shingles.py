"""Word and shingle hashes straight from a text's UTF-8 bytes, and bounded tables that Spark tasks merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakespark.llm.common import frees

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
#: Texts are hashed in blocks of about so many bytes.
_BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit of x moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_BASE = _STEP | 1
_POWERS, _INVERSES = _powers(_BASE, _BLOCK), _powers(pow(_BASE, -1, 1 << 64), _BLOCK)


def _block_hashes(raw: np.ndarray) -> np.ndarray:
    space = np.ones(len(raw) + 2, dtype=np.int8)
    space[1:-1] = _SPACES[raw]
    edge = np.diff(space)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[raw] * _POWERS[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _INVERSES[starts] + (ends - starts).astype(np.uint64))


def _long_word(raw: np.ndarray) -> np.ndarray:
    """The hash of one word of any length, block by block."""
    total, scale, step = 0, 1, pow(_BASE, _BLOCK, 1 << 64)
    for at in range(0, len(raw), _BLOCK):
        part = raw[at : at + _BLOCK]
        total += int((_VALUES[part] * _POWERS[: len(part)]).sum(dtype=np.uint64)) * scale
        scale = scale * step % (1 << 64)
    return mix(np.array([(total + len(raw)) % (1 << 64)], dtype=np.uint64))


def _next_space(raw: np.ndarray, at: int) -> int:
    while at < len(raw):
        gaps = np.flatnonzero(_SPACES[raw[at : at + _BLOCK]])
        if len(gaps):
            return at + int(gaps[0])
        at += _BLOCK
    return len(raw)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case, of UTF-8 bytes.

    A word's hash is a polynomial over its bytes, taken for all words at once
    from running sums. Long texts go block by block, cut at white space; a
    word longer than a block is summed over its blocks.
    """
    if len(raw) <= _BLOCK:
        return _block_hashes(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + _BLOCK, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(_SPACES[raw[at:end]])
            if not len(gaps):
                end = _next_space(raw, end)
                parts.append(_long_word(raw[at:end]))
                at = end
                continue
            end = at + int(gaps[-1]) + 1
        parts.append(_block_hashes(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of n-word shingles; of fewer words, that of the whole sequence."""
    if not len(words):
        return words
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(_STEP) + words[k : len(words) - size + 1 + k])
    return np.unique(out)


def slices(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each value of a string or binary column; none for null."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    at = np.frombuffer(places, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]]


_SEGMENT = 1 << 16
#: Partial tables are merged so many at a time.
_FAN = 16


def merged_table(rows: DataFrame, fill, size: int, dtype: str, join) -> np.ndarray:
    """A table of ``size`` numbers that every partition of ``rows`` fills and Spark merges.

    ``fill(table, batch)`` adds an Arrow batch to a partition's own table;
    ``join`` (np.add, np.bitwise_or) merges two. Partial tables travel as
    segments and merge _FAN at a time, so a task holds a segment and a few
    more, and the driver gets ``size`` numbers whatever the input.
    """
    step = max(1, min(_SEGMENT, size))

    @frees
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, number = np.zeros(size, dtype=dtype), TaskContext.get().partitionId()
        for batch in batches:
            fill(table, batch)
        for at in range(0, size, step):
            if table[at : at + step].any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([at], pa.int64()), "part": pa.array([number], pa.int64()), "body": pa.array([table[at : at + step].tobytes()], pa.binary())})

    def merge(key, group):
        total = np.zeros(step, dtype=dtype)
        for batch in group:
            for own in slices(batch.column("body")):
                own = np.frombuffer(own.tobytes(), dtype=dtype)
                total[: len(own)] = join(total[: len(own)], own)
        yield pa.RecordBatch.from_pydict({"segment": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "body": pa.array([total.tobytes()], pa.binary())})

    def merge_all(key, table):
        return pa.Table.from_batches(merge(key, table.to_batches()))

    schema = "segment long, part long, body binary"
    parts, left = rows.mapInArrow(part, schema), rows.rdd.getNumPartitions()
    while left > 1:
        parts, left = parts.withColumn("part", F.floor(F.col("part") / _FAN)).groupBy("segment", "part").applyInArrow(merge_all, schema), -(-left // _FAN)
    out = np.zeros(size, dtype=dtype)
    for r in parts.collect():
        own = np.frombuffer(bytes(r["body"]), dtype=dtype)[: size - r["segment"]]
        out[r["segment"] : r["segment"] + step] = own
    return out
