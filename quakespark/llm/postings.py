"""Words of texts, and their posting lists in shards of documents: what the phrase index and the ranked search are made of.

A shard holds whole documents, up to a bounded number of words, and has one
row for each of its words. So an index is written where the texts are read,
without a shuffle, and a search shuffles no more than its own words' lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakespark.llm.common import bound_batches, frees, join_small, settle

#: A shard is closed when it has so many words or documents; a longer document is a shard alone.
SHARD_WORDS, SHARD_DOCS = 1 << 21, 1 << 15
#: Rows of an index that go to Spark at a time.
_ROWS = 1 << 14

_WORD = np.zeros(256, dtype=bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_UPPER_CASE, _LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order: runs of digits, ASCII letters (in lower case) and characters beyond ASCII; null has none."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER_CASE, _LOWER_CASE)
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def batch_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (as ``words``) of all texts of a column, one after another, and how many each text has."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, places, data = texts.buffers()
    at = np.frombuffer(places, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    at = at - at[0]
    if not len(raw):
        return pa.array([], pa.string()), np.zeros(len(texts), dtype=np.int64)
    inside = _WORD[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first, last = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    opens[first] = inside[first]  # a text's end also ends a word
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])])
    return found, np.diff(np.searchsorted(starts, at))


def pack(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of non-negative numbers, one behind the other and ending at ``ends``, as bytes: seven bits of a number in each, the top bit where more follow."""
    width = np.ones(len(values), dtype=np.int64)
    for bits in (7, 14, 21, 28):
        width += values >= 1 << bits
    stops = np.cumsum(width)
    out, at, rest = np.zeros(int(stops[-1]) if len(stops) else 0, dtype=np.uint8), stops - width, values.astype(np.int64)
    for k in range(5):
        own = np.flatnonzero(width > k)
        if not len(own):
            break
        out[at[own] + k] = (rest[own] & 127) | np.where(width[own] > k + 1, 128, 0)
        rest[own] >>= 7
    offsets = np.zeros(len(ends) + 1, dtype=np.int32)
    offsets[1:] = stops[ends - 1] if len(ends) else 0
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpack(raw: np.ndarray) -> np.ndarray:
    """The numbers of one list of ``pack``."""
    ends = np.flatnonzero(raw < 128)
    if len(ends) == len(raw):
        return raw.astype(np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


def steps(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each number of ascending lists less the one before it; the first stays."""
    out = values.copy()
    out[1:] -= values[:-1]
    first = np.concatenate(([0], ends[:-1]))
    out[first] = values[first]
    return out


#: lists(codes, documents): the number of rows of each word and its columns of bytes, for words' codes and documents in order of the texts.
Lists = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list[pa.Array]]]


def positions(codes: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """For each word the places in the shard's texts, one behind the other."""
    order = np.sort(codes.astype(np.int64) << 32 | np.arange(len(codes))) & 0xFFFFFFFF
    counts = np.bincount(codes)
    ends = np.cumsum(counts)
    return counts, [pack(steps(order, ends), ends)]


def frequencies(codes: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """For each word its documents in ascending order, and how often it occurs in each."""
    keys = np.sort(codes.astype(np.int64) << 32 | documents)
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    times = np.diff(np.concatenate((heads, [len(keys)])))
    keys = keys[heads]
    counts = np.bincount(keys >> 32)
    ends = np.cumsum(counts)
    return counts, [pack(steps(keys & 0xFFFFFFFF, ends), ends), pack(times, ends)]


def write_shards(docs: DataFrame, id_col: str, text_col: str, lists: Lists, bodies: list[str], shard_words: int = SHARD_WORDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of ``docs``: (shard, word, n, *bodies, ids, sizes), settled.

    A shard's documents stand in the order of their identifiers, null last. Its
    row without a word has their identifiers and numbers of words; it has one
    row more for each word, with the lists of it.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    names = ["shard", "word", "n", *bodies, "ids", "sizes"]

    def shard_rows(shard: int, ids: list[pa.Array], texts: list[pa.Array], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every, sizes = pa.concat_arrays(ids), np.concatenate(counts)
        order = pc.sort_indices(every, null_placement="at_end").to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        coded = pa.concat_arrays(texts).dictionary_encode()
        codes, documents = coded.indices.to_numpy(), np.repeat(place, sizes)
        moved = np.argsort(documents, kind="stable")
        codes, documents = codes[moved], documents[moved]
        held = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), every.take(pa.array(order)))
        lengths = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), pa.array(sizes[order], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.string()), pa.array([len(codes)], pa.int64()), *[pa.array([None], pa.binary())] * len(bodies), held, lengths], names=names)
        if len(codes):
            n, columns = lists(codes, documents)
            size, distinct = len(n), coded.dictionary
            whole = pa.RecordBatch.from_arrays([pa.array(np.full(size, shard)), distinct, pa.array(n, pa.int64()), *columns, pa.nulls(size, held.type), pa.nulls(size, lengths.type)], names=names)
            for at in range(0, size, _ROWS):
                yield whole.slice(at, _ROWS)

    @frees
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, ids, texts, counts, total, n = TaskContext.get().partitionId() << 24, [], [], [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            found, sizes = batch_words(batch.column("text"))
            # a batch is cut where a shard is full, so that a shard's size does not hang on the batches
            ends, lo, word = np.cumsum(sizes), 0, 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(ends, word + shard_words - total, side="right"))
                hi = min(max(hi, lo + (not n)), lo + shard_docs - n, batch.num_rows)
                if hi > lo:
                    end = int(ends[hi - 1])
                    ids.append(batch.column("id").slice(lo, hi - lo))
                    texts.append(found.slice(word, end - word))
                    counts.append(sizes[lo:hi])
                    total, n, lo, word = total + end - word, n + hi - lo, hi, end
                if lo < batch.num_rows:
                    yield from shard_rows(shard, ids, texts, counts)
                    shard, ids, texts, counts, total, n = shard + 1, [], [], [], 0, 0
        if ids:
            yield from shard_rows(shard, ids, texts, counts)

    kind = rows.schema["id"].dataType.simpleString()
    columns = ", ".join(f"{b} binary" for b in bodies)
    return settle(rows.mapInArrow(make, f"shard long, word string, n long, {columns}, ids array<{kind}>, sizes array<int>"), "index", "zstd")


def documents(index: DataFrame) -> DataFrame:
    """(shard, doc, id, n_words) of every document of an index; doc is its place in the shard."""
    both = F.arrays_zip(F.col("ids").alias("id"), F.col("sizes").alias("size"))
    return index.where("word IS NULL").select("shard", F.posexplode(both).alias("doc", "d")).select("shard", "doc", F.col("d.id").alias("id"), F.col("d.size").cast("long").alias("n_words"))


def lists_of(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every shard's first row, and its rows of the words of ``wanted`` (word)."""
    own = join_small(index.where("word IS NOT NULL"), wanted.select("word").distinct(), ["word"], "left_semi").select(index.columns)
    return index.where("word IS NULL").unionByName(own)


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of one shard after another, from batches sorted by shard."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        own = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                if held and held[0].column("shard")[0].as_py() != own[a]:
                    yield held
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield held


def search_shards(index: DataFrame, wanted: DataFrame, search: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``search`` over the lists of the wanted words, a shard's rows together and in one task."""
    dealt = lists_of(index, wanted).repartition("shard").sortWithinPartitions("shard", F.col("word").isNotNull())
    return dealt.mapInArrow(frees(search), schema)
