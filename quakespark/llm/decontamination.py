"""Benchmark decontamination by a distributed positional inverted index.

The training texts' words are stored as posting lists of places, in shards of
documents (``postings``). A test phrase is looked up shard by shard: of its
words, the lists are taken from the rarest on; the places of each, less the
word's offset in the phrase, are intersected with what is left. What stays
after the last list is where the phrase stands. For proximity, every other word
must have a place near one of the rarest word.

Test phrases go to the tasks in blocks of a bounded size, so a test set of any
size is searched, a block after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakespark.llm.common import join_small, settle
from quakespark.llm.postings import by_shard, documents, positions, search_shards, unpack, words, write_shards
from quakespark.llm.shingles import slices

#: Phrases of a block: with ten words each, some MB that each task holds.
BLOCK = 50_000


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """The positional index of all words of all texts: a table in the shared folder (see ``write_shards``)."""
    return write_shards(docs, id_col, text_col, positions, ["places"], **sizes)


def phrases_of(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, phrase, words): every run of ``size`` words of an item; of fewer words, all of them; without words, none.

    Equal runs have one number (phrase), wherever they stand. A table in the
    shared folder, so that the numbers stay.
    """
    own = items.select(F.col(f"`{id_col}`").alias("item"), words(F.col(f"`{text_col}`")).alias("all")).where(F.size("all") > 0)
    run = F.transform(F.sequence(F.lit(0), F.greatest(F.size("all") - size, F.lit(0))), lambda i: F.slice("all", i + 1, size))
    runs = own.select("item", F.explode(run).alias("words")).distinct()
    numbered = settle(runs.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    return settle(runs.join(numbered, "words").select("item", "phrase", "words"), "items")


class Shard:
    """The lists of a shard's words that a block of phrases has."""

    def __init__(self, rows: list[pa.RecordBatch], number: dict[str, int]):
        sizes = next(b.column("sizes")[i] for b in rows for i in range(b.num_rows) if b.column("word")[i].as_py() is None).values.to_numpy()
        self.ends = np.cumsum(sizes)
        self.starts, self.n = self.ends - sizes, int(self.ends[-1])
        self.raw: list[np.ndarray | None] = [None] * len(number)
        self.counts = np.zeros(len(number), dtype=np.int64)
        self.lists: dict[int, np.ndarray] = {}
        for batch in rows:
            for word, n, body in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), slices(batch.column("places")), strict=True):
                if word in number:
                    self.raw[number[word]], self.counts[number[word]] = body, n

    def places(self, word: int) -> np.ndarray:
        found = self.lists.get(word)
        if found is None:
            found = self.lists[word] = np.cumsum(unpack(self.raw[word]))
        return found

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def phrase(self, ids: np.ndarray) -> np.ndarray:
        """The first places of a phrase, all in one document."""
        order = np.argsort(self.counts[ids], kind="stable").tolist()
        left = self.places(ids[order[0]]) - order[0]
        for k in order[1:]:
            if not len(left):
                return left
            other, at = self.places(ids[k]), left + k
            found = np.searchsorted(other, at)
            left = left[other[np.minimum(found, len(other) - 1)] == at]
        left = left[left >= 0]
        return left[self.document(left) == self.document(left + len(ids) - 1)] if len(left) else left

    def near(self, ids: np.ndarray, reach: int) -> np.ndarray:
        """The places of the phrase's rarest word with every other word of it at most ``reach`` words away, in the document."""
        distinct = sorted(set(ids.tolist()), key=lambda w: self.counts[w])
        left = self.places(distinct[0])
        for w in distinct[1:]:
            if not len(left):
                return left
            own = self.document(left)
            low, high = np.maximum(left - reach, self.starts[own]), np.minimum(left + reach, self.ends[own] - 1)
            other = self.places(w)
            left = left[np.searchsorted(other, high, side="right") > np.searchsorted(other, low)]
        return left


def _blocks(phrases: DataFrame, block: int) -> Iterator[DataFrame]:
    """``phrases`` (phrase, words) in parts of about ``block``."""
    distinct = phrases.select("phrase", "words").distinct()
    n = -(-distinct.count() // block)
    for i in range(n):
        yield distinct.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == i)


def _search(index: DataFrame, phrases: DataFrame, block: int, schema: str, emit) -> DataFrame | None:
    """``emit(shard number, Shard, ids of the block's phrases, their words as numbers)`` over every shard, for each block; None without phrases."""
    found, spark = None, index.sparkSession
    for part in _blocks(phrases, block):
        rows = part.collect()  # a block
        number: dict[str, int] = {}
        coded = [np.array([number.setdefault(w, len(number)) for w in r["words"]]) for r in rows]
        shared = spark.sparkContext.broadcast((number, [r["phrase"] for r in rows], coded))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            number, names, coded = shared.value
            every, heads = np.concatenate(coded), np.cumsum([0, *(len(c) for c in coded[:-1])])
            for rows in by_shard(batches):
                shard = Shard(rows, number)
                whole = np.minimum.reduceat(shard.counts[every], heads) > 0  # all words occur in the shard
                yield from emit(rows[0].column("shard")[0].as_py(), shard, [(names[i], coded[i]) for i in np.flatnonzero(whole).tolist()])

        own = settle(search_shards(index, part.select(F.explode("words").alias("word")), search, schema), "matches")
        found = own if found is None else found.unionByName(own)
    return found


def matches(index: DataFrame, phrases: DataFrame, reach: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id, phrase, place): where a document's words are a phrase; with ``reach`` where they are near each other.

    Places count words from 0. A place with ``reach`` is one of the phrase's
    rarest word (in the shard; of equally rare ones any) that has every other
    word of the phrase, in any order, at most ``reach`` words away. Phrases and
    documents may repeat; null and empty texts match nothing.
    """

    def emit(number: int, shard: Shard, phrases: list) -> Iterator[pa.RecordBatch]:
        names, documents_, places = [], [], []
        for name, ids in phrases:
            found = shard.phrase(ids) if reach is None else shard.near(ids, reach)
            if len(found):
                own = shard.document(found)
                names.append(np.full(len(found), name))
                documents_.append(own)
                places.append(found - shard.starts[own])
        if names:
            total = sum(map(len, names))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total, number)), pa.array(np.concatenate(documents_).astype(np.int32)), pa.array(np.concatenate(names)), pa.array(np.concatenate(places).astype(np.int64))], names=["shard", "doc", "phrase", "place"])

    schema = "shard long, doc int, phrase long, place long"
    found = _search(index, phrases, block, schema, emit)
    found = index.sparkSession.createDataFrame([], schema) if found is None else found
    return found.join(documents(index), ["shard", "doc"]).select("id", "phrase", "place")


def covered(index: DataFrame, phrases: DataFrame, block: int = BLOCK) -> DataFrame:
    """(shard, doc, start, stop, phrase): what a document has of the phrases, settled.

    Rows without a phrase are runs of words that lie in occurrences, stop
    exclusive; the others say that the phrase occurs. Occurrences are merged in
    the shard, so a passage is one row, however many phrases it has.
    """

    def emit(number: int, shard: Shard, phrases: list) -> Iterator[pa.RecordBatch]:
        change = np.zeros(shard.n + 1, dtype=np.int32)
        names, documents_ = [], []
        for name, ids in phrases:
            found = shard.phrase(ids)
            if len(found):
                np.add.at(change, found, 1)
                np.add.at(change, found + len(ids), -1)
                own = np.unique(shard.document(found))
                names.append(np.full(len(own), name))
                documents_.append(own)
        if names:
            inside = np.cumsum(change[:-1]) > 0
            edge = np.zeros(shard.n + 1, dtype=bool)
            edge[shard.starts] = True
            edge[-1] = True
            opens = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
            closes = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
            own = shard.document(opens)
            parts, n, m = np.concatenate(documents_), len(opens), sum(map(len, names))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n + m, number)), pa.array(np.concatenate((own, parts)).astype(np.int32)),
                pa.concat_arrays([pa.array(opens - shard.starts[own]), pa.nulls(m, pa.int64())]), pa.concat_arrays([pa.array(closes - shard.starts[own]), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.concatenate(names))]),
            ], names=["shard", "doc", "start", "stop", "phrase"])

    schema = "shard long, doc int, start long, stop long, phrase long"
    found = _search(index, phrases, block, schema, emit)
    return index.sparkSession.createDataFrame([], schema) if found is None else found


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK, **sizes) -> DataFrame:
    """One row for each row of ``docs``: identifier, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of ``size`` consecutive words of
    an item (of a shorter item, of all its words). n_items counts the items
    with an occurrence, items_sha256 is over their identifiers as strings,
    sorted and joined by commas. Null and empty texts have no words and no
    hits, and null and empty items no phrases. Repeated rows, also of one
    identifier, are rows of their own; items that repeat an identifier are one
    item. Empty tables and extra columns do no harm.
    """
    index = build_index(docs, id_col, text_col, **sizes)
    phrases = phrases_of(items, size, item_col, item_text_col)
    found = covered(index, phrases, block)
    before = F.max("stop").over(Window.partitionBy("shard", "doc").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))  # blocks of phrases may overlap
    new = F.greatest(F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0))
    hits = found.where("phrase IS NULL").withColumn("new", new).groupBy("shard", "doc").agg(F.sum("new").alias("n_hit"))
    pairs = found.where("phrase IS NOT NULL").select("shard", "doc", "phrase").join(phrases.select("phrase", F.col("item").cast("string").alias("item")), "phrase").where("item IS NOT NULL").select("shard", "doc", "item").distinct()
    named = pairs.groupBy("shard", "doc").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    marks = settle(hits.join(named, ["shard", "doc"], "left"), "marks")
    nothing = F.lit(0).cast("long")
    out = join_small(documents(index), marks, ["shard", "doc"], "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", nothing).alias("n_hit"), F.coalesce("n_items", nothing).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.coalesce("n_hit", nothing) > 0).alias("contaminated"),
    )

