"""Ranked lexical search, document at a time.

Texts are indexed in shards (``postings``): for each word its documents in the
order of their identifiers and how often they have it, compressed. A query is
answered shard by shard. Its lists' cursors wait in a heap, keyed by their next
document; the heap's head opens the next span of documents, the cursors that
stand in it move through it together, so that the span's documents get their
whole score at once, and come in ascending order. They pass through a bounded
heap keyed by score, then identifier. The shards' heaps are merged over all.

Queries go to the tasks in blocks of a bounded size, one block after the other.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakespark.llm.common import settle
from quakespark.llm.postings import by_shard, frequencies, search_shards, unpack, words, write_shards
from quakespark.llm.shingles import slices

#: Words of a block's queries: some MB that each task holds.
BLOCK_WORDS = 500_000
#: Documents that the cursors move through together.
SPAN = 4096


@dataclass(frozen=True)
class Formula:
    """Whole-number BM25: the weight of a word times scale * tf div (1000 * tf + k * m), m for the document's length.

    m is 100 - b + (b * n * N) div L; the weight is floor(1000 * ln((2 N + 2) / (2 df + 1))).
    """

    b: int = 75
    k: int = 8
    scale: int = 1_000_000_000

    def length(self, n: np.ndarray, documents: int, total: int) -> np.ndarray:
        if self.b * int(n.max(initial=0)) * documents < 1 << 63:
            return 100 - self.b + self.b * n.astype(np.int64) * documents // max(total, 1)
        return np.array([100 - self.b + self.b * int(x) * documents // max(total, 1) for x in n], dtype=np.int64)  # beyond 64 bits on the way

    def part(self, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.scale * times // (1000 * times + self.k * length)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """The frequency index of all words of all texts: a table in the shared folder (see ``write_shards``)."""
    return write_shards(docs, id_col, text_col, frequencies, ["documents", "times"], **sizes)


class Best:
    """The k greatest (score, earliest document), of documents that come in ascending order."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def offer(self, first: int, scores: np.ndarray) -> None:
        """The scores of the documents from ``first`` on; 0 for none."""
        least = self.heap[0][0] if len(self.heap) == self.k else 0
        better = np.flatnonzero(scores > least)  # an equal score of a later document is no better
        if len(better) > self.k:
            better = better[np.argsort(-scores[better], kind="stable")[: self.k]]
        for i in better.tolist():
            entry = int(scores[i]), -(first + i)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            else:
                heapq.heappushpop(self.heap, entry)


def merge(lists: list[tuple[np.ndarray, np.ndarray, int]], k: int, span: int = SPAN) -> list[tuple[int, int]]:
    """The k best (score, -document) of lists of (ascending documents, their parts of the score, a factor)."""
    best, at = Best(k), [0] * len(lists)
    cursors = [(int(documents[0]), i) for i, (documents, _, _) in enumerate(lists)]
    heapq.heapify(cursors)
    while cursors:
        first = cursors[0][0] // span * span
        scores = np.zeros(span, dtype=np.int64)
        while cursors and cursors[0][0] < first + span:
            _, i = cursors[0]
            documents, parts, factor = lists[i]
            stop = at[i] + int(np.searchsorted(documents[at[i] : at[i] + span], first + span))
            scores[documents[at[i] : stop] - first] += factor * parts[at[i] : stop]
            at[i] = stop
            if stop < len(documents):
                heapq.heapreplace(cursors, (int(documents[stop]), i))
            else:
                heapq.heappop(cursors)
        best.offer(first, scores)
    return best.heap


def _queries(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, item, words) of every row with a word, settled; query is a number of its own."""
    own = items.select(F.col(f"`{id_col}`").alias("item"), words(F.col(f"`{text_col}`")).alias("words")).where(F.size("words") > 0)
    return settle(own.withColumn("query", F.monotonically_increasing_id()), "queries")


def search(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", item_text_col: str = "text", id_name: str = "doc_id", formula: Formula = Formula(), block_words: int = BLOCK_WORDS) -> DataFrame:  # noqa: B008
    """(item, rank, identifier, score): each item's k documents of the highest score above 0; equal scores by ascending identifier, null last.

    An item's words count as often as they occur in it. Items without words
    have no rows; a row that repeats an item is an item of its own. Documents
    that repeat an identifier are documents of their own, and so have a rank
    each. Empty tables give an empty result.
    """
    spark = index.sparkSession
    heads = index.where("word IS NULL")
    sized = heads.select(F.size(F.filter("sizes", lambda s: s > 0)).cast("long").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s).alias("l"))
    whole = sized.agg(F.sum("n"), F.sum("l")).first()
    n, total = int(whole[0] or 0), int(whole[1] or 0)
    queries = _queries(items, item_col, item_text_col)
    blocks = -(-(queries.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words)
    kind = dict(index.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    schema = f"query long, id {kind}, score long"
    found = spark.createDataFrame([], schema)
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i)
        wanted = settle(part.select(F.explode("words").alias("word")).distinct(), "words")
        held = index.where("word IS NOT NULL").join(F.broadcast(wanted), "word").groupBy("word").agg(F.sum("n").alias("df"))  # a block's words
        weighed = held.select("word", F.floor(1000 * F.log((F.lit(2.0) * n + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")).where("w > 0")
        weights = {r["word"]: r["w"] for r in weighed.collect()}
        asked = [(r["query"], Counter(w for w in r["words"] if w in weights)) for r in part.collect()]
        shared = spark.sparkContext.broadcast((weights, asked))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weights, asked = shared.value
            for rows in by_shard(batches):
                ids, lists = _lists(rows, weights, formula, n, total)
                names, places, scores = [], [], []
                for query, wanted in asked:
                    own = [(*lists[w], times) for w, times in wanted.items() if w in lists]
                    for score, document in merge(own, k):
                        names.append(query)
                        places.append(-document)
                        scores.append(score)
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), ids.take(pa.array(places)), pa.array(scores, pa.int64())], names=["query", "id", "score"])

        found = found.unionByName(settle(search_shards(index, wanted, run, schema), "best"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # Spark limits the groups ahead of the shuffle too
    return ranked.join(queries.select("query", "item"), "query").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_name), "score")


def _lists(rows: list[pa.RecordBatch], weights: dict[str, int], formula: Formula, n: int, total: int) -> tuple[pa.Array, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """A shard's identifiers, and by word its documents with the word's part of their scores."""
    head = next((b, i) for b in rows for i in range(b.num_rows) if b.column("word")[i].as_py() is None)
    ids, sizes = (head[0].column(c)[head[1]].values for c in ("ids", "sizes"))
    lengths, lists = formula.length(sizes.to_numpy(), n, total), {}
    for batch in rows:
        for word, documents, times in zip(batch.column("word").to_pylist(), slices(batch.column("documents")), slices(batch.column("times")), strict=True):
            if word in weights:
                own = np.cumsum(unpack(documents))
                parts = weights[word] * formula.part(unpack(times), lengths[own])
                lists[word] = own, parts
    return ids, lists


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **sizes) -> DataFrame:
    """``search`` in an index made of ``docs``: item_id, rank, doc_id, score."""
    found = search(build_index(docs, id_col, text_col, **sizes), items, k, item_col, item_text_col, id_col)
    return found.withColumn("rank", F.col("rank").cast("int"))
