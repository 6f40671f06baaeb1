"""Hard negatives by vantage-point trees over norm-augmented vectors.

Scores are inner products of whole-number vectors. A vector x gets one more
component sqrt(M^2 - |x|^2), M the greatest norm, and a query 0; then
|x - q|^2 = M^2 + |q|^2 - 2 x.q, so a higher score is a smaller distance, and a
window of scores an annulus about the query.

Rows are dealt to cells by the upper part of a tree, fitted on a bounded sample;
cells of too many rows are split, so a shard's rows are bounded, whatever
repeats. Each shard has a tree of its own, with distances of all its rows. A
search walks every shard's tree nearest first: a queue holds nodes by the
highest score they can hold, and rows by their score. Nodes outside the annulus
are left out, and rows leave the queue in the order asked for, until there are
enough. Distances only bound; scores are exact whole numbers. The shards' rows
are merged over all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakespark.llm.common import bound_batches, frees, settle
from quakespark.llm.shingles import slices

#: Rows of a shard, about, and bytes of its vectors at most, about.
SHARD_ROWS, SHARD_BYTES = 4096, 8 << 20
#: Rows that the cells are fitted on, and cells, at most.
SAMPLE, CELLS = 4096, 256
LEAF = 128
#: Anchors of a block, and bytes of its vectors.
BLOCK, BLOCK_BYTES = 8192, 8 << 20
#: Rounding of a distance, as a part of M.
SLACK = 1e-6


def quantized(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part; v has floor(scale * x) for each component x."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & x.isNotNull() & ~bad
    return vectors.where(good).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; missing components are 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), dtype=np.int64)
    for i, (a, n) in enumerate(zip(np.cumsum(sizes) - sizes, sizes, strict=True)):
        out[i, :n] = flat[a : a + n]
    return out


def exact_kind(rows: np.ndarray, q: np.ndarray) -> type:
    """Floats where they hold every inner product of these whole numbers exactly, else 64-bit integers."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(rows.shape[1], 1)
    return np.float64 if most < 2**53 else np.int64


def augmented(rows: np.ndarray, m2: float) -> np.ndarray:
    x = rows.astype(np.float64)
    return np.column_stack((x, np.sqrt(np.maximum(m2 - (x * x).sum(axis=1), 0))))


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = rows - point
    return np.sqrt((d * d).sum(axis=1))


def vantage(rows: np.ndarray) -> int:
    """The row farthest from the first."""
    return int(np.argmax(distances(rows, rows[0])))


def upper_tree(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, float]]:
    """Vantage points and radii of 2^depth - 1 nodes, level by level; a node's nearer half goes left."""
    parts, out = [np.arange(len(sample))], []
    for _ in range(depth):
        below = []
        for part in parts:
            if not len(part):
                out.append((np.zeros(sample.shape[1]), 0.0))
                below += [part, part]
                continue
            point = sample[part[vantage(sample[part])]]
            d = distances(sample[part], point)
            radius = float(np.median(d))
            out.append((point, radius))
            below += [part[d <= radius], part[d > radius]]
        parts = below
    return out


def cells_of(rows: np.ndarray, tree: list[tuple[np.ndarray, float]], depth: int) -> np.ndarray:
    node = np.zeros(len(rows), dtype=np.int64)
    if not depth:
        return node
    points, radii = np.stack([p for p, _ in tree]), np.array([r for _, r in tree])
    for _ in range(depth):
        d = np.sqrt(((rows - points[node]) ** 2).sum(axis=1))
        node = 2 * node + 1 + (d > radii[node])
    return node - len(tree)


class Tree:
    """A shard's rows in the order of its leaves. Node (a, b) holds rows a to b; its halves are nodes, or leaves of LEAF rows at most.

    Of the inner nodes, in the order parent, first half, second half: ``points``
    has the row that is the vantage point, ``bounds`` the least and greatest
    distance from it of the rows of either half.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, bounds: np.ndarray, m2: float):
        self.vectors, self.ids, self.labels, self.points, self.bounds, self.m2 = vectors, ids, labels, points, bounds.tolist(), m2

    @staticmethod
    def grown(vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, m2: float) -> Tree:
        rows = augmented(vectors, m2)
        order, points, bounds = np.arange(len(rows)), [], []

        def grow(a: int, b: int) -> None:
            if b - a <= LEAF:
                return
            own = rows[order[a:b]]
            point = order[a + vantage(own)]
            d = distances(own, rows[point])
            by, half = np.argsort(d, kind="stable"), (b - a) // 2
            order[a:b], d = order[a:b][by], d[by]
            points.append(point)
            bounds.append((d[0], d[half - 1], d[half], d[-1]))
            grow(a, a + half)
            grow(a + half, b)

        grow(0, len(rows))
        place = np.empty(len(rows), dtype=np.int64)
        place[order] = np.arange(len(rows))
        return Tree(vectors[order], ids[order], labels[order], place[np.array(points, dtype=np.int64)], np.array(bounds).reshape(-1, 4), m2)

    def nodes(self) -> dict[tuple[int, int], int]:
        """The place of each inner node (a, b) in ``points``."""
        out: dict[tuple[int, int], int] = {}
        stack = [(0, len(self.ids))]
        while stack:
            a, b = stack.pop()
            if b - a > LEAF:
                out[a, b] = len(out)
                stack += [(a + (b - a) // 2, b), (a, a + (b - a) // 2)]
        return out


class Walk:
    """Searches of one query for the rows that ``takes`` marks; leaves that one window has opened serve the next."""

    def __init__(self, tree: Tree, nodes: dict[tuple[int, int], int], rows: np.ndarray, q: np.ndarray, takes: np.ndarray):
        """``rows`` and ``q``: the tree's vectors and the query, as numbers in which their inner products are exact."""
        self.tree, self.nodes, self.rows, self.q, self.takes = tree, nodes, rows, q, takes
        self.q2, self.slack = float((q.astype(np.float64) ** 2).sum()), SLACK * max(tree.m2, 1.0) ** 0.5
        self.far = np.sqrt(np.maximum(tree.m2 + self.q2 - 2.0 * (rows[tree.points] @ q), 0)).tolist()
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def score(self, distance: float) -> float:
        return (self.tree.m2 + self.q2 - distance * distance) / 2

    def leaf(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(-score, id) of the leaf's marked rows, in order."""
        found = self.leaves.get(a)
        if found is None:
            kept = np.flatnonzero(self.takes[a:b]) + a
            minus, ids = -(self.rows[kept] @ self.q), self.tree.ids[kept]
            order = np.lexsort((ids, minus))
            found = self.leaves[a] = minus[order].astype(np.int64), ids[order]
        return found

    def nearest(self, low: float = -np.inf, high: float = np.inf) -> Iterator[tuple[int, int]]:
        """(score, id) of the marked rows with low <= score <= high, highest score first, then smallest id."""
        queue: list[tuple] = [(-np.inf, 0, 0, len(self.tree.ids), 0.0, np.inf)]
        while queue:
            entry = heapq.heappop(queue)
            if entry[1]:  # a leaf's next row
                minus, _, own, leaf, at = entry
                yield -minus, own
                if at < len(leaf[0]) and leaf[0][at] <= -low:
                    heapq.heappush(queue, (int(leaf[0][at]), 1, int(leaf[1][at]), leaf, at + 1))
                continue
            _, _, a, b, near, far = entry
            if b - a <= LEAF:
                leaf = self.leaf(a, b)
                at = int(np.searchsorted(leaf[0], -high)) if high < np.inf else 0
                if at < len(leaf[0]) and leaf[0][at] <= -low:
                    heapq.heappush(queue, (int(leaf[0][at]), 1, int(leaf[1][at]), leaf, at + 1))
                continue
            place, half = self.nodes[a, b], a + (b - a) // 2
            d, (lo0, hi0, lo1, hi1) = self.far[place], self.tree.bounds[place]
            for x, y, lo, hi in ((a, half, lo0, hi0), (half, b, lo1, hi1)):
                least, most = max(near, d - hi - self.slack, lo - d - self.slack), min(far, d + hi + self.slack)
                best = self.score(least)
                if best >= low and self.score(most) <= high:  # the node reaches into the annulus
                    heapq.heappush(queue, (-best, 0, x, y, least, most))


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A tree for each shard of (id, label, v), settled: its vectors, ids, labels, vantage points and bounds as bytes."""
    spark = rows.sparkSession
    bound_batches(spark, 4096)
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    shape = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    n, dims, m2 = int(shape[0]), max(int(shape[1] or 0), 1), float(shape[2] or 0.0)
    per_shard = max(LEAF, min(shard_rows, SHARD_BYTES // (8 * dims)))
    depth = max(0, min(CELLS, -(-n // per_shard)).bit_length() - 1)
    sample = rows.select("v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE) if depth else rows.select("v").limit(0)
    fitted = np.zeros((0, dims), dtype=np.int64)
    if depth:
        fitted = np.array([r["v"] + [0] * (dims - len(r["v"])) for r in sample.collect()], dtype=np.int64)
    shared = spark.sparkContext.broadcast(upper_tree(augmented(fitted, m2), depth))

    @frees
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            own = _matrix(batch.column("v"), dims)
            cells = cells_of(augmented(own, m2), shared.value, depth)
            bodies = [x.tobytes() for x in np.ascontiguousarray(own, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.arange(at, at + len(own))), batch.column("id"), batch.column("label"), pa.array(bodies, pa.binary())], names=["cell", "row", "id", "label", "vector"])
            at += len(own)

    placed = settle(rows.mapInArrow(place, "cell long, row long, id long, label string, vector binary"), "placed", "zstd")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / per_shard).cast("long").alias("parts"))  # CELLS rows at most
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("shard", F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("row"), F.col("parts"))).drop("cell", "parts")

    @frees
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quakespark.llm.postings import by_shard

        for group in by_shard(batches):
            own = pa.Table.from_batches(group).combine_chunks()
            ids, body = own.column("id").to_numpy(), own.column("vector").chunk(0)
            vectors = np.stack([np.frombuffer(x.tobytes(), dtype=np.int64) for x in slices(body)])
            coded = own.column("label").chunk(0).dictionary_encode()
            tree = Tree.grown(vectors, ids, coded.indices.to_numpy().astype(np.int32), m2)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([group[0].column("shard")[0].as_py()]), "m2": pa.array([m2]), "dims": pa.array([dims], pa.int32()), "names": pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())),
                **{k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in (("ids", tree.ids), ("labels", tree.labels), ("vectors", tree.vectors), ("points", tree.points), ("bounds", np.array(tree.bounds, dtype=np.float64)))},
            })

    schema = "shard long, m2 double, dims int, names array<string>, ids binary, labels binary, vectors binary, points binary, bounds binary"
    return settle(dealt.repartition("shard").sortWithinPartitions("shard", "row").mapInArrow(grow, schema), "trees", "zstd")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tree, list[str]]]:
    for batch in batches:
        for r in batch.to_pylist():
            of = lambda c, t: np.frombuffer(r[c], dtype=t)  # noqa: B023, E731
            yield Tree(of("vectors", np.int64).reshape(-1, r["dims"]), of("ids", np.int64), of("labels", np.int32), of("points", np.int64), of("bounds", np.float64).reshape(-1, 4), r["m2"]), r["names"]


def _search(index: DataFrame, queries: DataFrame, find, schema: str, block: int) -> DataFrame | None:
    """``find(walk_of, tree, label's number or -1, query row)`` -> rows, for each query (query, id, label, v, ...) in each tree; ``walk_of(takes)`` is its Walk."""
    spark, found = index.sparkSession, None
    shape = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    size = max(1, min(block, BLOCK_BYTES // (8 * max(shape[1] or 0, 1))))
    blocks = -(-shape[0] // size)
    for i in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).collect()  # a block
        shared = spark.sparkContext.broadcast(asked)

        @frees
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            for tree, names in _trees(batches):
                number, nodes, dims, out = {x: i for i, x in enumerate(names)}, tree.nodes(), tree.vectors.shape[1], []
                queries = [np.array(r["v"] + [0] * (dims - len(r["v"])), dtype=np.int64) for r in asked]
                kind = exact_kind(tree.vectors, np.stack(queries))
                rows = tree.vectors.astype(kind)
                for r, q in zip(asked, queries, strict=True):
                    out += find(partial(Walk, tree, nodes, rows, q.astype(kind)), tree, number.get(r["label"], -1), r)
                if out:
                    yield pa.RecordBatch.from_pylist(out)

        own = settle(index.mapInArrow(run, schema), "found")
        found = own if found is None else found.unionByName(own)
    return found


def _first(found: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    """The k highest scores by ``by``, the smallest id of equals; Spark limits the groups ahead of the shuffle too."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor is a row for which ``is_anchor`` (of ``id``) holds; its positives
    are the first ``positives`` rows of its label and another identifier, by
    score, then identifier. For each positive of score p it has the first ``k``
    rows of other labels with low * p <= 100 * score <= high * p. Rows with a
    null identifier, label, vector or component, or one that is not finite,
    take no part. Rows that repeat are rows of their own, as anchors too. A
    shorter vector counts as filled up with 0. Sums must fit into 64 bits. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors, id_col, vector_col, label_col, scale)
    index = build_index(rows, shard_rows)
    anchors = settle(rows.where(is_anchor).withColumn("query", F.monotonically_increasing_id()), "anchors")

    def same(walk_of, tree: Tree, label: int, r) -> list[dict]:
        walk = walk_of((tree.labels == label) & (tree.ids != r["id"]))
        return [{"query": r["query"], "id": i, "score": s} for s, i in islice(walk.nearest(), positives)]

    found = _search(index, anchors, same, "query long, id long, score long", block)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    best = settle(_first(found, ["query"], positives, "place").withColumn("place", F.col("place").cast("long")), "positives")
    pairs = anchors.join(best.groupBy("query").agg(F.collect_list(F.struct("place", "score")).alias("own")), "query")  # a few for each

    def other(walk_of, tree: Tree, label: int, r) -> list[dict]:
        walk, out, known = walk_of(tree.labels != label), [], {}
        for place, p in r["own"]:
            window = -(-low * p // 100), high * p // 100
            if window[0] > window[1]:
                continue
            if window not in known:
                known[window] = list(islice(walk.nearest(*window), k))
            out += [{"query": r["query"], "place": place, "id": i, "score": s} for s, i in known[window]]
        return out

    negatives = _search(index, pairs, other, "query long, place long, id long, score long", block)
    if negatives is None:
        negatives = spark.createDataFrame([], "query long, place long, id long, score long")
    ranked = _first(negatives, ["query", "place"], k, "rank").select("query", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best.select("query", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select("query", F.col("id").alias("anchor_id")), "query")
    return ranked.join(named, ["query", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
